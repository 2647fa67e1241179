"""The trained models against plain loops, and every operator on very long texts, empty tables and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from echogrid.llm import common, decontamination, jaccard_join, knn_quality, language_id, line_dedup, piece_tokens, quality_rules, sharding, toxicity, warc

from .test_operators import DOC


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def network(seed=1):
    r = np.random.default_rng(seed)
    net = toxicity.Network(r.standard_normal(1 << toxicity.WORD_BITS), r.standard_normal(1 << toxicity.CHAR_BITS))
    net.p["in_bias"] = r.standard_normal(net.p["in_bias"].shape).astype(np.float32) * 0.3
    return net


def plain_logit(p, words, chars):
    """One window, word by word: two gated layers, attention, logistic unit."""
    h, g = toxicity.HIDDEN, 3 * toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    gates = [p["word"][w] @ p["in_word"] + p["char"][c].max(0) @ p["in_char"] + p["in_bias"] for w, c in zip(words, chars, strict=True)]

    def walk(order, u, at):
        state, out = np.zeros(h), {}
        for t in order:
            x, hu = gates[t][at : at + g], state @ u
            z, r = sig(x[:h] + hu[:h]), sig(x[h : 2 * h] + hu[h : 2 * h])
            n = np.tanh(x[2 * h :] + r * hu[2 * h :])
            state = (1 - z) * n + z * state
            out[t] = state
        return out

    fore, back = walk(range(len(words)), p["fore"], 0), walk(range(len(words) - 1, -1, -1), p["back"], g)
    states = np.array([np.concatenate([fore[t], back[t]]) for t in range(len(words))])
    a = np.exp(states @ p["attend"])
    return float((a / a.sum()) @ states @ p["out"] + p["bias"][0])


def test_network_equals_a_plain_recurrence():
    r, net = random.Random(2), network()
    texts = [" ".join("".join(r.choice("abcdé") for _ in range(r.randrange(1, 7))) for _ in range(n)) for n in (1, 5, 48, 60, 130)]
    words = toxicity.Words.of(*buffers(texts))
    row, first, logits = net.score(words)
    _, _, size = words.windows()
    assert len(row) == 9
    for f, n, logit in zip(first, size, logits, strict=True):
        chars = [words.char[words.char_at[k] : words.char_at[k + 1]] for k in range(f, f + n)]
        assert logit == pytest.approx(plain_logit(net.p, words.word[f : f + n], chars), abs=2e-4)


def test_gradient_equals_finite_differences():
    r, net = np.random.default_rng(3), network(4)
    words = toxicity.Words.of(*buffers(["ab cd abc d " * 9, "x yz"]))
    _, first, size = words.windows()
    gates = net.gates(words).astype(np.float64)
    index = toxicity._places(first, size, len(words.word))
    d = r.standard_normal(len(first)).astype(np.float32)
    loss = lambda: float((net.logits(gates, index)[0] * d).sum())
    _, made = net.logits(gates, index, keep=True)
    grads, inputs = net.gradient(d, index, made)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in g.shape)
            held = net.p[name][at]
            up, down = [(net.p[name].__setitem__(at, held + e), loss())[1] for e in (1e-2, -1e-2)]
            net.p[name][at] = held
            assert g[at] == pytest.approx((up - down) / 2e-2, rel=3e-2, abs=3e-3), name
    for _ in range(6):
        t, w, k = r.integers(0, int(size.min())), r.integers(0, len(first)), r.integers(0, gates.shape[1])
        cell = index[t, w], k
        held = gates[cell]
        up, down = [(gates.__setitem__(cell, held + e), loss())[1] for e in (1e-2, -1e-2)]
        gates[cell] = held
        truth = sum(inputs[i, j, k] for i, j in zip(*np.nonzero(index == cell[0]), strict=True))
        assert truth == pytest.approx((up - down) / 2e-2, rel=3e-2, abs=3e-3)


def test_slices_have_the_windows_of_the_whole_text():
    net = network()
    for n in (1, 47, 48, 49, 96, 111, 112, 113, 144, 160, 161, 300):
        text, offs = buffers([" ".join(f"w{i % 7}" for i in range(n)) + "!" * 8000])
        whole = net.score(toxicity.Words.of(text, offs))[2]
        parts = [net.score(toxicity.Words.of(*s))[2] for s in toxicity.slices(text, offs, 96)]
        assert len(parts) == max(1, -(-(n - 16) // 96))
        assert np.allclose(np.concatenate(parts), whole, atol=1e-5)


def test_machine_is_near_the_optimum():
    r = np.random.default_rng(5)
    x = np.r_[r.normal(0.6, 1, (40, 6)), r.normal(-0.6, 1, (15, 6))].astype(np.float32)
    y = np.r_[np.ones(40), -np.ones(15)].astype(np.float32)
    share = np.where(y > 0, 0.5 / 40, 0.5 / 15)
    loss = lambda w, b: float((share * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 0.5e-3 * (w @ w))
    w, b = np.zeros(6), 0.0
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ w + b)) * share * y
        w, b = w - 0.02 * (1e-3 * w - 2 * slack @ x), b + 0.04 * slack.sum()
    assert loss(*language_id.svm(x, y)) == pytest.approx(loss(w, b), rel=0.1)


def test_languages_equal_a_plain_vote(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(language_id.learnable(data))
    rows = data.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in language_id.identify(data.select("doc_id", "text"), model).collect()}
    for row in rows[:60]:
        raw = row.text.encode().translate(common.LOWER_TABLE)
        total, n = np.zeros(len(model.bias)), max(1, len(raw) - 2)
        for a in range(0, len(raw) - 2):
            code = (raw[a] * 65599 + raw[a + 1]) * 65599 + raw[a + 2]
            total += model.weights[:, ((code * 2654435761) & 0xFFFFFFFF) >> (32 - language_id.BITS)]
        margins = total / n + model.bias
        family = int(np.argmax(margins[: len(model.families)]))
        at = len(model.families) + sum(len(p) for p in model.pairs[:family])
        votes = {name: 0.0 for name in model.families[family]}
        for (i, j), m in zip(model.pairs[family], margins[at:], strict=False):
            p, names = 1 / (1 + np.exp(-3 * m)), model.families[family]
            votes[names[i] if p >= 0.5 else names[j]] += 1
            votes[names[i]] += p / (len(names) + 1)
            votes[names[j]] += (1 - p) / (len(names) + 1)
        assert got[row.doc_id].lang_pred == max(votes, key=votes.get)
    odd = spark.createDataFrame([(1, "²"), (2, "½ ①"), (3, "Ⅷ"), (4, "é"), (5, "日本")], "doc_id long, text string")
    assert {r.doc_id for r in language_id.identify(odd, model).where("lang_pred = 'und'").collect()} == {1, 2, 3}


def test_trigram_slices_add_up():
    text, offs = buffers(["".join(random.Random(1).choice("abc ") for _ in range(1000))])
    whole = np.bincount(language_id.trigrams(text, offs), minlength=(1 << language_id.BITS) + 1)[:-1]
    parts = sum(np.bincount(language_id.trigrams(*s), minlength=(1 << language_id.BITS) + 1)[:-1] for s in language_id.slices(text, offs, 100))
    assert np.array_equal(whole, parts)


def test_votes_equal_plain_cosines():
    r, rng = random.Random(7), np.random.default_rng(7)
    pool = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    text, offs = buffers([" ".join(r.choice(pool) for _ in range(r.randrange(1, 30))) for _ in range(40)] + [""])
    basis = rng.standard_normal((knn_quality.WIDTH, 8)).astype(np.float32)
    labels = rng.integers(0, 2, 50).astype(float)
    vectors = rng.standard_normal((50, 8)).astype(np.float32)
    vectors[10:20] = vectors[0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = knn_quality.Model(basis, vectors, labels, 0.3)
    columns, logs, at = knn_quality.terms(text, offs)
    got = model.vote(model.embed(columns, logs, at), 5, block=7)
    for k in range(41):
        v = sum((basis[c] * x for c, x in zip(columns[at[k] : at[k + 1]], logs[at[k] : at[k + 1]], strict=True)), np.zeros(8))
        cosines = [float(v @ u) / max(1e-9, float(np.linalg.norm(v))) for u in vectors]
        least = sorted(cosines)[-5]
        weight = [max(0.0, c) ** 8 if c >= least - 1e-6 else 0.0 for c in cosines]
        truth = np.dot(weight, labels) / sum(weight) if sum(weight) > 1e-12 else 0.3
        assert got[k] == pytest.approx(truth, abs=1e-3)


N_LONG = 30_000
LONG = " ".join(f"w{i}" for i in range(N_LONG))
CLASH = "doc_id long, text string, score int, lang_pred int, lang_score int, toxicity int, quality_score int, ids int, decoded int, drops int, hit_doc int, copy_doc int, copy_text int, n_lines int, block int, key int, token int"


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, LONG, "en", "s", None), (2, "short text of words here", "en", "s", None), (3, LONG.replace("w15000", "x"), "en", "s", None)]
    return spark.createDataFrame(rows, DOC).cache()


def test_very_long_texts(spark, long_docs):
    import sentencepiece

    found = {r.doc_id: r for r in jaccard_join.join_components(long_docs).collect()}
    assert [found[k].component_id for k in (1, 2, 3)] == [1, 2, 1]
    assert found[1].n_shingles == N_LONG - 3
    lines = {r.doc_id: r for r in line_dedup.digest(long_docs, min_docs=1).collect()}
    assert lines[1].kept_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert {r.doc_id: r.size for r in sharding.shard_documents(long_docs, shards=2).collect()}[1] == len(LONG) + 16
    model = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.MODEL)
    tokens = {r.doc_id: r for r in piece_tokens.digest(long_docs).collect()}
    assert tokens[1].n_tokens == len(model.encode(LONG))
    assert tokens[1].round_trip
    item = spark.createDataFrame([(7, LONG[-700:])], "item_id long, text string")
    assert {r.doc_id for r in decontamination.matches(long_docs, item).collect()} == {1, 3}
    assert {r.doc_id for r in decontamination.decontaminate(long_docs, item).collect()} == {2}
    net = network()
    scores = {r.doc_id: r.toxicity for r in toxicity.rate(long_docs.select("doc_id", "text"), net).collect()}
    assert scores[1] == pytest.approx(float(toxicity._sigmoid(net.score(toxicity.Words.of(*buffers([LONG])))[2].max())), abs=1e-5)
    rules = {r.doc_id: r for r in quality_rules.rate(long_docs, long_docs.where("doc_id = 2").select("doc_id"), whole=1 << 12).collect()}
    assert (rules[1].n_words, rules[1].n_repeat_words, rules[1].base_failed) == (N_LONG, 0, False)
    labelled = [(label, LONG[:k]) for label, k in ((0, 900), (1, 1300))]
    votes = knn_quality.rate(long_docs.select("doc_id", "text"), knn_quality.fit(spark.createDataFrame(labelled, "label int, text string"))).collect()
    assert all(0 <= r.quality_score <= 1 for r in votes)
    langs = language_id.identify(long_docs.select("doc_id", "text"), language_id.fit(long_docs)).collect()
    assert {r.lang_pred for r in langs} == {"en"}
    pages = spark.createDataFrame([(1, "u", LONG), (2, "v", LONG)], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_digest, r.refers_to) for r in warc.digest(pages).collect()} == {(k, hashlib.sha256(LONG.encode()).hexdigest(), f) for k, f in ((1, None), (2, 1))}


@pytest.mark.parametrize("rows", [0, 3])
def test_clashing_columns_and_empty_tables(spark, rows):
    names = CLASH.split(", ")
    data = [(k, "some words of a text " * 5 if k else None, *[k] * (len(names) - 2)) for k in range(rows)]
    docs = spark.createDataFrame(data, CLASH)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(rows)], "doc_id long, quality int, toxic int")
    lang = docs.withColumn("lang", F.lit("en"))
    outs = {
        "toxicity": (toxicity.rate(docs, network()), "toxicity"),
        "language": (language_id.identify(docs, language_id.fit(lang)), "lang_score"),
        "quality": (knn_quality.rate(docs, knn_quality.fit(labels.select(F.col("quality").alias("label"), F.lit("a b").alias("text")))), "quality_score"),
        "pieces": (piece_tokens.encode(docs, decoded="decoded"), "decoded"),
        "lines": (line_dedup.dedup_lines(docs), "n_lines"),
    }
    for out, made in outs.values():
        kept = set(docs.columns) - {made, "ids", "lang_pred"}
        assert kept <= set(out.columns)
        assert out.columns.count(made) == 1
        got = out.collect()
        assert sorted(r.doc_id for r in got) == list(range(rows))
        assert all(r.token == r.doc_id for r in got)
    assert len(toxicity.digest(docs, labels).collect()) == len(knn_quality.digest(docs, labels).collect()) == rows
    assert len(language_id.digest(lang).collect()) == rows
    for out in (jaccard_join.one_of_each(docs), decontamination.decontaminate(docs, labels.select(F.col("doc_id").alias("item_id"), F.lit("zz").alias("text")))):
        assert out.columns == docs.columns
        assert len(out.collect()) == (2 if rows and out.count() == 2 else rows)
    stage_docs = lang.withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, stage_docs, "").columns == stage_docs.columns, name


def test_slices_count_what_the_whole_text_has(monkeypatch):
    """Slices of every length, cut within and between words, give the counts of the whole text."""
    r = np.random.default_rng(12)
    words = ["a", "A", "bb,", "the", "the", "épée", "x" * 40, "12", "|", "\n", "  "]
    text = " ".join(r.choice(words, 400).tolist())
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = knn_quality.terms(raw, np.array([0, len(raw)]))
    for size in (1, 2, 7, 50, 333, len(raw) - 1):
        monkeypatch.setattr(knn_quality, "SLICE", size)
        parts = knn_quality.terms(raw, np.array([0, len(raw)]))
        for a, b in zip(whole, parts, strict=True):
            assert np.array_equal(a, b), size
    monkeypatch.setattr(knn_quality, "SLICE", 3)
    blank = np.frombuffer(b" \n  \t  ", np.uint8)
    assert len(knn_quality.terms(blank, np.array([0, len(blank)]))[0]) == 0
