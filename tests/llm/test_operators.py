"""The operators against brute force, on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.llm import components, decontamination, jaccard_join, knn_quality, language_id, line_dedup, piece_tokens, quality_rules, sharding, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["alpha", "beta", "Gamma", "delta", "épée", "zeta", "eta", "theta", "the", "of", "|", "x%%%", "iota."]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample(seed=1, n=60):
    """Texts of several kinds: long, empty, null, blank, repeated under one id and under others."""
    r = random.Random(seed)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.choice([3, 40, 90]))) for _ in range(n)]
    base = "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(8))
    near = [base.replace("alpha", "omega", k) for k in range(8)]
    rows = [(i, t) for i, t in enumerate([*texts, *near, base, base, "", None, " \t\n ", "x", "a b c", "one line of shared boilerplate text\nq", "one line of shared boilerplate text\nr", " ONE line of shared boilerplate text\t\ns"])]
    return [(i, t, None if i % 7 == 0 else "en", "src", None) for i, t in rows] + [(3, texts[3], "en", None, 1), (None, base, "en", "src", 2), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), DOC).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def lines_oracle(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n") if i is not None else ():
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t, *_ in rows:
        each = (t or "").split("\n")
        kept = [x for x in each if i is None or len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out.append((i, len(each), len(each) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(docs, empty):
    assert Counter(map(tuple, line_dedup.digest(docs).collect())) == lines_oracle(sample())
    assert line_dedup.digest(empty).count() == 0
    kept = line_dedup.dedup_lines(docs.withColumnRenamed("source", "n_lines").withColumnRenamed("lang", "drops"), batches=1)
    assert kept.columns == ["doc_id", "text", "drops", "n_chars", "n_lines", "n_dropped"]
    assert kept.count() == docs.count()


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, 2)
    for k in range(4):
        runs.add(spark.createDataFrame([(k, 1, 1), (k, k, 2)], "doc_id long, h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    # the run has each hash once, as the first batch had it; what came later are hits
    assert {(r.h1, r.h2): (r.n_docs, r.holder) for r in runs.runs()[0].collect()} == {(1, 1): (1, 0), **{(k, k if k != 1 else 1, ): (1, k) for k in ()}, (0, 2): (1, 0), (1, 2): (1, 1), (2, 2): (1, 2), (3, 2): (1, 3)}
    assert [(r.h1, r.h2, r.n_docs, r.holder) for r in runs.repeated(3).collect()] == [(1, 1, 4, 3)]
    assert runs.repeated(1).count() == 5
    runs.add(spark.createDataFrame([(9, 1, 1), (9, 9, 9)], "doc_id long, h1 long, h2 long"))
    join = runs._merged(*runs.runs()[:2])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in join


def sets_oracle(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    ids = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            ids[root(k)] = min(i, ids.get(root(k), i))
    return Counter((i, len(s), ids.get(root(k)) if s else i) for k, ((i, *_), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 500_000), (5, 80, 60)])
def test_jaccard_join(docs, width, percent, block):
    found = jaccard_join.join_components(docs, width=width, percent=percent, block=block, sketch_bits=12, list_rows=3 if block == 60 else 50_000)
    assert Counter(map(tuple, found.collect())) == sets_oracle(sample(), width, percent)


def test_jaccard_join_of_near_copies(spark):
    r = random.Random(11)
    pool = [f"w{i}" for i in range(400)]
    bases = [[r.choice(pool) for _ in range(n)] for n in (12, 60, 61, 150) for _ in range(3)]
    passage = [r.choice(pool) for _ in range(55)]
    rows = []
    for i in range(150):
        w = list(bases[i % len(bases)]) + (passage if i % 5 == 0 else [])
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = r.choice(pool)
        rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"list_rows": 4, "block": 300, "sketch_bits": 10}):
        found = jaccard_join.join_components(frame, **options).collect()
        assert Counter(map(tuple, found)) == sets_oracle(rows, 4, 85)


def test_merge_skip_is_exact():
    r = np.random.default_rng(4)
    index = jaccard_join.BlockIndex([np.unique(r.integers(0, 60, r.integers(1, 40)).astype(np.uint64)) for _ in range(70)])
    for least in (1, 2, 5, 9):
        picked = r.choice(len(index.tokens), 20, replace=False)
        lists = [(int(index.first[k]), int(index.first[k] + index.length[k])) for k in picked]
        truth = Counter(x for a, b in lists for x in index.owners[a:b])
        found, counts = index.merge(lists, least)
        assert dict(zip(found.tolist(), counts.tolist())) == {k: v for k, v in truth.items() if v >= least}


def test_jaccard_edges(spark, docs, empty):
    assert jaccard_join.join_components(empty).count() == 0
    assert jaccard_join.join_components(docs.where("doc_id is null")).count() == 2
    kept = jaccard_join.one_of_each(docs, width=5, percent=80)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 3").count() == 1
    twice = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "q r s t u v w x")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.one_of_each(twice).collect())) == [(1, "a b c d e f g h"), (2, "q r s t u v w x")]
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in sets_oracle([x for x in sample() if x[0] is not None], 5, 80) if i == c} | {None}


def test_block_search_is_exact():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**60, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 120, replace=False), r.integers(0, 2**60, 5, dtype=np.uint64)])) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[:-k], s[:1]])) for s in sets[:6] for k in (1, 9, 30)]
    index = jaccard_join.BlockIndex(sets)
    for q in sets:
        truth = [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s))]
        assert index.search(q, 85).tolist() == truth


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(5))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {(r.vertex, r.label) for r in found.collect()} == {(x, root(x)) for x in linked}


def test_sharding(docs, empty):
    found = sharding.shard_documents(docs, shards=6, piece_rows=2).collect()
    assert len(found) == docs.count()
    assert {r.law for r in found} == {"bytes"}
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    of_text = {}
    for r in found:
        of_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(x) == 1 for x in of_text.values())
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= max(sizes.values()) * 0.2
    assert sharding.shard_documents(empty).count() == 0
    again = sharding.shard_documents(docs.repartition(7, "text"), shards=6, piece_rows=2).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in again) == Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in found)


def test_sharding_of_clashing_columns(spark):
    names = ["parcel", "piece", "nth", "group_size", "shard", "packer"]
    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i, i, i, i, i) for i in range(30)], ", ".join(f"{n} long" for n in names))
    found = sharding.shard_groups(rows, ["parcel"], "nth", shards=2, piece_rows=2)
    assert found.columns == ["parcel", "piece", "nth", "group_size", "packer", "shard", "slot"]
    assert sorted(r.piece for r in found.collect()) == list(range(30))
    homes = {}
    for r in found.collect():
        homes.setdefault(r.parcel, set()).add(r.shard)
    assert all(len(x) == 1 for x in homes.values())


def test_best_fit():
    r = random.Random(3)
    sizes = sorted((r.randrange(1, 60) for _ in range(200)), reverse=True)
    bins, plain = [], []
    for s in sizes:
        fits = [(room, k) for k, room in enumerate(plain) if room >= s]
        k = min(fits)[1] if fits else len(plain)
        plain += [100] * (k == len(plain))
        plain[k] -= s
        bins.append(k)
    assert list(sharding.best_fit(sizes, 100)) == bins
    shares = Counter()
    for s, k in zip(sizes, sharding.even_bins(sizes, 7), strict=True):
        shares[k] += s
    assert len(shares) == 7
    assert max(shares.values()) <= sum(sizes) / 7 + 2


def test_quality_rules(spark, docs, empty):
    trusted = docs.where("doc_id % 2 = 0 and text not like '%\\%%'").select("doc_id")
    found = quality_rules.rate(docs, trusted).collect()
    assert len(found) == docs.count()
    truth = Counter()
    for i, t, *_ in sample():
        w = words(t)
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k, x in enumerate(zip(w, w[1:], w[2:])) if n[x] > 1 for d in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        truth[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == truth
    assert all(not r.kept or not r.base_failed for r in found)
    assert quality_rules.rate(empty, trusted).count() == 0
    assert {r.ratio for r in quality_rules.rate(docs, trusted.limit(0)).collect()} == {0.0}


def test_ratio_against_brute_force(spark):
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    one = lambda w: signed(xxhash.xxh64_intdigest(w[-3:].encode(), 42)) % 512
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["good", "fine", "text", "is", "here", "%%%", "###"][: 5 if i % 3 else 7]) + str(r.randrange(30)) for _ in range(60))) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = [i for i, _ in rows if i % 3]
    found = {x.doc_id: x.ratio for x in quality_rules.rate(frame, spark.createDataFrame([(i,) for i in trusted], "doc_id long"), buckets=512).collect()}

    def grams(text):
        w = words(text)
        pairs = []
        for a, b in zip(w, w[1:]):
            h = 42
            for part in (a[-3:], "+", b[-3:]):
                h = xxhash.xxh64_intdigest(part.encode(), h)
            pairs.append(signed(h) % 512)
        return [one(x) for x in w] + pairs

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        target.update(grams(t) if i in trusted else [])
    a, b = sum(target.values()) + 512, sum(raw.values()) + 512
    for i, t in rows:
        g = grams(t)
        assert found[i] == pytest.approx(sum(np.log((target[x] + 1) / a) - np.log((raw[x] + 1) / b) for x in g) / len(g), abs=1e-9)


def test_ratio_reads_whole_words(spark):
    r = random.Random(6)
    stems = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(5)) for _ in range(120)]
    good, junk = [x + "ing" for x in stems[:60]], [x + "ing" for x in stems[60:]]
    rows = [(i, " ".join(r.choice(junk if i % 4 == 0 else good) for _ in range(80))) for i in range(80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = frame.where("doc_id % 4 in (1, 2)").select("doc_id")
    found = {x.doc_id: x for x in quality_rules.rate(frame, trusted, whole=1 << 20).collect()}
    assert not any(x.base_failed for x in found.values())
    assert {i for i, x in found.items() if x.kept} == {i for i, _ in rows if i % 4}
    grams = lambda t: [("e", x[-3:]) for x in words(t)] + words(t) + list(zip(words(t), words(t)[1:]))
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i % 4 in (1, 2) for g in grams(t))
    share = target.total() / raw.total()
    for i, t in rows[:8]:
        # distinct pairs seldom share a bucket of the 2^20
        assert found[i].ratio == pytest.approx(np.mean([np.log((target[g] + 10) / (raw[g] * share + 10)) for g in grams(t)]), abs=1e-2)


@pytest.mark.parametrize("bits", [64, 1 << 10, None])
def test_marks_at_any_table_size(spark, bits):
    ids = [None, -5, *range(0, 4000, 7), 14, 14]
    frame = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    trusted = spark.createDataFrame([(i,) for i in [None, -5, *range(0, 6000, 3), 21]], "doc_id long")
    found = Counter(map(tuple, quality_rules._marked(frame, trusted, bits).select("doc_id", "text", "good").collect()))
    assert found == Counter((i, f"text {i}", int(i is not None and (i == -5 or i % 3 == 0))) for i in ids)
    assert {r.good for r in quality_rules._marked(frame, trusted.limit(0), bits).collect()} == {0}


def test_query_reads_whole_words(spark, tmp_path):
    from echogrid.llm import queries

    r = random.Random(7)
    pools = [["".join(r.choice("abcdefghilmnoprstu") for _ in range(5)) + "ing" for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join(r.choice(pools[i % 4 == 0]) for _ in range(80))) for i in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80) if i % 4 in (1, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {x.doc_id for x in queries.op6_quality_rules(spark, str(tmp_path)).where("kept").collect()} == {i for i in range(80) if i % 4}


def distance(pattern, text):
    """The least edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    r = random.Random(6)
    for _ in range(60):
        p, t = ("".join(r.choice("ab ") for _ in range(r.randrange(1, n))) for n in (90, 160))
        assert decontamination.myers(decontamination.letter_masks(p), len(p), t) == distance(p, t)


def test_decontamination(spark, docs, empty):
    r = random.Random(8)
    item = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    broken = item[:30] + "Z" + item[31:60] + item[62:]
    far = "".join(c if k % 5 else "#" for k, c in enumerate(item))
    rows = [(0, "x " + item.upper().replace(" ", "\n", 3) + " y"), (1, "..." + broken), (2, far), (3, None), (4, ""), (5, "tiny"), (6, "a tiny thing"), (None, item), (0, item)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, " Tiny "), (None, "zz" * 30)], "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.errors) for x in decontamination.matches(frame, items).collect()}
    low = item.translate(LOW)
    assert found == {(0, 7, 0), (1, 7, distance(low, broken.translate(LOW))), (5, 10, 0), (6, 10, 0), (None, 7, 0)}
    assert found == {(x.doc_id, x.item_id, x.errors) for x in decontamination.matches(frame, items, block_chars=40).collect()}
    kept = decontamination.decontaminate(frame.withColumnRenamed("source", "hit_doc"), items)
    assert kept.columns == ["doc_id", "text", "lang", "hit_doc", "n_chars"]
    assert sorted(x.doc_id for x in kept.collect()) == [2, 3, 4]
    assert sorted(x.doc_id for x in decontamination.decontaminate(frame, items, block_chars=40).collect()) == [2, 3, 4]
    assert decontamination.matches(empty, items).count() == decontamination.matches(docs, items.limit(0)).count() == 0


def test_pieces_equal_the_library(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.MODEL)
    odd = [(100, "  lead and  trail  "), (101, "日本語 ﬁ \U0001f600\t<s> <0x0A> \r\n\n"), (102, "▁mark ▁▁x"), (103, "a" * 3000 + " " * 50 + "b"), (104, " ".join(f"w{i % 977}é{i}" for i in range(150_000)))]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    for r in piece_tokens.decode(piece_tokens.encode(frame.withColumn("decoded", F.lit(1)), decoded="same", cache_bytes=2000)).collect():
        assert r.ids == model.encode(r.text or "")
        assert r.decoded == r.same == (r.text or "").replace("▁", " ")
    assert piece_tokens.digest(empty).count() == 0
    assert piece_tokens.digest(docs).where("not round_trip").count() == 0


def test_words_are_encoded_once(monkeypatch):
    model = piece_tokens.Vocabulary({"a": (0, 0.0)}, [], 9)
    fresh = Counter()

    def encode_words(words):
        fresh.update(words)
        return ((w, [int(w)]) for w in words)

    monkeypatch.setattr(model, "encode_words", encode_words)
    cache = piece_tokens.WordCache(model, piece_tokens.DIGEST_CACHE)
    batches = [[[str(i) for i in range(k, k + 10_000)], [], [str(k), str(k)]] for k in range(0, 200_000, 10_000)]
    for rows in [*batches, *batches]:
        assert cache.ids_of(rows) == [np.array([int(w) for w in words], "<i4").tobytes() for words in rows]
    assert set(fresh.values()) == {1}


def test_unigram_pieces():
    r = random.Random(9)
    pieces = {p: (i, -r.random() * 5 - 1) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca", "bca", "cab"])}
    model = piece_tokens.Vocabulary(pieces, [], 99, "unigram")

    def best(word):
        ways = {0: (0.0, [])}
        for i in range(1, len(word) + 1):
            ways[i] = max((ways[j][0] + pieces[word[j:i]][1], [*ways[j][1], pieces[word[j:i]][0]]) for j in range(i) if j in ways and word[j:i] in pieces)
        return ways[len(word)]

    for word, ids in model.encode_words(sorted("▁" + "".join(r.choice("abc") for _ in range(r.randrange(1, 12))) for _ in range(80))):
        assert sum(s for i in ids for k, s in pieces.values() if k == i) == pytest.approx(best(word)[0])


def test_warc(spark):
    big = "<p>é " + "x" * 200
    rows = [(1, "http://a/ b", big), (2, "http://b", big), (None, "http://c", big), (3, None, None), (4, "", ""), (5, "u", "short"), (6, "u", "short"), (2, "http://b", big), (7, "http://d", big + "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    index = warc.write(pages, __import__("echogrid.llm.common", fromlist=["x"]).shared_dir(spark, "warc-test"))
    assert index.count() == len(rows)
    back = warc.read(index).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in back) == Counter(
        (i, "revisit" if h == big and i != 1 else "response", 1 if h == big and i != 1 else None, len((h or "").encode())) for i, _, h in rows
    )
    for r in back:
        if r.payload is not None:
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    assert {r.page_id for r in warc.read(index.where("page_id in (3, 7)"), gap=0).collect()} == {3, 7}
    assert warc.digest(pages.limit(0)).count() == 0


def test_language_id(spark, empty):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.digest(data).alias("p").join(data.alias("d"), "doc_id").selectExpr("held_out", "lang_pred = lang as right").collect()
    assert sum(r.right for r in found if r.held_out) >= 0.95 * sum(r.held_out for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "a"), (None, "the text of this")], "doc_id long, text string")
    model = language_id.fit(language_id.learnable(data))
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in language_id.identify(odd, model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] != "und"
    assert language_id.digest(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}


def test_language_sample_has_a_quota(spark, monkeypatch):
    r = random.Random(12)
    pool = {"en": ["the", "house", "which", "with"], "es": ["casa", "que", "niño", "para"], "fr": ["maison", "quelle", "vous", "été"]}
    text = lambda lang: " ".join(r.choice(pool[lang]) for _ in range(20))
    rows = [(i, text("en"), "en") for i in range(3000)] + [(5000 + i, text("es"), "es") for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(frame, most=60)
    assert sorted(x for names in model.families for x in names) == ["en", "es"]
    assert [x.lang_pred for x in language_id.identify(spark.createDataFrame([(1, text("es"))], "doc_id long, text string"), model).collect()] == ["es"]
    # one document of many rows and a low hash takes one place, and one histogram
    hot = spark.range(400).selectExpr("id", "xxhash64(id) h").orderBy("h").first()[0]
    rows = [(hot, text("en"), "en")] * 500 + [(hot, text("en"), "en") for _ in range(50)] + [(1000 + i, text(x), x) for i in range(60) for x in ["en", "es", "fr"][i % 3 :][:1]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    assert {x.language: x["count"] for x in language_id.chosen(frame, 60).groupBy("language").count().collect()} == {"en": 20, "es": 20, "fr": 20}
    sizes = []
    monkeypatch.setattr(language_id, "svm", lambda x, y, plain=language_id.svm: sizes.append(len(x)) or plain(x, y))
    model = language_id.fit(frame, most=60)
    assert sorted(x for names in model.families for x in names) == ["en", "es", "fr"]
    assert max(sizes) == 60


def test_quality_votes(spark, empty):
    data, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = knn_quality.digest(data, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in found) >= 0.95 * len(found)
    assert knn_quality.digest(empty, labels).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2)], "doc_id long, text string, score int")
    assert [r.score for r in knn_quality.rate(odd, None, score="score").collect()] == [0.5, 0.5]


def test_quality_shows_in_words(spark):
    r = random.Random(8)
    good, spam = (["".join(r.choice("abcdefghilmnoprstu") for _ in range(6)) for _ in range(80)] for _ in range(2))
    text = lambda pool: " ".join(r.choice(pool) for _ in range(60)).capitalize() + "."
    rows = [(i, text(spam if i % 2 else good), 1 - i % 2) for i in range(300)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = knn_quality.digest(data.drop("quality"), data.drop("text")).join(data, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in found) >= 0.95 * len(found)
    # word salad: the same words, whose neighbours alone tell it from fixed phrases
    phrases = [" ".join(r.sample(good, 4)) for _ in range(25)]
    rows = [(i, text(" ".join(phrases).split() if i % 2 else phrases), 1 - i % 2) for i in range(300)]
    rows = [(i, " ".join(t.split()[:60]), q) for i, t, q in rows]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    found = knn_quality.digest(data.drop("quality"), data.drop("text")).join(data, "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in found) >= 0.85 * len(found)


def test_toxicity(spark, empty):
    r = random.Random(10)
    plain = ["".join(r.choice(["an", "er", "th", "on", "re"]) for _ in range(r.randrange(1, 4))) for _ in range(300)]
    text = lambda bad: " ".join([r.choice(plain) for _ in range(120)] + [w for w in bad] + [r.choice(plain) for _ in range(20)])
    toxic = ["scum", "idiot", "moron"]
    y = np.array([i % 2 for i in range(160)])
    net = toxicity.train([text([r.choice(toxic)]) if v else text([]) for v in y], y, steps=150)
    rows = [(1, text(["idiot"])), (2, text([])), (3, None), (4, ""), (5, "scum"), (5, "scum"), (None, text(["moron,"]))]
    out = [(x.doc_id, x.toxicity) for x in toxicity.rate(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()]
    assert [s >= 0.5 for _, s in out] == [True, False, out[2][1] >= 0.5, out[3][1] >= 0.5, True, True, True]
    assert out[2][1] == out[3][1]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.digest(empty, labels).count() == 0


def test_windows_cover_all_words():
    texts = ["a " * n for n in (0, 1, 47, 48, 49, 80, 81, 300)]
    raw = [t.encode() for t in texts]
    w = toxicity.Words.of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    row, first, size = w.windows()
    seen = np.zeros(len(w.word), int)
    for f, s in zip(first, size, strict=True):
        seen[f : f + s] += 1
    assert (seen > 0).all()
    assert np.bincount(row, minlength=8).tolist() == [0, 1, 1, 1, 2, 2, 3, 9]
