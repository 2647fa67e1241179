"""run() against a brute-force version of its stages."""

import random

import sentencepiece

import corpus_pipeline
from echogrid.llm import decontamination, piece_tokens

from .test_operators import DOC, sets_oracle


def plain_lines(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i)) for i, t in rows]


def test_pipeline(spark, tmp_path):
    top = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{top}/documents.parquet").collect()]
    n = max(i for i, _ in rows)
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "123 456 |"), (n + 4, rows[0][1]), (5, next(t for i, t in rows if i == 5))]
    spark.createDataFrame([(i, t, "en" if i > n else None, "s", 1) for i, t in rows], DOC).drop("lang").join(spark.read.parquet(f"{top}/documents.parquet").select("doc_id", "lang"), "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{top}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(got)

    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    kept = plain_lines(kept)
    first = {i for (i, _, c) in sets_oracle(kept, 5, 80) if i == c}
    kept = {i: t for i, t in kept if i in first}
    items = [decontamination.normalised(r.text.encode()) for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    clean = {}
    for i, t in kept.items():
        low = decontamination.normalised(t.encode())
        if not any(p in low or (len(low) >= 0.9 * len(p) and decontamination.myers(decontamination.letter_masks(p), len(p), low) <= int(0.08 * len(p))) for p in items):
            clean[i] = t
    model = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.MODEL)
    assert set(got) == set(clean)
    for i, t in clean.items():
        assert got[i].ids == model.encode(t)
        assert got[i].n_tokens == len(got[i].ids)


def test_texts_of_no_learned_language_go(spark):
    r = random.Random(5)
    rows = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "for (int i = 0; i < n; ++i) { if (x[i] != NULL && y[i] > 0x1f) { buf[k++] = (uint8_t)(x[i] ^ y[i]); } } return k;",
        "".join(r.choice("qwertyuiopasdfghjklzxcvbnm ") for _ in range(400)),
    ]
    planted = [(10**6 + i, t, None, "s", len(t)) for i, t in enumerate(foreign)]
    kept = {x.doc_id for x in corpus_pipeline.keep_known_languages(spark, spark.createDataFrame(rows + planted, DOC), "").collect()}
    assert kept == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}


def test_stages_take_empty_tables_and_nulls(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (1, "", "en", None, 0)]):
        docs = spark.createDataFrame(rows, DOC)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.collect()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
