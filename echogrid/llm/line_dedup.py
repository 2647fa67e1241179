"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, holder), bucketed and sorted by the 128-bit
hash of a line's key, one row per hash. Documents arrive in batches. A batch's
hashes are merge-anti-joined against all runs: those that no run has become a
run of level 0, so no hash is in two runs; those that a run has are hits, kept
beside the runs. As soon as a level has `fanout` runs they are merged into one
run of the next level. Runs have one bucketing and one order, so neither the
anti-join nor a merge shuffles a run. At the end a hash's documents are those of
its run plus those of its hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes that continue a code point, to count code points in UTF-8.
_CONTINUES = bytes(range(0x80, 0xC0))
#: Parts of the stored line hashes; a batch is one or more of them.
_SLICES = 24


def line_key(line: bytes) -> bytes:
    return line.strip(common.SPACE_BYTES).translate(common.LOWER_TABLE)


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.translate(None, _CONTINUES))


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> Iterator[bytes]:
    raw, offs = common.buffers(column)
    raw = raw.tobytes()
    return (raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2): each key of a document once, if it has at least min_chars code points."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, second = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                found = {_digest(k) for k in map(line_key, text.split(b"\n")) if len(k) >= min_chars and _code_points(k) >= min_chars}
                ids += [doc] * len(found)
                first += [int.from_bytes(d[:8], "big", signed=True) for d in found]
                second += [int.from_bytes(d[8:], "big", signed=True) for d in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64())], ["doc_id", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(keys, "doc_id long, h1 long, h2 long")


class LineRuns:
    """Levelled runs in the shared folder; see the module's text."""

    def __init__(self, spark: SparkSession, buckets: int = 8, fanout: int = 2):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[DataFrame]] = []
        self.hits: list[DataFrame] = []

    def runs(self) -> list[DataFrame]:
        """All runs, older ones first."""
        return [run for level in reversed(self.levels) for run in level]

    def _sorted(self, df: DataFrame, label: str) -> DataFrame:
        """df as a bucketed and sorted table in the shared folder; the catalog does not keep its name."""
        name = f"line_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", common.shared_dir(self.spark, label)).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")
        return out

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2). A document's rows all belong to one batch."""
        batch = hashes.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("holder")).repartition(self.buckets, "h1", "h2")
        batch = batch.withColumn("known", F.lit(False))
        for run in self.runs():
            held = run.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            batch = batch.join(held.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left").select("h1", "h2", "n_docs", "holder", (F.col("known") | F.col("r1").isNotNull()).alias("known"))
        batch = self._sorted(batch, "line-batch")
        if self.levels:
            self.hits.append(batch.where("known").drop("known"))
        self._put(0, batch.where("not known").drop("known"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._sorted(reduce(self._merged, full), f"line-run-{level + 1}"))

    @staticmethod
    def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
        """Two runs merged along their order; they have no hash in common, so each row is of one of them."""
        new = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns])
        both = old.join(new.hint("merge"), (F.col("h1") == F.col("new_h1")) & (F.col("h2") == F.col("new_h2")), "full_outer")
        return both.select(*[F.coalesce(c, f"new_{c}").alias(c) for c in old.columns])

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, n_docs, holder) of the hashes in at least min_docs documents."""
        runs = reduce(DataFrame.unionByName, self.runs())
        if not self.hits:
            return runs.where(F.col("n_docs") >= min_docs)
        hits = reduce(DataFrame.unionByName, self.hits).groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("holder").alias("later")).withColumnsRenamed({"h1": "k1", "h2": "k2"})
        # most hashes are in one document and were never hit
        total = runs.join(hits, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left").where(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= min_docs)
        return total.select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("holder", "later").alias("holder"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 3, fanout: int = 2, batch_rows: int = 2_000_000_000, bucket_rows: int = 20_000_000) -> DataFrame:
    """docs with the repeated lines taken out of `text`, and n_lines, n_dropped (long) added.

    A line's key is the line, stripped of ASCII white space and with A-Z in
    lower case. A key of at least min_chars code points in at least min_docs
    documents loses all its lines except in the largest doc_id that holds it.

    Null text counts as one empty line and becomes the empty text. A row
    without doc_id keeps its text and is not counted. Rows that share a doc_id
    are one document: they count once and keep or lose a line together. Other
    columns pass through; columns named n_lines or n_dropped are replaced. An
    empty table gives an empty result. Whole texts of any length are read.

    There are at least `batches` batches, and more (up to _SLICES) where one
    would have over batch_rows lines; a run has a bucket for each bucket_rows lines. A
    line of very many documents is split before it is joined.
    """
    spark = docs.sparkSession
    hashes = line_hashes(docs, min_chars).withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(_SLICES)).cast("int"))
    path = common.shared_dir(spark, "line-hashes")
    hashes.write.partitionBy("slice").parquet(path)
    hashes = spark.read.schema("doc_id long, h1 long, h2 long, slice int").parquet(path)
    rows = hashes.count()
    batches = min(_SLICES, max(batches, -(-rows // batch_rows)))
    index = LineRuns(spark, max(8, -(-rows // bucket_rows)), fanout)
    for k in range(batches):
        index.add(hashes.where(F.pmod(F.col("slice"), F.lit(batches)) == k).drop("slice"))
    lines = common.stored(index.repeated(min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n_docs", "holder"), "common-lines")
    found = common.split_join(hashes.drop("slice"), lines, [("h1", "k1"), ("h2", "k2")], "n_docs")
    drops = found.where("doc_id <> holder").groupBy("doc_id").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    kept = docs.drop("n_lines", "n_dropped")
    drop_name, id_name = common.free_name(kept, "drops"), common.free_name(kept, "line_doc")
    drops = drops.select(F.col("doc_id").alias(id_name), F.col("drops").alias(drop_name))
    kept = kept.join(drops, F.col("doc_id").cast("long") == F.col(id_name), "left").drop(id_name)
    schema = common.widened(kept.drop(drop_name), "n_lines long, n_dropped long")
    text_at, drop_at = kept.columns.index("text"), kept.columns.index(drop_name)

    def strip(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, lines, gone = [], [], []
            for text, drop in zip(_texts(batch.column(text_at)), batch.column(drop_at).to_pylist(), strict=True):
                n, rest = text.count(b"\n") + 1, None
                if drop:
                    away = {x["h1"].to_bytes(8, "big", signed=True) + x["h2"].to_bytes(8, "big", signed=True) for x in drop}
                    rest = [x for x in text.split(b"\n") if len(x) < min_chars or _digest(line_key(x)) not in away]
                    text = b"\n".join(rest)
                texts.append(text)
                lines.append(n)
                gone.append(0 if rest is None else n - len(rest))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != drop_at]
            names = [c for i, c in enumerate(batch.schema.names) if i != drop_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    return kept.mapInArrow(strip, schema)


def digest(docs: DataFrame, **options: int) -> DataFrame:
    """What the query returns of dedup_lines: doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup_lines(docs.select("doc_id", "text"), **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
