"""Helpers shared by the text operators: scratch space, label folds, byte kernels.

The byte kernels work on the UTF-8 buffer of a whole Arrow string column, so
that words are found, lower-cased and hashed with a handful of NumPy passes and
no Python object per word.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The word separators of every contract: blank, tab, LF, VT, FF, CR.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(SPACE_BYTES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = bytes(LOWER)

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
POWER = 0x9E3779B97F4A7C15 | 1
_codes = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
CODES = np.where(SPACE, np.uint64(0), _codes)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only where that is unset and
    Spark runs in one process, as in tests, a folder of this machine stands in.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: this cuts lineage and survives executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], rows: str, how: str = "inner", most: int = 2000) -> DataFrame:
    """left joined (inner or left) with right (null-safe equal keys), where right has each key once and, in `rows`, how many rows of left have it.

    A key that holds more than a share of 1 in `most` of all these rows is split
    by a hash of left's row, so no task gets all rows of a frequent key. At most
    `most` keys are that frequent, which bounds what is broadcast.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    share = max(1, -(-total // most))
    salts = F.floor((F.col(rows) - 1) / share).cast("long")
    hot = right.where(F.col(rows) > share)
    taken = "_" * max(len(c) for c in left.columns + right.columns)
    salt, its, own = (f"{taken}{x}" for x in ("salt", "salts", "right_salt"))
    hot = hot.select(*[F.col(b).alias(f"hot_{i}") for i, (_, b) in enumerate(keys)], (salts + 1).alias(its))
    same = [left[a].eqNullSafe(hot[f"hot_{i}"]) for i, (a, _) in enumerate(keys)]
    order = [c for c, kind in left.dtypes if not kind.startswith(("map", "variant"))]
    salted = left.join(F.broadcast(hot), same, "left").select(*left.columns, F.coalesce(F.pmod(F.xxhash64(*order), F.col(its)), F.lit(0)).alias(salt))
    spread = right.withColumn(own, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), salts))))
    both = [salted[a].eqNullSafe(spread[b]) for a, b in keys]
    return salted.join(spread, [*both, salted[salt] == spread[own]], how).drop(salt, own)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold that the label contracts name. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def widened(df: DataFrame, columns: str) -> T.StructType:
    """df's schema with the columns of a DDL string at its end."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(columns).fields])


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the rows' offsets in them; null rows have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.string()), False
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, most: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most `rows` rows and about `most` bytes: (first row, end row, bytes, offsets). A longer text is a run by itself."""
    text, offs = buffers(column)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, a + rows)
        yield a, b, text[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def bounds(text: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and where each row's words begin (n + 1 numbers)."""
    solid = ~space[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 17 << 16)
        for i, p in enumerate((POWER, pow(POWER, -1, 1 << 64))):
            out = np.full(size, p, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def word_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at `starts`: a polynomial over random codes of the bytes, then mixed.

    Bytes are taken in slices of whole words of about a megabyte.
    """
    out, a = np.zeros(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + (1 << 20))))
        part = text[starts[a] : starts[b] if b < len(starts) else len(text)]
        up, down = powers(len(part))
        out[a:b] = np.add.reduceat(CODES[part] * up[: len(part)], starts[a:b] - starts[a]) * down[starts[a:b] - starts[a]]
        a = b
    return mix(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n_folds: int, held_out: int, most: int) -> DataFrame:
    """At most `most` labelled rows outside the held-out fold as (doc_id, text, label), half of them of each class where there are as many.

    The rows are chosen by a hash of the id; `most` bounds what a model is
    fitted on. Rows without id or label never enter; an id with several labels
    has the largest.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    marks = marks.where(fold("doc_id", n_folds) != held_out)
    half = [marks.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for v in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(half[0].unionByName(half[1])), "doc_id").select("doc_id", "text", "label")
