"""Hard-negative mining by angular triangle filtering.

Each row keeps, beside its whole-number vector, its norm and its angles to some
reference directions. For an anchor a, a row x and a direction r the triangle
inequality of angles gives |ar - xr| <= ax <= min(ar + xr, 2 pi - ar - xr), so a
window of rows with like angles has an interval of cosines, and with the norms an
interval of scores, widened beyond every rounding. Only windows whose interval
meets what an anchor still looks for are scored in whole numbers.

Rows lie in blocks of bounded size. A task holds one block, cut into windows,
and all anchors pass it in batches; each anchor leaves at most a few rows a
block, and a grouped limit merges these. A first pass finds the positives, a
second one the negatives in the windows that the positives' scores span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of a block, of a window in it, and of a piece that is scored at once; anchors of a batch.
BLOCK, WINDOW, PIECE, BATCH = 1 << 16, 128, 4096, 512
#: More than the angles' rounding (stored as 32-bit floats) can amount to, in radians.
SLACK = 4e-6
_NONE = np.iinfo(np.int64).min
_STORED = "vec_id long, label long, q binary, norm double, angles binary, near int, toward float, id_key binary"


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of binaries as a matrix; shorter ones end in zeros."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    width = max((len(x) for x in parts), default=0)
    if all(len(x) == width for x in parts):
        return np.vstack(parts) if parts else np.zeros((0, 0), kind)
    out = np.zeros((len(parts), width), kind)
    for row, x in zip(out, parts, strict=True):
        row[: len(x)] = x
    return out


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, q (whole numbers floor(256 x)) of the rows that take part, each distinct row once.

    Rows take no part without vec_id, label or vector, with a null or non-finite
    component, or with a norm of 2^31 or more, whose scores would not fit a long.
    Where vec_id is divisible by 7 the label moves on by one, modulo 10.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~odd)
    scaled = rows.withColumn("v", F.transform("v", lambda x: 256 * x)).where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < 2.0**61)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return scaled.select("vec_id", moved.alias("label"), F.transform("v", lambda x: F.floor(x).cast("int")).alias("q")).distinct()


def with_angles(rows: DataFrame, directions: int = 32) -> DataFrame:
    """rows with norms and angles to `directions` reference rows, stored in the shared folder.

    The references are the rows that come first by a hash of the id: a bounded
    sample, which only decides how much the bounds spare.
    """
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "q").limit(directions).select("q").collect()
    width = max((len(r.q) for r in chosen), default=0)
    refs = np.zeros((len(chosen), width))
    for row, r in zip(refs, chosen, strict=True):
        row[: len(r.q)] = r.q
    size = np.linalg.norm(refs, axis=1)
    refs = refs[size > 0] / size[size > 0, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, q = batch.column(0), batch.column(1), batch.column(2)
            offs, flat = q.offsets.to_numpy(), q.values.to_numpy(zero_copy_only=False)
            each = [flat[a:b].astype(np.int32) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            m = _matrix(pa.array([x.tobytes() for x in each], pa.binary()), "<i4").astype(np.float64)
            norm = np.linalg.norm(m, axis=1)
            unit = _fit(m / np.maximum(norm, 1)[:, None], refs.shape[1]) if m.shape[1] else np.zeros((len(each), refs.shape[1]))
            angle = np.arccos(np.clip(unit @ _fit(refs, unit.shape[1]).T, -1, 1))
            # a vector of length 0 has no direction, and any angle bounds its scores
            near = np.argmin(angle, axis=1) if angle.shape[1] else np.zeros(len(each), np.int64)
            toward = angle[np.arange(len(each)), near] if angle.shape[1] else np.zeros(len(each))
            keys = [hashlib.md5(f"{i}:{k}:".encode() + np.trim_zeros(x, "b").tobytes()).digest() for i, k, x in zip(ids.to_pylist(), labels.to_pylist(), each, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([x.tobytes() for x in each], pa.binary()), pa.array(norm), pa.array([x.tobytes() for x in angle.astype("<f4")], pa.binary()), pa.array(near, pa.int32()), pa.array(toward, pa.float32()), pa.array(keys, pa.binary())], ["vec_id", "label", "q", "norm", "angles", "near", "toward", "id_key"])

    return common.stored(rows.mapInArrow(run, _STORED), "vectors")


class Side:
    """Some rows as matrices."""

    def __init__(self, batch: pa.RecordBatch):
        get = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        self.id, self.label, self.norm = (get[c].to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm"))
        self.q, self.angles = _matrix(get["q"], "<i4"), _matrix(get["angles"], "<f4").astype(np.float64)
        self.key = np.array(get["id_key"].to_pylist(), object)
        # an anchor looks for scores in windows, one for each place; the default is any score, and what is missing is empty
        n = len(batch)
        self.low, self.high = np.full((n, 1), _NONE + 1), np.full((n, 1), -(_NONE + 1))
        if "low" in get and get["low"].null_count < n:
            low, high = get["low"].to_pylist(), get["high"].to_pylist()
            places = max(map(len, low))
            self.low, self.high = (np.array([x + [spare] * (places - len(x)) for x in each], np.int64) for each, spare in ((low, 1), (high, 0)))


def scores(a: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers; most bounds every partial sum."""
    width = max(a.shape[1], x.shape[1])
    a, x = _fit(a, width), _fit(x, width)
    for kind, limit in ((np.float32, 2**24), (np.float64, 2**53)):
        if most < limit:
            return (a.astype(kind) @ x.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class Windows:
    """A block's rows in windows of like angles."""

    def __init__(self, side: Side):
        self.rows, n = side, len(side.id)
        cut = np.arange(0, n, WINDOW)
        self.first, self.end = cut, np.minimum(cut + WINDOW, n)
        self.least, self.most = np.minimum.reduceat(side.angles, cut), np.maximum.reduceat(side.angles, cut)
        self.short, self.long = np.minimum.reduceat(side.norm, cut), np.maximum.reduceat(side.norm, cut)
        self.longest = float(side.norm.max())

    def bounds(self, a: Side) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with any row of each window, rounded outwards."""
        near, far = np.zeros((len(a.id), len(self.first))), np.full((len(a.id), len(self.first)), np.pi)
        for j in range(a.angles.shape[1]):
            own, low, high = a.angles[:, j, None], self.least[None, :, j], self.most[None, :, j]
            near = np.maximum(near, np.maximum(own - high, low - own) - SLACK)
            far = np.minimum(far, np.minimum(own + high, 2 * np.pi - own - low) + SLACK)
        top, bottom = np.cos(near), np.cos(np.clip(far, near, np.pi))
        norm, spare = a.norm[:, None], 1 + 1e-9 * a.norm[:, None] * self.long
        # vectors of length 0 score 0, and their angles say nothing
        return norm * np.where(bottom < 0, self.long, self.short) * bottom - spare, norm * np.where(top > 0, self.long, self.short) * top + spare

    def pieces(self, wanted: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the rows in the wanted windows, some thousands at a time."""
        at = np.flatnonzero(wanted)
        for k in range(0, len(at), PIECE // WINDOW):
            yield np.concatenate([np.arange(self.first[w], self.end[w]) for w in at[k : k + PIECE // WINDOW].tolist()])

    def best(self, a: Side, k: int, same: bool) -> list[tuple[np.ndarray, ...]]:
        """For each anchor and each of its places the first k rows with a score of low to high and its own or another label; all that tie with the last one are among them."""
        floor, found = a.low.copy(), []
        bottom, top = self.bounds(a)
        open_places = a.low <= a.high
        least = np.where(open_places, a.low, -_NONE - 1).min(axis=1, initial=-_NONE - 1)
        most = np.where(open_places, a.high, _NONE).max(axis=1, initial=_NONE)
        for at in self.pieces(((top >= least[:, None]) & (bottom <= most[:, None])).any(axis=0)):
            s = scores(a.q, self.rows.q[at], float(a.norm.max()) * self.longest)
            fits = (self.rows.label[at] == a.label[:, None]) == same
            for i in np.flatnonzero(np.isin(a.id, self.rows.id[at])).tolist():
                fits[i, [j for j in np.flatnonzero(self.rows.id[at] == a.id[i]).tolist() if self.rows.key[at[j]] == a.key[i]]] = False
            s = np.where(fits, s, _NONE)
            for place in range(a.low.shape[1]):
                own = np.where((s >= floor[:, place, None]) & (s <= a.high[:, place, None]), s, _NONE)
                if own.shape[1] > k:
                    floor[:, place] = np.maximum(floor[:, place], np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k])
                row, col = np.nonzero((own >= floor[:, place, None]) & (own > _NONE))
                found.append((row, np.full(len(row), place), self.rows.id[at[col]], self.rows.key[at[col]], own[row, col]))
        return found


def _first(found: list, k: int) -> tuple[np.ndarray, ...]:
    row, place, ids, keys, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((keys.astype("S16"), ids, -s, place, row))
    row, place, ids, keys, s = row[order], place[order], ids[order], keys[order], s[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))
    keep = rank < k
    return row[keep], place[keep], ids[keep], keys[keep], s[keep]


def _blocks(kept: DataFrame, anchors: DataFrame, blocks: int, k: int) -> DataFrame:
    """(anchor_key, place, other, other_key, score): the first k rows of each block for each anchor.

    anchors without low and high look for rows of their own label; with them,
    for each place of these arrays, for rows of other labels in that window.
    """
    negatives = "low" in anchors.columns
    home = F.pmod(F.xxhash64("id_key"), F.lit(blocks)).cast("int")
    spare = [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high")] if negatives else []
    rows = kept.select(home.alias("block"), F.lit(0).alias("side"), *kept.columns, *spare)
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("side"), *anchors.columns)
    dealt = rows.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "side", "near", "toward", "id_key")
    schema = "anchor_key binary, place int, other long, other_key binary, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, windows, at = [], None, None
        for batch in batches:
            for block, side, part in _runs(batch):
                if block != at:
                    held, windows, at = [], None, block
                if side == 0:
                    held.append(part)
                    continue
                if windows is None and held:
                    windows, held = Windows(Side(pa.Table.from_batches(held).combine_chunks().to_batches()[0])), []
                for a in range(0, len(part) if windows else 0, BATCH):
                    asked = Side(part.slice(a, BATCH))
                    if found := windows.best(asked, k, same=not negatives):
                        row, place, ids, keys, s = _first(found, k)
                        yield pa.RecordBatch.from_arrays([pa.array(asked.key[row], pa.binary()), pa.array(place, pa.int32()), pa.array(ids), pa.array(keys, pa.binary()), pa.array(s)], ["anchor_key", "place", "other", "other_key", "score"])

    return dealt.mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Runs of rows of one block and side."""
    block, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    cuts = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
        if b > a:
            yield int(block[a]), int(side[a]), batch.slice(a, b - a)


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other", "other_key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, block: int = BLOCK, directions: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; whole_vectors says
    which rows take part. Vectors of unequal length are scored as if the shorter
    one ended in zeros. Ties go to the smaller vec_id; rows that repeat count
    once, different rows of one vec_id are rows of their own. An empty table, an
    anchor without positives and a positive without negatives give no rows. Other
    columns are not looked at.
    """
    kept = with_angles(whole_vectors(df), directions)
    # at least some blocks for each core, and no block beyond what a task holds
    blocks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // block))
    anchors = kept.where(F.col("vec_id") % every == 0)
    first = _ranked(_blocks(kept, anchors, blocks, positives), positives, "anchor_key")
    # 50 p <= 100 n <= 95 p in whole numbers; no score lies in it where p is negative
    low, high = F.expr("(score + 1) div 2"), F.expr("(95 * (score div 100)) + (95 * (score % 100)) div 100")
    first = common.stored(first.where("score >= 0").select("anchor_key", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")), "positives")
    ends = first.groupBy(F.col("anchor_key").alias("of_key")).agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    asked = anchors.join(ends, anchors["id_key"] == ends["of_key"]).select(*anchors.columns, F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    second = _ranked(_blocks(kept, asked, blocks, negatives), negatives, "anchor_key", "place").withColumn("place", F.col("place") + 1)
    named = second.join(first, ["anchor_key", "place"]).join(anchors.select(F.col("id_key").alias("anchor_key"), F.col("vec_id").alias("anchor_id")), "anchor_key")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
