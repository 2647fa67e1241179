"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts form a group that no shard boundary may split. Packing runs on two
levels, so that no task and no driver sees all groups:

1. A hash of the key deals the groups to a fixed number of packers. Each packer
   takes its groups by falling size and packs them into parcels of a fixed
   capacity, total / (shards * parcels_per_shard). A group beyond that capacity
   is a parcel of its own.
2. The parcels, at most 2 * shards * parcels_per_shard and one for each packer,
   enter the shards on the driver by the same rule, under the smallest
   capacity that lets them all fit.

What a packer holds is the open parcels alone. Number of packers, order within
them and ties depend on keys and sizes only, so the result does not depend on
how Spark deals out the rows, and a lost task gives the same parcels again.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_MASK = (1 << 64) - 1


class BinTree:
    """Open bins in a balanced search tree (a treap) ordered by (room, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None

    @staticmethod
    def _priority(label: int) -> int:
        x = (label + 1) * 0x9E3779B97F4A7C15 & _MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
        return x ^ x >> 27

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Nodes below key, nodes from key on."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _join(self, low: list | None, high: list | None) -> list | None:
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high

    def add(self, room: int, label: int) -> None:
        low, high = self._split(self.root, (room, label))
        self.root = self._join(self._join(low, [(room, label), self._priority(label), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least room that holds size; None if there is none."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is None:
            return None
        low, rest = self._split(self.root, best)
        _, high = self._split(rest, (best[0], best[1] + 1))
        self.root = self._join(low, high)
        return best


def best_fit(sizes: Iterable[int], capacity: int, most: int | None = None) -> Iterator[int]:
    """The bin of each size, in order; sizes fall. A size beyond capacity gets a bin alone. Yields -1 when `most` bins are not enough."""
    tree, bins = BinTree(), 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if bins == most:
                yield -1
                return
            room, label, bins = capacity - size, bins, bins + 1
        else:
            room, label = found[0] - size, found[1]
        if room > 0:
            tree.add(room, label)
        yield label


def even_bins(sizes: list[int], shards: int) -> list[int]:
    """Best fit for falling sizes into `shards` bins under the least capacity found by halving."""
    if not sizes:
        return []

    def packed(capacity: int) -> list[int] | None:
        out = list(best_fit(sizes, capacity, shards))
        return None if out[-1] < 0 else out

    low, high = -(-sum(sizes) // shards), sum(sizes)
    # what is larger than an even share keeps its own bin, and the rest evens out over the other bins
    rest, bins = sum(sizes), shards
    for size in sizes:
        if bins <= 1 or size * bins <= rest:
            break
        rest, bins = rest - size, bins - 1
    low = -(-rest // bins)
    best = packed(low)
    if best is not None:
        return best
    high, step = low, 1
    while (best := packed(high)) is None:
        high, step = high + step, step * 2
    while low + 1 < high:
        middle = (low + high) // 2
        if (out := packed(middle)) is None:
            low = middle
        else:
            best, high = out, middle
    return best


def shard_groups(rows: DataFrame, key: list[str], size: str, shards: int = 40, parcels_per_shard: int = 200, piece_rows: int = 500, packers: int = 256) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in a shard) added; rows with equal key stay together.

    Rows of one group are numbered in pieces of about piece_rows, so a group of
    any size spreads over tasks, and a frequent key is split before it is
    joined. An empty table gives an empty result. Nulls in key are equal to each other; a null
    size counts as 0. Columns named shard or slot are replaced.
    """
    rows = rows.drop("shard", "slot")
    spark = rows.sparkSession
    # every column gets a name of its own, so that no name of the input can clash
    given = {c: f"c{i}" for i, c in enumerate(rows.columns)}
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in given.items()])
    keys = [given[c] for c in key]
    groups = rows.groupBy(*keys).agg(F.sum(F.coalesce(F.col(given[size]), F.lit(0)).cast("long")).alias("group_size"), F.count("*").alias("group_rows"))
    groups = common.stored(groups.withColumn("packer", F.pmod(F.xxhash64(*keys), F.lit(packers))), "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    capacity = max(1, total // (shards * parcels_per_shard))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, fit, feed = None, None, deque()
        for batch in batches:
            labels = []
            for own, amount in zip(batch["packer"].tolist(), batch["group_size"].tolist(), strict=True):
                if own != packer:
                    packer, feed = own, deque()
                    fit = best_fit(iter(feed.popleft, None), capacity)
                feed.append(amount)
                labels.append((own << 40) + next(fit))
            yield batch.assign(parcel=labels)

    ordered = groups.repartition("packer").sortWithinPartitions("packer", F.desc("group_size"), *keys)
    packed = common.stored(ordered.mapInPandas(pack, common.widened(groups, "parcel long")), "parcels")
    parcels = packed.groupBy("parcel").agg(F.sum("group_size").alias("bytes"), F.sum("group_rows").alias("rows")).orderBy(F.desc("bytes"), "parcel").collect()
    offsets, plan = [0] * shards, []
    for p, shard in zip(parcels, even_bins([p["bytes"] for p in parcels], shards), strict=True):
        plan.append((p["parcel"], shard, offsets[shard], -(-p["rows"] // piece_rows)))
        offsets[shard] += p["rows"]
    plan = spark.createDataFrame(plan, "parcel long, shard int, parcel_at long, pieces long")
    where = packed.select(*[F.col(c).alias(f"key_{c}") for c in keys], "group_rows", "parcel").join(F.broadcast(plan), "parcel")
    placed = common.split_join(rows, where, [(c, f"key_{c}") for c in keys], "group_rows")
    order = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    placed = placed.select(*rows.columns, "parcel", "shard", "parcel_at", F.pmod(F.xxhash64(*order), F.col("pieces")).alias("piece"))
    counts = placed.groupBy("parcel", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("parcel").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("parcel").alias("of_parcel"), F.col("piece").alias("of_piece"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("piece_at"))
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("parcel", "piece").orderBy(*order)))
    placed = placed.join(counts, (placed["parcel"] == counts["of_parcel"]) & (placed["piece"] == counts["of_piece"]))
    return placed.select(*[F.col(n).alias(c) for c, n in given.items()], "shard", (F.col("parcel_at") + F.col("piece_at") + F.col("nth") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 40, **options: int) -> DataFrame:
    """Puts documents into shards of nearly equal bytes, equal texts together.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, law
    ('bytes'), shard, slot and grown_shard (null: the law `bytes` makes no
    promise for another shard count). A null text counts as the empty text.
    Rows that repeat are rows of their own; a null doc_id is carried along.
    Groups larger than an even share get a shard to themselves. Whole texts of
    any length count; other columns are not looked at; an empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("text_key"))
    placed = shard_groups(rows, ["text_key", "size"], "size", shards, **options)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
