"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A text's set holds the hashes of its distinct word n-grams. Two texts link when
100 * shared >= percent * united. Equal sets are one class and travel once.

1. A sketch of fixed size orders n-grams from rare to frequent. Two linked sets
   share at least k of their rarest n - T + k n-grams, so only these go into
   inverted lists. A set stays a candidate if at least k of its lists hold
   another set of fitting size; with k a tenth of the set, n-grams that sets
   share by chance make no candidates, however large the corpus.
2. Candidates go, once, to the home list that most sets share. There, in blocks
   of bounded size, each set is searched among the others by T-occurrence: the
   short lists are merged through a heap that skips what can't reach the needed
   count, and the long ones are probed by binary search for what the merge left.
   A home of several blocks then brings what is not yet in its main component to
   all its blocks. This settles a group of near copies without its pairs ever
   being written out.
3. Every list again: its pairs of sets from different homes that are not in one
   component yet, and that sizes and positions allow, are verified by the same
   search; first neighbours only, as that leaves few pairs for the whole round.

A list that the sketch calls longer than `list_rows` lies in parts, so no task
holds it whole; in step 3 its parts meet in pairs. Links between sets that a
chain of links already joins do not change any component and are not searched.
The components are those of all links. The sketch, the Bloom filters and the
lengths from which lists are searched for neighbours first (_LONG) or in parts
only order or spare work; no result depends on them.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import Forest, components

_MIX = [np.uint64(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0x9E3779B185EBCA87)]
_BLOCKS = 64
#: Lists from this length on are searched for neighbours first; in shorter ones that would do their few pairs twice.
_LONG = 16


def shingle_sets(text: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than `width` make one shingle, no words none."""
    low = common.LOWER[text]
    starts, _, at = common.bounds(low, offs)
    words = common.word_hashes(low, starts)
    if len(words) >= width:
        every = words[: len(words) - width + 1] * _MIX[0]
        for k in range(1, width):
            every = every + (words[k : len(words) - width + 1 + k] ^ np.uint64(k)) * _MIX[k % len(_MIX)] * np.uint64(2 * (k // len(_MIX)) + 1)
        every = common.mix(every)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap of a set of size n with any set that it links with."""
    return (percent * n + 99) // 100


def overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least overlap that links sets of sizes n and m: 100 o >= percent (n + m - o)."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def common_first(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The number k of rare shared n-grams that the lists of a set of size n allow for."""
    return np.maximum(1, n // 10)


def key_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class BlockIndex:
    """Inverted lists over some sets, and DivideSkip's search in them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
        self.tokens, self.first = every[first], first
        self.length = np.diff(np.r_[first, len(every)])
        self.owners = self.owner.tolist()

    def merge(self, lists: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets in at least `least` of the lists (first and end place in the owners), and in how many: MergeSkip over a heap."""
        owners, found, counts = self.owners, [], []
        heap = [(owners[a], a, b) for a, b in lists]
        heapify(heap)
        while len(heap) >= least:
            top, moved = heap[0][0], []
            while heap and heap[0][0] == top:
                moved.append(heappop(heap))
            if len(moved) >= least:
                found.append(top)
                counts.append(len(moved))
                for _, a, b in moved:
                    if a + 1 < b:
                        heappush(heap, (owners[a + 1], a + 1, b))
                continue
            # the next least - 1 lists can't lift any set below the new top to `least`: they jump to it
            while len(moved) < least - 1:
                moved.append(heappop(heap))
            top = heap[0][0]
            for _, a, b in moved:
                a = bisect_left(owners, top, a, b)
                if a < b:
                    heappush(heap, (owners[a], a, b))
        return np.array(found, np.int64), np.array(counts, np.int64)

    def search(self, query: np.ndarray, percent: int, allowed: np.ndarray | None = None, weight: float = 0.0085) -> np.ndarray:
        """The sets that link with the query."""
        if not len(query) or not len(self.tokens):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        at = at[self.tokens[at] == query]
        least = int(need(len(query), percent))
        if len(at) < least:
            return np.zeros(0, np.int64)
        at = at[np.argsort(self.length[at], kind="stable")]
        n_long = min(int(least / (weight * np.log2(max(2, self.length[at[-1]])) + 1)), least - 1)
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        firsts = self.first[short]
        found, have = self.merge(list(zip(firsts.tolist(), (firsts + self.length[short]).tolist(), strict=True)), max(1, least - n_long))
        if allowed is not None:
            have, found = have[allowed[found]], found[allowed[found]]
        ratio = 100 * np.minimum(self.sizes[found], len(query)) >= percent * np.maximum(self.sizes[found], len(query))
        have, found = have[ratio], found[ratio]
        wanted = overlap(len(query), self.sizes[found], percent)
        left = n_long
        for k in long.tolist():
            if not len(found):
                break
            owners = self.owner[self.first[k] : self.first[k] + self.length[k]]
            place = np.minimum(np.searchsorted(owners, found), len(owners) - 1)
            have = have + (owners[place] == found)
            left -= 1
            if left % 16 == 0:
                alive = have + left >= wanted
                found, wanted, have = found[alive], wanted[alive], have[alive]
        return found[have >= wanted]


def _decoded(frame: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in frame["shingles"]]


def block_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets; a set is searched only among those of other components."""
    index, forest, out = BlockIndex(sets), Forest(len(sets)), []
    root = np.arange(len(sets))
    for q in np.argsort(-index.sizes, kind="stable").tolist():
        others = (root != root[q]) & (100 * np.minimum(index.sizes, index.sizes[q]) >= percent * np.maximum(index.sizes, index.sizes[q]))
        if not others.any():
            continue
        for other in index.search(sets[q], percent, others).tolist():
            if forest.link(q, other):
                out.append((q, other))
                root[root == max(root[q], root[other])] = min(root[q], root[other])
    return out


def _first_seen(seen: set[int], keys: list[int]) -> list[bool]:
    """Whether a task meets a key for the first time: a class leaves each task once, however many copies it has."""
    out = []
    for k in keys:
        out.append(k not in seen)
        seen.add(k)
    return out


def _merged_blocks(parts: DataFrame, kind: str, top: bool) -> np.ndarray:
    """Arrays that tasks sent in _BLOCKS compressed blocks (block, bytes), added up (or or-ed) block by block."""

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for raw in frame["bytes"]:
            x = np.frombuffer(zlib.decompress(raw), kind)
            total = x.astype(np.int64) if total is None and not top else x.copy() if total is None else (total | x) if top else total + x
        out = total if top else np.minimum(total, np.iinfo(kind).max).astype(kind)
        return pd.DataFrame({"block": frame["block"].iloc[:1], "bytes": [zlib.compress(out.tobytes(), 1)]})

    # two steps: what many tasks send for one block meets in several places first
    near = parts.withColumn("part", F.pmod(F.xxhash64("bytes"), F.lit(8))).groupBy("block", "part").applyInPandas(lambda k: join(k), "block int, bytes binary")
    rows = near.groupBy("block").applyInPandas(lambda k: join(k), "block int, bytes binary").collect()
    blocks = {r["block"]: np.frombuffer(zlib.decompress(bytes(r["bytes"])), kind) for r in rows}
    return np.concatenate([blocks[i] for i in range(_BLOCKS)]) if len(blocks) == _BLOCKS else np.zeros(0, kind)


def _in_blocks(array: np.ndarray) -> list[tuple[int, bytes]]:
    return [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(np.split(array, _BLOCKS))]


def link_sets(docs: DataFrame, width: int = 4, percent: int = 85, sketch_bits: int = 22, block: int = 500_000, list_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """Sets and components of docs (doc_id, text).

    Returns (doc_id, n_shingles, set_key, text_key), a row for each row of docs
    with text_key the text's xxhash64, and (set_key, label) of the sets that link with another; sets with one label
    are one component. A text without words has no set: its set_key is null.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    slots = 1 << sketch_bits

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(slots, np.uint32), [], 0
        names = ["doc_id", "text_key", "n", "key", "block", "bytes"]

        def count() -> None:
            more = np.bincount(np.concatenate(waiting), minlength=slots) if waiting else np.zeros(slots, np.int64)
            np.minimum(counts + more, 2**32 - 1, out=counts, casting="unsafe")
            waiting.clear()

        for batch in batches:
            sizes, keys = [], []
            for _, _, text, offs in common.chunks(batch.column(1)):
                sets = shingle_sets(text, offs, width)
                sizes += map(len, sets)
                keys += [key_of(s) if len(s) else None for s in sets]
                waiting += [(s >> np.uint64(64 - sketch_bits)).astype(np.int64) for s in sets]
                held += sum(map(len, sets))
                if held > 2_000_000:
                    count()
                    held = 0
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        count()
        parts = _in_blocks(counts)
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names)

    first = common.stored(docs.mapInArrow(first_pass, "doc_id long, text_key long, n int, key long, block int, bytes binary"), "sets")
    members = first.where("block is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("key").alias("set_key"), "text_key")
    counts = _merged_blocks(first.where("block is not null").select("block", "bytes"), "<u4", top=False)
    if not len(counts):
        counts = np.zeros(slots, np.uint32)
    ranks = spark.sparkContext.broadcast(np.log2(counts.astype(np.float32) + 1).astype(np.uint8))
    # a slot counts all n-grams that fall into it: what it has beyond the usual is one long list's
    hot = np.flatnonzero(counts > np.median(counts) + list_rows)
    # few slots count so many n-grams; each such list has parts of about list_rows sets
    hot_parts = spark.sparkContext.broadcast((hot, (counts[hot].astype(np.int64) // list_rows + 1).astype(np.int32)))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, (slot, parts_of), seen = ranks.value, hot_parts.value, set()
        for batch in batches:
            for _, _, text, offs in common.chunks(batch.column(0)):
                tokens, sizes, keys, places, parts = [], [], [], [], []
                sets = [s for s in shingle_sets(text, offs, width) if len(s)]
                own = [key_of(s) for s in sets]
                for s, k, new in zip(sets, own, _first_seen(seen, own), strict=True):
                    if not new:
                        continue
                    size = len(s) - int(need(len(s), percent)) + int(common_first(len(s), percent))
                    cells = (s >> np.uint64(64 - sketch_bits)).astype(np.int64)
                    order = np.argsort(rank[cells], kind="stable")[:size]
                    tokens.append(s[order])
                    sizes.append(np.full(size, len(s), np.int32))
                    keys.append(np.full(size, k, np.int64))
                    places.append(np.arange(size, dtype=np.int32))
                    part = np.zeros(size, np.int32)
                    if len(slot):
                        at = np.minimum(np.searchsorted(slot, cells[order]), len(slot) - 1)
                        part = np.where(slot[at] == cells[order], 1 + (k & 0x7FFFFFFF) % parts_of[at], 0).astype(np.int32)
                    parts.append(part)
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(tokens).view(np.int64), *map(np.concatenate, (parts, sizes, keys, places)))], ["token", "part", "n", "key", "place"])

    lists = docs.select("text").where("text is not null").mapInArrow(postings, "token long, part int, n int, key long, place int")
    lists = lists.repartition("token", "part").sortWithinPartitions("token", "part", "n", "key")
    lists = common.stored(lists.mapInArrow(lambda batches: (_shared(x, percent) for x in _whole_lists(batches)), "token long, part int, n int, key long, place int, m int"), "lists")
    # linked sets have min(k, k) lists in common, and the smaller one has need(n) n-grams at least
    k = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n").cast("long") * percent / 100) / 10))
    homes = lists.groupBy("key").agg(F.max(F.struct("m", "token")).alias("home"), F.first("n").alias("n"), F.count("*").alias("lists")).where(F.col("lists") >= k).select("key", "n", F.col("home.token").alias("home"))
    # a home whose sets are too many for one block has parts
    parts = homes.groupBy("home").agg(F.ceil(F.sum("n") / block).cast("int").alias("parts")).withColumnRenamed("home", "at")
    homes = homes.join(parts, homes["home"] == parts["at"]).select("key", "n", "home", "parts", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    homes = common.stored(homes, "homes")
    wanted = spark.sparkContext.broadcast(_bloom(homes.select("key")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            for _, _, text, offs in common.chunks(batch.column(0)):
                sets = [s for s in shingle_sets(text, offs, width) if len(s)]
                own = [key_of(s) for s in sets]
                maybe = _in_bloom(bits, np.array(own, np.int64))
                chosen = [(k, s.tobytes()) for s, k, new, m in zip(sets, own, _first_seen(seen, own), maybe, strict=True) if new and m]
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chosen], pa.int64()), pa.array([s for _, s in chosen], pa.binary())], ["set_key", "shingles"])

    sets = docs.select("text").where("text is not null").mapInArrow(sets_of, "set_key long, shingles binary")
    # the same kind of join at every size
    at_home = homes.hint("merge").join(sets, homes["key"] == sets["set_key"]).select("key", "home", "parts", "part", "shingles")
    at_home = common.stored(at_home, "home-sets")

    def home_links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("key")
        keys = frame["key"].to_numpy()
        pairs = block_links(_decoded(frame), percent)
        return pd.DataFrame({"a": keys[[a for a, _ in pairs]], "b": keys[[b for _, b in pairs]]}, dtype="int64")

    near = common.stored(at_home.groupBy("home", "part").applyInPandas(home_links, "a long, b long"), "home-links")
    labels = components(near)
    if homes.where("parts > 1").limit(1).count():
        near = near.unionByName(common.stored(_across_parts(homes, at_home, labels, percent, block), "part-links"))
        labels = components(near)

    # what is left: pairs of one list, in different components, that sizes and places allow and that did not meet
    # at home; first neighbours in the lists, which joins what a group of copies has at several homes, then all
    lists = _only(lists, "key", wanted).where(F.col("place") <= F.col("n") - F.ceil(F.col("n").cast("long") * percent / 100))
    for steps in (1, 0):
        tags = homes.join(labels.hint("merge"), homes["key"] == labels["vertex"], "left").select(F.col("key").alias("k"), F.coalesce("label", "key").alias("label"), "home")
        named = lists.join(tags.hint("merge"), lists["key"] == tags["k"]).select("token", "part", "n", "key", "place", "label", "home")
        last = common.stored(_verified(_candidates(named, percent, steps), at_home, percent), "last-links")
        if last.limit(1).count():
            near = near.unionByName(last)
            labels = components(near)
    return members, labels.select(F.col("vertex").alias("set_key"), "label")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of runs of whole lists; rows come sorted by their first two columns, and a list may span batches."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        other = (columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1])
        if rest and not other.any() and columns[0][0] == rest[-1][0][-1] and columns[1][0] == rest[-1][1][-1]:
            rest.append(columns)
            continue
        cut = len(other) - int(np.argmax(other[::-1])) if other.any() else 0
        yield [np.concatenate([*(r[i] for r in rest), c[:cut]]) for i, c in enumerate(columns)]
        rest = [[c[cut:] for c in columns]]
    if rest:
        yield [np.concatenate([r[i] for r in rest]) for i in range(len(rest[0]))]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _fitting(first: np.ndarray, n: np.ndarray, place: np.ndarray, percent: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one list that may link, as (earlier, later) row numbers; lists begin at `first` and are sorted by size.

    The partners of a row stand behind it as far as its size allows, and for
    two sets whose first shared n-gram this is, what stands behind it in either
    set must suffice for the overlap they need.
    """
    if not len(n):
        return
    end = np.repeat(np.r_[first[1:], len(n)], np.diff(np.r_[first, len(n)]))
    live = np.arange(len(n))
    for step in range(1, steps + 1):
        live = live[live + step < end[live]]
        live = live[100 * n[live] >= percent * n[live + step]]
        if not len(live):
            return
        other = live + step
        rest = np.minimum(n[live] - place[live], n[other] - place[other])
        good = rest >= overlap(n[live], n[other], percent)
        yield live[good], other[good]


def _fitting_apart(n: np.ndarray, place: np.ndarray, label: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for one long list: only rows outside its most frequent component look for partners, each in its window of sizes."""
    names, dense, times = np.unique(label, return_inverse=True, return_counts=True)
    asks = dense != int(times.argmax())
    low, high = np.searchsorted(100 * n, percent * n, "left"), np.searchsorted(percent * n, 100 * n, "right")
    for i in np.flatnonzero(asks).tolist():
        other = np.arange(low[i], high[i])
        # of two rows that both ask, the earlier one finds the pair
        other = other[(dense[other] != dense[i]) & (~asks[other] | (other > i))]
        rest = np.minimum(n[i] - place[i], n[other] - place[other])
        other = other[rest >= overlap(n[i], n[other], percent)]
        yield np.full(len(other), i), other


def _candidates(named: DataFrame, percent: int, steps: int) -> DataFrame:
    """(a, b, label_a, label_b): pairs of one list that are open; with steps > 0 only rows of long lists that many places apart or less.

    In the whole round, a list in parts is met by cells of two parts each (or
    one with itself), so that each pair of its rows meets once.
    """
    if steps:
        cells = named.withColumn("cell", F.col("part"))
    else:
        parts = named.where("part > 0").groupBy("token").agg(F.max("part").alias("parts")).withColumnRenamed("token", "hot")
        split = named.where("part > 0").join(parts, F.col("token") == F.col("hot")).withColumn("q", F.explode(F.sequence(F.lit(1), F.col("parts"))))
        pair = F.least("part", "q") * (F.col("parts") + 1) + F.greatest("part", "q")
        cells = named.where("part = 0").withColumn("cell", F.lit(0)).unionByName(split.withColumn("cell", pair.cast("int")).drop("hot", "parts", "q"))
    ordered = cells.select("token", "cell", "n", "key", "place", "label", "home", "part").repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "key")
    return common.stored(ordered.mapInArrow(lambda batches: (y for x in _whole_lists(batches) for y in _open_pairs(x, percent, steps)), "a long, b long, label_a long, label_b long").distinct(), "open-pairs")


def _verified(pairs: DataFrame, at_home: DataFrame, percent: int) -> DataFrame:
    """Links among open pairs, in cells of bounded size; of a cell's links between the same components one is enough."""
    spark = pairs.sparkSession
    cells = max(1, pairs.count() // 4096)
    sides = [F.struct(F.col(x).alias("key"), F.col(f"label_{x}").alias("label"), F.lit(x == "a").alias("held")) for x in "ab"]
    cell = pairs.select(F.pmod(F.xxhash64("a"), F.lit(cells)).alias("cell"), F.pmod(F.xxhash64("b"), F.lit(1 + cells // 64)).alias("side"), F.explode(F.array(*sides)).alias("x"))
    asked = cell.select("cell", "side", "x.key", "x.label", "x.held").distinct()
    open_keys = spark.sparkContext.broadcast(_bloom(asked.select("key").distinct()))

    known = _only(at_home.select(F.col("key").alias("set_key"), "shingles"), "set_key", open_keys)
    loaded = asked.hint("merge").join(known, asked["key"] == known["set_key"]).select("cell", "side", "key", "label", "held", "shingles")

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["key", "held"])
        _, dense = np.unique(frame["label"].to_numpy(), return_inverse=True)
        stay, forest, root, out = frame["held"].to_numpy(), Forest(int(dense.max()) + 1), dense.copy(), []
        index, keys, own = BlockIndex(_decoded(frame[stay])), frame["key"].to_numpy()[stay], np.flatnonzero(stay)
        for q, key, shingles in zip(np.flatnonzero(~stay).tolist(), frame["key"].to_numpy()[~stay].tolist(), _decoded(frame[~stay]), strict=True):
            apart = root[own] != root[q]
            for i in index.search(shingles, percent, apart).tolist() if apart.any() else ():
                if forest.link(int(dense[q]), int(dense[own[i]])):
                    out.append((int(keys[i]), key))
                    x, y = root[q], root[own[i]]
                    root[root == max(x, y)] = min(x, y)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return loaded.groupBy("cell", "side").applyInPandas(links, "a long, b long")


def _across_parts(homes: DataFrame, at_home: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between different parts of a home.

    Most sets of a large home are in one component by now, and pairs inside it
    are settled. Only the others ask: each goes to every part of the home,
    while the parts stay as they are.
    """
    big = homes.where("parts > 1").join(labels, homes["key"] == labels["vertex"], "left").select("key", "n", "home", "parts", "part", F.coalesce("label", "key").alias("label"))
    mains = big.groupBy("home", "label").agg(F.count("*").alias("c")).groupBy("home").agg(F.max(F.struct("c", "label")).alias("m")).select(F.col("home").alias("at"), F.col("m.label").alias("main"))
    big = big.join(mains, big["home"] == mains["at"]).drop("at").withColumn("asks", F.col("label") != F.col("main"))
    askers = big.where("asks").groupBy("home").agg(F.ceil(F.sum("n") / block).cast("int").alias("groups")).withColumnRenamed("home", "at")
    big = big.join(askers, big["home"] == askers["at"]).drop("at")
    held = big.select("key", "label", "home", "part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.lit(True).alias("held"))
    asking = big.where("asks").select("key", "label", "home", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("key", F.lit(7)), F.col("groups")).cast("int").alias("group"), F.lit(False).alias("held"))
    sets = at_home.where("parts > 1").select(F.col("key").alias("set_key"), "shingles")
    cells = held.unionByName(asking).join(sets, F.col("key") == F.col("set_key")).select("home", "part", "group", "key", "label", "held", "shingles")

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["key", "held"])
        stay, ask = frame[frame["held"]], frame[~frame["held"]]
        index, keys, names, out = BlockIndex(_decoded(stay)), stay["key"].to_numpy(), stay["label"].to_numpy(), []
        for key, name, shingles in zip(ask["key"], ask["label"], _decoded(ask), strict=True):
            found = index.search(shingles, percent, names != name)
            _, one = np.unique(names[found], return_index=True)
            out += [(int(keys[i]), key) for i in found[one].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return cells.groupBy("home", "part", "group").applyInPandas(links, "a long, b long")


def _shared(columns: list[np.ndarray], percent: int) -> pa.RecordBatch:
    """Rows of whole lists that have a set of fitting size in their list, without repeats of a set, and their number m in the list.

    Rows are sorted by size, so it is enough to look at the neighbours. Rows of
    a list in parts all stay, as their partners may be in another part.
    """
    columns = [c[_starts(columns[0], columns[1], columns[3])] for c in columns]
    token, part, n, key, place = columns
    near = (token[1:] == token[:-1]) & (part[1:] == part[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
    meets = (np.r_[near, False] | np.r_[False, near] | (part > 0)) if len(token) else np.zeros(0, bool)
    token, part, n, key, place = (c[meets] for c in columns)
    size = np.diff(np.r_[_starts(token, part), len(token)]) if len(token) else np.zeros(0, np.int64)
    m = np.repeat(size, size).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (token, part, n, key, place, m)], ["token", "part", "n", "key", "place", "m"])


def _open_pairs(columns: list[np.ndarray], percent: int, steps: int) -> Iterator[pa.RecordBatch]:
    """Pairs within each list or cell (rows sorted by size) whose labels and homes differ and whose sizes and places allow a link."""
    token, cell, n, key, place, label, home, part = columns
    n, place = n.astype(np.int64), place.astype(np.int64)
    first = _starts(token, cell)
    size = np.diff(np.r_[first, len(token)])
    out, held = [], 0

    def found(live: np.ndarray, other: np.ndarray) -> None:
        nonlocal held
        apart = (label[live] != label[other]) & (home[live] != home[other]) & (key[live] != key[other])
        live, other = live[apart], other[apart]
        a, b = np.where(key[live] < key[other], live, other), np.where(key[live] < key[other], other, live)
        out.append(np.stack([key[a], key[b], label[a], label[b]], 1))
        held += len(a)

    if steps:
        rows = np.flatnonzero(np.repeat(size >= _LONG, size))
        for live, other in _fitting(_starts(token[rows], cell[rows]), n[rows], place[rows], percent, steps):
            found(rows[live], rows[other])
    else:
        rows = np.flatnonzero(np.repeat(size < _LONG, size))
        for live, other in _fitting(_starts(token[rows], cell[rows]), n[rows], place[rows], percent, _LONG):
            found(rows[live], rows[other])
        for k in np.flatnonzero(size >= _LONG).tolist():
            a, b = first[k], first[k] + size[k]
            # a cell of two parts is for pairs between them
            two = part[a:b].min() != part[a:b].max()
            for live, other in _fitting_apart(n[a:b], place[a:b], label[a:b], percent):
                if two:
                    live, other = live[part[a + live] != part[a + other]], other[part[a + live] != part[a + other]]
                found(a + live, a + other)
                if held > 500_000:
                    yield _pairs(out)
                    out, held = [], 0
    if held:
        yield _pairs(out)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], ["a", "b", "label_a", "label_b"])


_BLOOM_BITS = 25


def _bloom_places(keys: np.ndarray) -> list[np.ndarray]:
    mixed = common.mix(keys.astype(np.int64).view(np.uint64))
    return [((mixed >> np.uint64(s)) & np.uint64((1 << _BLOOM_BITS) - 1)).astype(np.int64) for s in (0, 19, 38)]


def _in_bloom(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    if not len(bits):
        return np.zeros(len(keys), bool)
    for place in _bloom_places(keys):
        out &= bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
    return out


def _only(df: DataFrame, column: str, wanted) -> DataFrame:
    """The rows of df whose key may be in a broadcast Bloom filter."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in_bloom(wanted.value, batch.column(at).to_numpy())))

    return df.mapInArrow(run, df.schema)


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (4 MB) over a column of longs; it only spares work, and never decides."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (_BLOOM_BITS - 3), np.uint8)
        for batch in batches:
            for place in _bloom_places(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
        parts = _in_blocks(bits)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "bytes"])

    return _merged_blocks(keys.mapInArrow(fill, "block int, bytes binary"), "<u1", top=True)


def _named(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for each row of docs."""
    return named(*link_sets(docs, **options))


def named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id from the results of link_sets()."""
    sets = members.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"))
    own = labels.withColumnRenamed("set_key", "vertex")
    sets = sets.join(own, sets["set_key"] == own["vertex"], "left").select("set_key", "least", F.coalesce("label", "set_key").alias("label"))
    least = sets.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = sets.select("set_key", "label").join(least, "label").select(F.col("set_key").alias("k"), "component_id")
    found = members.where("set_key is not null").join(of_set, F.col("set_key") == F.col("k")).select("doc_id", "text_key", "n_shingles", "component_id")
    return found.unionByName(members.where("set_key is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id")))


def join_components(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own
    included. Null, empty and blank texts have no shingles and link with
    nothing: their component is their own doc_id. A null doc_id is carried
    along and never names a component unless no other id is there (then null).
    Rows that repeat have one set and so one component; rows with one doc_id
    but different texts are compared like any others. Other columns are not
    looked at; whole texts of any length are cut into n-grams; an empty table
    gives an empty result.
    """
    return _named(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """docs without the near copies: of each component the row with the smallest doc_id stays.

    Rows without words stay, and so do rows without doc_id. Of rows with one
    doc_id and equal texts one stays; different texts of one doc_id that are no
    copies of another document all stay.
    """
    found = common.stored(_named(docs.where("doc_id is not null"), **options).where("n_shingles > 0"), "near-copies")
    doc, key = common.free_name(docs, "copy_doc"), common.free_name(docs, "copy_text")
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64("text") == F.col(key))

    def rows(frame: DataFrame) -> DataFrame:
        return frame.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()

    left = docs.join(rows(found.where("component_id <> doc_id")), same, "left_anti")
    again = rows(found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1"))
    if again.limit(1).count() == 0:
        return left
    own = left.withColumn(key, F.xxhash64("text"))
    return left.join(again, same, "left_anti").unionByName(own.join(again.withColumnRenamed(key, f"{key}_"), (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(key) == F.col(f"{key}_")), "left_semi").dropDuplicates(["doc_id", key]).drop(key))
