"""Near-duplicate groups by a chosen-path set similarity join.

A text's set holds the hashes of its distinct word n-grams; equal sets are one
class and travel once. A signature holds the set's minwise token under each of
_COORDINATES hash functions: two sets agree in a coordinate with the probability
of their similarity.

A tree starts with all sets in one node. A node chooses one or two coordinates,
1 / (percent / 100) of them in the mean, by a hash of its own path, and a set goes
on to the child that its minwise token there names. So two sets at the threshold
share one child of a shared node in the mean, more similar ones more, and
unlike ones soon part. The first `depth` levels need no look at other sets; then
nodes with few sets outside their largest known component are compared
exhaustively, and the others branch on until they are small. The number of
independent trees follows from the recall that is asked for at the threshold.

1. In each node all sets are held against one of them, in a large node the one
   next to what most of its sets have in common: that makes a group of near copies
   of any size one component with one link a set.
2. In each small node, sets outside the main component are compared with all
   others. A node with a large main component lies in parts, and only the few
   others visit all parts. What they may link with is looked up in the cells of
   its component: a set and a cell make one row, never a row for each pair, and
   the first link on full sets joins the components.

Comparisons first count equal coordinates, and what may reach the threshold is
confirmed on full sets. Pairs inside a component change nothing and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, jaccard_join
from .components import components

_COORDINATES = 128
_ODD = np.random.default_rng(77).integers(1, 2**63, _COORDINATES, dtype=np.uint64) | np.uint64(1)
_SHIFT = np.random.default_rng(78).integers(1, 2**63, _COORDINATES, dtype=np.uint64)
#: A node is small if its sets times those outside its main component are at most SMALL squared, and has a hub beyond HUB sets.
#: Sets of a part of a node; n-grams of a cell of a component; levels beyond which nodes are compared whatever their size.
SMALL, HUB, PART, CELL, LEVELS = 2048, 64, 1024, 500_000, 40


def trees_for(recall: float, depth: int, percent: int) -> int:
    """Trees that find a pair at the threshold with this probability: a pair has two shared children of a node at most."""
    similarity, two = percent / 100, 100 / percent - 1
    miss = 0.0
    for _ in range(depth):
        lost = 1 - similarity + similarity * miss
        miss = (1 - two) * lost + two * lost**2
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def least_agreement(percent: int) -> int:
    """Equal coordinates below which a pair is no candidate: four standard deviations under the threshold's mean."""
    p = percent / 100
    return max(1, math.floor(_COORDINATES * p - 4 * math.sqrt(_COORDINATES * p * (1 - p))))


def signatures_of(sets: list[np.ndarray]) -> list[bytes]:
    """Each set's minwise token under each hash function, as 16 bits of its hash; no set is empty."""
    if not sets:
        return []
    every = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), _COORDINATES), np.uint64)
    for k in range(_COORDINATES):
        out[:, k] = np.minimum.reduceat((every ^ _SHIFT[k]) * _ODD[k], first)
    return [x.tobytes() for x in (common.mix(out) >> np.uint64(48)).astype("<u2")]


def children(owner: np.ndarray, node: np.ndarray, signs: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes' children that their sets (rows of signs) go to."""
    chosen = common.mix(node ^ np.uint64(0x9E3779B97F4A7C15))
    first = (chosen % np.uint64(_COORDINATES)).astype(np.int64)
    # a second coordinate in so many of 2^16 nodes
    more = np.flatnonzero(((chosen >> np.uint64(40)) & np.uint64(0xFFFF)) < np.uint64(65536 * (100 - percent) // percent))
    second = (first[more] + 1 + ((chosen[more] >> np.uint64(20)) % np.uint64(_COORDINATES - 1)).astype(np.int64)) % _COORDINATES
    owner, node, at = np.r_[owner, owner[more]], np.r_[node, node[more]], np.r_[first, second]
    token = signs[owner, at].astype(np.uint64) << np.uint64(8) | at.astype(np.uint64)
    return owner, common.mix((node ^ np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xC2B2AE3D27D4EB4F) + token)


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, _COORDINATES)


def _nodes(signatures: DataFrame, trees: int, depth: int, percent: int) -> DataFrame:
    """(node, key): the nodes of each set at this depth of all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = common.mix(np.arange(1, trees + 1, dtype=np.uint64))
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                signs = _signs(batch.column(1))
                owner, node = np.repeat(np.arange(len(signs)), trees), np.tile(roots, len(signs))
                for _ in range(depth):
                    owner, node = children(owner, node, signs, percent)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(batch.column(0).to_numpy()[owner])], ["node", "key"])

    return signatures.select("key", "signature").mapInArrow(run, "node long, key long")


def _shared(rows: DataFrame, signatures: DataFrame) -> DataFrame:
    """(node, key, centre, n) of the nodes that hold several sets, n of them; centre is one of them, which the others are held against first."""
    several = rows.groupBy(F.col("node").alias("at")).agg(F.count("*").alias("n"), F.min("key").alias("centre")).where("n > 1")
    several = common.stored(several, "nodes")
    hubs = several.where(F.col("n") > HUB)
    if hubs.limit(1).count():
        hubs = common.stored(_hubs(rows, hubs, signatures), "hubs")
        several = several.join(hubs, several["at"] == hubs["hub_of"], "left").select("at", "n", F.coalesce("hub", "centre").alias("centre"))
    return common.stored(common.split_join(rows, several, [("node", "at")], "n").select("node", "key", "centre", "n"), "shared")


def _hubs(rows: DataFrame, large: DataFrame, signatures: DataFrame, sample: int = 256) -> DataFrame:
    """(hub_of, hub): of each large node the set that agrees most with what most sets have in each coordinate.

    In a group of copies of one text that is the text itself or the copy next to
    it, with which the others are more alike than with each other. About
    `sample` sets of a node are looked at; that decides only which one is the hub.
    """

    def chosen(node: list[pa.RecordBatch]) -> int:
        signs, keys = np.concatenate([_signs(b.column(2)) for b in node]), np.concatenate([b.column(1).to_numpy() for b in node])
        order = np.sort(signs, axis=0)
        # of each column the value of its longest run
        runs = np.cumsum(np.r_[np.ones((1, _COORDINATES), bool), order[1:] != order[:-1]], axis=0)
        most = np.array([order[np.argmax(np.bincount(runs[:, k])[runs[:, k]]), k] for k in range(_COORDINATES)], np.uint16)
        return int(keys[np.lexsort((keys, -(signs == most).sum(axis=1)))[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            node, out = batch.column(0).to_numpy(), []
            cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
                if a == b:
                    continue
                if held and at != node[a]:
                    out.append((at, chosen(held)))
                    held = []
                at = node[a]
                held.append(batch.slice(a, b - a))
            if out:
                yield _pair_batch([np.array(out, np.int64)], "hub_of", "hub")
        if held:
            yield _pair_batch([np.array([(at, chosen(held))], np.int64)], "hub_of", "hub")

    some = rows.join(large.select("at", "n"), rows["node"] == large["at"]).where(F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / sample)) == 0)
    signed = some.join(signatures.select(F.col("key").alias("of"), "signature"), F.col("key") == F.col("of")).select("node", "key", "signature")
    return signed.repartition("node").sortWithinPartitions("node").mapInArrow(run, "hub_of long, hub long")


def _members(labels: DataFrame, signatures: DataFrame) -> DataFrame:
    """(vertex, label, cell): each linked set's component and its cell in it; cells hold about CELL n-grams."""
    sized = labels.join(signatures.select(F.col("key").alias("vertex"), "n"), "vertex")
    cells = sized.groupBy("label").agg(F.ceil(F.sum("n") / CELL).cast("int").alias("cells"))
    return common.stored(sized.join(cells, "label").select("vertex", "label", F.pmod(F.xxhash64("vertex"), "cells").cast("int").alias("cell")), "members")


def _labelled(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows with each set's component and cell, and their nodes' size and main component; nodes of one component are left out."""
    own = rows.join(members, rows["key"] == members["vertex"], "left").select("node", "key", F.coalesce("label", "key").alias("label"), F.coalesce("cell", F.lit(0)).alias("cell"))
    per_label = own.groupBy("node", "label").agg(F.count("*").alias("c"))
    nodes = per_label.groupBy(F.col("node").alias("at")).agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("most")).select("at", "n", F.col("most.label").alias("main"), (F.col("n") - F.col("most.c")).alias("others")).where("others > 0")
    nodes = common.stored(nodes, "mixed-nodes")
    return common.stored(common.split_join(own, nodes, [("node", "at")], "n").select("node", "key", "label", "cell", "n", "main", "others"), "mixed")


def _branched(rows: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(node, key) one level further down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, node = children(np.arange(batch.num_rows), batch.column(0).to_numpy().view(np.uint64), _signs(batch.column(2)), percent)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(batch.column(1).to_numpy()[owner])], ["node", "key"])

    signs = signatures.select(F.col("key").alias("of"), "signature")
    return rows.join(signs, rows["key"] == signs["of"]).select("node", "key", "signature").mapInArrow(run, "node long, key long")


def _fitting(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _with_centre(shared: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set b two of the centres a of its nodes that it may link with, the most alike one and that of the largest node.

    The second is the same for most sets of a large group, and so joins what
    the first ones leave apart.
    """
    enough = least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, held, n, m = (batch.column(i).to_numpy() for i in range(5))
            alike = (_signs(batch.column(5)) == _signs(batch.column(6))).sum(axis=1)
            keep = (alike >= enough) & _fitting(n, m, percent)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, alike, held)], ["a", "b", "alike", "held"])

    pairs = shared.where("key <> centre").groupBy(F.col("centre").alias("a"), F.col("key").alias("b")).agg(F.max("n").alias("held"))
    pairs = common.stored(pairs.join(signatures.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("signature").alias("sign_b")), "b"), "with-centre")
    of_a = pairs.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n_rows")).join(signatures, "key").select(F.col("key").alias("a_key"), "n", F.col("signature").alias("sign_a"), "n_rows")
    of_a = common.stored(of_a, "centres")
    both = common.split_join(pairs, of_a, [("a", "a_key")], "n_rows").select("a", "b", "held", "n", "m", "sign_a", "sign_b")
    best = both.mapInArrow(run, "a long, b long, alike long, held long").groupBy("b").agg(*[F.max(F.struct(by, F.col("a").alias("a"))).alias(by) for by in ("alike", "held")])
    return best.select(F.explode(F.array_distinct(F.array("alike.a", "held.a"))).alias("a"), "b")


def _candidates(mixed: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """(label, cell, asker, others): sets of a component's cell that a set of another component may link with, from all small nodes.

    Sets outside a node's main component ask; every pair of a node in different
    components is compared once, and told by the first of the nodes that it shares.
    """
    enough = least_agreement(percent)
    parts = F.ceil(F.col("n") / PART).cast("int")
    asks = F.col("label") != F.col("main")
    held = mixed.where(~asks).select("node", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), "key", "label", "cell", F.lit(False).alias("asks"))
    asking = mixed.where(asks).select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "key", "label", "cell", F.lit(True).alias("asks"))
    # a set is in some dozens of nodes
    known = mixed.groupBy(F.col("key").alias("of")).agg(F.collect_list("node").alias("nodes"))
    signs = signatures.join(known, F.col("key") == F.col("of")).select("of", F.col("n").alias("size"), "signature", "nodes")
    rows = held.unionByName(asking)
    rows = rows.join(signs, rows["key"] == signs["of"]).select("node", "part", "asks", "key", "label", "cell", "size", "signature", "nodes")
    dealt = rows.repartition("node", "part").sortWithinPartitions("node", "part", "asks", "key")

    def compared(node: list[pa.RecordBatch]) -> list[tuple[int, int, int, list[int]]]:
        columns = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in node]) for i in (2, 3, 4, 5, 6)]
        asks, key, label, cell, size = columns
        signs, out = np.concatenate([_signs(b.column(7)) for b in node]), []
        here = int(node[0].column(0)[0].as_py())
        # the nodes of each set that come before this one
        before = [[x for x in nodes if x < here] for b in node for nodes in b.column(8).to_pylist()]
        for y in np.flatnonzero(asks).tolist():
            # with what does not ask, and with what comes before among those that do
            apart = np.flatnonzero((label[:y] != label[y]) & _fitting(size[:y], size[y], percent))
            apart = apart[(signs[apart] == signs[y]).sum(axis=1) >= enough]
            told = set(before[y])
            apart = apart[[told.isdisjoint(before[x]) for x in apart.tolist()]] if len(apart) else apart
            order = np.lexsort((cell[apart], label[apart]))
            apart = apart[order]
            cuts = np.flatnonzero((label[apart][1:] != label[apart][:-1]) | (cell[apart][1:] != cell[apart][:-1])) + 1
            out += [(int(label[x[0]]), int(cell[x[0]]), int(key[y]), key[x].tolist()) for x in np.split(apart, cuts) if len(x)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, [], []
        for batch in batches:
            node, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((node[1:] != node[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)], strict=True):
                if a == b:
                    continue
                if held and at != (node[a], part[a]):
                    out += compared(held)
                    held = []
                at = (node[a], part[a])
                held.append(batch.slice(a, b - a))
            if len(out) > 2000:
                yield packed(out)
                out = []
        if held:
            out += compared(held)
        if out:
            yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["label", "cell", "asker", "others"])

    found = dealt.mapInArrow(run, "label long, cell int, asker long, others array<long>")
    # there are no more others than sets in the cell
    return found.groupBy("label", "cell", "asker").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))


def _sets_of(keys: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(set_key, shingles) of the sets that a column of keys names, and of few others."""
    bloom = docs.sparkSession.sparkContext.broadcast(jaccard_join._bloom(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, text, offs in common.chunks(batch.column(0)):
                sets = [s for s in jaccard_join.shingle_sets(text, offs, width) if len(s)]
                own = [jaccard_join.key_of(s) for s in sets]
                maybe = jaccard_join._in_bloom(bloom.value, np.array(own, np.int64))
                chosen = [(k, s.tobytes()) for s, k, new, m in zip(sets, own, jaccard_join._first_seen(seen, own), maybe, strict=True) if new and m]
                if chosen:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chosen], pa.int64()), pa.array([s for _, s in chosen], pa.binary())], ["set_key", "shingles"])

    return docs.select("text").where("text is not null").mapInArrow(run, "set_key long, shingles binary")


def _found_in_cells(asked: DataFrame, members: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): for each set that asks and each cell a link on full sets, if there is one; further ones would not change any component."""
    cells = asked.select("label", "cell").distinct()
    own = members.select(F.col("label").alias("of"), F.col("cell").alias("in"), "vertex")
    held = cells.join(own, (F.col("label") == F.col("of")) & (F.col("cell") == F.col("in")), "left").select("label", "cell", F.lit(0).alias("side"), F.coalesce("vertex", "label").alias("key"), F.lit(None).cast("array<long>").alias("others"))
    rows = common.stored(held.unionByName(asked.select("label", "cell", F.lit(1).alias("side"), F.col("asker").alias("key"), "others")), "asked")
    sets = _sets_of(rows.select("key").distinct(), docs, width)
    loaded = rows.hint("merge").join(sets, rows["key"] == sets["set_key"]).select("label", "cell", "side", "key", "others", "shingles")
    dealt = loaded.repartition("label", "cell").sortWithinPartitions("label", "cell", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, last = None, {}, None
        for batch in batches:
            out = []
            for label, cell, side, key, others, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (label, cell) != at:
                    at, held, last = (label, cell), {}, None
                own = np.frombuffer(raw, np.uint64)
                if side == 0:
                    held[key] = own
                elif key != last:  # equal texts of several tasks bring a set more than once
                    last = key
                    for a in range(0, len(others), 256):
                        some = [x for x in others[a : a + 256] if x in held]
                        hit = _linked(own, [held[x] for x in some], percent)
                        if len(hit):
                            out.append((some[hit[0]], key))
                            break
            if out:
                yield _pair_batch([np.array(out, np.int64)])

    return dealt.mapInArrow(run, "a long, b long")


def _linked(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Places of the sets that link with one set."""
    if not others:
        return np.zeros(0, np.int64)
    every, size = np.concatenate(others), np.array([len(x) for x in others])
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    shared = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(size) - size)
    return np.flatnonzero(100 * shared >= percent * (len(own) + size - shared))


def _pair_batch(found: list[np.ndarray], *names: str) -> pa.RecordBatch:
    rows = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], list(names) or ["a", "b"])


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int, rows: int = 2000) -> DataFrame:
    """The pairs (a, b) whose full sets link. A set that many pairs name lies once beside each `rows` of them."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), docs, width)
    often = common.stored(pairs.groupBy(F.col("a").alias("name")).agg(F.count("*").alias("times")), "named")
    cells = common.split_join(pairs, often, [("a", "name")], "times")
    cells = common.stored(cells.select(F.col("a").alias("home"), F.pmod(F.xxhash64("b"), F.ceil(F.col("times") / rows)).cast("int").alias("part"), F.col("b").alias("key"), F.lit(1).alias("side")), "cells")
    homes = cells.select("home", "part", F.col("home").alias("key"), F.lit(0).alias("side")).distinct()
    asked = cells.unionByName(homes)
    loaded = asked.hint("merge").join(sets, asked["key"] == sets["set_key"]).select("home", "part", "side", "key", "shingles")
    dealt = loaded.repartition("home", "part").sortWithinPartitions("home", "part", "side", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            out = []
            for home, part, side, key, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (home, part) != at:
                    at, last = (home, part), None
                if side == 0:
                    own = np.frombuffer(raw, np.uint64)
                elif key != last:  # equal texts of several tasks bring a set more than once
                    last = key
                    if len(_linked(own, [np.frombuffer(raw, np.uint64)], percent)):
                        out.append((home, key))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def link_sets(docs: DataFrame, width: int = 5, percent: int = 80, recall: float = 0.99999, depth: int = 4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_key, text_key) for each row, and (vertex, label) of the sets that link with another."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs = [], [], []
            for _, _, text, offs in common.chunks(batch.column(1)):
                sets = jaccard_join.shingle_sets(text, offs, width)
                sizes += map(len, sets)
                keys += [jaccard_join.key_of(s) if len(s) else None for s in sets]
                found = iter(signatures_of([s for s in sets if len(s)]))
                signs += [next(found) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "text_key", "n_shingles", "set_key", "signature"])

    rows = common.stored(docs.mapInArrow(signed, "doc_id long, text_key long, n_shingles long, set_key long, signature binary"), "signed")
    members = rows.drop("signature")
    signatures = rows.where("set_key is not null").groupBy(F.col("set_key").alias("key")).agg(F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    signatures = common.stored(signatures, "signatures")
    shared = _shared(_nodes(signatures, trees_for(recall, depth, percent), depth, percent), signatures)
    links = common.stored(_confirmed(common.stored(_with_centre(shared, signatures, percent), "pairs"), docs, width, percent), "confirmed")
    linked = _members(components(links), signatures)
    # nodes whose comparison would be too much branch on
    mixed = _labelled(shared, linked)
    much = F.col("others") * F.col("n") > SMALL * SMALL
    small = mixed.where(~much)
    for _ in range(LEVELS):
        large = mixed.where(much)
        if large.limit(1).count() == 0:
            break
        mixed = _labelled(_shared(_branched(large.select("node", "key"), signatures, percent), signatures), linked)
        small = small.unionByName(mixed.where(~much))
    else:
        small = small.unionByName(mixed.where(much))
    asked = common.stored(_candidates(small, signatures, percent), "candidates")
    labels = linked.select("vertex", "label")
    if asked.limit(1).count():
        links = links.unionByName(common.stored(_found_in_cells(asked, linked, docs, width, percent), "found"))
        labels = components(links)
    return members, labels


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, **options: float) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own
    included; kept tells that it is the row's own. Null, empty and blank texts
    have no shingles and link with nothing. A null doc_id never names a component
    unless no other id is there (then null, and the row is kept). Rows that
    repeat have one set and so one component; rows with one doc_id but
    different texts are compared like any others. Other columns are not looked
    at; whole texts of any length are cut into n-grams; an empty table gives an
    empty result. A pair is missed by all trees with a probability of at most
    1 - recall at the threshold; links of a group mostly have others beside them.
    """
    found = jaccard_join.named(*link_sets(docs, width, percent, **options))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
