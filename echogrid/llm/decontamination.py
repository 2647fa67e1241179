"""Benchmark decontamination by pigeonhole edit matching.

Item and text are normalised: A-Z in lower case, each run of ASCII white space
one blank, none at the ends. An item of m code points may differ from a passage
by `budget = floor(rate * m)` edits. It is cut into budget + 1 pieces: whatever
passage is within the budget holds at least one piece unchanged. An
Aho-Corasick automaton finds all piece hits in one pass over each whole text,
and Myers' bit-parallel algorithm verifies the stretch of text around a hit.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .line_dedup import _texts


def normalised(text: bytes) -> str:
    return b" ".join(text.translate(common.LOWER_TABLE).split()).decode("utf-8", "replace")


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


def myers(masks: dict[str, int], m: int, text: Iterable[str], stop: int = 0) -> int:
    """The least edit distance between the pattern and any substring of text; ends early at `stop`."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best = score
                if best <= stop:
                    return best
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best


@dataclass
class Matcher:
    """A block of items and what is needed to find them; built where it is used, once in each worker."""

    name: str
    items: list[tuple[int, str]]
    rate: float

    def built(self) -> Matcher:
        """This block, or the one of the same name that the worker has built before; a worker holds one block."""
        if _built.get("name") != self.name:
            _built.clear()
            _built.update(name=self.name, matcher=self._build())
        return _built["matcher"]

    def budget(self, k: int) -> int:
        return int(self.rate * len(self.items[k][1]))

    def _build(self) -> Matcher:
        pieces: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            m, n = len(text), self.budget(k) + 1
            for j in range(n):
                a, b = j * m // n, (j + 1) * m // n
                pieces[text[a:b]].append((k, a, b - a))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, where)
        if pieces:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}
        return self

    def find(self, text: str, first_only: bool = False) -> dict[int, int]:
        """Places in `items` of those within their budget somewhere in text, with the least number of edits; or one of them."""
        found: dict[int, int] = {}
        spans: dict[int, list[list[int]]] = {}
        if len(self.automaton):
            for end, where in self.automaton.iter(text):
                for k, a, size in where:
                    m, budget = len(self.items[k][1]), self.budget(k)
                    if not budget:
                        found[k] = 0
                        continue
                    first = end + 1 - size - a - budget
                    last = first + m + 2 * budget
                    held = spans.setdefault(k, [])
                    if held and first <= held[-1][1] and last - held[-1][0] <= 4 * (m + 2 * budget):
                        held[-1] = [min(first, held[-1][0]), max(last, held[-1][1])]
                    else:
                        held.append([first, last])
        for k, held in spans.items():
            if first_only and found:
                break
            item, budget = self.items[k][1], self.budget(k)
            best = budget + 1
            for first, last in held:
                stretch = text[max(0, first) : max(0, last)]
                if item in stretch:
                    best = 0
                elif len(stretch) >= len(item) - budget:
                    if k not in self.masks:
                        self.masks[k] = letter_masks(item)
                    best = min(best, myers(self.masks[k], len(item), stretch, 0))
                if best == 0:
                    break
            if best <= budget:
                found[k] = best
        return found


_built: dict = {}


def _blocks(items: DataFrame, rate: float, block_chars: int) -> Iterator[tuple[Matcher, int]]:
    """The items in blocks of about block_chars characters, each fetched when its turn comes, and the number of blocks."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        listed = sorted({(r["item_id"], normalised(r["text"].encode())) for r in part.collect()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield Matcher(uuid.uuid4().hex, [x for x in listed if x[1]], rate), blocks


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, errors, budget): each item found in a document, with the least number of edits.

    Items of every length follow the one rule: floor(rate * length) edits, so an
    item below 1 / rate characters is found where it stands unchanged. Items
    without words match nothing, and neither do null or empty texts. Whole texts
    of any length are searched. Rows that share a doc_id count as one document,
    items that share an item_id as one item (the best match counts), items with
    the same span are all found, and a null doc_id or item_id is carried along.
    Other columns are not looked at; an empty table gives an empty result.

    Items travel to the executors in blocks of about block_chars characters
    (about 50 bytes of automaton each in a worker), one broadcast and one pass
    over the documents for each; a block's matches are stored before the next
    block is fetched, so what is broadcast does not grow with the items.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    spark, found = docs.sparkSession, []
    for matcher, blocks in _blocks(items, rate, block_chars):
        shared = spark.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.value.built()
            for batch in batches:
                rows = [
                    (doc, matcher.items[k][0], errors, matcher.budget(k))
                    for doc, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True)
                    for k, errors in matcher.find(normalised(text)).items()
                ]
                columns = zip(*rows, strict=True) if rows else ((), (), (), ())
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "errors", "budget"])

        hits = texts.mapInArrow(run, "doc_id long, item_id long, errors int, budget int")
        if blocks > 1:
            hits = common.stored(hits, "item-matches")
            shared.unpersist()
        found.append(hits)
    best = F.min(F.struct("errors", "budget")).alias("best")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.errors", "best.budget")


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = 0.08, block_chars: int = 2_000_000) -> DataFrame:
    """docs without the rows whose text holds an item; see `matches` for what holds one.

    Each row is judged by its own whole text, so rows without doc_id go like any
    others, and nothing is shuffled. Columns stay as they are, whatever their
    names; rows without text stay; an empty table gives an empty result.
    """
    at = docs.columns.index("text")
    for matcher, blocks in _blocks(items, rate, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.value.built()
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normalised(text), first_only=True) for text in _texts(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if blocks > 1:
            docs = common.stored(docs, "clean")
            shared.unpersist()
    return docs
