"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text is counted as a bag of its lower-cased words and of pairs of neighbouring
words, hashed into fixed columns; word shapes (which classes of bytes a word
has, its length, whether it repeats the word before) and pairs of shapes are
further columns. Counts are sparse and weighted by inverse document frequency. A
truncated singular value decomposition of the labelled sample's weighted counts
gives the latent space. The sample's vectors, a bounded number,
are broadcast; every document is compared with all of them by blocked matrix
products, and its nearest neighbours vote with their cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHAPES, PAIRS, WORDS, WORD_PAIRS = 1 << 10, 1 << 11, 1 << 16, 1 << 16
WIDTH = SHAPES + PAIRS + WORDS + WORD_PAIRS
_CLASS = np.full(256, 64, np.uint8)
_CLASS[list(common.SPACE_BYTES)] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_CLASS[list(b"#*$%&|<>")] = 8
_CLASS[list(b".,;:!?")] = 32


#: Bytes of a slice of a very long text.
SLICE = 1 << 22


def _slices(text: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A text in slices of whole words, each behind the two words before it, and how many such words it has."""
    before: list[bytes] = []
    a, n = 0, len(text)
    while a < n:
        b = min(n, a + SLICE)
        while b < n:
            gap = np.flatnonzero(common.SPACE[text[b : b + 65_536]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(n, b + 65_536)
        part = np.concatenate([np.frombuffer(b"".join(w + b" " for w in before), np.uint8), text[a:b]])
        yield part, len(before)
        starts, ends, _ = common.bounds(part, np.array([0, len(part)]))
        before = [part[s:e].tobytes() for s, e in zip(starts[-2:], ends[-2:], strict=True)]
        a = b


def terms(text: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of the terms that each row has, logarithms of one more than their counts, and where each row's terms begin (n + 1 numbers).

    A very long row is counted slice by slice.
    """
    n = len(offs) - 1
    if n == 1 and len(text) > SLICE:
        counts = np.zeros(WIDTH, np.int64)
        for part, skip in _slices(text):
            columns, found = _counted(part, np.array([0, len(part)]), skip)
            counts[columns] += found
        cells = np.flatnonzero(counts)
        found = counts[cells]
    else:
        cells, found = _counted(text, offs)
    return cells % WIDTH, np.log1p(found).astype(np.float32), np.searchsorted(cells, np.arange(n + 1) * WIDTH)


def _counted(text: np.ndarray, offs: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Cells (row * WIDTH + column) of the terms of all rows, and their counts; terms that end within the first `skip` words do not count."""
    starts, ends, at = common.bounds(text, offs)
    if len(starts) <= skip:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    together = row[1:] == row[:-1]
    hashes = common.word_hashes(text, starts)
    again = np.zeros(len(starts), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & together
    size = np.searchsorted([2, 4, 9], ends - starts, "right")
    shape = np.bitwise_or.reduceat(_CLASS[text], starts).astype(np.int64) | size << 7 | again << 9
    pair = ((shape[:-1] * 1031 + shape[1:]) * 2654435761 >> 7) % PAIRS
    low = common.word_hashes(common.LOWER[text], starts)
    word = (low % np.uint64(WORDS)).astype(np.int64)
    two = (common.mix(low[:-1] * np.uint64(3) + low[1:]) % np.uint64(WORD_PAIRS)).astype(np.int64)
    first = row * WIDTH
    together[: max(0, skip - 1)] = False
    cells = np.concatenate([(first + shape)[skip:], (first[1:] + SHAPES + pair)[together], (first + (SHAPES + PAIRS) + word)[skip:], (first[1:] + (SHAPES + PAIRS + WORDS) + two)[together]])
    return np.unique(cells, return_counts=True)


def _product(columns: np.ndarray, values: np.ndarray, at: np.ndarray, dense: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """The sparse rows (columns and values of row i from at[i] to at[i + 1]) times a dense matrix, by runs of rows with about `block` values."""
    out, a, n = np.zeros((len(at) - 1, dense.shape[1]), np.float32), 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + block, "right")) - 1)
        full = a + np.flatnonzero(np.diff(at[a : b + 1]))
        if len(full):
            part = dense[columns[at[a] : at[b]]] * values[at[a] : at[b], None]
            out[full] = np.add.reduceat(part, at[full] - at[a], axis=0)
        a = b
    return out


@dataclass
class Model:
    basis: np.ndarray  # WIDTH x dimensions, times the weight of each term
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray
    prior: float

    def embed(self, columns: np.ndarray, logs: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = _product(columns, logs, at, self.basis)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray, neighbours: int, block: int = 512) -> np.ndarray:
        out = np.full(len(vectors), self.prior)
        k = min(neighbours, len(self.labels))
        for a in range(0, len(vectors), block):
            cosines = vectors[a : a + block] @ self.vectors.T
            least = np.partition(cosines, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            weight = np.where(cosines >= least, np.maximum(cosines, 0), 0)
            for _ in range(3):
                weight *= weight
            total = weight.sum(1)
            voted = weight @ self.labels / np.maximum(total, 1e-12)
            out[a : a + block] = np.where(total > 1e-12, voted, self.prior)
        return np.clip(out, 0, 1)


def _decompose(columns: np.ndarray, values: np.ndarray, at: np.ndarray, width: int, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of sparse rows by subspace iteration."""
    n = len(at) - 1
    order = np.argsort(columns, kind="stable")
    rows = np.repeat(np.arange(n), np.diff(at))[order]
    turned = rows, values[order], np.searchsorted(columns[order], np.arange(width + 1))
    q = np.random.default_rng(7).standard_normal((width, min(dimensions + 8, n, width))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(_product(*turned, _product(columns, values, at, q)))
    _, _, v = np.linalg.svd(_product(columns, values, at, q), full_matrices=False)
    return (q @ v.T)[:, :dimensions].astype(np.float32)


def fit(sample: DataFrame, dimensions: int = 32) -> Model | None:
    """The model of a bounded sample (text, label); None if it is empty. Tasks count the texts; only the terms that occur come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, _, text, offs in common.chunks(batch.column(1)):
                columns, logs, at = terms(text, offs)
                rows += [(columns[a:b].astype("<u4").tobytes(), logs[a:b].astype("<f2").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(x), pa.binary()) for x in (zip(*rows) if rows else ((), ())))], ["label", "columns", "logs"])

    rows = sorted((r["label"], bytes(r["columns"]), bytes(r["logs"])) for r in sample.select("label", "text").mapInArrow(count, "label int, columns binary, logs binary").collect())
    if not rows:
        return None
    columns = np.frombuffer(b"".join(c for _, c, _ in rows), "<u4")
    at = np.concatenate([[0], np.cumsum([len(c) // 4 for _, c, _ in rows])])
    # only columns that the sample has are decomposed
    used, place, holders = np.unique(columns, return_inverse=True, return_counts=True)
    scale = np.log((1 + len(rows)) / (1 + holders)).astype(np.float32) + np.float32(0.1)
    logs = np.frombuffer(b"".join(v for _, _, v in rows), "<f2").astype(np.float32)
    y = np.array([v for v, _, _ in rows], np.float64)
    found = _decompose(place, logs * scale[place], at, len(used), dimensions) * scale[:, None]
    basis = np.zeros((WIDTH, found.shape[1]), np.float32)
    basis[used] = found
    model = Model(basis, np.zeros((0, found.shape[1]), np.float32), y, float(y.mean()))
    model.vectors = model.embed(columns, logs, at)
    return model


def rate(docs: DataFrame, model: Model | None, neighbours: int = 15, score: str = "quality_score") -> DataFrame:
    """docs with a score from 0 to 1 added: the share of good labels among the nearest neighbours.

    Whole texts are read, very long ones in slices. All neighbours that tie at the last place vote. An
    empty table gives an empty result. A null text counts as empty. Where no neighbour resembles the text, as for
    an empty one, the score is the sample's share of good rows, and 0.5 without
    a model. A column of that name is replaced; others pass through; rows that
    repeat get the same score.
    """
    docs = docs.drop(score)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                for a, b, text, offs in common.chunks(batch.column(at)):
                    out[a:b] = model.vote(model.embed(*terms(text, offs)), neighbours)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, common.widened(docs, f"`{score}` double"))


def digest(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels.quality of the other folds is what is learned. A null doc_id is held out."""
    model = fit(common.labelled_sample(docs, labels, "quality", 3, 1, most))
    found = rate(docs.select("doc_id", "text"), model, score="score")
    return found.select("doc_id", F.coalesce(common.fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
