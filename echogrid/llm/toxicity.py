"""Toxicity from a bidirectional gated recurrent network with attention pooling.

Inputs of a word (a run of letters or digits) are a hashed word embedding and
the maximum of hashed embeddings of its characters, each taken once with the
two and once with the five bytes before it. Two
recurrent layers read a window of words from both ends; attention pools their
states into one vector and a logistic unit rates it. Every text is cut into
overlapping windows that cover all its words, and the text's score is that of
its worst window. The network is trained here, in NumPy, on a bounded sample:
in each round the worst windows of every sample text, as the network of that
moment sees them, are what it learns from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, STRIDE = 48, 32
WORD_BITS, CHAR_BITS = 17, 15
WORD_DIM, CHAR_DIM, HIDDEN = 8, 4, 8
_GATES = 3 * HIDDEN
_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False


@dataclass
class Words:
    """The words of some rows: bucket of each word, buckets of all its characters, where words and rows begin."""

    word: np.ndarray
    char: np.ndarray
    char_at: np.ndarray
    row_at: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, offs: np.ndarray) -> Words:
        low = np.where(_SPLIT[text], np.uint8(32), common.LOWER[text])
        starts, ends, row_at = common.bounds(low, offs)
        word = (common.word_hashes(low, starts) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        size = ends - starts
        code = low[low != 32].astype(np.uint32) + np.uint32(1)
        since = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        near = short = code
        for back in range(1, 6):
            before = np.zeros_like(code)
            before[back:] = np.where(since[back:] >= back, code[:-back], 0)
            near = near * np.uint32(65599) + before
            if back == 2:
                short = near
        half = np.uint32(33 - CHAR_BITS)
        char = np.empty(2 * len(code), np.int32)
        char[::2] = (short * np.uint32(2654435761)) >> half
        char[1::2] = ((near * np.uint32(2654435761)) >> half) + np.uint32(1 << (CHAR_BITS - 1))
        return cls(word, char, np.concatenate([[0], np.cumsum(2 * size)]), row_at)

    def part(self, a: int, b: int) -> Words:
        """Rows a to b."""
        w, z = self.row_at[a], self.row_at[b]
        c, d = self.char_at[w], self.char_at[z]
        return Words(self.word[w:z], self.char[c:d], self.char_at[w : z + 1] - c, self.row_at[a : b + 1] - w)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and length of every window; a row without words has none."""
        n = np.diff(self.row_at)
        per = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(n)), per)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
        return row, self.row_at[row] + nth * STRIDE, np.minimum(WINDOW, n[row] - nth * STRIDE)


def slices(text: np.ndarray, offs: np.ndarray, words: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, offsets) as it is, but one very long row in slices of `words` words.

    A slice begins at a window of the whole text and ends with another, so all
    slices together have exactly the windows of the whole text.
    """
    if len(offs) > 2 or len(text) < 16 * words:
        yield text, offs
        return
    starts, ends, _ = common.bounds(np.where(_SPLIT[text], np.uint8(32), text), offs)
    step = max(1, words // STRIDE) * STRIDE
    for k in range(0, max(1, len(starts)), step):
        if k and len(starts) - k <= WINDOW - STRIDE:
            break
        last = min(len(starts), k + step + WINDOW - STRIDE)
        part = text[starts[k] : ends[last - 1]] if len(starts) else text[:0]
        yield part, np.array([0, len(part)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """The parameters, the forward pass over windows and its gradient."""

    def __init__(self, lead: np.ndarray, char_lead: np.ndarray, seed: int = 3):
        """The leads, first guesses of the buckets' toxicity, start as the first dimension of the embeddings."""
        r = np.random.default_rng(seed)
        f = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": f(1 << WORD_BITS, WORD_DIM, scale=0.05),
            "char": f(1 << CHAR_BITS, CHAR_DIM, scale=0.05),
            "in_word": f(WORD_DIM, 2 * _GATES, scale=0.3),
            "in_char": f(CHAR_DIM, 2 * _GATES, scale=0.3),
            "in_bias": np.zeros(2 * _GATES, np.float32),
            "fore": f(HIDDEN, _GATES, scale=0.3),
            "back": f(HIDDEN, _GATES, scale=0.3),
            "attend": f(2 * HIDDEN, scale=0.3),
            "out": f(2 * HIDDEN, scale=0.5),
            "bias": np.zeros(1, np.float32),
        }
        self.p["word"][:, 0] += lead.astype(np.float32)
        self.p["char"][:, 0] += char_lead.astype(np.float32)

    def gates(self, words: Words) -> np.ndarray:
        """Gate inputs of both directions of every word, and one row more for padding: it keeps a state as it is."""
        p = self.p
        out = np.zeros((len(words.word) + 1, 2 * _GATES), np.float32)
        if len(words.word):
            chars = np.maximum.reduceat(p["char"][words.char], words.char_at[:-1], axis=0)
            np.matmul(chars, p["in_char"], out=out[:-1])
            # the whole table once, or the words that are there if they are fewer
            if len(words.word) > len(p["word"]):
                out[:-1] += (p["word"] @ p["in_word"] + p["in_bias"])[words.word]
            else:
                out[:-1] += p["word"][words.word] @ p["in_word"] + p["in_bias"]
        out[-1, :HIDDEN] = out[-1, _GATES : _GATES + HIDDEN] = 30
        return out

    @staticmethod
    def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        hu = h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        return n + z * (h - n), z, r, n, hu[:, 2 * HIDDEN :]

    def logits(self, gates: np.ndarray, index: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows; index (WINDOW x windows) names rows of gates."""
        p, (steps, n) = self.p, index.shape
        states = np.empty((steps, n, 2 * HIDDEN), np.float32)
        trace: dict = {"fore": [None] * steps, "back": [None] * steps}
        for name, at, order in (("fore", 0, range(steps)), ("back", 1, range(steps - 1, -1, -1))):
            h, own = np.zeros((n, HIDDEN), np.float32), gates[:, at * _GATES : (at + 1) * _GATES]
            for t in order:
                new, *rest = self.step(own[index[t]], h, p[name])
                if keep:
                    trace[name][t] = (h, *rest)
                states[t, :, at * HIDDEN : (at + 1) * HIDDEN] = h = new
        real = index < len(gates) - 1
        a = np.where(real, states @ p["attend"], -1e9)
        a = np.exp(a - a.max(0)) * real
        a /= np.maximum(a.sum(0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return pooled @ p["out"] + p["bias"][0], {"states": states, "a": a, "pooled": pooled, "trace": trace}

    def gradient(self, d: np.ndarray, index: np.ndarray, made: dict) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the small parameters, and of the gate inputs at each place of index, from those of the logits."""
        p, states, a = self.p, made["states"], made["a"]
        g = {"out": d @ made["pooled"], "bias": d.sum(keepdims=True)}
        to_pool = d[:, None] * p["out"]
        along = np.einsum("tnh,nh->tn", states, to_pool)
        scored = a * (along - (a * along).sum(0))
        g["attend"] = np.einsum("tn,tnh->h", scored, states)
        outer = a[:, :, None] * to_pool + scored[:, :, None] * p["attend"]
        steps, n = index.shape
        inputs = np.empty((steps, n, 2 * _GATES), np.float32)
        for name, at, order in (("fore", 0, range(steps - 1, -1, -1)), ("back", 1, range(steps))):
            u, gu, dh = p[name], np.zeros((HIDDEN, _GATES), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t in order:
                h, z, r, c, hc = made["trace"][name][t]
                dh = dh + outer[t, :, at * HIDDEN : (at + 1) * HIDDEN]
                dc = dh * (1 - z) * (1 - c * c)
                dz, dr = dh * (h - c) * z * (1 - z), dc * hc * r * (1 - r)
                both = np.concatenate([dz, dr], 1)
                inputs[t, :, at * _GATES : (at + 1) * _GATES] = np.concatenate([both, dc], 1)
                du = np.concatenate([both, dc * r], 1)
                gu += h.T @ du
                dh = dh * z + du @ u.T
            g[name] = gu
        return g, inputs

    def score(self, words: Words, block: int = 2048, most: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and logit of every window; runs of rows with about `most` words are laid out at a time."""
        out, a, n = [], 0, len(words.row_at) - 1
        row, first, _ = words.windows()
        while a < n:
            b = max(a + 1, int(np.searchsorted(words.row_at, words.row_at[a] + most, "right")) - 1)
            part = words.part(a, b)
            _, at, size = part.windows()
            gates = self.gates(part)
            for k in range(0, len(at), block):
                out.append(self.logits(gates, _places(at[k : k + block], size[k : k + block], len(part.word)))[0])
            a = b
        return row, first, np.concatenate(out) if out else np.zeros(0, np.float32)


def _places(first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    t = np.arange(WINDOW)[:, None]
    return np.where(t < size, first + t, pad)


class Adam:
    """Adam's steps. A gradient (rows, values) of an embedding moves these rows alone, so a step costs the same for any table."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.k = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def apply(self, g: dict[str, tuple[np.ndarray | slice, np.ndarray]]) -> None:
        self.k += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.k) / (1 - 0.9**self.k)
        for k, (at, x) in g.items():
            m, v = self.m[k][at], self.v[k][at]
            m, v = m + 0.1 * (x - m), v + 0.001 * (x * x - v)
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= scale * m / (np.sqrt(v) + 1e-7)


def _sums(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in index, and the sums of their values."""
    rows, at = np.unique(index, return_inverse=True)
    return rows, np.stack([np.bincount(at, values[:, k], len(rows)) for k in range(values.shape[1])], 1).astype(np.float32)


def _lead(buckets: np.ndarray, at: np.ndarray, labels: np.ndarray, used: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log ratio of toxic rows to expected ones for each bucket, and the number of rows that have it; rows begin at `at`."""
    held, bad = np.zeros(1 << bits), np.zeros(1 << bits)
    for i in np.flatnonzero(used).tolist():
        own = np.unique(buckets[at[i] : at[i + 1]])
        held[own] += 1
        bad[own] += labels[i]
    return np.log((bad + 3) / (held * labels[used].mean() + 3)), held


def train(texts: list[str], labels: np.ndarray, rounds: int = 5, batch: int = 64, steps: int = 450, rate: float = 0.005, rare: int = 4, seed: int = 11) -> Network:
    """The network of a sample of texts with labels 0 and 1.

    Word buckets in fewer than `rare` texts are unknown words: they stay zero.
    One text in eight is kept aside, and the round that rates those best wins.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    words = Words.of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    r = np.random.default_rng(seed)
    aside = r.random(len(texts)) < 0.125
    if len({*labels[~aside]}) < 2 or len({*labels[aside]}) < 2:
        aside[:] = False
    lead, held = _lead(words.word, words.row_at, labels, ~aside, WORD_BITS)
    char_lead, _ = _lead(words.char, words.char_at[words.row_at], labels, ~aside, CHAR_BITS)
    lead[held < rare] = 0
    net = Network(lead, char_lead)
    net.p["word"][held < rare] = 0
    row, first, size = words.windows()
    if not len(row) or labels.min() == labels.max():
        net.p["out"][:], net.p["bias"][:] = 0, 2.0 if len(labels) and labels.mean() > 0.5 else -2.0
        return net
    strong = np.maximum(0, lead[words.word] - 0.5)
    strong += np.maximum(0, np.maximum.reduceat(char_lead[words.char], words.char_at[:-1]) - 0.5)
    total = np.concatenate([[0.0], np.cumsum(strong)])
    del strong
    worst, adam, best = total[first + size] - total[first], Adam(net.p, rate), (np.inf, net.p)
    for k in range(rounds):
        order = np.lexsort((-worst, row))
        lead_of = order[np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]])]
        clean = np.flatnonzero((labels[row] == 0) & ~aside[row])
        extra = r.choice(clean, min(len(clean), len(lead_of)))
        used = r.permutation(np.concatenate([lead_of[~aside[row[lead_of]]], extra]))
        bad = labels[row[used]] == 1
        weight = np.where(bad, 0.5 / max(1, bad.sum()), 0.5 / max(1, (~bad).sum())) * len(used)
        adam.rate = rate * (1 - k / (rounds + 1))
        # as many passes as make the round's share of the steps: a small sample is passed more often, not without end
        for _ in range(max(1, round(steps / rounds / -(-len(used) // batch)))):
            for a in range(0, len(used), batch):
                w = used[a : a + batch]
                same = (labels[row[w]] == 0) & (r.random(len(w)) < 0.15)
                _learn(net, adam, words, first[w], size[w], same, labels[row[w]], weight[a : a + batch], held < rare)
        worst = net.score(words)[2]
        top = np.full(len(texts), net.p["bias"][0], np.float64)
        np.maximum.at(top, row, worst)
        trial = aside if aside.any() else np.ones(len(texts), bool)
        loss = np.logaddexp(0, np.where(labels == 1, -top, top))[trial]
        loss = loss[labels[trial] == 1].mean() + loss[labels[trial] == 0].mean()
        if loss <= best[0]:
            best = (loss, {name: x.copy() for name, x in net.p.items()})
    net.p = best[1]
    return net


def _learn(net: Network, adam: Adam, words: Words, first: np.ndarray, size: np.ndarray, same: np.ndarray, y: np.ndarray, weight: np.ndarray, frozen: np.ndarray) -> None:
    """One step on some windows. Windows marked `same` are read as their middle word over and over, which must not change what a clean word means.

    Only the windows' words are laid out, so a step costs the same for any sample.
    """
    index = _places(first, size, -1)
    index = np.where(same & (index >= 0), first + size // 2, index)
    at = index[index >= 0]
    n_chars = np.diff(words.char_at)[at]
    char_at = np.concatenate([[0], np.cumsum(n_chars)])
    chars = words.char[np.repeat(words.char_at[at] - char_at[:-1], n_chars) + np.arange(char_at[-1])]
    part = Words(words.word[at], chars, char_at, np.array([0, len(at)]))
    local = np.full(index.shape, len(at))
    local[index >= 0] = np.arange(len(at))
    logits, made = net.logits(net.gates(part), local, keep=True)
    d = ((_sigmoid(logits) - y) * weight / len(y)).astype(np.float32)
    g, inputs = net.gradient(d, local, made)
    inputs, p = inputs[index >= 0], net.p
    each = p["char"][chars]
    most = np.maximum.reduceat(each, char_at[:-1], axis=0)
    g["in_word"], g["in_char"], g["in_bias"] = p["word"][part.word].T @ inputs, most.T @ inputs, inputs.sum(0)
    moved = {k: (slice(None), x) for k, x in g.items()}
    moved["word"] = _sums(part.word, inputs @ p["in_word"].T * ~frozen[part.word, None])
    moved["char"] = _sums(chars, np.repeat(inputs @ p["in_char"].T, n_chars, axis=0) * (each == np.repeat(most, n_chars, axis=0)))
    norm = np.sqrt(sum(float((x * x).sum()) for _, x in moved.values()))
    adam.apply({k: (at, x * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))) for k, (at, x) in moved.items()})


def spread(text: str, most: int, piece: int = 4096) -> str:
    """A text of at most about `most` characters as it is; of a longer one pieces of whole words, evenly spread over it."""
    if len(text) <= most:
        return text
    starts = np.linspace(0, len(text) - piece, max(1, most // piece)).astype(int).tolist()
    cut = (text[a : a + piece].split(" ") for a in starts)
    return " ".join(" ".join(words[1:-1] if len(words) > 2 else words) for words in cut)


def fit(sample: DataFrame, characters: int = 1 << 16) -> Network | None:
    """The network of a bounded sample (text, label); None if it is empty.

    `characters` bounds what one text of the sample brings to the driver: of a
    longer text evenly spread pieces are learned from.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spread(t, characters) for t in batch.column(1).to_pylist()], pa.string())], ["label", "text"])

    rows = sorted((r["label"], r["text"]) for r in sample.select("label", "text").mapInArrow(bounded, "label int, text string").collect())
    if not rows:
        return None
    return train([t for _, t in rows], np.array([min(1, max(0, v)) for v, _ in rows]))


def rate(docs: DataFrame, net: Network | None, score: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1 added, the highest of the text's windows.

    Whole texts are read; a very long one in slices, whose windows are those of
    the whole text. An empty table gives an empty result.
    A text without words, null included, has the score of an empty window; all
    have 0.5 without a network. A column of that name is replaced; others pass
    through; rows that repeat get the same score.
    """
    docs = docs.drop(score)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out = np.full(batch.num_rows, 0.0 if net is None else net.p["bias"][0], np.float64)
            if net is not None:
                for a, b, text, offs in common.chunks(batch.column(at)):
                    found = np.full(b - a, -np.inf)
                    for part, cuts in slices(text, offs):
                        row, _, logits = net.score(Words.of(part, cuts))
                        np.maximum.at(found, row, logits)
                    out[a:b] = np.where(np.isfinite(found), found, out[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(out), pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, common.widened(docs, f"`{score}` double"))


def digest(docs: DataFrame, labels: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels.toxic of the other folds is what is learned. A null doc_id is held out."""
    net = fit(common.labelled_sample(docs, labels, "toxic", 5, 0, most))
    found = rate(docs.select("doc_id", "text"), net, "score")
    return found.select("doc_id", F.coalesce(common.fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
