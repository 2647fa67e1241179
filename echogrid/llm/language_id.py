"""Language identification in two steps: the language family, then the language within it.

One linear support vector machine for each family (one versus the rest) picks
the family; inside it one machine for each pair of languages votes. Features
are hashed trigrams of the lower-cased UTF-8 bytes as shares of the text, so a
machine's margin for a whole text is a mean of table lookups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Language families by ISO 639-1 code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
BITS = 13
#: Nats a trigram by which a text may fall below its language's lowest hundredth.
ROOM = 0.5
#: Shares travel as half floats of this many parts, which keeps small ones exact enough.
_UNIT = 1024.0
_ASCII_LETTER = np.zeros(256, np.uint8)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


def trigrams(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The bucket of the trigram at each byte; 2^BITS where a row has no three bytes left."""
    low = common.LOWER[text].astype(np.uint32)
    out = np.full(len(text), 1 << BITS, np.int32)
    if len(text) > 2:
        code = low[:-2] * np.uint32(65599) + low[1:-1]
        code = code * np.uint32(65599) + low[2:]
        out[:-2] = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    ends = offs[1:][np.diff(offs) > 0]
    out[ends - 1] = 1 << BITS
    out[np.maximum(ends - 2, 0)] = 1 << BITS
    return out


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values over each row's bytes; 0 for empty rows."""
    out, full = np.zeros(len(offs) - 1, np.float64), np.diff(offs) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offs[:-1][full], dtype=np.float64)
    return out


def slices(text: np.ndarray, offs: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, offsets) in slices of about `most` bytes if this is one very long row; each trigram lies in one slice."""
    if len(offs) > 2 or len(text) <= most + 2:
        yield text, offs
        return
    for a in range(0, max(1, len(text) - 2), most):
        part = text[a : a + most + 2]
        yield part, np.array([0, len(part)])


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by accelerated gradient descent; classes weigh the same."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    size = 2 * float((share * np.einsum("ij,ij->i", x, x)).sum()) + 2 + penalty
    w, b, pw, pb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for k in range(rounds):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * share * y
        pw, pb = w, b
        w = vw - (penalty * vw - 2 * (slack @ x)) / size
        b = vb + 2 * float(slack.sum()) / size
    return w, b


@dataclass
class Model:
    """Machines as rows of one table; families and pairs say what each row decides."""

    families: list[list[str]]
    pairs: list[list[tuple[int, int]]]
    weights: np.ndarray
    bias: np.ndarray
    profiles: np.ndarray  # languages x trigrams (0 in the last column): log of each trigram's share in the language
    least: np.ndarray  # languages: a low mean of these logs among the language's learned texts
    spread: np.ndarray  # languages: standard deviation of one trigram's log

    def totals(self, text: np.ndarray, offs: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Sums of each table over the trigrams of each row (rows x tables)."""
        out = np.zeros((len(offs) - 1, len(tables)))
        for part, at in slices(text, offs):
            grams = trigrams(part, at)
            for k, table in enumerate(tables):
                out[:, k] += _sums(table[grams], at)
        return out

    def excess(self, langs: np.ndarray, sums: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """How far each text's mean log share lies above the limit of its language; a short text has the room that chance gives it."""
        names = [lang for family in self.families for lang in family]
        which = np.array([names.index(lang) for lang in langs], np.int64)
        n = np.maximum(1, np.diff(offs) - 2)
        mean = sums[np.arange(len(which)), which] / n
        return mean - self.least[which] + 4 * self.spread[which] / np.sqrt(n)

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores from the margins (rows x machines)."""
        sure = 1 / (1 + np.exp(-np.clip(3 * margins, -30, 30)))
        n = len(self.families)
        family = margins[:, :n].argmax(1) if n > 1 else np.zeros(len(margins), int)
        langs, scores, at = np.empty(len(margins), object), np.ones(len(margins)), n if n > 1 else 0
        for f, names in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, trust = np.zeros((len(rows), len(names))), np.zeros((len(rows), len(names)))
            for i, j in self.pairs[f]:
                p = sure[rows, at]
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                trust[:, i] += p
                trust[:, j] += 1 - p
                at += 1
            best = (votes + trust / (len(names) + 1)).argmax(1) if len(rows) else np.zeros(0, int)
            langs[rows] = np.array(names, object)[best]
            scores[rows] = (sure[rows, f] if n > 1 else 1.0) * (trust[np.arange(len(rows)), best] / max(1, len(names) - 1) if len(names) > 1 else 1.0)
        return langs, scores


def chosen(sample: DataFrame, most: int, least: int = 20) -> DataFrame:
    """(id, language) of distinct pairs of sample (doc_id, lang), for each language those of lowest hash up to one quota.

    The quota is an equal part of `most`, but `least` where there are very many
    languages. A language with many pairs is first thinned by the hash to about
    three quotas, so that no task gathers more than a few quotas of a language.
    """
    pairs = sample.select("doc_id", "lang").distinct().withColumn("rank", F.xxhash64("doc_id"))
    sizes = pairs.groupBy("lang").agg(F.count("*").alias("pairs"))
    n = sizes.count()
    quota = max(least, most // max(1, n))
    part = (F.col("rank") / F.lit(2.0**64) + 0.5) * F.col("pairs")
    few = pairs.join(F.broadcast(sizes), "lang").where(part <= 3 * quota + 30)
    lowest = few.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "doc_id"))), 1, quota).alias("lowest"))
    return lowest.select(F.explode("lowest").alias("one"), F.col("lang").alias("language")).select(F.col("one.doc_id").alias("id"), "language")


def fit(docs: DataFrame, most: int = 2000) -> Model | None:
    """Fits the machines on about `most` documents with text and language, as many of each language where there are; None if there is none.

    The documents are chosen by a hash of doc_id, one text for each pair of
    doc_id and language. Tasks turn the whole texts into histograms; only those
    come to the driver.
    """

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], tuple[int, bytes]] = {}
        for batch in batches:
            ids, langs, ranks = (batch.column(k).to_pylist() for k in range(3))
            for first, _, text, offs in common.chunks(batch.column(3)):
                for i, (a, b) in enumerate(zip(offs[:-1], offs[1:], strict=True), first):
                    key = ids[i], langs[i]
                    if key in best and best[key][0] <= ranks[i]:
                        continue
                    counts = sum(np.bincount(trigrams(*x), minlength=(1 << BITS) + 1)[:-1] for x in slices(text[a:b], np.array([0, b - a])))
                    best[key] = ranks[i], (counts * (_UNIT / max(1, counts.sum()))).astype("<f2").tobytes()
        rows = [(*key, *value) for key, value in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], ["id", "lang", "rank", "counts"])

    sample = docs.where("doc_id is not null and lang is not null and text is not null and length(text) > 2").select("doc_id", "lang", "text")
    picked = sample.join(F.broadcast(chosen(sample, most)), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("language")))
    counted = picked.select(F.col("doc_id").cast("string"), "lang", F.xxhash64("text").alias("rank"), "text").mapInArrow(histograms, "id string, lang string, rank long, counts binary")
    # tasks leave one row of each pair; of the tasks' rows the lowest stays
    single = counted.groupBy("id", "lang").agg(F.min(F.struct("rank", "counts")).alias("one")).select("lang", "one.counts")
    rows = sorted((str(r["lang"]), bytes(r["counts"])) for r in single.collect())
    if not rows:
        return None
    y = np.array([lang for lang, _ in rows], object)
    x = np.empty((len(rows), 1 << BITS), np.float32)
    while rows:
        x[len(rows) - 1] = np.frombuffer(rows.pop()[1], "<f2")
    x /= _UNIT
    scale = (1 / np.sqrt(x.mean(0) + 1e-6)).astype(np.float32)
    langs = sorted(set(y))
    profiles = _profiles(x, y, langs)
    x *= scale
    families = [[lang for lang in langs if _FAMILY.get(lang, lang) == f] for f in sorted({_FAMILY.get(lang, lang) for lang in langs})]
    machines = [svm(x, np.where(np.isin(y, names), 1, -1).astype(np.float32)) for names in families] if len(families) > 1 else []
    pairs = [list(combinations(range(len(names)), 2)) for names in families]
    for names, duels in zip(families, pairs, strict=True):
        for i, j in duels:
            rows_ij = np.isin(y, [names[i], names[j]])
            machines.append(svm(x[rows_ij], np.where(y[rows_ij] == names[i], 1, -1).astype(np.float32)))
    table = np.zeros((len(machines), (1 << BITS) + 1), np.float32)
    for k, (w, _) in enumerate(machines):
        table[k, :-1] = w * scale
    return Model(families, pairs, table, np.array([b for _, b in machines]), *(part[[langs.index(lang) for names in families for lang in names]] for part in profiles))


def _profiles(shares: np.ndarray, y: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log profiles, limits and spreads of the languages.

    A limit lies ROOM below the hundredth of the learned texts with the lowest
    means; each mean is taken from a profile that the text itself is no part of,
    where the language has two texts.
    """
    logs, least, spread = np.zeros((len(names), shares.shape[1] + 1), np.float32), np.zeros(len(names)), np.zeros(len(names))

    def smooth(share: np.ndarray) -> np.ndarray:
        return np.log(0.95 * share + 0.05 / len(share))

    for k, name in enumerate(names):
        own = np.flatnonzero(y == name)
        total = sum(shares[i].astype(np.float64) for i in own)
        share = total / len(own)
        logs[k, :-1] = smooth(share)
        # one text at a time: the driver holds one table of shares and no second
        means = [float(shares[i] @ smooth((total - shares[i]) / (len(own) - 1) if len(own) > 1 else share)) for i in own]
        least[k] = np.quantile(means, 0.01) - ROOM
        spread[k] = np.sqrt(max(0.0, share @ (logs[k, :-1] - share @ logs[k, :-1]) ** 2))
    return logs, least, spread


def identify(docs: DataFrame, model: Model | None, pred: str = "lang_pred", score: str = "lang_score", excess: str | None = None) -> DataFrame:
    """docs with the predicted language (string) and a score (0 to 1) added.

    `excess` names a further column (double): below 0, the text is less like its
    language than the learned texts are, so it is likely of none of them; null
    for `und`.

    Whole texts are read, very long ones in slices. An empty table gives an empty
    result. A text that is null or has no letter (str.isalpha) is `und` with score 0, and so is every
    text if nothing could be learned. Columns that have these names already are
    replaced; all others pass through. Rows that repeat are predicted one by one.
    """
    docs = docs.drop(pred, score, *([excess] if excess else []))
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            above = np.full(batch.num_rows, np.nan)
            column = batch.column(at)
            for a, b, text, offs in common.chunks(column):
                letters = _sums(_ASCII_LETTER[text], offs) > 0
                for i in np.flatnonzero(~letters & (np.diff(offs) > 0)):
                    letters[i] = any(map(str.isalpha, bytes(text[offs[i] : offs[i + 1]]).decode("utf-8", "replace")))
                if model is None or not letters.any():
                    continue
                n = np.maximum(1, np.diff(offs) - 2)
                margins = model.totals(text, offs, model.weights) / n[:, None] + model.bias
                found, sure = model.predict(margins)
                langs[a:b][letters], scores[a:b][letters] = found[letters], sure[letters]
                if excess:
                    above[a:b][letters] = model.excess(found, model.totals(text, offs, model.profiles), offs)[letters]
            more = {excess: pa.array(above, pa.float64(), from_pandas=True)} if excess else {}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more.values()], [*batch.schema.names, pred, score, *more])

    return docs.mapInArrow(run, common.widened(docs, f"`{pred}` string, `{score}` double" + (f", `{excess}` double" if excess else "")))


def learnable(docs: DataFrame, n_folds: int = 5, held_out: int = 0) -> DataFrame:
    """The documents outside the held-out fold."""
    return docs.where(common.fold("doc_id", n_folds) != held_out)


def digest(docs: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the other folds. A null doc_id is held out."""
    found = identify(docs.select("doc_id", "text"), fit(learnable(docs), most), "lang_pred", "score")
    return found.select("doc_id", F.coalesce(common.fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")
