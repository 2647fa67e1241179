"""Quality rules: surface counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are estimated from all documents: the
target from the trusted rows, the raw one from every row. A document's score is
the sum of log(target / raw) over its n-grams, divided by their number, and one
fixed threshold decides for every document. The n-grams are whole words, pairs
of neighbouring words and word endings (the last three code points of a word,
which many words share, so that they tell something of words never seen before),
each kind in buckets of its own. A short form takes only endings and their pairs.

Everything here is a DataFrame expression; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_SPACES = " \t\n\x0b\x0c\r"
_ENDING = 3
#: Occurrences that the target must have or lack before a whole word or pair weighs much: most words of any corpus are rare.
_PRIOR = 10.0


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; an empty array for null, empty or blank text."""
    # a split at one plain character needs no regular expression; what lies between two blanks is no word
    blanks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(blanks, " "), "")


def _ending(word: Column) -> Column:
    return F.substring(word, -_ENDING, _ENDING)


def _pairs(words: str) -> Column:
    """Each word of a text with the one behind it, as array<struct<word, next>>; null at the last word."""
    return F.arrays_zip(F.col(words).alias("word"), F.slice(words, 2, F.size(words)).alias("next"))


def _grams(pair: str, buckets: int, whole: int | None) -> list[Column]:
    """The buckets of the n-grams that begin at a word (null for a pair at the last word).

    With `whole`: ending, word and pair of words, in `buckets`, `whole` and
    `whole` buckets that follow each other. Without: ending and pair of
    endings, which share `buckets`.
    """
    first, second = F.col(f"{pair}.word"), F.col(f"{pair}.next")
    ending = F.pmod(F.xxhash64(_ending(first)), F.lit(buckets))
    if whole is None:
        return [ending, F.when(second.isNotNull(), F.pmod(F.xxhash64(_ending(first), F.lit("+"), _ending(second)), F.lit(buckets)))]
    pair_of = F.when(second.isNotNull(), F.pmod(F.xxhash64(first, F.lit(" "), second), F.lit(whole)) + (buckets + whole))
    return [ending, F.pmod(F.xxhash64(first), F.lit(whole)) + buckets, pair_of]


def with_repeated_words(rows: DataFrame) -> DataFrame:
    """rows (words, n_words) with n_repeat_words: the words that lie in a 3-word window found twice or more in the text.

    Each window's hash, with the window's place in its low bits, is sorted as
    one array of longs, so equal windows become neighbours; the words themselves
    are compared before two windows count as equal. Each step is a column of its
    own, so that it is made once, and reads its neighbours from shifted arrays:
    a lookup by place in a lambda costs several times as much.
    """
    word = F.col("words")
    bits = F.greatest(F.lit(20), F.length(F.bin("n_words"))).cast("int")
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1

    def rest(column: str, k: int) -> Column:
        return F.slice(column, k + 1, F.size(column))

    def same_words(pair: Column) -> Column:
        at = [(F.get(word, pair["a"] + k), F.get(word, pair["b"] + k)) for k in range(3)]
        return (at[0][0] == at[0][1]) & (at[1][0] == at[1][1]) & (at[2][0] == at[2][1])

    # zip_with fills the shorter array with nulls: the last two windows are none
    pairs = F.zip_with("hashes", rest("hashes", 1), lambda x, y: F.xxhash64(x, y))
    windows = F.slice(F.zip_with(pairs, rest("hashes", 2), lambda x, y: F.xxhash64(x, y)), 1, F.greatest(F.lit(0), F.size("hashes") - 2))
    # a text without equal hashes has no equal windows; only the others are sorted
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    keyed = F.transform("windows", lambda x, i: x.bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long")))
    keyed = F.when(again, F.sort_array(keyed)).otherwise(F.array().cast("array<bigint>"))
    both = lambda x, y: F.struct(x.bitwiseAND(F.col("mask")).cast("int").alias("a"), y.bitwiseAND(F.col("mask")).cast("int").alias("b"))
    hits = F.zip_with("keyed", rest("keyed", 1), lambda x, y: F.when(F.call_function("shiftrightunsigned", x.bitwiseXOR(y), F.col("bits")) == 0, both(x, y)))
    equal = F.filter(F.filter(hits, lambda p: p.isNotNull()), same_words)
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(equal, lambda p: F.array(p["a"], p["b"])))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    out = rows.withColumns({"hashes": F.transform("words", lambda x: F.xxhash64(x)), "bits": bits}).withColumn("mask", place)
    out = out.withColumn("windows", windows).drop("hashes").withColumn("keyed", keyed).withColumn("n_repeat_words", covered)
    return out.drop("windows", "bits", "mask", "keyed")


def base_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), the text replaced by words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0)
    out = docs.withColumns({
        "words": words_of(text),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": F.when(F.instr(text, "\n") > 0, F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]).otherwise(0).cast("long"),
    })
    out = out.drop("text").withColumns({"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long")})
    out = with_repeated_words(out)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _marked(docs: DataFrame, trusted: DataFrame, bits: int | None = None) -> DataFrame:
    """docs with good: 1 if the row's doc_id is trusted, else 0. Ids move, texts hardly.

    Two bit tables settle nearly all rows where they are. An id outside the
    first, of the trusted ids, is not trusted. The second holds the ids of docs
    that the first lets pass and a join of ids alone does not find: an id of
    the first outside the second is trusted. Only rows in both take their text
    through a join. Any size of the tables gives the same marks; `bits` is 16 or
    more for each trusted row, up to 2^26 (8 MB).
    """
    if bits is None:
        bits = 1 << min(26, max(16, (16 * trusted.count()).bit_length()))
    marks = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    own = docs["doc_id"].cast("long")

    def place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    def held(ids: DataFrame, label: str) -> Column:
        """Whether a row of docs is in the bit table of these ids."""
        cells = ids.select(place(F.col(ids.columns[0])).alias("at")).groupBy(F.floor(F.col("at") / 64).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("held"))
        table = common.stored(_dense(cells, "cell", "held", bits // 64, F.lit(0).cast("long")), label).scalar()
        return own.isNotNull() & (F.getbit(F.get(table, F.floor(place(own) / 64).cast("int")), (place(own) % 64).cast("int")) == 1)

    first = held(marks, "trusted")
    second = held(docs.where(first).select(own.alias("passed_id")).join(marks.hint("merge"), F.col("passed_id") == F.col("trusted_id"), "left_anti"), "passed")
    open_rows = docs.where(first & second).join(marks.hint("merge"), own == F.col("trusted_id"), "left")
    settled = docs.where(~first | ~second).select(*docs.columns, first.cast("int").alias("good"))
    return settled.unionByName(open_rows.select(*docs.columns, F.col("trusted_id").isNotNull().cast("int").alias("good")))


def _dense(table: DataFrame, index: str, value: str, size: int, empty: Column) -> DataFrame:
    """A table of at most `size` rows as one row with one array, by index; `size` bounds it, whatever the input."""
    every = table.sparkSession.range(size).join(table, F.col("id") == F.col(index), "left").select("id", F.coalesce(F.col(value), empty).alias("v"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "v"))), lambda x: x["v"]).alias("values"))


def gram_weights(docs: DataFrame, trusted: DataFrame, buckets: int, whole: int | None = None) -> DataFrame:
    """(bucket, weight): log(target / raw) from the words of all documents. At most buckets + 2 whole rows.

    The short form has add-one smoothing. With `whole` words most grams are rare,
    and adding one to both counts would call a gram good that the target never
    had; there the target's count is held against the one expected from the raw
    share, both with the same prior, so that a rare gram weighs next to nothing.
    """

    # each n-gram is counted once, for both counts, where its text is
    words = _marked(docs, trusted).select("good", words_of(F.col("text")).alias("words"))
    each = words.select("good", F.explode_outer(_pairs("words")).alias("p")).where("p is not null")
    each = each.select("good", F.explode_outer(F.array(*_grams("p", buckets, whole))).alias("bucket")).where("bucket is not null")
    counts = common.stored(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target")), "gram-counts")
    totals = counts.agg(F.sum("raw").alias("raw_n"), F.sum("target").alias("target_n")).first()
    raw_n, target_n = totals["raw_n"] or 0, totals["target_n"] or 0
    if whole is not None:
        expected = F.col("raw") * F.lit(target_n / max(1, raw_n))
        return counts.select("bucket", F.log((F.col("target") + _PRIOR) / (expected + _PRIOR)).alias("weight"))
    return counts.select("bucket", (F.log((F.col("target") + 1) / F.lit(float(target_n + buckets))) - F.log((F.col("raw") + 1) / F.lit(float(raw_n + buckets)))).alias("weight"))


def rate(docs: DataFrame, trusted: DataFrame, buckets: int = 8192, threshold: float = -0.15, whole: int | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): the counts, base_failed, ratio (double) and kept.

    trusted names the target's rows by doc_id. kept is false where the base
    rules fail, and otherwise whether ratio >= threshold; with no trusted row
    all ratios follow the raw corpus alone, so no document is refused by them
    (the ratio is 0). Null and blank texts have no words and fail the base
    rules. Whole texts of any length are counted; an empty table gives an empty
    result. Rows that repeat are rated one by one; a null doc_id is carried
    along; columns besides doc_id and text are not looked at. `whole` is the
    number of buckets for whole words and, again, for their pairs; None takes
    endings and their pairs alone. The weights, at most one number a bucket,
    are broadcast; what a text's n-grams weigh is added up where the text is.
    """
    docs = docs.select("doc_id", "text")
    weights = gram_weights(docs, trusted, buckets, whole)
    known = trusted.where("doc_id is not null").limit(1).count() > 0
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    # what fails the base rules needs no ratio: its n-grams are not made. A null pair at the end stands for the row itself
    use = ~F.col("base_failed") & F.lit(known)
    pairs = F.when(use, F.array_append(_pairs("words"), F.lit(None))).otherwise(F.slice(F.array_append(_pairs("words"), F.lit(None)), -1, 1))
    counted = base_counts(docs.withColumn("text_key", F.xxhash64("text"))).select(*keep, "text_key", pairs.alias("pairs"))
    # explode_outer: a plain explode lets the optimizer infer a filter on the array's size, which is pushed below
    # the projections and makes all words anew for every word
    spread = counted.select(*keep, "text_key", F.explode_outer("pairs").alias("p"))
    places = _grams("p", buckets, whole)
    scored = spread.select(*keep, "text_key", F.col("p").isNull().alias("mark"), *[F.when(F.col("p").isNotNull(), g).alias(f"g{k}") for k, g in enumerate(places)])
    for k in range(len(places)):
        table = F.broadcast(weights.select(F.col("bucket").alias("gram"), F.col("weight").alias(f"w{k}")))
        scored = scored.join(table, F.col(f"g{k}") == F.col("gram"), "left").drop("gram", f"g{k}")
    # rows that repeat whole have one sum; the marks say how many rows they are, so no row needs a number of its own
    weight = sum((F.coalesce(F.col(f"w{k}"), F.lit(0.0)) for k in range(1, len(places))), F.coalesce("w0", F.lit(0.0)))
    sums = scored.groupBy(*keep, "text_key").agg(F.sum(weight).alias("total"), F.count_if("mark").alias("rows"))
    # a text of n words has n n-grams of each kind, but one pair less
    grams = (len(places) * F.col("n_words") - 1) * F.col("rows")
    rated = sums.withColumn("ratio", F.when(use, F.coalesce(F.try_divide("total", grams), F.lit(0.0))).otherwise(0.0)).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return rated.select(*keep, "ratio", (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"))
