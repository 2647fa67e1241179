"""The corpus pipeline: stages that each write Parquet for the next.

Every stage works on all rows that its predecessor kept, and what it decides
takes effect: documents without a trusted language go, repeated lines go from
the texts, one document of each group of near copies stays, documents that hold
a benchmark item go, and what is left is turned into piece ids. All stages but
the last return the columns of documents. Nulls, empty tables and repeated rows
have the results that the operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.llm import common, decontamination, jaccard_join, language_id, line_dedup, piece_tokens

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A prediction below this score is no trusted language. The four languages' own texts score far above.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language is `und`, is hardly told from others, or whose text is unlike all that was learned of it.

    Null and empty texts are `und` and go. Whole texts count, very long ones
    too; rows that repeat go or stay together; columns with other names, the
    operator's own among them, pass through; an empty table stays empty.
    """
    pred, score, excess = (common.free_name(docs, x) for x in ("lang_pred", "lang_score", "lang_excess"))
    found = language_id.identify(docs, language_id.fit(language_id.learnable(docs)), pred, score, excess)
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE) & (F.col(excess) >= 0)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay in one of them; n_chars follows the text.

    A null text becomes the empty one; a row without doc_id keeps its text;
    rows of one doc_id are one document. Whole texts of any length are read, and
    ties go to the largest doc_id. Other columns pass through; an empty table
    stays empty.
    """
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8 or more.

    The smallest doc_id of a group stays; texts without words and rows without
    doc_id all stay; of rows that repeat one stays. Whole texts of any length
    are compared; other columns pass through; an empty table stays empty.
    """
    return jaccard_join.one_of_each(docs, width=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go.

    Each row is judged by its own whole text, whatever its length or doc_id;
    rows without text stay, rows that repeat go or stay together, other columns
    pass through; an empty table stays empty.
    """
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether decoding the ids gives the text back.

    Null and empty texts have no tokens; whole texts of any length are encoded;
    rows that repeat stay rows of their own; an empty table stays empty.
    """
    coded = piece_tokens.encode(docs.select("doc_id", "lang", "source", "text"), decoded="decoded")
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit(""))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_copy),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", to_pieces),
]

#: Language identification and piece encoding have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each result is written to the shared folder and reread."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
