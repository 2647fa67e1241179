"""Automatic point targets: strongest pixels, one after another, with their surroundings set aside."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .measure import pta_stats_2d


class Target(NamedTuple):
    row: int
    col: int
    value: float
    valid: bool


def strongest_targets(pixels: DataFrame, rows: int, cols: int, most: int, chip: int = 3, threshold: float = 0.5) -> list[Target]:
    """At most `most` targets of an image (row, col, value): each round takes the highest pixel that is left.

    A target below threshold times the first one ends the search. The chip of
    chip x chip pixels around a target is left out afterwards; a chip that the
    image's edge cuts makes the target invalid but counts. Of equals the first
    by row and column wins. Each round is one distributed aggregate that
    returns one row.
    """
    half, left, out = chip // 2, pixels.where("value is not null"), []
    best = F.max(F.struct("value", (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))
    for _ in range(most):
        top = left.agg(best.alias("top")).first()["top"]
        if top is None or (out and top["value"] < threshold * out[0].value):
            break
        row, col = -top["r"], -top["c"]
        inside = half <= row < rows - half and half <= col < cols - half
        out.append(Target(row, col, float(top["value"]), inside))
        left = left.where((F.abs(F.col("row") - row) > half) | (F.abs(F.col("col") - col) > half))
    return out


def target_statistics(pixels: DataFrame, found: list[Target], chip: int = 3) -> DataFrame:
    """(nth, row, col, value, valid, x, y): peak statistics by column and by row of each valid target's chip.

    The targets, a short list, travel as a literal. A pixel that an earlier
    target's chip has set aside counts as zero in a later one.
    """
    spark, half = pixels.sparkSession, chip // 2
    listed = spark.createDataFrame([(k, *t) for k, t in enumerate(found)], "nth int, row int, col int, value double, valid boolean")
    if not found:
        return listed.select("*", *[F.lit(None).alias(c) for c in "xy"])
    places = F.lit([[k, t.row, t.col] for k, t in enumerate(found)])
    near = F.filter(places, lambda t: (F.abs(F.col("row") - t[1]) <= half) & (F.abs(F.col("col") - t[2]) <= half))
    held = pixels.select("row", "col", "value", near.alias("near")).where(F.size("near") > 0).select("row", "col", "value", F.posexplode("near").alias("order", "t"))
    cut = held.select(F.col("t")[0].alias("nth"), (F.col("row") - F.col("t")[1] + half).alias("row"), (F.col("col") - F.col("t")[2] + half).alias("col"), F.when(F.col("order") == 0, F.col("value")).otherwise(0.0).alias("value"))
    stats = pta_stats_2d(cut, chip, chip, "nth").withColumnRenamed("nth", "of")
    valid = F.col("valid")
    return listed.join(stats, F.col("nth") == F.col("of"), "left").select(*listed.columns, F.when(valid, F.col("x")).alias("x"), F.when(valid, F.col("y")).alias("y"))


def chip_around(pixels: DataFrame, row: int, col: int, size: int) -> DataFrame:
    """The size x size pixels around a place, with rows and columns counted from the chip's corner; what lies outside the image is left out."""
    half = size // 2
    near = F.col("row").between(row - half, row - half + size - 1) & F.col("col").between(col - half, col - half + size - 1)
    return pixels.where(near).withColumns({"row": F.col("row") - (row - half), "col": F.col("col") - (col - half)})


def centre_chip(pixels: DataFrame, rows: int, cols: int, size: int) -> DataFrame:
    """The middle of an image, at most as large as the image."""
    height, width = min(size, rows), min(size, cols)
    top, left = (rows - height) // 2, (cols - width) // 2
    inside = F.col("row").between(top, top + height - 1) & F.col("col").between(left, left + width - 1)
    return pixels.where(inside).withColumns({"row": F.col("row") - top, "col": F.col("col") - left})
