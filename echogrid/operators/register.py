"""Frame registration by centroids, and integer shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measure import running


def centroid(line: Column, rows: int, cols: int) -> Column:
    """struct(total, cx, cy) of a frame stored row by row, weighted by magnitude."""
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    places = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    sums = F.aggregate(F.zip_with(line, places, lambda v, i: F.struct(F.abs(v).alias("w"), i.alias("i"))), zero, lambda a, e: F.struct((a["t"] + e["w"]).alias("t"), (a["x"] + e["w"] * (e["i"] % cols)).alias("x"), (a["y"] + e["w"] * F.floor(e["i"] / cols)).alias("y")))
    return F.struct(sums["t"].alias("total"), F.try_divide(sums["x"], sums["t"]).alias("cx"), F.try_divide(sums["y"], sums["t"]).alias("cy"))


def register(frames: DataFrame, stream: str, order: str) -> DataFrame:
    """Adds dx, dy, metric, cum_dx, cum_dy to frames (total, cx, cy): shifts against the first frame with energy of its stream.

    Frames without energy, and the reference itself, do not move. Shifts are
    rounded half away from zero. The reference is one aggregate row a stream.
    """
    lit = F.col("total") > 0
    ref = frames.where(lit).groupBy(F.col(stream).alias("_of")).agg(F.min_by(F.struct("cx", "cy"), order).alias("_ref"))
    out = frames.join(ref, F.col(stream).eqNullSafe(F.col("_of")), "left")
    ddx, ddy = F.col("cx") - F.col("_ref.cx"), F.col("cy") - F.col("_ref.cy")
    moves = {"dx": F.when(lit, F.round(-ddx)).otherwise(0).cast("int"), "dy": F.when(lit, F.round(-ddy)).otherwise(0).cast("int"), "metric": F.when(lit, F.hypot(ddx, ddy)).otherwise(0.0)}
    out = out.select(*frames.columns, *[c.alias(n) for n, c in moves.items()])
    return running(out, stream, order, cum_dx=("sum", "dx", True), cum_dy=("sum", "dy", True))


def shift(pixels: DataFrame, dx: int, dy: int, rows: int, cols: int) -> DataFrame:
    """An image (row, col, value) moved by whole pixels; what comes in, or has no pixel, is zero.

    Zeros for all pixels are generated and appended, and each pixel's values
    added up: one shuffle with partial sums, no join.
    """
    moved = pixels.select((F.col("row") + dy).cast("int").alias("row"), (F.col("col") + dx).cast("int").alias("col"), "value").where(f"row between 0 and {rows - 1} and col between 0 and {cols - 1}")
    every = pixels.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return moved.unionByName(every.withColumn("value", F.lit(0.0))).groupBy("row", "col").agg(F.sum("value").alias("value"))
