"""Previews: decibel and phase grays, reductions, colour maps, panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knots of the colour maps (red, green, blue), evenly spaced over the levels.
MAPS = {
    "gray": [(0, 0, 0), (255, 255, 255)],
    "inverted": [(255, 255, 255), (0, 0, 0)],
    "hot": [(0, 0, 0), (255, 0, 0), (255, 255, 0), (255, 255, 255)],
    "turbo": [(48, 18, 59), (50, 126, 184), (179, 221, 55), (250, 174, 34), (122, 4, 2)],
}


def _unit(share: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def gray_db(value: Column, peak: Column, dynamic_range: float = 60.0) -> Column:
    """0 to 255 by decibels under the peak, rounded; zero, NaN and null are black."""
    db = 20 * F.log10(value) - 20 * F.log10(peak)
    return F.when((peak > 0) & (value > 0) & ~F.isnan(value), F.round(_unit(1 + db / dynamic_range) * 255)).otherwise(0.0).cast("int")


def level_db(value: Column, peak: Column, dynamic_range: float = 50.0) -> Column:
    """0 to 255 by decibels under the peak, cut off below: values count as a millionth of the peak at least."""
    share = value / F.when(peak > 0, peak).otherwise(1.0)
    db = 20 * F.log10(F.greatest(share, F.lit(1e-6)))
    return F.floor(255 * _unit((db + dynamic_range) / dynamic_range)).cast("int")


def gray_phase(phase: Column) -> Column:
    """-pi to pi as 0 to 255, rounded; NaN and null stay without a value."""
    return F.when(~F.isnan(phase), F.round((phase + F.pi()) / (2 * F.pi()) * 255)).cast("int")


def gray_linear(value: Column, low: Column, high: Column) -> Column:
    share = F.try_divide(value - low, high - low)
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(F.floor(_unit(F.coalesce(share, F.lit(0.0))) * 255 + 0.5)).cast("int")


def box_power(pixels: DataFrame, factor: int) -> DataFrame:
    """Boxes of factor x factor pixels as the root of their mean power."""
    return pixels.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("value"))


def reduced_shape(rows: int, cols: int, most: int, whole: bool = False, aspect: bool = True) -> tuple[int, int]:
    """The size of a preview of at most `most` pixels a side: rounded, or cut to whole numbers; without `aspect` each side by itself."""
    if not aspect:
        return min(rows, most), min(cols, most)
    scale = min(1.0, most / max(rows, cols))
    cut = int if whole else lambda x: int(x + 0.5)
    return max(1, cut(rows * scale)), max(1, cut(cols * scale))


def _cell(at: Column, n: int, cells: int) -> Column:
    """Which of `cells` cells, whose edges are floor(k * n / cells), a place falls into."""
    return F.floor(((at + 1) * cells - 1) / n).cast("int")


def reduced(pixels: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """An image as height x width cells, each the root of the mean power of its valid pixels; NaN where there is none."""
    power = F.avg(F.when(~F.isnan("value"), F.col("value").cast("double") * F.col("value")))
    return pixels.groupBy(_cell(F.col("row"), rows, height).alias("row"), _cell(F.col("col"), cols, width).alias("col")).agg(F.coalesce(F.sqrt(power), F.lit(float("nan"))).alias("value"))


def centre_phase(pixels: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """The phase of each cell's middle pixel (row, col, re, im); NaN where that has no amplitude. A filter, no shuffle."""

    def middle(at: Column, n: int, cells: int) -> Column:
        k = _cell(at, n, cells)
        return at == F.floor((F.floor(k * n / cells) + F.floor((k + 1) * n / cells) - 1) / 2)

    chosen = pixels.where(middle(F.col("row"), rows, height) & middle(F.col("col"), cols, width))
    phase = F.when((F.col("re") != 0) | (F.col("im") != 0), F.atan2("im", "re")).otherwise(float("nan"))
    return chosen.select(_cell(F.col("row"), rows, height).alias("row"), _cell(F.col("col"), cols, width).alias("col"), phase.alias("value"))


def nearest(pixels: DataFrame, rows: int, cols: int, out_rows: int, out_cols: int) -> DataFrame:
    """The pixels at floor(i * rows / out_rows), floor(j * cols / out_cols): a filter, no join. The output is not larger than the input.

    All in whole numbers: the first i whose place is not before a row is
    ceil(row * out_rows / rows), and it counts if its place is that row.
    """
    out_rows, out_cols = max(1, min(rows, out_rows)), max(1, min(cols, out_cols))

    def place(at: str, size: int, out: int) -> tuple[Column, Column]:
        first = F.expr(f"(`{at}` * {out}L + {size - 1}L) div {size}L")
        return first.cast("int"), (first < out) & (F.expr(f"((`{at}` * {out}L + {size - 1}L) div {size}L) * {size}L div {out}L") == F.col(at))

    (r, in_row), (c, in_col) = place("row", rows, out_rows), place("col", cols, out_cols)
    return pixels.where(in_row & in_col).select(r.alias("row"), c.alias("col"), "value")


def datagram_shape(rows: int, cols: int, most_bytes: int = 65507 - 16) -> tuple[int, int]:
    """The size to which a frame of floats shrinks, keeping its sides' ratio, to fit one datagram."""
    most = most_bytes // 4
    if rows * cols <= most:
        return rows, cols
    scale = (most / (rows * cols)) ** 0.5
    height, width = max(1, int(rows * scale)), max(1, int(cols * scale))
    # a side that cannot shrink below one pixel leaves the other the rest
    return min(height, most // width) if width == 1 else height, min(width, most // height) if height == 1 else width


def datagram_frame(pixels: DataFrame, rows: int, cols: int, most_bytes: int = 65507 - 16) -> tuple[DataFrame, int, int]:
    """A frame (row, col, value) shrunk to its nearest pixels so that it fits one datagram, with its new size."""
    height, width = datagram_shape(rows, cols, most_bytes)
    return (pixels if (height, width) == (rows, cols) else nearest(pixels, rows, cols, height, width)), height, width


def coloured(level: Column, name: str = "turbo") -> Column:
    """struct(red, green, blue, alpha) of a level from 0 to 1, linear between the map's knots; NaN and null are transparent."""
    knots = MAPS[name]
    t = _unit(level) * (len(knots) - 1)
    k = F.least(F.floor(t).cast("int"), F.lit(len(knots) - 2))
    parts = [F.round(F.get(F.lit([p[i] for p in knots]), k) * (1 - (t - k)) + F.get(F.lit([p[i] for p in knots]), k + 1) * (t - k)).cast("int") for i in range(3)]
    seen = level.isNotNull() & ~F.isnan(level)
    return F.struct(*[F.when(seen, p).otherwise(0).alias(n) for n, p in zip(("red", "green", "blue"), parts, strict=True)], F.when(seen, 255).otherwise(0).alias("alpha"))


def turbo(level: Column) -> list[Column]:
    """Red, green and blue of a level from 0 to 1."""
    return [coloured(level)[n] for n in ("red", "green", "blue")]


def panels(stages: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """(panel, stage, reason): for each panel the first of its wanted stages that is available; without one, why the first is not.

    stages has stage, available and reason, a few rows; wanted names each panel's stages in order.
    """
    spark = stages.sparkSession
    order = spark.createDataFrame([(p, k, s) for p, names in wanted.items() for k, s in enumerate(names)], "panel string, nth int, wanted string")
    met = order.join(F.broadcast(stages), F.col("wanted") == F.col("stage"), "left")
    ok = F.coalesce("available", F.lit(False))
    best = met.groupBy("panel").agg(F.min_by(F.when(ok, F.col("wanted")), F.when(ok, F.col("nth"))).alias("stage"), F.min_by(F.coalesce("reason", F.lit("not made")), "nth").alias("why"))
    return best.select("panel", "stage", F.when(F.col("stage").isNull(), F.col("why")).alias("reason"))


#: Which stages a data set of each kind can show, and why the others are missing.
STAGE_POLICY = {
    "phase_history": {"raw_echo": "the source holds frequency samples, no raw echoes", "range_profiles": None, "complex_image": None, "geocoded": "the scene has no geographic origin"},
    "raw_echo": {"raw_echo": None, "range_profiles": None, "complex_image": None, "geocoded": "the scene has no geographic origin"},
    "focused_image": {"raw_echo": "the source is a focused image", "range_profiles": "the source is a focused image", "complex_image": None, "geocoded": None},
}


def stage_policy(sets: DataFrame) -> DataFrame:
    """(data_set, stage, available, reason) of data sets (data_set, kind, has_origin) by the policy of their kind."""
    rows = [(k, s, r) for k, stages in STAGE_POLICY.items() for s, r in stages.items()]
    policy = sets.sparkSession.createDataFrame(rows, "kind string, stage string, reason string")
    open_ = (F.col("stage") == "geocoded") & F.col("has_origin") & F.col("reason").isNotNull()
    met = sets.join(F.broadcast(policy), "kind").withColumn("reason", F.when(~open_, F.col("reason")))
    return met.select("data_set", "stage", F.col("reason").isNull().alias("available"), "reason")
