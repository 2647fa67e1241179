"""The older demonstration image: magnitudes of a two-dimensional FFT, with its corrections in their fixed order.

It is no focused image; coherent backprojection is in `imaging`. Lines are
rows (row, re, im); pixels are rows (row, col, value). Steps along a row are
array expressions; only the turn to columns shuffles.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows
from ..sources import rpf
from . import geo, measure, register, signal


def _each(lines: DataFrame, change) -> DataFrame:
    return lines.withColumns({c: change(F.col(c)) for c in ("re", "im")})


def apply_window(lines: DataFrame, weights: np.ndarray, along: str = "cols", count: int | None = None) -> DataFrame:
    """Lines weighed along their columns, or by their row; weights of another size than `count` change nothing."""
    if count is not None and len(weights) != count:
        return lines
    taps = windows.weights_array(weights)
    if along == "cols":
        return _each(lines, lambda c: F.when(F.size(c) == len(weights), F.zip_with(c, taps, lambda x, w: x * w)).otherwise(c))
    return _each(lines, lambda c: F.transform(c, lambda x: x * F.get(taps, F.col("row"))))


def collapse_rows(lines: DataFrame, factor: int, rows: int) -> DataFrame:
    """Means over whole groups of `factor` neighbouring rows; what is left over goes; a factor of one or less, or beyond the rows, changes nothing."""
    groups = rows // factor if factor > 1 else 0
    if not groups:
        return lines
    spread = lines.where(F.col("row") < groups * factor).select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.posexplode(F.arrays_zip("re", "im")).alias("col", "v"))
    means = spread.groupBy("row", "col").agg((F.sum("v.re") / factor).alias("re"), (F.sum("v.im") / factor).alias("im"))
    packed = means.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "re", "im"))).alias("l"))
    return packed.select("row", F.col("l.re").alias("re"), F.col("l.im").alias("im"))


def centre_pad(lines: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """Lines in the middle of a larger matrix of zeros; rows that come in are generated, nothing is joined."""
    top, left = (height - rows) // 2, (width - cols) // 2
    wide = _each(lines, lambda c: F.concat(F.array_repeat(F.lit(0.0), left), c, F.array_repeat(F.lit(0.0), width - cols - left)))
    wide = wide.select((F.col("row") + top).cast("int").alias("row"), "re", "im")
    none = F.array_repeat(F.lit(0.0), width)
    border = lines.sparkSession.range(height).select(F.col("id").cast("int").alias("row")).where(~F.col("row").between(top, top + rows - 1))
    return wide.unionByName(border.select("row", none.alias("re"), none.alias("im")))


def remove_dc(lines: DataFrame) -> DataFrame:
    """Lines less the complex mean of the whole matrix."""
    sums = lines.agg(*[(F.sum(signal.total(F.col(c))) / F.sum(F.size(c))).alias(f"_{c}") for c in ("re", "im")])
    met = lines.join(F.broadcast(sums))
    return met.select("row", *map(_less, ("re", "im")))


def _less(c: str) -> Column:
    return F.transform(c, lambda x: x - F.col(f"_{c}")).alias(c)


def taper_rows(lines: DataFrame, samples: int, rows: int) -> DataFrame:
    """The raised cosine of `edge_taper`, over the outer rows."""
    n = min(samples, rows // 2)
    if n <= 0:
        return lines
    d = F.least(F.col("row"), F.lit(rows - 1) - F.col("row"))
    weight = F.when(d < n, 0.5 - 0.5 * F.cos(F.pi() * (d + 1) / (n + 1))).otherwise(1.0)
    return _each(lines, lambda c: F.transform(c, lambda x: x * weight))


def crop_magnitude(pixels: DataFrame, rows: int, cols: int, height: int, width: int) -> DataFrame:
    """The middle of complex pixels (row, col, re, im) as magnitudes; no frequency shift."""
    return signal.centre_crop(pixels.select("row", "col", F.hypot("re", "im").alias("value")), rows, cols, height, width)


def row_agc(pixels: DataFrame) -> DataFrame:
    """Pixels over the mean of their row, where that is positive."""
    mean = F.avg("value").over(Window.partitionBy("row"))
    return pixels.withColumn("value", F.when(mean > 0, F.col("value") / mean).otherwise(F.col("value")))


def image_edge_taper(pixels: DataFrame, samples: int, rows: int, cols: int) -> DataFrame:
    """A raised cosine over the outer rows and columns alike; a corner is weighed by both."""
    n = min(samples, min(rows, cols) // 2)
    if n <= 0:
        return pixels

    def weight(at: Column, count: int) -> Column:
        d = F.least(at, F.lit(count - 1) - at)
        return F.when(d < n, 0.5 - 0.5 * F.cos(F.pi() * (d + 1) / (n + 1))).otherwise(1.0)

    return pixels.withColumn("value", F.col("value") * weight(F.col("row"), rows) * weight(F.col("col"), cols))


class Tiles(NamedTuple):
    across: int
    down: int
    width: int
    height: int
    overlap: int


def tile_layout(rows: int, cols: int, across: int, down: int, overlap: int = 0) -> Tiles:
    return Tiles(across, down, math.ceil(cols / across), math.ceil(rows / down), overlap)


def tile_blend(pixels: DataFrame, rows: int, cols: int, layout: Tiles) -> DataFrame:
    """Tiles weighed down towards their edges, added up and divided by the weights.

    Tiles that reach `overlap` pixels into each other (layout.overlap) are
    dealt out and blended; as all tiles are cut from one image, each pixel gets
    its own value back, with the number of tiles that held it.
    """

    def reach(at: Column, size: int, count: int) -> Column:
        own = F.floor(at / size).cast("int")
        near = F.filter(F.array(own - 1, own, own + 1), lambda t: (t >= 0) & (t < count) & (at >= t * size - layout.overlap) & (at < (t + 1) * size + layout.overlap))
        return F.explode(near)

    def weight(at: Column, tile: Column, size: int, total: int) -> Column:
        low, high = F.greatest(F.lit(0), tile * size - layout.overlap), F.least(F.lit(total), (tile + 1) * size + layout.overlap) - 1
        ramp = lambda d: F.when(d < layout.overlap, 0.5 - 0.5 * F.cos(F.pi() * (d + 1) / (layout.overlap + 1))).otherwise(1.0)
        return ramp(at - low) * ramp(high - at)

    each = pixels.withColumn("ty", reach(F.col("row"), layout.height, layout.down)).withColumn("tx", reach(F.col("col"), layout.width, layout.across))
    w = weight(F.col("row"), F.col("ty"), layout.height, rows) * weight(F.col("col"), F.col("tx"), layout.width, cols)
    return each.withColumn("w", w).groupBy("row", "col").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"), F.count("*").alias("tiles"))


def input_slice(lines: DataFrame, first: int = 1, most: int = 0) -> DataFrame:
    """Stream lines (line, pixels) from a first line on, at most `most` (0: all), as (row, re, im); a gap or a value that is not finite is an error.

    The first line is at least the stream's own first.
    """
    start = lines.agg(F.greatest(F.min("line"), F.lit(first)).alias("_start"))
    cut = lines.join(F.broadcast(start)).where((F.col("line") >= F.col("_start")) & ((F.col("line") < F.col("_start") + most) if most > 0 else F.lit(True)))
    ends = cut.agg(F.count("*").alias("_n"), (F.max("line") - F.min("line") + 1).alias("_span"))
    bad = F.exists("pixels", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | (F.col("_n") != F.col("_span"))
    re = F.when(bad, F.raise_error(F.lit("a line is missing, repeated or not finite"))).otherwise(signal.doubles(F.col("pixels")))
    return cut.join(F.broadcast(ends)).select((F.col("line") - F.col("_start")).cast("int").alias("row"), re.alias("re"), F.transform("pixels", lambda x: F.lit(0.0)).alias("im"))


def stream_input(catalog: DataFrame, number: int = 0, first: int = 1, most: int = 0) -> DataFrame:
    """The lines of the acquisition that a number asks for (0: the first), cut to a slice; only their bytes are read."""
    blocks = geo.line_stream(catalog, geo.matching_blocks(catalog, number))
    lines = rpf.lines(blocks, first=first)
    return input_slice(lines.select("line", "pixels"), first, most)


class Settings(NamedTuple):
    """Steps of the older image; each value that is 0 or False leaves its step out."""

    collapse_cols: int = 1
    collapse_rows: int = 1
    pad_cols: int = 0
    pad_rows: int = 0
    stc: bool = False
    range_taper: int = 0
    azimuth_taper: int = 0
    range_coefficient: float = 0.54
    azimuth_coefficient: float = 0.54
    broadening: float = 1.0
    scaling: str = ""
    agc: bool = False
    edge_taper: int = 0


def demonstration_image(lines: DataFrame, rows: int, cols: int, s: Settings = Settings()) -> tuple[DataFrame, int, int]:
    """The image (row, col, value) of lines (row, re, im), with its rows and columns.

    Collapse, pad, remove the mean, ramp, taper, weigh, transform rows and
    columns, crop to magnitudes, even out rows, taper the edges.
    """
    if s.collapse_cols > 1 and cols // s.collapse_cols:
        lines, cols = _each(lines, lambda c: signal.collapse(c, s.collapse_cols, cols)), cols // s.collapse_cols
    if s.collapse_rows > 1 and rows // s.collapse_rows:
        lines, rows = collapse_rows(lines, s.collapse_rows, rows), rows // s.collapse_rows
    height, width = rows + 2 * s.pad_rows, cols + s.pad_cols
    if (height, width) != (rows, cols):
        lines = centre_pad(lines, rows, cols, height, width)
    lines = remove_dc(lines)
    if s.stc:
        lines = _each(lines, lambda c: signal.stc_ramp(c, width))
    lines = taper_rows(_each(lines, lambda c: signal.edge_taper(c, s.range_taper, width)), s.azimuth_taper, height)
    weights = [windows.shaped(windows.hamming(n, c), s.broadening, s.scaling) for n, c in ((width, s.range_coefficient), (height, s.azimuth_coefficient))]
    lines = apply_window(apply_window(lines, weights[0], "cols", width), weights[1], "rows", height)
    both = signal.transpose(signal.fft_lines(signal.transpose(signal.fft_lines(lines.select("row", "re", "im")))))
    pixels = both.select("row", F.posexplode(F.arrays_zip("re", "im")).alias("col", "v")).select("row", "col", F.col("v.re").alias("re"), F.col("v.im").alias("im"))
    image = crop_magnitude(pixels, height, width, rows, cols)
    if s.agc:
        image = row_agc(image)
    return image_edge_taper(image, s.edge_taper, rows, cols), rows, cols


def frame_measures(frames: DataFrame, rows: int, cols: int, stream: str, order: str, line: str = "line") -> DataFrame:
    """Registration and focus of magnitude frames (arrays, row by row): shifts, cumulative shifts, focus metric, delta and is_best."""
    centred = frames.select(stream, order, line, register.centroid(F.col(line), rows, cols).alias("c")).select(stream, order, "c.*", measure.focus_metric(F.col(line), rows, cols).alias("focus"))
    moved = register.register(centred, stream, order)
    return measure.running_best(moved, stream, order, "focus")


def chip_report(spark, chip: DataFrame, config) -> dict:
    """The analysis of one chip (row, col, value) as a nested report; see configs.Analysis for what it is told."""
    rows, cols = chip.agg(F.max("row") + 1, F.max("col") + 1).first()
    if rows is None:
        raise ValueError("the chip has no data")
    line = chip.groupBy("col").agg(F.sum("value").alias("v")) if rows > 1 and cols > 1 else chip.select((F.col("row") + F.col("col")).alias("col"), F.col("value").alias("v"))
    count = cols if cols > 1 else rows
    line = line.agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "v"))), lambda x: x["v"]).alias("line"))
    options = {"factor": max(1, config.mag_factor), "size": config.fft_size, "most": config.max_peaks, "separation": config.min_separation}

    def found(df: DataFrame) -> dict:
        r = df.first()
        return {"stats": r["stats"].asDict(), "peaks": [p.asDict() for p in r["peaks"]]}

    report = {"chip": {"rows": rows, "cols": cols}, "pta": found(measure.zoom_analysis(line, "line", count, **options))}
    if config.analyze2_d:
        both = measure.pta_stats_2d(chip, rows, cols).first()
        report["pta2d"] = {n: both[n].asDict() for n in ("x", "y")}
    if config.histogram_bins > 0:
        counts = dict(map(tuple, measure.histogram(chip, "value", config.histogram_bins).collect()))
        report["histogram"] = [counts.get(k, 0) for k in range(config.histogram_bins)]
    if config.use_iqa or config.use_iqa2_d or config.power_detection or config.side_lobe_method:
        report["iqa"] = found(measure.image_quality(line, "line", count, detection=config.power_detection, **options)) | {"powerDetection": config.power_detection, "sideLobeMethod": config.side_lobe_method, "zpAlpha": config.zp_alpha}
        if config.use_iqa2_d:
            both = measure.image_quality_2d(chip, rows, cols, detection=config.power_detection).first()
            report["iqa"]["image"] = {n: both[n].asDict() for n in ("x", "y")}
    return report
