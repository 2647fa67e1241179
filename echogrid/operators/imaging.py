"""Image formation: pixel grids, coherent backprojection, direct frequency sums."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, windows
from .signal import C, aperture_weights, interpolate, let, total

_PIXEL = "row int, col int, re double, im double"


class Grid(NamedTuple):
    """Evenly spaced axes (first, last, count) at one height; rows follow y. Six numbers and a height, whatever its size."""

    x: tuple[float, float, int]
    y: tuple[float, float, int]
    z: float = 0.0

    def checked(self) -> Grid:
        if any(n < 2 or b <= a for a, b, n in (self.x, self.y)):
            raise ValueError("axes must rise and have two points or more")
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        """(row, col, x, y, z) of all pixels."""
        (x0, x1, nx), (y0, y1, ny), z = self.checked()
        row, col = F.floor(F.col("id") / nx).cast("int"), (F.col("id") % nx).cast("int")
        return spark.range(nx * ny).select(row.alias("row"), col.alias("col"), (F.lit(x0) + col * ((x1 - x0) / (nx - 1))).alias("x"), (F.lit(y0) + row * ((y1 - y0) / (ny - 1))).alias("y"), F.lit(float(z)).alias("z"))

    def tiles(self, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, col, x, y, z) of runs of at most `most` pixels."""
        (x0, x1, nx), (y0, y1, ny), z = self
        for a in range(0, nx * ny, most):
            row, col = np.divmod(np.arange(a, min(nx * ny, a + most)), nx)
            yield row.astype(np.int32), col.astype(np.int32), x0 + col * ((x1 - x0) / (nx - 1)), y0 + row * ((y1 - y0) / (ny - 1)), np.full(len(row), float(z))


def pixel_grid(spark: SparkSession, x: tuple[float, float, int], y: tuple[float, float, int], z: float = 0.0) -> DataFrame:
    """(row, col, x, y, z) of evenly spaced axes (first, last, count); row follows y."""
    return Grid(x, y, z).frame(spark)


class _Kernel(NamedTuple):
    """How one pulse adds to some pixels."""

    start: float
    step: float
    wave: float
    method: str
    half_width: int

    def add(self, image: np.ndarray, at: tuple[np.ndarray, ...], profile: np.ndarray, px: float, py: float, pz: float, r0: float, weight: float) -> None:
        x, y, z = at
        delta = np.sqrt((x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2) - r0
        value = interpolate(profile, (delta - self.start) / self.step, self.method, self.half_width)
        angle = self.wave * delta
        turn = np.empty(len(x), complex)
        turn.real, turn.imag = np.cos(angle), np.sin(angle)
        image += weight * value * turn


def _kernel(meta: dict[str, float], method: str, half_width: int) -> _Kernel:
    return _Kernel(meta["range_start_m"], meta["range_step_m"], 4 * np.pi * meta["carrier_hz"] / C, method, half_width)


def _profiles(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(profile, x, y, z, r0, weight) of each row of (re, im, x, y, z, r0, weight)."""
    (re, at), (im, _) = lines.offsets(batch.column(0)), lines.offsets(batch.column(1))
    rest = [batch.column(k).to_numpy(zero_copy_only=False).tolist() for k in range(2, 7)]
    for a, b, *place in zip(at[:-1].tolist(), at[1:].tolist(), *rest, strict=True):
        profile = np.empty(b - a, complex)
        profile.real, profile.imag = re[a:b], im[a:b]
        yield profile, *place


def _pixels(row: np.ndarray, col: np.ndarray, image: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, col, image.real, image.imag)], ["row", "col", "re", "im"])


def _weighted(profiles: DataFrame, window: str) -> DataFrame:
    """The columns that a sum needs; profiles that came without weights get them here."""
    full = profiles if "weight" in profiles.columns else aperture_weights(profiles, window)
    return full.select("re", "im", "x", "y", "z", "r0", "weight")


def backproject(grid: Grid, profiles: DataFrame, meta: dict[str, float], window: str = "hann", method: str = "linear", half_width: int = 8, tile: int = 65_536, held: int = 4_194_304) -> DataFrame:
    """Complex image (row, col, re, im) of a grid from range profiles (pulse, re, im, x, y, z, r0, weight).

    Profiles stay where they are. Each task makes the pixels' places from the
    grid's axes, tile by tile, and sums its own pulses; the sums meet in one
    shuffle by pixel. A task hands over what it has summed when that reaches
    `held` pixels, so memory is bounded for a grid of any size. Where profiles
    have no weight column, the aperture's weights are found first.
    """
    grid.checked()
    kernel = _kernel(meta, method, half_width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small, sums = grid.x[2] * grid.y[2] <= held, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            pulses = list(_profiles(batch))
            for k, (row, col, *at) in enumerate(grid.tiles(tile)):
                image = sums.setdefault(k, np.zeros(len(row), complex)) if small else np.zeros(len(row), complex)
                for pulse in pulses:
                    kernel.add(image, at, *pulse)
                if not small:
                    yield _pixels(row, col, image)
        if sums:
            for k, (row, col, *_) in enumerate(grid.tiles(tile)):
                yield _pixels(row, col, sums[k])

    return _weighted(profiles, window).mapInArrow(partial, _PIXEL).groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def backproject_points(points: DataFrame, profiles: DataFrame, meta: dict[str, float], window: str = "hann", method: str = "linear", half_width: int = 8, point_parts: int = 1, pulse_parts: int = 8) -> DataFrame:
    """The same sum at any points (row, col, x, y, z), such as pixels on a surface.

    Points and pulses are dealt into parts by hash, and each pair of parts is
    one task's work: a point travels to pulse_parts tasks, a profile to
    point_parts. Choose the parts so that a pair fits a task's memory.
    """
    kernel = _kernel(meta, method, half_width)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = points.select(F.pmod(F.hash("row", "col"), F.lit(point_parts)).alias("p"), every(pulse_parts).alias("q"), "row", "col", "x", "y", "z")
    seen = _weighted(profiles, window)
    seen = seen.select("re", "im", "x", "y", "z", "r0", "weight", F.pmod(F.hash("x", "y", "z", "r0"), F.lit(pulse_parts)).alias("q"), every(point_parts).alias("p"))

    def form(at: pa.Table, pulses: pa.Table) -> pa.Table:
        row, col, *places = (at.column(c).to_numpy() for c in ("row", "col", "x", "y", "z"))
        image = np.zeros(len(row), complex)
        for batch in pulses.to_batches() if len(row) else ():
            for pulse in _profiles(batch):
                kernel.add(image, tuple(places), *pulse)
        return pa.Table.from_batches([_pixels(row.astype(np.int32), col.astype(np.int32), image)])

    parts = asked.groupBy("p", "q").cogroup(seen.groupBy("p", "q")).applyInArrow(form, _PIXEL)
    return parts.groupBy("row", "col").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def backproject_sums(pulses: DataFrame, points: list[tuple[float, float, float]], line: str, count: int, start: float, step: float, wave: float) -> DataFrame:
    """(point, re, im): sums over all pulses (x, y, z, r0, line) of real lines, for a short list of points.

    Each pulse meets every point by an array literal, without a join; sums are
    formed before the shuffle, which moves one row for each point and task.
    """
    listed = F.lit([[float(c) for c in p] for p in points])
    spread = pulses.select("x", "y", "z", "r0", F.col(line).alias("line"), F.posexplode(listed).alias("point", "at"))
    delta = F.sqrt(sum((F.col(c) - F.col("at")[i]) ** 2 for i, c in enumerate("xyz"))) - F.col("r0")
    spread = spread.withColumn("delta", delta).withColumn("index", (F.col("delta") - start) / step)
    low = F.least(F.floor("index").cast("int"), F.lit(count - 2))
    value = F.get("line", low) * (1 - (F.col("index") - low)) + F.get("line", low + 1) * (F.col("index") - low)
    value = F.when((F.col("index") >= 0) & (F.col("index") <= count - 1), value)
    return spread.groupBy("point").agg(F.sum(value * F.cos(wave * F.col("delta"))).alias("re"), F.sum(value * F.sin(wave * F.col("delta"))).alias("im"), F.count(value).alias("n"))


def direct_sums(pulses: DataFrame, points: list[tuple[float, float, float]], line: str, first: float, step: float, count: int) -> DataFrame:
    """(point, re, im): sums over pulses and frequencies of real samples, phase first + k * step radians a metre."""
    listed = F.lit([[float(c) for c in p] for p in points])
    spread = pulses.select("x", "y", "z", "r0", F.col(line).alias("line"), F.posexplode(listed).alias("point", "at"))
    delta = F.sqrt(sum((F.col(c) - F.col("at")[i]) ** 2 for i, c in enumerate("xyz"))) - F.col("r0")
    spread = spread.withColumn("delta", delta)
    k = F.sequence(F.lit(0), F.lit(count - 1))

    def part(f: Column) -> Column:
        return total(F.zip_with("line", k, lambda v, i: v * f((first + step * i) * F.col("delta"))))

    return spread.groupBy("point").agg(F.sum(part(F.cos)).alias("re"), F.sum(part(F.sin)).alias("im"))


def frequency_sums(pulses: DataFrame, points: DataFrame, frequency: np.ndarray, window: str = "hann", azimuth_window: str = "hann") -> DataFrame:
    """(row, col, re, im) at a short list of points: the sum over all pulses and frequencies, without any transform.

    The points travel as one row to the pulses; what is summed within a pulse
    stays an array expression, and one row for each point and task is shuffled.
    """
    taper = windows.window(len(frequency), window)
    axis = F.lit([float(f) * 4 * np.pi / C for f in frequency])
    share = F.lit([float(w) / float(taper.sum()) for w in taper])
    listed = points.agg(F.collect_list(F.struct("row", "col", "x", "y", "z")).alias("_points"))
    seen = pulses if "weight" in pulses.columns else aperture_weights(pulses, azimuth_window)
    each = seen.join(F.broadcast(listed)).select("re", "im", "weight", "r0", *[F.col(c).alias(f"p{c}") for c in "xyz"], F.explode("_points").alias("at"))
    delta = F.sqrt(sum((F.col(f"at.{c}") - F.col(f"p{c}")) ** 2 for c in "xyz")) - F.col("r0")
    each = each.withColumn("delta", delta).withColumn("angles", F.transform(axis, lambda f: f * F.col("delta")))
    both = F.zip_with(F.arrays_zip("re", "im"), F.arrays_zip(F.col("angles").alias("a"), share.alias("w")), lambda v, t: F.struct(((v["re"] * F.cos(t["a"]) - v["im"] * F.sin(t["a"])) * t["w"]).alias("re"), ((v["re"] * F.sin(t["a"]) + v["im"] * F.cos(t["a"])) * t["w"]).alias("im")))
    each = each.select("at.row", "at.col", "weight", both.alias("turned"))
    return each.groupBy("row", "col").agg(*[F.sum(F.col("weight") * total(F.col("turned")[c])).alias(c) for c in ("re", "im")])


def self_check(image: DataFrame, grid: Grid, pulses: DataFrame, frequency: np.ndarray, window: str = "hann", azimuth_window: str = "hann", most: float = 0.01) -> float:
    """Relative error of the image against the direct sum on a 5 x 5 lattice and its 25 strongest pixels; beyond `most` an error."""
    if not image.agg(F.bool_or((F.col("re") != 0) | (F.col("im") != 0))).first()[0]:
        raise ValueError("the image has no signal")
    on = [F.col(c).isin([round(k * (axis[2] - 1) / 4) for k in range(5)]) for c, axis in (("row", grid.y), ("col", grid.x))]
    strongest = image.orderBy(F.desc(F.hypot("re", "im")), "row", "col").limit(25)
    chosen = image.where(on[0] & on[1]).unionByName(strongest).distinct()
    points = grid.frame(image.sparkSession).join(F.broadcast(chosen.select("row", "col")), ["row", "col"])
    truth = frequency_sums(pulses, points, frequency, window, azimuth_window).withColumnsRenamed({"re": "true_re", "im": "true_im"})
    off = (F.col("re") - F.col("true_re")) ** 2 + (F.col("im") - F.col("true_im")) ** 2
    error = chosen.join(truth, ["row", "col"]).agg(F.sqrt(F.sum(off) / F.sum(F.col("true_re") ** 2 + F.col("true_im") ** 2))).first()[0]
    if not error <= most:
        raise ValueError(f"the image differs from the direct sum by {error}")
    return error


def point_echoes(targets: DataFrame, pulses: int, spacing_m: float, samples: int, step_m: float, wave: float, phase_sign: int = 1) -> DataFrame:
    """(pulse, sample, re, im) of point targets (x, y, rcs) seen by a platform that moves along y.

    A target's range falls between two samples and is shared between them
    linearly. Targets meet pulses by a generated sequence; sums are formed
    before the shuffle.
    """
    seen = targets.select("x", "y", "rcs", F.explode(F.sequence(F.lit(0), F.lit(pulses - 1))).alias("pulse"))
    seen = seen.withColumn("range", F.hypot(F.col("x"), F.col("y") - F.col("pulse") * spacing_m))
    at = F.floor(F.col("range") / step_m)
    share = F.col("range") / step_m - at
    both = F.array(F.struct(at.cast("int").alias("sample"), (1 - share).alias("w")), F.struct((at + 1).cast("int").alias("sample"), share.alias("w")))
    spread = seen.select("pulse", "rcs", "range", F.explode(both).alias("s")).where((F.col("s.sample") >= 0) & (F.col("s.sample") < samples))
    angle = F.lit(phase_sign * wave) * F.col("range")
    return spread.groupBy("pulse", F.col("s.sample").alias("sample")).agg(F.sum(F.col("rcs") * F.col("s.w") * F.cos(angle)).alias("re"), F.sum(F.col("rcs") * F.col("s.w") * F.sin(angle)).alias("im"))


def quantised(line: Column) -> Column:
    """Samples scaled so that the largest component is 32767, rounded."""
    peak = F.array_max(F.transform(line, lambda x: F.abs(x)))
    return let(peak, lambda top: F.transform(line, lambda x: F.when(top > 0, F.round(x / top * 32767)).otherwise(0.0).cast("int")))
