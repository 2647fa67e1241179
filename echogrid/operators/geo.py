"""Line lookup, grid interpolation and coordinates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import rpf

#: Fixed values of the WGS84 ellipsoid and the mean Earth radius in metres.
WGS84_A, WGS84_F, EARTH_RADIUS = 6378137.0, 1 / 298.257223563, 6371008.8
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def line_lookup(rows: DataFrame, blocks: DataFrame, line: str, width: int = 1024) -> DataFrame:
    """rows with the first block (of block, first, last) that covers each row's line; rows without one go, repeated rows stay.

    A range join turned into an equi-join on cells of `width` lines. Each
    distinct line is looked up once.
    """
    cells = blocks.select("block", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("_cell"))
    asked = rows.select(F.col(line).alias("_line")).distinct().withColumn("_cell", F.floor(F.col("_line") / width))
    found = asked.join(cells, "_cell").where(F.col("_line").between(F.col("first"), F.col("last"))).groupBy("_line").agg(F.min("block").alias("block"))
    return rows.join(found, rows[line] == found["_line"]).drop("_line")


class _Buckets:
    """Ranges of lines with about as many rows each; a line that fills several ranges alone is a bucket whose rows go to several tasks."""

    def __init__(self, lines: DataFrame, parts: int | None = None):
        parts = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = [k / parts for k in range(1, parts)]
        cuts = lines.select(F.col(lines.columns[0]).cast("double").alias("line")).approxQuantile("line", shares, 0.2 / parts) if shares else []
        held = Counter(cuts)
        self.splits = sorted(held)
        self.tasks = [1, *[held[x] for x in self.splits]]

    def placed(self, df: DataFrame, line: Column) -> DataFrame:
        """df with its rows' bucket; rows without a line are in the first one."""
        if not self.splits:
            return df.withColumn("_bucket", F.lit(0))
        found = Bucketizer(splits=[-math.inf, *self.splits, math.inf], inputCol="_at", outputCol="_in")
        return found.transform(df.withColumn("_at", F.coalesce(line.cast("double"), F.lit(-math.inf)))).withColumn("_bucket", F.col("_in").cast("int")).drop("_at", "_in")

    def salted(self, df: DataFrame, every: bool) -> DataFrame:
        """df (with buckets) with the task of each row in its bucket, or once for every one of them."""
        if max(self.tasks) == 1:
            return df.withColumn("_task", F.lit(0))
        tasks = F.element_at(F.lit(self.tasks), F.col("_bucket") + 1)
        if every:
            return df.withColumn("_task", F.explode(F.sequence(F.lit(0), tasks - 1)))
        plain = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
        return df.withColumn("_task", F.pmod(F.xxhash64(*plain), tasks).cast("int"))

    def across(self, ends: DataFrame, value: str, before: bool) -> DataFrame:
        """Of buckets' ends (_bucket, value) those of the last bucket before, or the first one behind, each bucket. One row a bucket."""
        order = Window.orderBy("_bucket")
        frame = order.rowsBetween(Window.unboundedPreceding, -1) if before else order.rowsBetween(1, Window.unboundedFollowing)
        every = ends.sparkSession.range(len(self.tasks)).select(F.col("id").cast("int").alias("_bucket")).join(F.broadcast(ends), "_bucket", "left")
        return every.select("_bucket", (F.last if before else F.first)(value, ignorenulls=True).over(frame).alias(value))


def latest(rows: DataFrame, line: str, table: DataFrame, at: str, name: str = "found", parts: int | None = None) -> DataFrame:
    """rows with `name`: a struct of the table's row with the greatest `at` that is not beyond the row's line, or null.

    An as-of join in one shuffle: rows and table meet in ranges of lines, sorted
    together, and the last table row so far is carried along. What a range
    begins with is the last table row of the ranges before it, one row for each
    range. `at` must be distinct.
    """
    lines = rows.select(F.col(line)).union(table.select(F.col(at)))
    return _latest(rows, line, table, at, name, _Buckets(lines, parts))


def _latest(rows: DataFrame, line: str, table: DataFrame, at: str, name: str, buckets: _Buckets) -> DataFrame:
    held = buckets.placed(table.select(F.col(at).alias("_line"), F.struct(*table.columns).alias("_row")), F.col("_line"))
    ends = held.groupBy("_bucket").agg(F.max_by(F.struct("_line", "_row"), "_line").alias("_end"))
    begins = buckets.across(ends, "_end", before=True).where("_end is not null").select(F.col("_end._line").alias("_line"), F.col("_end._row").alias("_row"), "_bucket")
    asked = buckets.salted(buckets.placed(rows.select(F.col(line).alias("_line"), F.struct(*rows.columns).alias("_asked")), F.col("_line")), every=False)
    both = buckets.salted(held.unionByName(begins), every=True).unionByName(asked, allowMissingColumns=True)
    so_far = Window.partitionBy("_bucket", "_task").orderBy("_line", F.col("_asked").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.when(F.col("_line").isNotNull(), F.last("_row", ignorenulls=True).over(so_far))).where("_asked is not null")
    return found.select(*[F.col("_asked")[c].alias(c) for c in rows.columns], F.col("_found").alias(name))


def knot_intervals(knots: DataFrame, at: str, *values: str, parts: int | None = None) -> DataFrame:
    """Successive knots as intervals (low, high, and for each value v: v_low, v_high). Knots are distinct."""
    buckets = _Buckets(knots.select(at), parts)
    own = buckets.placed(knots.select(F.col(at).alias("low"), *[F.col(v).alias(f"{v}_low") for v in values]), F.col("low"))
    row = F.struct("low", *[f"{v}_low" for v in values])
    heads = buckets.across(own.groupBy("_bucket").agg(F.min_by(row, "low").alias("_head")), "_head", before=False)
    each = own.withColumn("_next", F.lead(row).over(Window.partitionBy("_bucket").orderBy("low"))).join(F.broadcast(heads), "_bucket")
    after = F.coalesce("_next", "_head")
    return each.select("low", after["low"].alias("high"), *[c for v in values for c in (F.col(f"{v}_low"), after[f"{v}_low"].alias(f"{v}_high"))]).where("high is not null")


def _interpolated(rows: DataFrame, line: str, knots: DataFrame, at: str, values: tuple[str, ...], parts: int | None) -> DataFrame:
    """rows with _v, the array of the values at the row's line.

    Rows and knots are sorted together in ranges of lines, once up and once
    down: the last knot so far is the one before the row, or behind it. Ranges
    get the knots next to them, one on each side; the two outermost knots at
    both ends serve what lies beyond.
    """
    buckets = _Buckets(rows.select(F.col(line)).union(knots.select(F.col(at))), parts)
    knot = F.struct(F.col(at).cast("double").alias("at"), F.array(*[F.col(v).cast("double") for v in values]).alias("v"))
    held = buckets.placed(knots.select(F.col(at).alias("_line"), knot.alias("_knot")), F.col("_line"))
    ends = held.groupBy("_bucket").agg(*[f(F.struct("_line", "_knot"), "_line").alias(n) for f, n in ((F.max_by, "_last"), (F.min_by, "_first"))])
    for name, before in (("_last", True), ("_first", False)):
        beside = buckets.across(ends.select("_bucket", name), name, before).where(f"{name} is not null")
        held = held.unionByName(beside.select(F.col(f"{name}._line").alias("_line"), F.col(f"{name}._knot").alias("_knot"), "_bucket"))
    asked = buckets.salted(buckets.placed(rows.select(F.col(line).alias("_line"), F.struct(*rows.columns).alias("_asked")), F.col("_line")), every=False)
    both = buckets.salted(held, every=True).unionByName(asked, allowMissingColumns=True)
    own = Window.partitionBy("_bucket", "_task")
    ways = {"_low": (F.asc("_line"), F.col("_asked").isNotNull().asc()), "_high": (F.desc("_line"), F.col("_asked").isNotNull().desc())}
    for name, order in ways.items():
        both = both.withColumn(name, F.last("_knot", ignorenulls=True).over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    outer = [knots.select(knot.alias("k")).orderBy(order).limit(2).agg(F.array_sort(F.collect_list("k")).alias(n)) for order, n in ((F.asc("k.at"), "_begin"), (F.desc("k.at"), "_end"))]
    found = both.where("_asked is not null and _line is not null").join(F.broadcast(outer[0])).join(F.broadcast(outer[1]))
    low = F.when(F.col("_low").isNull(), F.get("_begin", F.lit(0))).when(F.col("_high").isNull(), F.get("_end", F.lit(0))).otherwise(F.col("_low"))
    high = F.when(F.col("_low").isNull(), F.get("_begin", F.lit(1))).when(F.col("_high").isNull(), F.get("_end", F.lit(1))).otherwise(F.col("_high"))
    found = found.select("_asked", F.col("_line").cast("double").alias("_line"), low.alias("_low"), high.alias("_high"))
    share = (F.col("_line") - F.col("_low.at")) / (F.col("_high.at") - F.col("_low.at"))
    mixed = F.zip_with("_low.v", "_high.v", lambda a, b: F.when(F.col("_share") == 0, a).when(F.col("_share") == 1, b).otherwise(a + F.col("_share") * (b - a)))
    found = found.withColumn("_share", share).withColumn("_v", F.when(F.col("_high").isNull(), F.col("_low.v")).otherwise(mixed))
    return found.select(*[F.col("_asked")[c].alias(c) for c in rows.columns], "_v")


def interpolate_lines(rows: DataFrame, line: str, knots: DataFrame, at: str, *values: str, parts: int | None = None) -> DataFrame:
    """rows with each value of the knots at the row's line: the knot's own at a knot, linear between two, and
    carried on along the first or last interval outside them. A single knot gives its value everywhere; rows without a line go."""
    found = _interpolated(rows, line, knots, at, values, parts)
    return found.select(*rows.columns, *[F.get("_v", F.lit(k)).alias(v) for k, v in enumerate(values)])


def across_pixels(pixel: Column, pixels: Column | int, begin: Column, middle: Column, end: Column) -> Column:
    """A value at a pixel (from 1) of a line, from those at its first, middle ((n + 1) / 2) and last pixel; carried on outside."""
    n = F.lit(pixels) if isinstance(pixels, int) else pixels
    centre = F.floor((n + 1) / 2)
    left = F.coalesce(begin + F.try_divide(pixel - 1, centre - 1) * (middle - begin), begin)
    right = F.coalesce(middle + F.try_divide(pixel - centre, n - centre) * (end - middle), middle)
    return F.when(pixel == 1, begin).when(pixel == centre, middle).when(pixel == n, end).when(pixel < centre, left).otherwise(right)


def grid_coordinates(rows: DataFrame, grid: DataFrame, pixels: int, line: str = "line", pixel: str = "pixel") -> DataFrame:
    """rows (line, pixel) with latitude, longitude and ratio from a geolocation grid (line and, for begin, mid and end, _lat, _lon, _ratio)."""
    names = [f"{p}_{v}" for p in ("begin", "mid", "end") for v in ("lat", "lon", "ratio")]
    found = interpolate_lines(rows, line, grid, "line", *names)
    at = [across_pixels(F.col(pixel), pixels, *[F.col(f"{p}_{v}") for p in ("begin", "mid", "end")]) for v in ("lat", "lon", "ratio")]
    return found.select(*rows.columns, *[c.alias(n) for c, n in zip(at, ("latitude", "longitude", "ratio"), strict=True)])


def in_sequence(catalog: DataFrame) -> DataFrame:
    """catalog with `base` and `number` of each file in its sequence (base_1, base_2, ...); null for files that are in none.

    A sequence ends at its first gap, so a file behind it has a base, but no number.
    """
    run = rpf.first_sequence(catalog.select("path").distinct()).select(F.col("path").alias("_path"), "number")
    return catalog.join(run, catalog["path"] == run["_path"], "left").drop("_path").withColumn("base", rpf.sequence_base(F.col("path")))


def matching_blocks(catalog: DataFrame, number: int, named: str | None = None) -> DataFrame:
    """The image blocks of a catalog (path, chunk, mode, start, lines, ...) that an acquisition number asks for, with their rank from 1.

    A stripmap block answers for the lines that it covers, any other for its
    own frame number; zero or less asks for the first block of a file. With a named file only
    it and its sequence are searched, the file itself first; without one, all
    files. Sequences go by number up to their first gap, not by text.
    """
    stripmap = F.col("mode") == "stripmap"
    hit = F.when(stripmap, F.lit(number).between(F.col("start"), F.col("start") + F.col("lines") - 1)).otherwise(F.col("start") == number)
    placed = in_sequence(catalog)
    searched = F.col("number").isNotNull() | F.col("base").isNull()
    if named is not None:
        searched = (F.col("path") == named) | (F.col("number").isNotNull() & (F.col("base") == rpf.sequence_base(F.lit(named))))
    asked = placed.where(searched if number <= 0 else searched & hit)
    # only blocks that match are ranked
    order = Window.orderBy(F.col("path") != named if named else F.lit(False), F.coalesce("base", "path"), F.col("number").asc_nulls_last(), "path", "chunk")
    return asked.select(*catalog.columns, F.row_number().over(order).alias("rank")).orderBy("rank")


def line_stream(catalog: DataFrame, match: DataFrame) -> DataFrame:
    """The blocks that a line stream runs over, with their place `nth` from 1: all blocks of the sequence that a stripmap match
    belongs to, by number up to the first gap, whether before or behind the match; else the one matching block.

    Each block keeps its own chunk number, by which its geolocation grid is found.
    """
    head = match.orderBy("rank").limit(1).select(F.col("path").alias("_path"), F.col("chunk").alias("_chunk"), F.col("mode").alias("_mode"), rpf.sequence_base(F.col("path")).alias("_base"))
    placed = in_sequence(catalog).join(F.broadcast(head))
    own = F.col("path") == F.col("_path")
    of_strip = (F.col("mode") == "stripmap") & (own | (F.col("number").isNotNull() & (F.col("base") == F.col("_base"))))
    chosen = placed.where(F.when(F.col("_mode") == "stripmap", of_strip).otherwise(own & (F.col("chunk") == F.col("_chunk"))))
    return chosen.select(*catalog.columns, F.row_number().over(Window.orderBy(F.col("number").asc_nulls_last(), "path", "chunk")).alias("nth")).orderBy("nth")


def flat_grid(lines: DataFrame) -> DataFrame:
    """A stand-in geolocation grid for (first, last): two lines at least, ratios of one, and no coordinates."""
    names = [f"{p}_{v}" for p in ("begin", "mid", "end") for v in ("lat", "lon", "ratio")]
    at = lines.select(F.explode(F.array("first", F.greatest(F.col("last"), F.col("first") + 1))).alias("line"))
    return at.select("line", *[(F.lit(1.0) if n.endswith("ratio") else F.lit(None).cast("double")).alias(n) for n in names])


def control_lattice(spark: SparkSession, rows: int, cols: int, x: tuple[float, float], y: tuple[float, float], lat: float, lon: float, height: float = 0.0, heading: float = 90.0, z: float = 0.0) -> DataFrame:
    """Up to 5 x 5 distinct control points of a scene image: (row, col, lon, lat, up) at pixel centres; x and y are the axes' ends."""
    places = [sorted({round(k * (n - 1) / 4) for k in range(5)}) for n in (rows, cols)]
    at = spark.range(1).select(F.explode(F.lit(places[0])).alias("row")).select("row", F.explode(F.lit(places[1])).alias("col"))
    px = F.lit(x[0]) + F.col("col") * ((x[1] - x[0]) / max(1, cols - 1))
    py = F.lit(y[0]) + F.col("row") * ((y[1] - y[0]) / max(1, rows - 1))
    found = scene_to_geodetic(px, py, F.lit(z), lat, lon, height, heading)
    return at.select((F.col("row") + 0.5).alias("row"), (F.col("col") + 0.5).alias("col"), *[c.alias(n) for c, n in zip(found, ("lon", "lat", "up"), strict=True)])


def wrapped(degrees: Column) -> Column:
    """An angle brought between -180 and 180 degrees."""
    return degrees - 360 * F.round(degrees / 360)


def frame_coordinates(pixels: DataFrame, rows: list[float], cols: list[float], lon: list[list[float]], lat: list[list[float]]) -> DataFrame:
    """pixels (row, col) with lon and lat from a small grid of knots, bilinear, across the date line too; null outside the knots.

    The knots (33 x 33 at most) travel as literals.
    """
    if len(rows) > 33 or len(cols) > 33 or min(len(rows), len(cols)) < 2:
        raise ValueError("a geolocation grid has 2 to 33 knots on each axis")

    def place(value: Column, knots: list[float]) -> tuple[Column, Column]:
        at = F.lit([float(k) for k in knots])
        k = F.least(F.greatest(F.size(F.filter(at, lambda x: x <= value)) - 1, F.lit(0)), F.lit(len(knots) - 2))
        return k, (value - F.get(at, k)) / (F.get(at, k + 1) - F.get(at, k))

    (r, u), (c, v) = place(F.col("row"), rows), place(F.col("col"), cols)
    inside = F.col("row").between(rows[0], rows[-1]) & F.col("col").between(cols[0], cols[-1])

    def mixed(table: list[list[float]], turn: bool) -> Column:
        corner = lambda i, j: F.get(F.get(F.lit([[float(x) for x in line] for line in table]), r + i), c + j)
        base = corner(0, 0)
        off = [[wrapped(corner(i, j) - base) if turn else corner(i, j) - base for j in (0, 1)] for i in (0, 1)]
        out = base + (1 - u) * v * off[0][1] + u * (1 - v) * off[1][0] + u * v * off[1][1]
        return F.when(inside, wrapped(out) if turn else out)

    return pixels.withColumns({"lon": mixed(lon, True), "lat": mixed(lat, False)})


def knot_places(images: DataFrame, rows: Column, cols: Column, most: int = 33) -> DataFrame:
    """images with the pixels (row, col) of their geolocation knots: `most` at most on each axis, numbered i and j, and the
    midpoints of the cells between them (mid). Rows and cols are the images' sizes, 2 or more."""

    def axis(size: Column, mid: bool) -> tuple[Column, Column]:
        n = F.least(size, F.lit(most))
        at = F.transform(F.sequence(F.lit(0), n - (2 if mid else 1)), lambda k: F.struct(k.alias("k"), ((k + (0.5 if mid else 0.0)) * (size - 1) / (n - 1)).alias("at")))
        return F.assert_true(size >= 2, "an image of at least 2 x 2 pixels is needed").isNull(), at

    def places(mid: bool) -> DataFrame:
        (good, down), (fine, across) = axis(rows, mid), axis(cols, mid)
        each = images.where(good & fine).select(*images.columns, F.explode(down).alias("_r"), across.alias("_across")).select(*images.columns, "_r", F.explode("_across").alias("_c"))
        return each.select(*images.columns, F.lit(mid).alias("mid"), F.col("_r.k").alias("i"), F.col("_c.k").alias("j"), F.col("_r.at").alias("row"), F.col("_c.at").alias("col"))

    return places(False).unionByName(places(True))


def knot_grid(located: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Knots and residuals of images (keys) from knot_places() with lon and lat, whatever map gave them.

    The knots (keys, i, j, row, col, lon, lat) have `flat`, the longitude without
    jumps: unwrapped along the columns of each row, then along the rows. The
    residuals (keys, interpolation_error_m) are the largest distance, over all
    cells, between a midpoint's place and the mean of its four knots.
    """
    knots = located.where("not mid")
    for across, along in (("i", "j"), ("j", "i")):
        name, own = ("lon" if across == "i" else "flat"), Window.partitionBy(*keys, across).orderBy(along)
        step = wrapped(F.col(name) - F.lag(name).over(own))
        knots = knots.withColumn("_step", F.coalesce(step, F.col(name))).withColumn("flat", F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    after = Window.partitionBy(*keys, "i").orderBy("j")
    pairs = knots.select(*keys, "i", "j", *[(F.col(c) + F.lead(c).over(after)).alias(f"{c}_2") for c in ("flat", "lat")])
    below = Window.partitionBy(*keys, "j").orderBy("i")
    means = pairs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), F.col("j").alias("_j"), *[((F.col(f"{c}_2") + F.lead(f"{c}_2").over(below)) / 4).alias(f"mean_{c}") for c in ("flat", "lat")])
    met = located.where("mid").join(means, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in (*keys, "i", "j")])
    off = F.hypot(F.radians(F.col("mean_lat") - F.col("lat")), F.radians(wrapped(F.col("mean_flat") - F.col("lon"))) * F.cos(F.radians("lat")))
    residuals = met.groupBy(*keys).agg(F.max(EARTH_RADIUS * off).alias("interpolation_error_m"))
    return knots.select(*keys, "i", "j", "row", "col", "lon", "lat", "flat"), residuals


def frame_geolocation(spark: SparkSession, place: Callable[[DataFrame], DataFrame], rows: int, cols: int, most: int = 33) -> dict:
    """The geolocation of one frame's manifest; `place` gives a DataFrame of pixels (row, col) lon and lat. At most `most` x `most` knots reach the driver."""
    if rows * cols > 64_000_000:
        raise ValueError("a frame has up to 64 million pixels")
    one = spark.range(1).select(F.lit(0).alias("frame"))
    knots, residual = knot_grid(place(knot_places(one, F.lit(rows), F.lit(cols), most)), "frame")
    found = {(k["i"], k["j"]): k for k in knots.collect()}
    n, m = (1 + max(k[axis] for k in found) for axis in (0, 1))
    out = {"rows": [found[i, 0]["row"] for i in range(n)], "cols": [found[0, j]["col"] for j in range(m)]}
    for name, c in (("longitude", "lon"), ("latitude", "lat")):
        out[name] = [[found[i, j][c] for j in range(m)] for i in range(n)]
    return {**out, "interpolation_error_m": residual.first()["interpolation_error_m"], "error_scope": "sampled cell-midpoint interpolation residual; absolute accuracy unknown"}


def knot_residual(points: DataFrame) -> DataFrame:
    """The largest distance in metres between places (lon, lat) and what a knot grid gives for them (grid_lon, grid_lat), as one row."""
    return points.agg(F.max(great_circle(F.col("lon"), F.col("lat"), F.col("grid_lon"), F.col("grid_lat"))).alias("residual_m"))


def utm_zone(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone of a place."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


#: Third flattening and the first coefficients of Krueger's series, from their definition by the flattening.
_N = WGS84_F / (2 - WGS84_F)
RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15]


def to_utm(lon: Column, lat: Column, epsg: Column | int) -> tuple[Column, Column]:
    """Easting and northing in metres in a UTM zone given by its EPSG code (Krueger's series to the third order)."""
    code = F.lit(epsg) if isinstance(epsg, int) else epsg
    centre, south = (code % 100) * 6 - 183, code >= 32700
    phi, lam = F.radians(lat), F.radians(wrapped(lon - centre))
    e = WGS84_E2**0.5
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(ALPHA, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return 500_000 + 0.9996 * RECTIFYING * east, F.when(south, 10_000_000.0).otherwise(0.0) + 0.9996 * RECTIFYING * north


def from_utm(east: Column, north: Column, epsg: Column | int) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a UTM zone."""
    code = F.lit(epsg) if isinstance(epsg, int) else epsg
    xi = (north - F.when(code >= 32700, 10_000_000.0).otherwise(0.0)) / (0.9996 * RECTIFYING)
    eta = (east - 500_000) / (0.9996 * RECTIFYING)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return wrapped(F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (code % 100) * 6 - 183), F.degrees(phi)


def merged_mask(value: Column, nodata: Column | float | None = None, mask: Column | None = None) -> Column:
    """A value, or NaN where its mask is zero, where it is the nodata value, or where it is not finite. Zero stays zero."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if nodata is not None:
        bad = bad | F.coalesce(value == nodata, F.lit(False))
    if mask is not None:
        bad = bad | (F.coalesce(mask, F.lit(0)) == 0)
    return F.when(bad, float("nan")).otherwise(value)


def geocode(image: DataFrame, a: tuple[float, float, float, float, float, float], rows: int, cols: int, pixel_m: float | None = None) -> tuple[DataFrame, dict[str, float]]:
    """A magnitude image (row, col, value; lon and lat by an affine map of its pixels) on the north-up grid of its UTM zone.

    Each source pixel gives its value to the output pixels around it: it is
    dealt, with its weight of a bilinear sample, to those whose own place in
    the source lies within one pixel. One shuffle by output pixel adds the
    weights up. Output without all its neighbours, or with one that is NaN, is
    NaN; output pixels outside the source are not in the result. The second
    result has epsg, the top left corner and the pixel size.
    """
    spark = image.sparkSession
    corners = spark.range(1).select(F.explode(F.lit([[float(r), float(c)] for r in (0, rows) for c in (0, cols)])).alias("p")).select((F.col("p")[0] - 0.5).alias("r"), (F.col("p")[1] - 0.5).alias("c"))
    lon, lat = affine(F.col("r"), F.col("c"), a)
    centre = affine(F.lit(rows / 2 - 0.5), F.lit(cols / 2 - 0.5), a)
    placed = corners.select(lon.alias("lon"), lat.alias("lat"), utm_zone(*centre).alias("epsg"))
    east, north = to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    box = placed.select("epsg", east.alias("e"), north.alias("n")).agg(F.first("epsg").alias("epsg"), F.min("e").alias("left"), F.max("e").alias("right"), F.min("n").alias("low"), F.max("n").alias("top")).first()
    step = pixel_m or max((box["right"] - box["left"]) / cols, (box["top"] - box["low"]) / rows)
    width, height = math.ceil((box["right"] - box["left"]) / step), math.ceil((box["top"] - box["low"]) / step)
    grid = {"epsg": box["epsg"], "left": box["left"], "top": box["top"], "pixel_m": step, "rows": height, "cols": width}
    det = a[0] * a[4] - a[1] * a[3]
    out = spark.range(width * height).select((F.floor(F.col("id") / width)).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    at = from_utm(F.lit(box["left"]) + (F.col("col") + 0.5) * step, F.lit(box["top"]) - (F.col("row") + 0.5) * step, box["epsg"])
    dx, dy = at[0] - a[2], at[1] - a[5]
    out = out.withColumns({"sc": (a[4] * dx - a[1] * dy) / det - 0.5, "sr": (a[0] * dy - a[3] * dx) / det - 0.5})
    out = out.where(F.col("sr").between(0, rows - 1) & F.col("sc").between(0, cols - 1))
    r0, c0 = F.least(F.floor("sr").cast("int"), F.lit(rows - 2)), F.least(F.floor("sc").cast("int"), F.lit(cols - 2))
    near = [F.struct((r0 + i).alias("row"), (c0 + j).alias("col"), ((1 - F.abs(F.col("sr") - (r0 + i))) * (1 - F.abs(F.col("sc") - (c0 + j)))).alias("w")) for i in (0, 1) for j in (0, 1)]
    asked = out.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.explode(F.array(*near)).alias("s")).where("s.w > 0").select("to_row", "to_col", "s.w", F.col("s.row").alias("row"), F.col("s.col").alias("col"))
    return resampled(image, asked), grid


def resampled(image: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, col, value) from weighted source pixels (to_row, to_col, w, row, col); a pixel that is missing or NaN makes its output NaN."""
    met = asked.join(image.select("row", "col", "value"), ["row", "col"], "left").groupBy("to_row", "to_col").agg(F.sum(F.col("w") * F.coalesce("value", F.lit(float("nan")))).alias("value"))
    return met.select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), "value")


def affine(row: Column, col: Column, a: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel's centre."""
    x, y = col + 0.5, row + 0.5
    return a[0] * x + a[1] * y + a[2], a[3] * x + a[4] * y + a[5]


def scene_to_geodetic(x: Column, y: Column, z: Column, lat: float, lon: float, height: float, heading: float = 90.0) -> tuple[Column, Column, Column]:
    """Longitude, latitude (degrees) and ellipsoid height of scene points; x points along `heading`, y to its left."""
    phi, lam, h = math.radians(lat), math.radians(lon), math.radians(heading)
    east = x * math.sin(h) - y * math.cos(h)
    north = x * math.cos(h) + y * math.sin(h)
    n = WGS84_A / math.sqrt(1 - WGS84_E2 * math.sin(phi) ** 2)
    ex = F.lit((n + height) * math.cos(phi) * math.cos(lam)) - east * math.sin(lam) - north * (math.sin(phi) * math.cos(lam)) + z * (math.cos(phi) * math.cos(lam))
    ey = F.lit((n + height) * math.cos(phi) * math.sin(lam)) + east * math.cos(lam) - north * (math.sin(phi) * math.sin(lam)) + z * (math.cos(phi) * math.sin(lam))
    ez = F.lit((n * (1 - WGS84_E2) + height) * math.sin(phi)) + north * math.cos(phi) + z * math.sin(phi)
    p = F.hypot(ex, ey)
    b = WGS84_A * (1 - WGS84_F)
    theta = F.atan2(ez * WGS84_A, p * b)
    ep2 = WGS84_E2 / (1 - WGS84_E2)
    out = F.atan2(ez + ep2 * b * F.pow(F.sin(theta), 3), p - WGS84_E2 * WGS84_A * F.pow(F.cos(theta), 3))
    across = WGS84_A / F.sqrt(1 - WGS84_E2 * F.pow(F.sin(out), 2))
    up = p * F.cos(out) + ez * F.sin(out) - WGS84_A * WGS84_A / across
    return F.degrees(F.atan2(ey, ex)), F.degrees(out), up


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), s)))
