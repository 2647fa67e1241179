"""The registered queries: the engine's operators over the given tables.

An embedding stands in for a range line of 64 samples, or for an 8 x 8 frame; a
label for an aperture or stream; events for a frame stream; lineitem, summed by
(l_orderkey % 32, l_linenumber), for a raster; orders and suppliers for blocks
and knots.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cplx
from ..operators import chain, geo, imaging, measure, preview, register, signal
from ..sources import rpf, sensors, tape

N, REPLICA = 64, [0.25, 0.5, 0.75, 1.0, 0.75, 0.5, 0.25]
Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", signal.doubles(F.col("embedding")).alias("line"))


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 32).cast("int").alias("row"), F.col("l_linenumber").alias("col"))
    return rows.agg(F.sum("l_quantity").alias("value"))


@_query
def q01_range_profile_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("vec_id", "label", _r(signal.windowed_energy(F.col("line"), N)).alias("energy"))


@_query
def q02_dft_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.dft_bins(_lines(spark, sf_dir), "line", N, 8, "vec_id").select("vec_id", "bin", _r("re").alias("re"), _r("im").alias("im"))


@_query
def q03_matched_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.best_lag(_lines(spark, sf_dir), "line", REPLICA, N, "vec_id").select("vec_id", "lag", _r("peak").alias("peak"))


@_query
def q04_pta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).select("vec_id", measure.pta_stats(F.transform("line", lambda x: F.abs(x)), N).alias("s"))
    return found.select("vec_id", _r("s.max_power").alias("max_power"), "s.pos", "s.irw", _r("s.mslr").alias("mslr"), _r("s.islr").alias("islr"))


@_query
def q05_local_peaks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).select("vec_id", F.posexplode(measure.local_peaks(F.col("line"), N, 3)).alias("nth", "p"))
    return found.select("vec_id", (F.col("nth") + 1).alias("nth"), F.col("p.index").alias("place"), _r("p.power").alias("power"))


@_query
def q06_profile_sum_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = signal.long_form(_lines(spark, sf_dir), "line", "label")
    return measure.profile_sums(samples, "label", "pos", "v").select("label", "pos", _r("total").alias("total"))


@_query
def q07_histogram_right_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.histogram(_table(spark, sf_dir, "events"), "value", 10)


@_query
def q08_percentile_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.order_statistics(_table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.02, 0.5, 0.98])


@_query
def q09_agc_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("vec_id", F.posexplode(signal.agc(F.transform("line", lambda x: F.abs(x)))).alias("pos", "v"))
    return lines.select("vec_id", "pos", _r("v").alias("value"))


@_query
def q10_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("vec_id", F.posexplode(signal.collapse(F.col("line"), 5, N)).alias("cell", "v"))
    return lines.select("vec_id", "cell", _r("v").alias("value"))


@_query
def q11_edge_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("vec_id", F.posexplode(signal.edge_taper(F.col("line"), 8, N)).alias("pos", "v"))
    return lines.select("vec_id", "pos", _r("v").alias("value"))


@_query
def q12_dc_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = signal.long_form(_lines(spark, sf_dir), "line", "vec_id")
    return signal.remove_mean(samples, "v").select("vec_id", "pos", _r("v").alias("value"))


@_query
def q13_centroid_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _lines(spark, sf_dir).select("label", "vec_id", register.centroid(F.col("line"), 8, 8).alias("c")).select("label", "vec_id", F.col("c.total").alias("total"), _r("c.cx", 9).alias("cx"), _r("c.cy", 9).alias("cy"))
    found = register.register(frames, "label", "vec_id")
    return found.select("label", "vec_id", "dx", "dy", _r("metric").alias("metric"), "cum_dx", "cum_dy")


@_query
def q14_focus_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("vec_id", _r(measure.focus_metric(F.col("line"), 8, 8)).alias("metric"))


@_query
def q15_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _lines(spark, sf_dir).select("label", "vec_id", _r(measure.focus_metric(F.col("line"), 8, 8)).alias("metric"))
    return measure.running_best(frames, "label", "vec_id", "metric").select("label", "vec_id", "metric", _r("delta").alias("delta"), "is_best")


@_query
def q16_latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure.latency_stats(_table(spark, sf_dir, "events"), "event_type", F.col("value") - 100)
    return found.select("event_type", "n", _r("least").alias("least"), _r("most").alias("most"), _r("mean").alias("mean"))


@_query
def q17_frame_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a buffer of four frames holds at the end, for each user: a bounded aggregate, no full sort of a user's events."""
    events = _table(spark, sf_dir, "events")
    latest = events.withColumn("nth", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return latest.where("nth <= 4").select("user_id", "event_id", "nth", "value")


@_query
def q18_block_line_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("block"), (F.col("s_suppkey") * 10).alias("first"), (F.col("s_suppkey") * 10 + 14).alias("last"))
    lines = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"))
    return geo.line_lookup(lines, blocks, "line").select("line", "block")


@_query
def q19_asof_grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10).alias("at"), "s_acctbal")
    lines = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"))
    found = geo.interpolate_lines(lines, "line", knots, "at", "s_acctbal")
    return found.select("line", _r("s_acctbal").alias("value"))


_POINTS = [(x, y, 0.0) for y in (-2.0, 0.0, 2.0) for x in (-2.0, 0.0, 2.0)]


def _pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a pulse on a circle of 100 m, 20 m high; r0 so that the scene's centre falls on sample 20."""
    angle = F.col("vec_id") * F.lit(0.01)
    return _lines(spark, sf_dir).select((100 * F.cos(angle)).alias("x"), (100 * F.sin(angle)).alias("y"), F.lit(20.0).alias("z"), F.lit(math.sqrt(10400.0) - 20.0).alias("r0"), "line")


@_query
def q20_backproject_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imaging.backproject_sums(_pulses(spark, sf_dir), _POINTS, "line", N, 0.0, 1.0, 0.5)
    return found.select("point", _r("re", 4).alias("re"), _r("im", 4).alias("im"), "n")


@_query
def q21_direct_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imaging.direct_sums(_pulses(spark, sf_dir), _POINTS, "line", 0.5, 0.01, N)
    return found.select("point", _r("re", 4).alias("re"), _r("im", 4).alias("im"))


@_query
def q22_compare_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    place = [(F.col("l_orderkey") % 32).cast("int").alias("row"), F.col("l_linenumber").alias("col")]
    b = lines.groupBy(*place).agg(F.sum(F.col("l_quantity") * (1 + F.col("l_tax") / 100)).alias("value"))
    found = measure.compare_images(_raster(spark, sf_dir), b, 0.5, 0.0004)
    return found.select("pixels", _r("rms", 4).alias("rms"), _r("max_difference", 4).alias("max_difference"), "failures", "unmatched")


@_query
def q23_preview_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview.box_power(_raster(spark, sf_dir), 4).select("row", "col", _r("value").alias("value"))


@_query
def q24_gray_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir)
    top = image.agg(F.max("value").alias("top"))
    return image.join(F.broadcast(top)).select("row", "col", preview.gray_db(F.col("value"), F.col("top"), 6.0).alias("gray"))


@_query
def q25_sequence_first_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, the first unbroken run of its suppliers' numbers."""
    names = _table(spark, sf_dir, "lineitem").select(F.concat("l_partkey", F.lit("_"), "l_linenumber", F.lit(".rpf")).alias("path")).distinct()
    found = rpf.first_sequence(names).groupBy(F.col("base").cast("long").alias("base"))
    return found.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("n"))


@_query
def q26_echo_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "customer").select((200.0 + F.col("c_custkey") % 97).alias("x"), (F.col("c_custkey") % 31 - 15.0).alias("y"), (F.col("c_acctbal") / 1000).alias("rcs"))
    found = imaging.point_echoes(targets, 8, 1.5, 200, 2.0, 0.25)
    return found.select("pulse", "sample", _r("re", 4).alias("re"), _r("im", 4).alias("im"))


@_query
def q27_shift_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir).withColumn("col", F.col("col") - 1)
    return register.shift(image, 1, -2, 32, 7).select("row", "col", _r("value").alias("value"))


@_query
def q28_unique_stem_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = _table(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("stem"))
    return stems.groupBy("stem").agg(F.count("*").alias("n")).where("n > 1")


@_query
def q29_mag_phase_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("magnitude"), F.pmod(F.sum("l_partkey") * 977, F.lit(65536)).alias("code"))
    value = cplx.mag_phase(F.col("magnitude"), F.col("code"))
    return lines.select("l_orderkey", _r(value.re).alias("re"), _r(value.im).alias("im"))


@_query
def q30_zoom_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zoomed lines' peaks, the first of equals."""
    zoomed = signal.zoom(_lines(spark, sf_dir), "line", 4, "vec_id").withColumn("zoomed", F.transform("zoomed", lambda x: F.round(x, 9)))
    return zoomed.select("vec_id", _r(F.array_max("zoomed")).alias("peak"), (F.array_position("zoomed", F.array_max("zoomed")) - 1).cast("int").alias("place"))


@_query
def q31_stc_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("vec_id", F.posexplode(signal.stc_ramp(F.col("line"), N)).alias("pos", "v"))
    return lines.select("vec_id", "pos", _r("v").alias("value"))


@_query
def q32_top_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.top_points(_raster(spark, sf_dir), 16).select("row", "col", _r("value").alias("value"))


@_query
def q33_frequency_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("k"), (9600.0 + F.col("s_suppkey") * 0.02 + F.col("s_acctbal") * 1e-6).alias("f"))
    return measure.frequency_fit(table, "k", "f").select(_r("start").alias("start"), _r("step", 8).alias("step"), _r("error").alias("error"))


@_query
def q34_scene_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.count("*").alias("n"))


@_query
def q35_scene_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 200 - 100.0).alias("x"), (F.col("c_acctbal") / 10).alias("y"))
    lon, lat, _ = geo.scene_to_geodetic(F.col("x"), F.col("y"), F.lit(0.0), 35.2, -106.5, 1600.0)
    return points.select("c_custkey", _r(lon, 7).alias("lon"), _r(lat, 7).alias("lat"))


@_query
def q36_phase_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring samples as real and imaginary parts."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(N // 2 - 1)), lambda k: F.struct(F.get("line", 2 * k).alias("a"), F.get("line", 2 * k + 1).alias("b")))
    each = _lines(spark, sf_dir).select("vec_id", F.posexplode(pairs).alias("pos", "v"))
    return each.select("vec_id", "pos", preview.gray_phase(F.atan2("v.b", "v.a")).alias("gray"))


@_query
def q37_normalised_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = measure.histogram(_table(spark, sf_dir, "orders"), "o_totalprice", 256)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("bin", _r(F.col("n") / F.col("total"), 9).alias("share"))


@_query
def q38_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).select("vec_id", F.posexplode(imaging.quantised(F.transform("line", lambda x: F.round(x, 4)))).alias("pos", "code"))
    return lines.groupBy("vec_id").agg(F.sum(F.abs("code")).alias("codes"), F.max("code").alias("top"), F.min("code").alias("least"))


@_query
def q39_impulse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null where a line has no minimum or no half-power crossing on one side."""
    found = _lines(spark, sf_dir).select("vec_id", measure.impulse_response(F.transform("line", lambda x: F.abs(x)), 0.5, strict=False).alias("r"))
    return found.select("vec_id", "r.peak", "r.left", "r.right", *[_r(f"r.{c}").alias(c) for c in ("width", "pslr", "islr", "pslr_db", "islr_db")])


def _frame_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an 8 x 8 frame: (vec_id, row, col, value)."""
    each = _lines(spark, sf_dir).select("vec_id", F.posexplode("line").alias("pos", "value"))
    return each.select("vec_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).alias("col"), "value")


@_query
def q40_axis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = measure.pta_stats_2d(_frame_pixels(spark, sf_dir).withColumn("value", F.abs("value")), 8, 8, "vec_id")
    return both.select("vec_id", *[_r(f"{a}.max_power").alias(f"{a}_power") for a in "xy"], *[F.col(f"{a}.pos").alias(f"{a}_pos") for a in "xy"], *[F.col(f"{a}.irw").alias(f"{a}_irw") for a in "xy"])


@_query
def q41_image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected lines, without zoom: statistics and the highest peak."""
    found = measure.image_quality(_lines(spark, sf_dir), "line", N, "vec_id", most=1)
    return found.select("vec_id", _r("stats.max_power", 4).alias("max_power"), F.col("stats.pos").alias("pos"), F.col("stats.irw").alias("irw"), _r(F.col("peaks")[0]["power"], 4).alias("peak"))


@_query
def q42_demonstration_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older chain on the raster: mean removed, Hamming both ways, two FFTs, magnitudes, rows evened out, edges tapered."""
    lines = _raster(spark, sf_dir).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"].cast("double")).alias("re")).withColumn("im", F.transform("re", lambda x: F.lit(0.0)))
    image, _, _ = chain.demonstration_image(lines, 32, 7, chain.Settings(agc=True, edge_taper=2))
    return image.select("row", "col", _r("value").alias("value"))


@_query
def q43_compressed_backprojection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range compression of every embedding as a pulse of 64 frequencies, and the coherent image of a full grid."""
    angle = F.col("vec_id") * F.lit(0.01)
    pulses = _lines(spark, sf_dir).select(F.col("vec_id").alias("pulse"), F.col("line").alias("re"), F.transform("line", lambda x: F.lit(0.0)).alias("im"), (100 * F.cos(angle)).alias("x"), (100 * F.sin(angle)).alias("y"), F.lit(20.0).alias("z"), F.lit(math.sqrt(10400.0)).alias("r0"))
    profiles, meta = signal.compress_phase_history(pulses, 1e8 + 1e6 * np.arange(N), 2)
    image = imaging.backproject(imaging.Grid((-15.0, 15.0, 11), (-15.0, 15.0, 7)), profiles, meta)
    return image.select("row", "col", _r("re").alias("re"), _r("im").alias("im"))


@_query
def q44_reduced_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir).withColumn("col", F.col("col") - 1)
    return preview.reduced(image, 32, 7, 5, 3).select("row", "col", _r("value").alias("value"))


@_query
def q45_centre_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = [(F.col("l_orderkey") % 32).cast("int").alias("row"), (F.col("l_linenumber") - 1).alias("col")]
    image = _table(spark, sf_dir, "lineitem").groupBy(*place).agg(F.sum("l_quantity").alias("re"), F.sum(F.col("l_discount") * 100 - 5).alias("im"))
    return preview.centre_phase(image, 32, 7, 5, 3).select("row", "col", _r("value").alias("value"))


@_query
def q46_level_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir)
    top = image.agg(F.max("value").alias("top"))
    return image.join(F.broadcast(top)).select("row", "col", preview.level_db(F.col("value"), F.col("top"), 6.0).alias("level"))


@_query
def q47_frame_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers at places of a frame whose knots lie on both sides of the date line."""
    at = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 41 / 2.0).alias("row"), (F.col("c_custkey") % 37 / 3.0).alias("col"))
    found = geo.frame_coordinates(at, [0.0, 8.0, 19.0], [0.0, 11.0], [[179.0, -179.5], [179.5, -178.5], [-179.8, -177.0]], [[10.0, 10.5], [9.0, 9.4], [7.0, 7.7]])
    return found.select("c_custkey", _r("lon").alias("lon"), _r("lat").alias("lat"))


@_query
def q48_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 350 - 175.0).alias("lon"), (F.col("c_acctbal") / 200).alias("lat"))
    placed = places.withColumn("epsg", geo.utm_zone(F.col("lon"), F.col("lat")))
    east, north = geo.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    return placed.select("c_custkey", "epsg", _r(east, 3).alias("east"), _r(north, 3).alias("north"))


@_query
def q49_acquisition_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as image blocks of a sequence of files by nation; those that answer for line or frame 350, best first."""
    key = F.col("s_suppkey")
    catalog = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("f_"), F.col("s_nationkey").cast("string")).alias("path"), key.alias("chunk"), F.when(key % 3 > 0, "stripmap").otherwise("seaspot").alias("mode"), (key * 10).alias("start"), F.lit(55).alias("lines"))
    return geo.matching_blocks(catalog, 350, "f_7")


@_query
def q50_scene_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as scene headers."""
    size = F.col("p_size")
    headers = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), (size * 100).alias("radar_frequency"), (size * 3).alias("pulse_width"), F.col("p_retailprice").alias("sampling_mhz"), (size / 2.0).alias("fm_rate_mhz_us"), F.col("p_retailprice").alias("velocity_t0"), (size * 1000).alias("scene_range"), (size * 1.5).alias("scene_eta"), (size % 5 * 200).alias("pri"))
    found = tape.scene_parameters(headers, 10)
    return found.withColumn("eta_rad", _r("eta_rad", 9))


@_query
def q51_source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("double").alias("k"), (9600.0 + F.col("s_suppkey") * 0.02 + F.col("s_acctbal") * 1e-6).alias("frequency_hz"))
    found = measure.source_statistics(table)
    return found.select("samples", _r("start").alias("start"), _r("step", 8).alias("step"), _r("error").alias("error"), _r("bandwidth_hz", 5).alias("bandwidth_hz"), _r("resolution_m", 1).alias("resolution_m"))


@_query
def q52_tile_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir).withColumn("col", F.col("col") - 1)
    found = chain.tile_blend(image, 32, 7, chain.tile_layout(32, 7, 2, 5, 2))
    return found.select("row", "col", _r("value").alias("value"), "tiles")


@_query
def q53_stage_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.lit(["phase_history", "raw_echo", "focused_image"]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    sets = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_set"), kinds.alias("kind"), (F.col("s_nationkey") < 12).alias("has_origin"))
    return preview.stage_policy(sets)


@_query
def q54_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir)
    top = image.agg(F.max("value").alias("top"))
    level = F.when(F.col("row") % 8 > 0, F.round(F.col("value") / F.col("top"), 9))
    return image.join(F.broadcast(top)).select("row", "col", preview.coloured(level).alias("c")).select("row", "col", "c.*")


@_query
def q55_flat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    strips = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("first"), (F.col("s_suppkey") + F.col("s_nationkey") % 4).alias("last"))
    return geo.flat_grid(strips).groupBy("line").agg(F.count("*").alias("n"), F.sum("mid_ratio").alias("ratios"), F.count("mid_lat").alias("known"))


@_query
def q56_merged_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir).groupBy("row").agg(F.count("*").alias("n"), F.sum(F.when(~F.isnan(geo.merged_mask(F.col("value").cast("double"), F.lit(None).cast("double"), (F.col("col") % 3))), F.col("value"))).alias("kept"))
    return image.select("row", "n", _r("kept").alias("kept"))


@_query
def q57_edge_taper_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = _raster(spark, sf_dir).withColumn("col", F.col("col") - 1)
    return chain.image_edge_taper(image, 3, 32, 7).select("row", "col", _r("value").alias("value"))


@_query
def q58_grid_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as places (line, pixel) between the geolocation lines that suppliers stand for."""
    names = [f"{p}_{v}" for p in ("begin", "mid", "end") for v in ("lat", "lon", "ratio")]
    knots = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 40).alias("line"), *[(F.col("s_acctbal") / 97 + k * F.col("s_nationkey")).alias(n) for k, n in enumerate(names)])
    asked = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("line"), (F.col("o_orderkey") % 23).alias("pixel"))
    found = geo.grid_coordinates(asked, knots, 20)
    return found.select("o_orderkey", *[_r(c, 5).alias(c) for c in ("latitude", "longitude", "ratio")])


@_query
def q59_geolocation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as images near the date line: knots and midpoint residuals of their geolocation grids."""
    images = _table(spark, sf_dir, "supplier").select("s_suppkey", (2 + F.col("s_suppkey") % 50).alias("rows"), (2 + F.col("s_nationkey") * 3).alias("cols"), (F.col("s_acctbal") * 1e-9).alias("bend"))
    at = geo.knot_places(images, F.col("rows"), F.col("cols"), 9)
    curve = F.col("bend") * F.col("row") * F.col("col")
    located = at.withColumn("lon", geo.wrapped(179.99 + 0.001 * F.col("col") + curve)).withColumn("lat", 60.0 - 0.0005 * F.col("row") + curve)
    knots, residuals = geo.knot_grid(located, "s_suppkey")
    summed = knots.groupBy("s_suppkey").agg(F.count("*").alias("knots"), _r(F.max("flat"), 9).alias("east"), _r(F.min("lat"), 9).alias("south"))
    return summed.join(residuals, "s_suppkey").select("s_suppkey", "knots", "east", "south", _r("interpolation_error_m", 5).alias("residual_m"))


@_query
def q60_sensor_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as documents of sensor records, some with units or values that cannot be used."""
    field = lambda name, value: F.concat(F.lit(f'<field name="{name}" value="'), value, F.lit('"/>'))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    craft = F.concat(F.lit('<tre name="ACFTB">'), field("ROW_SPACING", (nation - 2).cast("string")), field("ROW_SPACING_UNITS", F.element_at(F.lit(["m", "f", "y"]), (key % 3 + 1).cast("int"))), F.lit("</tre>"))
    angle = F.concat(F.lit('<tre name="EXPLTB">'), field("GRAZE_ANG", (nation * 4).cast("string")), F.lit("</tre>"))
    image = F.concat(F.lit('<tre name="MENSRB">'), field("RP_ROW", (key % 40).cast("string")), field("C_R_NC", F.lit("0.6")), field("C_R_EC", F.lit("0.8")), field("C_R_DC", F.when(key % 2 == 0, "0").otherwise("0.2")), F.lit("</tre>"))
    documents = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("<tres>"), craft, angle, image, F.lit("</tres>")).alias("xml"), F.lit(30).alias("height"))
    found = sensors.sensor_metadata(documents, "xml", "height")
    return found.select("s_suppkey", _r("row_spacing_m").alias("row_spacing_m"), "graze_deg", "reference_row", F.size("range_ned").alias("parts"), F.size("issues").alias("n_issues"), "status")


def queries() -> dict[str, Query]:
    return dict(_found)
