"""Operators against closed forms, direct sums and fixed expected values."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import cplx, decode, windows
from echogrid.operators import geo, imaging, measure, preview, register, signal
from echogrid.streaming import frames

C = 299792458.0


#: Published responses of ideal windows (half-power width in bins, PSLR and ISLR in dB).
TAYLOR_424 = (1.18416, -35.167, -27.131)
SINC = (0.88589294, -13.26146)


def response(spark, values, spacing=1.0, bounds=None, strict=True):
    frame = spark.createDataFrame([([float(v) for v in np.abs(values)],)], "line array<double>")
    return frame.select(measure.impulse_response(F.col("line"), spacing, bounds, strict).alias("r")).first()["r"]


def test_windows(spark):
    assert windows.hann(2).tolist() == [1, 1]
    assert windows.taylor(64, 5, 40).mean() == pytest.approx(1, abs=1e-9)
    assert windows.hamming(1, 0) == pytest.approx(0.08)
    row = spark.range(1).select(windows.hann_array(5)).first()[0]
    assert row == pytest.approx(np.hanning(5).tolist())
    for name in ("hann", "taylor", "none"):
        got = spark.range(9).select(windows.weight_at(F.col("id"), F.lit(9), name), windows.weight_sum(F.lit(9), name)).collect()
        assert [r[0] for r in got] == pytest.approx(windows.window(9, name).tolist())
        assert got[0][1] == pytest.approx(windows.window(9, name).sum())
    flat = np.array([4.0, 1.0])
    assert windows.shaped(flat, 2.0).tolist() == [2, 1]
    assert windows.shaped(flat, 1.0, "sum").sum() == pytest.approx(1)
    assert np.sqrt((windows.shaped(flat, 1.0, "totalpower") ** 2).mean()) == pytest.approx(1)
    cut = np.abs(np.fft.fft(windows.taylor(424), 424 * 64))
    found = response(spark, np.fft.fftshift(cut), 1 / 64)
    assert found.width == pytest.approx(TAYLOR_424[0], abs=2e-3)
    assert found.pslr_db == pytest.approx(TAYLOR_424[1], abs=0.02)
    assert found.islr_db == pytest.approx(TAYLOR_424[2], abs=0.05)


def test_impulse_response(spark):
    x = np.linspace(-16, 16, 32001)
    found = response(spark, np.sinc(x), 0.001)
    assert (found.peak, found.left, found.right) == (16000, 15000, 17000)
    assert found.width == pytest.approx(SINC[0], abs=2e-6)
    assert found.pslr_db == pytest.approx(SINC[1], abs=1e-4)
    power = np.array([1, 4, 0, 25, 100, 25, 0, 9, 1]) / 100
    lobe = response(spark, np.sqrt(power), 2, (2, 6))
    assert lobe.width == pytest.approx(8 / 3)
    assert lobe.pslr == pytest.approx(0.09)
    assert lobe.islr == pytest.approx((power[:2].sum() + power[7:].sum()) / power[2:7].sum())
    lone = response(spark, [0, 0, 0, 1, 0, 0, 0], bounds=(2, 4))
    assert (lone.pslr, lone.pslr_db) == (0, None)
    # a flat minimum counts by its middle
    flat = response(spark, [3, 1, 1, 1, 2, 9, 2, 0.5, 0.5, 4])
    assert (flat.left, flat.right) == (2, 7)
    assert response(spark, [1, 2, 3, 4, 5], strict=False) is None
    for bad in ([1, 2, 3, 4, 5], [0, 0, 0, 0, 0], [1, float("inf"), 0, 1, 2]):
        with pytest.raises(Exception, match="peak"):
            response(spark, bad)


def pulses_of(spark, points, count=17, radius=400.0, height=80.0, samples=64):
    """Frequency samples of point targets (x, y, z, amplitude) seen from an arc; made by Spark expressions."""
    axis = [9.6e9 + 2e7 * k for k in range(samples)]
    turn = F.radians(F.lit(-35.0) + F.col("id") * (70.0 / (count - 1)))
    seat = spark.range(count).select(F.col("id").cast("int").alias("pulse"), (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"), F.lit(height).alias("z"))
    seat = seat.withColumn("r0", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    parts = {"re": F.array_repeat(F.lit(0.0), samples), "im": F.array_repeat(F.lit(0.0), samples)}
    for px, py, pz, a in points:
        far = F.sqrt((F.col("x") - px) ** 2 + (F.col("y") - py) ** 2 + (F.col("z") - pz) ** 2) - F.col("r0")
        freq = F.lit(axis)
        parts["re"] = _add(parts["re"], freq, far, a, True)
        parts["im"] = _add(parts["im"], freq, far, a, False)
    return seat.withColumns(parts).select("pulse", "re", "im", "x", "y", "z", "r0"), np.array(axis)


def _add(held, freq, far, a, real):
    k = -4 * np.pi / C
    if real:
        return F.zip_with(held, freq, lambda v, f: v + a.real * F.cos(k * far * f) - a.imag * F.sin(k * far * f))
    return F.zip_with(held, freq, lambda v, f: v + a.real * F.sin(k * far * f) + a.imag * F.cos(k * far * f))


def apart(a, b):
    """The largest difference between two complex images (row, col, re, im), and how many pixels they share."""
    other = b.select("row", "col", F.col("re").alias("r2"), F.col("im").alias("i2"))
    return a.join(other, ["row", "col"]).agg(F.max(F.hypot(F.col("re") - F.col("r2"), F.col("im") - F.col("i2"))), F.count("*")).first()


def test_point_target(spark):
    amplitude = 0.7 + 1.1j
    pulses, f = pulses_of(spark, [(0.3, 0.2, 0.0, amplitude)])
    profiles, meta = signal.compress_phase_history(pulses, f, 64)
    grid = imaging.Grid((-0.6, 0.6, 25), (-0.6, 0.6, 25))
    image = imaging.backproject(grid, profiles, meta).cache()
    top = image.orderBy(F.desc(F.hypot("re", "im"))).first()
    assert (top["col"], top["row"]) == (18, 16)
    assert abs(complex(top["re"], top["im"]) - amplitude) < 1e-3
    assert imaging.self_check(image, grid, pulses, f) < 0.01
    points = grid.frame(spark)
    for other in (
        imaging.backproject(grid, profiles, meta, tile=7),
        imaging.backproject(grid, profiles, meta, tile=100, held=0),
        imaging.backproject(grid, profiles.drop("weight"), meta),
        imaging.backproject_points(points, profiles, meta, point_parts=3, pulse_parts=2),
    ):
        assert apart(image, other) == (pytest.approx(0, abs=1e-12), 625)
    direct = imaging.frequency_sums(pulses, points.where("row % 6 = 0 and col % 6 = 0"), f)
    assert apart(image, direct)[0] < 0.01
    with pytest.raises(ValueError, match="no signal"):
        imaging.self_check(image.withColumns({"re": F.lit(0.0), "im": F.lit(0.0)}), grid, pulses, f)
    with pytest.raises(ValueError, match="differs"):
        imaging.self_check(image.withColumn("re", F.col("re") * 2), grid, pulses, f)


def test_weights_follow_the_pulses(spark):
    rows = [(k, 0.0) for k in [5000, 3, 9, 4097, 12, 7]]
    found = signal.aperture_weights(spark.createDataFrame(rows, "pulse int, r0 double"), "hann").orderBy("pulse").collect()
    truth = np.hanning(6) / np.hanning(6).sum()
    assert [r.pulse for r in found] == [3, 7, 9, 12, 4097, 5000]
    assert [r.weight for r in found] == pytest.approx(truth.tolist())


def test_every_bin(spark):
    r = np.random.default_rng(841)
    x = r.standard_normal((3, 7)) + 1j * r.standard_normal((3, 7))
    frame = spark.createDataFrame([(i, v.real.tolist(), v.imag.tolist()) for i, v in enumerate(x)], "pulse int, re array<double>, im array<double>")
    out, meta = signal.compress_phase_history(frame, 3e9 + 1e6 * np.arange(7), 2, "none")
    k = np.arange(16) - 8
    truth = (x[:, None, :] * np.exp(2j * np.pi * k[:, None] * np.arange(7) / 16)).sum(2) / 7
    got = np.array([np.array(r.re) + 1j * np.array(r.im) for r in out.orderBy("pulse").collect()])
    assert np.abs(got - truth).max() < 2e-12
    assert meta["range_step_m"] == pytest.approx(C / (2e6 * 16))


def test_matched_filter(spark):
    r = np.random.default_rng(6)
    sent = np.exp(2j * np.pi * np.cumsum(np.linspace(-0.2, 0.2, 24)))
    x = r.standard_normal((3, 80)) + 1j * r.standard_normal((3, 80))
    x[1] = 0
    x[1, 17:41] = (0.3 - 0.4j) * sent
    rows = [(k, v.real.tolist(), v.imag.tolist(), 1e-6 * k) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "pulse int, re array<double>, im array<double>, receive_start_s double")
    for window in ("none", "hann"):
        w = windows.window(24, window)
        got = signal.compress_raw_echo(frame, sent, 1e8, window).orderBy("pulse").collect()
        for k, row in enumerate(got):
            padded = np.concatenate([x[k], np.zeros(24)])
            truth = [(padded[lag : lag + 24] * (sent * w).conj()).sum() / w.sum() for lag in range(80)]
            assert np.abs(np.array(row.re) + 1j * np.array(row.im) - truth).max() < 1e-12
            assert row.range_start_m == pytest.approx(C / 2 * 1e-6 * k)
        assert np.hypot(got[1].re, got[1].im).argmax() == 17
    with pytest.raises(ValueError, match="energy"):
        signal.compress_raw_echo(frame, np.zeros(4), 1e8)


def test_interpolation():
    n = np.arange(128)
    x = lambda n: 0.7 * np.exp(2j * np.pi * 0.18 * n) - 0.3j * np.exp(-2j * np.pi * 0.07 * n)
    at = np.linspace(10.01, 115.99, 173)
    sinc, line = (np.abs(signal.interpolate(x(n), at, m) - x(at)).max() for m in ("sinc", "linear"))
    assert sinc < 0.002
    assert sinc * 40 < line
    for method, bad in (("linear", -1e-12), ("linear", 127.000000000001), ("sinc", 6.99), ("sinc", 120.01), ("sinc", -1.0), ("sinc", 128.0)):
        with pytest.raises(ValueError):
            signal.interpolate(np.ones(128, complex), np.array([bad]), method)
    # whole places are samples, at the ends too
    whole = np.array([0.0, 5.0, 127.0])
    assert signal.interpolate(x(n), whole, "sinc").tolist() == x(n)[[0, 5, 127]].tolist()
    mixed = signal.interpolate(x(n), np.array([3.0, 40.25]), "sinc")
    assert mixed[0] == x(n)[3]
    assert abs(mixed[1] - x(40.25)) < 0.002


def test_interpolated_lines(spark):
    rows = [(1, [0.0, 1.0, 4.0], [0.0, 0.0, 2.0], [0.5, 2.0]), (2, [1.0, 2.0], [0.0, 0.0], [])]
    frame = spark.createDataFrame(rows, "k int, re array<double>, im array<double>, at array<double>")
    got = signal.interpolated(frame, "at").orderBy("k").collect()
    assert (got[0].at_re, got[0].at_im, got[1].at_re) == ([0.5, 4.0], [0.0, 2.0], [])
    with pytest.raises(Exception, match="swath"):
        signal.interpolated(frame.withColumn("at", F.lit([9.0])), "at").collect()


def test_focus(spark):
    pulses, f = pulses_of(spark, [(0.13, -0.21, 0.07, 0.7 - 0.4j)])
    error = 1.3 + 2.6 * F.sin(0.9 * F.col("pulse")) + 0.15 * F.col("pulse")
    turned = pulses.withColumn("e", error).withColumns({
        "re": F.zip_with("re", "im", lambda a, b: a * F.cos("e") - b * F.sin("e")),
        "im": F.zip_with("re", "im", lambda a, b: a * F.sin("e") + b * F.cos("e")),
    }).drop("e")
    fixed = signal.focus_pulses(turned, f, (0.13, -0.21, 0.07)).orderBy("pulse").collect()
    clean = pulses.orderBy("pulse").collect()
    for a, b in zip(fixed, clean):
        got, want = (np.array(r.re) + 1j * np.array(r.im) for r in (a, b))
        assert np.abs(got - want * np.exp(1.3j)).max() < 1e-8
        assert a.coherence == pytest.approx(1)


def line(spark, values):
    return spark.createDataFrame([([float(v) for v in values],)], "line array<double>")


def test_peaks(spark):
    s = line(spark, [0, 1, 0]).select(measure.pta_stats(F.col("line"), 3)).first()[0]
    assert (s.max_power, s.pos, s.irw, s.mslr, s.islr) == (1, 2, 2, 0, 0)
    p = line(spark, [0, 1, 0, 2, 0, 1.5, 0]).select(measure.local_peaks(F.col("line"), 7, 2, 1)).first()[0]
    assert [(x["index"], x.power) for x in p] == [(4, 2.0), (6, 1.5)]
    p = line(spark, [0, 3, 0, 2.5, 0, 1]).select(measure.local_peaks(F.col("line"), 6, 3, 3)).first()[0]
    assert [x["index"] for x in p] == [2]


def test_histogram_and_order(spark):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    counts = lambda v, n: dict(map(tuple, measure.histogram(frame(v), "v", n).collect()))
    assert counts([0, 0.5, 1, 1], 2) == {0: 2, 1: 2}
    assert counts([0, 1, 100], 2) == {0: 2, 1: 1}
    assert counts([5, 5, 5], 4) == {0: 3}
    v = np.random.default_rng(1).gamma(2, size=500).round(2)
    for values in (v, np.r_[v, 1e300, -1e300, np.full(300, 2.5)], np.full(40, 7.0)):
        for most in (5, 1_000_000):
            got = dict(map(tuple, measure.order_statistics(frame(values), "v", [0.0, 0.3, 1.0], most).collect()))
            assert got == {p: np.sort(values)[int(p * (len(values) - 1))] for p in (0.0, 0.3, 1.0)}
    assert measure.order_statistics(frame([float("nan")]), "v", [0.5]).count() == 0


def test_registration(spark):
    rows = [("s", 0, [0.0] * 4), ("s", 1, [1.0, 0.0, 0.0, 0.0]), ("s", 2, [0.0, 0.0, 0.0, 2.0]), ("s", 3, [0.0] * 4)]
    cut = spark.createDataFrame(rows, "k string, frame long, line array<double>").select("k", "frame", register.centroid(F.col("line"), 2, 2).alias("c")).select("k", "frame", "c.*")
    got = [(r.dx, r.dy, r.cum_dx, r.cum_dy) for r in register.register(cut, "k", "frame").orderBy("frame").collect()]
    assert got == [(0, 0, 0, 0), (0, 0, 0, 0), (-1, -1, -1, -1), (0, 0, -1, -1)]
    image = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 0.0), (1, 1, 0.0)], "row int, col int, value double")
    assert {(r.row, r.col): r.value for r in register.shift(image, -1, 0, 2, 2).collect()} == {(0, 0): 1.0, (1, 0): 0.0, (0, 1): 0.0, (1, 1): 0.0}
    assert line(spark, [0, 1, 0, 2]).select(measure.focus_metric(F.col("line"), 2, 2)).first()[0] == 3.0


def test_lookup(spark):
    blocks = spark.createDataFrame([(1, 0, 10), (2, 5, 3000)], "block int, first int, last int")
    lines = spark.createDataFrame([(2,), (3,), (9000,), (0,), (7,), (7,)], "line int")
    assert sorted((r.line, r.block) for r in geo.line_lookup(lines, blocks, "line").collect()) == [(0, 1), (2, 1), (3, 1), (7, 1), (7, 1)]


def test_grid_interpolation(spark):
    knots = spark.createDataFrame([(1, 10.0), (3, 20.0), (9000, 0.0), (5_000_000, 8.0)], "at int, v double")
    asked = [-50, 0, 1, 2, 3, 700, 9000, 9001, 4_000_000, 5_000_000, 6_000_000]
    lines = spark.createDataFrame([(x,) for x in asked], "line int")
    truth = {}
    at, v = [1, 3, 9000, 5_000_000], [10.0, 20.0, 0.0, 8.0]
    for x in asked:
        k = min(max(np.searchsorted(at, x, "right") - 1, 0), 2)
        truth[x] = v[k] + (x - at[k]) / (at[k + 1] - at[k]) * (v[k + 1] - v[k])
    for parts in (1, 4, 40):
        got = {r.line: r.v for r in geo.interpolate_lines(lines, "line", knots, "at", "v", parts=parts).collect()}
        assert got == pytest.approx(truth)
        assert got[9000] == 0.0
    single = geo.interpolate_lines(lines, "line", knots.limit(1), "at", "v").collect()
    assert {r.v for r in single} == {10.0}
    assert geo.latest(lines, "line", knots, "at").where("found is null").count() == 2
    none = geo.interpolate_lines(lines, "line", knots.limit(0), "at", "v").collect()
    assert [r.v for r in none] == [None] * len(asked)


def test_as_of_with_a_line_that_holds_most_rows(spark):
    """A line with most rows is dealt to several tasks; rows without a line find nothing; repeated rows stay."""
    r = np.random.default_rng(4)
    at = sorted(r.choice(5000, 300, replace=False).tolist())
    asked = [*r.integers(-100, 5200, 700).tolist(), *[2500] * 2000, None]
    rows = spark.createDataFrame([(x, k % 50) for k, x in enumerate(asked)], "line int, other int")
    table = spark.createDataFrame([(x, f"v{x}") for x in at], "at int, v string")
    found = geo.latest(rows, "line", table, "at", parts=8)
    assert found.columns == ["line", "other", "found"]
    want = {x: at[np.searchsorted(at, x, "right") - 1] if x is not None and x >= at[0] else None for x in asked}
    got = found.collect()
    assert sorted((x.line or -999, x.other) for x in got) == sorted((x or -999, k % 50) for k, x in enumerate(asked))
    assert all((x.found.at if x.found else None) == want[x.line] and (not x.found or x.found.v == f"v{x.found.at}") for x in got)
    buckets = geo._Buckets(rows.select("line"), 8)
    assert max(buckets.tasks) > 2
    pairs = sorted((x.low, x.high, x.v_low, x.v_high) for x in geo.knot_intervals(table, "at", "v", parts=7).collect())
    assert pairs == [(a, b, f"v{a}", f"v{b}") for a, b in zip(at, at[1:], strict=False)]


def test_grid_coordinates(spark):
    names = [f"{p}_{v}" for p in ("begin", "mid", "end") for v in ("lat", "lon", "ratio")]
    rows = [(1, *[float(10 * k) for k in range(9)]), (3, *[float(10 * k + 100) for k in range(9)])]
    grid = spark.createDataFrame(rows, ", ".join(["line int", *[f"{n} double" for n in names]]))
    asked = spark.createDataFrame([(2, 3), (2, 1), (2, 5), (2, 2), (1, 0), (1, 10), (0, 3), (9, 3)], "line int, pixel int")
    got = {(r.line, r.pixel): (r.latitude, r.longitude, r.ratio) for r in geo.grid_coordinates(asked, grid, 5).collect()}
    # lat is 0, 30, 60 at pixels 1, 3 and 5 of line 1, and 100 more at line 3
    assert got[2, 3] == (80.0, 90.0, 100.0)
    assert got[2, 1][0] == 50.0
    assert got[2, 5][0] == 110.0
    assert got[2, 2][0] == 65.0
    assert got[1, 0][0] == -15.0
    assert got[1, 10][0] == 60.0 + 5 * 15.0
    assert got[0, 3][0] == 30.0 - 50.0
    assert got[9, 3][0] == 30.0 + 400.0


def test_geodetic(spark):
    lon, lat, up = geo.scene_to_geodetic(F.lit(0.0), F.lit(0.0), F.lit(0.0), 35.2, -106.5, 1600.0)
    assert spark.range(1).select(lon, lat, up).first() == pytest.approx((-106.5, 35.2, 1600.0), abs=1e-8)
    lon, lat, _ = geo.scene_to_geodetic(F.lit(100.0), F.lit(0.0), F.lit(0.0), 0.0, 0.0, 0.0)
    assert spark.range(1).select(lon, lat).first() == pytest.approx((np.degrees(100 / geo.WGS84_A), 0.0), abs=1e-8)


def test_decoders(spark):
    assert decode.pixels(struct.pack(">4e", 3, 4, 0, -1), 2, 1, 6).tolist() == [[5.0, 1.0]]
    for bad in ((0, 1, 1), (1, 1, 9), (5, 5, 1)):
        with pytest.raises(ValueError):
            decode.pixels(b"\0\1", *bad)
    assert decode.iq_pairs(bytes([255, 2, 7])).tolist() == [-1 + 2j]
    x = np.array([1 / 3, -2.7, 1e9, 1e-8, np.nan], np.float32)
    assert np.frombuffer(decode.half_bytes(x), ">f2")[2] == np.inf
    word = spark.range(1).select(decode.base16_float(F.lit(0x42640000).cast("long"))).first()[0]
    assert word == 100.0
    stamp = 2011 << 52 | 7 << 48 | 14 << 43 | 9 << 38 | 5 << 32 | 59 << 26 | 250 << 16
    got = spark.range(1).select(decode.packed_time(F.lit(stamp >> 32), F.lit(stamp & 0xFFFFFFFF)).cast("string"), decode.packed_time(F.lit(0), F.lit(0))).first()
    assert tuple(got) == ("2011-07-14 09:05:59.25", None)
    for code in (0, 16384, 65535):
        v = cplx.mag_phase(F.lit(65535), F.lit(code))
        assert complex(*spark.range(1).select(v.re, v.im).first()) == pytest.approx(65535 * np.exp(2j * np.pi * code / 65536), abs=1e-6)


def test_preview(spark):
    got = spark.createDataFrame([(1.0,), (0.1,), (0.0,), (float("nan"),)], "v double").select(preview.gray_db(F.col("v"), F.lit(1.0), 40.0)).collect()
    assert [r[0] for r in got] == [255, 128, 0, 0]
    levels = [preview.gray_linear(F.lit(v), F.lit(1.0), F.lit(4.0)) for v in (1.0, 2.0, 4.0)]
    assert tuple(spark.range(1).select(*levels).first()) == (0, 85, 255)


def test_streams(spark, tmp_path):
    rows = [("s", i, float(i), 1.0, i % 3 * 1.0, 0.0) for i in range(10)]
    for k in range(2):
        spark.createDataFrame(rows[k * 5 : k * 5 + 5], "k string, frame long, value double, total double, cx double, cy double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = "k string, frame long, value double, total double, cx double, cy double"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    held = run(frames.latest_frames(source().withColumnRenamed("frame", "ts_ns"), "k", 3), "update", "held")
    assert {r.ts_ns for r in held} >= {7, 8, 9}
    moved = run(frames.registered(source(), "k"), "append", "moved")
    assert {r.frame: r.dx for r in moved} == {i: -(i % 3) for i in range(10)}
    best = run(frames.best_frames(source().select("k", "frame", F.col("value").alias("metric")), "k"), "append", "best")
    assert all(r.is_best for r in best)
    follows = {r.frame: r for r in run(frames.registered(source(), "k", 0.5), "append", "follows")}
    rx, want = 0.0, {0: 0}
    for i in range(1, 10):
        off = i % 3 - rx
        want[i] = int(np.copysign(np.floor(abs(off) + 0.5), -off))
        rx = 0.5 * rx + 0.5 * (i % 3)
    assert {i: r.dx for i, r in follows.items()} == want
    ends = {r.frame: r.converged for r in run(frames.best_frames(source().select("k", "frame", F.col("cx").alias("metric")), "k", 0.5, 9), "append", "ends")}
    assert ends == {i: i not in (1, 2) for i in range(10)}
    news = run(frames.changed(source().select("k", F.floor(F.col("frame") / 3).alias("version"), F.col("frame").alias("ts_ns"), "value"), "k"), "append", "news")
    assert sorted(r.ts_ns for r in news) == [0, 3, 6, 9]
    one = spark.createDataFrame([(2, 1.5)], "width int, value double")
    assert frames.repeated(spark, one).columns == ["version", "ts_ns", "width", "value"]
    assert frames.repeated(spark, one).isStreaming
    stats = run(frames.latencies(source().withColumn("latency", F.col("value") - 2), "k"), "complete", "stats")
    assert tuple(stats[0])[1:] == (8, 0.0, 7.0, 3.5)


def test_image_chain(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((4, 8)) + 1j * r.standard_normal((4, 8))
    lines = spark.createDataFrame([(i, v.real.tolist(), v.imag.tolist()) for i, v in enumerate(x)], "row int, re array<double>, im array<double>")
    got = np.zeros((4, 8))
    for p in signal.magnitude_image(lines).collect():
        got[p.row, p.col] = p.value
    assert np.abs(got - np.abs(np.fft.fft2(x))).max() < 1e-9


def test_targets(spark):
    from echogrid.operators import targets

    image = spark.range(25).select((F.col("id") / 5).cast("int").alias("row"), (F.col("id") % 5).cast("int").alias("col"), F.when(F.col("id") == 6, 10.0).when(F.col("id") == 18, 8.0).otherwise(0.0).alias("value"))
    found = targets.strongest_targets(image, 5, 5, 4)
    assert [(t.row, t.col, t.value, t.valid) for t in found] == [(1, 1, 10.0, True), (3, 3, 8.0, True)]
    stats = targets.target_statistics(image, found).orderBy("nth").collect()
    assert [(r.nth, r.x.max_power, r.x.pos, r.y.pos) for r in stats] == [(0, 10.0, 2, 2), (1, 8.0, 2, 2)]
    assert targets.target_statistics(image, []).count() == 0
    assert targets.centre_chip(image, 5, 5, 3).agg(F.max("value")).first()[0] == 10.0
    assert targets.chip_around(image, 0, 0, 3).count() == 4
