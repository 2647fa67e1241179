"""The older image chain, measurements of images, geocoding and previews against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.functions import windows
from echogrid.operators import chain, geo, measure, preview, signal
from echogrid.sources import configs, rpf


def lines_of(spark, x):
    return spark.createDataFrame([(i, v.real.tolist(), v.imag.tolist()) for i, v in enumerate(np.asarray(x, complex))], "row int, re array<double>, im array<double>")


def pixels_of(spark, matrix):
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(matrix) for c, v in enumerate(line)], "row int, col int, value double")


def matrix_of(df, rows, cols):
    out = np.full((rows, cols), np.nan)
    for r in df.collect():
        out[r.row, r.col] = r.value
    return out


def complex_of(df):
    return np.array([np.array(r.re) + 1j * np.array(r.im) for r in df.orderBy("row").collect()])


def taper(n, count):
    w = np.ones(count)
    for i in range(min(n, count // 2)):
        w[i] = w[count - 1 - i] = 0.5 - 0.5 * np.cos(np.pi * (i + 1) / (min(n, count // 2) + 1))
    return w


def test_steps(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((5, 6)) + 1j * r.standard_normal((5, 6))
    lines = lines_of(spark, x)
    assert np.allclose(complex_of(chain.collapse_rows(lines, 2, 5)), (x[0:4:2] + x[1:4:2]) / 2)
    assert complex_of(chain.collapse_rows(lines, 9, 5)).shape == (5, 6)
    padded = np.zeros((8, 9), complex)
    padded[1:6, 1:7] = x
    assert np.allclose(complex_of(chain.centre_pad(lines, 5, 6, 8, 9)), padded)
    assert np.allclose(complex_of(chain.remove_dc(lines)), x - x.mean())
    w, v = np.arange(1.0, 7), np.arange(2.0, 7)
    assert np.allclose(complex_of(chain.apply_window(lines, w)), x * w)
    assert np.allclose(complex_of(chain.apply_window(lines, v, "rows")), x * v[:, None])
    assert np.allclose(complex_of(chain.apply_window(lines, v, "cols", 6)), x)
    assert np.allclose(complex_of(chain.taper_rows(lines, 2, 5)), x * taper(2, 5)[:, None])
    image = np.abs(x)
    assert np.allclose(matrix_of(chain.image_edge_taper(pixels_of(spark, image), 2, 5, 6), 5, 6), image * taper(2, 5)[:, None] * taper(2, 6))
    assert np.allclose(matrix_of(chain.row_agc(pixels_of(spark, image)), 5, 6), image / image.mean(1, keepdims=True))
    blended = chain.tile_blend(pixels_of(spark, image), 5, 6, chain.tile_layout(5, 6, 2, 2, 1))
    assert np.allclose(matrix_of(blended, 5, 6), image)
    assert blended.agg(F.max("tiles")).first()[0] == 4


def test_demonstration_image(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((6, 9))
    s = chain.Settings(collapse_cols=2, collapse_rows=2, pad_cols=2, pad_rows=1, stc=True, range_taper=1, azimuth_taper=1, agc=True, edge_taper=1)
    image, rows, cols = chain.demonstration_image(lines_of(spark, x), 6, 9, s)
    assert (rows, cols) == (3, 4)
    y = x[:, :8].reshape(6, 4, 2).mean(2).reshape(3, 2, 4).mean(1)
    wide = np.zeros((5, 6))
    wide[1:4, 1:5] = y
    wide = (wide - wide.mean()) * (0.5 + 0.5 * np.arange(6) / 5) * taper(1, 6) * taper(1, 5)[:, None] * windows.hamming(6) * windows.hamming(5)[:, None]
    truth = np.abs(np.fft.fft2(wide))[1:4, 1:5]
    truth = truth / truth.mean(1, keepdims=True) * taper(1, 3)[:, None] * taper(1, 4)
    assert np.allclose(matrix_of(image, 3, 4), truth)


def test_stream_input(spark, tmp_path):
    image = np.arange(12.0).reshape(4, 3)
    grid = [(11, 1.0, 1.0, 1.0, *[0.0] * 6), (14, 1.0, 1.0, 1.0, *[0.0] * 6)]
    rpf.write(pixels_of(spark, image), f"{tmp_path}/s_1.rpf", 4, 3, 3, sections={"file_id": {"radar_mode": 2}}, grid=grid)
    catalog = rpf.catalog(spark, str(tmp_path))
    assert np.array_equal(complex_of(chain.stream_input(catalog, 12, first=12, most=2)).real, image[1:3])
    assert complex_of(chain.stream_input(catalog)).shape == (4, 3)
    gap = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "line int, pixels array<float>")
    with pytest.raises(Exception, match="missing"):
        chain.input_slice(gap).collect()


def test_chip_report(spark):
    chip = pixels_of(spark, [[0, 1, 0], [0, 3, 0], [0, 1, 0]])
    config = configs.Analysis(max_peaks=2, histogram_bins=3, analyze2_d=True, use_iqa2_d=True, power_detection="power", mag_factor=1)
    report = chain.chip_report(spark, chip, config)
    assert report["chip"] == {"rows": 3, "cols": 3}
    assert (report["pta"]["stats"]["max_power"], report["pta"]["stats"]["pos"]) == (pytest.approx(5), 2)
    assert report["pta"]["peaks"] == [{"power": 5.0, "index": 2}]
    assert report["histogram"] == [8, 0, 1]
    assert [report["pta2d"][a]["max_power"] for a in "xy"] == [5, 3]
    assert report["iqa"]["stats"]["max_power"] == pytest.approx(25)
    assert report["iqa"]["image"]["x"]["max_power"] == 11
    column = chain.chip_report(spark, pixels_of(spark, [[0], [2], [0]]), configs.Analysis())
    assert (column["pta"]["stats"]["pos"], "iqa" in column) == (2, False)


def test_zoom_and_statistics(spark):
    n = np.arange(32)
    x = 2 + np.cos(2 * np.pi * 3 * n / 32)
    frame = spark.createDataFrame([(1, x.tolist())], "k int, line array<double>")
    zoomed = np.array(signal.zoom(frame, "line", 4, "k").first()["zoomed"])
    at = np.arange(128) / 4
    assert np.allclose(zoomed * 4, 2 + np.cos(2 * np.pi * 3 * at / 32))
    assert len(signal.zoom(frame, "line", 1, "k", size=40).first()["zoomed"]) == 40
    found = measure.zoom_analysis(frame, "line", 32, "k", factor=4, most=2).first()
    assert found.stats.max_power == pytest.approx(0.75)
    assert len(found.peaks) == 2
    quality = measure.image_quality(frame, "line", 32, "k", detection="other").first()
    assert quality.stats.max_power == pytest.approx(3)
    assert [spark.range(1).select(measure.wavelength(F.lit(v))).first()[0] for v in (2.0, 0.0)] == [signal.C / 2, 0.0]
    for bad in (-1.0, float("nan"), 1e39):
        with pytest.raises(Exception, match="magnitude"):
            spark.range(1).select(measure.narrowed(F.lit(bad))).collect()


def test_utm(spark):
    #: A quarter of the meridian's length, and the length to 45 degrees, in metres (WGS84).
    places = [(-105.0, 45.0, 500000.0, 0.9996 * 4984944.378), (-105.0, 0.0, 500000.0, 0.0)]
    for lon, lat, e, n in places:
        assert spark.range(1).select(*geo.to_utm(F.lit(lon), F.lit(lat), 32613)).first() == pytest.approx((e, n), abs=2e-3)
    rows = spark.createDataFrame([(float(x), float(y)) for x in (-108, -105, -102.5) for y in (-79, -10, 0.5, 60, 80)], "lon double, lat double").withColumn("epsg", geo.utm_zone(F.col("lon"), F.col("lat")))
    east, north = geo.to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    back = rows.withColumns({"e": east, "n": north})
    lon, lat = geo.from_utm(F.col("e"), F.col("n"), F.col("epsg"))
    worst = back.agg(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-8


def test_geocode(spark):
    rows, cols = 40, 30
    a = (1e-4, 0.0, -105.01, 0.0, -1e-4, 35.3)
    r, c = np.mgrid[:rows, :cols]
    image = 100.0 + 2 * r + 3 * c
    image[5, 5] = np.nan
    got, grid = geo.geocode(pixels_of(spark, image), a, rows, cols)
    assert grid["epsg"] == 32613
    lon, lat = geo.from_utm(F.lit(grid["left"]) + (F.col("col") + 0.5) * grid["pixel_m"], F.lit(grid["top"]) - (F.col("row") + 0.5) * grid["pixel_m"], 32613)
    back = got.withColumns({"c": (lon - a[2]) / a[0] - 0.5, "r": (lat - a[5]) / a[4] - 0.5}).collect()
    good = [x for x in back if not np.isnan(x.value)]
    assert len(good) > 0.8 * len(back) > 400
    assert max(abs(x.value - (100 + 2 * x.r + 3 * x.c)) for x in good) < 1e-6
    bad = [x for x in back if np.isnan(x.value)]
    assert bad
    assert all(abs(x.r - 5) < 1 and abs(x.c - 5) < 1 for x in bad)


def test_places(spark):
    lattice = geo.control_lattice(spark, 9, 3, (-10.0, 10.0), (-20.0, 20.0), 35.2, -106.5, 1600.0).collect()
    assert len(lattice) == 15
    middle = next(p for p in lattice if (p.row, p.col) == (4.5, 1.5))
    assert (middle.lon, middle.lat, middle.up) == pytest.approx((-106.5, 35.2, 1600.0), abs=1e-8)
    at = spark.createDataFrame([(1.0, 1.0), (9.0, 0.0)], "row double, col double")
    got = geo.frame_coordinates(at, [0.0, 2.0], [0.0, 2.0], [[179.0, -179.0], [179.0, -179.0]], [[1.0, 1.0], [0.0, 0.0]]).collect()
    assert abs(got[0].lon) == pytest.approx(180)
    assert got[0].lat == 0.5
    assert (got[1].lon, got[1].lat) == (None, None)
    off = spark.createDataFrame([(0.0, 0.0, 0.0, 0.001), (0.0, 0.0, 0.0, 0.0)], "lon double, lat double, grid_lon double, grid_lat double")
    assert geo.knot_residual(off).first()[0] == pytest.approx(6371008.8 * np.deg2rad(0.001))
    x, y = geo.affine(F.lit(0), F.lit(0), (2.0, 0.0, 10.0, 0.0, -2.0, 20.0))
    assert tuple(spark.range(1).select(x, y).first()) == (11.0, 19.0)
    masked = [spark.range(1).select(geo.merged_mask(F.lit(v), -1.0, F.lit(m))).first()[0] for v, m in ((0.0, 1), (-1.0, 1), (3.0, 0), (float("inf"), 1))]
    assert masked[0] == 0
    assert all(np.isnan(v) for v in masked[1:])


def test_previews(spark):
    image = np.arange(35.0).reshape(5, 7)
    image[0, 0] = np.nan
    small = matrix_of(preview.reduced(pixels_of(spark, image), 5, 7, 2, 3), 2, 3)
    rows, cols = [int(k * 5 / 2) for k in range(3)], [int(k * 7 / 3) for k in range(4)]
    truth = [[np.sqrt(np.nanmean(image[rows[i] : rows[i + 1], cols[j] : cols[j + 1]] ** 2)) for j in range(3)] for i in range(2)]
    assert np.allclose(small, truth)
    turning = spark.createDataFrame([(r, c, float(np.cos(r * 7 + c)), float(np.sin(r * 7 + c)) if (r, c) != (0, 0) else 0.0) for r in range(5) for c in range(7)], "row int, col int, re double, im double")
    phase = matrix_of(preview.centre_phase(turning, 5, 7, 2, 3), 2, 3)
    for i in range(2):
        for j in range(3):
            r, c = (rows[i] + rows[i + 1] - 1) // 2, (cols[j] + cols[j + 1] - 1) // 2
            assert phase[i, j] == pytest.approx(np.angle(np.exp(1j * (r * 7 + c))) if (r, c) != (0, 0) else 0.0)
    assert preview.reduced_shape(3200, 100, 1600) == (1600, 50)
    assert preview.reduced_shape(10, 5000, 512, aspect=False) == (10, 512)
    assert preview.datagram_shape(10, 10) == (10, 10)
    h, w = preview.datagram_shape(1000, 500)
    assert h * w <= (65507 - 16) // 4 < (h + 1) * (w + 1)
    assert preview.datagram_shape(1, 10**6) == (1, 16372)
    small, h, w = preview.datagram_frame(pixels_of(spark, np.arange(60.0).reshape(6, 10)), 6, 10, 4 * 15)
    assert (h, w) == (3, 5)
    assert sorted((p.row, p.col, p.value) for p in small.collect()) == [(r, c, 10.0 * (2 * r) + 2 * c) for r in range(3) for c in range(5)]
    near = preview.nearest(pixels_of(spark, np.arange(12.0).reshape(3, 4)), 3, 4, 2, 2)
    assert np.array_equal(matrix_of(near, 2, 2), [[0, 2], [4, 6]])
    colours = lambda v, m: tuple(spark.range(1).select(preview.coloured(F.lit(v), m).alias("c")).select("c.*").first())
    assert colours(0.5, "gray") == (128, 128, 128, 255)
    assert colours(0.0, "inverted") == (255, 255, 255, 255)
    assert colours(1 / 3, "hot") == (255, 0, 0, 255)
    assert colours(0.25, "turbo") == (50, 126, 184, 255)
    assert colours(float("nan"), "turbo") == (0, 0, 0, 0)
    stages = spark.createDataFrame([("raw", False, "none kept"), ("formed", True, None)], "stage string, available boolean, reason string")
    got = {r.panel: (r.stage, r.reason) for r in preview.panels(stages, {"a": ["raw", "formed"], "b": ["raw", "other"]}).collect()}
    assert got == {"a": ("formed", None), "b": (None, "none kept")}


def test_nearest_of_every_size(spark):
    """All pairs of sizes below 100, in one frame: the rows of an image of one column."""
    got = {}
    for n in (1, 7, 50, 64, 99):
        image = spark.range(n).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.col("id").alias("value"))
        for m in (1, 2, 14, 37, 50, 63, 98, 120):
            got[n, m] = sorted((p.row, p.value) for p in preview.nearest(image, n, 1, m, 1).collect())
    for (n, m), rows in got.items():
        m = min(n, m)
        assert rows == [(i, i * n // m) for i in range(m)], (n, m)
    # the whole numbers behind it, for all pairs
    for n in range(1, 100):
        for m in range(1, n + 1):
            first = [(row * m + n - 1) // n for row in range(n)]
            assert [(r, row) for row, r in enumerate(first) if r < m and r * n // m == row] == [(i, i * n // m) for i in range(m)]
