"""Elevation models of every packing, and surfaces on models in tiles."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import geo, terrain
from echogrid.sources import elevation


def packed_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it; the table starts anew when it is full."""
    out, bits, width, have = 0, 0, 9, b""
    table = {bytes([k]): k for k in range(256)}
    after = 258

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    put(256)
    for k in range(len(data)):
        one = data[k : k + 1]
        if have + one in table:
            have += one
            continue
        put(table[have])
        table[have + one] = after
        after += 1
        if after == 4095:
            put(256)
            table, after, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
        have = one
    if have:
        put(table[have])
        after += 1
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
    put(257)
    pad = -bits % 8
    return (out << pad).to_bytes((bits + pad) // 8, "big")


def tiff(values, order="<", tile=None, strip=4, compression=1, predictor=1, notes=(), epsg=4326, origin=(10.0, 50.0), step=(0.1, 0.2)):
    rows, cols = values.shape
    height, width = tile or (strip, cols)
    blocks = []
    for i in range(0, rows, height):
        for j in range(0, cols, width):
            full = np.zeros((height if tile else min(height, rows - i), width), values.dtype)
            part = values[i : i + height, j : j + width]
            full[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                whole = full.view(f"u{full.dtype.itemsize}")
                full = np.diff(whole, axis=1, prepend=whole.dtype.type(0)).view(full.dtype)
            raw = full.astype(full.dtype.newbyteorder(order)).tobytes()
            if predictor == 3:
                each = full.astype(full.dtype.newbyteorder(">")).view(np.uint8).reshape(len(full), width, -1).transpose(0, 2, 1).reshape(len(full), -1)
                raw = np.diff(each, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
            blocks.append({1: lambda x: x, 5: packed_lzw, 8: zlib.compress}[compression](raw))
    kind = {"f": 3, "i": 2, "u": 1}[values.dtype.kind]
    note = f'<GDALMetadata><Item name="UNITTYPE" sample="0" role="unittype">metre</Item>{"".join(notes)}</GDALMetadata>\0'.encode()
    at = np.cumsum([8, *map(len, blocks)]).tolist()
    projected = epsg > 30000
    tags = [(256, 3, [cols]), (257, 3, [rows]), (258, 3, [8 * values.dtype.itemsize]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [kind])]
    tags += [(322, 3, [width]), (323, 3, [height]), (324, 4, at[:-1]), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, at[:-1]), (278, 3, [height]), (279, 4, [len(b) for b in blocks])]
    tags += [(33550, 12, [*step, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, 3072 if projected else 2048, 0, 1, epsg]), (42112, 2, list(note)), (42113, 2, list(b"-9999\0"))]
    tags.sort()
    end = at[-1] + at[-1] % 2
    place, behind, directory = end + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, v in tags:
        raw = struct.pack(f"{order}{len(v)}{ {2: 'B', 3: 'H', 4: 'I', 12: 'd'}[code] }", *v)
        directory += struct.pack(f"{order}HHI", tag, code, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", place + len(behind)))
        behind += raw if len(raw) > 4 else b""
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, end)
    return head + b"".join(blocks) + bytes(end - at[-1]) + struct.pack(f"{order}H", len(tags)) + directory + bytes(4) + behind


PACKINGS = [("<", None, 1, 1, "f4"), (">", (16, 16), 1, 1, "i2"), ("<", (16, 32), 8, 2, "i2"), (">", (16, 16), 8, 3, "f4"), ("<", (16, 16), 5, 2, "u2"), (">", None, 5, 1, "f8"), ("<", None, 8, 3, "f8"), ("<", (32, 16), 5, 3, "f4"), (">", None, 8, 2, "i4")]


@pytest.mark.parametrize("packing", PACKINGS)
def test_every_packing_gives_the_same_heights(spark, tmp_path, packing):
    order, tile, compression, predictor, kind = packing
    r = np.random.default_rng(3)
    values = (100 + 40 * r.standard_normal((50, 41)).cumsum(0)).clip(0, 9000).astype(kind)
    if np.dtype(kind).kind != "u":
        values[7, 9] = -9999
    (tmp_path / "m.tif").write_bytes(tiff(values, order, tile, 7, compression, predictor))
    x = elevation.layout(f"{tmp_path}/m.tif")
    want = np.where(values == -9999, np.nan, values.astype(float))
    got = np.array([v.value for v in elevation.rows(spark, f"{tmp_path}/m.tif", 3, 47, 8).orderBy("row").collect()])
    assert np.array_equal(got, want[3:47], equal_nan=True)
    assert np.array_equal(elevation.heights(x, 13, 31, 15, 34), want[13:31, 15:34], equal_nan=True)
    for t in elevation.tiles(spark, f"{tmp_path}/m.tif", 16).collect():
        tile = np.frombuffer(t.heights, float).reshape(17, 17)
        own = want[16 * t.tile_row : 16 * t.tile_row + 17, 16 * t.tile_col : 16 * t.tile_col + 17]
        assert np.array_equal(tile[: own.shape[0], : own.shape[1]], own, equal_nan=True)
        assert np.isnan(tile[own.shape[0] :]).all()


def test_scale_and_offset(spark, tmp_path):
    values = np.arange(30, dtype=np.int16).reshape(6, 5)
    values[0, 0] = -9999
    note = ['<Item name="SCALE" sample="0" role="scale">0.5</Item>', '<Item name="OFFSET" sample="0" role="offset">-10</Item>']
    (tmp_path / "s.tif").write_bytes(tiff(values, notes=note))
    got = np.array([v.value for v in elevation.rows(spark, f"{tmp_path}/s.tif").orderBy("row").collect()])
    assert np.isnan(got[0, 0])
    assert got[1:].tolist() == (values[1:] * 0.5 - 10).tolist()
    for bad in ("0", "inf", "nan"):
        (tmp_path / f"{bad}.tif").write_bytes(tiff(values, notes=[f'<Item name="SCALE" role="scale">{bad}</Item>']))
        with pytest.raises(ValueError, match="scale"):
            elevation.layout(f"{tmp_path}/{bad}.tif")
    (tmp_path / "p.tif").write_bytes(tiff(values, epsg=31467))
    with pytest.raises(ValueError, match="31467"):
        elevation.layout(f"{tmp_path}/p.tif")
    with pytest.raises(ValueError, match="terrain"):
        terrain.bilinear(np.full((3, 3), 2e5), np.array([1.0]), np.array([1.0]))


ORIGIN = (49.5, 10.3, 300.0, 75.0)


def scene(spark, n=40):
    at = spark.range(n * n).select(F.col("id"), ((F.col("id") % n) * 100.0 - 2000).alias("x"), (F.floor(F.col("id") / n) * 100.0 - 2000).cast("double").alias("y"), F.lit(0.0).alias("z"))
    return at.repartition(3)


@pytest.mark.parametrize("epsg", [4326, 32632])
def test_tiles_give_the_surface_of_the_whole_model(spark, tmp_path, epsg):
    r, c = np.mgrid[0:200, 0:180]
    values = (300 + 80 * np.sin(r / 9.0) * np.cos(c / 7.0) + c).astype(np.float32)
    if epsg == 4326:
        place = {"origin": (10.2, 49.56), "step": (0.001, 0.0006)}
    else:
        east, north = terrain.utm(np.array([10.2]), np.array([49.56]), epsg)
        place = {"origin": (float(east[0]), float(north[0])), "step": (75.0, 68.0)}
    (tmp_path / "m.tif").write_bytes(tiff(values, tile=(64, 64), compression=8, predictor=3, epsg=epsg, **place))
    model = elevation.layout(f"{tmp_path}/m.tif")
    points = scene(spark)
    whole = {x.id: x.z for x in terrain.surface(points, values.astype(float), model.affine, ORIGIN, epsg=epsg).collect()}
    # small tiles and parts: points of one tile lie in several tasks, and some pass from tile to tile
    by_tiles = {x.id: x.z for x in terrain.surface_by_tiles(points, model, ORIGIN, size=5, most=7).collect()}
    assert by_tiles.keys() == whole.keys()
    assert max(abs(by_tiles[k] - whole[k]) for k in whole) < 3e-4
    assert max(whole.values()) - min(whole.values()) > 50
    one = terrain.surface_by_tiles(points, model, ORIGIN, size=256)
    assert one.columns == points.columns
    assert max(abs(x.z - whole[x.id]) for x in one.collect()) < 3e-4


def test_tiles_fail_closed(spark, tmp_path):
    values = np.full((40, 40), 200, np.float32)
    values[20, 20] = -9999
    (tmp_path / "m.tif").write_bytes(tiff(values, origin=(10.2, 49.55), step=(0.005, 0.0025)))
    model = elevation.layout(f"{tmp_path}/m.tif")
    with pytest.raises(Exception, match="height is missing"):
        terrain.surface_by_tiles(scene(spark), model, (49.5, 10.3, 300.0, 75.0), size=16).count()
    with pytest.raises(Exception, match="outside"):
        terrain.surface_by_tiles(scene(spark), model, (48.0, 10.3, 300.0, 75.0), size=16).count()
    assert terrain.surface_by_tiles(scene(spark).limit(0), model, ORIGIN).collect() == []


def test_utm_of_arrays_and_columns(spark):
    lon, lat = np.array([10.2, 8.9, 12.0, -70.0]), np.array([49.5, -3.0, 61.2, 12.0])
    for epsg in (32632, 32733):
        east, north = terrain.utm(lon, lat, epsg)
        rows = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist(), strict=True)), "lon double, lat double").select(*geo.to_utm(F.col("lon"), F.col("lat"), epsg)).collect()
        assert np.allclose([list(x) for x in rows], np.stack([east, north], 1), atol=1e-6)


CONTROL = [(r + 0.5, c + 0.5, 10.0 + 0.0011 * c + 0.00006 * r + 1e-6 * c * r / 30, 49.7 - 0.0007 * r + 0.00005 * c + 2e-6 * (c - 20) ** 2) for r in (0, 20, 39, 59) for c in (0, 15, 30, 49)]


def test_the_way_back_equals_a_dense_search():
    way = terrain.ControlMap(CONTROL, 60, 50, cells=8)
    fine = np.stack(np.meshgrid(np.linspace(0, 59, 1181), np.linspace(0, 49, 981), indexing="ij"), 2).reshape(-1, 2)
    plane = way.to_plane(fine)
    r = np.random.default_rng(1)
    asked = way.to_plane(r.random((60, 2)) * [59, 49])
    got = way.back(asked)
    for p, g in zip(asked, got, strict=True):
        near = fine[np.argmin(((plane - p) ** 2).sum(1))]
        assert np.abs(near - g).max() <= 0.05
        assert np.abs(way.to_plane(g[None])[0] - p).max() < 1e-3
    # places beside the image have no pixel
    low, high = way.extent()
    assert np.isnan(way.back(np.array([low - 500, high + 500]))).all()
    slope, h = way.to_plane.slopes(fine[5000:5003]), 1e-3
    for a in (0, 1):
        step = np.eye(2)[a] * h
        assert np.allclose(slope[:, a], (way.to_plane(fine[5000:5003] + step) - way.to_plane(fine[5000:5003] - step)) / (2 * h), atol=1e-3)


def test_geocoding_by_control_points(spark):
    rows, cols = 60, 50
    values = np.add.outer(np.arange(rows) * 3.0, np.arange(cols) * 2.0)
    values[30, 30] = np.nan
    image = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(rows) for c in range(cols)], "row int, col int, value double")
    found, grid = terrain.geocode_control(image, CONTROL, rows, cols, 60.0, tile=32)
    assert grid["epsg"] == 32632
    way = terrain.ControlMap(CONTROL, rows, cols)
    got = {(x.row, x.col): x.value for x in found.collect()}
    holes = 0
    for (r, c), v in got.items():
        at = way.back(np.array([[grid["left"] + (c + 0.5) * 60, grid["top"] - (r + 0.5) * 60]]))[0]
        if np.isnan(v):
            holes += 1
            assert np.abs(at - [30, 30]).max() < 1
        else:
            assert v == pytest.approx(3 * at[0] + 2 * at[1], abs=1e-6)
    assert holes > 0
    inside = way.back(np.stack([x.ravel() for x in np.meshgrid(grid["left"] + (np.arange(grid["cols"]) + 0.5) * 60, grid["top"] - (np.arange(grid["rows"]) + 0.5) * 60)], 1))
    assert len(got) == np.isfinite(inside[:, 0]).sum() > 500
    # an affine image: both ways agree
    a = (0.001, 0.0, 10.0, 0.0, -0.0007, 49.7)
    exact = [(r + 0.5, c + 0.5, a[0] * (c + 0.5) + a[2], a[4] * (r + 0.5) + a[5]) for r in range(0, 60, 3) for c in range(0, 50, 7)]
    one, grid = geo.geocode(image, a, rows, cols, 80.0)
    two, other = terrain.geocode_control(image, exact, rows, cols, 80.0)
    assert abs(grid["left"] - other["left"]) < 5
    assert abs(grid["top"] - other["top"]) < 5
    both = {(x.row, x.col): x.value for x in one.collect()}
    shift = [abs(both[x.row, x.col] - x.value) for x in two.collect() if (x.row, x.col) in both and not np.isnan(x.value) and not np.isnan(both[x.row, x.col])]
    assert len(shift) > 500
    assert max(shift) < 0.5
    with pytest.raises(ValueError):
        terrain.geocode_control(image, CONTROL, rows, cols, 0.0)


def test_geolocation_grids_across_the_date_line(spark):
    """Knots of an affine map have no residual, whichever side of the date line they lie on; those of a bent one have what plain loops give."""
    images = spark.createDataFrame([(1, 100, 40, 179.99, 0.0), (2, 7, 3, -0.5, 0.0), (3, 2, 200, 179.9, 2e-7), (4, 500, 2, 10.0, 1e-7)], "id int, rows int, cols int, west double, bend double")
    located = geo.knot_places(images, F.col("rows"), F.col("cols"))
    bend = F.col("bend") * F.col("row") * F.col("col")
    located = located.withColumn("lon", geo.wrapped(F.col("west") + 0.001 * F.col("col") + 100 * bend)).withColumn("lat", 60.0 - 0.0005 * F.col("row") + bend)
    knots, residuals = geo.knot_grid(located, "id")
    error = {x.id: x.interpolation_error_m for x in residuals.collect()}
    assert error[1] < 1e-6
    assert error[2] < 1e-6
    for x in images.collect():
        n, m = min(x.rows, 33), min(x.cols, 33)
        own = {(k.i, k.j): k for k in knots.where(f"id = {x.id}").collect()}
        assert len(own) == n * m
        assert (own[n - 1, m - 1].row, own[n - 1, m - 1].col) == (x.rows - 1, x.cols - 1)
        place = lambda r, c: (x.west + 0.001 * c + 100 * x.bend * r * c, 60 - 0.0005 * r + x.bend * r * c)  # noqa: B023, E731
        worst = 0.0
        for i in range(n - 1):
            for j in range(m - 1):
                four = [place(own[i + a, j + b].row, own[i + a, j + b].col) for a in (0, 1) for b in (0, 1)]
                lon, lat = (sum(v[k] for v in four) / 4 for k in (0, 1))
                at = place((own[i, j].row + own[i + 1, j].row) / 2, (own[i, j].col + own[i, j + 1].col) / 2)
                worst = max(worst, 6371008.8 * np.hypot(np.deg2rad(lat - at[1]), np.deg2rad(lon - at[0]) * np.cos(np.deg2rad(at[1]))))
        assert error[x.id] == pytest.approx(worst, abs=1e-6)
        assert all(abs(k.flat - (own[0, 0].lon + place(k.row, k.col)[0] - place(0, 0)[0])) < 1e-9 for k in own.values())


def test_a_frame_with_its_geolocation(spark, tmp_path):
    from echogrid.sources import frames, products

    image = spark.range(60 * 50).select((F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), (F.col("id") % 7 + 1.0).alias("value"))
    where = geo.frame_geolocation(spark, lambda pixels: terrain.georeference(pixels, CONTROL), 60, 50)
    assert (len(where["rows"]), len(where["cols"])) == (33, 33)
    assert 0 < where["interpolation_error_m"] < 5
    (tmp_path / "o").mkdir()
    products.write_frame(image, f"{tmp_path}/o", 60, 50, "geocoded_magnitude", "test", where)
    assert frames.checked_manifest((tmp_path / "o" / "frame.sarframe").read_text())["geolocation"] == where
    at = spark.createDataFrame([(10.0, 20.0), (59.0, 49.0)], "row double, col double")
    got = geo.frame_coordinates(at, where["rows"], where["cols"], where["longitude"], where["latitude"]).collect()
    want = terrain.georeference(at, CONTROL).collect()
    assert all(abs(a.lon - b.lon) < 1e-4 and abs(a.lat - b.lat) < 1e-4 for a, b in zip(got, want, strict=True))
