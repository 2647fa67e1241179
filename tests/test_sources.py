"""Products, tapes, NITF images, frames, sinks and configurations on files built here."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.operators import geo
from echogrid.sources import binary, configs, files, frames, nitf, products, rpf, sensors, tape


def pixels(spark, matrix):
    rows = [(r, c, float(v)) for r, line in enumerate(matrix) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, value double").repartition(3)


def test_product_round_trip(spark, tmp_path):
    image = np.array([[0.4, 1.5, 300], [70000, 2, -3]])
    sections = {
        "file_id": {"file_type": 3, "radar_mode": 2, "format_version": "v1", "file_name": "strip"},
        "acquisition": {"aircraft_id": "AB1", "current_acquisition": 7, "current_mission_start": (2011, 7, 14, 9, 5, 59, 250)},
        "seaspot": {"track_id": -4, "latitude": 1.5, "speed": 2.0},
        "aircraft": {"altitude": 3000.0},
        "display": bytes(range(64)),
    }
    grid = [(11, 1.0, 1.5, 2.0, *range(6)), (12, 2.0, 2.5, 3.0, *range(10, 16))]
    rpf.write(pixels(spark, image), f"{tmp_path}/strip_1.rpf", 2, 3, 1, frame=9, sections=sections, start_line=4, start_pixel=2, grid=grid)
    found = rpf.catalog(spark, str(tmp_path))
    row = found.first()
    assert (row.mode, row.start, row.lines, row.pixels, row.pixel_type, row.frame, row.grid_lines) == ("stripmap", 11, 2, 3, 1, 9, 2)
    a = rpf.annotations(found).first()
    assert (a.file_id.file_name, a.acquisition.aircraft_id, a.seaspot.track_id, a.seaspot.latitude, a.aircraft.altitude) == ("strip", "AB1", -4, 1.5, 3000.0)
    assert str(a.acquisition.current_mission_start) == "2011-07-14 09:05:59.250000"
    assert a.acquisition.raw_mission_start is None
    assert bytes(a.display) == bytes(range(64))
    assert (a.rectangle.start_line, a.rectangle.start_pixel, a.rectangle.lines) == (4, 2, 2)
    assert a.summary == "fileType=3 radarMode=2 gridLines=2 fileId=strip"
    knots = rpf.geolocation(found).orderBy("nth").collect()
    assert [(k.line, k.mid_ratio, k.begin_lat, k.end_lon) for k in knots] == [(11, 1.5, 0.0, 5.0), (12, 2.5, 10.0, 15.0)]
    assert [(r.line, r.pixels) for r in rpf.lines(found).orderBy("line").collect()] == [(11, [0, 2, 300]), (12, [65535, 2, 0])]
    assert [r.line for r in rpf.lines(found, first=12, task_bytes=1).collect()] == [12]
    with pytest.raises(FileExistsError):
        rpf.write(pixels(spark, image), f"{tmp_path}/strip_1.rpf", 2, 3)
    with pytest.raises(ValueError):
        rpf.write(pixels(spark, image), f"{tmp_path}/x.rpf", 2, 3, 9)
    with pytest.raises(Exception, match="complete|rows are not"):
        rpf.write(pixels(spark, image), f"{tmp_path}/y.rpf", 3, 3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["strip_1.rpf"]


@pytest.mark.parametrize("kind", range(7))
def test_pixel_types(spark, tmp_path, kind):
    image = np.array([[0.0, 1.0, 250.0], [3.5, 100.25, 7.0]])
    rpf.write(pixels(spark, image), f"{tmp_path}/a_1.rpf", 2, 3, kind)
    got = np.array([r.pixels for r in rpf.lines(rpf.catalog(spark, str(tmp_path))).orderBy("line").collect()])
    assert np.array_equal(got, np.floor(image + 0.5) if kind < 3 else image)


def test_broken_products(spark, tmp_path):
    (tmp_path / "a_1.rpf").write_bytes(b"\0" * 64)
    with pytest.raises(Exception, match="no chunk"):
        rpf.catalog(spark, str(tmp_path)).count()
    (tmp_path / "a_1.rpf").write_bytes(struct.pack(">HHI", rpf.SYNC, rpf.IMAGE, 1000))
    with pytest.raises(Exception, match="cut short"):
        rpf.catalog(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        rpf.annotation_bytes({}, 1, 1, grid=rpf.flat_lines(1, 9, 6))
    half = np.frombuffer(rpf.encoded(np.array([1 / 3, 70000.0]), 4, truncate=True), ">f2")
    assert float(half[0]) < 1 / 3
    assert half[1] == np.inf


def test_streams_of_products(spark, tmp_path):
    for n, (start, mode) in enumerate([(1, 2), (3, 2), (8, 2), (5, 0)], 1):
        grid = [(start, 1.0, 1.0, 1.0, *[float(n)] * 6), (start + 1, 1.0, 1.0, 1.0, *[float(n)] * 6)]
        rpf.write(pixels(spark, np.full((2, 2), n)), f"{tmp_path}/{'s' if mode else 'f'}_{n}.rpf", 2, 2, 3, frame=40 + n, sections={"file_id": {"radar_mode": mode}}, grid=grid)
    every = rpf.catalog(spark, str(tmp_path)).cache()
    runs = rpf.first_sequence(every).orderBy("base", "number").collect()
    assert [(r.base.rpartition("/")[2], r.number) for r in runs] == [("f", 4), ("s", 1), ("s", 2), ("s", 3)]
    strips = every.where("mode = 'stripmap'")
    assert geo.matching_blocks(strips, 4).first().start == 3
    assert geo.matching_blocks(strips, 0).first().start == 1
    assert geo.matching_blocks(strips, 6).count() == 0
    assert geo.matching_blocks(every.where("mode <> 'stripmap'"), 44).first().frame == 44
    stream = geo.line_stream(strips, geo.matching_blocks(strips, 1)).orderBy("start")
    assert [r.start for r in stream.collect()] == [1, 3, 8]
    assert sorted(r.line for r in rpf.lines(stream).collect()) == [1, 2, 3, 4, 8, 9]
    named = [r.path for r in strips.orderBy("path").collect()][-1]
    assert geo.matching_blocks(strips, 0, named).first().path == named
    assert [r.nth for r in stream.collect()] == [1, 2, 3]
    assert geo.flat_grid(spark.createDataFrame([(5, 5)], "first int, last int")).orderBy("line").select("line", "mid_ratio", "mid_lat").collect() == [(5, 1.0, None), (6, 1.0, None)]


def test_sequences_go_by_number_and_end_at_a_gap(spark):
    """Two sequences of more than ten files, one with a gap; their names sort otherwise than their numbers."""
    rows = [(f"/d/{base}_{n}.rpf", 1, "stripmap", 100 * n + 1, 100) for base, numbers in (("s", [*range(1, 12), 13, 14]), ("t", range(2, 13))) for n in numbers]
    rows += [("/d/s_2.rpf", 2, "stripmap", 5000, 50), ("/d/alone.rpf", 1, "stripmap", 1, 900), ("/d/u_1.rpf", 1, "seaspot", 7, 10)]
    catalog = spark.createDataFrame(rows, "path string, chunk int, mode string, start int, lines int")
    first = geo.matching_blocks(catalog, 1050, "/d/t_3.rpf").first()
    assert (first.path, first.rank) == ("/d/t_10.rpf", 1)
    ranked = [(r.path, r.rank) for r in geo.matching_blocks(catalog, 450).collect()]
    assert ranked == [("/d/alone.rpf", 1), ("/d/s_4.rpf", 2), ("/d/t_4.rpf", 3)]
    # the named file goes first; files behind the gap are found only by their own name
    assert [r.path for r in geo.matching_blocks(catalog, 0, "/d/s_11.rpf").collect()][:4] == ["/d/s_11.rpf", "/d/s_1.rpf", "/d/s_2.rpf", "/d/s_2.rpf"]
    assert geo.matching_blocks(catalog, 1350).count() == 0
    assert geo.matching_blocks(catalog, 1350, "/d/s_13.rpf").first().path == "/d/s_13.rpf"
    # a stream has the whole sequence of the match, before and behind it, and no other
    stream = [(r.path, r.chunk) for r in geo.line_stream(catalog, geo.matching_blocks(catalog, 1050, "/d/s_9.rpf")).collect()]
    assert stream == [("/d/s_1.rpf", 1), ("/d/s_2.rpf", 1), ("/d/s_2.rpf", 2), *[(f"/d/s_{n}.rpf", 1) for n in range(3, 12)]]
    assert [r.path for r in geo.line_stream(catalog, geo.matching_blocks(catalog, 7, "/d/u_1.rpf")).collect()] == ["/d/u_1.rpf"]
    assert [r.path for r in geo.line_stream(catalog, geo.matching_blocks(catalog, 5, "/d/alone.rpf")).collect()] == ["/d/alone.rpf"]


def test_folders_appear_in_the_store_of_their_path(spark, tmp_path, monkeypatch):
    """Names keep their scheme, and the move happens in the named store."""
    from pyarrow import fs

    from echogrid.sources import files

    (tmp_path / "bucket").mkdir()
    inner, real = fs.SubTreeFileSystem(str(tmp_path / "bucket"), fs.LocalFileSystem()), files.located
    monkeypatch.setattr(files, "located", lambda path: (inner, path.removeprefix("store://")) if path.startswith("store://") else real(path))
    with files.published("store://a/b") as work:
        assert work.startswith("store://a/b.")
        files.write_bytes(f"{work}/x", b"1")
    assert (tmp_path / "bucket" / "a" / "b" / "x").read_bytes() == b"1"
    with pytest.raises(FileExistsError), files.published("store://a/b"):
        pass
    with pytest.raises(ZeroDivisionError), files.published("store://a/c") as work:
        files.write_bytes(f"{work}/x", b"1")
        1 / 0
    assert [p.name for p in (tmp_path / "bucket" / "a").iterdir()] == ["b"]
    with files.published(f"{tmp_path}/set") as work:
        assert work.startswith("file:///")
        spark.range(3).write.parquet(f"{work}/rows")
    assert spark.read.parquet(f"{tmp_path}/set/rows").count() == 3


def scene(sampling=255, rate=22, mode=0, pulses=2, end=0):
    raw = struct.pack(">HHI", 200, 3, 77) + bytes([0, 1, 0, 128]) + struct.pack(">h", -2) + struct.pack(">H", pulses) + struct.pack(">h", end) + struct.pack(">H", 1) + b"M123"
    raw += bytes([sampling, mode]) + struct.pack(">HIHBB", 0, 99, 400, 1, 2) + bytes.fromhex("42640000") + bytes.fromhex("C2640000")
    raw += bytes(4) + struct.pack(">I", 9000) + bytes(8) + struct.pack(">I", 50) + bytes(8) + struct.pack(">I", 12345) + bytes.fromhex("41100000") + bytes(4)
    return raw + struct.pack(">HHHH", 1, 9600, 500, rate) + bytes([1, 0, 1, 0]) + b"C1.0N2.0" + struct.pack(">IH", 0, 11)


def test_tapes(spark, tmp_path):
    rec = products.tape_record
    good = rec(2, 5, 1, 99, bytes([3, 4, 255, 0]))
    message = b"TR" + b"  12.5" + b"000000FF" + b"W01234567" + b"N0123456" + b"\n\r"
    accessory = bytearray(8192)
    accessory[600 : 600 + len(message)] = message
    accessory[640 : 640 + len(message)] = message[:-2] + b"\r\n"
    accessory[700 : 700 + len(message)] = message[:-2] + b"xx"
    records = [rec(0, 5, 1, 1, b"\1\2"), rec(1, 5, 2, 2, scene()), good, rec(3, 5, 4, 4, b""), rec(2, 5, 5, 100, bytes([6, 8])), good, rec(15, 5, 6, 5, b"")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.dat").write_bytes(bytes(accessory) + b"".join(records))
    path = f"{tmp_path}/t/a.dat"
    records_read = binary.read(spark, "sartape", path, records_per_task=2).orderBy("ordinal").collect()
    assert [r.type for r in records_read] == [0, 1, 2, 3, 2, 2, 15]
    assert bytes(records_read[0].payload[:2]) == b"\2\1"
    all_tape = binary.read(spark, "sartape", path, records_per_task=2)
    h = tape.scene_headers(all_tape).first()
    assert (h.byte_count, h.scene_number, h.mission_id, h.sampling_mhz, h.fm_rate_mhz_us, h.spot_pulses, h.strip_end) == (122, 3, "M123", 500.0, 22.5, 2, 0)
    assert h.initial_delay_ns == pytest.approx((256 * 256 + 128) * 20 / 256)
    assert h.delay_step_ns == pytest.approx(-2 * 20 / 256)
    assert (h.heading_t0, h.velocity_t0, h.altitude_t0, h.scene_range, h.scene_eta, h.end_code) == (100.0, -100.0, 9000, 12345, 1.0, 11)
    p = tape.scene_parameters(tape.scene_headers(all_tape), 2).first()
    assert (p.carrier_hz, p.prf_hz, p.samples, p.data_type) == (9.6e9, 2500.0, 972, "c")
    assert p.wavelength_m == pytest.approx(299792458 / 9.6e9)
    assert p.eta_rad == pytest.approx(np.deg2rad(1))
    assert [(m.range, m.time, m.longitude) for m in tape.target_messages(spark, path).orderBy("nth").collect()] == [(12.5, 255, "W01234567")] * 2
    # the header promises two lines; other record types are no lines
    assert [(r.line, r.time) for r in tape.data_lines(all_tape).orderBy("line").collect()] == [(0, 99), (1, 100)]
    expect = lambda *x: spark.range(1).select(tape.expected_lines(*map(F.lit, x))).first()[0]
    assert [expect(*x) for x in ((17, 0, 0), (1, 99, 0), (0, 0, 13000), (0, 0, 100), (1, -5, 0))] == [32772, 99, 12448, 100, None]
    assert tape.to_product(spark, path, f"{tmp_path}/p_1.rpf") == 2
    lines = rpf.lines(rpf.catalog(spark, f"{tmp_path}/p_1.rpf")).orderBy("line").collect()
    assert [r.pixels[:2] for r in lines] == [[5, 1], [10, 0]]
    assert len(lines[0].pixels) == 972
    assert tape.ingest(spark, path, f"{tmp_path}/out", complex_samples=True) == 2
    assert (tmp_path / "out.vts").read_text() == "99\n100\n"
    assert np.frombuffer((tmp_path / "out.dat").read_bytes(), "<c8").reshape(2, 972)[:, 0].tolist() == [3 + 4j, 6 + 8j]
    assert json.loads((tmp_path / "out.ssp").read_text())["lines"] == 2
    assert len(json.loads((tmp_path / "out.hdr").read_text())["target_positions"]) == 2


def test_bad_records(spark, tmp_path):
    good = products.tape_record(2, 5, 1, 99, bytes([3, 4, 255, 0]))
    (tmp_path / "t.dat").write_bytes(good + b"\0\0\0\0" + good[4:] + good)
    every = binary.read(spark, "sartape", f"{tmp_path}/t.dat")
    assert tape.data_lines(every, True).count() == 1
    assert tape.data_lines(every, False).count() == 3
    assert tape.magnitude_lines(tape.data_lines(every)).first()["values"][:3] == [5.0, 1.0, 0.0]


def nitf_file(mode="B", rows=5, cols=3, block=(0, 0), extension=b"", bands=("M", "P")):
    data = np.arange(rows * cols * 2, dtype=">u2").reshape(2, rows, cols)
    height, width = block[0] or rows, block[1] or cols
    down, across = -(-rows // height), -(-cols // width)
    body = b""
    for i in range(down):
        for j in range(across):
            part = np.zeros((2, height, width), ">u2")
            cut = data[:, i * height : (i + 1) * height, j * width : (j + 1) * width]
            part[:, : cut.shape[1], : cut.shape[2]] = cut
            body += {"B": part, "P": part.transpose(1, 2, 0), "R": part.transpose(1, 0, 2)}[mode].tobytes()
    image = b"IM".ljust(nitf.SIZE_AT, b" ") + b"%08d%08dINT" % (rows, cols) + b"MONO    SAR     16R " + b"0NC2"
    for band in bands:
        image += b"  " + band.encode().ljust(6) + b"N   0"
    image += b"0" + mode.encode() + b"%04d%04d%04d%04d16" % (across, down, width, height) + b"001000" + b"0" * 10 + b"1.0 "
    image += b"00000" + (b"%05d000" % (len(extension) + 3) + extension if extension else b"00000")
    size = 379 + len(image) + len(body)
    head = b"NITF02.10".ljust(342, b" ") + b"%012d%06d" % (size, 379) + b"001%06d%010d" % (len(image), len(body))
    return head.ljust(379, b"0") + image + body, data


def test_nitf(spark, tmp_path):
    for mode, block in (("B", (0, 0)), ("P", (2, 2)), ("R", (2, 2)), ("B", (2, 2))):
        folder = tmp_path / f"{mode}{block[0]}"
        folder.mkdir()
        raw, data = nitf_file(mode, block=block)
        (folder / "a.ntf").write_bytes(raw)
        got = nitf.rows(spark, str(folder), window=2).orderBy("row").collect()
        assert np.array_equal([r.magnitude for r in got], data[0])
        assert np.array_equal([r.phase for r in got], data[1])
    raw, _ = nitf_file()
    broken = {
        "length": raw + b"x",
        "bands": nitf_file(bands=("P", "M"))[0],
        "CMETAA": nitf_file(extension=b"CMETAA00003abc")[0],
        "BLOCKA": nitf_file(extension=b"BLOCKA00010" + b"0100004000")[0],
        "header": b"NITF02.00" + raw[9:],
        "blocks": nitf_file(rows=5)[0].replace(b"%08d%08dINT" % (5, 3), b"%08d%08dINT" % (9, 3)),
    }
    for match, content in broken.items():
        (tmp_path / "bad.ntf").write_bytes(content)
        with pytest.raises(ValueError, match=match):
            nitf.layout(f"{tmp_path}/bad.ntf")


def document(**tres):
    inner = "".join(f'<tre name="{n}">' + "".join(f'<field name="{k}" value="{v}"/>' for k, v in fields.items()) + "</tre>" for n, fields in tres.items())
    return f"<tres>{inner}</tres>"


def test_sensor_metadata(spark):
    fine = document(
        ACFTB={"ROW_SPACING": "2", "ROW_SPACING_UNITS": "f", "ENTELV": "10", "ELV_UNIT": "m", "ENTLOC": "+35.0-106.5"},
        EXPLTB={"GRAZE_ANG": "60"},
        MENSRB={"COSGRZ": "0.5", "RP_ROW": "3", "C_R_NC": "1", "C_R_EC": "0", "C_R_DC": "0", "C_AZ_NC": "0", "C_AZ_EC": "1", "C_AZ_DC": "0", "ACFT_ALT": "1000"},
    )
    poor = document(
        ACFTB={"ROW_SPACING": "0", "ROW_SPACING_UNITS": "m", "ENTELV": "x", "EXITELV": "5", "ENTLOC": "nowhere"},
        EXPLTB={"GRAZE_ANG": "60", "SQUINT_ANGLE": "86"},
        MENSRB={"COSGRZ": "0.9", "RP_ROW": "11", "C_R_NC": "1", "C_AZ_NC": "0.5", "C_AZ_EC": "0", "C_AZ_DC": "0"},
    )
    rows = spark.createDataFrame([(1, fine, 10), (2, poor, 10), (3, None, 10)], "k int, xml string, height int")
    got = {r.k: r for r in sensors.sensor_metadata(rows, "xml", "height").collect()}
    a = got[1]
    assert (a.status, a.issues) == ("checked", [])
    assert a.row_spacing_m == pytest.approx(0.6096)
    assert (a.entry_elevation_m, a.entry_lonlat, a.reference_row, a.range_ned) == (10.0, [-106.5, 35.0], 2, [1.0, 0.0, 0.0])
    assert a.aircraft_altitude_msl_m == pytest.approx(304.8)
    b = got[2]
    assert b.status == "issues_found"
    assert len(b.issues) == 9
    assert (b.row_spacing_m, b.entry_lonlat, b.reference_row, b.range_ned, b.azimuth_ned) == (None,) * 5
    assert (got[3].status, got[3].issues) == ("unavailable", [])
    skew = document(MENSRB={"C_R_NC": "1", "C_R_EC": "0", "C_R_DC": "0", "C_AZ_NC": "0.6", "C_AZ_EC": "0.8", "C_AZ_DC": "0"})
    one = sensors.sensor_metadata(spark.createDataFrame([(skew,)], "xml string")).first()
    assert one.issues == ["MENSRB: range_ned and azimuth_ned are not at right angles"]
    for bad in ("<!DOCTYPE x><tres/>", "<tres", "<other/>", "<tres>" + '<tre name="ACFTB"/>' * 2 + "</tres>", '<tres><tre name="ACFTB"><field name="a" value="1"/><field name="a" value="2"/></tre></tres>'):
        with pytest.raises(Exception, match="too large|entities|expected|repeated|MALFORMED|malformed"):
            sensors.sensor_metadata(spark.createDataFrame([(bad,)], "xml string")).collect()
    other = document(ACFTB={"ENTELV": "3", "ELV_UNIT": "F"}).replace("<tres>", '<tres><tre name="OTHER"><field name="a" value="1"/></tre><tre name="EXPLTB" location="text"/>')
    one = sensors.sensor_metadata(spark.createDataFrame([(other,)], "xml string")).first()
    assert (one.status, one.entry_elevation_m) == ("checked", pytest.approx(0.9144))


def test_rasters_and_tiffs(spark, tmp_path):
    image = np.arange(12.0).reshape(3, 4)
    frame = pixels(spark, image)
    products.write_raster(frame, f"{tmp_path}/a.raw", 3, 4)
    assert [r.value for r in binary.read(spark, "floatraster", f"{tmp_path}/a.raw", rows_per_task=2).orderBy("row").collect()] == image.tolist()
    with pytest.raises(FileExistsError):
        products.write_raster(frame, f"{tmp_path}/a.raw", 3, 4)
    for bad in (pixels(spark, image[:2]), pixels(spark, -image), pixels(spark, image[:, :3])):
        with pytest.raises(Exception, match="rows are not|magnitude|complete"):
            products.write_raster(bad, f"{tmp_path}/b.raw", 3, 4)
    (tmp_path / "short.raw").write_bytes(struct.pack("<II", 2, 2) + bytes(12))
    with pytest.raises(Exception, match="payload"):
        binary.read(spark, "floatraster", f"{tmp_path}/short.raw").collect()

    def tiff(path):
        raw = (tmp_path / path).read_bytes()
        at = struct.unpack("<I", raw[4:8])[0]
        n = struct.unpack("<H", raw[at : at + 2])[0]
        tags = {t[0]: t[3] for t in (struct.unpack("<HHII", raw[at + 2 + 12 * k : at + 14 + 12 * k]) for k in range(n))}
        return np.frombuffer(raw[8 : 8 + tags[279]], "<u2" if tags[258] == 16 else "<f4").reshape(tags[257], tags[256]), tags

    products.write_tiff(frame, f"{tmp_path}/m.tif", 3, 4)
    got, tags = tiff("m.tif")
    assert np.array_equal(got, np.floor(image / 11 * 65535 + 0.5))
    assert sorted(tags) == [256, 257, 258, 259, 262, 273, 277, 278, 279]
    products.write_percentile_tiff(frame, f"{tmp_path}/p.tif", 3, 4, 0.1, 0.9, 2.0)
    low, high = 1.0, 9.0
    assert np.array_equal(tiff("p.tif")[0], np.floor(np.clip((image - low) / (high - low) * 2, 0, 1) * 65535 + 0.5))
    products.write_tiff(pixels(spark, np.ones((2, 2))), f"{tmp_path}/flat.tif", 2, 2)
    assert tiff("flat.tif")[0].max() == 0
    products.write_float_tiff(frame, f"{tmp_path}/g.tif", 3, 4, (0.5, 0.5), (100.0, 200.0), 32613)
    assert np.array_equal(tiff("g.tif")[0], image)


def test_image_set_and_reports(spark, tmp_path):
    image = pixels(spark, np.arange(1.0, 13).reshape(3, 4)).select("row", "col", F.col("value").alias("re"), F.lit(0.0).alias("im"))
    products.write_image_set(image, f"{tmp_path}/set", 3, 4, reference={"scale": (1.0, 1.0), "corner": (0.0, 0.0), "epsg": 32613})
    assert sorted(p.name for p in (tmp_path / "set").iterdir()) == ["complex", "image.png", "image.raw", "magnitude_native.tif"]
    assert (tmp_path / "set" / "image.png").read_bytes()[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(FileExistsError), files.published(f"{tmp_path}/set"):
        pass
    with pytest.raises(RuntimeError), files.published(f"{tmp_path}/never"):
        raise RuntimeError
    assert sorted(p.name for p in tmp_path.iterdir()) == ["set"]
    products.write_report(f"{tmp_path}/r.json", {"a": 1})
    products.write_report(f"{tmp_path}/r.txt", {"a": {"b": 1.5}, "c": [{"d": 2}], "e": None})
    assert (tmp_path / "r.txt").read_text() == "a.b=1.5\nc.count=1\nc.0.d=2\ne=\n"
    with pytest.raises(ValueError):
        products.write_json(f"{tmp_path}/nan.json", {"a": float("nan")})
    products.lines_report(f"{tmp_path}/l.txt", spark.createDataFrame([(5,), (2,), (5,)], "line int"))
    assert (tmp_path / "l.txt").read_text() == "count=2\nlines.count=2\nlines.0=2\nlines.1=5\n"
    products.series_report(f"{tmp_path}/s.json", {"alpha": 0.5}, spark.createDataFrame([(2, 1.0), (1, 2.0)], "frame int, metric double"), "frame", {"best": 1})
    assert json.loads((tmp_path / "s.json").read_text())["results"][0] == {"frame": 1, "metric": 2.0}
    meta = products.legacy_outputs(pixels(spark, np.arange(4.0).reshape(2, 2)), f"{tmp_path}/old", 2, 2, states={"registration": {"x": 1}})
    assert (meta["scale"], meta["offset"]) == (65535 / 3, 0)
    assert sorted(p.name for p in (tmp_path / "old").iterdir()) == ["image.json", "image.raw", "image.tif", "image_normalized.tif", "registration.json"]


def test_annotation_reports(spark, tmp_path):
    from echogrid.operators import measure

    rpf.write(pixels(spark, np.arange(6.0).reshape(2, 3)), f"{tmp_path}/a_1.rpf", 2, 3, sections={"file_id": {"file_name": "a"}})
    found = rpf.catalog(spark, f"{tmp_path}/a_1.rpf")
    line = spark.createDataFrame([([0.0, 1.0, 0.0],)], "line array<double>").select(measure.pta_stats(F.col("line"), 3).alias("s")).select("s.*")
    products.annotation_report(f"{tmp_path}/a.json", rpf.annotations(found), rpf.geolocation(found), line, line)
    report = json.loads((tmp_path / "a.json").read_text())
    assert report["annotation"]["file_id"]["file_name"] == "a"
    assert len(report["grid"]) == 2
    assert report["pta"]["x"]["max_power"] == 1.0
    products.auto_pta_report(f"{tmp_path}/b.json", rpf.annotations(found), line.withColumn("line", F.lit(4)))
    assert json.loads((tmp_path / "b.json").read_text())["entries"][0]["line"] == 4


def test_frames_and_scans(spark, tmp_path):
    image = np.arange(20.0).reshape(4, 5)
    image[0, 0] = np.nan
    turning = spark.createDataFrame([(r, c, float(np.cos(r + c)), float(np.sin(r + c))) for r in range(4) for c in range(5)], "row int, col int, re double, im double")
    stages = {
        "formed": {"image": pixels(spark, image), "rows": 4, "cols": 5, "product": "scene_local_magnitude"},
        "phase": {"image": turning, "rows": 4, "cols": 5, "product": "focused_phase", "phase": True},
        "geocoded": {"reason": "no origin"},
    }
    products.write_scan(stages, f"{tmp_path}/scan", "L", "S", "formed")
    found = frames.discovered(spark, str(tmp_path))
    assert [r.kind for r in found.collect()] == ["scan"]
    report = {r.stage: r for r in frames.validated(found).collect()}
    assert {k: r.valid for k, r in report.items()} == {"formed": True, "phase": True}
    assert (report["formed"].width, report["formed"].most, report["formed"].empty) == (5, 19.0, 1)
    manifests = spark.createDataFrame([(f"{tmp_path}/scan/formed.sarframe",)], "path string")
    got = np.array([r.value for r in frames.frame_rows(manifests).orderBy("row").collect()])
    assert np.array_equal(got, image, equal_nan=True)
    m = json.loads((tmp_path / "scan" / "formed.sarframe").read_text())
    for change in ({"schema": "x"}, {"width": 0}, {"product": "other"}, {"units": "m"}, {"data_file": "../a"}, {"display_scale": "phase_radians"}, {"product": "geocoded_magnitude"}):
        with pytest.raises(ValueError):
            frames.checked_manifest(json.dumps(m | change))
    geolocation = {"rows": [0, 3], "cols": [0, 4], "longitude": [[179.0, -179.0], [179.0, -179.0]], "latitude": [[1.0, 1.0], [0.0, 0.0]], "interpolation_error_m": 0.0}
    assert frames.checked_manifest(json.dumps(m | {"product": "geocoded_magnitude", "geolocation": geolocation}))
    with pytest.raises(ValueError):
        frames.checked_manifest(json.dumps(m | {"product": "geocoded_magnitude", "geolocation": geolocation | {"rows": [0, 2]}}))
    raw = (tmp_path / "scan" / "formed.raw").read_bytes()
    (tmp_path / "scan" / "formed.raw").write_bytes(raw[:-4] + struct.pack("<f", -1.0))
    assert not {r.stage: r.valid for r in frames.validated(found).collect()}["formed"]
    with pytest.raises(ValueError):
        products.write_scan(stages, f"{tmp_path}/no", "L", "S", "geocoded")


def test_configs(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"nPixX": 5, "fastMode": True, "unknown": 1}))
    o = configs.load(f"{tmp_path}/o.json", configs.Operator())
    assert (o.n_pix_x, o.fast_mode, o.first_range_line) == (5, True, 1)
    assert configs.load(f"{tmp_path}/none.json", configs.Secondary()) == configs.Secondary()
    (tmp_path / "s.json").write_text(json.dumps({"quadParams": {"nRngTaper": 4}, "autofocusParams": 3}))
    s = configs.load(f"{tmp_path}/s.json", configs.Secondary())
    assert (s.quad_params.n_rng_taper, s.quad_params.min_sub_image_size, s.autofocus_params.max_points) == (4, 32, 16)
    assert len(configs.fields(configs.Operator)) == 31
    (tmp_path / "a.prs").write_text("maxPeaks = 3 # few\nchipData=1, 2,,3 4\nanalyze2D=yes\nbad line\n% all comment\nchipRows=x\n")
    a = configs.load_analysis(f"{tmp_path}/a.prs")
    assert (a.max_peaks, a.chip_data, a.analyze2_d, a.chip_rows) == (3, [1.0, 2.0, 3.0], True, 0)
    (tmp_path / "a.json").write_text(json.dumps({"chipData": [[1, 2], [3, 4]], "reportFormat": "text"}))
    a = configs.load_analysis(f"{tmp_path}/a.json")
    assert (a.chip_rows, a.chip_cols, a.report_format) == (2, 2, "text")
    assert configs.chip_frame(spark, a).count() == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "X.NTF").write_bytes(b"x")
    assert configs.input_format(spark, f"{tmp_path}/in") == "focused_image"
    (tmp_path / "in" / "data_3dsar_pass1_az001_HH.mat").write_bytes(b"x")
    with pytest.raises(ValueError):
        configs.input_format(spark, f"{tmp_path}/in")


def dem(order="<", rows=6, cols=5, extra=(), unit="m", strip=2, nodata="-9999"):
    values = np.arange(rows * cols, dtype=np.float32).reshape(rows, cols)
    values[5, 4] = -9999
    data = values.astype(order + "f4").tobytes()
    note = f'<GDALMetadata><Item name="UNITTYPE" role="unittype">{unit}</Item>{"".join(extra)}</GDALMetadata>\0'.encode()
    size = strip * cols * 4
    strips = [8 + size * k for k in range(rows // strip)]
    tags = [(256, 3, [cols]), (257, 3, [rows]), (258, 3, [32]), (259, 3, [1]), (273, 4, strips), (277, 3, [1]), (278, 3, [strip]), (339, 3, [3])]
    tags += [(33550, 12, [0.1, 0.2, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 10.0, 50.0, 0.0]), (34735, 3, [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326]), (42112, 2, list(note)), (42113, 2, list(nodata.encode() + b"\0"))]
    at, behind, directory = 8 + len(data) + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, v in tags:
        raw = struct.pack(f"{order}{len(v)}{ {2: 'B', 3: 'H', 4: 'I', 12: 'd'}[kind] }", *v)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(f"{order}I", at + len(behind))
        behind += raw if len(raw) > 4 else b""
        directory += struct.pack(f"{order}HHI", tag, kind, len(v)) + place
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(f"{order}HI", 42, 8 + len(data)) + data + struct.pack(f"{order}H", len(tags)) + directory + bytes(4) + behind, values


def test_elevation(spark, tmp_path):
    from echogrid.sources import elevation

    for order in "<>":
        raw, values = dem(order)
        (tmp_path / "d.tif").write_bytes(raw)
        x = elevation.layout(f"{tmp_path}/d.tif")
        assert (x.epsg, x.affine) == (4326, (0.1, 0.0, 10.0, 0.0, -0.2, 50.0))
        got = np.array([r.value for r in elevation.rows(spark, f"{tmp_path}/d.tif", window=3).orderBy("row").collect()])
        assert np.isnan(got[5, 4])
        assert np.array_equal(got[:5], values[:5])
        assert elevation.rows(spark, f"{tmp_path}/d.tif", 1, 4, 2).count() == 3
    cut, affine = elevation.window_around(spark, f"{tmp_path}/d.tif", [(10.15, 49.5)], margin=1)
    assert np.array_equal(cut, values[1:4, 0:3])
    assert affine == pytest.approx((0.1, 0.0, 10.0, 0.0, -0.2, 49.8))
    datum = ['<Item name="VERTICAL_DATUM">EGM96</Item>']
    for broken in (dem(unit="ft")[0], dem(extra=datum)[0], b"II*\0", dem()[0].replace(struct.pack("<HHIHH", 259, 3, 1, 1, 0), struct.pack("<HHIHH", 259, 3, 1, 7, 0))):
        (tmp_path / "b.tif").write_bytes(broken)
        with pytest.raises((ValueError, struct.error)):
            elevation.layout(f"{tmp_path}/b.tif")


def test_commands(spark, tmp_path, capsys):
    from echogrid import __main__ as commands

    for name, v in (("a", 1.0), ("b", 1.5)):
        products.write_raster(pixels(spark, np.full((2, 2), v)), f"{tmp_path}/{name}.raw", 2, 2)
    assert commands.main(["compare", f"{tmp_path}/a.raw", f"{tmp_path}/b.raw", "--atol", "0.6"]) == 0
    assert commands.main(["compare", f"{tmp_path}/a.raw", f"{tmp_path}/b.raw"]) == 1
    (tmp_path / "c.json").write_text(json.dumps({"chipData": [0, 1, 0], "reportPath": f"{tmp_path}/out.txt", "reportFormat": "odd"}))
    assert commands.main(["analyze", f"{tmp_path}/c.json"]) == 0
    assert "pta.stats.pos=2" in (tmp_path / "out.txt").read_text()
    (tmp_path / "t.dat").write_bytes(products.tape_record(2, 5, 1, 99, bytes([3, 4])))
    assert commands.main(["ingest", f"{tmp_path}/t.dat", f"{tmp_path}/o"]) == 0
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.sarframe").write_text("{}")
    assert commands.main(["validate", f"{tmp_path}/f"]) == 1
    assert '"valid": false' in capsys.readouterr().out
