"""Archive readers on files built here, and terrain kernels against closed forms."""

import struct
import zlib

import numpy as np
import pytest

from echogrid.operators import terrain
from echogrid.sources import archives


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + bytes(-len(body) % 8)


def matrix(name, value):
    if isinstance(value, dict):
        names = b"".join(k.encode().ljust(32, b"\0") for k in value)
        body = element(6, struct.pack("<II", 2, 0)) + element(5, struct.pack("<ii", 1, 1)) + element(1, name.encode())
        body += struct.pack("<HHi", 5, 4, 32) + element(1, names) + b"".join(matrix("", v) for v in value.values())
        return element(14, body)
    v = np.atleast_2d(value)
    flags = 6 | (0x800 if np.iscomplexobj(v) else 0)
    body = element(6, struct.pack("<II", flags, 0)) + element(5, struct.pack("<ii", *v.shape)) + element(1, name.encode())
    body += element(9, np.asfortranarray(v.real).astype("<f8").tobytes("F"))
    if flags & 0x800:
        body += element(9, v.imag.astype("<f8").tobytes("F"))
    return element(14, body)


def mat(path, data, packed):
    body = matrix("data", data)
    path.write_bytes(b"MATLAB 5.0".ljust(124, b" ") + struct.pack("<H", 0x100) + b"IM" + (struct.pack("<II", 15, len(z := zlib.compress(body))) + z if packed else body))


def test_phase_histories(spark, tmp_path):
    r = np.random.default_rng(1)
    kept = {}
    for az in (1, 2):
        fp = r.standard_normal((5, 3)) + 1j * r.standard_normal((5, 3))
        kept[az] = fp
        mat(tmp_path / f"data_3dsar_pass1_az{az:03d}_HH.mat", {"fp": fp, "freq": 9e9 + np.arange(5.0), "x": np.arange(3.0), "y": np.ones(3), "z": np.ones(3), "r0": np.full(3, 7.0), "th": np.full(3, az)}, az == 2)
    got = archives.phase_histories(spark, str(tmp_path), 1, 2).orderBy("azimuth", "nth").collect()
    assert len(got) == 6
    for row in got:
        assert np.allclose(np.array(row.re) + 1j * np.array(row.im), kept[row.azimuth][:, row.nth])
    assert all(row.af is None for row in got)
    with pytest.raises(ValueError):
        archives.phase_histories(spark, str(tmp_path), 1, 3)
    assert archives.provenance(spark, str(tmp_path)).count() == 2
    base = {"fp": np.ones((5, 3)) + 0j, "freq": 9e9 + np.arange(5.0), "x": np.arange(3.0), "y": np.ones(3), "z": np.ones(3), "r0": np.full(3, 7.0), "th": np.ones(3)}
    mat(tmp_path / "data_3dsar_pass1_az003_HH.mat", base | {"af": {"r_correct": np.array([1.0, 2, 3]), "ph_correct": np.zeros(3)}}, False)
    kept = archives.phase_histories(spark, str(tmp_path), 3, 3).orderBy("nth").collect()
    assert [(r.af.r_correct, r.re) for r in kept] == [(k, [1.0] * 5) for k in (1.0, 2.0, 3.0)]
    mat(tmp_path / "data_3dsar_pass1_az004_HH.mat", base | {"freq": 9e9 + 2 * np.arange(5.0)}, False)
    with pytest.raises(ValueError, match="frequency"):
        archives.phase_histories(spark, str(tmp_path), 1, 4)
    mat(tmp_path / "data_3dsar_pass1_az005_HH.mat", base | {"af": {"r_correct": np.ones(2), "ph_correct": np.zeros(3)}}, False)
    with pytest.raises(Exception, match="one real value"):
        archives.phase_histories(spark, str(tmp_path), 5, 5).collect()


def test_raw_echoes(spark, tmp_path):
    a = {"samples": np.ones((2, 4), complex), "replica": np.ones(2, complex), "sampling_rate_hz": 1.0, "carrier_hz": 2.0, "receive_start_s": np.zeros(2), "positions_m": np.zeros((2, 3))}
    np.savez(tmp_path / "a.npz", stage="raw_echo", **a)
    rows = archives.raw_echoes(spark, f"{tmp_path}/a.npz").collect()
    assert [r.pulse for r in rows] == [0, 1]
    np.savez(tmp_path / "b.npz", stage="complex_image", **a)
    with pytest.raises(ValueError):
        archives.guarded((tmp_path / "b.npz").read_bytes(), "raw_echo")
    np.savez(tmp_path / "c.npz", stage="raw_echo", samples=np.array([{}], object))
    with pytest.raises(ValueError):
        archives.guarded((tmp_path / "c.npz").read_bytes(), "raw_echo")


def test_terrain(spark):
    y, x = np.mgrid[0:6, 0:8] + 0.5
    plane = 2 * x + 3 * y + 1
    assert terrain.bilinear(plane, np.array([2.2]), np.array([3.7]))[0] == pytest.approx(2 * 3.7 + 3 * 2.2 + 1)
    hole = plane.copy()
    hole[5, 7] = np.nan
    assert terrain.bilinear(hole, np.array([1.0]), np.array([1.0]))[0] == pytest.approx(6.0)
    for at in ((0.1, 1.0), (5.4, 7.4)):
        with pytest.raises(ValueError):
            terrain.bilinear(hole, np.array([at[0]]), np.array([at[1]]))
    # a sphere's curve: the ellipsoid's own circle at the equator, 100 m up
    flat = np.full((60, 60), 100.0)
    at = spark.createDataFrame([(x, 0.0, 0.0) for x in (-1000.0, 0.0, 1000.0)], "x double, y double, z double")
    got = terrain.surface(at, flat, (0.001, 0, -0.03, 0, -0.001, 0.03), (0.0, 0.0, 0.0, 90.0)).orderBy("x").collect()
    for r in got:
        assert r.z == pytest.approx(np.sqrt((6378137.0 + 100) ** 2 - r.x**2) - 6378137.0, abs=1e-4)
    # a slope in longitude and latitude, with a turned scene
    row, col = np.mgrid[:100, :100] + 0.5
    step = (0.0004, 0.0, -106.52, 0.0, -0.0004, 35.22)
    heights = lambda lon, lat: 1725 + 5000 * (lon + 106.5) + 7000 * (lat - 35.2)
    slope = heights(step[0] * col + step[2], step[4] * row + step[5])
    places = spark.createDataFrame([(float(x), float(y), 15.0) for x in (-400, 0, 400) for y in (-400, 100)], "x double, y double, z double")
    for heading in (0.0, 35.0, 270.0):
        origin = (35.2, -106.5, 1700.0, heading)
        for r in terrain.surface(places, slope, step, origin).collect():
            lon, lat, up = terrain.world(*(np.array([v]) for v in (r.x, r.y, r.z)), origin)[0]
            assert up == pytest.approx(heights(lon, lat), abs=2e-4)
    with pytest.raises(Exception, match="outside|not met"):
        terrain.surface(places.withColumn("x", places.x * 100), slope, step, origin).collect()
    control = [(r, c, -106 + c * 0.01 + r * 0.002, 35 - r * 0.01) for r in (0, 10, 20) for c in (0, 10, 20)]
    got = terrain.georeference(spark.createDataFrame([(4, 7)], "row int, col int"), control).first()
    assert (got["lon"], got["lat"]) == pytest.approx((-106 + 0.075 + 0.009, 35 - 0.045), abs=1e-9)
