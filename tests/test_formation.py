"""The main command from files to a published image set."""

import json

import numpy as np
import pytest

from echogrid import __main__ as commands
from echogrid.plans import formation
from echogrid.sources import frames
from tests.test_archives import mat
from tests.test_terrain import tiff

C = 299792458.0
TARGET = np.array([6.0, -4.0, 0.0])


def histories(folder, height=0.0):
    folder.mkdir()
    f = 9e9 + 2e6 * np.arange(128)
    target = TARGET + [0, 0, height]
    for az in (1, 2):
        angle = np.deg2rad(2.0 * (np.arange(20) / 20 + az - 1) - 2)
        at = np.stack([7000 * np.cos(angle), 7000 * np.sin(angle), np.full(20, 7000.0)], 1)
        r0 = np.linalg.norm(at, axis=1)
        delta = np.linalg.norm(at - target, axis=1) - r0
        mat(folder / f"data_3dsar_pass1_az{az:03d}_HH.mat", {"fp": np.exp(-4j * np.pi * f[:, None] * delta / C), "freq": f, "x": at[:, 0], "y": at[:, 1], "z": at[:, 2], "r0": r0, "th": np.full(20, float(az))}, az == 2)


def test_phase_histories_to_an_image_set(spark, tmp_path, capsys):
    histories(tmp_path / "in")
    done = commands.main(["form", f"{tmp_path}/in", f"{tmp_path}/out", "--last-azimuth", "2", "--pixels", "33", "--width-m", "32", "--upsample", "8", "--method", "sinc", "--origin", "49.5", "10.3", "300", "90", "--focus-point", *map(str, TARGET)])
    assert done == 0
    said = capsys.readouterr().out
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert json.loads(said[said.index("{") :]) == report
    assert report["validation"]["direct_sum_relative_l2_error"] < 0.01
    assert (report["pulses"], report["image_shape"], report["additional_autofocus"]["point_m"]) == (40, [33, 33], TARGET.tolist())
    image = spark.read.parquet(f"{tmp_path}/out/pixels").collect()
    top = max(image, key=lambda p: abs(complex(p.re, p.im)))
    assert (top.col - 16, top.row - 16) == (6, -4)
    assert abs(complex(top.re, top.im)) == pytest.approx(1, abs=0.02)
    manifest = frames.checked_manifest((tmp_path / "out" / "frame.sarframe").read_text())
    assert abs(manifest["geolocation"]["latitude"][16][16] - 49.5) < 1e-6
    assert sorted(p.name for p in (tmp_path / "out" / "image").iterdir()) == ["complex", "image.png", "image.raw"]
    with pytest.raises(FileExistsError):
        formation.form_scene(spark, f"{tmp_path}/in", f"{tmp_path}/out")


def test_what_fails_leaves_nothing(spark, tmp_path):
    histories(tmp_path / "in")
    with pytest.raises(ValueError, match="direct sum"):
        formation.form_scene(spark, f"{tmp_path}/in", f"{tmp_path}/o", formation.Scene(32, 17, upsample=1, last_azimuth=2))
    for bad in (formation.Scene(pixels=1), formation.Scene(model="x")):
        with pytest.raises(ValueError):
            formation.form_scene(spark, f"{tmp_path}/in", f"{tmp_path}/o", bad)
    assert [p.name for p in tmp_path.iterdir()] == ["in"]


def test_an_elevation_model_moves_the_surface(spark, tmp_path):
    """A target 25 m up is in focus, and in its place, on the model's surface."""
    histories(tmp_path / "in", 25.0)
    (tmp_path / "m.tif").write_bytes(tiff(np.full((60, 60), 325, np.float32), tile=(16, 16), compression=8, origin=(10.27, 49.53), step=(0.001, 0.001)))
    scene = formation.Scene(32, 33, upsample=8, method="sinc", last_azimuth=2, origin=(49.5, 10.3, 300.0, 90.0), model=f"{tmp_path}/m.tif")
    report = formation.form_scene(spark, f"{tmp_path}/in", f"{tmp_path}/out", scene)
    assert report["terrain"]["local_z_min_m"] == pytest.approx(25, abs=0.01)
    top = max(spark.read.parquet(f"{tmp_path}/out/pixels").collect(), key=lambda p: abs(complex(p.re, p.im)))
    assert (top.col - 16, top.row - 16) == (6, -4)
    assert abs(complex(top.re, top.im)) == pytest.approx(1, abs=0.02)


def test_raw_echoes_to_an_image_set(spark, tmp_path):
    rate, carrier, n = 200e6, 1e9, 400
    t = np.arange(100) / rate
    replica = np.exp(1j * np.pi * 8e13 * (t - t.mean()) ** 2)
    y = np.linspace(-60, 60, 61)
    at = np.stack([np.full(61, -500.0), y, np.full(61, 300.0)], 1)
    start = 2 * (np.linalg.norm(at, axis=1) - 60) / C
    samples = np.zeros((61, n), complex)
    grid = np.fft.fftfreq(1024, 1 / rate)
    for k, p in enumerate(at):
        away = 2 * np.linalg.norm(p - TARGET) / C
        echo = np.fft.ifft(np.fft.fft(replica, 1024) * np.exp(-2j * np.pi * grid * (away - start[k])))[:n]
        samples[k] = echo * np.exp(-2j * np.pi * carrier * away)
    np.savez(tmp_path / "raw.npz", stage="raw_echo", samples=samples, replica=replica, sampling_rate_hz=rate, carrier_hz=carrier, receive_start_s=start, positions_m=at)
    report = formation.form_scene(spark, f"{tmp_path}/raw.npz", f"{tmp_path}/out", formation.Scene(20, 21, method="sinc"))
    assert report["input_stage"] == "raw_echo"
    top = max(spark.read.parquet(f"{tmp_path}/out/pixels").collect(), key=lambda p: abs(complex(p.re, p.im)))
    assert abs(top.col - 10 - 6) <= 1
    assert abs(top.row - 10 + 4) <= 1
    assert abs(complex(top.re, top.im)) > 0.7
