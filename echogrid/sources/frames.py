"""Scientific frames and scans: JSON manifests beside float payloads, and a report on whether they hold together."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import list_array
from . import files
from .rpf import _mapped

MAX_PIXELS, MAX_MANIFEST, MAX_STAGES = 64_000_000, 2_000_000, 16
#: Fixed values of the format: products that show phases, and those that show magnitudes.
PHASES = ("focused_phase", "backprojected_phase")
MAGNITUDES = ("geocoded_magnitude", "scene_local_magnitude", "range_profile_magnitude", "focused_magnitude", "backprojected_magnitude")


def _axis(values: list, size: int) -> list[float]:
    axis = [float(v) for v in values]
    rising = all(a < b for a, b in zip(axis, axis[1:], strict=False))
    if not 1 <= len(axis) <= 33 or not rising or axis[0] != 0 or axis[-1] != size - 1:
        raise ValueError("a geolocation axis must rise from the first to the last pixel")
    return axis


def checked_manifest(raw: str) -> dict:
    """A frame's manifest, if its fields agree with each other; else an error that says why not."""
    if len(raw) > MAX_MANIFEST:
        raise ValueError("the manifest is too large")
    m = json.loads(raw)
    if m["schema"] != "sar-scientific-frame-v1":
        raise ValueError("unknown schema")
    width, height, product = m["width"], m["height"], m["product"]
    if not (isinstance(width, int) and isinstance(height, int) and width > 0 and height > 0 and width * height <= MAX_PIXELS):
        raise ValueError("the size is not that of a frame")
    phase = product in PHASES
    if not phase and product not in MAGNITUDES:
        raise ValueError("unknown product")
    if (product == "geocoded_magnitude") > ("geolocation" in m) or (product == "scene_local_magnitude" and "geolocation" in m):
        raise ValueError("geocoded frames have a geolocation, and local ones have none")
    if m.get("display_scale", "amplitude_db") != ("phase_radians" if phase else "amplitude_db") or m["units"] != ("radians" if phase else "uncalibrated magnitude DN"):
        raise ValueError("product, scale and units do not agree")
    if not m["source"] or not re.fullmatch(r"[^/\\:]+", m["data_file"]) or m["data_file"] in (".", ".."):
        raise ValueError("the payload must be a file beside the manifest")
    if (g := m.get("geolocation")) is not None:
        shape = len(_axis(g["rows"], height)), len(_axis(g["cols"], width))
        for name, most in (("longitude", 180), ("latitude", 90)):
            table = np.array(g[name], float)
            if table.shape != shape or not (np.abs(table) <= most).all():
                raise ValueError(f"{name} does not fit its axes or bounds")
        if not (np.isfinite(g["interpolation_error_m"]) and g["interpolation_error_m"] >= 0):
            raise ValueError("the interpolation error must be finite and not negative")
    return m


def _payload_rows(path: str, m: dict, rows: int = 1024) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of rows of a frame's payload, checked; (first row, matrix)."""
    place = f"{path.rpartition('/')[0]}/{m['data_file']}"
    width, height = m["width"], m["height"]
    with files.opened(files.uri(place)) as f:
        if f.size() != 8 + 4 * width * height or np.frombuffer(f.read_at(8, 0), "<u4").tolist() != [width, height]:
            raise ValueError("the payload's size is not the manifest's")
        for a in range(0, height, rows):
            b = min(height, a + rows)
            x = np.frombuffer(f.read_at(4 * width * (b - a), 8 + 4 * width * a), "<f4").reshape(b - a, width)
            if np.isinf(x).any() or (m["product"] in PHASES and (np.abs(x) > np.float32(np.pi)).any()) or (m["product"] not in PHASES and (x < 0).any()):
                raise ValueError("a pixel is infinite or out of bounds")
            yield a, x


def discovered(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(path, kind) of scans under path or, where a folder tree has none, of frames; sorted, at most `most`."""
    scans = files.listed(spark, path, "*.sarscan", recursive=True).select("path", F.lit("scan").alias("kind"))
    frames = files.listed(spark, path, "*.sarframe", recursive=True).select("path", F.lit("frame").alias("kind"))
    every = scans.unionByName(frames)
    chosen = every.join(F.broadcast(every.agg(F.max("kind").alias("best"))), F.col("kind") == F.col("best")).select("path", "kind").orderBy("path")
    return chosen if most is None else chosen.limit(most)


def frame_rows(manifests: DataFrame) -> DataFrame:
    """The pixels of frames (path): path, row and value array<float>; NaN is nodata. A frame that does not hold together is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.opened(files.uri(path)) as f:
                    m = checked_manifest(f.read().decode())
                for a, x in _payload_rows(path, m):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(np.arange(a, a + len(x), dtype=np.int32)), list_array(x)], ["path", "row", "value"])

    return manifests.select("path").repartition("path").mapInArrow(run, "path string, row int, value array<float>")


def _stages(path: str, scan: dict) -> Iterator[tuple[str, str | None]]:
    """(stage, manifest's path or None) of a scan whose manifest holds together."""
    stages = scan["stages"]
    names = [s["id"] for s in stages]
    if scan["schema"] != "sar-scientific-scan-v1" or not 1 <= len(stages) <= MAX_STAGES or len(set(names)) != len(names) or not all(scan[k] for k in ("label", "source", "default_stage")):
        raise ValueError("a scan has up to 16 stages with names of their own, a label, a source and a default")
    for s in stages:
        ready = s["status"] == "available"
        if not ready and (s["status"] != "unavailable" or "manifest" in s or not s["reason"]):
            raise ValueError(f"stage {s['id']} is neither available nor explained")
        if ready and not re.fullmatch(r"[^/\\:]+", s["manifest"]):
            raise ValueError(f"stage {s['id']}: its manifest must be a file beside the scan's")
        yield s["id"], f"{path.rpartition('/')[0]}/{s['manifest']}" if ready else None
    if not any(s["id"] == scan["default_stage"] and s["status"] == "available" for s in stages):
        raise ValueError("the default stage is not available")


def validated(inputs: DataFrame) -> DataFrame:
    """A report on frames and scans (path, kind): path, stage (null for a frame), valid, problem, width, height, least, most, pixels without
    a value, and whether there is a geolocation. Each payload is read once, in runs of rows."""

    def check(path: str, stage: str | None) -> tuple:
        try:
            with files.opened(files.uri(path)) as f:
                m = checked_manifest(f.read().decode())
            low, high, empty = np.inf, -np.inf, 0
            for _, x in _payload_rows(path, m):
                seen = x[~np.isnan(x)]
                empty += x.size - seen.size
                if seen.size:
                    low, high = min(low, float(seen.min())), max(high, float(seen.max()))
            if low > high:
                raise ValueError("the frame has no valid pixels")
            return path, stage, True, None, m["width"], m["height"], low, high, empty, "geolocation" in m
        except (ValueError, KeyError, TypeError, OSError) as broken:
            return path, stage, False, f"{type(broken).__name__}: {broken}", None, None, None, None, None, None

    def rows(r: dict) -> Iterator[tuple]:
        if r["kind"] == "frame":
            yield check(r["path"], None)
            return
        try:
            with files.opened(files.uri(r["path"])) as f:
                found = list(_stages(r["path"], json.loads(f.read().decode())))
        except (ValueError, KeyError, TypeError, OSError) as broken:
            yield r["path"], None, False, f"{type(broken).__name__}: {broken}", None, None, None, None, None, None
            return
        for stage, manifest in found:
            if manifest is not None:
                _, _, *rest = check(manifest, stage)
                yield r["path"], stage, *rest

    return _mapped(inputs.select("path", "kind").repartition("path"), rows, "path string, stage string, valid boolean, problem string, width int, height int, least double, most double, empty long, geolocated boolean")
