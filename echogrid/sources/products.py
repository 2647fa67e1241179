"""Sinks for images and reports: rasters, TIFF, PNG, image sets, frame and scan bundles, JSON and text."""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import measure, preview
from . import files
from .binary import HEADER, RAMP, RECORD, SYNC
from .rpf import encoded_rows


def tape_record(kind: int, scene: int, number: int, time: int, payload: bytes) -> bytes:
    """One 2048-byte record with its three headers."""
    room = RECORD - HEADER - RAMP
    return struct.pack(">I", SYNC) + struct.pack(">HHI", kind << 12 | scene, number, time) * 3 + payload[:room].ljust(room, b"\0") + bytes(RAMP)


def write_tape(records: DataFrame, path: str) -> DataFrame:
    """Tape files, one a task, from (type, scene, number, time, payload); returns (file, records)."""

    def run(batches):
        import pyarrow as pa

        store, top = files.located(path)
        store.create_dir(top, recursive=True)
        name = f"{top}/tape-{TaskContext.get().partitionId():05d}.dat"
        # attempts of one task write files of their own; each becomes the same file when it is whole
        own, n = f"{name}.{uuid.uuid4().hex}", 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    out.write(tape_record(r["type"], r["scene"], r["number"], r["time"], r["payload"]))
                    n += 1
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return records.select("type", "scene", "number", "time", "payload").mapInArrow(run, "file string, records long")


def write_raster(image: DataFrame, path: str, rows: int, cols: int, nodata: bool = False) -> None:
    """A raster file of little-endian floats behind width and height, from magnitudes (row, col, value).

    Values that are negative, not finite or too large are errors; with
    `nodata`, NaN stands for pixels without a value and is written as such.
    """
    value = measure.narrowed(F.col("value").cast("double"))
    if nodata:
        value = F.when(F.isnan("value") | F.col("value").isNull(), float("nan")).otherwise(value)
    whole = image.select("row", "col", value.cast("double").alias("value"))
    files.write_rows(encoded_rows(whole, cols, lambda x: x.astype("<f4").tobytes()), path, rows, struct.pack("<II", cols, rows))


def tiff_tail(rows: int, cols: int, at: int = 8, bits: int = 16, extra: list[tuple[int, int, list]] = ()) -> tuple[bytes, bytes]:
    """The header of a little-endian TIFF of one strip, and the directory behind its pixels.

    extra has further tags as (tag, type, values); their values follow the directory.
    """
    size = rows * cols * bits // 8
    if 8 + size > 0xFFFFFF00:
        raise ValueError("a TIFF of this kind holds less than 4 GB")
    #: Fixed values of the format: size, depth, no compression, black is zero, one strip of one sample.
    tags = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [bits]), (259, 3, [1]), (262, 3, [1]), (273, 4, [at]), (277, 3, [1]), (278, 4, [rows]), (279, 4, [size])]
    tags = sorted([*tags, *extra])
    codes = {2: "B", 3: "H", 4: "I", 12: "d"}
    directory, behind, start = b"", b"", 8 + size + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        raw = struct.pack(f"<{len(values)}{codes[kind]}", *values)
        if len(raw) > 4:
            place = struct.pack("<I", start + len(behind))
            behind += raw
        else:
            place = raw.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kind, len(values)) + place
    return struct.pack("<2sHI", b"II", 42, 8 + size), struct.pack("<H", len(tags)) + directory + bytes(4) + behind


def _scaled_tiff(image: DataFrame, path: str, rows: int, cols: int, low: float, high: float, factor: float = 1.0) -> None:
    span = high - low if high > low else 1.0
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("value") - low) / span * factor))
    head, tail = tiff_tail(rows, cols)
    pixels = image.select("row", "col", F.floor(level * 65535 + 0.5).cast("double").alias("value"))
    files.write_rows(encoded_rows(pixels, cols, lambda x: x.astype("<u2").tobytes()), path, rows, head, tail)


def write_tiff(image: DataFrame, path: str, rows: int, cols: int) -> None:
    """A 16-bit TIFF of (row, col, value) from its least to its largest value."""
    low, high = image.agg(F.min("value"), F.max("value")).first()
    _scaled_tiff(image, path, rows, cols, low, high)


def write_percentile_tiff(image: DataFrame, path: str, rows: int, cols: int, lower: float = 0.0, upper: float = 1.0, factor: float = 1.0) -> None:
    """A 16-bit TIFF between two exact order statistics; levels are multiplied by `factor` before they are cut off."""
    shares = [min(1.0, max(0.0, p)) for p in (lower, upper)]
    found = {r["share"]: r["value"] for r in measure.order_statistics(image, "value", shares).collect()}
    low, high = sorted(found[p] for p in shares)
    _scaled_tiff(image, path, rows, cols, low, high, factor)


def write_float_tiff(image: DataFrame, path: str, rows: int, cols: int, scale: tuple[float, float], corner: tuple[float, float], epsg: int, nodata: str = "nan") -> None:
    """A float TIFF of (row, col, value) with pixel size, top left corner and EPSG code as GeoTIFF tags."""
    geographic = epsg < 5000
    keys = [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]
    extra = [(339, 3, [3]), (33550, 12, [scale[0], scale[1], 0.0]), (33922, 12, [0.0, 0.0, 0.0, corner[0], corner[1], 0.0]), (34735, 3, keys), (42113, 2, list(nodata.encode() + b"\0"))]
    head, tail = tiff_tail(rows, cols, bits=32, extra=extra)
    files.write_rows(encoded_rows(image, cols, lambda x: x.astype("<f4").tobytes()), path, rows, head, tail)


def png(gray: np.ndarray) -> bytes:
    """A gray or colour PNG of a matrix (rows x cols, or rows x cols x 3 or 4) of bytes."""
    x = np.ascontiguousarray(gray, np.uint8)
    kind = {2: 0, 3: {3: 2, 4: 6}.get(x.shape[-1], 0)}[x.ndim]
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((len(x), 1), np.uint8), x.reshape(len(x), -1)], 1)
    head = struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def write_preview(image: DataFrame, path: str, rows: int, cols: int, dynamic_range: float = 50.0, most: int = 1600) -> None:
    """A PNG of decibels under the peak. The image is reduced, by mean power, to at most `most` pixels a side before
    any of it comes to the driver, so what comes is bounded."""
    if not 1 <= dynamic_range <= 120:
        raise ValueError("the dynamic range must be between 1 and 120 dB")
    height, width = preview.reduced_shape(rows, cols, most)
    small = preview.reduced(image, rows, cols, height, width)
    top = small.agg(F.max("value").alias("top"))
    level = small.join(F.broadcast(top)).select("row", "col", preview.level_db(F.col("value"), F.col("top"), dynamic_range).alias("gray"))
    out = np.zeros((height, width), np.uint8)
    for r in level.collect():
        out[r["row"], r["col"]] = r["gray"]
    files.write_bytes(path, png(out))


def write_image_set(image: DataFrame, folder: str, rows: int, cols: int, dynamic_range: float = 50.0, reference: dict | None = None) -> None:
    """A formed image (row, col, re, im) as a folder: complex pixels as Parquet, magnitudes as a raster, a preview, and with a
    reference (scale, corner, epsg) a georeferenced TIFF. The folder appears whole or not at all."""
    size = F.hypot("re", "im")
    magnitude = image.select("row", "col", size.alias("value"))
    with files.published(folder) as work:
        image.write.parquet(f"{work}/complex")
        write_raster(magnitude, f"{work}/image.raw", rows, cols)
        write_preview(magnitude, f"{work}/image.png", rows, cols, dynamic_range)
        if reference is not None:
            write_float_tiff(magnitude, f"{work}/magnitude_native.tif", rows, cols, **reference)


def write_json(path: str, report: dict | list) -> None:
    """A JSON report; NaN and infinities are errors."""
    files.write_bytes(path, (json.dumps(report, indent=2, allow_nan=False) + "\n").encode())


def report_text(report: dict, prefix: str = "") -> Iterator[str]:
    """key=value lines of a nested report; lists count, and their entries follow by number."""
    for key, value in report.items():
        name = f"{prefix}{key}"
        if isinstance(value, dict):
            yield from report_text(value, f"{name}.")
        elif isinstance(value, list):
            yield f"{name}.count={len(value)}"
            for k, x in enumerate(value):
                yield from report_text(x if isinstance(x, dict) else {str(k): x}, f"{name}.{k}." if isinstance(x, dict) else f"{name}.")
        else:
            yield f"{name}={'' if value is None else value}"


def write_report(path: str, report: dict, form: str | None = None) -> None:
    """A report as JSON where the path ends in .json (or form is `json`), and else as key=value lines."""
    if (form or ("json" if path.endswith(".json") else "text")) == "json":
        write_json(path, report)
    else:
        files.write_bytes(path, ("\n".join(report_text(report)) + "\n").encode())


def _plain(row) -> dict:
    """A row as JSON takes it: structs as objects, times as text, bytes left out."""

    def value(x):
        if hasattr(x, "asDict"):
            return _plain(x)
        if isinstance(x, list):
            return [value(v) for v in x]
        if isinstance(x, float) and not math.isfinite(x):
            return None
        return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)

    return {k: value(v) for k, v in row.asDict().items() if not isinstance(v, (bytes, bytearray))}


def annotation_report(path: str, annotation: DataFrame, grid: DataFrame, x: DataFrame, y: DataFrame) -> None:
    """The annotation of one image with its grid (2 to 5 lines) and the peak statistics of both axes."""
    stats = {n: _plain(df.first()) for n, df in (("x", x), ("y", y))}
    write_report(path, {"annotation": _plain(annotation.first()), "grid": [_plain(r) for r in grid.orderBy("nth").collect()], "pta": stats})


def auto_pta_report(path: str, annotation: DataFrame, entries: DataFrame) -> None:
    """Peak statistics of automatically found lines (line, x, y) of one image."""
    write_report(path, {"annotation": _plain(annotation.first()), "entries": [_plain(r) for r in entries.orderBy("line").collect()]})


def lines_report(path: str, lines: DataFrame) -> None:
    """Lines (line) that are to be processed again, in order."""
    found = sorted(r["line"] for r in lines.select("line").distinct().collect())
    write_report(path, {"count": len(found), "lines": found})


def series_report(path: str, parameters: dict, results: DataFrame, order: str, summary: dict | None = None) -> None:
    """A registration's or a focus search's parameters and its results by frame; the results are streamed to the driver."""
    write_json(path, {**(summary or {}), "params": parameters, "results": [_plain(r) for r in results.orderBy(order).toLocalIterator()]})


def write_frame(image: DataFrame, folder: str, rows: int, cols: int, product: str, source: str, geolocation: dict | None = None, name: str = "frame", phase: bool = False) -> dict:
    """A raster with NaN as nodata and its manifest in an existing folder; returns the manifest."""
    if product == "geocoded_magnitude" and geolocation is None:
        raise ValueError("a geocoded frame needs its geolocation")
    valid = image.where(~F.isnan("value") & F.col("value").isNotNull()).limit(1).count()
    if not valid:
        raise ValueError("the frame has no valid pixels")
    if phase:
        whole = image.select("row", "col", F.coalesce(F.col("value").cast("double"), F.lit(float("nan"))).alias("value"))
        files.write_rows(encoded_rows(whole, cols, lambda x: x.astype("<f4").tobytes()), f"{folder}/{name}.raw", rows, struct.pack("<II", cols, rows))
    else:
        write_raster(image, f"{folder}/{name}.raw", rows, cols, nodata=True)
    manifest = {"schema": "sar-scientific-frame-v1", "width": cols, "height": rows, "data_file": f"{name}.raw", "product": product, "units": "radians" if phase else "uncalibrated magnitude DN", "source": source}
    if phase:
        manifest["display_scale"] = "phase_radians"
    if geolocation is not None:
        manifest["geolocation"] = geolocation
    write_json(f"{folder}/{name}.sarframe", manifest)
    return manifest


def write_scan(stages: dict[str, dict], folder: str, label: str, source: str, default: str, most: int = 512) -> None:
    """A bundle of a scan's stages: each is {image, rows, cols, product, phase} or {reason}. Previews of at most `most` pixels a
    side are written as frames, the scan's manifest last, and the folder appears whole or not at all."""
    if default not in stages or "reason" in stages[default] or len(stages) > 16:
        raise ValueError("a scan has up to 16 stages, and its default stage must be available")
    with files.published(folder) as work:
        listed = []
        for stage, s in stages.items():
            if "reason" in s:
                listed.append({"id": stage, "label": stage, "status": "unavailable", "reason": s["reason"]})
                continue
            height, width = preview.reduced_shape(s["rows"], s["cols"], most, whole=True)
            small = (preview.centre_phase if s.get("phase") else preview.reduced)(s["image"], s["rows"], s["cols"], height, width)
            write_frame(small, work, height, width, s["product"], source, name=stage, phase=bool(s.get("phase")))
            listed.append({"id": stage, "label": stage, "status": "available", "manifest": f"{stage}.sarframe"})
        write_json(f"{work}/scan.sarscan", {"schema": "sar-scientific-scan-v1", "label": label, "source": source, "default_stage": default, "stages": listed})


def legacy_outputs(image: DataFrame, folder: str, rows: int, cols: int, fast: bool = False, lower: float = 0.0, upper: float = 1.0, factor: float = 1.0, states: dict[str, dict] | None = None) -> dict:
    """The older image's folder: TIFF, percentile TIFF unless fast, raster, and metadata with the scale of the 16-bit levels."""
    low, high = image.agg(F.min("value"), F.max("value")).first()
    span = high - low if high > low else 1.0
    meta = {"width": cols, "height": rows, "min": low, "max": high, "scale": 65535.0 / span, "offset": low, "algorithm": "magnitude of a two-dimensional FFT, a demonstration"}
    with files.published(folder) as work:
        write_tiff(image, f"{work}/image.tif", rows, cols)
        if not fast:
            write_percentile_tiff(image, f"{work}/image_normalized.tif", rows, cols, lower, upper, factor)
        write_raster(image, f"{work}/image.raw", rows, cols)
        write_json(f"{work}/image.json", meta)
        for name, report in (states or {}).items():
            write_json(f"{work}/{name}.json", report)
    return meta


def copy_file(source: str, target: str) -> None:
    """A file copied in blocks, appearing whole or not at all."""
    a, b = files.located(source), files.located(target)
    fs.copy_files(a[1], b[1], source_filesystem=a[0], destination_filesystem=b[0])
