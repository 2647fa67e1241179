"""Elevation models in GeoTIFF files: validated from their directory, read by the byte ranges of strips or tiles.

Blocks may be plain, LZW or Deflate, with any of the three predictors. Rows and
tiles of any size are read by tasks, which fetch and unpack only the blocks that
they need.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import list_array
from . import files

#: Fixed values of the format: bytes and codes of the value types, and of samples by (format, bits).
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "Q"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Names of metres, and of datums whose heights are above the ellipsoid.
METRES = ("m", "metre", "metres", "meter", "meters")
ELLIPSOIDS = ("ellipsoid", "ellipsoidal", "hae", "wgs84", "wgs84 ellipsoid")


#: Compressions (none, LZW, Deflate and its older code) and predictors (none, differences, of floating-point bytes).
PLAIN, LZW, DEFLATE = 1, 5, (8, 32946)
DIFFERENCES, FLOAT_BYTES = 2, 3
#: Heights beyond these bounds are no terrain.
LOWEST, HIGHEST = -12_000.0, 100_000.0


class Elevation(NamedTuple):
    """A model's size, samples, blocks (strips or tiles: offsets and lengths row by row of the model, and their size), affine
    map (of column and row to x and y), EPSG code, nodata value, and what makes metres of a sample."""

    path: str
    rows: int
    cols: int
    kind: str
    offsets: list[int]
    lengths: list[int]
    block_rows: int
    block_cols: int
    compression: int
    predictor: int
    affine: tuple[float, float, float, float, float, float]
    epsg: int
    nodata: float | None
    scale: float
    offset: float

    @property
    def across(self) -> int:
        """Blocks side by side."""
        return -(-self.cols // self.block_cols)


def _tags(f: pa.NativeFile, path: str) -> tuple[str, dict[int, list]]:
    head = f.read_at(8, 0)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(f"{order}H", head[2:4])[0] != 42:
        raise ValueError(f"{path}: no TIFF file")
    at = struct.unpack(f"{order}I", head[4:8])[0]
    n = struct.unpack(f"{order}H", f.read_at(2, at))[0]
    raw, out = f.read_at(12 * n + 4, at + 2), {}
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", raw[12 * k : 12 * k + 8])
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        body = raw[12 * k + 8 : 12 * k + 12]
        if size * count > 4:
            body = f.read_at(size * count, struct.unpack(f"{order}I", body)[0])
        values = list(struct.unpack(f"{order}{count}{code}", body[: size * count]))
        out[tag] = [b"".join(values).split(b"\0")[0].decode("latin-1")] if kind == 2 else values
    if struct.unpack(f"{order}I", raw[-4:])[0]:
        raise ValueError(f"{path}: one image is expected")
    return order, out


def layout(path: str) -> Elevation:
    """The validated layout of one model: a single band of real numbers in strips, a CRS, an affine map that is no
    degenerate one, heights in metres, and no vertical datum but the ellipsoid."""
    with files.opened(files.uri(path)) as f:
        order, t = _tags(f, path)
    rows, cols = t[257][0], t[256][0]
    kind = _SAMPLES.get((t.get(339, [1])[0], t[258][0]))
    compression, predictor = t.get(259, [1])[0], t.get(317, [1])[0]
    if t.get(277, [1])[0] != 1 or min(rows, cols) < 2 or kind is None or not (273 in t or 324 in t):
        raise ValueError(f"{path}: a single band of at least 2 x 2 numbers in strips or tiles is expected")
    if compression not in (PLAIN, LZW, *DEFLATE) or predictor not in (1, DIFFERENCES, FLOAT_BYTES) or (predictor == FLOAT_BYTES) > (kind[0] == "f"):
        raise ValueError(f"{path}: compression {compression} with predictor {predictor} is not read")
    offsets, lengths = (t[324], t[325]) if 324 in t else (t[273], t.get(279))
    block_rows, block_cols = (t[323][0], t[322][0]) if 324 in t else (min(rows, t.get(278, [rows])[0]), cols)
    if lengths is None:
        lengths = [np.dtype(kind).itemsize * cols * min(block_rows, rows - k * block_rows) for k in range(len(offsets))]
    if len(offsets) != len(lengths) or len(offsets) != -(-rows // block_rows) * -(-cols // block_cols):
        raise ValueError(f"{path}: {len(offsets)} blocks do not cover the model")
    keys = t.get(34735, [])
    pairs = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    epsg = pairs.get(2048) or pairs.get(3072)
    if not epsg or pairs.get(1024) not in (1, 2):
        raise ValueError(f"{path}: a geographic or projected CRS is needed")
    if 34264 in t:
        m = t[34264]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif 33550 in t and len(t.get(33922, [])) == 6:
        (sx, sy, *_), (i, j, _, x, y, _) = t[33550], t[33922]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        raise ValueError(f"{path}: control points must be turned into an affine grid first")
    if not np.isfinite(affine).all() or abs(affine[0] * affine[4] - affine[1] * affine[3]) < 1e-20:
        raise ValueError(f"{path}: the affine map is degenerate")
    if pairs.get(1025, 1) == 2:  # a sample stands for a point: its pixel begins half a step before it
        a = affine
        affine = (a[0], a[1], a[2] - (a[0] + a[1]) / 2, a[3], a[4], a[5] - (a[3] + a[4]) / 2)
    if pairs.get(1024) == 1 and not (32601 <= epsg <= 32660 or 32701 <= epsg <= 32760):
        raise ValueError(f"{path}: EPSG {epsg} is no UTM zone of WGS84, nor geographic")
    notes = {name.lower(): value.strip().lower() for name, value in re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', t.get(42112, [""])[0])}
    scale, offset = float(notes.get("scale", 1)), float(notes.get("offset", 0))
    if not np.isfinite([scale, offset]).all() or scale == 0:
        raise ValueError(f"{path}: scale and offset must be finite, and the scale not zero")
    if notes.get("unittype") not in METRES:
        raise ValueError(f"{path}: heights must be declared in metres")
    if any(notes[k] not in ELLIPSOIDS for k in ("vertical_datum", "height_reference") if k in notes):
        raise ValueError(f"{path}: heights above the ellipsoid are needed")
    nodata = float(t[42113][0]) if 42113 in t else None
    return Elevation(path, rows, cols, order + kind, offsets, lengths, block_rows, block_cols, compression, predictor, affine, epsg, nodata, scale, offset)


def unpacked_lzw(raw: bytes) -> bytes:
    """The bytes of an LZW stream as TIFF has it: codes of 9 to 12 bits, the highest bit first, one code earlier longer."""
    table: list[bytes] = []
    out, last, width, waiting, have = [], b"", 9, 0, 0
    for byte in raw:
        waiting, have = (waiting << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = waiting >> have & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        if code > len(table) or (code == len(table) and not last):
            raise ValueError("a damaged LZW stream")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def _unpack(x: Elevation, raw: bytes, height: int) -> np.ndarray:
    """The samples of one block, `height` rows of its full width."""
    kind = np.dtype(x.kind)
    if x.compression != PLAIN:
        raw = unpacked_lzw(raw) if x.compression == LZW else zlib.decompress(raw)
    size = height * x.block_cols * kind.itemsize
    if len(raw) < size:
        raise ValueError(f"{x.path}: a block is cut short")
    if x.predictor == FLOAT_BYTES:
        # each row: differences of bytes, the highest bytes of all samples first
        planes = np.cumsum(np.frombuffer(raw[:size], np.uint8).reshape(height, -1), axis=1, dtype=np.uint8)
        return np.ascontiguousarray(planes.reshape(height, kind.itemsize, x.block_cols).transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0].astype(float)
    values = np.frombuffer(raw[:size], kind).reshape(height, x.block_cols)
    if x.predictor == DIFFERENCES:
        whole = values.view(f"{kind.str[0]}u{kind.itemsize}")
        values = np.cumsum(whole, axis=1, dtype=whole.dtype.newbyteorder("=")).view(kind.newbyteorder("="))
    return values.astype(float)


def heights(x: Elevation, r0: int, r1: int, c0: int, c1: int) -> np.ndarray:
    """Metres in rows r0 to r1 - 1 and columns c0 to c1 - 1, NaN where there is none; only the blocks that hold them are read."""
    out = np.full((r1 - r0, c1 - c0), np.nan)
    kind = np.dtype(x.kind)
    with files.opened(files.uri(x.path)) as f:
        for i in range(r0 // x.block_rows, -(-r1 // x.block_rows)):
            top = i * x.block_rows
            low, high = max(r0, top), min(r1, top + x.block_rows)
            for j in range(c0 // x.block_cols, -(-c1 // x.block_cols)):
                left, k = j * x.block_cols, i * x.across + j
                if x.lengths[k] == 0 and x.offsets[k] == 0:  # a block that was never written
                    continue
                full = min(x.block_rows, x.rows - top) if x.block_cols == x.cols else x.block_rows
                if x.compression == PLAIN and x.predictor == 1:  # rows of a plain block lie one after the other
                    line = x.block_cols * kind.itemsize
                    raw = f.read_at((high - low) * line, x.offsets[k] + (low - top) * line)
                    block = _unpack(x, raw, high - low)
                else:
                    block = _unpack(x, f.read_at(x.lengths[k], x.offsets[k]), full)[low - top : high - top]
                a, b = max(c0, left), min(c1, left + x.block_cols)
                out[low - r0 : high - r0, a - c0 : b - c0] = block[:, a - left : b - left]
    if x.nodata is not None:
        out[out == x.nodata] = np.nan
    return out * x.scale + x.offset


def rows(spark: SparkSession, path: str, first: int = 0, last: int | None = None, window: int = 256) -> DataFrame:
    """Rows first to last - 1 of one model as (row, value array<double>); NaN where there is no height. A task for each window of whole blocks."""
    x = layout(path)
    end = min(x.rows, x.rows if last is None else last)
    step = -(-window // x.block_rows) * x.block_rows if x.compression != PLAIN else window
    cuts = [first, *range((first // step + 1) * step, end, step), end]
    parts = spark.createDataFrame(list(zip(cuts, cuts[1:], strict=False)), "a int, b int").where("a < b").repartition("a")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b, dtype=np.int32)), list_array(heights(x, a, b, 0, x.cols))], ["row", "value"])

    return parts.mapInArrow(read, "row int, value array<double>")


def tiles(spark: SparkSession, path: str, size: int = 256) -> DataFrame:
    """The whole model in tiles of `size` cells and one more row and column of their neighbours: (tile_row, tile_col, heights binary of doubles).

    What lies beyond the model is NaN. A tile is read by one task, from the byte
    ranges of the blocks that it meets.
    """
    x = layout(path)
    down, across = -(-x.rows // size), -(-x.cols // size)
    listed = spark.range(down * across).select((F.col("id") / across).cast("int").alias("tile_row"), (F.col("id") % across).cast("int").alias("tile_col"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                tile = np.full((size + 1, size + 1), np.nan)
                found = heights(x, i * size, min(x.rows, (i + 1) * size + 1), j * size, min(x.cols, (j + 1) * size + 1))
                tile[: found.shape[0], : found.shape[1]] = found
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([tile.tobytes()], pa.binary())], ["tile_row", "tile_col", "heights"])

    return listed.mapInArrow(read, "tile_row int, tile_col int, heights binary")


def window_around(spark: SparkSession, path: str, lonlat: list[tuple[float, float]], margin: int = 2, most: int = 16_777_216) -> tuple[np.ndarray, tuple[float, ...]]:
    """The heights around some places (in the model's own coordinates) as a matrix, with its affine map; for `terrain.surface`.

    A window beyond `most` cells is refused, as it is to be broadcast; `terrain.surface_by_tiles` has no such limit.
    """
    x = layout(path)
    a, det = x.affine, x.affine[0] * x.affine[4] - x.affine[1] * x.affine[3]
    at = np.array([((a[4] * (u - a[2]) - a[1] * (v - a[5])) / det, (a[0] * (v - a[5]) - a[3] * (u - a[2])) / det) for u, v in lonlat])
    (c0, r0), (c1, r1) = np.floor(at.min(0)).astype(int) - margin, np.ceil(at.max(0)).astype(int) + margin
    r0, c0, r1, c1 = max(0, r0), max(0, c0), min(x.rows, r1), min(x.cols, c1)
    if r1 - r0 < 2 or c1 - c0 < 2 or (r1 - r0) * (c1 - c0) > most:
        raise ValueError("the places lie outside the model, or need a window that is too large")
    found = sorted((r["row"], r["value"][c0:c1]) for r in rows(spark, path, int(r0), int(r1)).collect())
    return np.array([v for _, v in found]), (a[0], a[1], a[2] + a[0] * c0 + a[1] * r0, a[3], a[4], a[5] + a[3] * c0 + a[4] * r0)
