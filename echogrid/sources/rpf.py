"""Radar products: chunked files of images, annotations and geolocation grids, read and written by byte ranges.

A file is a row of chunks, each with a header of 8 bytes; an image chunk is
followed by its annotation chunk, which ends in the geolocation grid. The
catalog has a row for each image, read from the headers alone. Annotations,
grids and lines are further columns or rows that a query asks for: what is not
asked for is not read, and lines are read as byte ranges that tasks share.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import decode
from ..functions.lines import list_array, offsets
from . import files

#: Fixed values of the format: chunk sync, chunk types, header sizes, radar modes.
SYNC, IMAGE, ANNOTATION, END = 0xDCDC, 0, 200, 32768
IMAGE_HEADER, ANNOTATION_HEADER = 64, 64
MODES = {0: "seaspot", 1: "landspot", 2: "stripmap"}
#: Fixed values of the format: the annotation's sections in order, with their sizes.
SECTIONS = {"header": 64, "file_id": 64, "display": 64, "acquisition": 192, "seaspot": 48, "landspot": 32, "stripmap": 40, "processing_in": 136, "processing_out": 640, "aircraft": 64, "processing_id": 256}
_STARTS = dict(zip(SECTIONS, np.cumsum([0, *SECTIONS.values()]).tolist(), strict=False))
GRID_AT = sum(SECTIONS.values())
#: Where the number of grid lines stands: 64 bytes into the last 96 of the processing output.
_GRID_LINES = _STARTS["processing_out"] + 640 - 96 + 64
#: Fixed values of the format: the fields of each decoded section (name, type); `time` is a packed time, `xN` N bytes without meaning.
FIELDS = {
    "file_id": [("file_type", "i"), ("radar_mode", "i"), ("format_version", "16s"), ("file_name", "40s")],
    "acquisition": [
        ("aircraft_id", "6s"), ("_", "2x"), ("sortie_number", "8s"), ("current_mission_start", "time"), ("raw_mission_start", "time"), ("current_acquisition", "i"), ("raw_acquisition", "i"),
        ("current_acquisition_start", "time"), ("raw_acquisition_start", "time"), ("resolution", "I"), ("polarization", "I"), ("tape_file_name", "40s"),
    ],
    "seaspot": [("target_select", "I"), ("track_id", "i"), ("use_counter", "i"), ("velocity", "I"), ("latitude", "d"), ("longitude", "d"), ("speed", "f"), ("course", "f"), ("elevation", "f")],
    "landspot": [("target_select", "I"), ("track_id", "I"), ("use_counter", "I"), ("elevation", "f"), ("latitude", "d"), ("longitude", "d")],
    "stripmap": [("target_select", "I"), ("elevation", "f"), ("latitude", "d"), ("longitude", "d"), ("second_latitude", "d"), ("second_longitude", "d")],
    "aircraft": [("heading", "f"), ("speed", "f"), ("latitude", "d"), ("longitude", "d"), ("altitude", "d")],
}
OPAQUE = ("display", "processing_in", "processing_out", "processing_id")
#: Fixed values of the format: one line of a geolocation grid.
_KNOT = [("begin_lat", ">f8"), ("begin_lon", ">f8"), ("mid_lat", ">f8"), ("mid_lon", ">f8"), ("end_lat", ">f8"), ("end_lon", ">f8")]
GRID = np.dtype([("line", ">i4"), ("begin_ratio", ">f4"), ("mid_ratio", ">f4"), ("end_ratio", ">f4"), *_KNOT])
#: Bytes of a pixel by its type.
PIXEL_BYTES = {k: np.dtype(v).itemsize * (2 if k == 6 else 1) for k, v in decode.PIXELS.items()}

CATALOG = "path string, chunk int, mode string, radar_mode int, start int, lines int, pixels int, pixel_type int, frame int, rsp_inhibit int, margins array<int>, offset long, annotation_at long, grid_lines int"


def _read(f: pa.NativeFile, at: int, size: int, path: str) -> bytes:
    data = f.read_at(size, at)
    if len(data) != size:
        raise ValueError(f"{path}: cut short at byte {at}")
    return data


def chunks(f: pa.NativeFile, path: str) -> Iterator[tuple[int, int, int]]:
    """(type, first byte of the body, byte behind it) of each chunk up to the end chunk."""
    at, size = 0, f.size()
    while True:
        sync, kind, eighths = struct.unpack(">HHI", _read(f, at, 8, path))
        if sync != SYNC:
            raise ValueError(f"{path}: no chunk at byte {at}")
        if kind == END:
            return
        body, at = at + 8, at + 8 + 8 * eighths
        if at > size:
            raise ValueError(f"{path}: the chunk at byte {body - 8} is cut short")
        yield kind, body, at


def _images(path: str) -> Iterator[tuple]:
    """Rows of the catalog."""
    with files.opened(path) as f:
        every, nth = list(chunks(f, path)), 0
        for (kind, body, _), behind in zip(every, [*every[1:], None], strict=True):
            if kind != IMAGE:
                continue
            if behind is None or behind[0] != ANNOTATION:
                raise ValueError(f"{path}: image {nth} has no annotation")
            frame, width, height, pixel, inhibit, *margins = struct.unpack(">5i4H", _read(f, body, 28, path))
            mode = struct.unpack(">i", _read(f, behind[1] + _STARTS["file_id"] + 4, 4, path))[0]
            lines = struct.unpack(">I", _read(f, behind[1] + _GRID_LINES, 4, path))[0] & 0xFFFF
            start = struct.unpack(">i", _read(f, behind[1] + GRID_AT, 4, path))[0] if MODES.get(mode) == "stripmap" else frame
            yield path, nth, MODES.get(mode, str(mode)), mode, start, height, width, pixel, frame, inhibit, margins, body + IMAGE_HEADER, behind[1], lines
            nth += 1


def _mapped(df: DataFrame, rows, schema: T.StructType | str) -> DataFrame:
    """df's rows turned into others by a generator, one row at a time, as Arrow batches of a few thousand."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for batch in batches:
            for row in batch.to_pylist():
                for made in rows(row):
                    out.append(made)
                    if len(out) == 4096:
                        yield _batch(out, kind)
                        out = []
        if out:
            yield _batch(out, kind)

    return df.mapInArrow(run, kind)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each image chunk of the files under path, from their headers alone.

    start is the first line of the geolocation grid for a stripmap, and the
    frame number otherwise; offset is where the pixels begin.
    """
    return _mapped(files.listed(spark, path, pattern).select("path").repartition("path"), lambda r: _images(files.uri(r["path"])), CATALOG)


def _packed_time(raw: bytes):
    """A packed UTC time as (year, month, day, hour, minute, second, millisecond); None where it is not filled."""
    a, b, c = struct.unpack(">3H", raw[:6])
    found = a >> 4, a & 15, b >> 11, b >> 6 & 31, b & 63, c >> 10, c & 1023
    return found if found[1] and found[2] else None


def packed_time(year: int, month: int, day: int, hour: int, minute: int, second: int, milli: int) -> bytes:
    return struct.pack(">4H", year << 4 | month, day << 11 | hour << 6 | minute, second << 10 | milli, 0)


def _section(name: str, raw: bytes) -> dict:
    out, at = {}, 0
    for field, kind in FIELDS[name]:
        size = 8 if kind == "time" else struct.calcsize(f">{kind}")
        part, at = raw[at : at + size], at + size
        if kind == "time":
            when = _packed_time(part)
            out[field] = None if when is None else "{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}.{:03d}".format(*when)
        elif kind.endswith("s"):
            out[field] = part.split(b"\0")[0].decode("latin-1")
        elif not kind.endswith("x"):
            out[field] = struct.unpack(f">{kind}", part)[0]
    return out


_SPARK = {"i": T.IntegerType(), "I": T.LongType(), "f": T.FloatType(), "d": T.DoubleType()}


def _annotation_schema() -> T.StructType:
    def kind(code: str) -> T.DataType:
        return T.StringType() if code == "time" or code.endswith("s") else _SPARK[code]

    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("chunk", T.IntegerType())])
    for name in SECTIONS:
        if name in FIELDS:
            out.add(name, T.StructType([T.StructField(f, kind(k)) for f, k in FIELDS[name] if not k.endswith("x")]))
        elif name in OPAQUE:
            out.add(name, T.BinaryType())
    out.add("rectangle", T.StructType.fromDDL("start_line int, start_pixel int, lines int, pixels int"))
    return out.add("summary", T.StringType())


def annotations(images: DataFrame) -> DataFrame:
    """The decoded annotation of each row of a catalog: a struct for each known section, bytes for the opaque ones.

    Times are timestamps, null where they were not filled in. The image's
    rectangle is taken from the acquisition's spare bytes if it is positive and
    lies within the image, and else is (1, 1) without a size.
    """

    def rows(r: dict) -> Iterator[tuple]:
        with files.opened(r["path"]) as f:
            raw = _read(f, r["annotation_at"], GRID_AT, r["path"])
        part = {n: raw[a : a + SECTIONS[n]] for n, a in _STARTS.items()}
        line, pixel, height, width = struct.unpack(">4i", part["acquisition"][-88:-72])
        inside = min(line, pixel, height, width) > 0 and height <= r["lines"] and width <= r["pixels"]
        box = (line, pixel, height, width) if inside else (1, 1, 0, 0)
        known = {n: _section(n, part[n]) for n in FIELDS}
        name = known["file_id"]["file_name"]
        summary = f"fileType={known['file_id']['file_type']} radarMode={known['file_id']['radar_mode']} gridLines={r['grid_lines']}" + (f" fileId={name}" if name else "")
        sections = [known.get(n, part[n]) for n in SECTIONS if n in FIELDS or n in OPAQUE]
        yield r["path"], r["chunk"], *sections, dict(zip(("start_line", "start_pixel", "lines", "pixels"), box, strict=True)), summary

    found = _mapped(images.select("path", "chunk", "lines", "pixels", "annotation_at", "grid_lines"), rows, _annotation_schema())
    times = [f for f, k in FIELDS["acquisition"] if k == "time"]
    stamped = F.col("acquisition").withField(times[0], F.try_to_timestamp(F.col(f"acquisition.{times[0]}"), F.lit("yyyy-MM-dd HH:mm:ss.SSS")))
    for t in times[1:]:
        stamped = stamped.withField(t, F.try_to_timestamp(F.col(f"acquisition.{t}"), F.lit("yyyy-MM-dd HH:mm:ss.SSS")))
    return found.withColumn("acquisition", stamped)


def geolocation(images: DataFrame) -> DataFrame:
    """The grid lines of each row of a catalog: path, chunk, nth, line, three ratios and six coordinates."""
    kinds = ", ".join(f"{n} {'int' if n == 'line' else 'double'}" for n in GRID.names)

    def rows(r: dict) -> Iterator[tuple]:
        with files.opened(r["path"]) as f:
            raw = np.frombuffer(_read(f, r["annotation_at"] + GRID_AT, GRID.itemsize * r["grid_lines"], r["path"]), GRID)
        for nth, knot in enumerate(raw.tolist()):
            yield r["path"], r["chunk"], nth, *knot

    return _mapped(images.where("grid_lines > 0").select("path", "chunk", "annotation_at", "grid_lines"), rows, f"path string, chunk int, nth int, {kinds}")


def lines(images: DataFrame, first: int | None = None, last: int | None = None, task_bytes: int = 1 << 24) -> DataFrame:
    """The lines of each row of a catalog: path, chunk, line (counted from start for a stripmap, from 1 else) and pixels array<float>.

    Complex pixels come as magnitudes. Only the bytes of lines from `first` to
    `last` are read, in ranges of about task_bytes that are dealt to tasks.
    """
    known = images.where(F.col("pixel_type").isin(list(PIXEL_BYTES)) & (F.col("lines") > 0) & (F.col("pixels") > 0))
    bad = images.subtract(known).limit(1).count()
    if bad:
        raise ValueError("an image has no size or an unknown pixel type")
    size = F.col("pixels").cast("long") * F.element_at(F.create_map(*[F.lit(x) for kv in PIXEL_BYTES.items() for x in kv]), F.col("pixel_type"))
    begin = F.when(F.col("mode") == "stripmap", F.col("start")).otherwise(1)
    low = F.greatest(F.lit(0), F.lit(first) - begin) if first is not None else F.lit(0)
    high = F.least(F.col("lines"), F.lit(last) - begin + 1) if last is not None else F.col("lines")
    step = F.greatest(F.lit(1), F.floor(F.lit(task_bytes) / size)).cast("int")
    ranges = known.select("path", "chunk", "pixels", "pixel_type", begin.alias("begin"), size.alias("size"), "offset", low.alias("low"), high.alias("high"), step.alias("step")).where("low < high")
    ranges = ranges.withColumn("a", F.explode(F.sequence("low", F.col("high") - 1, F.col("step")))).withColumn("b", F.least(F.col("a") + F.col("step"), F.col("high")))
    ranges = ranges.repartition("path", "chunk", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with files.opened(r["path"]) as f:
                    raw = _read(f, r["offset"] + r["a"] * r["size"], (r["b"] - r["a"]) * r["size"], r["path"])
                image = decode.pixels(raw, r["pixels"], r["b"] - r["a"], r["pixel_type"])
                n = len(image)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n), pa.array([r["chunk"]] * n, pa.int32()), pa.array(np.arange(r["begin"] + r["a"], r["begin"] + r["b"], dtype=np.int32)), list_array(image)], ["path", "chunk", "line", "pixels"])

    return ranges.mapInArrow(run, "path string, chunk int, line int, pixels array<float>")


def encoded(values: np.ndarray, kind: int, truncate: bool = False) -> bytes:
    """Magnitudes as big-endian pixels: whole-number types are clamped and rounded half up, complex ones have no imaginary part."""
    x = np.nan_to_num(np.asarray(values, np.float64), nan=0.0, posinf=np.inf, neginf=-np.inf) if kind in (0, 1, 2) else np.asarray(values, np.float32)
    if kind in (0, 1, 2):
        top = {0: 255.0, 1: 65535.0, 2: 4294967295.0}[kind]
        return np.floor(np.clip(x, 0, top) + 0.5).clip(0, top).astype(decode.PIXELS[kind]).tobytes()
    if kind == 3:
        return x.astype(">f4").tobytes()
    if kind == 4:
        return decode.half_bytes(x, truncate)
    if kind == 5:
        return np.stack([x, np.zeros_like(x)], -1).astype(">f4").tobytes()
    if kind == 6:
        half = np.frombuffer(decode.half_bytes(x, truncate), ">u2").reshape(x.shape)
        return np.stack([half, np.zeros_like(half)], -1).astype(">u2").tobytes()
    raise ValueError(f"unknown pixel type {kind}")


def _chunk(kind: int, size: int) -> tuple[bytes, bytes]:
    """A chunk's header and the padding behind `size` bytes of body."""
    return struct.pack(">HHI", SYNC, kind, -(-size // 8)), bytes(-size % 8)


def annotation_bytes(sections: dict[str, dict | bytes], height: int, width: int, start_line: int = 1, start_pixel: int = 1, grid: list[tuple] = ()) -> bytes:
    """The annotation chunk of an image: sections as `annotations` names them (what is missing is zero) and its grid lines."""
    if not 2 <= len(grid) <= 5:
        raise ValueError("a product has 2 to 5 grid lines")
    body = b""
    for name, size in SECTIONS.items():
        given = sections.get(name, {})
        if isinstance(given, bytes):
            part = given
        else:
            part = b""
            for field, kind in FIELDS.get(name, []):
                value = given.get(field, b"" if kind.endswith("s") else None if kind == "time" else 0)
                if kind == "time":
                    part += bytes(8) if value is None else packed_time(*value)
                elif kind.endswith("x"):
                    part += bytes(int(kind[:-1]))
                else:
                    part += struct.pack(f">{kind}", value.encode("latin-1", "replace") if isinstance(value, str) else value)
        if len(part) > size:
            raise ValueError(f"section {name} is too long")
        if name == "acquisition" and not isinstance(given, bytes):
            part += struct.pack(">4i", start_line, start_pixel, height, width)
        if name == "processing_out" and not part:
            part = bytes(640 - 96 + 64) + struct.pack(">I", len(grid))
        body += part.ljust(size, b"\0")
    body += np.array([tuple(g) for g in grid], GRID).tobytes()
    head, pad = _chunk(ANNOTATION, len(body))
    return head + body + pad


def flat_lines(start_line: int, height: int, count: int = 2) -> list[tuple]:
    """Grid lines without coordinates: ratios of one at evenly spread lines, nothing else known."""
    return [(start_line + k * max(1, height // count), 1.0, 1.0, 1.0, *[float("nan")] * 6) for k in range(count)]


def encoded_rows(image: DataFrame, width: int, encode) -> DataFrame:
    """(row, bytes) of pixels (row, col, value): each row complete, in the order of its columns."""
    packed = image.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.col("value").cast("double").alias("value")))).alias("line"))
    packed = packed.select("row", F.col("line.col").alias("cols"), F.col("line.value").alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.arange(width)
        for batch in batches:
            # some megabytes of rows at a time
            step = max(1, (1 << 22) // (8 * width))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                (cols, at), (values, _) = offsets(part.column(1)), offsets(part.column(2))
                out = []
                for row, b, e in zip(part.column(0).to_pylist(), at[:-1] - at[0], at[1:] - at[0], strict=True):
                    if e - b != width or not np.array_equal(cols[b:e], whole) or part.column(2).values.null_count and np.isnan(values[b:e].astype(float)).any():
                        raise ValueError(f"row {row} is not complete")
                    out.append((row, encode(values[b:e].astype(float))))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["row", "bytes"])

    return packed.mapInArrow(run, "row long, bytes binary")


def write(image: DataFrame, path: str, height: int, width: int, pixel_type: int = 3, frame: int = 0, sections: dict[str, dict | bytes] | None = None, start_line: int = 1, start_pixel: int = 1, grid: list[tuple] | None = None, rsp_inhibit: int = 0, margins: tuple[int, int, int, int] = (0, 0, 0, 0), truncate: bool = False) -> None:
    """A product file of one image (row, col, value) with its annotation; rows are encoded and written by tasks.

    `truncate` cuts the mantissa of half floats off instead of rounding them.
    """
    if height <= 0 or width <= 0 or pixel_type not in PIXEL_BYTES:
        raise ValueError("a product needs an image with a size and a known pixel type")
    size = IMAGE_HEADER + height * width * PIXEL_BYTES[pixel_type]
    head, pad = _chunk(IMAGE, size)
    head += struct.pack(">5i4H", frame, width, height, pixel_type, rsp_inhibit, *margins).ljust(IMAGE_HEADER, b"\0")
    tail = pad + annotation_bytes(sections or {}, height, width, start_line, start_pixel, grid or flat_lines(start_line, height)) + _chunk(END, 0)[0]
    files.write_rows(encoded_rows(image, width, lambda x: encoded(x, pixel_type, truncate)), path, height, head, tail)


_NUMBERED = r"^(.*)_(\d+)(\.[^./]*)?$"


def sequence_base(path: Column) -> Column:
    """What a file's name has before its last underscore and number; null where it has no number."""
    return F.nullif(F.regexp_extract(path, _NUMBERED, 1), F.lit(""))


def first_sequence(names: DataFrame, path: str = "path") -> DataFrame:
    """Files whose names are a base, an underscore and a number: for each base, the unbroken run from its lowest number on.

    Returns (base, number, path). Of two files with one number the first by path counts.
    """
    from pyspark.sql import Window

    cut = names.select(sequence_base(F.col(path)).alias("base"), F.regexp_extract(path, _NUMBERED, 2).alias("digits"), F.col(path).alias("path")).where("base is not null")
    each = cut.groupBy("base", F.col("digits").cast("long").alias("number")).agg(F.min("path").alias("path"))
    own = Window.partitionBy("base").orderBy("number")
    runs = each.withColumns({"_run": F.col("number") - F.row_number().over(own), "_head": F.min("number").over(Window.partitionBy("base"))})
    return runs.where("_run = _head - 1").select("base", "number", "path")


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)
