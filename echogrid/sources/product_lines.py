"""Product lines as a Spark data source, for batches with filters pushed into the scan and for streams along a file sequence.

    product_lines.read(spark, path).where("line between 100 and 120 and frame = 7")

plans only files, images and byte ranges that the filters leave: path, chunk,
mode, frame and line are settled before a pixel is read. The option
pixels=false reads none at all. As a stream the source follows one sequence of
files (base_1, base_2, ...) as it grows; its offsets are (file number, chunk,
line), so a restart goes on exactly where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from ..functions import decode
from ..functions.lines import list_array
from . import files, rpf

SCHEMA = "path string, chunk int, mode string, frame int, line int, pixels array<float>"
#: Columns that are settled from names and headers.
_KNOWN = ("path", "chunk", "mode", "frame")


class Lines(ds.InputPartition):
    """Lines a to b - 1 (from 0) of one image."""

    def __init__(self, path: str, image: dict[str, Any], a: int, b: int):
        self.path, self.image, self.a, self.b = path, image, a, b

    @property
    def bytes(self) -> int:
        return (self.b - self.a) * self.image["size"]


def images_of(path: str) -> list[dict[str, Any]]:
    """The images of one file from its headers."""
    names = ("path", "chunk", "mode", "mode_code", "start", "lines", "pixels", "pixel_type", "frame", "inhibit", "margins", "offset", "annotation_at", "grid_lines")
    out = []
    for row in rpf._images(files.uri(path)):
        x = dict(zip(names, row, strict=True))
        if x["pixel_type"] not in rpf.PIXEL_BYTES or x["lines"] <= 0 or x["pixels"] <= 0:
            raise ValueError(f"{path}: image {x['chunk']} has no size or an unknown pixel type")
        out.append({k: x[k] for k in ("chunk", "mode", "frame", "lines", "pixels", "pixel_type", "offset")} | {"begin": x["start"] if x["mode"] == "stripmap" else 1, "size": x["pixels"] * rpf.PIXEL_BYTES[x["pixel_type"]]})
    return out


def _listed(path: str) -> list[str]:
    store, top = files.located(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def _test(f: ds.Filter) -> Callable[[Any], bool] | None:
    """What a filter asks of its column's value; None for filters that are not pushed."""
    kinds: dict[type, Callable[[Any], Callable[[Any], bool]]] = {
        ds.EqualTo: lambda v: lambda x: x == v,
        ds.GreaterThan: lambda v: lambda x: x > v,
        ds.GreaterThanOrEqual: lambda v: lambda x: x >= v,
        ds.LessThan: lambda v: lambda x: x < v,
        ds.LessThanOrEqual: lambda v: lambda x: x <= v,
        ds.In: lambda v: lambda x: x in v,
        ds.StringStartsWith: lambda v: lambda x: x.startswith(v),
        ds.StringEndsWith: lambda v: lambda x: x.endswith(v),
        ds.StringContains: lambda v: lambda x: v in x,
    }
    if isinstance(f, ds.IsNotNull):
        return lambda x: x is not None
    return kinds[type(f)](f.value) if type(f) in kinds else None


class _Read:
    """Reading ranges of lines, and cutting an image into them."""

    task_bytes: int
    pixels: bool

    def ranges(self, path: str, image: dict[str, Any], a: int, b: int) -> Iterator[Lines]:
        step = max(1, self.task_bytes // image["size"]) if self.pixels else max(1, b - a)
        for k in range(a, b, step):
            yield Lines(path, image, k, min(b, k + step))

    def read(self, part: Lines | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark makes of a plan without partitions
            return
        x, n = part.image, part.b - part.a
        if self.pixels:
            with files.opened(files.uri(part.path)) as f:
                raw = rpf._read(f, x["offset"] + part.a * x["size"], part.bytes, part.path)
            values = list_array(decode.pixels(raw, x["pixels"], n, x["pixel_type"]).astype(np.float32), pa.float32())
        else:
            values = pa.nulls(n, pa.list_(pa.float32()))
        line = pa.array(np.arange(x["begin"] + part.a, x["begin"] + part.b, dtype=np.int32))
        fixed = (pa.array([part.path] * n), pa.array([x["chunk"]] * n, pa.int32()), pa.array([x["mode"]] * n), pa.array([x["frame"]] * n, pa.int32()))
        yield pa.RecordBatch.from_arrays([*fixed, line, values], ["path", "chunk", "mode", "frame", "line", "pixels"])


class LineReader(_Read, ds.DataSourceReader):
    def __init__(self, path: str, task_bytes: int, pixels: bool):
        self.path, self.task_bytes, self.pixels = path, task_bytes, pixels
        self.asked: list[tuple[str, ds.Filter]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        self.asked = []
        for f in filters:
            column = getattr(f, "attribute", None)
            if column is not None and len(column) == 1 and (column[0] in _KNOWN or column[0] == "line") and _test(f) is not None:
                self.asked.append((column[0], f))
            else:
                yield f

    def _fits(self, column: str, value: Any) -> bool:
        return all(_test(f)(value) for c, f in self.asked if c == column)

    def partitions(self) -> list[Lines]:
        paths = [p for p in _listed(self.path) if self._fits("path", p)]
        if not paths:
            return []
        # headers alone; many files are looked at together
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(images_of, paths))
        out: list[Lines] = []
        for path, images in zip(paths, found, strict=True):
            for image in images:
                if all(self._fits(c, image[c]) for c in _KNOWN[1:]):
                    for a, b in self._runs(image):
                        out += self.ranges(path, image, a, b)
        return out

    def _runs(self, image: dict[str, Any]) -> list[tuple[int, int]]:
        """The runs of an image's lines (from 0) that the filters leave."""
        asked = [f for c, f in self.asked if c == "line"]
        low, high = image["begin"], image["begin"] + image["lines"] - 1
        for f in asked:
            if isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual)):
                low = max(low, f.value)
            if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual)):
                high = min(high, f.value)
            if isinstance(f, ds.GreaterThan):
                low = max(low, f.value + 1)
            if isinstance(f, ds.LessThan):
                high = min(high, f.value - 1)
        listed = [set(f.value) for f in asked if isinstance(f, ds.In)]
        if not listed:
            return [(low - image["begin"], high - image["begin"] + 1)] if low <= high else []
        lines = np.array(sorted(x for x in set.intersection(*listed) if x is not None and low <= x <= high), np.int64) - image["begin"]
        cuts = np.flatnonzero(np.diff(lines) > 1) + 1
        return [(int(run[0]), int(run[-1]) + 1) for run in np.split(lines, cuts) if len(run)]


class LineStream(_Read, ds.DataSourceStreamReader):
    """Offsets: {number, chunk, line} says that all lines before this one are read; a file that is there is there as a whole."""

    def __init__(self, path: str, base: str, task_bytes: int, pixels: bool):
        self.path, self.base, self.task_bytes, self.pixels = path, base, task_bytes, pixels

    def _sequence(self) -> list[tuple[int, str]]:
        """The sequence's files by number, up to the first gap."""
        own: dict[int, str] = {}
        for path in _listed(self.path):
            stem = path.rpartition("/")[2].split(".")[0]
            name, _, digits = stem.rpartition("_")
            if name == self.base and digits.isdigit():
                own.setdefault(int(digits), path)
        out: list[tuple[int, str]] = []
        for n in sorted(own):
            if out and n != out[-1][0] + 1:
                break
            out.append((n, own[n]))
        return out

    def initialOffset(self) -> dict[str, int]:
        return {"number": -1, "chunk": 0, "line": 0}

    def latestOffset(self) -> dict[str, int]:
        found = self._sequence()
        return {"number": found[-1][0] + 1, "chunk": 0, "line": 0} if found else self.initialOffset()

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Lines]:
        at = lambda o: (o["number"], o["chunk"], o["line"])
        out: list[Lines] = []
        for number, path in self._sequence():
            if not start["number"] <= number <= end["number"] or (number, 0, 0) >= at(end):
                continue
            for image in images_of(path):
                spot = (number, image["chunk"])
                a = start["line"] if spot == at(start)[:2] else 0 if spot > at(start)[:2] else image["lines"]
                b = min(image["lines"], end["line"]) if spot == at(end)[:2] else image["lines"] if spot < at(end)[:2] else 0
                out += self.ranges(path, image, a, b)
        return out

    def commit(self, end: dict[str, int]) -> None:
        """Nothing is held for batches that are done."""


class ProductLines(ds.DataSource):
    """Lines of product files. Options: path; task_bytes; pixels (false leaves them out); base, the sequence that a stream follows."""

    @classmethod
    def name(cls) -> str:
        return "rpflines"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[int, bool]:
        return int(self.options.get("task_bytes", 1 << 24)), str(self.options.get("pixels", "true")).lower() != "false"

    def reader(self, schema: Any) -> LineReader:
        return LineReader(self.options["path"], *self._options())

    def streamReader(self, schema: Any) -> LineStream:
        return LineStream(self.options["path"], self.options["base"], *self._options())


def _registered(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProductLines)


def read(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Lines of the files under path; filters on path, chunk, mode, frame and line decide which bytes are read.

    Spark keeps the reader of a DataFrame's last query, and its filters, for the
    next query that has none to push. The condition that is always there makes
    it ask anew each time.
    """
    _registered(spark)
    return spark.read.format("rpflines").options(path=path, **options).load().where("chunk is not null")


def follow(spark: SparkSession, path: str, base: str, **options: Any) -> DataFrame:
    """The lines of a sequence of files as a stream: what is there, and what is added behind it."""
    _registered(spark)
    return spark.readStream.format("rpflines").options(path=path, base=base, **options).load()


def keep(stream: DataFrame, folder: str, checkpoint: str) -> Any:
    """Writes a stream's batches as folder/batch=<id> for as long as there is something new, then ends; returns the query.

    A batch that is repeated after a failure replaces itself, so a restart with
    the same checkpoint neither loses nor repeats lines.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
