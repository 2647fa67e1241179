"""Binary radar files as Spark data sources.

Each source plans byte ranges on the driver from a few header bytes and reads
them in tasks, so a tape or a product of any size spreads over executors. Files
open through Arrow's file systems: local, HDFS or object stores alike.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

#: Fixed values of the tape format: record size, sync word, header and trailing test ramp, accessory prefix.
RECORD, SYNC, HEADER, RAMP, ACCESSORY = 2048, 0x0EB22000, 28, 76, 8192
BLOCK = 1 << 22


def _files(path: str) -> list[str]:
    store, top = files.located(path)
    info = store.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(top))
    return sorted(f"{path.rstrip('/')}/{x.base_name}" for x in found if x.type == fs.FileType.File)


_open = files.opened


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, more: tuple = ()):
        self.path, self.start, self.end, self.more = path, start, end, more


class _Tape(DataSourceReader):
    def __init__(self, path: str, records: int):
        self.path, self.records = path, records

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            with _open(path) as f:
                size, head = f.size(), f.read(4)
                start = 0
                if len(head) == 4 and struct.unpack(">I", head)[0] != SYNC and size >= ACCESSORY + 4:
                    start = ACCESSORY if struct.unpack(">I", f.read_at(4, ACCESSORY))[0] == SYNC else 0
            whole = (size - start) // RECORD
            out += [Range(path, start + k * RECORD, start + min(whole, k + self.records) * RECORD, (k,)) for k in range(0, whole, self.records)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        most = BLOCK // RECORD * RECORD
        with _open(part.path) as f:
            for k, at in enumerate(range(part.start, part.end, RECORD)):
                # the range is read in blocks of megabytes, not record by record
                inside = (at - part.start) % most
                if not inside:
                    block = f.read_at(min(most, part.end - at), at)
                raw = block[inside : inside + RECORD]
                kind, number, time = struct.unpack(">HHI", raw[4:12])
                data = raw[HEADER : RECORD - RAMP]
                if kind >> 12 == 0 and number == 1:
                    data = np.frombuffer(data, ">u2").astype("<u2").tobytes()
                yield part.path, part.more[0] + k, struct.unpack(">I", raw[:4])[0] == SYNC, kind >> 12, kind & 0xFFF, number, time, data


class SarTape(DataSource):
    """Tape records: path, ordinal, sync_valid, type, scene, number, time and the payload's I/Q bytes.

    A file may begin with an accessory record of 8192 bytes. The first of three
    equal headers counts; the test ramp at a record's end is left out; dummy
    records (type 0, number 1) have swapped bytes. Option records_per_task.
    """

    @classmethod
    def name(cls) -> str:
        return "sartape"

    def schema(self) -> str:
        return "path string, ordinal long, sync_valid boolean, type int, scene int, number int, time long, payload binary"

    def reader(self, schema) -> _Tape:
        return _Tape(self.options["path"], int(self.options.get("records_per_task", 32_768)))


class _Raster(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            with _open(path) as f:
                width, height = struct.unpack("<II", f.read(8))
                if f.size() != 8 + 4 * width * height:
                    raise ValueError(f"{path}: the payload does not have {width} x {height} floats")
            out += [Range(path, a, min(height, a + self.rows), (width,)) for a in range(0, height, self.rows)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        width = part.more[0]
        with _open(part.path) as f:
            raw = f.read_at(4 * width * (part.end - part.start), 8 + 4 * width * part.start)
        for k, row in enumerate(np.frombuffer(raw, "<f4").reshape(-1, width)):
            yield part.path, part.start + k, row.tolist()


class FloatRaster(DataSource):
    """Rasters of little-endian floats behind width and height: path, row, value array. Option rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "floatraster"

    def schema(self) -> str:
        return "path string, row int, value array<float>"

    def reader(self, schema) -> _Raster:
        return _Raster(self.options["path"], int(self.options.get("rows_per_task", 256)))


def register(spark: SparkSession) -> None:
    for source in (SarTape, FloatRaster):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, path: str, **options: int) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(path=path, **options).load()
