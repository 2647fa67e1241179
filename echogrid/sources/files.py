"""Files beneath the binary sources and sinks: listing, byte ranges, and output that appears whole or not at all."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uri(path: str) -> str:
    """A path as Arrow's file systems take it; Spark writes file:/a for file:///a."""
    return re.sub(r"^file:/(?!/)", "file:///", path)


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri(path))


def opened(path: str) -> fs.NativeFile:
    store, where = located(path)
    return store.open_input_file(where)


def exists(path: str) -> bool:
    store, where = located(path)
    return store.get_file_info(where).type != fs.FileType.NotFound


def listed(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name, length) of files under path; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def private_name(path: str) -> str:
    """A name beside `path`, in the same store, that no other writer has."""
    return f"{uri(path).rstrip('/')}.{uuid.uuid4().hex}"


def _moved(private: str, path: str) -> None:
    if exists(path):
        raise FileExistsError(path)
    store, where = located(private)
    store.move(where, located(path)[1].rstrip("/"))


@contextmanager
def published(path: str) -> Iterator[str]:
    """A private folder beside `path` that becomes `path` when the block ends well, and goes when it does not.

    It is named as `path` is, with its scheme, so that Spark and Arrow write to
    the same store; a path without a scheme is one of the local disk for both.
    An existing target is refused at the start and again before the move.
    """
    if exists(path):
        raise FileExistsError(path)
    private = private_name(path)
    if "://" not in private:
        private = f"file://{private if private.startswith('/') else f'{os.getcwd()}/{private}'}"
    store, where = located(private)
    store.create_dir(where, recursive=True)
    try:
        yield private
        _moved(private, path)
    except BaseException:
        if store.get_file_info(where).type != fs.FileType.NotFound:
            store.delete_dir(where)
        raise


def write_rows(rows: DataFrame, path: str, expected: int, head: bytes = b"", tail: bytes = b"") -> None:
    """One file of `head`, the bytes of rows 0 to expected - 1 (row, bytes) in order, and `tail`.

    Tasks write bands of rows as parts; one more task streams the parts
    together, so neither the driver nor any task holds the file. A missing or
    repeated row is an error, and the file takes its name only when it is whole.
    """
    if exists(path):
        raise FileExistsError(path)
    spark = rows.sparkSession
    place = private_name(path)
    store, private = located(place)
    store.create_dir(private, recursive=True)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, first, last, store, top = None, "", 0, -1, *located(place)
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    name, first = f"{top}/{row:012d}-{uuid.uuid4().hex}", row
                    out = store.open_output_stream(name, compression=None)
                elif row != last + 1:
                    raise ValueError(f"row {row} follows row {last}")
                out.write(data)
                last = row
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"first": [first], "last": [last], "name": [name]})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = located(place)
        for batch in batches:
            with store.open_output_stream(f"{top}/whole", compression=None) as out:
                out.write(head)
                for name in batch.column(0)[0].as_py():
                    with store.open_input_stream(name) as part:
                        while block := part.read(1 << 22):
                            out.write(block)
                out.write(tail)
            yield pa.RecordBatch.from_pydict({"done": [1]})

    try:
        ordered = rows.select(F.col("row").cast("long").alias("row"), "bytes").repartitionByRange("row").sortWithinPartitions("row")
        found = sorted(map(tuple, ordered.mapInArrow(parts, "first long, last long, name string").collect()))
        ends = [-1, *[last for _, last, _ in found]]
        if [first for first, _, _ in found] != [x + 1 for x in ends[:-1]] or ends[-1] != expected - 1:
            raise ValueError(f"the rows are not 0 to {expected - 1}")
        spark.createDataFrame([([name for _, _, name in found],)], "names array<string>").coalesce(1).mapInArrow(joined, "done long").collect()
        _moved(f"{place}/whole", path)
    finally:
        store.delete_dir(private)


def write_bytes(path: str, content: bytes) -> None:
    """A small file that appears whole or not at all; an existing one is refused."""
    if exists(path):
        raise FileExistsError(path)
    private = private_name(path)
    store, where = located(private)
    with store.open_output_stream(where, compression=None) as out:
        out.write(content)
    _moved(private, path)
