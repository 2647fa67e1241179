"""Archives of pulses: NPZ raw echoes, MAT phase histories, provenance."""

from __future__ import annotations

import io
import math
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 512 << 20
#: Fixed values of the MAT-5 format: element types by number, and array classes for structures.
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _PACKED, _STRUCT = 14, 15, 2


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _member(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> np.ndarray:
    """One array of an archive, if its header is plain and promises exactly the bytes that are there."""
    readers = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    with archive.open(info) as raw:
        if (version := np.lib.format.read_magic(raw)) not in readers:
            raise ValueError(f"{info.filename}: NPY version {version}")
        shape, by_column, kind = readers[version](raw)
        size = math.prod(shape) * kind.itemsize
        if kind.hasobject or raw.tell() + size != info.file_size:
            raise ValueError(f"{info.filename}: objects, or a size that is not the header's")
        return np.frombuffer(raw.read(size), kind).reshape(shape, order="F" if by_column else "C")


def guarded(content: bytes, stage: str) -> dict[str, np.ndarray]:
    """The arrays of an NPZ archive that is of the stage asked for. Nothing of it is unpickled, and its unpacked size is
    held against MAX_BYTES, which one row of a task can hold, before anything is unpacked."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = archive.infolist()
        if sum(m.file_size for m in members) > MAX_BYTES:
            raise ValueError("the archive is too large")
        found = {m.filename.removesuffix(".npy"): _member(archive, m) for m in members}
    if (own := str(found.get("stage"))) != stage:
        raise ValueError(f"stage is {own}, not {stage}")
    return found


def raw_echoes(spark: SparkSession, path: str) -> DataFrame:
    """Pulses of raw-echo archives: path, pulse, re, im, receive_start_s, x, y, z, sampling_rate_hz, carrier_hz, replica_re, replica_im."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                a = guarded(content, "raw_echo")
                s, p = np.atleast_2d(a["samples"]), a["positions_m"]
                if p.shape != (len(s), 3) or a["receive_start_s"].shape != (len(s),) or not (np.isfinite(s).all() and np.isfinite(p).all()):
                    raise ValueError(f"{name}: shapes do not agree, or values are not finite")
                n = len(s)
                yield pd.DataFrame({
                    "path": [name] * n, "pulse": range(n), "re": list(s.real.astype(float)), "im": list(s.imag.astype(float)), "receive_start_s": a["receive_start_s"].astype(float),
                    "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "sampling_rate_hz": [float(a["sampling_rate_hz"])] * n, "carrier_hz": [float(a["carrier_hz"])] * n,
                    "replica_re": [a["replica"].real.astype(float)] * n, "replica_im": [a["replica"].imag.astype(float)] * n,
                })

    schema = "path string, pulse int, re array<double>, im array<double>, receive_start_s double, x double, y double, z double, sampling_rate_hz double, carrier_hz double, replica_re array<double>, replica_im array<double>"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def _elements(raw: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(raw):
        word, size = struct.unpack(f"{order}II", raw[at : at + 8])
        if word >> 16:
            yield word & 0xFFFF, raw[at + 4 : at + 4 + (word >> 16)]
            at += 8
            continue
        yield word, raw[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if word != _PACKED else 0)


def _matrix(raw: bytes, order: str) -> tuple[str, object]:
    parts = list(_elements(raw, order))
    flags = int(np.frombuffer(parts[0][1], f"{order}u4")[0])
    shape = np.frombuffer(parts[1][1], f"{order}i4")
    name = parts[2][1].decode("latin-1")
    if flags & 255 == _STRUCT:
        width = int(np.frombuffer(parts[3][1], f"{order}i4")[0])
        names = [parts[4][1][k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(parts[4][1]), width)]
        return name, {n: _matrix(body, order)[1] for n, (_, body) in zip(names, parts[5:], strict=False)}
    numbers = [np.frombuffer(body, order + MAT_TYPES[kind]).astype(float) for kind, body in parts[3:] if kind in MAT_TYPES]
    if not numbers:
        return name, None
    value = numbers[0] + 1j * numbers[1] if flags & 0x800 and len(numbers) > 1 else numbers[0]
    return name, value.reshape(shape, order="F")


def mat_variables(content: bytes) -> dict[str, object]:
    """Numeric arrays and scalar structures of a MAT-5 file; other classes are None."""
    if len(content) < 128 or content[126:128] not in (b"IM", b"MI"):
        raise ValueError("no MAT-5 file")
    order = "<" if content[126:128] == b"IM" else ">"
    out = {}
    for kind, body in _elements(content[128:], order):
        if kind == _PACKED:
            kind, body = next(_elements(zlib.decompress(body), order))
        if kind == _MATRIX:
            name, value = _matrix(body, order)
            out[name] = value
    return out


def phase_histories(spark: SparkSession, folder: str, first: int = 1, last: int = 4, passage: int = 1, polarisation: str = "HH") -> DataFrame:
    """Pulses of the azimuth files first..last: azimuth, nth, re, im, x, y, z, r0, az_deg, the frequencies, and af.

    Folders are searched to any depth. Each azimuth must have exactly one file,
    and all files one frequency axis. Rows sort by (azimuth, nth). af holds a
    producer's corrections (r_correct, ph_correct) as they are; nothing here
    applies them, as nothing says whether they were applied before.
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    found = F.regexp_extract("name", rf"^data_3dsar_pass{passage}_az(\d+)_{re.escape(polarisation)}\.mat$", 1)
    chosen = names.withColumn("azimuth", F.when(found != "", found.cast("int"))).where(F.col("azimuth").between(first, last))
    counts = {r["azimuth"]: r["count"] for r in chosen.groupBy("azimuth").count().collect()}
    if counts != {k: 1 for k in range(first, last + 1)}:
        raise ValueError(f"each azimuth from {first} to {last} needs one file; found {counts}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, azimuth, content in zip(batch["path"], batch["azimuth"], batch["content"], strict=True):
                d = mat_variables(content)["data"]
                f, s = d["freq"].ravel(), d["fp"].T
                n = len(s)
                if s.shape[1] != len(f) or any(d[c].size != n for c in ("x", "y", "z", "r0", "th")) or not np.isfinite(s).all():
                    raise ValueError(f"{name}: shapes do not agree, or values are not finite")
                af = d.get("af")
                if af is not None:
                    parts = [np.atleast_1d(np.asarray(af.get(k)).squeeze()) if isinstance(af, dict) else np.zeros(0) for k in ("r_correct", "ph_correct")]
                    if any(v.shape != (n,) or v.dtype.kind not in "fiu" or not np.isfinite(v).all() for v in parts):
                        raise ValueError(f"{name}: af must hold one real value for each pulse")
                    af = [{"r_correct": float(a), "ph_correct": float(b)} for a, b in zip(*parts, strict=True)]
                yield pd.DataFrame({
                    "azimuth": [azimuth] * n, "nth": range(n), "re": list(s.real), "im": list(s.imag), "x": d["x"].ravel(), "y": d["y"].ravel(), "z": d["z"].ravel(),
                    "r0": d["r0"].ravel(), "az_deg": d["th"].ravel(), "frequency_hz": [f] * n, "af": af or [None] * n,
                })

    def axis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"axis": [np.ascontiguousarray(mat_variables(c)["data"]["freq"].ravel()).tobytes() for c in batch["content"]]})

    schema = "azimuth int, nth int, re array<double>, im array<double>, x double, y double, z double, r0 double, az_deg double, frequency_hz array<double>, af struct<r_correct double, ph_correct double>"
    found = chosen.select("path", "azimuth", "content").mapInPandas(rows, schema)
    axes = chosen.select("path", "azimuth", "content").mapInPandas(axis, "axis binary").distinct().limit(2).count()
    if axes > 1:
        raise ValueError("the files differ in their frequency axes")
    return found
