"""Array columns of Arrow batches as NumPy matrices, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and where each list begins and ends; a null list is empty."""
    if column.null_count:
        column = column.fill_null(pa.scalar([], column.type))
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def equal_runs(column: pa.Array, rows: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of at most `rows` lists of one length, as (first, end, matrix)."""
    values, at = offsets(column)
    size, a = np.diff(at), 0
    while a < len(size):
        other = np.flatnonzero(size[a : a + rows] != size[a])
        b = a + int(other[0]) if len(other) else min(len(size), a + rows)
        yield a, b, values[at[a] : at[b]].reshape(b - a, int(size[a]))
        a = b


def list_array(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column with the matrix's rows."""
    cuts = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def map_complex(lines: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], re: str = "re", im: str = "im", rows: int = 64) -> DataFrame:
    """lines with re and im replaced by what the kernel makes of them: a complex matrix of some rows, to one with as many rows."""
    at, names = [lines.columns.index(c) for c in (re, im)], lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x in equal_runs(batch.column(at[0]), rows):
                other = offsets(batch.column(at[1]).slice(a, b - a))[0]
                if len(other) != x.size:
                    raise ValueError("real and imaginary parts differ in length")
                out = kernel(x + 1j * other.reshape(x.shape))
                part = {n: c for n, c in zip(names, batch.slice(a, b - a).columns, strict=True)}
                part[re], part[im] = list_array(out.real, pa.float64()), list_array(out.imag, pa.float64())
                yield pa.RecordBatch.from_arrays(list(part.values()), names)

    arrays = T.ArrayType(T.DoubleType())
    schema = T.StructType([T.StructField(f.name, arrays if f.name in (re, im) else f.dataType) for f in lines.schema])
    return lines.mapInArrow(run, schema)
