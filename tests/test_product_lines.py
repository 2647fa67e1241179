"""The product data source: bytes that filters leave, and streams that go on after a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.sources import files, product_lines, rpf


def write(spark, path, start, lines=20, cols=8, frame=1, mode=2):
    values = [(r, c, float(100 * (start + r) + c)) for r in range(lines) for c in range(cols)]
    grid = [(start, 1.0, 1.0, 1.0, *[0.0] * 6), (start + lines - 1, 1.0, 1.0, 1.0, *[0.0] * 6)]
    rpf.write(spark.createDataFrame(values, "row int, col int, value double"), path, lines, cols, 3, frame=frame, sections={"file_id": {"radar_mode": mode}}, grid=grid)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("lines")
    write(spark, f"{top}/s_1.rpf", 1)
    write(spark, f"{top}/s_2.rpf", 21)
    write(spark, f"{top}/f_1.rpf", 1, lines=5, frame=7, mode=0)
    return str(top)


def test_filters_are_settled_before_pixels_are_read(spark, folder):
    every = product_lines.read(spark, folder, task_bytes=200)
    assert every.count() == 45
    assert [r.pixels[0] for r in every.where("mode = 'stripmap'").orderBy("line").collect()] == [100.0 * k for k in range(1, 41)]
    for where, lines in (("line between 18 and 23", 6 + 0), ("frame = 7", 5), ("line in (3, 4, 9, 22) and mode = 'stripmap'", 4), ("path like '%s_2.rpf' and line > 38", 2), ("line = 5 or line = 6", None), ("chunk = 1", 0), ("size(pixels) = 8 and line <= 2 and frame <> 7", None)):
        found = every.where(where)
        want = product_lines.read(spark, folder).cache().where(where).count()
        assert found.count() == want
        assert lines is None or want == lines
    assert every.count() == 45


def test_bytes_that_are_read(folder, monkeypatch):
    """Of all pixel bytes only those of the asked lines are read, and of files that the path filter excludes not even headers."""
    from pyspark.sql import datasource as ds

    opened, real = [], files.opened

    class Counted:
        def __init__(self, f, path):
            self.f, self.path = f, path

        def __enter__(self):
            self.f.__enter__()
            return self

        def __exit__(self, *x):
            return self.f.__exit__(*x)

        def read_at(self, n, at):
            opened.append((self.path.rpartition("/")[2], n))
            return self.f.read_at(n, at)

        def size(self):
            return self.f.size()

    monkeypatch.setattr(files, "opened", lambda path: Counted(real(path), path))
    reader = product_lines.LineReader(folder, 1 << 20, True)
    other = ds.Not(ds.EqualTo(("frame",), 7))
    left = list(reader.pushFilters([ds.StringEndsWith(("path",), "s_2.rpf"), ds.GreaterThanOrEqual(("line",), 25), ds.LessThan(("line",), 28), other]))
    assert left == [other]
    parts = reader.partitions()
    assert {name for name, _ in opened} == {"s_2.rpf"}
    assert sum(n for _, n in opened) < 500
    opened.clear()
    batches = [b for p in parts for b in reader.read(p)]
    assert opened == [("s_2.rpf", 3 * 8 * 4)]
    assert [x for b in batches for x in b.column("line").to_pylist()] == [25, 26, 27]
    opened.clear()
    none = product_lines.LineReader(folder, 1 << 20, False)
    assert sum(len(b) for p in none.partitions() for b in none.read(p)) == 45
    assert sum(n for _, n in opened) < 1500


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    top, out, marks = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/marks"
    (tmp_path / "in").mkdir()

    def run():
        query = product_lines.keep(product_lines.follow(spark, top, "s", task_bytes=100), out, marks)
        assert query.awaitTermination(120)
        return sorted(r.line for r in spark.read.parquet(out).collect())

    write(spark, f"{top}/s_1.rpf", 1)
    write(spark, f"{top}/s_2.rpf", 21)
    write(spark, f"{top}/s_10.rpf", 900)
    write(spark, f"{top}/t_1.rpf", 5000)
    assert run() == list(range(1, 41))
    assert run() == list(range(1, 41))
    # the gap closes: s_10 follows s_9
    for n in range(3, 10):
        write(spark, f"{top}/s_{n}.rpf", 1 + 20 * (n - 1))
    assert run() == [*range(1, 181), *range(900, 920)]
    assert spark.read.parquet(out).groupBy("line").count().where(F.col("count") > 1).count() == 0
    stream = product_lines.LineStream(top, "s", 100, True)
    middle = stream.partitions({"number": 2, "chunk": 0, "line": 15}, {"number": 4, "chunk": 0, "line": 3})
    got = [x for p in middle for b in stream.read(p) for x in b.column("line").to_pylist()]
    assert got == list(range(36, 64))
    assert np.array_equal(sorted(got), got)
