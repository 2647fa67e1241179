"""Typed state against the array forms, across restarts, with initial states."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.streaming import stateful

SCHEMA = "k string, frame long, ts_ns long, value double, total double, cx double, cy double, metric double"


@pytest.fixture(scope="module")
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    stateful.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, old)


def frames(n, first=0):
    r = np.random.default_rng(9)
    rows = [(k, i, 1000 + i, float(r.integers(0, 50)), float(r.random() > 0.1), float(r.normal() * 3), float(r.normal() * 3), float(r.integers(0, 9))) for i in range(40) for k in "ab"]
    return rows[2 * first : 2 * n]


def loop(rows, alpha):
    """dx, dy, cum_dx, cum_dy of each frame, one after the other."""
    out = {}
    for key in "ab":
        rx, sx, sy, ry = None, 0, 0, None
        for k, frame, _, _, total, cx, cy, _ in rows:
            if k != key:
                continue
            dx = dy = 0
            if total > 0 and rx is None:
                rx, ry = cx, cy
            elif total > 0:
                dx, dy = (-int(math.copysign(math.floor(abs(e) + 0.5), e)) for e in (cx - rx, cy - ry))
                if 0 < alpha < 1:
                    rx, ry = alpha * rx + (1 - alpha) * cx, alpha * ry + (1 - alpha) * cy
            sx, sy = sx + dx, sy + dy
            out[key, frame] = (dx, dy, sx, sy)
    return out


def runner(spark, folder, make, mode, name):
    """Runs a query over the files that are there, then ends; a call with new files goes on from its checkpoint."""
    out = f"{folder}/{name}-out"

    def run(rows, part):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/{name}-in")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/{name}-in")
        query = make(source).writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).option("checkpointLocation", f"{folder}/{name}-marks").trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        return spark.read.parquet(out).collect()

    return run


def test_trackers_go_on_after_a_restart(rocks, tmp_path):
    every = frames(30)
    for alpha in (0.0, 0.5):
        run = runner(rocks, tmp_path, lambda s, alpha=alpha: stateful.registered(s.select("k", "frame", "total", "cx", "cy"), "k", alpha), "append", f"shift{alpha > 0}")
        run(frames(12), 0)
        got = run(frames(30, 12), 1)
        assert {(r.k, r.frame): (r.dx, r.dy, r.cum_dx, r.cum_dy) for r in got} == loop(every, alpha)
        assert len(got) == 60
    run = runner(rocks, tmp_path, lambda s: stateful.best_frames(s.select("k", "frame", "metric"), "k", 0.5, 25), "append", "best")
    run(frames(12), 0)
    got = {(r.k, r.frame): (r.delta, r.is_best, r.converged) for r in run(frames(30, 12), 1)}
    for key in "ab":
        best = 0.0
        for n, (_, frame, *_, metric) in enumerate([r for r in every if r[0] == key], 1):
            gain = metric - best
            assert got[key, frame] == (gain, gain >= 0, gain < 0.5 or n >= 25)
            best = max(best, metric)


def test_rings_hold_the_last_frames(rocks, tmp_path):
    begin = rocks.createDataFrame([("a", 1, -1.0), ("a", 2, -2.0), ("c", 3, -3.0)], "k string, ts_ns long, value double")
    run = runner(rocks, tmp_path, lambda s: stateful.latest_frames(s.select("k", "ts_ns", "value"), "k", 5, initial=begin), "update", "ring")
    first = run(frames(3), 0)
    assert sorted(r.ts_ns for r in first if r.k == "a") == [1, 2, 1000, 1001, 1002]
    assert sorted(r.ts_ns for r in first if r.k == "b") == [1000, 1001, 1002]
    last = run(frames(20, 3), 1)
    newest = max(r.batch for r in last)
    value = {(r[0], r[2]): r[3] for r in frames(20)}
    for key in "ab":
        held = sorted((r.ts_ns, r.value) for r in last if r.k == key and r.batch == newest)
        assert held == [(t, value[key, t]) for t in range(1015, 1020)]


def test_initial_states(rocks, tmp_path):
    begin = rocks.createDataFrame([("a", 100.0, 7)], "k string, best double, n long")
    run = runner(rocks, tmp_path, lambda s: stateful.best_frames(s.select("k", "frame", "metric"), "k", 0.0, 9, initial=begin), "append", "begun")
    got = {(r.k, r.frame): (r.is_best, r.converged) for r in run(frames(3), 0)}
    assert [got["a", i] for i in range(3)] == [(False, False), (False, True), (False, True)]
    assert got["b", 0][0]
    source = rocks.readStream.schema(SCHEMA).json(f"{tmp_path}/begun-in")
    # with a time to live a query runs on, as its states end by the clock
    assert stateful.best_frames(source.select("k", "frame", "metric"), "k", ttl_ms=1000).isStreaming
    with pytest.raises(ValueError):
        stateful.latest_frames(begin, "k", 0)
