"""Frame streams: bounded buffers, registration, focus tracking and latencies with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .stateful import focus, shifts


def latest_frames(frames: DataFrame, key: str, capacity: int) -> DataFrame:
    """After each batch, what a buffer of `capacity` frames (key, ts_ns, value) holds for every key that had news: the oldest go first."""
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def push(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for batch in batches:
            held = sorted(held + list(zip(batch["ts_ns"].tolist(), batch["value"].tolist(), strict=True)))[-capacity:]
        state.update(([t for t, _ in held], [v for _, v in held]))
        yield pd.DataFrame({key: [k[0]] * len(held), "ts_ns": [t for t, _ in held], "value": [v for _, v in held]})

    kind = dict(frames.dtypes)[key]
    return frames.select(key, "ts_ns", "value").groupBy(key).applyInPandasWithState(push, f"`{key}` {kind}, ts_ns long, value double", "ts array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout)


def registered(frames: DataFrame, key: str, alpha: float = 0.0) -> DataFrame:
    """Shifts of frames (key, frame, total, cx, cy) against a running reference; 0 < alpha < 1 lets the reference follow.

    Frames of one batch are taken in order; later batches must hold later frames.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        out, behind = shifts(*(rows[c].to_numpy(float) for c in ("total", "cx", "cy")), state.get if state.exists else (None, None, 0, 0), alpha)
        state.update(behind)
        names = ("dx", "dy", "metric", "cum_dx", "cum_dy")
        yield pd.DataFrame({key: k[0], "frame": rows["frame"].to_numpy(np.int64), **{n: out[:, i] if n == "metric" else out[:, i].astype(np.int64) for i, n in enumerate(names)}})

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, frame long, dx int, dy int, metric double, cum_dx long, cum_dy long", "rx double, ry double, sx long, sy long", "append", GroupStateTimeout.NoTimeout)


def best_frames(frames: DataFrame, key: str, least_gain: float = 0.0, most_frames: int = 0) -> DataFrame:
    """Focus tracking of frames (key, frame, metric): is_best and converged against the best metric so far, which begins at 0."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame", kind="stable")
        found, best, n = focus(rows["metric"].to_numpy(float), *(state.get if state.exists else (0.0, 0)), least_gain, most_frames)
        state.update((best, n))
        yield pd.DataFrame({key: k[0], "frame": rows["frame"].to_numpy(np.int64), "metric": rows["metric"].to_numpy(float), **found})

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, frame long, metric double, delta double, is_best boolean, converged boolean", "best double, n long", "append", GroupStateTimeout.NoTimeout)


def latencies(frames: DataFrame, key: str) -> DataFrame:
    """Running count, least, most and mean latency of each key; negative ones are ignored. Built-in aggregates keep the state."""
    return frames.where("latency >= 0").groupBy(key).agg(F.count("*").alias("n"), F.min("latency").alias("least"), F.max("latency").alias("most"), F.avg("latency").alias("mean"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """An extension: events in tumbling windows, with a watermark for late ones. A time without zone is taken as UTC."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def repeated(spark: SparkSession, frame: DataFrame, per_second: int = 10) -> DataFrame:
    """A stream that hands out one frame (a single row) over and over with a fresh version and time: version, ts_ns and the frame's columns."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    ticks = ticks.select(F.col("value").alias("_version"), (F.unix_micros("timestamp") * 1000).alias("_ts"))
    return ticks.join(F.broadcast(frame.limit(1))).select(F.col("_version").alias("version"), F.col("_ts").alias("ts_ns"), *frame.columns)


def changed(frames: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The frames (key, version, value) whose version is not the one that came before it for their key; frames of a batch are taken by ts_ns."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts_ns", kind="stable")
        last = rows[version].shift(1)
        if state.exists:
            last.iloc[0] = state.get[0]
        new = rows[last.isna() | (rows[version] != last)]
        state.update((int(rows[version].iloc[-1]),))
        yield pd.DataFrame({key: [k[0]] * len(new), version: new[version].astype("int64"), "ts_ns": new["ts_ns"].astype("int64"), "value": new["value"].astype(float)})

    kind = dict(frames.dtypes)[key]
    return frames.select(key, version, "ts_ns", "value").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{version}` long, ts_ns long, value double", "last long", "append", GroupStateTimeout.NoTimeout)
