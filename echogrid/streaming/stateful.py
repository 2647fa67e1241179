"""Frame buffers, registration and focus tracking on typed state, one element at a time.

A pushed frame touches one slot of a ring of map state, not the whole buffer; the
trackers keep one small value. All states take a time to live and an initial
state, so that a stream can begin where another run ended. They need the RocksDB
state store (`use_rocksdb`). Results equal those of the forms in `frames`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shifts(total: np.ndarray, cx: np.ndarray, cy: np.ndarray, state: tuple[Any, Any, int, int], alpha: float) -> tuple[np.ndarray, tuple[Any, Any, int, int]]:
    """(dx, dy, metric, cum_dx, cum_dy) of frames in order against a reference, and the state behind them.

    Without following (alpha outside 0 to 1) all frames are taken at once; a
    reference that follows is a recursion over the frames that count.
    """
    rx, ry, sx, sy = state
    seen = np.flatnonzero(total > 0)
    off = np.zeros((len(total), 2))
    if len(seen) and rx is None:
        rx, ry = float(cx[seen[0]]), float(cy[seen[0]])
        seen = seen[1:]
    if len(seen):
        at = np.stack([cx[seen], cy[seen]], 1)
        if 0 < alpha < 1:
            reference = np.array([rx, ry], float)
            for k, place in enumerate(at):
                off[seen[k]] = place - reference
                reference = alpha * reference + (1 - alpha) * place
            rx, ry = reference.tolist()
        else:
            off[seen] = at - [rx, ry]
    move = -np.copysign(np.floor(np.abs(off) + 0.5), off).astype(np.int64)
    summed = move.cumsum(axis=0) + [sx, sy]
    if len(total):
        sx, sy = summed[-1].tolist()
    return np.column_stack([move, np.hypot(off[:, 0], off[:, 1]), summed]), (rx, ry, sx, sy)


def focus(metric: np.ndarray, best: float, n: int, least_gain: float, most_frames: int) -> tuple[dict[str, np.ndarray], float, int]:
    """delta, is_best and converged of frames in order against the best so far, and that best and the count behind them."""
    before = np.maximum.accumulate(np.r_[best, metric])
    gain, count = metric - before[:-1], n + 1 + np.arange(len(metric))
    ended = (gain < least_gain) & (least_gain > 0) | (count >= most_frames) & (most_frames > 0)
    return {"delta": gain, "is_best": gain >= 0, "converged": ended}, float(before[-1]), n + len(metric)


class _Processor(StatefulProcessor):
    """What the processors share: their state's time to live, and a batch's rows in order."""

    order = "frame"

    def __init__(self, key: str, ttl_ms: int | None):
        self.key, self.ttl_ms = key, ttl_ms

    def rows(self, batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(list(batches)).sort_values(self.order, kind="stable").reset_index(drop=True)

    def close(self) -> None:
        """Nothing is open."""


class _Ring(_Processor):
    order = "ts_ns"

    def __init__(self, key: str, ttl_ms: int | None, capacity: int):
        super().__init__(key, ttl_ms)
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "ts_ns long, value double", self.ttl_ms)
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def _push(self, rows: pd.DataFrame) -> None:
        n = int(self.count.get()[0]) if self.count.exists() else 0
        # of a batch beyond the capacity only the end can stay
        first = max(0, len(rows) - self.capacity)
        for k, (ts, value) in enumerate(zip(rows["ts_ns"].tolist()[first:], rows["value"].tolist()[first:], strict=True), n + first):
            self.slots.updateValue((k % self.capacity,), (ts, value))
        self.count.update((n + len(rows),))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        self._push(initialState.sort_values("ts_ns", kind="stable"))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        self._push(self.rows(rows))
        held = sorted(tuple(v) for _, v in self.slots.iterator())
        yield pd.DataFrame({self.key: [key[0]] * len(held), "ts_ns": [t for t, _ in held], "value": [v for _, v in held]})


class _Shift(_Processor):
    def __init__(self, key: str, ttl_ms: int | None, alpha: float):
        super().__init__(key, ttl_ms)
        self.alpha = alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reference", "rx double, ry double, sx long, sy long", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        rx, ry, sx, sy = initialState[["rx", "ry", "sx", "sy"]].iloc[-1]
        self.state.update((float(rx), float(ry), int(sx), int(sy)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = self.rows(rows)
        state = tuple(self.state.get()) if self.state.exists() else (None, None, 0, 0)
        out, state = shifts(*(batch[c].to_numpy(float) for c in ("total", "cx", "cy")), state, self.alpha)
        self.state.update(state)
        made = pd.DataFrame({self.key: key[0], "frame": batch["frame"].astype("int64"), "dx": out[:, 0].astype("int32"), "dy": out[:, 1].astype("int32"), "metric": out[:, 2], "cum_dx": out[:, 3].astype("int64"), "cum_dy": out[:, 4].astype("int64")})
        yield made


class _Best(_Processor):
    def __init__(self, key: str, ttl_ms: int | None, least_gain: float, most_frames: int):
        super().__init__(key, ttl_ms)
        self.least_gain, self.most_frames = least_gain, most_frames

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "best double, n long", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:
        best, n = initialState[["best", "n"]].iloc[-1]
        self.state.update((float(best), int(n)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = self.rows(rows)
        best, n = self.state.get() if self.state.exists() else (0.0, 0)
        found, best, n = focus(batch["metric"].to_numpy(float), best, n, self.least_gain, self.most_frames)
        self.state.update((best, n))
        yield pd.DataFrame({self.key: key[0], "frame": batch["frame"].astype("int64"), "metric": batch["metric"].astype(float), **found})


def _run(frames: DataFrame, key: str, processor: _Processor, schema: str, mode: str, initial: DataFrame | None) -> DataFrame:
    kind = dict(frames.dtypes)[key]
    begun = None if initial is None else initial.groupBy(key)
    return frames.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {schema}", mode, "None" if processor.ttl_ms is None else "ProcessingTime", begun)


def latest_frames(frames: DataFrame, key: str, capacity: int, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """After each batch, what a ring of the last `capacity` frames (key, ts_ns, value) holds for every key that had news.

    Frames of a batch are pushed by time; the one that was pushed first goes
    first. `initial` has frames that the rings begin with.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    return _run(frames.select(key, "ts_ns", "value"), key, _Ring(key, ttl_ms, capacity), "ts_ns long, value double", "Update", initial)


def registered(frames: DataFrame, key: str, alpha: float = 0.0, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Shifts of frames (key, frame, total, cx, cy) against a running reference; `initial` has (key, rx, ry, sx, sy) of an earlier run."""
    return _run(frames, key, _Shift(key, ttl_ms, alpha), "frame long, dx int, dy int, metric double, cum_dx long, cum_dy long", "Append", initial)


def best_frames(frames: DataFrame, key: str, least_gain: float = 0.0, most_frames: int = 0, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Focus tracking of frames (key, frame, metric) against the best so far; `initial` has (key, best, n) of an earlier run."""
    return _run(frames, key, _Best(key, ttl_ms, least_gain, most_frames), "frame long, metric double, delta double, is_best boolean, converged boolean", "Append", initial)
