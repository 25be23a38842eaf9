"""Structured Streaming forms of the stateful stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from engram.operators.bank import Store, numbered, upsert


def ema_stream(rewards: DataFrame, alpha: float = 0.1, q0: float = 0.5) -> DataFrame:
    """rewards (key, ts, seq, reward), a stream -> (key, steps, utility) whenever a key's utility changes. Rewards of one batch are
    applied in the order of (ts, seq), later batches on arrival."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, n = state.get if state.exists else (q0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        for r in rows["reward"].tolist():
            q += alpha * (r - q)
        n += len(rows)
        state.update((q, n))
        yield pd.DataFrame({"key": [key[0]], "steps": [n], "utility": [q]})

    kind = dict(rewards.dtypes)["key"]
    return rewards.select("key", "ts", "seq", "reward").groupBy("key").applyInPandasWithState(
        step, f"key {kind}, steps long, utility double", "q double, n long", "update", GroupStateTimeout.NoTimeout
    )


def _told(key: Any, steps: int, utility: float, late: int, some: bool) -> pd.DataFrame:
    """A row, or none."""
    row = pd.DataFrame({"key": pd.Series([key], dtype=object), "steps": [steps], "utility": [utility], "late": [late]})
    return row if some else row.iloc[:0]


class _InOrder(StatefulProcessor):
    """Rewards of a key wait until the watermark has passed them, then are folded in the order of (ts, seq)."""

    def __init__(self, alpha: float, q0: float):
        self.alpha, self.q0 = alpha, q0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, reward double")
        self.folded = handle.getValueState("folded", "q double, n long, late long, upto long")

    def _state(self) -> tuple[float, int, int, int]:
        return tuple(self.folded.get()) if self.folded.exists() else (self.q0, 0, 0, -(1 << 62))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        q, n, late, upto = self._state()
        frame = pd.concat(list(rows)).dropna(subset=["ts", "reward"])
        us = frame["ts"].to_numpy("datetime64[us]").astype("int64")
        behind = us <= upto
        if behind.any():
            late += int(behind.sum())
            self.folded.update((q, n, late, upto))
        new = list(zip(us[~behind].tolist(), frame["seq"][~behind].tolist(), frame["reward"][~behind].tolist(), strict=True))
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(u for u, *_ in new) // 1000))
        yield _told(key[0], n, q, late, bool(behind.any()))

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        q, n, late, upto = self._state()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(tuple(r) for r in self.waiting.get())
        due, left = [r for r in every if r[0] <= now], [r for r in every if r[0] > now]
        for _, _, reward in due:
            q += self.alpha * (reward - q)
        n += len(due)
        self.folded.update((q, n, late, max(now, upto)))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(-(-left[0][0] // 1000))
        elif every:
            self.waiting.clear()
        yield _told(key[0], n, q, late, bool(due))


def ema_event_time(rewards: DataFrame, delay: str = "1 hour", alpha: float = 0.1, q0: float = 0.5) -> DataFrame:
    """rewards (key, ts, seq, reward), a stream -> (key, steps, utility, late) whenever rewards of a key are folded, or come too late.

    A reward waits in its key's state until the watermark, ``delay`` behind the latest ts, has passed it; then all that are due are folded in the order
    of (ts, seq). So the utilities are those of the batch fold, however rewards are dealt to batches, as long as none is later than
    ``delay``; such ones are not folded, but counted in late. What waits of a key is what came within about ``delay``. Rewards without
    ts or reward are no steps. Needs the RocksDB state store."""
    spark = rewards.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise ValueError("set spark.sql.streaming.stateStore.providerClass to the RocksDB provider")
    kind = dict(rewards.dtypes)["key"]
    return rewards.select("key", "ts", "seq", "reward").withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        _InOrder(alpha, q0), f"key {kind}, steps long, utility double, late long", "Update", "EventTime"
    )


def notes_sink(store: Store, name: str = "notes") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: upserts each batch of notes into the store as a new version, of which only the buckets of the batch's banks are
    written; the number of the batch is published with it under the stream's name, so a restart does not write it twice. A stream that
    begins anew with an empty checkpoint needs a new name."""

    def save(batch: DataFrame, number: int) -> None:
        last = store.mark(name)
        if last is None or number > last:
            store.change(batch, lambda old, new: upsert(old, numbered(old, new, [F.col("ts"), F.col("id")]).select(*old.columns)), (name, number))

    return save
