"""Wall time of stages: of actions (StageTimes), or of points within the plan of one action (StageWatch) or stream (StreamWatch)."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

STAGE_ROWS = "stage string, rows long, began_ms long, ended_ms long, duration_ms double"
#: What names a stream's stages among the metrics of its progress.
PREFIX = "stage:"


class StageTimes:
    """Durations in milliseconds by stage; a stage's time is that of the action run inside it."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, (time.perf_counter() - began) * 1000))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "stage string, duration_ms double")


def _clock() -> Column:
    """The executor's clock in milliseconds, read for each row inside the JVM."""
    return F.expr("CAST(reflect('java.lang.System', 'currentTimeMillis') AS BIGINT)")


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.min(_clock()).alias("began_ms"), F.max(_clock()).alias("ended_ms")]


def _stage_row(stage: str, m: dict[str, Any]) -> tuple[str, int, int | None, int | None, float | None]:
    began, ended = m.get("began_ms"), m.get("ended_ms")
    return stage, m.get("rows") or 0, began, ended, None if began is None else float(ended - began)


class StageWatch:
    """Rows and times of the stages of a query, from the one run that the query takes anyway.

    ``at`` marks the place of the plan where a stage's rows pass. They are counted as they pass, with the first and last time of it,
    in each task, and the tasks' figures are put together: no job is added, and the driver gets a row a stage. Stages of one Spark
    stage overlap in time, as each row passes all of them. Filters and columns are not pushed through the place. Rows worked
    out again after the loss of an executor may count again; where the plan holds a place twice, as both sides of a self-join do, one of
    the two is told; a part of the plan that the optimizer takes away has no rows. The executors' clocks are taken to agree."""

    def __init__(self) -> None:
        self._stages: list[tuple[str, Observation]] = []

    def at(self, stage: str, df: DataFrame) -> DataFrame:
        seen = Observation()
        self._stages.append((stage, seen))
        return df.observe(seen, *_measures())

    def frame(self, spark: SparkSession) -> DataFrame:
        """(stage, rows, began_ms, ended_ms, duration_ms) in the order of the marks; a stage without rows has no times. Waits for the
        run, so an action on the query must have begun."""
        return spark.createDataFrame([_stage_row(stage, seen.get) for stage, seen in self._stages], STAGE_ROWS)


class StreamWatch(StreamingQueryListener):
    """The same for streams: rows of each stage over all batches, told by each batch's progress.

    ``spark.streams.addListener(watch)`` begins it; ``at`` marks the places. Of a stage only its sums are kept, so a stream may run
    for ever; ``duration_ms`` sums up the batches' spans."""

    def __init__(self) -> None:
        self._sums: dict[str, list[Any]] = {}
        self._lock = threading.Lock()

    @staticmethod
    def at(stage: str, df: DataFrame) -> DataFrame:
        return df.observe(f"{PREFIX}{stage}", *_measures())

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        with self._lock:
            for name, m in event.progress.observedMetrics.items():
                if not name.startswith(PREFIX):
                    continue
                _, rows, began, ended, took = _stage_row(name, m.asDict())
                s = self._sums.setdefault(name[len(PREFIX) :], [0, None, None, None])
                s[0] += rows
                if took is not None:
                    s[1:] = [began, ended, took] if s[1] is None else [min(s[1], began), max(s[2], ended), s[3] + took]

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def frame(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            return spark.createDataFrame([(stage, *s) for stage, s in sorted(self._sums.items())], STAGE_ROWS)


def stage_means(times: DataFrame) -> DataFrame:
    """(stage, mean_ms); stages without a time are not there."""
    return times.groupBy("stage").agg(F.avg("duration_ms").alias("mean_ms"))
