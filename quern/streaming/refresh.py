"""Refreshes by Structured Streaming, schedules, and events of trajectories."""

from __future__ import annotations

import os
import signal
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import QuernError
from ..shared import shared_folder  # noqa: F401


def on_refresh(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of new records is one refresh: `apply` rewrites what depends on it. Static sides are cached by the caller."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fold_stream(spark: SparkSession, source: str, schema, keys: list[str], sums: dict[str, Column], out: str, checkpoint: str) -> DataFrame:
    """Sums by key of all records that a folder has so far: state is a table of partial sums, one folder a batch, merged when read.

    A batch that runs again overwrites its own folder, so a restart counts nothing twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in sums.items()]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    on_refresh(spark.readStream.schema(schema).parquet(source), apply, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sums])


def schedule_times(start: float, end: float, times: list[float] | None = None, interval: float | None = None, offset: float = 0.0) -> list[float]:
    """Given times and multiples of an interval from start + offset, inside the run, once each."""
    out = {t for t in times or [] if start <= t <= end}
    if interval is not None:
        if interval <= 0:
            raise QuernError("schedule", "an interval is longer than nothing")
        k = 0
        while (t := start + offset + k * interval) <= end:
            out.add(t)
            k += 1
    return sorted(out)


def union_of_times(*providers) -> list[float]:
    return sorted({t for p in providers for t in p.refresh_times()})


def crossings(df: DataFrame, by: list[str], order: str, value: str, direction: str = "all") -> DataFrame:
    """Rows at which a trajectory's value has changed sign since the row before: up, down or all. A zero counts when it is reached."""
    if direction not in ("all", "up", "down"):
        raise QuernError("crossing", direction)
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    up, down = (before < 0) & (F.col(value) >= 0), (before > 0) & (F.col(value) <= 0)
    return df.withColumn("__hit", {"up": up, "down": down, "all": up | down}[direction]).where("__hit").drop("__hit")


def became_true(df: DataFrame, by: list[str], order: str, condition: Column) -> DataFrame:
    """Rows at which a condition holds and did not on the row before."""
    w = Window.partitionBy(*by).orderBy(order)
    now = df.withColumn("__now", F.coalesce(condition, F.lit(False)))
    return now.withColumn("__was", F.coalesce(F.lag("__now").over(w), F.lit(False))).where("__now and not __was").drop("__now", "__was")


def segments(start: float, end: float, refreshes: list[float]) -> list[tuple[float, float]]:
    """Pieces of a run between refreshes."""
    cuts = [start, *sorted(t for t in set(refreshes) if start < t < end), end]
    return list(zip(cuts, cuts[1:], strict=False))


def every(seconds: float, clock: Callable[[], float] = time.monotonic) -> Callable[[], bool]:
    """True once each `seconds`: when to write a checkpoint."""
    last = [clock()]

    def due() -> bool:
        if clock() - last[0] < seconds:
            return False
        last[0] = clock()
        return True

    return due


def before_walltime(end: float, margin: float, clock: Callable[[], float] = time.time) -> Callable[[], bool]:
    """True when a job's end is nearer than the margin."""
    return lambda: clock() >= end - margin


def preempted(number: int = signal.SIGTERM) -> Callable[[], bool]:
    """True once the process has been told to stop."""
    told: list[int] = []
    signal.signal(number, lambda n, _: told.append(n))
    return lambda: bool(told)


def flag_file(path: str) -> Callable[[], bool]:
    return lambda: os.path.exists(path)
