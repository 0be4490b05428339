"""Providers that are refreshed at times, and sinks that append snapshots partitioned by time."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuernError


class Provider(Protocol):
    def materialize(self) -> DataFrame: ...
    def refresh(self, t: float) -> DataFrame: ...
    def refresh_times(self) -> list[float]: ...


class TableProvider:
    """A table with a time column: at t it gives the rows of its last record time not after t. Without a time column it is constant."""

    def __init__(self, df: DataFrame, time: str | None = None):
        self.df, self.time = df, time

    def refresh_times(self) -> list[float]:
        return [] if self.time is None else sorted(r[0] for r in self.df.select(self.time).distinct().collect())

    def materialize(self) -> DataFrame:
        return self.df if self.time is None else self.refresh(self.refresh_times()[0])

    def refresh(self, t: float) -> DataFrame:
        if self.time is None:
            return self.df
        last = self.df.where(F.col(self.time) <= t).agg(F.max(self.time).alias("last"))
        return self.df.join(F.broadcast(last), F.col(self.time) == F.col("last")).drop("last")


class Providers:
    """Named sources of a document; a factory makes each one when first asked for."""

    def __init__(self, factory: Callable[[str], Provider]):
        self.factory, self.made = factory, {}

    def __getitem__(self, name: str) -> Provider:
        if name not in self.made:
            self.made[name] = self.factory(name)
        return self.made[name]


class ParquetSink:
    """Snapshots in long form, one folder for each output time. A time written again replaces itself, so a retried run leaves one copy."""

    def __init__(self, path: str, output_times: list[float]):
        self.path, self.output_times, self.opened = path, list(output_times), False

    def open(self, spark: SparkSession) -> ParquetSink:
        self.spark, self.opened = spark, True
        return self

    def write(self, t: float, snapshot: DataFrame) -> None:
        if not self.opened:
            raise QuernError("sink_closed", self.path)
        snapshot.write.mode("overwrite").parquet(f"{self.path}/t={t!r}")

    def written(self) -> list[float]:
        """Times whose snapshots are whole."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/t=*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(float(f.getPath().getParent().getName()[2:]) for f in found or [])

    def flush(self) -> None:
        """Every write is whole when it returns."""

    def close(self) -> None:
        self.opened = False


def restart_state(spark: SparkSession, path: str) -> DataFrame:
    """The last time's snapshot of a sink."""
    df = spark.read.parquet(path)
    last = df.agg(F.max("t")).first()[0]
    if last is None:
        raise QuernError("no_checkpoint", path)
    return df.where(F.col("t") == last)


def with_coordinates(df: DataFrame, axis: str, coordinates: DataFrame, name: str) -> DataFrame:
    """Coordinate values of an axis (axis, value) joined for output."""
    return df.join(coordinates.select(axis, F.col("value").alias(name)), axis, "left")


def output_plan(shapes: dict[str, tuple[str, ...]]) -> dict[tuple[str, ...], list[str]]:
    """Variables by the grid they share: one table a grid."""
    out: dict[tuple[str, ...], list[str]] = {}
    for name in sorted(shapes):
        out.setdefault(tuple(shapes[name]), []).append(name)
    return out
