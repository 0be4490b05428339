"""Sets that grow and snapshots at given times: index sets in versions whose dependants are rebuilt, and output at ticks, each written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import QuernError
from ..operators.aggregate import place_among
from ..operators.relational import rank
from ..types import check_keys


class VersionedSet:
    """A derived index set (member, pos) in numbered versions. A new version keeps every member's place and gives new members the next ones, in order; older versions stay."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.dependants: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def _exists(self, at: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def at(self, version: int) -> DataFrame:
        if not self._exists(f"{self.path}/version={version}/_SUCCESS"):
            raise QuernError("unknown_version", f"{version} of {self.path}")
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def depends(self, name: str, build: Callable[[DataFrame], DataFrame]) -> None:
        """What is built from the set: build(members) is written with each version."""
        self.dependants[name] = build

    def dependant(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/version={version}")

    def remesh(self, version: int, members: DataFrame) -> bool:
        """Version `version` from the one before it and the column `member` of some rows; false if nothing is new. A version that is there already stays."""
        check_keys(members, "member")
        own = members.select("member").where("member is not null").distinct()
        if self._exists(f"{self.path}/version={version}/_SUCCESS"):
            return False
        before = self.at(version - 1) if version else None
        fresh = own if before is None else own.join(before, "member", "left_anti")
        count = 0 if before is None else before.count()
        new = rank(fresh, "member", base=count + 1, name="pos").select("member", "pos")
        grown = new if before is None else before.unionByName(new)
        changed = not fresh.isEmpty()
        grown.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        for name, build in self.dependants.items():
            # What depends on a set that hasn't changed is what it was; it is built anew only where it has.
            df = build(self.at(version)) if changed or version == 0 else self.dependant(name, version - 1)
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/version={version}")
        return changed


def snapshots(df: DataFrame, by: list[str], order: str, ticks: list[float], *columns: str) -> DataFrame:
    """by, tick, columns: of each trajectory and tick the last row not after it; no row where it has not begun.

    Rows fold into the tick that they come before, in every task; what goes through a window is one row a trajectory and tick.
    """
    ticks = sorted(set(ticks))
    if not ticks:
        raise QuernError("ticks", "no tick")
    at = place_among(F.col(order), ticks)
    last = df.where(F.col(order).isNotNull() & (F.col(order) <= ticks[-1])).groupBy(*by, at.alias("__k")).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("__last"))
    # A row stands at its own tick and at those up to the trajectory's next row.
    next_k = F.coalesce(F.lead("__k").over(Window.partitionBy(*by).orderBy("__k")), F.lit(len(ticks)))
    filled = last.withColumn("__next", next_k).select(*by, F.explode(F.sequence(F.col("__k"), F.col("__next") - 1)).alias("__k"), "__last")
    tick = F.element_at(F.array(*[F.lit(t) for t in ticks]), F.col("__k") + 1)
    return filled.select(*by, tick.alias("tick"), "__last.*")


def output_at(sink, ticks: list[float], state: Callable[[float], DataFrame], upto: float | None = None) -> list[float]:
    """Write a snapshot for every tick that has come (not after `upto`) and that the sink has not got; gives those written.

    A sink's write(t, df) replaces what stood at t, so a run that stops between two ticks goes on with the next.
    """
    done = set(sink.written()) if hasattr(sink, "written") else set()
    out = []
    for t in sorted(ticks):
        if (upto is None or t <= upto) and t not in done:
            sink.write(t, state(t))
            out.append(t)
    sink.flush()
    return out
