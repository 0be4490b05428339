"""Connected components of a graph of any size by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, saved


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of every node in edges (a, b: long).

    Large stars hang a node's larger neighbours on its smallest one, small stars its smaller neighbours and
    itself; both shrink to one star a component in a number of rounds like the logarithm of its size. A round
    is aggregations with a partial step and joins that adaptive execution can split, so a node of any degree is
    many tasks. Each round is written to the shared folder; the driver holds two sums.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(e, name)
    before = None
    while True:
        # Large star: each u sends its smallest neighbour (or itself) to its larger neighbours.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = e.join(low, e.b == low.u).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each u sends the smallest of its smaller neighbours to the others and to itself.
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        low = large.join(least, large.a == least.u)
        small = low.select(F.col("b").alias("x"), "m").unionByName(low.select(F.col("a").alias("x"), "m")).where("x <> m")
        new = saved(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), name)
        sums = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(e)
        e = new
        if sums == before or not sums[0]:
            break
        before = sums
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
