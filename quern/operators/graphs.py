"""Strong components of a graph of any size, by trimming and by reaching forward and back from many roots at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import dropped, saved
from ..types import check_keys


def _without(e: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """Edges with both ends among (left_semi) or not among (left_anti) some nodes."""
    return e.join(nodes.select(F.col("node").alias("a")), "a", how).join(nodes.select(F.col("node").alias("b")), "b", how)


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges left when nodes that nothing enters or nothing leaves go, again and again: such nodes are components of their own."""
    n = e.count()
    while n:
        inner = e.select(F.col("a").alias("node")).distinct().join(e.select(F.col("b").alias("node")).distinct(), "node", "left_semi")
        kept = saved(_without(e, inner, "left_semi"), "scc-trimmed")
        dropped(e)
        was, n, e = n, kept.count(), kept
        if n == was:
            break
    return e


def _first_ancestors(e: DataFrame) -> DataFrame:
    """node, color: the smallest node from which each can be reached. Only colors that have just changed go on."""
    colors = saved(e.select(F.col("a").alias("node")).distinct().withColumn("color", F.col("node")).withColumn("fresh", F.lit(True)), "scc-colors")
    while True:
        come = e.join(colors.where("fresh").select(F.col("node").alias("a"), "color"), "a").groupBy(F.col("b").alias("node")).agg(F.min("color").alias("new"))
        lower = F.col("new") < F.col("color")
        after = saved(colors.join(come, "node", "left").select("node", F.when(lower, F.col("new")).otherwise(F.col("color")).alias("color"), F.coalesce(lower, F.lit(False)).alias("fresh")), "scc-colors")
        dropped(colors)
        colors = after
        if colors.where("fresh").isEmpty():
            return colors.select("node", "color")


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component of every end of an edge: the smallest node of those that reach it and that it reaches.

    In a round every node takes the smallest node that reaches it as its color; a node of its own color is a root, and what
    reaches a root inside its color is the root's component. All roots go back at once; edges between colors and around
    components then go. Rounds are joins and folds with a partial step, written to the shared folder; the driver gets
    counts. Edges with a null end are left out; repeated edges and loops change nothing.
    """
    check_keys(edges, a, b)
    e = saved(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "scc-edges")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct()
    nodes = saved(nodes, "scc-nodes")
    left, found = saved(e.where("a <> b"), "scc-edges"), None
    dropped(e)
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            break
        colors = _first_ancestors(left)
        color = lambda end: colors.select(F.col("node").alias(end), F.col("color").alias(f"c{end}"))  # noqa: B023, E731
        own = saved(left.join(color("a"), "a").join(color("b"), "b").where("ca = cb").select("a", "b", F.col("ca").alias("color")), "scc-own")
        dropped(left)
        members = saved(colors.where("node = color"), "scc-members")
        front = members
        while True:
            # What leads to the front inside its color, and is not known yet.
            new = own.join(front.select(F.col("node").alias("b")), "b").select(F.col("a").alias("node"), "color").distinct().join(members, "node", "left_anti")
            new = saved(new, "scc-front")
            if new.isEmpty():
                break
            members, front = saved(members.unionByName(new), "scc-members"), new
        found = members if found is None else found.unionByName(members)
        left = saved(_without(own.select("a", "b"), members, "left_anti"), "scc-edges")
        dropped(own)
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found.select("node", "color"), "node", "left").select("node", F.coalesce("color", "node").alias("component"))
