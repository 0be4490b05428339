"""What is looked at: a domain's part of a table, where on a cell a value lies, and the data of lines, scatters and heat maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QuernError

#: Where a value lies on a grid's cell: fixed values.
LOCATIONS = ("cell_center", "edge_normal", "edge_tangential", "x_face", "y_face", "z_face", "vertex")


def domain(df: DataFrame, spec: Mapping, time: str | None = None, axes: Mapping[str, str] | None = None) -> DataFrame:
    """Rows inside a domain: temporal {start, end} on the column `time`, ends included, and spatial {axis: {min, max}} on the columns that `axes` names.

    Plain filters, which reach a Parquet scan; null places are outside.
    """
    temporal, spatial = spec.get("temporal") or {}, spec.get("spatial") or {}
    if time is not None:
        kind = df.schema[time].dataType.simpleString()
        for end, test in (("start", F.col(time).__ge__), ("end", F.col(time).__le__)):
            if temporal.get(end) is not None:
                text = temporal[end].replace("Z", "") if kind == "timestamp_ntz" else temporal[end]
                df = df.where(test(F.lit(text).cast(kind)))
    for axis, bound in spatial.items():
        column = (axes or {}).get(axis, axis)
        if column not in df.columns:
            raise QuernError("domain_axis", axis)
        if bound.get("min") is not None:
            df = df.where(F.col(column) >= F.lit(bound["min"]))
        if bound.get("max") is not None:
            df = df.where(F.col(column) <= F.lit(bound["max"]))
    return df


def located(df: DataFrame, column: str, location: str) -> DataFrame:
    """The column with where its values lie on a cell, in its field's metadata: no value changes."""
    if location not in LOCATIONS:
        raise QuernError("location", f"{location} is not one of {LOCATIONS}")
    return df.withMetadata(column, {**df.schema[column].metadata, "location": location})


def location_of(df: DataFrame, column: str) -> str:
    return df.schema[column].metadata.get("location", "cell_center")


def plot_data(df: DataFrame, spec: Mapping, value: str | None = None, bins: int = 0, bounds: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """The data of a plot {type, x: {variable}, y: {variable}, series: [{variable}]}: nothing is drawn.

    line: (series, x, y), y averaged where an x repeats; scatter: (x, y) as they are; heatmap: (x, y, value), means of `value` (or of
    spec's value) over the two variables, in `bins` equal bins of `bounds` each way if given, by their lower edges.
    """
    x, y = spec["x"]["variable"], (spec.get("y") or {}).get("variable")
    if spec["type"] == "scatter":
        return df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    if spec["type"] == "line":
        shown = [s["variable"] for s in spec.get("series") or []] or [y]
        long = df.select(F.col(x).alias("x"), F.explode(F.create_map(*[c for s in shown for c in (F.lit(s), F.col(s).cast("double"))])).alias("series", "y"))
        return long.groupBy("series", "x").agg(F.avg("y").alias("y"))
    if spec["type"] != "heatmap":
        raise QuernError("plot", spec["type"])
    value = value or spec["value"]["variable"]

    def edge(column: str):
        c = F.col(column)
        if not bins:
            return c
        lo, hi = (bounds or {})[column]
        k = F.least(F.floor((c - lo) / (hi - lo) * bins), F.lit(bins - 1))
        return F.when(c.between(lo, hi), F.lit(float(lo)) + k * ((hi - lo) / bins))

    cells = df.select(edge(x).alias("x"), edge(y).alias("y"), F.col(value).cast("double").alias("value")).where("x is not null and y is not null")
    return cells.groupBy("x", "y").agg(F.avg("value").alias("value"))
