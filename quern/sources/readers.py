"""Sources: grids, points and static tables, record tables with codes and filters, axis selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QuernError
from . import grids

#: Formats by name; register() adds more. Each reader takes (spark, path, options).
FORMATS: dict[str, Callable[[SparkSession, str, dict], DataFrame]] = {
    f: (lambda spark, path, options, f=f: spark.read.format(f).options(**options).load(path)) for f in ("parquet", "orc", "json", "text", "binaryFile")
}
FORMATS["zarr"] = lambda spark, path, options: grids.read_zarr(spark, path, **options)
FORMATS["netcdf"] = lambda spark, path, options: grids.read_netcdf(spark, path, **options)
FORMATS["csv"] = lambda spark, path, options: spark.read.options(**{"header": "true", "inferSchema": "true"} | options).csv(path)


def register(name: str, reader: Callable[[SparkSession, str, dict], DataFrame]) -> None:
    FORMATS[name] = reader


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    if format not in FORMATS:
        raise QuernError("unknown_format", f"{format} is not one of {sorted(FORMATS)}")
    return FORMATS[format](spark, path, options)


def points(spark: SparkSession, path: str, format: str = "json", root: str | None = None) -> DataFrame:
    """Records as columns: of JSON the rows, or the array under `root`; nested objects become dotted names with underscores."""
    df = read(spark, path, format, **({"multiLine": "true"} if format == "json" else {}))
    if root:
        df = df.select(F.explode(root).alias("r")).select("r.*")
    return flattened(df)


def flattened(df: DataFrame) -> DataFrame:
    while any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        cols = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    return df


def coded(df: DataFrame, column: str, codes: dict[str, float], unmapped: str | float = "error", ignore_case: bool = False, name: str | None = None) -> DataFrame:
    """Text to numbers. Trimmed text without a code: its row is dropped, fails the query, or takes the given number."""
    key = F.trim(F.col(column))
    items = {k.strip().upper() if ignore_case else k.strip(): float(v) for k, v in codes.items()}
    table = F.create_map(*[F.lit(x) for kv in items.items() for x in kv])
    value = F.try_element_at(table, F.upper(key) if ignore_case else key)
    name = name or column
    if unmapped == "drop":
        return df.withColumn(name, value).where(F.col(name).isNotNull())
    if unmapped == "error":
        return df.withColumn(name, F.coalesce(value, F.raise_error(F.concat(F.lit("[unmapped_code] "), F.coalesce(key, F.lit("null")))).cast("double")))
    return df.withColumn(name, F.coalesce(value, F.lit(float(unmapped))))


def require_finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns all hold finite numbers: one mask for the whole record."""
    for c in columns:
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df


def select_axis(df: DataFrame, axis: str, how, gate: DataFrame | None = None) -> DataFrame:
    """"all"; {"fixed": i} (the axis goes); {"range": {start, stop, step}} from 0, without stop; {"gated_by": name} with the gate's members.

    The index column counts from 1. Fixed and ranged selections are plain filters, which reach a Parquet scan.
    """
    if how == "all":
        return df
    if "fixed" in how:
        return df.where(F.col(axis) == how["fixed"] + 1).drop(axis)
    if "range" in how:
        start, stop, step = how["range"].get("start", 0), how["range"].get("stop"), how["range"].get("step", 1)
        df = df.where(F.col(axis) >= start + 1)
        df = df if stop is None else df.where(F.col(axis) <= stop)
        return df if step == 1 else df.where((F.col(axis) - 1 - start) % step == 0)
    if "gated_by" in how and gate is not None:
        return df.join(gate.select(F.col(gate.columns[0]).alias(axis)).distinct(), axis, "left_semi")
    raise QuernError("select", f"{how}")


def supported(matrix: DataFrame, row: str, demand: DataFrame, where: Column | None = None) -> DataFrame:
    """The rows of a matrix source that an additive contraction can use: those whose key some demand row has.

    Only sound for sums, where an absent term adds nothing. A semi-join, which Spark turns into dynamic pruning
    or a Bloom filter on the scan where it pays.
    """
    keys = (demand if where is None else demand.where(where)).select(row).distinct()
    return matrix.join(keys, row, "left_semi")


def converted(df: DataFrame, column: str, conversion: float | Callable[[Column], Column]) -> DataFrame:
    """Unit conversion at load: a factor, or a function of the column."""
    c = F.col(column)
    return df.withColumn(column, conversion(c) if callable(conversion) else c * F.lit(float(conversion)))


def extent(df: DataFrame) -> int:
    """A source's own number of records, for metaparameters."""
    return df.count()
