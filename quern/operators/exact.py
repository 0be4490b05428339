"""Sums of doubles that are exact until they are rounded once: the same for any partitioning, partial in every task, and undone by a negative term.

A finite double is a whole number of bits times a power of two. Powers are cut into strips of 32; inside a strip terms are
whole decimals, which Spark adds exactly in any order. A sum is at most 68 strips, however many terms it has.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import ship

#: Powers of two in a strip, and what brings the least power of a term to zero.
STRIP, SHIFT = 32, 1152
DIGITS = "decimal(38,0)"


def terms(x: Column) -> tuple[Column, Column]:
    """(strip, digits) of finite numbers: x = digits * 2 ** (STRIP * strip - SHIFT); null and zero have none, nor have other numbers."""
    x = x.cast("double")
    size = F.abs(x)
    some = (size > 0) & (size < float("inf"))
    # One power below the lowest bit: the logarithm may be off by one at powers of two.
    low = (F.floor(F.log2(size)) - 54).cast("int")
    half = (-low / 2).cast("int")
    bits = (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -low - half)).cast("decimal(20,0)")
    strip = F.floor((low + SHIFT) / STRIP).cast("int")
    power = F.element_at(F.array(*[F.lit(1 << k) for k in range(STRIP)]), (low + SHIFT - STRIP * strip + 1).cast("int")).cast("decimal(11,0)")
    return F.when(some, strip), F.when(some, (bits * power).cast(DIGITS))


def rounded(parts: Column) -> Column:
    """The double nearest to a list of structs (strip, digits): a sum's few strips."""
    ship(SparkSession.active())

    @F.arrow_udf("double")
    def nearest(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists.to_pylist():
            total = sum(int(p["digits"]) << STRIP * p["strip"] for p in row or () if p["digits"] is not None)
            try:
                out.append(total / (1 << SHIFT))
            except OverflowError:
                out.append(float("inf") if total > 0 else float("-inf"))
        return pa.array(out, pa.float64())

    return nearest(parts)


def exact_sum(df: DataFrame, keys: list[str], value: str, name: str = "value") -> DataFrame:
    """keys, name: the sum of each group rounded once; null terms are left out, a group of nulls only is 0.0; infinities and NaN go through as in any sum.

    Each task adds up its own strips, so a group of any size is a few dozen rows a task.
    """
    x = F.col(value).cast("double")
    strip, digits = terms(x)
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    own = df.select(*keys, strip.alias("strip"), digits.alias("digits"), F.when(odd, x).alias("odd"))
    strips = own.groupBy(*keys, "strip").agg(F.sum("digits").cast(DIGITS).alias("digits"), F.sum("odd").alias("odd"))
    few = F.collect_list(F.when(F.col("strip").isNotNull(), F.struct("strip", "digits")))
    sums = (strips.groupBy(*keys) if keys else strips.groupBy()).agg(few.alias("parts"), F.sum("odd").alias("odd"))
    return sums.select(*keys, F.coalesce("odd", rounded(F.col("parts"))).alias(name))
