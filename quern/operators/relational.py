"""Distinct, Skolem keys, dense ranks, joins, grouped folds and witnesses.

Order is by value: integers as numbers, strings by code point, structs field by field. Keys of float type are
refused when the plan is built. Results are sets of rows; sort them at a sink where order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QuernError
from ..shared import saved
from ..types import Semiring, check_keys


def key_int(x: Column) -> Column:
    """A whole number as long; anything else fails the query."""
    d = x.cast("double")
    return F.when(x.isNull(), F.lit(None)).when(d == F.floor(d), x.cast("long")).otherwise(F.raise_error(F.lit("[key_not_integral]")).cast("long"))


def skolem(*components: Column, symmetric: bool = False) -> Column:
    """The tuple itself, never a hash; symmetric tuples are sorted. One component stays a scalar."""
    if not components:
        raise QuernError("arity", "skolem takes a component at least")
    if symmetric:
        return F.sort_array(F.array(*components))
    return components[0] if len(components) == 1 else F.struct(*[c.alias(f"c{i}") for i, c in enumerate(components, 1)])


def skolem_edge(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    check_keys(df, *columns)
    return df.select(*columns).distinct()


def rank(df: DataFrame, *columns: str, base: int = 0, name: str = "rank") -> DataFrame:
    """Distinct keys with dense ids in order, from `base`.

    No window over all rows: distinct keys are range-partitioned and sorted, ids are places inside a range plus
    the sizes of the ranges before it, of which the driver handles one number a range.
    """
    check_keys(df, *columns)
    keys = df.select(*columns).where(" and ".join(f"`{c}` is not null" for c in columns)).distinct()
    # Written once: ranges are drawn anew each time they are asked for, and ids must come from one drawing.
    ranges = saved(keys.repartitionByRange(*[F.col(c) for c in columns]).withColumn("__part", F.spark_partition_id()), "rank")
    sizes = ranges.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, start = {}, base
    for r in sizes:
        before[r["__part"]] = start
        start += r["n"]
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    ids = (F.element_at(offsets, F.col("__part")) + inside - 1).cast("long") if before else F.lit(None).cast("long")
    return ranges.withColumn(name, ids).drop("__part")


def without_nulls(df: DataFrame, *keys: str) -> DataFrame:
    """df, whose query fails where one of its keys is null: what declared keys must not be."""
    for k in keys:
        df = df.withColumn(k, F.coalesce(F.col(k), F.raise_error(F.lit(f"[null_key] {k}")).cast(df.schema[k].dataType)))
    return df


def categories(df: DataFrame, *keys: str) -> DataFrame:
    """Boolean keys as the numbers 0 and 1, which other keys of numbers match."""
    return df.withColumns({k: F.col(k).cast("int") for k in keys if isinstance(df.schema[k].dataType, T.BooleanType)})


def equijoin(left: DataFrame, right: DataFrame, on_left: list[str], on_right: list[str], strict: bool = False, order: tuple[str, str] | None = None) -> DataFrame:
    """All m * n pairs of rows with equal keys; null keys match nothing, or with `strict` fail the query. Same-named columns of `right` get the suffix _r.

    `order` (a column of each side) asks for the rows in order of key, left and right: a sort by ranges, where it can be seen.
    """
    if len(on_left) != len(on_right) or not on_left:
        raise QuernError("join_keys", "as many keys on the left as on the right")
    check_keys(left, *on_left)
    check_keys(right, *on_right)
    if strict:
        left, right = without_nulls(left, *on_left), without_nulls(right, *on_right)
    left, right = categories(left, *on_left), categories(right, *on_right)
    clash = {c: f"{c}_r" for c in right.columns if c in left.columns}
    r = right.withColumnsRenamed(clash)
    cond = [F.col(a) == F.col(clash.get(b, b)) for a, b in zip(on_left, on_right, strict=True)]
    out = left.join(r, cond)
    return out if order is None else out.orderBy(*on_left, order[0], clash.get(order[1], order[1]))


def exists(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of left with a partner: the boolean semiring over a join."""
    check_keys(left, *on)
    return left.join(right.select(*on), on, "left_semi")


def group_aggregate(df: DataFrame, keys: list[str], value: str, ring: Semiring, name: str = "value", exact: bool = False) -> DataFrame:
    """A fold of values by key. `exact` adds in order of value, so floats don't depend on partitions; a group's values then meet in one row."""
    check_keys(df, *keys)
    if exact and ring.zero == 0.0:
        fold = F.aggregate(F.array_sort(F.collect_list(F.col(value).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    else:
        fold = ring.plus(F.col(value))
    return df.groupBy(*keys).agg(fold.alias(name))


def arg_best(df: DataFrame, by: list[str], value: str, witness: str, largest: bool = False, name: str | None = None) -> DataFrame:
    """Of each group the witness of the least (largest) value; ties go to the smallest witness. Null and NaN values take no part."""
    v = F.col(value)
    if isinstance(df.schema[value].dataType, T.FloatType | T.DoubleType):
        df = df.where(~F.isnan(v))
    best = F.min(F.struct((-v if largest else v).alias("v"), F.col(witness).alias("w")))
    return df.where(v.isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.w").alias(name or witness), (-F.col("b.v") if largest else F.col("b.v")).alias(value))


def grouped(df: DataFrame, by: str, ring: Semiring, body: Column, dense: DataFrame, name: str = "value") -> DataFrame:
    """A fold over a minted key, dense over the frame `dense` (one column: the key): empty groups give the semiring's zero."""
    folded = df.groupBy(by).agg(ring.plus(body).alias(name))
    return dense.join(folded, by, "left").withColumn(name, F.coalesce(F.col(name), F.lit(ring.zero)))


def index_set(df: DataFrame, key: Column, where: Column | None = None, base: int = 1) -> DataFrame:
    """The distinct members of `key` over the admitted rows, as (member, pos): a derived index set."""
    rows = df if where is None else df.where(where)
    return rank(rows.select(key.alias("member")), "member", base=base, name="pos")
