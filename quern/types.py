"""Semirings, index sets and keyed factors: the data model that queries are written in."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import QuernError


@dataclass(frozen=True)
class Semiring:
    """plus folds terms, zero is what an empty fold gives, times combines factors, one is its identity."""

    name: str
    plus: Callable[[Column], Column]
    zero: object
    times: Callable[[Column, Column], Column]
    one: object

    def both(self, a: Column, b: Column) -> Column:
        """plus of two terms."""
        if isinstance(self.zero, bool):
            return a | b
        return {0.0: lambda: a + b, 1.0: lambda: a * b, -math.inf: lambda: F.greatest(a, b), math.inf: lambda: F.least(a, b)}[self.zero]()


_add, _mul = (lambda a, b: a + b), (lambda a, b: a * b)
#: The closed set; documents name one, identities and products never come from them.
SEMIRINGS = {
    s.name: s
    for s in (
        Semiring("sum_product", F.sum, 0.0, _mul, 1.0),
        Semiring("max_product", F.max, -math.inf, _mul, 1.0),
        Semiring("min_sum", F.min, math.inf, _add, 0.0),
        Semiring("max_sum", F.max, -math.inf, _add, 0.0),
        Semiring("bool_and_or", F.bool_or, False, lambda a, b: a & b, True),
    )
}
#: Folds of the older `reduce` spelling; the product is always multiplication.
REDUCERS = {
    "+": SEMIRINGS["sum_product"],
    "*": Semiring("*", F.product, 1.0, _mul, 1.0),
    "max": SEMIRINGS["max_product"],
    "min": Semiring("min", F.min, math.inf, _mul, 1.0),
}


def semiring(name: str | None = None, reduce: str | None = None) -> Semiring:
    """`name` wins over `reduce`; neither means sum_product."""
    if name is not None:
        if name not in SEMIRINGS:
            raise QuernError("unknown_semiring", f"{name} is not one of {sorted(SEMIRINGS)}")
        return SEMIRINGS[name]
    if reduce is not None:
        if reduce not in REDUCERS:
            raise QuernError("unknown_reduce", f"{reduce} is not one of {sorted(REDUCERS)}")
        return REDUCERS[reduce]
    return SEMIRINGS["sum_product"]


def check_keys(df: DataFrame, *keys: str) -> None:
    """Keys are integers, strings or booleans; floats are refused when the plan is built."""
    for k in keys:
        kind = df.schema[k].dataType
        if isinstance(kind, T.FloatType | T.DoubleType):
            raise QuernError("float_key", f"{k} is {kind.simpleString()}; keys are integers, strings or booleans")


@dataclass(frozen=True)
class Factor:
    """A map from index tuples to values, in long form: one column an axis, and `value`."""

    df: DataFrame
    axes: tuple[str, ...]
    value: str = "value"

    def __post_init__(self):
        check_keys(self.df, *self.axes)

    def named(self, *axes: str, value: str | None = None) -> Factor:
        """The same factor under other index names."""
        cols = [F.col(a).alias(b) for a, b in zip(self.axes, axes, strict=True)]
        return Factor(self.df.select(*cols, F.col(self.value).alias(value or self.value)), tuple(axes), value or self.value)


@dataclass(frozen=True)
class IndexSet:
    """kind interval (size), categorical (members), ragged (child table parent, k, member) or derived (frame of dense ids)."""

    kind: str
    size: int | None = None
    members: tuple = ()
    frame: DataFrame | None = field(default=None, compare=False)

    def positions(self, spark: SparkSession, name: str) -> DataFrame:
        """Positions from 1, as a column of the given name; categorical sets also have `name_member`."""
        if self.kind == "interval":
            return spark.range(1, self.size + 1).withColumnRenamed("id", name)
        if self.kind == "categorical":
            kind = "string" if any(isinstance(m, str) for m in self.members) else "bigint"
            return spark.createDataFrame(list(enumerate(self.members, 1)), f"{name} bigint, {name}_member {kind}")
        if self.frame is None:
            raise QuernError("unbound_index_set", f"a {self.kind} set needs its table")
        return self.frame.withColumnsRenamed({"pos": name, "member": f"{name}_member"})


def interval(size: int) -> IndexSet:
    return IndexSet("interval", size)


def categorical(*members) -> IndexSet:
    return IndexSet("categorical", len(members), members)
