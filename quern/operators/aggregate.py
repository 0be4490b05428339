"""The aggregate node: a functional aggregate query over a semiring, as one DataFrame plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QuernError
from ..types import Factor, Semiring, check_keys
from . import elimination


def aggregate(factors: list[Factor], out: list[str], ring: Semiring, body: Column | None = None, where: Column | None = None, dense: DataFrame | None = None, name: str = "value", early: bool = True) -> DataFrame:
    """out[free] = plus over the other indices of times over the factors.

    `body` replaces the product of the factors' values (named apart); `where` drops inadmissible combinations
    before the fold; `dense`, a frame of the free indices, adds those without a term, which get the zero. Without
    either, indices are eliminated one by one (operators/elimination.py), unless `early` is false or the ring's product
    does not distribute over its fold.
    """
    if not factors:
        raise QuernError("no_factors", "an aggregate reads a factor at least")
    names = [f.value for f in factors]
    if body is None and where is None and early and elimination.distributes(ring):
        folded = elimination.contract(factors, out, ring, name)
    elif body is None:
        factors = [Factor(f.df.withColumnRenamed(f.value, f"__v{i}"), f.axes, f"__v{i}") for i, f in enumerate(factors)]
        body = reduce(ring.times, [F.col(f.value) for f in factors])
    elif len(set(names)) < len(names):
        raise QuernError("value_names", "a body needs factors with values of different names")
    if body is not None:
        joined = elimination.natural_join(factors)
        if where is not None:
            joined = joined.where(where)
        folded = joined.groupBy(*out).agg(ring.plus(body).alias(name)) if out else joined.agg(ring.plus(body).alias(name))
    if dense is not None and out:
        check_keys(dense, *out)
        folded = dense.select(*out).join(folded, out, "left")
    return folded.withColumn(name, F.coalesce(F.col(name), F.lit(ring.zero)))


def prefix(df: DataFrame, by: list[str], order: str, value: Column, ring: Semiring, strict: bool = False, reverse: bool = False, name: str = "value") -> DataFrame:
    """Running folds: j <= i, j < i (strict), j >= i (reverse), j > i. An inequality self-join would grow with the square; a window does not.

    Without `by`, the one axis is cut into ranges: each is scanned by itself, and starts from the fold of the
    ranges before it, so no task holds the whole axis.
    """
    if not by:
        return _ranged(df, order, value, ring, strict, reverse, name)
    return df.withColumn(name, F.coalesce(ring.plus(value).over(running(by, order, strict, reverse)), F.lit(ring.zero)))


def running(by: list[str], order: str, strict: bool, reverse: bool):
    """The rows up to each one. From the end the axis is turned round: a frame that only grows costs one step a row, one that shrinks is folded anew for each."""
    w = Window.partitionBy(*by).orderBy(F.desc(order) if reverse else F.asc(order))
    return w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)


#: Cuts that a tree of comparisons holds; more are looked up in an array by halving.
TREE = 64


def place_among(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are below x; 0 for null."""
    if len(cuts) <= TREE:

        def tree(xs):
            if not xs:
                return F.lit(0)
            mid = len(xs) // 2
            return F.when(x > F.lit(xs[mid]), F.lit(mid + 1) + tree(xs[mid + 1 :])).otherwise(tree(xs[:mid]))

        return tree(cuts)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    array = F.array(*[F.lit(v) for v in cuts])
    return F.aggregate(F.array(*[F.lit(p) for p in steps]), F.lit(0), lambda at, p: F.when(x > F.get(array, at + p - 1), at + p).otherwise(at))


def axis_range(df: DataFrame, order: str) -> Column:
    """The number of the range of an axis that a row is in, by quantiles: as many ranges as shuffle partitions. Equal places are in one range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.select(F.percentile_approx(order, F.array(*[F.lit((k + 1) / n) for k in range(max(1, n - 1))]), F.lit(10_000))).first()[0]
    return place_among(F.col(order), sorted(set(cuts or ())))


def with_halo(df: DataFrame, order: str, before: int, after: int, *needed: str) -> DataFrame:
    """df cut into ranges of an axis, each with copies of the `before` rows before it and the `after` rows after it: columns __range and __own.

    Copies have the columns order and `needed`, the others are null, and __own is false. Of a range only its first and last rows
    move, found before any exchange by a limit in each task; where ranges are shorter than the halo it reaches
    over several. The driver gets one number a range.
    """
    cut = df.withColumn("__range", axis_range(df, order))
    sizes = {r["__range"]: r["n"] for r in cut.groupBy("__range").agg(F.count("*").alias("n")).collect()}
    ranges, moves = sorted(sizes), []
    for at, r in enumerate(ranges):
        for last, most, others in ((True, before, ranges[at + 1 :]), (False, after, ranges[:at][::-1])):
            for to in others:
                if most <= 0:
                    break
                moves.append((r, last, to, most))
                most -= sizes[to]
    whole = cut.withColumn("__own", F.lit(True))
    if not moves:
        return whole
    own = list(dict.fromkeys((order, *needed)))
    ends = []
    for last, most in ((True, before), (False, after)):
        w = Window.partitionBy("__range").orderBy(F.desc(order) if last else F.asc(order))
        ends.append(cut.select("__range", *own).withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") <= most).withColumn("__last", F.lit(last)))
    to = df.sparkSession.createDataFrame(moves, "__from int, __side boolean, __to int, __most int")
    moved = ends[0].unionByName(ends[1]).join(F.broadcast(to), (F.col("__range") == F.col("__from")) & (F.col("__last") == F.col("__side")) & (F.col("__nth") <= F.col("__most")))
    return whole.unionByName(moved.select(F.col("__to").alias("__range"), *own, F.lit(False).alias("__own")), allowMissingColumns=True)


def _ranged(df: DataFrame, order: str, value: Column, ring: Semiring, strict: bool, reverse: bool, name: str) -> DataFrame:
    df = df.withColumn("__value", value).withColumn("__range", axis_range(df, order))
    # One row a range, so this window without partitions holds the list of ranges, not rows.
    by_range = Window.orderBy(F.desc("__range") if reverse else F.asc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy("__range").agg(ring.plus(F.col("__value")).alias("__fold")).select(F.col("__range").alias("__of"), ring.plus(F.col("__fold")).over(by_range).alias("__start"))
    out = df.withColumn(name, ring.plus(F.col("__value")).over(running(["__range"], order, strict, reverse))).join(F.broadcast(starts), F.col("__range") == F.col("__of"))
    both = F.when(F.col("__start").isNull(), F.col(name)).when(F.col(name).isNull(), F.col("__start")).otherwise(ring.both(F.col("__start"), F.col(name)))
    return out.withColumn(name, F.coalesce(both, F.lit(ring.zero))).drop("__value", "__range", "__of", "__start")


def statistics(df: DataFrame, by: list[str], x: str, weight: str) -> DataFrame:
    """count, mean and weighted_mean by group."""
    return df.groupBy(*by).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), (F.sum(F.col(weight) * F.col(x)) / F.sum(weight)).alias("weighted_mean"))


def expand_range(df: DataFrame, lo, hi, name: str, step: int = 1) -> DataFrame:
    """One row for each of lo, lo + step, ... hi (numbers or Columns of the row); an empty range gives none."""
    if step == 0:
        raise QuernError("range_step", "a step is not zero")
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    some = hi >= lo if step > 0 else hi <= lo
    return df.withColumn(name, F.explode(F.when(some, F.sequence(lo.cast("long"), hi.cast("long"), F.lit(step).cast("long")))))


def ragged(parents: DataFrame, parent: str, lengths: Factor, values: Factor, k: str, member: str) -> DataFrame:
    """Members 1..length of each parent, gathered from a factor over (parent, place)."""
    n = lengths.named(parent, value="__n").df
    places = expand_range(parents.join(n, parent), F.lit(1), F.col("__n"), k).drop("__n")
    return places.join(values.named(parent, k, value=member).df, [parent, k])
