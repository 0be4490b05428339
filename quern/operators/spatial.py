"""Overlap joins of boxes by grid bins, and joins on binned keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QuernError
from ..shared import saved
from .aggregate import axis_range

BOX = ("xmin", "ymin", "xmax", "ymax")


def envelope(ring: Column) -> dict[str, Column]:
    """The box of a ring: an array of structs (lon, lat)."""
    lon, lat = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return {"xmin": F.array_min(lon), "ymin": F.array_min(lat), "xmax": F.array_max(lon), "ymax": F.array_max(lat)}


def bin_key(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


#: Widths of cells grow by STEP from level to level; boxes of next to no extent are at LOWEST.
STEP, LOWEST = 4.0, -8
#: Rows of one cell that one task joins; a cell with more is split.
CELL_ROWS = 100_000
#: Cells where the sides' rows are more than BLOCK_ROWS x BLOCK_ROWS pairs are split into blocks of so many rows; a task gets TASK_BLOCKS pairs of blocks or so.
BLOCK_ROWS, TASK_BLOCKS = 1000, 128
#: Cells are counted by so many hashes first, and one by one only where a hash has many rows.
HASHES = 1 << 18


def bin_width(a: DataFrame, b: DataFrame, eps: float = 0.0) -> tuple[float, float]:
    """Twice the mean extent of both sides' boxes in x and in y."""
    mean = lambda lo, hi: F.avg(F.col(hi) - F.col(lo))
    r = a.select(*BOX).unionByName(b.select(*BOX)).agg(mean("xmin", "xmax"), mean("ymin", "ymax")).first()
    return tuple(max(2.0 * ((x or 0.0) + 2 * eps), 1e-9) for x in r)


def box_level(wx: float, wy: float, eps: float) -> Column:
    """The level whose cells are as wide and high as a box at least: it lies in four of them at most."""
    extent = F.greatest((F.col("xmax") - F.col("xmin") + 2 * eps) / wx, (F.col("ymax") - F.col("ymin") + 2 * eps) / wy)
    level = F.ceil(F.log(extent) / F.log(F.lit(STEP)) + 1e-9).cast("int")
    return F.when(extent > STEP**LOWEST, F.greatest(level, F.lit(LOWEST))).otherwise(F.lit(LOWEST))


def _cells(df: DataFrame, levels: Column, wx: float, wy: float, eps: float) -> DataFrame:
    """A row for each of `levels` and cell (bx, by) of it that a box meets; x0 and y0 say if the cell is the first on its axis."""
    df = df.withColumn("bl", F.explode(levels))
    key = lambda c, w, more: F.floor((F.col(c) + more) / (F.lit(w) * F.pow(F.lit(STEP), F.col("bl")))).cast("long")
    for x, w in (("x", wx), ("y", wy)):
        df = df.withColumn(f"{x}0", key(f"{x}min", w, -eps)).withColumn(f"b{x}", F.explode(F.sequence(F.col(f"{x}0"), key(f"{x}max", w, eps))))
    return df.withColumn("x0", F.col("x0") == F.col("bx")).withColumn("y0", F.col("y0") == F.col("by"))


def _split(left: DataFrame, right: DataFrame, key: list[str], most: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a part of the cell, where cells have many pairs: each side's rows are dealt to blocks, and every two blocks meet in one part.

    Without such cells nothing changes. With them the sides are dealt to as many tasks as the pairs of blocks ask for: a
    pair costs the same however few bytes its rows have.
    """
    block = min(most, BLOCK_ROWS)
    many = f"n * m > {block * block} or n > {most} or m > {most}"
    place = F.pmod(F.xxhash64(*key), F.lit(HASHES)).cast("int").alias("__hash")
    counted = lambda by: left.groupBy(*by).agg(F.count("*").alias("n")).join(right.groupBy(*by).agg(F.count("*").alias("m")), [x if isinstance(x, str) else "__hash" for x in by]).where(many)
    full = saved(counted([place]).select("__hash"), "cells")
    if full.isEmpty():
        return left, right, key
    some = lambda df: df.withColumn("__hash", place).join(F.broadcast(full), "__hash", "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    hot = some(left).join(some(right).withColumnRenamed("n", "m"), key).where(many)
    hot = saved(hot.select(*key, *[F.ceil(F.col(n) / block).cast("int").alias(f"__{n}") for n in "nm"]), "cells")
    blocks = hot.agg(F.sum(F.col("__n").cast("long") * F.col("__m"))).first()[0]
    if not blocks:
        return left, right, key
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-blocks // TASK_BLOCKS))
    n, m = (F.coalesce(f"__{x}", F.lit(1)) for x in "nm")
    own = lambda df, parts: F.pmod(F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()]), parts).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    key_parts = [*key, "part"]
    sides = []
    for df, mine, other, part in ((left, n, m, lambda i, j: i * m + j), (right, m, n, lambda i, j: j * m + i)):
        dealt = df.join(hot, key, "left").withColumn("__own", own(df, mine)).withColumn("__other", each(other))
        sides.append(dealt.withColumn("part", part(F.col("__own"), F.col("__other"))).drop("__n", "__m", "__own", "__other").repartition(tasks, *key_parts))
    return *sides, key_parts


def overlap_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str, eps: float = 0.0, width: tuple[float, float] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a_id, b_id) of boxes that meet, edges included, after both sides grow by eps; boxes with a null or NaN corner meet nothing.

    A hierarchy of grids: each box is at the level whose cells are about its size, and stands in four of them at
    most. Two boxes meet in the cells of the coarser one's level, so a side also stands in the cells of those coarser
    levels that the other side has. The plan is one equi-join, or two where both sides have coarser boxes than the other.
    A pair that shares several cells is kept in that of the larger of its two lower corners, so nothing is shuffled to
    remove repeats. `width` is the size of level 0; cells with more than cell_rows of a side, or with very many pairs, are split. Boxes outside
    all that the other side has at a level don't go there.
    """
    if a_id == b_id:
        raise QuernError("overlap_names", "the two sides' ids need different names")
    c = F.col
    real = lambda df: df.where(" and ".join(f"{x} is not null and not isnan({x})" for x in BOX))
    a, b = (real(df.select(c(i).alias(i), *[c(x).cast("double").alias(x) for x in BOX])) for df, i in ((a, a_id), (b, b_id)))
    wx, wy = width or bin_width(a, b, eps)
    left, right = (df.withColumn("level", box_level(wx, wy, eps)) for df in (a, b))
    # Levels are a few dozen at most, whatever the tables; of each the box around all that it holds.
    around = [*[F.min(x).alias(x) for x in BOX[:2]], *[F.max(x).alias(x) for x in BOX[2:]]]
    have = left.select(F.lit(0).alias("side"), "level", *BOX).unionByName(right.select(F.lit(1).alias("side"), "level", *BOX)).groupBy("side", "level").agg(*around).collect()
    of = [{r["level"]: r for r in sorted(have, key=lambda r: r["level"]) if r["side"] == side} for side in (0, 1)]
    near = lambda r: (c("xmin") - eps <= r["xmax"] + eps) & (r["xmin"] - eps <= c("xmax") + eps) & (c("ymin") - eps <= r["ymax"] + eps) & (r["ymin"] - eps <= c("ymax") + eps)

    def joined(fine: DataFrame, coarse: DataFrame, finer: dict, levels: dict, strict: bool) -> DataFrame:
        """Pairs at the levels of `coarse`, with the other side's boxes that are finer, or as fine unless strict."""
        below = lambda x, y: x < y if strict else x <= y
        up = F.array_compact(F.array(*[F.when(below(c("level"), F.lit(x)) & near(r), F.lit(x)) for x, r in levels.items()]))
        own = F.array_compact(F.array(F.when(reduce(lambda p, q: p | q, [below(F.lit(x), c("level")) & near(r) for x, r in finer.items()]), c("level"))))
        fine, coarse = _cells(fine, up, wx, wy, eps), _cells(coarse, own, wx, wy, eps)
        fine, coarse, key = _split(fine.drop("level"), coarse.drop("level"), ["bl", "bx", "by"], cell_rows)
        fine, coarse = (df.withColumnsRenamed({x: f"{side}_{x}" for x in (*BOX, "x0", "y0")}) for df, side in ((fine, "f"), (coarse, "c")))
        meet = (c("f_xmin") - eps <= c("c_xmax") + eps) & (c("c_xmin") - eps <= c("f_xmax") + eps) & (c("f_ymin") - eps <= c("c_ymax") + eps) & (c("c_ymin") - eps <= c("f_ymax") + eps)
        # A cell that both stand in has the larger of their lower corners if it is the first of one of them.
        once = (c("f_x0") | c("c_x0")) & (c("f_y0") | c("c_y0"))
        return fine.join(coarse, key).where(meet & once).select(a_id, b_id)

    if not of[0] or not of[1]:
        return left.select(a_id).limit(0).withColumn(b_id, F.lit(None).cast(right.schema[b_id].dataType))
    pairs = joined(left, right, of[0], of[1], False)
    if max(of[0]) > min(of[1]):
        pairs = pairs.unionByName(joined(right, left, of[1], of[0], True))
    return pairs


def interval_join(a: DataFrame, b: DataFrame, a_lo: str, a_hi: str, b_lo: str, b_hi: str, width: float, eps: float = 0.0) -> DataFrame:
    """Rows whose closed intervals meet, after both grow by eps, by bins of one axis; `width` is that of the finest bins.

    As with boxes, an interval stands in two bins at most of the level that fits its length, and meets longer ones at their level.
    """
    c = F.col
    length = lambda lo, hi: F.greatest((c(hi) - c(lo) + 2 * eps) / F.lit(float(width)), F.lit(1.0))
    level = lambda lo, hi: F.ceil(F.log(length(lo, hi)) / F.log(F.lit(STEP))).cast("int")
    real = lambda df, lo, hi: df.where(c(lo).isNotNull() & c(hi).isNotNull() & (c(lo) <= c(hi))).withColumn("__level", level(lo, hi))
    left, right = real(a, a_lo, a_hi), real(b, b_lo, b_hi)
    have = left.select(F.lit(0).alias("side"), "__level").unionByName(right.select(F.lit(1).alias("side"), "__level")).distinct().collect()
    of = [sorted(r["__level"] for r in have if r["side"] == side) for side in (0, 1)]
    meet = (c(a_lo) - eps <= c(b_hi) + eps) & (c(b_lo) - eps <= c(a_hi) + eps)

    def binned(df: DataFrame, lo: str, hi: str, levels: Column, first: str) -> DataFrame:
        df = df.withColumn("__bl", F.explode(levels)).drop("__level")
        wide = F.lit(float(width)) * F.pow(F.lit(STEP), c("__bl"))
        df = df.withColumn(first, F.floor((c(lo) - eps) / wide).cast("long")).withColumn("__bin", F.explode(F.sequence(c(first), F.floor((c(hi) + eps) / wide).cast("long"))))
        return df.withColumn(first, c(first) == c("__bin"))

    def joined(levels: list[int], finer: str, strict: bool) -> DataFrame:
        up = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > c("__level") if strict else x >= c("__level"))
        own = F.array("__level")
        sides = binned(left, a_lo, a_hi, up if finer == "a" else own, "__a0"), binned(right, b_lo, b_hi, up if finer == "b" else own, "__b0")
        one, other, key = _split(*sides, ["__bl", "__bin"], CELL_ROWS)
        return one.join(other, key).where(meet & (c("__a0") | c("__b0"))).drop(*key, "__a0", "__b0")

    out = joined(of[1] or [0], "a", False)
    return out.unionByName(joined(of[0], "b", True)) if of[0] and of[1] and of[0][-1] > of[1][0] else out


def nearest(points: DataFrame, targets: DataFrame, point: str, target: str, x: str, gx: str) -> DataFrame:
    """(point, target, distance) of the target nearest on one axis, ties to the smallest id.

    Points and targets are sorted together along the axis, range by range: the nearest target is the last one
    before a point or the first one after it, in its range or in the nearest range that has any. One shuffle
    by range, whatever the density; null and NaN places take no part.
    """
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    t = targets.where(real(gx)).groupBy(F.col(gx).cast("double").alias("__at")).agg(F.min(target).alias("__t"))
    p = points.where(real(x)).select(F.col(x).cast("double").alias("__at"), F.col(point).alias("__p"))
    here = axis_range(p, "__at")
    stop = F.struct("__at", F.col("__t").alias("id"))
    both = p.select("__at", "__p", F.lit(None).cast(t.schema["__t"].dataType).alias("__t")).unionByName(t.select("__at", F.lit(None).cast(p.schema["__p"].dataType).alias("__p"), "__t"))
    both = both.withColumn("__range", here).withColumn("__stop", F.when(F.col("__t").isNotNull(), stop))
    # At one place targets come first, so a point sees those of its own place as before it.
    # Turned round, what comes after is the last one before: frames that only grow cost one step a row.
    w, past = Window.partitionBy("__range"), (Window.unboundedPreceding, -1)
    before = w.orderBy("__at", F.col("__p").isNotNull()).rowsBetween(*past)
    after = w.orderBy(F.desc("__at"), F.col("__p").isNull()).rowsBetween(*past)
    near = both.select("__p", "__at", "__range", F.last("__stop", True).over(before).alias("__lo"), F.last("__stop", True).over(after).alias("__hi")).where("__p is not null")
    # One row a range: the windows without partitions hold the list of ranges.
    ends = both.groupBy("__range").agg(F.min("__stop").alias("__min"), F.max("__stop").alias("__max"))
    below, above = (Window.orderBy(o("__range")).rowsBetween(*past) for o in (F.asc, F.desc))
    ends = ends.select(F.col("__range").alias("__of"), F.last("__max", True).over(below).alias("__below"), F.last("__min", True).over(above).alias("__above"))
    near = near.join(F.broadcast(ends), F.col("__range") == F.col("__of"))
    lo, hi = F.coalesce("__lo", "__below"), F.coalesce("__hi", "__above")
    option = lambda s: F.when(s.isNotNull(), F.struct(F.abs(F.col("__at") - s["__at"]).alias("distance"), s["id"].alias("id")))
    best = F.least(option(lo), option(hi))
    return near.select(F.col("__p").alias(point), best.alias("b")).where("b is not null").select(point, F.col("b.id").alias(target), "b.distance")
