"""Array operators on keyed factors: gathers, blocks, shapes, alignment, stencils and field reductions. Places count from 1."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QuernError
from ..shared import ship
from ..types import Factor
from .aggregate import with_halo


def bound(i: Column, n: int | Column, policy: str = "error") -> Column:
    """A subscript of a constant array of n places: periodic wraps, clamp stops at the ends, error fails the query."""
    n = n if isinstance(n, Column) else F.lit(n)
    if policy == "periodic":
        return F.pmod(i - 1, n) + 1
    if policy == "clamp":
        return F.least(F.greatest(i, F.lit(1)), n)
    if policy == "error":
        return F.when((i >= 1) & (i <= n), i).otherwise(F.raise_error(F.lit("[index_out_of_range]")).cast("long"))
    raise QuernError("index_policy", policy)


def gather(frame: DataFrame, array: Factor, subscripts: list[Column], name: str, ghost: float | None = None) -> DataFrame:
    """frame with `name` = array[subscripts]. With `ghost`, places outside a state array read that value; else their rows go."""
    if len(subscripts) != len(array.axes):
        raise QuernError("index_rank", f"{len(array.axes)} subscripts, not {len(subscripts)}")
    keys = [f"__{name}{k}" for k in range(len(subscripts))]
    side = array.named(*keys, value=name).df
    out = frame.withColumns(dict(zip(keys, [s.cast("long") for s in subscripts], strict=True))).join(side, keys, "inner" if ghost is None else "left").drop(*keys)
    return out if ghost is None else out.withColumn(name, F.coalesce(F.col(name), F.lit(ghost)))


def makearray(grid: DataFrame, axes: list[str], regions: list[tuple[list[tuple[int, int]], Column]], default: float = 0.0, name: str = "value") -> Factor:
    """Blocks over a grid; where regions overlap the later one holds."""
    value = F.lit(default)
    for spans, body in regions:
        inside = reduce(lambda a, b: a & b, [F.col(a).between(lo, hi) for a, (lo, hi) in zip(axes, spans, strict=True)])
        value = F.when(inside, body).otherwise(value)
    return Factor(grid.select(*axes, value.alias(name)), tuple(axes), name)


def _linear(axes: tuple[str, ...], shape: list[int]) -> Column:
    """Place of an element from 0, the first axis fastest."""
    at, step = F.lit(0), 1
    for a, n in zip(axes, shape, strict=True):
        at, step = at + (F.col(a) - 1) * step, step * n
    return at


def reshape(array: Factor, shape: list[int], to: list[int]) -> Factor:
    """The same elements in column-major order under axes d1, d2, ..."""
    if reduce(lambda a, b: a * b, shape) != reduce(lambda a, b: a * b, to):
        raise QuernError("reshape", f"{shape} has not as many elements as {to}")
    at, cols, step = _linear(array.axes, shape), [], 1
    for k, n in enumerate(to, 1):
        cols.append((F.pmod(F.floor(at / step), F.lit(n)) + 1).cast("long").alias(f"d{k}"))
        step *= n
    return Factor(array.df.select(*cols, array.value), tuple(f"d{k}" for k in range(1, len(to) + 1)), array.value)


def flat(array: Factor, shape: list[int]) -> Factor:
    """A grid's elements in one axis `at`, column by column: how a solver holds a state."""
    return Factor(array.df.select((_linear(array.axes, shape) + 1).cast("long").alias("at"), array.value), ("at",), array.value)


def scattered(vector: Factor, shape: list[int], axes: tuple[str, ...]) -> Factor:
    """The grid that flat() came from; places outside the shape fail the query."""
    if len(axes) != len(shape):
        raise QuernError("reshape", f"{len(axes)} axes of a grid of {len(shape)}")
    at = bound(F.col(vector.axes[0]), reduce(lambda a, b: a * b, shape)) - 1
    cols, step = [], 1
    for a, n in zip(axes, shape, strict=True):
        cols.append((F.pmod(F.floor(at / step), F.lit(n)) + 1).cast("long").alias(a))
        step *= n
    return Factor(vector.df.select(*cols, vector.value), tuple(axes), vector.value)


def transpose(array: Factor, perm: list[int] | None = None) -> Factor:
    """Axes in the order perm (from 0; backwards if absent), under the names they take over."""
    perm = perm or list(range(len(array.axes)))[::-1]
    if sorted(perm) != list(range(len(array.axes))):
        raise QuernError("transpose", f"{perm} is not an order of {len(array.axes)} axes")
    cols = [F.col(array.axes[p]).alias(a) for a, p in zip(array.axes, perm, strict=True)]
    return Factor(array.df.select(*cols, array.value), array.axes, array.value)


def concat(arrays: list[Factor], sizes: list[int], axis: int = 0) -> Factor:
    """Arrays one after another along an axis (from 0); sizes are theirs along it."""
    first, start, out = arrays[0], 0, None
    for a, n in zip(arrays, sizes, strict=True):
        part = a.named(*first.axes, value=first.value).df.withColumn(first.axes[axis], F.col(first.axes[axis]) + F.lit(start))
        out, start = part if out is None else out.unionByName(part), start + n
    return Factor(out, first.axes, first.value)


def aligned(target: list[str], arrays: list[Factor], sets: dict[str, DataFrame]) -> DataFrame:
    """Arrays side by side over the axes `target`, matched by axis name; axes that none has are repeated over their set. Others are an error."""
    for a in arrays:
        if extra := set(a.axes) - set(target):
            raise QuernError("axis_not_in_result", f"{sorted(extra)}")
    out, have = None, set()
    for a in arrays:
        shared = sorted(have & set(a.axes))
        out = a.df if out is None else out.join(a.df, shared) if shared else out.crossJoin(a.df)
        have |= set(a.axes)
    for axis in target:
        if axis not in have:
            out = out.crossJoin(sets[axis])
    return out


def broadcast(fn, arrays: list[Factor], target: list[str], sets: dict[str, DataFrame], name: str = "value") -> Factor:
    """A scalar function of aligned arrays, element by element."""
    apart = [Factor(a.df.withColumnRenamed(a.value, f"__b{i}"), a.axes, f"__b{i}") for i, a in enumerate(arrays)]
    frame = aligned(target, apart, sets)
    return Factor(frame.select(*target, fn(*[F.col(a.value) for a in apart]).alias(name)), tuple(target), name)


def stencil(df: DataFrame, by: list[str], order: str, value: str, weights: dict[int, float], name: str = "value", ghost: float = 0.0) -> DataFrame:
    """Weighted sum of neighbours at offsets along a gap-free axis; beyond its ends they read `ghost`.

    Without `by`, the one axis is cut into ranges, and each gets a halo of the rows around it, so no task holds the whole axis.
    """
    at = lambda k, w: F.col(value) if k == 0 else F.coalesce(F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w), F.lit(ghost))
    total = lambda w: reduce(lambda a, b: a + b, [F.lit(c) * at(k, w) for k, c in sorted(weights.items())])
    if by:
        return df.withColumn(name, total(Window.partitionBy(*by).orderBy(order)))
    cut = with_halo(df, order, max(0, -min(weights)), max(0, max(weights)), value)
    return cut.withColumn(name, total(Window.partitionBy("__range").orderBy(order))).where("__own").drop("__range", "__own")


def shifted(array: Factor, axis: str, by: int, name: str, ghost: float = 0.0) -> DataFrame:
    """array with `name` = its value `by` places on along one of several axes: a join on the shifted key."""
    side = array.df.select(*[F.col(a) - F.lit(by) if a == axis else F.col(a) for a in array.axes], F.col(array.value).alias(name)).toDF(*array.axes, name)
    return array.df.join(side, list(array.axes), "left").withColumn(name, F.coalesce(F.col(name), F.lit(ghost)))


def field_reduce(df: DataFrame, value: str, how: str, reference: str | None = None) -> DataFrame:
    """mean, max, min, integral (the mean: unit measure), L2_error (relative to the reference's norm) or Linf_error."""
    v, d = F.col(value), (F.col(value) - F.col(reference) if reference else None)
    simple = {"mean": F.avg(v), "integral": F.avg(v), "max": F.max(v), "min": F.min(v)}
    if how in simple:
        return df.agg(simple[how].alias(how))
    if reference is None or how not in ("L2_error", "Linf_error"):
        raise QuernError("field_reduce", f"{how} with reference {reference}")
    if how == "Linf_error":
        return df.agg(F.max(F.abs(d)).alias(how))
    return df.agg(F.sqrt(F.sum(d * d) / F.sum(F.col(reference) * F.col(reference))).alias(how))


def cell_name(base: str, *index: Column) -> Column:
    """u[i,j] as text."""
    return F.concat(F.lit(f"{base}["), F.concat_ws(",", *[i.cast("string") for i in index]), F.lit("]"))


def parse_cell(name: Column) -> tuple[Column, Column]:
    """(base, indices) of u[i,j]; a plain name has none."""
    inner = F.regexp_extract(name, r"\[([0-9,\s-]*)\]$", 1)
    return F.regexp_replace(name, r"\[[0-9,\s-]*\]$", ""), F.when(inner == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(inner, r"\s*,\s*"), lambda x: x.cast("long")))


def matvec(matrix: Factor, vector: Factor, row: str, col: str, name: str = "value") -> DataFrame:
    """y[r] = sum over c of A[r, c] * x[c]; map-side sums keep the shuffle at one row a row and task."""
    return matrix.df.select(row, col, F.col(matrix.value).alias("__a")).join(vector.df.select(col, F.col(vector.value).alias("__x")), col).groupBy(row).agg(F.sum(F.col("__a") * F.col("__x")).alias(name))


#: Rows and columns of a packed block.
BLOCK_ROWS, BLOCK_COLS = 4096, 512


def matmul(a: Factor, b: Factor, name: str = "value", inner: int | None = None, block: tuple[int, int] = (BLOCK_ROWS, BLOCK_COLS)) -> Factor:
    """out[r, k] = sum over c of a[r, c] * b[c, k], by dense products of blocks of rows and columns; places count from 1.

    Cells of a meet in blocks of rows and columns; those of b that have a block's columns stand beside each block of rows. One
    exchange, and a second that adds up where the columns, `inner` of them (their largest place, if not given), fill
    more than one block. A cell of the result exists where a row and a column share a place; cells with a null key or value take no part,
    cells given twice are added.
    """
    (row, col), (bcol, k) = a.axes, b.axes
    ship(a.df.sparkSession)
    tall, wide = block
    left = a.df.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col(a.value).isNotNull()).select(F.col(row).cast("long").alias("r"), F.col(col).cast("long").alias("c"), F.col(a.value).cast("double").alias("v"))
    right = b.df.where(F.col(bcol).isNotNull() & F.col(k).isNotNull() & F.col(b.value).isNotNull()).select(F.col(k).cast("long").alias("r"), F.col(bcol).cast("long").alias("c"), F.col(b.value).cast("double").alias("v"))
    rows, cols = left.agg(F.max("r"), F.max("c")).first()
    blocks = -(-(rows or 0) // tall)
    placed = lambda df, at, side: df.select(at.alias("rb"), F.floor((F.col("c") - 1) / wide).alias("cb"), F.lit(side).alias("side"), "r", "c", "v")
    both = placed(left, F.floor((F.col("r") - 1) / tall), 0).unionByName(placed(right, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))) if blocks else F.lit(0).cast("long"), 1))

    def product(key, table):
        """One block: dense where it has cells, rows and columns that it lacks left out."""
        side = table["side"].to_numpy()
        r, c, v = (table[x].to_numpy() for x in "rcv")
        own, other = side == 0, side == 1
        rows, ri = np.unique(r[own], return_inverse=True)
        ks, ki = np.unique(r[other], return_inverse=True)
        places, ci = np.unique(c, return_inverse=True)
        dense, there = [], []
        for n, i, which in ((len(rows), ri, own), (len(ks), ki, other)):
            x, has = np.zeros((n, len(places))), np.zeros((n, len(places)), np.float32)
            np.add.at(x, (i, ci[which]), v[which])
            has[i, ci[which]] = 1
            dense.append(x)
            there.append(has)
        met = np.nonzero(there[0] @ there[1].T)
        return pa.table({row: rows[met[0]], k: ks[met[1]], name: (dense[0] @ dense[1].T)[met]})

    out = both.groupBy("rb", "cb").applyInArrow(product, f"`{row}` long, `{k}` long, `{name}` double")
    if (inner or cols or 0) > wide:
        out = out.groupBy(row, k).agg(F.sum(name).alias(name))
    return Factor(out, (row, k), name)
