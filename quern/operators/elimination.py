"""Contraction of many factors: an order of elimination, folds between joins, and a shares exchange for cyclic bodies.

Eliminating an index joins the factors that have it and folds it, as times distributes over plus. The order comes
from the hypergraph of the factors' indices: first whatever makes no factor larger than those there are, then the
index whose join has the smallest bound. A cyclic core, where any join of two factors can exceed the whole body's
bound, is joined in one exchange by operators/hypercube.py.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Factor, Semiring


@dataclass(frozen=True)
class Algebra:
    """A semiring over one or two value columns. Greatest and least products need both the least and the greatest value of each factor: a negative factor swaps them."""

    ring: Semiring

    @property
    def signed(self) -> bool:
        return self.ring.name in ("max_product", "min")

    @property
    def columns(self) -> tuple[str, ...]:
        return ("__lo", "__hi") if self.signed else ("__v",)

    def lifted(self, f: Factor) -> DataFrame:
        """A factor's rows with its value in these columns; null keys match nothing."""
        return f.df.where(" and ".join(f"`{a}` is not null" for a in f.axes) or "true").select(*f.axes, *[F.col(f.value).alias(c) for c in self.columns])

    def folds(self) -> list[Column]:
        if self.signed:
            return [F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi")]
        return [self.ring.plus(F.col("__v")).alias("__v")]

    def times(self, a: list[Column], b: list[Column]) -> list[Column]:
        if self.signed:
            products = [x * y for x in a for y in b]
            return [F.least(*products), F.greatest(*products)]
        return [self.ring.times(a[0], b[0])]

    def result(self) -> Column:
        return F.col("__v") if not self.signed else F.col("__hi") if self.ring.name == "max_product" else F.col("__lo")

    def product(self, values: list[list[np.ndarray]]) -> list[np.ndarray]:
        """times over factors, on arrays."""

        def two(a, b):
            if self.signed:
                products = [x * y for x in a for y in b]
                return [reduce(np.minimum, products), reduce(np.maximum, products)]
            return [{"sum_product": np.multiply, "bool_and_or": np.logical_and}.get(self.ring.name, np.add)(a[0], b[0])]

        return reduce(two, values)

    def reducers(self) -> list[np.ufunc]:
        """The fold of each column, on arrays."""
        return [np.minimum, np.maximum] if self.signed else [{"sum_product": np.add, "min_sum": np.minimum, "max_sum": np.maximum, "bool_and_or": np.logical_or}[self.ring.name]]


def distributes(ring: Semiring) -> bool:
    """Whether times distributes over the fold; a product of products does not."""
    return ring.name in ("sum_product", "max_product", "min", "min_sum", "max_sum", "bool_and_or")


def natural_join(factors: list[Factor]) -> DataFrame:
    """Factors joined by index name. Those that share an index with what is joined so far come first, so no product is formed between factors that are linked at all."""
    left, rest = factors[0].df, list(factors[1:])
    axes = set(factors[0].axes)
    while rest:
        nxt = next((f for f in rest if axes & set(f.axes)), rest[0])
        rest.remove(nxt)
        shared = sorted(axes & set(nxt.axes))
        left = left.join(nxt.df, shared) if shared else left.crossJoin(nxt.df)
        axes |= set(nxt.axes)
    return left


def cyclic_core(edges: list[frozenset]) -> list[int]:
    """The hyperedges left when indices of one edge only and edges inside others are removed again and again; none if the body is acyclic."""
    left = dict(enumerate(edges))
    while True:
        seen: dict[str, int] = {}
        for e in left.values():
            for a in e:
                seen[a] = seen.get(a, 0) + 1
        cut = {k: frozenset(a for a in e if seen[a] > 1) for k, e in left.items()}
        kept: dict[int, frozenset] = {}
        for k, e in sorted(cut.items(), key=lambda x: -len(x[1])):
            if e and not any(e <= o for o in kept.values()):
                kept[k] = e
        if kept == left:
            return sorted(kept) if len(kept) > 1 else []
        left = kept


def next_step(edges: list[frozenset], out: frozenset, extents: dict[str, float] | None = None) -> tuple[str, list[int], frozenset] | None:
    """What comes next: ("join" or "core", the factors it takes, the indices of its result); None once only free indices are left.

    Of the indices to fold, the first choice is one whose factors all lie inside one of them, so the result is no
    larger than that factor; then a cyclic core; then the index with the smallest bound of its result.
    """
    bound = sorted({a for e in edges for a in e} - out)
    if not bound:
        return None
    extents = extents or {}
    options = []
    for v in bound:
        own = [k for k, e in enumerate(edges) if v in e]
        union = frozenset().union(*(edges[k] for k in own))
        # Indices that no other factor has are folded with it.
        rest = frozenset(a for a in union if a in out or any(a in e for k, e in enumerate(edges) if k not in own))
        free = any(union <= edges[k] for k in own)
        options.append((not free, sum(math.log(extents.get(a, 1000.0)) for a in rest), len(own), v, own, rest))
    best = min(options, key=lambda x: x[:4])
    if not best[0]:
        return "join", best[4], best[5]
    core = cyclic_core(edges)
    if core:
        rest = frozenset(a for k in core for a in edges[k] if a in out or any(a in e for j, e in enumerate(edges) if j not in core))
        return "core", core, rest
    return "join", best[4], best[5]


def contract(factors: list[Factor], out: list[str], ring: Semiring, name: str = "value", extents: dict[str, float] | None = None) -> DataFrame:
    """out, name: plus over the other indices of times over the factors, index by index.

    `extents` are sizes of index sets, where known; they only change the order. Rows of equal indices are terms of their own.
    Without a term the result has no row, and for no free index one row of null.
    """
    from .hypercube import join_core

    algebra = Algebra(ring)
    work = [(frozenset(f.axes), algebra.lifted(f)) for f in factors]
    free = frozenset(out)

    def joined(parts: list[tuple[frozenset, DataFrame]], keep: frozenset) -> DataFrame:
        named = [Factor(df.select(*sorted(axes), *[F.col(c).alias(f"{c}{k}") for c in algebra.columns]), tuple(sorted(axes)), f"{algebra.columns[0]}{k}") for k, (axes, df) in enumerate(parts)]
        values = reduce(algebra.times, [[F.col(f"{c}{k}") for c in algebra.columns] for k in range(len(parts))])
        df = natural_join(named).select(*sorted(frozenset().union(*(a for a, _ in parts))), *[v.alias(c) for v, c in zip(values, algebra.columns, strict=True)])
        return df.groupBy(*sorted(keep)).agg(*algebra.folds()) if keep else df.agg(*algebra.folds())

    # An index that one factor alone has is folded before anything is joined.
    for k, (axes, df) in enumerate(work):
        keep = frozenset(a for a in axes if a in free or any(a in e for j, (e, _) in enumerate(work) if j != k))
        if len(work) > 1 and keep != axes:
            work[k] = keep, (df.groupBy(*sorted(keep)) if keep else df.groupBy()).agg(*algebra.folds())
    while step := next_step([a for a, _ in work], free, extents):
        kind, own, keep = step
        parts = [work[k] for k in own]
        df = join_core(parts, keep, algebra) if kind == "core" else joined(parts, keep)
        work = [w for k, w in enumerate(work) if k not in own] + [(keep, df)]
    last = joined(work, free)
    return last.select(*out, algebra.result().alias(name))
