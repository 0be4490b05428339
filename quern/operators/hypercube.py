"""Cyclic joins in one exchange: rows go to the cells of a grid over the indices, and each cell joins index by index.

Each index has a share, the number of parts that its values are cut into: ranges of as many rows for numbers, so that values that
lie together stay together, and hashes for anything else. A cell is one part of each index, and a block is what a factor has in one part of
each of its own. Cells are listed from the counts of the blocks: one in which some factor has no row is none, and gets
nothing. A block goes to all listed cells that agree with it, so any combination of rows meets in exactly one; it goes
compressed, packed before it is repeated. Where values occur with few others of another index, and those lie together, cells grow with the
rows; where any value meets any other, they are the whole grid, and go in waves, each joined and folded before the next is sent, so that
what stands on disk grows with the rows still. In a cell the factors are tries of
sorted arrays, and an index is bound by the factor that offers the fewest values and looked up in the others,
many partial bindings at a time: no intermediate exceeds what the body can give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import saved, ship
from .elimination import Algebra

#: Rows of all factors that a cell should not exceed; cells at most; partial bindings extended at a time.
CELL_ROWS, MOST_CELLS, AT_ONCE = 500_000, 1 << 20, 1 << 19
#: Rows that a wave sends to cells: so many, or so many times the rows of the factors.
WAVE_ROWS, WAVE_TIMES = 100_000_000, 4
#: Blocks of a factor that can be counted; rows that a task packs at a time; places of a level that are looked up in a table.
MOST_BLOCKS, PACK_ROWS, DENSE = 1 << 20, 1 << 20, 1 << 23


def _sorted(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns of whole numbers: of one number each, where that fits."""
    spans = [int(x.max()) - int(x.min()) + 1 if len(x) else 1 for x in columns]
    if np.prod(spans, dtype=float) >= 1 << 62:
        return np.lexsort(columns[::-1])
    return np.argsort(_combined([x - (x.min() if len(x) else 0) for x in columns], spans))


def _combined(parts: list[np.ndarray], shares: list[int]) -> np.ndarray:
    """One number for a part of each index."""
    return reduce(lambda own, x: own * x[1] + x[0], zip(parts, shares, strict=True), np.int64(0))


class Trie:
    """Distinct rows of codes, level by level: keys are parent * size + code, in order; start says where a parent's children begin."""

    def __init__(self, columns: list[np.ndarray], sizes: list[int]):
        order = _sorted(columns)
        self.sizes, self.keys, self.codes, self.start, self.tables, node, parents = sizes, [], [], [], {}, np.zeros(len(order), np.int64), 1
        for column, size in zip(columns, sizes, strict=True):
            key = node * size + column[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            self.keys.append(key[new])
            self.codes.append(column[order][new])
            self.start.append(np.searchsorted(self.keys[-1], np.arange(parents + 1) * size))
            node, parents = np.cumsum(new) - 1, int(new.sum())
        #: Of each leaf the row that it came from.
        self.row = order

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[level][node], self.start[level][node + 1]

    def find(self, level: int, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child with a code, or -1."""
        key = node * self.sizes[level] + code
        space = (len(self.start[level]) - 1) * self.sizes[level]
        if level not in self.tables and space <= min(DENSE, 8 * len(key)):
            self.tables[level] = np.full(space, -1, np.int32)
            self.tables[level][self.keys[level]] = np.arange(len(self.keys[level]), dtype=np.int32)
        if level in self.tables:
            return self.tables[level][key].astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys[level], key), len(self.keys[level]) - 1)
        return np.where(self.keys[level][at] == key, at, -1)


def bindings(tries: list[Trie], axes: list[list[int]], n_vars: int, keep: list[int], at_once: int = AT_ONCE) -> Iterator[tuple[dict[int, np.ndarray], list[np.ndarray]]]:
    """(codes of the indices in keep, leaf of each trie) of all full bindings, in parts."""
    if any(not len(t.row) for t in tries):
        return

    def extend(v: int, codes: dict[int, np.ndarray], nodes: list[np.ndarray]):
        if v == n_vars:
            yield codes, nodes
            return
        own = [r for r, a in enumerate(axes) if v in a]
        level = {r: axes[r].index(v) for r in own}
        spans = {r: tries[r].children(level[r], nodes[r]) for r in own}
        counts = np.stack([spans[r][1] - spans[r][0] for r in own])
        fewest, offer = counts.min(0), counts.argmin(0)
        for which, r in enumerate(own):
            mine = np.flatnonzero((offer == which) & (fewest > 0))
            # Bindings are extended in groups, so that what they offer stays bounded; one binding's own offer is a group at least.
            ends = np.cumsum(fewest[mine])
            lo = 0
            while lo < len(mine):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, "right")))
                some = mine[lo:hi]
                lo = hi
                n = fewest[some]
                back = np.repeat(some, n)
                child = np.arange(int(n.sum())) + np.repeat(spans[r][0][some] - (np.cumsum(n) - n), n)
                code = tries[r].codes[level[r]][child]
                found = {r: child}
                for s in own:
                    if s != r:
                        at = tries[s].find(level[s], nodes[s][back], code)
                        hit = at >= 0
                        back, code = back[hit], code[hit]
                        found = {k: x[hit] for k, x in found.items()} | {s: at[hit]}
                if len(back):
                    now = {k: x[back] for k, x in codes.items()} | ({v: code} if v in keep else {})
                    yield from extend(v + 1, now, [found[k] if k in found else x[back] for k, x in enumerate(nodes)])

    yield from extend(0, {}, [np.zeros(1, np.int64) for _ in tries])


def folded(keys: list[np.ndarray], values: list[np.ndarray], reducers: list[np.ufunc]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One row for each combination of keys."""
    n = len(values[0])
    group = np.zeros(n, np.int64)
    for k in keys:
        group = np.unique(group * (int(k.max()) + 1 if n else 1) + k, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])[:n])
    return [k[order][first] for k in keys], [f.reduceat(v[order], first) if n else v for f, v in zip(reducers, values, strict=True)]


def join_cell(tables: list[pa.Table], axes: list[list[str]], order: list[str], keep: list[str], algebra: Algebra, at_once: int = AT_ONCE) -> pa.Table:
    """The join of one cell's factors, folded onto `keep`: keys and value columns."""
    names, codes, sizes = {}, [{} for _ in tables], {}
    for v in order:
        chunks = [t[v].combine_chunks() for t, a in zip(tables, axes, strict=True) if v in a]
        whole = pa.chunked_array(chunks).combine_chunks().dictionary_encode()
        names[v], every = whole.dictionary, whole.indices.to_numpy().astype(np.int64)
        sizes[v], at = max(1, len(whole.dictionary)), 0
        for k, a in enumerate(axes):
            if v in a:
                codes[k][v] = every[at : at + len(tables[k])]
                at += len(tables[k])
    ranked = [[v for v in order if v in a] for a in axes]
    tries = [Trie([codes[k][v] for v in r], [sizes[v] for v in r]) for k, r in enumerate(ranked)]
    values = [[t[c].to_numpy() for c in algebra.columns] for t in tables]
    place = {v: i for i, v in enumerate(order)}
    held: list = []
    for own, leaves in bindings(tries, [[place[v] for v in r] for r in ranked], len(order), [place[v] for v in keep], at_once):
        terms = algebra.product([[c[t.row[leaf]] for c in vs] for vs, t, leaf in zip(values, tries, leaves, strict=True)])
        held.append(folded([own[place[v]] for v in keep], terms, algebra.reducers()))
        if sum(len(x[1][0]) for x in held) > 4 * at_once:
            held = [folded([np.concatenate(x) for x in zip(*(k for k, _ in held), strict=True)], [np.concatenate(x) for x in zip(*(v for _, v in held), strict=True)], algebra.reducers())]
    keys = [np.concatenate([k[i] for k, _ in held]) if held else np.zeros(0, np.int64) for i in range(len(keep))]
    sums = [np.concatenate([v[i] for _, v in held]) if held else values[0][i][:0] for i in range(len(algebra.columns))]
    keys, sums = folded(keys, sums, algebra.reducers())
    return pa.table({**{v: names[v].take(pa.array(k)) for v, k in zip(keep, keys, strict=True)}, **dict(zip(algebra.columns, map(pa.array, sums), strict=True))})


@dataclass(frozen=True)
class Grid:
    """The parts of the indices and the cells that hold a row of each factor.

    An index has `fine` parts, between `cuts` or by hash; neighbours are put together until `shares` are left. `cells` has the
    parts of each cell, by index, and `rows` what it gets.
    """

    fine: int
    cuts: dict[str, np.ndarray | None]
    shares: dict[str, int]
    cells: dict[str, np.ndarray]
    rows: np.ndarray | None = None

    def waves(self, most: int) -> list[Grid]:
        """The cells in groups that get about `most` rows each, those of one part of the first index together."""
        order = np.lexsort([self.cells[v] for v in sorted(self.cells)][::-1])
        wave = (np.cumsum(self.rows[order]) - self.rows[order]) // most
        groups = [g for g in np.split(order, np.flatnonzero(np.diff(wave)) + 1) if len(g)]
        return [replace(self, cells={v: x[g] for v, x in self.cells.items()}, rows=self.rows[g]) for g in groups] or [self]

    def hashed(self, df: DataFrame) -> DataFrame:
        """df with a column __at_v for each index v that has no cuts."""
        return df.withColumns({f"__at_{v}": F.pmod(F.xxhash64(F.lit(v), F.col(v)), F.lit(self.fine)).cast("int") for v in df.columns if v in self.cuts and self.cuts[v] is None})

    def part(self, rows: pa.Table, v: str) -> np.ndarray:
        """Of what hashed() gave, the part of each row."""
        fine = rows[f"__at_{v}"].to_numpy() if self.cuts[v] is None else np.searchsorted(self.cuts[v], rows[v].to_numpy())
        return fine.astype(np.int64) * self.shares[v] // self.fine

    def own(self, rows: pa.Table, axes: list[str]) -> np.ndarray:
        """The block of each row."""
        return _combined([self.part(rows, v) for v in axes], [self.shares[v] for v in axes])

    def within(self, df: DataFrame) -> DataFrame:
        """The rows of df between the first and the last part of each index that cells have."""
        for v in df.columns:
            cuts = self.cuts.get(v)
            if cuts is None or not len(self.cells[v]):
                continue
            wide = self.fine // self.shares[v]
            lo, hi = int(self.cells[v].min()) * wide, int(self.cells[v].max() + 1) * wide
            df = df.where(F.col(v) > cuts[lo - 1].item()) if 0 < lo <= len(cuts) else df
            df = df.where(F.col(v) <= cuts[hi - 1].item()) if hi <= len(cuts) else df
        return df

    def places(self, axes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks that have cells; where the cells of each begin, and the end; cells in this order."""
        own = _combined([self.cells[v] for v in axes], [self.shares[v] for v in axes])
        order = np.argsort(own, kind="stable")
        blocks, start = np.unique(own[order], return_index=True)
        return blocks, np.append(start, len(own)), order


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _cuts(parts: list[tuple[frozenset, DataFrame]], v: str, fine: int) -> np.ndarray | None:
    """Ends of ranges of an index with as many rows each; none unless it is of numbers."""
    own = [df.select(v) for axes, df in parts if v in axes]
    if not isinstance(own[0].schema[v].dataType, T.IntegralType | T.FractionalType) or isinstance(own[0].schema[v].dataType, T.DecimalType):
        return None
    ends = F.array(*[F.lit(k / fine) for k in range(1, fine)])
    return np.unique(reduce(DataFrame.unionByName, own).select(F.percentile_approx(v, ends, 10_000)).first()[0] or [0])


def _counted(df: DataFrame, axes: list[str], grid: Grid) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The blocks of a factor that have rows, by index, and their rows: MOST_BLOCKS numbers at most, whatever the rows are."""
    size = int(np.prod([grid.shares[v] for v in axes]))

    def count(batches):
        n = np.zeros(size, np.int64)
        for rows in _gathered(batches, PACK_ROWS):
            n += np.bincount(grid.own(rows, axes), minlength=size)
        at = np.flatnonzero(n)
        yield pa.record_batch({"__own": pa.array(at), "__n": pa.array(n[at])})

    got = grid.hashed(df.select(*axes)).mapInArrow(count, "__own long, __n long").groupBy("__own").agg(F.sum("__n").alias("__n")).toArrow()
    own = got["__own"].to_numpy()
    return dict(zip(axes, np.unravel_index(own, [grid.shares[v] for v in axes]), strict=True)), got["__n"].to_numpy()


def _listed(blocks: list[tuple[dict[str, np.ndarray], np.ndarray]], shares: dict[str, int], fine: int) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
    """The cells that have rows of each factor, and how many; None if they are too many."""
    order, tries, sums = sorted(shares), [], []
    for fines, n in blocks:
        sizes = [shares[v] for v in sorted(fines)]
        sums.append(np.bincount(_combined([fines[v].astype(np.int64) * shares[v] // fine for v in sorted(fines)], sizes), n, int(np.prod(sizes))))
        at = np.flatnonzero(sums[-1])
        sums[-1] = sums[-1][at]
        tries.append(Trie([x.astype(np.int64) for x in np.unravel_index(at, sizes)], sizes))
    held, cells = [], 0
    for own, leaves in bindings(tries, [[order.index(v) for v in sorted(fines)] for fines, _ in blocks], len(order), list(range(len(order)))):
        held.append((own, sum(n[t.row[leaf]] for n, t, leaf in zip(sums, tries, leaves, strict=True))))
        cells += len(held[-1][1])
        if cells > MOST_CELLS:
            return None
    joined = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return {v: joined([own[k] for own, _ in held]) for k, v in enumerate(order)}, joined([n for _, n in held])


def choose_grid(parts: list[tuple[frozenset, DataFrame]], cores: int, cell_rows: int = CELL_ROWS) -> Grid:
    """Shares that give as many cells as cores and, as counted, none with more than cell_rows rows, and send few rows to several cells.

    All are doubled together while cells are too large; then, if that would list too many cells, that of the index whose
    doubling makes the largest cell smallest. What was doubled in vain, or for fewer rows than it repeats, is halved again.
    """
    ship(parts[0][1].sparkSession)
    axes = sorted(frozenset().union(*(a for a, _ in parts)))
    total = sum(df.count() for _, df in parts)
    most = MOST_BLOCKS.bit_length() - 1
    fine = 1 << min(most // max(len(a) for a, _ in parts), max(6, (8 * total // cell_rows).bit_length()))
    finest = Grid(fine, {v: _cuts(parts, v, fine) for v in axes}, dict.fromkeys(axes, fine), {})
    blocks = [_counted(df, sorted(a), finest) for a, df in parts]
    cost = lambda shares: (listed := _listed(blocks, shares, fine)) and (listed[1].max(initial=0), listed[1].sum(), shares, listed)
    enough = lambda at: not at[1] or at[0] <= cell_rows and (len(at[3][1]) >= cores or total <= 10_000)
    step = lambda shares, own, by: cost(shares | {v: int(shares[v] * by) for v in own})
    at = cost(dict.fromkeys(axes, 1))
    while not enough(at) and at[2][axes[0]] < fine and (more := step(at[2], axes, 2)):
        at = more
    while not enough(at) and (tried := [x for v in axes if at[2][v] < fine and (x := step(at[2], [v], 2))]):
        at = min(tried, key=lambda x: x[:2])
    cell_rows = max(cell_rows, at[0])
    while tried := [x for v in axes if at[2][v] > 1 and (x := step(at[2], [v], 0.5)) and enough(x) and x[1] < at[1]]:
        at = min(tried, key=lambda x: x[1])
    shares, (cells, rows) = at[2:]
    return Grid(fine, finest.cuts, shares, cells, rows)


def choose_shares(parts: list[tuple[frozenset, DataFrame]], cores: int, cell_rows: int = CELL_ROWS) -> dict[str, int]:
    return choose_grid(parts, cores, cell_rows).shares


def _written(rows: pa.Table) -> bytes:
    """A block as bytes; whole numbers are counted from the least, in as few bytes as they need."""
    least, columns = {}, {}
    for name, x in zip(rows.column_names, rows.columns, strict=True):
        if pa.types.is_signed_integer(x.type):
            x = x.to_numpy()
            low, high = int(x.min()), int(x.max())
            if high - low < 1 << 32:
                least[name], x = str(low), (x - low).astype(np.min_scalar_type(high - low))
        columns[name] = x
    table = pa.table(columns).replace_schema_metadata(least)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _read(block: pa.Buffer, schema: pa.Schema) -> pa.Table:
    """What _written() was given."""
    table = pa.ipc.open_stream(block).read_all()
    least = {k.decode(): int(v) for k, v in (table.schema.metadata or {}).items()}
    return pa.table([table[f.name].to_numpy().astype(np.int64) + least[f.name] if f.name in least else table[f.name] for f in schema], names=schema.names).cast(schema)


def _packed(number: int, axes: list[str], columns: list[str], grid) -> Callable:
    """A factor's rows as blocks, sorted where keys are whole numbers and compressed since they go to many cells, each with its cells; a block without a cell is left out.
    A task packs PACK_ROWS rows at a time, so a block can come in several pieces."""

    def pack(batches):
        own_grid = grid.value
        blocks, start, cells = own_grid.places(axes)
        has_cells = np.zeros(int(np.prod([own_grid.shares[v] for v in axes])), bool)
        has_cells[blocks] = True
        for rows in _gathered(batches, PACK_ROWS):
            own = own_grid.own(rows, axes)
            at = np.flatnonzero(has_cells[own])
            if not len(at):
                continue
            if len(at) < len(own):
                own, rows = own[at], rows.combine_chunks().take(at)
            whole = [rows[v].to_numpy().astype(np.int64) for v in axes if pa.types.is_integer(rows.schema.field(v).type)]
            order = _sorted([own, *whole])
            own, rows = own[order], rows.select(columns).combine_chunks().take(order)
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            place = np.searchsorted(blocks, own[first])
            out = [(cells[start[k] : start[k + 1]], number, _written(rows.slice(lo, hi - lo))) for lo, hi, k in zip(first, [*first[1:], len(own)], place, strict=True)]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.list_(pa.int64()), pa.int32(), pa.binary()), strict=True)], names=["__cells", "__factor", "__block"])

    return pack


def join_core(parts: list[tuple[frozenset, DataFrame]], keep: frozenset, algebra: Algebra, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The join of factors (indices, rows) of a cyclic body, folded onto the indices in `keep`."""
    spark = parts[0][1].sparkSession
    ship(spark)
    # Indices of most factors first: they are looked up in most others.
    order = sorted(frozenset().union(*(a for a, _ in parts)), key=lambda v: (-sum(v in a for a, _ in parts), v))
    keys = {v: next(df.schema[v].dataType for a, df in parts if v in a) for v in order}
    parts = [(axes, saved(df.select(*[F.col(v).cast(keys[v]).alias(v) for v in sorted(axes)], *algebra.columns).groupBy(*sorted(axes)).agg(*algebra.folds()), "core", tidy=True)) for axes, df in parts]
    cores = spark.sparkContext.defaultParallelism
    grid = choose_grid(parts, cores, cell_rows)
    axes, frames = [sorted(a) for a, _ in parts], [df.select(*sorted(a), *algebra.columns) for a, df in parts]
    empty = [df.limit(0).toArrow().schema.empty_table() for df in frames]
    kept = sorted(keep)
    out = parts[0][1].select(*algebra.columns).schema
    schema = ", ".join([*(f"`{v}` {keys[v].simpleString()}" for v in kept), *(f"{f.name} {f.dataType.simpleString()}" for f in out)])

    def cell(table: pa.Table) -> pa.Table:
        blocks = [[e] for e in empty]
        for k, block in zip(table["__factor"].to_pylist(), table["__block"], strict=True):
            blocks[k].append(_read(block.as_buffer(), empty[k].schema))
        return join_cell([pa.concat_tables(b) for b in blocks], axes, order, kept, algebra)

    def folded_onto(df: DataFrame) -> DataFrame:
        return df.groupBy(*kept).agg(*algebra.folds()) if kept else df.agg(*algebra.folds())

    def met(some: Grid) -> DataFrame:
        shared, placed = spark.sparkContext.broadcast(some), []
        for k, (a, df) in enumerate(zip(axes, frames, strict=True)):
            blocks = some.hashed(some.within(df)).mapInArrow(_packed(k, a, df.columns, shared), "__cells array<long>, __factor int, __block binary")
            placed.append(blocks.select(F.explode("__cells").alias("__cell"), "__factor", "__block"))
        # Some cells a task, whatever they weigh, and few enough to be sorted in memory.
        n = min(10_000, max(4 * cores, len(some.rows) // 8))
        return folded_onto(reduce(DataFrame.unionByName, placed).repartition(n, "__cell").groupBy("__cell").applyInArrow(cell, schema))

    waves = grid.waves(max(WAVE_ROWS, WAVE_TIMES * sum(df.count() for df in frames)))
    if len(waves) == 1:
        return met(grid)
    return folded_onto(reduce(DataFrame.unionByName, [saved(met(w), "wave", tidy=True) for w in waves]))
