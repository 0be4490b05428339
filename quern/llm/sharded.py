"""Tables of hashes counted in Spark, merged by shards, written as sorted arrays and memory-mapped by workers.

A map task sends, for each shard, arrays compressed into one cell, so a count of hundreds of millions of keys
shuffles as a few thousand rows. A shard is a range of hashes: its size follows the number of shards, and a
frequent key adds one entry a task to it, not one an occurrence. Beyond FAN shards a gathering sends one cell
for each of at most FAN ranges of shards, and tasks that share a range cut it further, exchange by exchange:
cells then grow with the input, not with its square.
"""

from __future__ import annotations

import json
import mmap
import os
import sys
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .shared import write_array_file
from .text import mix

#: Bytes of text to a shard of its statistics; cells that one gathering sends at most.
SHARD_BYTES, FAN = 14 << 20, 1024
#: Bytes of packed cells that a task cuts at a time; bytes of text that one task gathers at least, where the cluster has no more cores.
RECUT_BYTES, TASK_BYTES = 32 << 20, 256 << 20
#: Whether a mapped file can do without its descriptor; files of one table that a worker keeps mapped. Keys visit the shards in turn, so
#: with fewer than there are shards each visit would map its file, and fault its pages in, again.
FREE = {"trackfd": False} if sys.version_info >= (3, 13) else {}
OPEN = 8192 if FREE else 512
CELL = "shard int, fine binary, data binary"


class Shards(int):
    """A number of shards; at: the parts that one exchange cuts into, of which the number is a power."""

    at: int


def shard_number(input_bytes: int, shard_bytes: int = SHARD_BYTES) -> Shards:
    """Shards for so many bytes: up to FAN any number, beyond it a square, a cube and so on."""
    n, k = max(4, -(-input_bytes // shard_bytes)), 1
    while (f := n if k == 1 else int(np.ceil(round(n ** (1 / k), 9)))) > FAN:
        k += 1
    out = Shards(f**k)
    out.at = f
    return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Monotone in h, so hashes in order are shards in order."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.nbytes))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:]
    out, at = [], 8 + 16 * n
    for kind, size in head.reshape(-1, 2):
        out.append(np.frombuffer(raw[at : at + size], np.dtype(chr(kind))))
        at += int(size)
    return out


def cells(where: np.ndarray, shards: Shards, columns: list[np.ndarray], pack=packed, at: int | None = None) -> pa.RecordBatch:
    """Rows in order of their shards `where`, one cell for each range of shards that has rows; pack() keeps rows and their order."""
    at = at or shards.at
    step = shards // at
    cut = np.searchsorted(where, np.arange(0, shards + 1, step))
    own = np.flatnonzero(np.diff(cut))
    fine = [None if step == 1 else packed((where[cut[s] : cut[s + 1]] - s * step).astype(np.int32)) for s in own]
    data = [pack(*(c[cut[s] : cut[s + 1]] for c in columns)) for s in own]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(fine, pa.binary()), pa.array(data, pa.binary())], ["shard", "fine", "data"])


def _recut(shards: Shards, was: int, at: int, pack, unpack):
    def recut(batches):
        held, size = [], 0

        def flush():
            where = np.concatenate([w for w, _ in held])
            order = np.argsort(where, kind="stable")
            columns = [np.concatenate(c)[order] for c in zip(*(c for _, c in held), strict=True)]
            return cells(where[order], shards, columns, pack, at)

        for b in batches:
            for s, fine, data in zip(*(b.column(c).to_pylist() for c in ("shard", "fine", "data")), strict=True):
                held.append((unpacked(fine)[0].astype(np.int64) + s * (shards // was), unpack(data)))
                size += len(data)
                if size > RECUT_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return recut


def grouped(df, shards: Shards, pack=packed, unpack=unpacked):
    """Cells (CELL) grouped by shard, a task each, whatever the session's number of shuffle partitions."""
    f = at = shards.at
    while at < shards:
        n = shards // at
        df = df.repartitionById(shards, F.col("shard") * n + F.pmod(F.xxhash64("data"), F.lit(n)).cast("int")).mapInArrow(_recut(shards, at, at * f, pack, unpack), CELL)
        at *= f
    return df.repartitionById(shards, F.col("shard")).groupBy("shard")


def gathering(rows, input_bytes: int):
    """Rows in fewer, larger map tasks, never fewer than the cluster's cores: what a task adds up before it sends is worth more."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-input_bytes // TASK_BYTES)))


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.zeros(len(sorted_keys[0]), bool)
    if len(new):
        new[0] = True
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts


def write_sorted(folder: str, name: str, shard: int, **columns: np.ndarray) -> None:
    """The columns of one shard in one file: a header of names, types, shapes and places, then the arrays."""
    arrays = {c: np.ascontiguousarray(a) for c, a in columns.items()}
    head, at = [], 0
    for c, a in arrays.items():
        head.append([c, a.dtype.str, list(a.shape), at])
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    start = -(-(len(text) + 16) // 64) * 64

    def put(path: str) -> None:
        with open(path, "wb") as f:
            f.write(np.array([len(text), start], np.int64).tobytes() + text.ljust(start - 16))
            for a in arrays.values():
                f.write(a.tobytes() + bytes(-a.nbytes % 64))

    write_array_file(f"{folder}/{name}-{shard}.arrays", put)


def _mapped(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **FREE)
    n, start = np.frombuffer(m, np.int64, 2)
    out = {}
    for c, kind, shape, at in json.loads(m[16 : 16 + int(n)]):
        size = int(np.prod(shape))
        out[c] = np.frombuffer(m, np.dtype(kind), size, int(start) + at).reshape(shape) if size else np.zeros(shape, np.dtype(kind))
    return out


class Sorted:
    """Reads what write_sorted() wrote; shards are mapped when first asked for, the OPEN last used stay mapped."""

    def __init__(self, folder: str, name: str, shards: int, columns: tuple[str, ...]):
        self.folder, self.name, self.shards, self.columns, self.open = folder, name, shards, columns, OrderedDict()

    def shard(self, s: int) -> dict[str, np.ndarray] | None:
        if s not in self.open:
            path = f"{self.folder}/{self.name}-{s}.arrays"
            self.open[s] = _mapped(path) if os.path.exists(path) else None
            if len(self.open) > OPEN:
                self.open.popitem(last=False)
        self.open.move_to_end(s)
        return self.open[s]

    def find(self, own: dict[str, np.ndarray], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys q in one shard, and whether they are there."""
        i = np.searchsorted(own["key"], q)
        i[i == len(own["key"])] = 0
        return i, own["key"][i] == q

    def get(self, q: np.ndarray, by: np.ndarray | None = None) -> list[np.ndarray]:
        """The columns at each key of q, 0 where it is missing; `by` has the hash whose shard holds the key."""
        where = shard_of(q if by is None else by, self.shards)
        order = np.argsort(where, kind="stable")
        where = where[order]
        cut = np.append(runs(where), len(q))
        out: list = [None] * len(self.columns)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = self.shard(int(where[a]))
            if own is None or not len(own["key"]):
                continue
            rows = order[a:b]
            i, hit = self.find(own, q[rows])
            for k, c in enumerate(self.columns):
                x = own[c]
                if out[k] is None:
                    out[k] = np.zeros((len(q), *x.shape[1:]), np.float64 if x.dtype.kind == "f" else np.int64)
                out[k][rows[hit]] = x[i[hit]]
        return [np.zeros(len(q), np.int64) if x is None else x for x in out]


def _dealt_by(key: str, shards: Shards):
    def deal(batches):
        for b in batches:
            where = shard_of(mix(b.column(key).to_numpy().view(np.uint64)), shards)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *b.columns], ["shard", *b.schema.names])

    return deal


def _written(folder: str, name: str, key: str, columns: tuple[str, ...]):
    def write(shard, table):
        h = mix(table[key].to_numpy().view(np.uint64))
        order = np.argsort(h)
        write_sorted(folder, name, shard[0].as_py(), key=h[order], **{c: table[c].to_numpy()[order] for c in columns})
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    return write


def written_table(df, folder: str, name: str, key: str, columns: tuple[str, ...]) -> Shards:
    """Rows of a unique long key and columns of numbers without nulls, as sorted arrays of the shared folder that scans map and look up."""
    rows = df.select(key, *columns)
    shards = shard_number(8 * (1 + len(columns)) * rows.count())
    dealt = rows.mapInArrow(_dealt_by(key, shards), "shard int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)).repartitionById(shards, F.col("shard"))
    dealt.groupBy("shard").applyInArrow(_written(folder, name, key, columns), "n long").agg(F.sum("n")).collect()
    return shards
