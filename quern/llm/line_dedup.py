"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .near_dedup import Links
from .sharded import CELL, Shards, Sorted, cells, grouped, runs, shard_number, shard_of, small, totals, unpacked, write_sorted
from .shared import new_folder, saved, ship, text_bytes
from .text import LOWER, SPACE, _powers, buffers, mix, pair, pieces

#: Edits between lines of one class, and by default bytes of the shortest line that may differ; shorter lines must be equal.
EDITS, LEAST = 2, 24
#: Keys gathered before they are sent on; lines of one key that one task compares.
GATHER, BLOCK = 1_500_000, 1000


class Lines:
    """The lines of a piece of text: bytes between newlines without white space around them; blank ones are left out.

    hash: two 64-bit hashes of a line's bytes. start, end: its places. doc, number: its document and its place among all lines there.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        cut = np.flatnonzero(data == 10)
        begin = np.union1d(off[:-1], cut + 1)
        begin = begin[begin < len(data)]
        stop = np.append(begin[1:], len(data))
        stop = stop - (data[stop - 1] == 10) if len(stop) else stop
        ink = np.concatenate([[0], np.cumsum(~SPACE[data])])
        place = np.flatnonzero(~SPACE[data])
        own = ink[stop] > ink[begin] if len(begin) else np.zeros(0, bool)
        self.doc = np.searchsorted(off, begin, "right") - 1
        self.number = np.arange(len(begin)) - np.searchsorted(begin, off[self.doc])
        self.doc, self.number = self.doc[own], self.number[own]
        self.raw = begin[own], stop[own]
        self.start, self.end = place[ink[begin[own]]], place[ink[stop[own]] - 1] + 1
        self.size = self.end - self.start
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])
        # A second, unrelated sum: of mixed pairs of a byte and the power of its place.
        h = self.span(self.start, self.end)
        other = np.zeros(len(data) + 1, np.uint64)
        step = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA24BAED4963EE407))
        np.cumsum(step[LOWER[data]] * up[: len(data)], out=other[1:])
        second = (other[self.end] - other[self.start]) * self.down[self.start]
        self.hash = mix(h ^ self.size.astype(np.uint64)), mix(second + self.size.astype(np.uint64))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from a to b."""
        return (self.sums[b] - self.sums[a]) * self.down[a]


def segments(size: np.ndarray, edits: int = EDITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of the edits + 1 segments of lines of these sizes: even, the longer ones last."""
    n, parts = size // (edits + 1), edits + 1
    long = size - n * parts
    out, at = [], np.zeros_like(size)
    for i in range(parts):
        k = n + (i >= parts - long)
        out.append((at, k))
        at = at + k
    return out


def line_keys(lines: Lines, own: np.ndarray, edits: int = EDITS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): of each line its own segments, and the substrings where segments of lines up to `edits` shorter may stand.

    If a longer line s and a line r, d bytes shorter, are within the distance, one segment of r stands in s
    unchanged; with i segments on its left that all have edits, segment i (from 0) is at most i bytes from its
    place in r, and by the same count from the right at most edits - i bytes from its place there, d bytes on.
    """
    start, size = lines.start[own], lines.size[own]
    rows, keys = [], []
    for d in range(edits + 1):
        short = size - d
        for i, (at, k) in enumerate(segments(short, edits)):
            tag = mix(short.astype(np.uint64) * np.uint64(64) + np.uint64(i))
            for shift in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                a = start + at + shift
                ok = np.flatnonzero((short >= least) & (at + shift >= 0) & (at + shift + k <= size))
                keys.append(pair(tag[ok], lines.span(a[ok], (a + k)[ok])))
                rows.append(ok)
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    first = order[runs(rows[order], keys[order])] if len(order) else order
    return own[rows[first]], keys[first]


def within(a: bytes, b: bytes, edits: int = EDITS) -> bool:
    """Whether the edit distance of bytes is at most `edits`: a band of 2 * edits + 1 diagonals, one bit each, moved along both.

    Bit x of level e is set if the cell x diagonals into the band is reachable with e edits at the current row.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= edits
    width = 2 * edits + 1
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for k, c in enumerate(b):
        where[c] = where.get(c, 0) | 1 << (k + edits)
    inside = ((1 << (len(b) + 1)) - 1) << edits
    # level[e]: bit x stands for column row + x - edits of b.
    level = [0] * (edits + 1)
    for e in range(edits + 1):
        level[e] = ((1 << (e + 1)) - 1) << edits & full
    for row, c in enumerate(a):
        match = where.get(c, 0) >> row
        valid = inside >> (row + 1) & full
        before, below = 0, 0
        for e in range(edits + 1):
            old = level[e]
            new = old & match
            if e:
                # substitution keeps the diagonal, deletion moves one down it, insertion one up from the level below.
                new |= below | below >> 1 | before << 1
            new &= valid
            before, below = new, old
            level[e] = new
        if not level[edits]:
            return False
    return bool(level[edits] >> (len(b) - len(a) + edits) & 1)


def _cells(lines: Lines, own: np.ndarray) -> list[bytes]:
    lower = LOWER[lines.data].tobytes()
    return [lower[a:b] for a, b in zip(lines.start[own], lines.end[own], strict=True)]


def _pieces(column):
    data, off = buffers(column)
    for i, j in pieces(off):
        yield i, j, Lines(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _by_shard(keys: np.ndarray, shards: Shards, *columns: np.ndarray) -> pa.RecordBatch:
    """Cells of sorted keys and what belongs to them."""
    return cells(shard_of(keys, shards), shards, [keys, *columns])


def _owners(shards: Shards):
    """Of each distinct line of a gathering: hashes, first document and line there, and whether it occurs again."""

    def owners(batches):
        held, size = [], 0

        def flush():
            a, b, doc, line = (np.concatenate([x[k] for x in held]) if held else np.zeros(0, np.int64) for k in range(4))
            a, b = a.astype(np.uint64), b.astype(np.uint64)
            order = np.lexsort((line, doc, b, a))
            at = runs(a[order], b[order])
            n = np.diff(np.append(at, len(order)))
            own = order[at]
            return _by_shard(a[own], shards, b[own], doc[own], line[own], small(np.minimum(n, 2)))

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, lines in _pieces(batch.column("text")):
                held.append((*lines.hash, ids[i:j][lines.doc].astype(np.int64), lines.number))
                size += len(lines.doc)
                if size > GATHER // 4:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return owners


def _merge_owners(folder: str):
    def merge(key, table):
        parts = [unpacked(b) for b in table["data"].to_pylist()]
        a, b, doc, line, n = (np.concatenate([p[k] for p in parts]) for k in range(5))
        order = np.lexsort((line, doc, b, a))
        a, b, doc, line, n = (x[order] for x in (a, b, doc, line, n.astype(np.int64)))
        at = runs(a, b)
        total = np.add.reduceat(n, at)
        at = at[total > 1]
        name = pair(a[at], b[at])
        at = at[np.argsort(name)]
        write_sorted(folder, "owner", key[0].as_py(), key=np.sort(name), at=np.stack([doc[at], line[at]], 1), mark=np.ones(len(at), np.uint8))
        return pa.table({"n": pa.array([len(at)], pa.int64())})

    return merge


def _firsts(lines: Lines, ids: np.ndarray, owner: Sorted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document and line where each line first occurs, and whether that is here."""
    name = pair(*lines.hash)
    (at,) = owner.get(name, lines.hash[0])
    doc = ids[lines.doc].astype(np.int64)
    if at.ndim == 1:
        return doc, lines.number, np.ones(len(doc), bool)
    known = owner.hit
    first, line = np.where(known, at[:, 0], doc), np.where(known, at[:, 1], lines.number)
    return first, line, (first == doc) & (line == lines.number)


class Owners(Sorted):
    """Sorted, that also remembers which keys it had: an owner may be document 0, line 0."""

    def get(self, q, by=None):
        at, mark = super().get(q, by)
        self.hit = mark > 0
        return [at]


def _open_owners(folder: str, shards: int) -> Owners:
    return Owners(folder, "owner", shards, ("at", "mark"))


def _key_counts(folder: str, shards: Shards, least: int):
    def counts(batches):
        owner, held, size = _open_owners(folder, shards), [], 0

        def flush():
            k, n = totals(np.concatenate(held), np.ones(size, np.int64)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return _by_shard(k, shards, small(np.minimum(n, 2)))

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, lines in _pieces(batch.column("text")):
                _, _, here = _firsts(lines, ids[i:j], owner)
                held.append(line_keys(lines, np.flatnonzero(here & (lines.size >= least)), least=least)[1])
                size += len(held[-1])
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return counts


def _merge_keys(folder: str):
    def merge(key, table):
        parts = [unpacked(b) for b in table["data"].to_pylist()]
        k, n = totals(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        k = k[n > 1]
        write_sorted(folder, "key", key[0].as_py(), key=k, one=np.ones(len(k), np.uint8))
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    return merge


def _probe(folder: str, shards: Shards, least: int):
    """(key, name, line's bytes, document and number where it first stands) of lines that share a key with another line. A name is the mix of a line's two hashes."""

    def probe(batches):
        owner, shared = _open_owners(folder, shards), Sorted(folder, "key", shards, ("one",))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, lines in _pieces(batch.column("text")):
                doc, _, here = _firsts(lines, ids[i:j], owner)
                row, key = line_keys(lines, np.flatnonzero(here & (lines.size >= least)), least=least)
                own = shared.get(key)[0] > 0
                row, key = row[own], key[own]
                if len(row):
                    at, inverse = np.unique(row, return_inverse=True)
                    text = pa.array(_cells(lines, at), pa.binary()).take(pa.array(inverse))
                    name = pair(*lines.hash)[row]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), text, pa.array(doc[row]), pa.array(lines.number[row].astype(np.int64))], ["key", "name", "line", "doc", "number"])

    return probe


def _verify(key, table):
    """Links between the lines of a key, in a block or between two blocks; only those that join two components."""
    i, j = key[1].as_py(), key[2].as_py()
    names, lines, blk = table["name"].to_pylist(), table["line"].to_pylist(), table["blk"].to_pylist()
    order = sorted(range(len(names)), key=lambda x: (len(lines[x]), lines[x]))
    links, out = Links(len(names)), []
    for p, x in enumerate(order):
        for y in order[p + 1 :]:
            if len(lines[y]) - len(lines[x]) > EDITS:
                break
            if names[x] != names[y] and (i == j or blk[x] != blk[y]) and links.top(x) != links.top(y) and within(lines[x], lines[y]):
                links.join(x, y)
                out.append((names[x], names[y]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _write_names(folder: str, name: str, shards: int, columns: tuple[str, ...]):
    """Rows of one shard (key and columns) as sorted arrays."""

    def write(key, table):
        k = table["key"].to_numpy().view(np.uint64)
        order = np.argsort(k)
        values = {c: np.stack([table[x].to_numpy()[order] for x in c.split("_")], 1) if "_" in c else table[c].to_numpy()[order] for c in columns}
        write_sorted(folder, name, key[0].as_py(), key=k[order], **values)
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    return write


def _clean(folder: str, shards: int):
    """Of each document the numbers of its lines that stand elsewhere first, and the text of the others."""

    def clean(batches):
        owner, best = _open_owners(folder, shards), Sorted(folder, "best", shards, ("doc_line", "mark"))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            texts, n, drop = [], [], []
            for i, j, lines in _pieces(batch.column("text")):
                doc, line, here = _firsts(lines, ids[i:j], owner)
                at, mark = best.get(pair(*lines.hash))
                if at.ndim == 2:
                    own = ids[i:j][lines.doc].astype(np.int64)
                    better = (mark > 0) & ((at[:, 0] != own) | (at[:, 1] != lines.number))
                    here = np.where(mark > 0, ~better, here)
                cut = np.searchsorted(lines.doc, np.arange(j - i + 1))
                raw = lines.data.tobytes()
                for d in range(j - i):
                    s = slice(cut[d], cut[d + 1])
                    gone = ~here[s]
                    n.append(int(cut[d + 1] - cut[d]))
                    drop.append(lines.number[s][gone].tolist())
                    texts.append(None if not gone.any() else b"\n".join(raw[a:b] for a, b in zip(lines.raw[0][s][~gone], lines.raw[1][s][~gone], strict=True)).decode("utf-8", "replace"))
            fresh = pa.array(texts, pa.string())
            whole = batch.column("text").cast(pa.string())
            changed = pa.array([t is not None for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(drop, pa.list_(pa.int64())), pc.if_else(changed, fresh, whole), *(batch.column(c) for c in batch.schema.names[2:])], ["doc_id", "n_lines", "dropped", "text", *batch.schema.names[2:]])

    return clean


def dedup_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, dropped (numbers of lines, from 0), text (without them) and the columns `keep` (as kept_<name>) of every row.

    Lines stand between newlines, without white space around them, A-Z lower-cased; blank ones don't count.
    Lines of a class - equal ones, and, from `least` bytes on, those linked by chains of at most EDITS edits of bytes - are
    kept where the class first occurs (smallest document id, then line). Null text has no lines and stays null;
    rows with a null id are kept whole; rows that repeat an id and line both keep it; empty input gives no rows.

    Equal lines meet as hashes by shards. Distinct lines then send the hashes of their segments and of the
    substrings that segments of lines up to EDITS shorter could match; only lines that share such a key move,
    are verified by key (a key of many lines over pairs of blocks), and joined into components.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    real = rows.where("doc_id is not null").select("doc_id", "text")
    shards, folder = shard_number(text_bytes(real.select("text")), 28 << 20), new_folder(spark, "lines")
    grouped(real.mapInArrow(_owners(shards), CELL), shards).applyInArrow(_merge_owners(folder), "n long").agg(F.sum("n")).collect()
    grouped(real.mapInArrow(_key_counts(folder, shards, least), CELL), shards).applyInArrow(_merge_keys(folder), "n long").agg(F.sum("n")).collect()
    met = saved(real.mapInArrow(_probe(folder, shards, least), "key long, name long, line binary, doc long, number long"), "line-probes")
    sizes = met.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m"))
    blk = F.pmod(F.xxhash64("name"), F.col("m")).cast("int")
    spread = met.join(sizes, "key").select("key", "name", "line", blk.alias("blk"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("o"))
    spread = spread.select("key", "name", "line", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    links = saved(spread.groupBy("key", "i", "j").applyInArrow(_verify, "a long, b long"), "line-links")
    joined = components(links, "line-classes")
    placed = met.select("name", "doc", "number").distinct().join(joined, F.col("name") == F.col("node"))
    shard = F.expr(f"cast(shiftright(shiftrightunsigned(key, 32) * {int(shards)}L, 32) as int)")
    low = placed.groupBy("component").agg(F.min(F.struct("doc", "number")).alias("s"))
    best = placed.select("name", "component").join(low, "component").select(F.col("name").alias("key"), "s.doc", F.col("s.number").alias("line"), F.lit(1).cast("byte").alias("mark"))
    best.withColumn("shard", shard).repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(_write_names(folder, "best", shards, ("doc_line", "mark")), "n long").agg(F.sum("n")).collect()
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:])
    schema = f"doc_id long, n_lines long, dropped array<long>, text string{kept}"
    whole = rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("n_lines"), F.array().cast("array<long>").alias("dropped"), "text", *rows.columns[2:])
    return rows.where("doc_id is not null").mapInArrow(_clean(folder, shards), schema).unionByName(whole)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", F.length("text").cast("long").alias("kept_chars"))
