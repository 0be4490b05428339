"""Passages that repeat across documents, by sparse suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sharded import CELL, Shards, Sorted, cells, grouped, runs, shard_number, shard_of, small, totals, unpacked, write_sorted
from .shared import new_folder, saved, ship, text_bytes
from .text import batches_of_words, grams, pair

#: Words of the shortest passage, and of the runs whose hashes select suffixes. Any WINDOW runs in a row, so
#: any passage of LEAST words, have their smallest hash selected, in every document that holds them.
LEAST, RUN = 50, 20
WINDOW = LEAST - RUN + 1
#: Words kept on each side of a suffix's run: further than that, the next selected suffix carries on.
SIDE = WINDOW - 1
#: Hashes gathered before they are sent on, windows likewise, and rows compared at a time.
GATHER, GATHER_WINDOWS, CHUNK = 1_500_000, 600_000, 60_000
#: Rows of one run that a task compares by itself; a run that stands in more places is hot, and its windows are counted.
HOT = 1_000
ROW = "key long, right binary, left binary, doc_id long, pos int, hot boolean"
SPAN = "doc_id long, first_word int, end_word int, other_doc long"


def sliding(x: np.ndarray, n: int, fold: np.ufunc) -> np.ndarray:
    """fold over each n values in a row, by blocks: the end of one block and the start of the next."""
    if len(x) < n:
        return x[:0]
    pad = -len(x) % n
    y = np.concatenate([x, np.full(pad, x[-1], x.dtype)]).reshape(-1, n)
    ahead = fold.accumulate(y, axis=1).ravel()[: len(x)]
    back = fold.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()[: len(x)]
    return fold(back[: len(x) - n + 1], ahead[n - 1 :])


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of selected runs: the smallest of some WINDOW runs in one document.

    Where one word repeats, runs one word apart are equal. Of a stretch of those the first and the last WINDOW
    stay, and one in WINDOW between: a passage that takes in an end of the stretch meets its partner there, one
    from the middle at any of those, as their words to either side reach from one to the next.
    """
    g, at = grams(h, first, RUN)
    if not len(g):
        return g, at
    doc = np.searchsorted(first, at, "right") - 1
    g = np.maximum(g, np.uint64(1))
    low = sliding(g, WINDOW, np.minimum)
    low = np.where(doc[: len(low)] == doc[WINDOW - 1 :], low, np.uint64(0)) if len(low) else low
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)])
    chosen = (sliding(wide, WINDOW, np.maximum)[: len(g)] == g) if len(low) else np.zeros(len(g), bool)
    new = runs(g, doc)
    size = np.diff(np.append(new, len(g)))
    into = np.arange(len(g)) - np.repeat(new, size)
    middle = (into >= WINDOW) & (into < np.repeat(size, size) - WINDOW) & (into % WINDOW != 0)
    own = np.flatnonzero(chosen & ~middle)
    return g[own], at[own]


def _keys(shards: Shards, hot: int):
    def keys(batches):
        held, size = [], 0

        def flush():
            k, n = totals(np.concatenate(held), np.ones(size, np.int64)) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return cells(shard_of(k, shards), shards, [k, small(np.minimum(n, hot + 1))])

        for b in batches:
            for _, _, _, _, w in batches_of_words(b.column("text")):
                held.append(anchors(w.hash, w.first)[0])
                size += len(held[-1])
                if size > GATHER:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return keys


def _repeated(folder: str, hot: int):
    def repeated(key, table):
        parts = [unpacked(b) for b in table["data"].to_pylist()]
        k, n = totals(np.concatenate([p[0] for p in parts]), np.concatenate([p[1].astype(np.int64) for p in parts]))
        k, n = k[n > 1], n[n > 1]
        write_sorted(folder, "repeated", key[0].as_py(), key=k, kind=np.where(n > hot, 2, 1).astype(np.uint8))
        return pa.table({"n": pa.array([len(k)], pa.int64())})

    return repeated


def _suffixes(folder: str, shards: int):
    def suffixes(batches):
        seen = Sorted(folder, "repeated", shards, ("kind",))
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j, _, _, w in batches_of_words(b.column("text")):
                k, at = anchors(w.hash, w.first)
                kind = seen.get(k)[0]
                own = kind > 0
                k, at, hot = k[own], at[own], kind[own] > 1
                doc = np.searchsorted(w.first, at, "right") - 1
                # Zero stands for the document's end, and equals nothing.
                word = np.concatenate([np.maximum((w.hash >> np.uint64(32)).astype(np.uint32), 1), [np.uint32(0)]])
                side = lambda places, inside: np.ascontiguousarray(word[np.where(inside, places, len(word) - 1)]).tobytes()
                step = np.arange(SIDE)
                right, left = at[:, None] + RUN + step, at[:, None] - 1 - step
                size = 4 * SIDE
                r, l = side(right, right < w.first[doc + 1][:, None]), side(left, left >= w.first[doc][:, None])
                cells = lambda raw: pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(np.arange(0, size * len(k) + 1, size, dtype=np.int32).tobytes()), pa.py_buffer(raw)])
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), cells(r), cells(l), pa.array(ids[i:j][doc].astype(np.int64)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(hot)], ["key", "right", "left", "doc_id", "pos", "hot"])

    return suffixes


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that rows of sides have in common before they differ or a document ends."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


class Rows:
    def __init__(self, table: pa.Table):
        get = lambda c: table[c].to_numpy()
        self.key, self.doc, self.pos = get("key"), get("doc_id"), get("pos")
        self.sides = [np.frombuffer(b"".join(table[c].to_pylist()), np.uint32).reshape(-1, SIDE) for c in ("right", "left")]

    def spans(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        """doc, first, end, other document of both sides of the pairs of rows whose match is long enough."""
        own = (self.key[a] == self.key[b]) & (self.doc[a] != self.doc[b])
        a, b = a[own], b[own]
        right, left = (_common(s[a], s[b]) for s in self.sides)
        own = left + RUN + right >= LEAST
        a, b, right, left = a[own], b[own], right[own], left[own]
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        right, left = np.tile(right, 2), np.tile(left, 2)
        return [self.doc[x], self.pos[x] - left, self.pos[x] + RUN + right, self.doc[y]]

    def neighbours(self, order: np.ndarray) -> list[np.ndarray]:
        """Each run of one document's rows meets the rows of the runs before and after it."""
        key, doc = self.key[order], self.doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        run = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(order)) - 1
        at = np.arange(len(order))
        before = np.flatnonzero(run > 0)
        after = np.flatnonzero(run < len(start) - 1)
        a, b = np.concatenate([at[before], at[after]]), np.concatenate([end[run[before] - 1], start[run[after] + 1]])
        return self.spans(order[a], order[b])


def _span_batch(doc: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    kinds = zip((doc, first, end, other), (np.int64, np.int32, np.int32, np.int64), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x.astype(kind)) for x, kind in kinds], [x.split()[0] for x in SPAN.split(", ")])


def _distinct(found: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Spans of each document that overlap or adjoin as one, with the smallest other document."""
    doc, first, end, other = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    order = np.lexsort((first, doc))
    doc, first, end, other = (x[order] for x in (doc, first, end, other))
    # Documents one after the other on one line, so that a running maximum of ends never reaches into the next.
    at = runs(doc)
    base = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(doc)))) * (int(end.max(initial=0)) + 2)
    reach = np.maximum.accumulate(end + base) if len(end) else end
    new = np.ones(len(doc), bool)
    new[1:] = first[1:] + base[1:] > reach[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return [doc, first, end, other]
    last = np.append(at[1:], len(doc)) - 1
    return [doc[at], first[at], reach[last] - base[last], np.minimum.reduceat(other, at)]


def _compare(chunk: int):
    def compare(batches):
        """Spans of sorted rows, some whole runs at a time."""
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= chunk:
                key = held["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield _span_batch(*_distinct(_chunk(held.slice(0, cut))))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield _span_batch(*_distinct(_chunk(held)))

    return compare


def _windows(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each number of words before its run, the hash of the LEAST words that hold it there, and whether the document has them."""
    right, left = ([np.zeros(len(rows.key), np.uint64)] for _ in range(2))
    left[0] = rows.key.view(np.uint64)
    for sums, side in zip((right, left), rows.sides, strict=True):
        for k in range(SIDE):
            sums.append(pair(sums[-1], side[:, k].astype(np.uint64)))
    whole = [np.concatenate([np.ones((len(rows.key), 1), bool), side != 0], axis=1) for side in rows.sides]
    return np.stack([pair(left[k], right[SIDE - k]) for k in range(SIDE + 1)], 1), whole[1] & whole[0][:, ::-1]


def _two(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the two smallest documents of each; the same one twice where it is alone."""
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    own = runs(h, doc)
    h, doc = h[own], doc[own]
    at = runs(h)
    size = np.diff(np.append(at, len(h)))
    return h[at], doc[at], doc[at + (size > 1)]


def _documents_of_windows(shards: Shards):
    def documents(batches):
        held, size = [], 0

        def flush():
            h, low, high = _two(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return cells(shard_of(h, shards), shards, [h, low, high - low])

        for b in batches:
            rows = Rows(pa.Table.from_batches([b]))
            h, whole = _windows(rows)
            held.append((h[whole], np.repeat(rows.doc, whole.sum(1))))
            size += len(held[-1][0])
            if size > GATHER_WINDOWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return documents


def _shared_windows(folder: str):
    def shared(key, table):
        parts = [unpacked(b) for b in table["data"].to_pylist()]
        h, low, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        h, low, high = _two(np.tile(h, 2), np.concatenate([low, low + more]))
        own = low != high
        write_sorted(folder, "window", key[0].as_py(), key=h[own], low=low[own], high=high[own])
        return pa.table({"n": pa.array([int(own.sum())], pa.int64())})

    return shared


def _hot_spans(folder: str, shards: int):
    def spans(batches):
        seen = Sorted(folder, "window", shards, ("low", "high"))
        for b in batches:
            rows = Rows(pa.Table.from_batches([b]))
            h, whole = _windows(rows)
            low, high = (x.reshape(h.shape) for x in seen.get(h.ravel()))
            own = whole & (low != high)
            some = np.flatnonzero(own.any(1))
            own, doc, pos = own[some], rows.doc[some], rows.pos[some].astype(np.int64)
            other = np.where(low[some] == doc[:, None], high[some], low[some])
            # All windows of a row hold its run, so together they are one stretch.
            most, least = SIDE - own[:, ::-1].argmax(1), own.argmax(1)
            yield _span_batch(*_distinct([[doc, pos - most, pos - least + LEAST, np.where(own, other, np.iinfo(np.int64).max).min(1)]]))

    return spans


def _chunk(t: pa.Table) -> list[list[np.ndarray]]:
    """Spans of rows in suffix order: of neighbours, and where a run of three or more rows stands in different settings, of neighbours among those that agree on the words before it.

    A partner that shares few following words may share many words before the run, so for each number of
    words before, the rows that agree on them are looked at in suffix order by themselves: each row meets the
    partners with the longest match to the right for every length to the left.
    """
    rows = Rows(t)
    out = [rows.neighbours(np.arange(t.num_rows))]
    _, left = np.unique(rows.sides[1].astype(">u4").view(f"S{4 * SIDE}").ravel(), return_inverse=True)
    left = left.ravel()
    right = np.zeros(t.num_rows, np.int64)
    right[1:] = np.cumsum((rows.key[1:] != rows.key[:-1]) | (rows.sides[0][1:] != rows.sides[0][:-1]).any(1))
    key = np.cumsum(np.concatenate([[False], rows.key[1:] != rows.key[:-1]]))
    kinds = np.unique(np.stack([key, right, left]), axis=1)[0]
    # Two rows are neighbours anyway, and rows that agree in everything are each other's partners.
    own = np.flatnonzero((np.bincount(kinds, minlength=key[-1] + 1)[key] > 1) & (np.bincount(key)[key] > 2))
    if len(own):
        by = own[np.lexsort((left[own], key[own]))]
        agree = np.full(len(by), -1)
        agree[1:] = np.where(key[by[1:]] == key[by[:-1]], _common(rows.sides[1][by[1:]], rows.sides[1][by[:-1]]), -1)
        group = np.empty(t.num_rows, np.int64)
        for words in range(1, SIDE + 1):
            group[by] = np.cumsum(agree < words)
            out.append(rows.neighbours(own[np.argsort(group[own], kind="stable")]))
    return out


def repeated_passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, first_word, n_words, other_doc of every stretch of 50 words or more that another document repeats.

    Words are lower-cased A-Z runs without white space; overlapping and adjoining matches of a document are
    one stretch; other_doc is one document that holds a part of it (which one depends on how often its runs occur). Texts of fewer
    words, null and empty texts and null ids take no part; rows that repeat an id are one document; empty input
    gives no rows; other columns are ignored.

    Of all suffixes those at content-selected places remain, about one in 16. Their run hashes are merged by
    shards, and those that occur twice become sorted arrays that a second scan maps, so only suffixes with a
    partner move, each with SIDE words to either side. A run of up to `hot` suffixes is compared whole in one
    task, in the order of the words after it, for each length of agreement to the left. A run of more is in
    as many tasks as its rows are: all stretches of 50 words around it are hashed, the two smallest documents of each
    merge by shards, and those with two become sorted arrays that a scan of the suffixes maps.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = rows.select("text")
    shards, folder = shard_number(text_bytes(texts), 56 << 20), new_folder(spark, "suffix")
    grouped(texts.mapInArrow(_keys(shards, hot), CELL), shards).applyInArrow(_repeated(folder, hot), "n long").agg(F.sum("n")).collect()
    suffixes = saved(rows.mapInArrow(_suffixes(folder, shards), ROW), "suffixes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    every = suffixes.where("not hot").drop("hot").repartition(parts, "key").sortWithinPartitions("key", "right", "doc_id", "pos", "left").mapInArrow(_compare(chunk), SPAN)
    often = suffixes.where("hot").drop("hot")
    n_often = often.count()
    if n_often:
        cuts = shard_number(n_often * (SIDE + 1) * 24, 56 << 20)
        grouped(often.mapInArrow(_documents_of_windows(cuts), CELL), cuts).applyInArrow(_shared_windows(folder), "n long").agg(F.sum("n")).collect()
        every = every.unionByName(often.mapInArrow(_hot_spans(folder, cuts), SPAN))
    w = Window.partitionBy("doc_id").orderBy("first_word", "end_word")
    before = F.max("end_word").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", F.when(before >= F.col("first_word"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("first_word").alias("first_word"), (F.max("end_word") - F.min("first_word")).alias("n_words"), F.min("other_doc").alias("other_doc")).drop("island")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("first_word").cast("long").alias("first_word"), F.col("n_words").cast("long").alias("n_words"))


#: All stretches of 50 words, those that two documents hold, and the unions of those that overlap or adjoin.
OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 48), lambda i: {'p': i - 1, 'h': md5(array_to_string(w[i:i + 49], ' '))})) AS g
  FROM t WHERE len(w) >= 50),
h AS (SELECT DISTINCT doc_id, g.p AS p, g.h AS h FROM g),
c AS (SELECT doc_id, p FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
n AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM n)
SELECT doc_id, min(p)::BIGINT AS first_word, (max(p) + 50 - min(p))::BIGINT AS n_words FROM i GROUP BY doc_id, island
"""
