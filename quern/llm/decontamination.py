"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, ship
from .text import _powers, batches_of_words, grams, pair

#: Words of the shortest tile, the share of an item that tiles must cover, and the most bytes of benchmark that go to every task.
TILE, COVER, BROADCAST_BYTES = 5, 0.5, 32 << 20


def _sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(len(h) + 1)[0][: len(h)], out=out[1:])
    return out


def matches(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in item, place in doc and length of every maximal match of at least `least` words.

    Running Karp-Rabin hashes of `least` words give the seeds. A match starts at a seed whose words before
    differ, so of a word said a thousand times only the ends of the stretch pair up; its length is found by
    halving on the same hashes.
    """
    a, ia = grams(item, np.array([0, len(item)]), least)
    b, ib = grams(doc, np.array([0, len(doc)]), least)
    # Zero stands for what is before the first word, and is no word's hash here.
    before = lambda h, at: np.where(at > 0, np.maximum(h[np.maximum(at - 1, 0)], np.uint64(1)), np.uint64(0))
    pa_, pb = before(item, ia), before(doc, ib)
    order = np.lexsort((pa_, a))
    a, pa_, ia = a[order], pa_[order], ia[order]
    seeds, first = np.unique(a, return_index=True)
    cut = np.append(first, len(a))
    at = np.searchsorted(seeds, b)
    at[at == len(seeds)] = 0
    hit = np.flatnonzero(seeds[at] == b)
    ib, pb, lo, hi = ib[hit], pb[hit], cut[at[hit]], cut[at[hit] + 1]
    # In each seed's range those with the same word before are one range too; at the very beginning nothing is the same.
    rank, names = np.unique(np.concatenate([pa_, pb]), return_inverse=True)
    names = names.ravel()
    key = np.searchsorted(seeds, a).astype(np.int64) * len(rank) + names[: len(a)]
    own = at[hit].astype(np.int64) * len(rank) + names[len(a) :]
    skip, end = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
    end = np.where(pb == 0, skip, end)
    spans = [(lo, skip), (end, hi)]
    n = np.concatenate([y - x for x, y in spans])
    start = np.concatenate([x for x, _ in spans])
    j = np.repeat(np.tile(ib, 2), n)
    i = ia[np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    sa, sb, down = _sums(item), _sums(doc), _powers(max(len(item), len(doc)) + 1)[1]
    good, bad = np.full(len(i), least), np.minimum(len(item) - i, len(doc) - j) + 1
    while (bad - good > 1).any():
        mid = (good + bad) >> 1
        same = (sa[i + mid] - sa[i]) * down[i] == (sb[j + mid] - sb[j]) * down[j]
        good, bad = np.where(same, mid, good), np.where(same, bad, mid)
    return i, j, good


def tiles(item: np.ndarray, doc: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of non-overlapping matches, the longest marked first.

    Of the longest match whose words are unmarked on both sides all words are marked; of one that is partly
    marked, the unmarked stretches of at least `least` words try again. Ties go to the smaller places.
    """
    if min(len(item), len(doc)) < least:
        return []
    heap = [(-int(k), int(x), int(y)) for x, y, k in zip(*matches(item, doc, least), strict=True)]
    heapq.heapify(heap)
    left, right, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap and not left.all():
        k, x, y = heapq.heappop(heap)
        free = ~(left[x : x - k] | right[y : y - k])
        if free.all():
            left[x : x - k] = right[y : y - k] = True
            out.append((x, y, -k))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in edge.reshape(-1, 2):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), x + int(s), y + int(s)))
    return out


class Index:
    """The benchmark's items as word hashes, and their seeds in order of hash."""

    def __init__(self, ids: list, texts: list, least: int):
        self.items, self.least = [], least
        for i, j, _, _, w in batches_of_words(pa.array(texts, pa.string())):
            self.items += [(ids[i + d], w.hash[w.first[d] : w.first[d + 1]]) for d in range(j - i)]
        seeds = []
        for at, (_, h) in enumerate(self.items):
            # An item of fewer words is one seed of its own length.
            k = min(least, len(h))
            if k:
                g, _ = grams(h, np.array([0, len(h)]), k)
                seeds.append(np.stack([g, np.full(len(g), at, np.uint64), np.arange(len(g), dtype=np.uint64), np.full(len(g), k, np.uint64)]))
        self.hash, self.at, self.place, self.k = np.concatenate(seeds, 1) if seeds else np.zeros((4, 0), np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.at, self.place, self.k = (x[order] for x in (self.hash, self.at, self.place, self.k))
        self.lengths = sorted({int(k) for k in self.k})

    def candidates(self, w, n_docs: int, cover: float):
        """(document, item) pairs whose shared seeds could cover enough of the item."""
        docs, seeds = [], []
        for k in self.lengths:
            g, at = grams(w.hash, w.first, k)
            i = np.searchsorted(self.hash, g)
            i[i == len(self.hash)] = 0
            hit = np.flatnonzero(self.hash[i] == g)
            lo, hi = np.searchsorted(self.hash, g[hit], "left"), np.searchsorted(self.hash, g[hit], "right")
            n = hi - lo
            seeds.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            docs.append(np.repeat(np.searchsorted(w.first, at[hit], "right") - 1, n))
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.int64)
        doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        if not len(seed):
            return
        item = self.at[seed].astype(np.int64)
        key, inverse = np.unique(np.stack([doc, item], 1), axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")
        cut = np.searchsorted(inverse.ravel()[by], np.arange(len(key) + 1))
        for p, (d, at) in enumerate(key):
            own = seed[by[cut[p] : cut[p + 1]]]
            n = len(self.items[at][1])
            mark = np.zeros(n + 1, np.int64)
            k = min(self.least, n)
            places = np.unique(self.place[own].astype(np.int64))
            np.add.at(mark, places, 1)
            np.add.at(mark, np.minimum(places + k, n), -1)
            if (np.cumsum(mark)[:n] > 0).sum() >= cover * n:
                yield int(d), int(at)

    def found(self, w, n_docs: int, cover: float):
        """(document, item id, words, covered, tiles, first word in the document) of covered items."""
        for d, at in self.candidates(w, n_docs, cover):
            name, item = self.items[at]
            t = tiles(item, w.hash[w.first[d] : w.first[d + 1]], min(self.least, len(item)))
            covered = sum(k for _, _, k in t)
            if covered >= cover * len(item):
                yield d, name, len(item), covered, len(t), min(y for _, y, _ in t)


SCHEMA = "doc_id long, item_id long, item_words long, covered long, coverage double, tiles long, first_word long"


def _table(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 4 else pa.int64()) for i, c in enumerate(cols)], [x.split()[0] for x in SCHEMA.split(", ")])


def _scan(index, cover: float):
    def scan(batches):
        own = index.value
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for i, j, _, _, w in batches_of_words(b.column("text")):
                out += [(ids[i + d], name, n, c, c / n, t, y) for d, name, n, c, t, y in own.found(w, j - i, cover)]
            yield _table(out)

    return scan


def _item_seeds(least: int):
    """(item, seed, places, words, k) of each item's distinct seeds."""

    def seeds(batches):
        for b in batches:
            names, out = b.column("item").to_numpy(), []
            for i, j, _, _, w in batches_of_words(b.column("text")):
                for d in range(j - i):
                    h = w.hash[w.first[d] : w.first[d + 1]]
                    if k := min(least, len(h)):
                        g, n = np.unique(grams(h, np.array([0, len(h)]), k)[0], return_counts=True)
                        out.append(np.stack([np.full(len(g), names[i + d]), g.view(np.int64), n, np.full(len(g), len(h)), np.full(len(g), k)]))
            cols = np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["item", "seed", "places", "words", "k"])

    return seeds


def _document_seeds(least: int):
    """(doc, seed) of each text's distinct runs of 1 to `least` words, as items have such seeds."""

    def seeds(batches):
        for b in batches:
            names = b.column("doc").to_numpy()
            for i, j, _, _, w in batches_of_words(b.column("text")):
                for k in range(1, least + 1):
                    g, at = grams(w.hash, w.first, k)
                    d = np.searchsorted(w.first, at, "right") - 1
                    _, first = np.unique(pair(g, d.astype(np.uint64)), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names[i:j][d[first]]), pa.array(g[first].view(np.int64))], ["doc", "seed"])

    return seeds


def _tiled(cover: float, least: int):
    def tiled(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                own = Index([row.column("item")[0].as_py()], row.column("item_text").to_pylist(), least)
                for _, _, _, _, w in batches_of_words(row.column("text")):
                    out += [(row.column("doc")[0].as_py(), name, n, c, c / n, t, y) for _, name, n, c, t, y in own.found(w, 1, cover)]
            yield _table(out)

    return tiled


def _by_seeds(docs: DataFrame, items: DataFrame, cover: float, least: int) -> DataFrame:
    """The same rows as a scan with the whole index gives, for a benchmark of any size.

    Distinct texts stand for rows, which come back by their digests at the end, so ids may be null or repeat.
    A document that covers enough of an item shares at least `need` of its seeds' places. So of each item the
    seeds that most documents hold are left out as far as their places are fewer than that: whoever shares only
    those can't cover it, and the most frequent seeds never join. Texts move only for pairs that are left.
    """
    digest = lambda c: F.xxhash64(F.lit(11), c)
    docs, items = docs.where("text is not null").withColumn("doc", digest("text")), items.withColumn("item", digest("item_text"))
    held = saved(docs.groupBy("doc").agg(F.first("text").alias("text")).mapInArrow(_document_seeds(least), "doc long, seed long"), "tile-seeds")
    asked = saved(items.groupBy("item").agg(F.first("item_text").alias("text")).mapInArrow(_item_seeds(least), "item long, seed long, places long, words long, k long"), "tile-items")
    often = held.join(asked.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count("*").alias("docs"))
    w = Window.partitionBy("item").orderBy(F.desc("docs"), "seed")
    need = F.ceil(F.lit(cover) * F.col("words") / F.col("k"))
    rare = asked.join(often, "seed").withColumn("so_far", F.sum("places").over(w)).where(F.col("so_far") >= need)
    pairs = held.join(rare.select("seed", "item"), "seed").select("doc", "item").distinct()
    texts = docs.select("doc", "text").groupBy("doc").agg(F.first("text").alias("text"))
    met = pairs.join(items.groupBy("item").agg(F.first("item_text").alias("item_text")), "item").join(texts, "doc")
    found = met.select("doc", "text", "item", "item_text").mapInArrow(_tiled(cover, least), SCHEMA).withColumnsRenamed({"doc_id": "doc", "item_id": "item"})
    return docs.select("doc_id", "doc").join(found, "doc").join(items.select("item", "item_id"), "item").select(*[c.split()[0] for c in SCHEMA.split(", ")])


def contaminated(documents: DataFrame, benchmark: DataFrame, cover: float = COVER, least: int = TILE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, item_words, covered, coverage, tiles, first_word of documents whose tiles cover at least `cover` of an item.

    Tiles are matches of at least `least` words (lower-cased A-Z), in any order, so reordered passages count;
    an item of fewer words must occur whole. Null and empty texts and items match nothing; repeated rows give
    repeated pairs; null ids stay null; empty tables give no rows; other columns are ignored.

    The benchmark's index goes to every task only after its size has been checked; a larger one is joined by
    seeds, with the same result.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where("item_text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    if size > broadcast_bytes:
        return _by_seeds(docs, items, cover, least)
    rows = items.collect()
    index = spark.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], least))
    return docs.mapInArrow(_scan(index, cover), SCHEMA)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
