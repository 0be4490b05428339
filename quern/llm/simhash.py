"""SimHash near-duplicates by pivot distance tables: fingerprints, their Hamming distances to many reference fingerprints, and links verified.

References are a staircase (the first j bits set, j from 0 to 64) and random fingerprints. From step to step of
the staircase a fingerprint's distance falls by one where its bit is set and rises by one where it isn't, so
the steps of a segment of bits tell what the fingerprint has there. Two fingerprints at three or fewer bits
agree in all but three segments at most: rows meet that have the same steps in so many segments, are
discarded where the distances to any reference are more than three apart, and what survives is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import saved, ship
from .sharded import runs
from .text import LOWER, SPACE, Words, batches_of_words, mix, pair

SHINGLE, SEED, BITS = 3, 42, 3
REFERENCES = np.concatenate([np.array([(1 << j) - 1 for j in range(65)], np.uint64), mix(np.arange(1, 32, dtype=np.uint64))])
#: Random references first, as they discard most.
_ORDER = np.r_[65:96, 64, 32, 16, 48, 8, 24, 40, 56]
#: Fingerprints of a bucket that one task compares; a larger one is compared block by block.
BLOCK = 4096
#: Segments that fingerprints are cut into, at least and at most, and fingerprints that a bucket should have.
SEGMENTS, USUAL = (4, 8), 8
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15


def plain(data: np.ndarray, w: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a piece of text lower-cased with one space after each, and where each starts and ends."""
    n = w.end - w.start
    end = np.cumsum(n + 1) - 1
    out = np.full(int(n.sum()) + len(n), 0x20, np.uint8)
    out[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = LOWER[data[~SPACE[data]]]
    return out.tobytes(), end - n, end


def shingle_places(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every run of k words, repeats included, and its document; fewer words are one run."""
    n = np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + first[doc]
    return at, at + np.minimum(n, k)[doc] - 1, doc


def fingerprints(column: pa.Array, k: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints of texts: a bit is set where over half of the shingles' hashes have it; without words zero."""
    out = np.zeros(len(column), np.uint64)
    for i, j, data, _, w in batches_of_words(column):
        text, start, end = plain(data, w)
        first, last, doc = shingle_places(w.first, k)
        h = np.fromiter((xxhash.xxh64_intdigest(text[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)), np.uint64, len(first))
        set_bits = np.zeros((j - i, 64), np.int64)
        for at in range(0, len(h), COUNTED):
            own = doc[at : at + COUNTED]
            cut = runs(own)
            bits = np.unpackbits(h[at : at + COUNTED].view(np.uint8), bitorder="little").reshape(-1, 64)
            set_bits[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
        over = 2 * set_bits > np.bincount(doc, minlength=j - i)[:, None]
        out[i:j] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def distances(prints: np.ndarray) -> np.ndarray:
    """The table of Hamming distances to the references, a row a fingerprint."""
    return np.bitwise_count(prints[:, None] ^ REFERENCES)


def segments_for(n: int) -> int:
    """Segments for n fingerprints: the fewest with which a bucket of spread fingerprints has about USUAL rows."""
    return next((b for b in range(*SEGMENTS) if n <= USUAL * 2.0 ** (64 * (b - BITS) / b)), SEGMENTS[1])


def bucket_keys(table: np.ndarray, segments: int, bits: int = BITS) -> np.ndarray:
    """(rows, choices) keys: for each choice of all but `bits` segments a hash of the steps of the distances inside them."""
    cut = np.linspace(0, 64, segments + 1).astype(int)
    own = np.zeros((segments, len(table)), np.uint64)
    for s in range(segments):
        for c in range(cut[s] + 1, cut[s + 1] + 1):
            own[s] = own[s] * np.uint64(0x9E3779B97F4A7C15) + (table[:, c].astype(np.int64) - table[:, cut[s]]).astype(np.uint64)
    out = []
    for number, chosen in enumerate(combinations(range(segments), segments - bits)):
        h = np.full(len(table), number + 1, np.uint64)
        for s in chosen:
            h = pair(h, own[s])
        out.append(h)
    return np.stack(out, 1)


def near(table: np.ndarray, prints: np.ndarray, i: np.ndarray, j: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of the pairs (i, j) link: those with a coordinate too far apart are discarded, the survivors verified."""
    left = np.arange(len(i))
    for at in range(0, len(_ORDER), 8):
        c = _ORDER[at : at + 8]
        apart = np.abs(table[np.ix_(i[left], c)].astype(np.int8) - table[np.ix_(j[left], c)].astype(np.int8)).max(1, initial=0)
        left = left[apart <= bits]
        if not len(left):
            break
    return left[np.bitwise_count(prints[i[left]] ^ prints[j[left]]) <= bits]


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of each a and b: up gives every place its tree's smallest."""
    while True:
        x, y = up[a], up[b]
        other = x != y
        if not other.any():
            return
        np.minimum.at(up, np.maximum(x, y)[other], np.minimum(x, y)[other])
        while (up != up[up]).any():
            up[:] = up[up]


def _tree(prints: np.ndarray, up: np.ndarray) -> pa.RecordBatch:
    own = np.flatnonzero(up != np.arange(len(up)))
    return pa.RecordBatch.from_arrays([pa.array(prints[own].view(np.int64)), pa.array(prints[up[own]].view(np.int64))], ["a", "b"])


def linked_in_runs(key: np.ndarray, prints: np.ndarray, bits: int = BITS) -> pa.RecordBatch:
    """Links that connect what is near inside each run of equal keys; rows already connected are not compared."""
    table = distances(prints)
    order = np.lexsort((table[:, 65], key))
    key, prints, table = key[order], prints[order], table[order]
    place, up, i, o = table[:, 65].astype(np.int64), np.arange(len(key)), np.arange(len(key)), 0
    while True:
        o += 1
        i = i[i < len(key) - o]
        i = i[(key[i] == key[i + o]) & (place[i + o] - place[i] <= bits)]
        if not len(i):
            return _tree(prints, up)
        a = i[up[i] != up[i + o]]
        a = a[near(table, prints, a, a + o, bits)]
        if len(a):
            unite(up, a, a + o)


def _runs(bits: int):
    """Over rows in order of key; a run that goes on in the next batch waits for it."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            if key[0] == key[-1]:
                held.append(b)
                continue
            last = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
            yield found(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = [b.slice(last)]
        if held:
            yield found(pa.Table.from_batches(held))

    def found(t: pa.Table) -> pa.RecordBatch:
        return linked_in_runs(t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64), bits)

    return run


def _blocks(bits: int):
    """Links of one block's rows (side 0) with another's (side 1) of the same bucket."""

    def met(key, rows):
        p, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        table, up = distances(p), np.arange(len(p))
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        second = second[np.argsort(table[second, 65], kind="stable")]
        place = table[second, 65].astype(np.int64)
        for x in first:
            lo, hi = np.searchsorted(place, [int(table[x, 65]) - bits, int(table[x, 65]) + bits + 1])
            j = second[lo:hi]
            j = j[up[j] != up[x]]
            j = j[near(table, p, np.full(len(j), x), j, bits)]
            if len(j):
                unite(up, np.full(len(j), x), j)
        return pa.Table.from_batches([_tree(p, up)])

    return met


def _prints(k: int, seed: int):
    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(b.column("text"), k, seed).view(np.int64))], ["doc_id", "fp"])

    return scan


def _keys(segments: int, bits: int):
    def scan(batches):
        for b in batches:
            keys = bucket_keys(distances(b.column("fp").to_numpy().view(np.uint64)), segments, bits)
            many = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column("fp").to_numpy(), many)), pa.array(np.repeat(b.column("n").to_numpy(), many))], ["key", "fp", "n"])

    return scan


def links(classes: DataFrame, bits: int = BITS, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """(a, b) of fingerprints whose components hold every two of classes (fp, n: rows that have it) at `bits` or fewer bits.

    A bucket is compared in one task if it has at most `block` rows. In a larger one the fingerprint of most rows is the
    star: who is near it is linked to it, and only the others meet the bucket's rows, block by block.
    """
    segments = segments or segments_for(classes.count())
    keyed = classes.mapInArrow(_keys(segments, bits), "key long, fp long, n long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("n", "fp")).alias("star")).where("size > 1")
    met = saved(keyed.join(sizes, "key").select("key", "fp", "size", F.col("star.fp").alias("star")), "simhash-met")
    small = met.where(F.col("size") <= block).select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_runs(bits), "a long, b long")
    large = met.where(F.col("size") > block).withColumn("m", F.ceil(F.col("size") / block).cast("int"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("star"))) <= bits
    starred = large.where(close & (F.col("fp") != F.col("star"))).select(F.col("fp").alias("a"), F.col("star").alias("b"))
    far = large.where(~close)
    parts = far.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("r"))
    part = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = far.join(parts, "key").select("key", part("r", 1).alias("i"), each("m").alias("j"), F.lit(0).alias("side"), "fp")
    right = large.join(parts, "key").select("key", each("r").alias("i"), part("m", 2).alias("j"), F.lit(1).alias("side"), "fp")
    others = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_blocks(bits), "a long, b long")
    return small.unionByName(starred).unionByName(others).distinct()


def simhash_duplicates(documents: DataFrame, k: int = SHINGLE, bits: int = BITS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id of every row: components of fingerprints linked at `bits` or fewer differing bits.

    Shingles are the runs of k words (lower-cased A-Z), repeats included; fewer words are one shingle. A text that is null or
    has no words has fingerprint zero and links like any other. component_id is the smallest id reachable, its own included. Rows
    that repeat an id are one node, linked through each of its texts. A null id gets its fingerprint and a null
    component and links nothing; empty input gives no rows; other columns are ignored.

    Equal fingerprints are one class from the start, so copies never pair up.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = saved(rows.mapInArrow(_prints(k, seed), "doc_id long, fp long"), "simhash-prints")
    some = prints.where("doc_id is not null")
    classes = saved(some.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "simhash-classes")
    # Rows that repeat an id with other texts link their classes.
    again = some.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b <> most").drop("most")
    edges = links(classes.select("fp", "n"), bits).unionByName(some.join(again, "doc_id").select(F.col("fp").alias("a"), "b"))
    grown = components(edges, "simhash-linked").join(classes, F.col("fp") == F.col("node")).select("fp", "component", "low")
    lows = grown.join(grown.groupBy("component").agg(F.min("low").alias("lowest")), "component").select("fp", "lowest")
    named = classes.join(lows, "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    found = some.join(named, "fp").unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
