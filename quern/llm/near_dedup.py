"""Near-duplicate documents by SetSketch registers, banded, estimated jointly by likelihood and verified on full sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .sharded import Shards, Sorted, shard_number, shard_of, write_sorted
from .shared import new_folder, saved, ship
from .text import batches_of_words, mix, shingle_sets

#: 32 bands of 5 registers: a pair of similarity 0.75 meets in none with probability 2e-4, one of 0.8 with 3e-6.
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Registers grow by one as the smallest value shrinks by BASE; RATE and the width keep them inside 16 bits.
BASE, RATE = 1.001, 20.0
SHINGLE, SIMILAR = 5, 75
#: Estimates this far below the similarity are over five standard deviations off.
DOUBT = 0.17
#: Sure members of a star leave its bucket; the rest of a bucket meet among themselves. By the triangle
#: inequality of Jaccard distance, a document similar to one that left is within SOFT of the star.
SURE, SOFT = 0.80, 0.38
#: Of a residual bucket that one task compares; a larger one is one candidate cluster as a whole.
RESIDUAL = 4096
#: Documents and shingles of one block in verification.
BLOCK_DOCS, BLOCK_SHINGLES = 1500, 2_000_000

_FACTORS = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes: floor(1 - log_BASE of the least exponential value)."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (_FACTORS[:, None] * high[None, i : i + 2048] + low[None, i : i + 2048]).min(1), out=least)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) hashes of each band's register values."""
    h = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(0xB5297A4D)), (len(regs), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + regs[:, r::ROWS].astype(np.uint64))
    return h


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sketches whose sets have na and nb elements.

    With u, v the shares of na, nb, a register is larger in a with probability p(u - v J), in b with p(v - u J),
    p(x) = -log_BASE(1 - x (BASE - 1) / BASE); the three counts are multinomial. The score falls in J; halving finds its zero.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    c, s = (BASE - 1) / BASE, 1 / np.log(BASE)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        j = (lo + hi) / 2
        x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
        p, q = -np.log1p(-c * x) * s, -np.log1p(-c * y) * s
        dp, dq = -v * c * s / (1 - c * x), -u * c * s / (1 - c * y)
        up = more * dp / np.maximum(p, 1e-12) + less * dq / np.maximum(q, 1e-12) - same * (dp + dq) / np.maximum(1 - p - q, 1e-12) > 0
        lo, hi = np.where(up, j, lo), np.where(up, hi, j)
    return (lo + hi) / 2


def _regs(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _sketch(batches):
    for b in batches:
        n, d1, d2, regs = [], [], [], []
        for _, _, _, _, w in batches_of_words(b.column("text")):
            for s in shingle_sets(w, SHINGLE):
                n.append(len(s))
                x, y = digests(s)
                d1.append(x)
                d2.append(y)
                regs.append(registers(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n", "d1", "d2", "regs"])


def _bands(batches):
    for b in batches:
        keys = band_keys(_regs(b.column("regs"))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("id").to_numpy(), BANDS))], ["key", "id"])


def _estimate(batches):
    for b in batches:
        j = joint_estimate(_regs(b.column("ra")), _regs(b.column("rb")), b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float)) if b.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j)], ["a", "b", "j"])


class Links:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def likely_pairs(regs: np.ndarray, n: np.ndarray, least: float, split: int = 0):
    """Pairs i < j (with split: i before it, j after) whose joint estimate is at least `least`, likeliest first."""
    out = []
    for i in range(len(regs) if not split else split):
        first = max(i + 1, split)
        same = (regs[first:] == regs[i]).sum(1)
        j = np.flatnonzero(same >= REGISTERS * (least - 0.1)) + first
        if len(j):
            e = joint_estimate(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), float(n[i])), n[j].astype(float))
            out.append(np.stack([np.full(len(j), i), j, e], 1)[e >= least])
    pairs = np.concatenate(out) if out else np.zeros((0, 3))
    return pairs[np.argsort(-pairs[:, 2], kind="stable")]


def _residual(key, table):
    ids = table["id"].to_numpy()
    links = Links(len(ids))
    found = [(ids[int(i)], ids[int(j)]) for i, j, _ in likely_pairs(_regs(table["regs"]), table["n"].to_numpy(), SIMILAR / 100 - DOUBT) if links.join(int(i), int(j))]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of a set that tell sets apart."""
    m = mix(shingles ^ np.uint64(0x1D8E4E27C47D124F))
    return int(np.bitwise_xor.reduce(m).view(np.int64)), int(m.sum(dtype=np.uint64).view(np.int64))


def _sets(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows whose text has the set of their class, one a class and side, in order of side, and the sets; ids that repeat bring other texts too."""
    table = table.sort_by([("side", "ascending"), ("id", "ascending")])
    sets = [s for _, _, _, _, w in batches_of_words(table["text"].combine_chunks()) for s in shingle_sets(w, SHINGLE)]
    own, seen = [], set()
    for k, (side, name, d1, d2) in enumerate(zip(*(table[c].to_pylist() for c in ("side", "id", "d1", "d2")), strict=True)):
        if (side, name) not in seen and digests(sets[k]) == (d1, d2):
            seen.add((side, name))
            own.append(k)
    return table.take(pa.array(own, pa.int64())), [sets[k] for k in own]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the similarity: 100 * intersection >= SIMILAR * union."""
    if 100 * min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILAR * (len(a) + len(b) - both)


def _pairs(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verify(key, table):
    """Links of one block, or of the rows of side 0 with those of side 1: confirmed on full shingle sets, and only those that join two components."""
    table, sets = _sets(table)
    ids, side = table["id"].to_numpy(), table["side"].to_numpy()
    split = int((side == 0).sum()) if (side == 1).any() else 0
    n = np.array([len(s) for s in sets])
    if len(ids) <= 12 and not split:
        pairs = [(x, y) for x in range(len(ids)) for y in range(x + 1, len(ids))]
    elif len(ids):
        pairs = [(int(x), int(y)) for x, y, _ in likely_pairs(np.stack([registers(s) for s in sets]), n, SIMILAR / 100 - DOUBT, split)]
    else:
        pairs = []
    links, out = Links(len(ids)), []
    for x, y in pairs:
        if links.top(x) != links.top(y) and ids[x] != ids[y] and similar(sets[x], sets[y]):
            links.join(x, y)
            out.append((int(ids[x]), int(ids[y])))
    return _pairs([x for x, _ in out], [y for _, y in out])


def _with_star(key, table):
    """Links of a block's rows (side 1) with their cluster's star (side 0)."""
    table, sets = _sets(table)
    ids, side = table["id"].to_numpy(), table["side"].to_numpy()
    star = int(np.flatnonzero(side == 0)[0])
    own = [k for k in np.flatnonzero(side == 1) if ids[k] != ids[star] and similar(sets[k], sets[star])]
    return _pairs([int(ids[k]) for k in own], [int(ids[star])] * len(own))


def candidate_edges(sketches: DataFrame) -> DataFrame:
    """Edges (a, b) whose components hold every pair of sketches (id, n, regs) that share a band and may be similar.

    Each bucket is a star about its smallest id. Members whose joint estimate makes them sure stay with the
    star and leave; the others keep an edge if it is above SOFT, and meet once more among themselves, bucket by
    bucket. Nothing emits all pairs of a group, and no partner is dropped.
    """
    bands = sketches.mapInArrow(_bands, "key long, id long")
    stars = bands.groupBy("key").agg(F.min("id").alias("star"), F.count("*").alias("size")).where("size > 1").drop("size")
    members = saved(bands.join(stars, "key").where("id <> star"), "near-members")
    of = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    pairs = members.select(F.col("id").alias("a"), F.col("star").alias("b")).distinct()
    tried = saved(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_estimate, "a long, b long, j double"), "near-tried")
    rest = members.join(tried.where(F.col("j") < SURE), (F.col("id") == F.col("a")) & (F.col("star") == F.col("b"))).select("key", "id")
    rest = saved(rest, "near-rest")
    sizes = rest.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low")).where("size > 1")
    large = rest.join(sizes.where(F.col("size") > RESIDUAL), "key").select(F.col("id").alias("a"), F.col("low").alias("b"))
    small = rest.join(sizes.where(F.col("size") <= RESIDUAL).select("key"), "key").join(sketches, "id").select("key", "id", "n", "regs")
    found = small.groupBy("key").applyInArrow(_residual, "a long, b long")
    return tried.where(F.col("j") >= SOFT).select("a", "b").unionByName(large).unionByName(found)


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: components of documents linked at similarity 0.75 or more.

    A document's set is its distinct runs of five words (lower-cased A-Z), with fewer words the whole sequence;
    without words or text it is empty and linked with nothing. Links have 100 * intersection >= 75 * union on
    full sets. component_id is the smallest id reachable, kept marks the document that has it. Rows that repeat
    an id are one node, linked with whatever one of its texts is similar to; null ids take no part and get a null component and kept = false; empty input gives no
    rows; other columns are ignored.

    Equal sets are one class from the start, so copies never pair up. Candidate clusters are verified where
    their texts meet, block by block.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = saved(rows.mapInArrow(_sketch, "doc_id long, n long, d1 long, d2 long, regs binary"), "near-sketches")
    some = sketches.where("n > 0 and doc_id is not null")
    # Numbers of classes are made once, in the saved table.
    classes = saved(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("low")).withColumn("id", F.monotonically_increasing_id()), "near-classes")
    named = saved(some.drop("regs").join(classes, ["d1", "d2", "n"]).select("doc_id", "n", "id"), "near-named")
    of = classes.select("id", "d1", "d2", "n", F.col("low").alias("doc_id"))
    distinct = saved(some.join(of, ["d1", "d2", "n", "doc_id"]).groupBy("id").agg(F.min(F.struct("n", "regs")).alias("s")).select("id", "s.n", "s.regs"), "near-distinct")
    clusters = components(candidate_edges(distinct), "near-clusters")
    links = _confirmed(rows, classes, clusters)
    # Rows that repeat an id with other texts link their classes.
    shared = named.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("most")).where("b <> most").drop("most")
    linked = components(links.unionByName(named.join(shared, "doc_id").select(F.col("id").alias("a"), "b")), "near-linked")
    grown = linked.join(classes, F.col("id") == F.col("node")).select("id", "component", "low")
    named_by = grown.join(grown.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("id", "component_id")
    found = named.join(classes.select("id", "low"), "id").join(named_by, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "low").alias("component_id"))
    rest = sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _by_hash(shards: Shards):
    def deal(batches):
        for b in batches:
            where = shard_of(mix(b.column("id").to_numpy().view(np.uint64)), shards)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), b.column("id")], ["shard", "id"])

    return deal


def _write_ids(folder: str):
    def write(key, table):
        h = np.sort(mix(table["id"].to_numpy().view(np.uint64)))
        write_sorted(folder, "id", key[0].as_py(), key=h, one=np.ones(len(h), np.uint8))
        return pa.table({"n": pa.array([len(h)], pa.int64())})

    return write


def _with_ids(folder: str, shards: Shards):
    def own(batches):
        known = Sorted(folder, "id", shards, ("one",))
        for b in batches:
            hit = known.get(mix(b.column("doc_id").fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64)))[0] > 0
            yield b.filter(pa.compute.and_(pa.array(hit), b.column("doc_id").is_valid()))

    return own


def _having(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (doc_id, text) whose id is among `ids`: a scan that maps sorted arrays of them, so no other text is shuffled."""
    spark = rows.sparkSession
    shards, folder = shard_number(8 * ids.count(), 1 << 20), new_folder(spark, "near-ids")
    dealt = ids.mapInArrow(_by_hash(shards), "shard int, id long").repartitionById(shards, F.col("shard"))
    dealt.groupBy("shard").applyInArrow(_write_ids(folder), "n long").agg(F.sum("n")).collect()
    return rows.mapInArrow(_with_ids(folder, shards), rows.schema)


def _confirmed(rows: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links (a, b) of classes that connect all similar pairs of each candidate cluster, verified on full texts.

    A cluster that fits a block is verified whole. Of a larger one every class first meets the star, the
    cluster's smallest class; those that are not similar to it meet all classes, block by block. So a family
    of near copies costs in proportion to its size, times the blocks of those that the star doesn't reach.
    """
    sized = saved(clusters.join(classes, F.col("id") == F.col("node")).select("component", "id", "n", "d1", "d2", "low"), "near-sized")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("m"), F.min("id").alias("star"))
    text_of = _having(rows, sized.select(F.col("low").alias("id")).distinct()).groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h")
    dealt = sized.join(blocks, "component").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    with_text = saved(dealt.join(text_of, F.col("low") == F.col("doc_id")).select("component", "m", "star", "blk", "id", "d1", "d2", "text"), "near-texts")
    schema, row = "a long, b long", ["id", "d1", "d2", "text"]
    small = with_text.where("m = 1").select("component", F.lit(0).alias("side"), *row).groupBy("component").applyInArrow(_verify, schema)
    large = with_text.where("m > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
    stars = large.where("id = star").select("component", every.alias("blk"), F.lit(0).alias("side"), *row)
    near = saved(stars.unionByName(large.select("component", "blk", F.lit(1).alias("side"), *row)).groupBy("component", "blk").applyInArrow(_with_star, schema), "near-stars")
    far = large.where("id <> star").join(near.select(F.col("a").alias("id")), "id", "left_anti")
    parts = far.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("r"))
    left = far.join(parts, "component").select("component", F.pmod(F.xxhash64("id", F.lit(1)), F.col("r")).cast("int").alias("i"), every.alias("j"), F.lit(0).alias("side"), *row)
    right = large.join(parts, "component").select("component", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), *row)
    met = left.unionByName(right).groupBy("component", "i", "j").applyInArrow(_verify, schema)
    return saved(small.unionByName(near).unionByName(met), "near-links")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Five-word sets by whole texts, their similarities by a join on shingles, and components by following links.
OP9_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM t),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept FROM s JOIN m USING (doc_id)
"""
