"""Exact top-k search by sorted lists without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sharded import Sorted, write_sorted
from .shared import new_folder, ship

#: Candidates and queries in one block; a block's bounds take about 8 bytes times their product, five times.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 256
#: Shares of each list that have been read when the bounds are looked at.
DEPTHS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0)


def nra_top_k(x: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """The k largest inner products of each query with the rows of x and all rows tied with the k-th, as (rows, scores); and how many list entries were read, for all queries.

    Each component's values are a sorted list; a query reads it from the end where its own component makes
    the product large, each entry once. After each share of the lists, a row's score lies between what was
    read plus the smallest, and plus the last, values that its unread lists can still give. A query stops when
    at most the rows above the k-th lower bound can qualify; their scores are then resolved in full.
    """
    n, d = x.shape
    if not n:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries], 0
    k = min(k, n)
    largest = d * max(1, int(np.abs(x).max(initial=0))) * int(np.abs(queries).max(initial=0))
    if largest >= 2**63:
        raise OverflowError(f"scores of up to {largest} are beyond 64 bits; use a smaller scale")
    if largest >= 2**53:
        # Bounds would be rounded: every list is read to its end, in whole numbers.
        out = []
        for q in queries:
            score = x @ q
            keep = score >= np.partition(score, n - k)[n - k]
            out.append((np.flatnonzero(keep), score[keep]))
        return out, n * d * len(queries)
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), 0)
    # Sums of whole numbers below 2 ** 24 are exact in half the width.
    narrow = largest < 2**24
    kind = np.float32 if narrow else np.float64
    lists = np.take_along_axis(x, order, 0).astype(kind)
    out: list = [None] * len(queries)
    live, was, reads = np.arange(len(queries)), 0, 0
    whole = x.astype(kind)
    for depth in DEPTHS:
        r = max(1, int(np.ceil(n * depth)))
        up, down = np.maximum(queries[live], 0).astype(kind), np.minimum(queries[live], 0).astype(kind)
        reads += (r - was) * d * len(live)
        was = r
        if r < n:
            top, bottom = rank >= n - r, rank < r
            # What a list has given where it was read, what it can still give elsewhere: as products, exact in whole numbers.
            most = np.where(top, whole, lists[n - r]) @ up.T + np.where(bottom, whole, lists[r - 1]) @ down.T
            least = np.where(top, whole, lists[0]) @ up.T + np.where(bottom, whole, lists[-1]) @ down.T
            can = most >= np.partition(least, n - k, axis=0)[n - k]
            done = can.sum(0) <= 8 * k
        else:
            read = whole @ (up + down).T
            can = read >= np.partition(read, n - k, axis=0)[n - k]
            done = np.ones(len(live), bool)
        for q in np.flatnonzero(done):
            rows = np.flatnonzero(can[:, q])
            score = x[rows] @ queries[live[q]]
            kth = np.partition(score, len(rows) - k)[len(rows) - k]
            keep = score >= kth
            out[live[q]] = rows[keep], score[keep]
        live = live[~done]
        if not len(live):
            break
    return out, reads


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of integers; shorter ones are filled with zeros, which add nothing to a product."""
    out = np.zeros((len(column), d), np.int64)
    flat = column.combine_chunks()
    n = np.diff(flat.offsets.to_numpy())
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = flat.flatten().to_numpy()
    return out


def _write_queries(folder: str):
    def write(key, table):
        v = _matrix(table["v"], max([0, *np.diff(table["v"].combine_chunks().offsets.to_numpy())]))
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        write_sorted(folder, "ask", key[0].as_py(), key=table["id"].to_numpy()[order], v=v[order])
        return pa.table({"n": pa.array([len(v)], pa.int64())})

    return write


def _wide(v: np.ndarray, d: int) -> np.ndarray:
    return v if v.shape[1] == d else np.concatenate([v, np.zeros((len(v), d - v.shape[1]), v.dtype)], 1)


def _search(folder: str, blocks: int, k: int):
    """The best rows of each candidate block for every query of a group; queries are mapped from their files, block by block."""

    def search(batches):
        asks, held, size = Sorted(folder, "ask", blocks, ("v",)), [], 0

        def found():
            table = pa.concat_tables(held)
            part, groups = table["part"][0].as_py(), table["groups"][0].as_py()
            ids = table["id"].to_numpy()
            v = _matrix(table["v"], max([0, *np.diff(table["v"].combine_chunks().offsets.to_numpy())]))
            by_id = np.argsort(ids, kind="stable")
            ids, v = ids[by_id], v[by_id]
            # Equal vectors are one row of the lists; of each, the k + 1 smallest ids can appear (one may be the query's own).
            x, inverse = np.unique(v, axis=0, return_inverse=True)
            by = np.argsort(inverse.ravel(), kind="stable")
            cut = np.searchsorted(inverse.ravel()[by], np.arange(len(x) + 1))
            for q in range(part, blocks, groups):
                own = asks.shard(q)
                if own is None:
                    continue
                d, out = max(x.shape[1], own["v"].shape[1]), [[], [], []]
                for ask, (rows, scores) in zip(own["key"].tolist(), nra_top_k(_wide(x, d), _wide(own["v"], d), k + 1)[0], strict=True):
                    best = sorted((-int(s), int(i)) for row, s in zip(rows, scores, strict=True) for i in ids[by[cut[row] : min(cut[row + 1], cut[row] + k + 1)]] if i != ask)[:k]
                    out[0] += [ask] * len(best)
                    out[1] += [i for _, i in best]
                    out[2] += [-s for s, _ in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

        for b in batches:
            for at in range(0, b.num_rows, CANDIDATE_BLOCK):
                t = pa.Table.from_batches([b.slice(at, CANDIDATE_BLOCK)])
                if held and size + t.num_rows > CANDIDATE_BLOCK:
                    yield from found()
                    held, size = [], 0
                held.append(t)
                size += t.num_rows
        if size:
            yield from found()

    return search


def top_k(vectors: DataFrame, asks, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows of each row that the Column `asks` marks.

    Components become floor(scale * x); scores are integer inner products, ties go to the smaller id. Null
    vectors, vectors with null or non-finite components and null ids take no part; of rows that repeat an id
    each counts; shorter vectors are filled with zeros; empty input gives no rows; other columns are ignored. Scores that
    64 bits cannot hold fail the query; beyond 53 bits, where bounds would be rounded, lists are read whole.

    Queries are written in blocks to the shared folder, as sorted arrays that tasks map one at a time. Each
    candidate is scanned once, or by a few groups of query blocks where the table has fewer blocks than the
    cluster has cores; only k rows a query and candidate block go on: exact at every size, since a row among
    the k best of all is among those of its block.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(embedding)
    finite = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & finite).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), asks.alias("ask"))
    n, m = rows.select(F.count("*"), F.count(F.when(F.col("ask"), 1))).first()
    c, q, folder = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK)), new_folder(spark, "asks")
    block = F.pmod(F.xxhash64("id"), F.lit(q)).cast("int").alias("block")
    rows.where("ask").select(block, "id", "v").repartitionById(q, F.col("block")).groupBy("block").applyInArrow(_write_queries(folder), "n long").agg(F.sum("n")).collect()
    groups = max(1, min(q, spark.sparkContext.defaultParallelism // c))
    dealt = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(groups).alias("groups"))
    place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(c)).cast("int") * groups + F.col("part")
    near = dealt.repartitionById(c * groups, place).mapInArrow(_search(folder, q, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= 5
"""
