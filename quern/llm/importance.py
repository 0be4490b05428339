"""Importance resampling towards a target: hashed features counted by a vectorised byte automaton, weights, and a Gumbel top-k draw."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, ship
from .text import LOWER, bounds, buffers, pieces

BUCKETS, LONGEST, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024
#: Classes of bytes after lower-casing: digits, a-z and all of other characters are in words.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Steps of the automaton that all words take together; what is longer goes on one by one.
STEPS = 48


def crc_table() -> np.ndarray:
    """The transitions of CRC-32 by one byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


TABLE = crc_table()


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The automaton's states after reading data[start:end] of each row, all rows byte by byte at once."""
    n = np.minimum(end - start, STEPS + 1).astype(np.int16)
    order = np.argsort(-n, kind="stable")
    reach = np.searchsorted(-n[order], -np.arange(STEPS, dtype=np.int16), "left")
    s, at = state[order], start[order]
    for p, m in enumerate(reach.tolist()):
        if not m:
            break
        s[:m] = TABLE[(s[:m] ^ data[at[:m] + p]) & np.uint32(255)] ^ (s[:m] >> np.uint32(8))
    out = np.empty_like(s)
    out[order] = s
    for k in np.flatnonzero(n > STEPS):
        out[k] = zlib.crc32(data[start[k] + STEPS : end[k]], int(~out[k])) ^ 0xFFFFFFFF
    return out


def features(column: pa.Array, longest: int = LONGEST):
    """(first row, end row, CRCs of all runs of 1 to `longest` words, the row of each, words of each row) of pieces of a column."""
    data, off = buffers(column)
    for i, j in pieces(off):
        part, own = LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i]
        start, end = bounds(part, own, BETWEEN)
        n = np.diff(np.searchsorted(start, own))
        doc = np.repeat(np.arange(j - i), n)
        state, crcs, docs = np.full(len(start), 0xFFFFFFFF, np.uint32), [], []
        for k in range(longest):
            if k:
                inside = np.flatnonzero(doc[k:] == doc[: max(0, len(doc) - k)])
                state = advance(TABLE[(state[inside] ^ np.uint32(0x20)) & np.uint32(255)] ^ (state[inside] >> np.uint32(8)), part, start[inside + k], end[inside + k])
                # Runs keep the place of their first word.
                full = np.zeros(max(0, len(doc) - k), np.uint32)
                full[inside] = state
                state, rows = full, inside
            else:
                state, rows = advance(state, part, start, end), np.arange(len(doc))
            crcs.append(~state[rows])
            docs.append(doc[rows])
        yield i, j, np.concatenate(crcs), np.concatenate(docs), n


def _count(buckets: int, longest: int):
    def scan(batches):
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, crcs, _, _ in features(b.column("text"), longest):
                counts += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own])], ["bucket", "n"])

    return scan


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of a column `text` by bucket; each task sends its sums, the driver gets a number for each bucket."""
    ship(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(_count(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the smoothed log ratio of target to raw in each bucket, floored."""
    s, t, b = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _weigh(gain: np.ndarray, longest: int):
    def scan(batches):
        for b in batches:
            n, total, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, j, crcs, doc, own in features(b.column("text"), longest):
                n[i:j] = np.bincount(doc, minlength=j - i)
                # Sums of whole numbers below 2 ** 53 are exact.
                total[i:j] = np.bincount(doc, gain[crcs % np.uint32(len(gain))], j - i).astype(np.int64)
                words[i:j] = own
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], ["doc_id", "n_words", "n_features", "weight"])

    return scan


def resample(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, share: int = SHARE, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row: `share` in a hundred of those with `least_words` words are drawn, by weight and Gumbel noise.

    Words are runs of digits, a-z (A-Z lower-cased) and other than ASCII characters; features the runs of 1 to
    `longest` words, joined by one space. A feature's bucket is its CRC-32 modulo `buckets`, a bucket's gain floor(1000 *
    log ratio) of its smoothed shares of target and documents; weight is the floored mean of a row's gains (0
    without features). Noise follows the SHA-256 of seed and id, so reruns agree. The highest scores are
    ranked, ties by smaller id, then fewer features, then smaller weight; rank is null where not drawn.

    Null texts have no words. Rows that repeat an id are rows like others. A null id has a null score and is
    not drawn nor counted among those drawn from, but its features count. Empty input gives no rows; an empty target
    has zero counts; other columns are ignored.

    Scores are whole numbers between about -40,000 and 60,000 at every size (logarithms of counts), so the
    driver gets at most so many of their counts; ties of one score are ranked in a task each.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(rows.select("text"), buckets, longest), bucket_counts(target.select(F.col(target_text).alias("text")), buckets, longest))
    weighed = rows.mapInArrow(_weigh(gain, longest), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = saved(weighed.withColumn("score", score), "importance-scored")
    may = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    counts = sorted(((r.score, r.n) for r in scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn, above, bases = share * sum(n for _, n in counts) // 100, 0, []
    for s, n in counts:
        if above >= drawn:
            break
        bases.append((s, above))
        above += n
    out = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not bases:
        return scored.select(*out, none)
    least = bases[-1][0]
    chosen = may & (F.col("score") >= least)
    base = spark.createDataFrame(bases, "score long, above long")
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    rank = (F.col("above") + F.row_number().over(within)).cast("long")
    ranked = scored.where(chosen).join(F.broadcast(base), "score").withColumn("rank", rank).select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(chosen, F.lit(False))).select(*out, none))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 by its table over the bytes of each different word; the draw by one window.
OP12_SQL = r"""
WITH crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) r(i)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
u AS (SELECT doc_id, unnest(w) AS x FROM d),
v AS (SELECT DISTINCT x FROM (SELECT x FROM u UNION ALL SELECT x FROM e)),
b AS (
  SELECT x, xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(hex(x)) + 1, 2), lambda i: ('0x' || hex(x)[i:i + 1])::BIGINT)),
    lambda c, y: xor(t[xor(c, y) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM v, crc),
s AS (SELECT bucket, count(*) AS s FROM u JOIN b USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM e JOIN b USING (x) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM u JOIN b USING (x) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN m USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20),
n AS (SELECT 10 * count(*) // 100 AS n FROM k)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT n FROM n) THEN rank END::BIGINT AS rank FROM r LEFT JOIN k USING (doc_id)
"""
