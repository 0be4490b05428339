"""Token counts through a cache keyed by digests of content and tokenizer."""

from __future__ import annotations

import base64
import hashlib
import importlib.metadata
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, ship

#: Texts of these characters alone are read alike by every edition of the Unicode tables.
USUAL = "[^\\t\\n\\r -~\\u00a1-\\u024f]"
SPECIAL = "<|endoftext|>"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + importlib.metadata.version("tokenizers").encode()).hexdigest()


def counter(path: str, ranks_path: str | None = None):
    """A function from a list of texts to token counts, as the tokenizers library gives them for the file at `path`.

    With the same vocabulary as ranks, usual texts go through the faster tiktoken, which gives the same
    counts; texts with any other character go through tokenizers itself.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    state: dict = {}

    def exact(texts: list[str]) -> list[int]:
        if "exact" not in state:
            state["exact"] = Tokenizer.from_file(path)
            state["exact"].no_truncation()
            state["exact"].no_padding()
        return [len(e.ids) for e in state["exact"].encode_batch(texts, add_special_tokens=False)]

    if not ranks_path:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    odd = re.compile(USUAL).search

    def count(texts: list[str]) -> list[int]:
        return [exact([t])[0] if odd(t) else len(fast.encode(t, allowed_special="all")) for t in texts]

    return count


def _encode(path: str, ranks_path: str | None):
    def encode(batches):
        count = None
        for b in batches:
            count = count or counter(path, ranks_path)
            n = [x for i in range(0, b.num_rows, 256) for x in count(b.column("text").slice(i, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encode


def token_counts(documents: DataFrame, path: str, cache: str, ranks_path: str | None = None, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; null text counts as empty.

    `cache` is a Parquet folder of (tokenizer, digest, n_tokens) that outlives the call. Contents are joined
    to it by SHA-256 digest, only distinct contents that it lacks are encoded, and those counts are appended.
    Repeated rows and ids each get a row; empty input gives no rows; other columns are ignored.

    Copies meet after a partial aggregation in each task, so a content that fills a third of the rows moves
    once a task. The digests of all rows then meet the counts in a join that adaptive execution can split.
    """
    spark = documents.sparkSession
    ship(spark)
    version = tokenizer_digest(path)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    known = cached(spark, cache, version)
    wanted = documents.select(digest.alias("digest"), content.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        wanted = wanted.join(known.select("digest"), "digest", "left_anti")
    wanted.mapInArrow(_encode(path, ranks_path), "digest binary, n_tokens long").withColumn("tokenizer", F.lit(version)).write.mode("append").option("compression", "zstd").partitionBy("tokenizer").parquet(cache)
    known = cached(spark, cache, version)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), digest.alias("digest"))
    if known is None:
        return rows.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("over_limit")).where("false")
    return rows.join(known, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """Counts of this tokenizer version, one for each digest even if two runs appended the same; None if nothing is stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/tokenizer={version}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={version}").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(documents, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
