"""A training-data pipeline over `documents`: toxic documents, repeated lines, near copies and benchmark leaks go, then sources are mixed.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontamination import contaminated
from quern.llm.line_dedup import dedup_lines
from quern.llm.lm_scoring import crc_is
from quern.llm.mixing import mix
from quern.llm.near_dedup import near_duplicates
from quern.llm.shared import saved
from quern.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not predict as toxic, with or without an id; labels with crc32(doc_id) mod 3 = 1 are never learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = [c for c in docs.columns if c != "doc_id"]
    clean = toxicity(docs, labels, crc_is("doc_id", 3, 1), keep=tuple(own)).where("predicted = 0")
    return clean.select(*[F.col(f"kept_{c}").alias(c) if c in own else c for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line class stays where it first occurs; a document whose every line stood elsewhere first goes; documents without an id stay whole."""
    own = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = dedup_lines(docs, keep=own).where("n_lines is null or n_lines = 0 or size(dropped) < n_lines")
    named = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")} | {c: F.col(f"kept_{c}") for c in own}
    return left.select(*[named[c].alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays; documents without an id stay."""
    gone = near_duplicates(docs).where("doc_id is not null and not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold enough of a benchmark item, in any order, go, those without an id too: texts are told apart by their digests."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    digest = F.xxhash64(F.lit(8), "text")
    held = contaminated(docs.select(digest.alias("digest"), "text"), items, doc_id="digest").select(F.col("doc_id").alias("digest")).distinct()
    marked = docs.select(F.struct(*docs.columns).alias("row"), digest.alias("digest"))
    return marked.join(held, "digest", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies, words taken and their source's target; null and repeated ids are rows like others."""
    own = [c for c in docs.columns if c != "doc_id"]
    taken = mix(docs, keep=tuple(own)).where("copies > 0")
    mixed = [F.col(c).alias(f"mix_{c}" if c in own else c) for c in ("size", "source_size", "target", "copies", "taken")]
    return taken.select(*[F.col(f"kept_{c}").alias(c) if c in own else c for c in docs.columns], *mixed)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]
#: Edit joins, components and balanced sampling are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # Written and read again: no later action repeats a stage.
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
