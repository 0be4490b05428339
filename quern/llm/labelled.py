"""Bounded samples of labelled documents, and scores that do not depend on how rows are batched."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
#: Different texts of one id that take part, at most: those with the smallest digests.
TEXTS_OF_ID = 4
#: Decimal digits of a score.
DIGITS = 12


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w added up column by column: a row's sums have one order, whatever rows stand beside it."""
    out = np.zeros((len(x), w.shape[1]))
    for k in range(w.shape[0]):
        out += x[:, k, None] * w[k]
    return out


def sample(documents: DataFrame, labels: DataFrame, label: str, training, most: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, label (0 or 1) of at most `most` labelled rows that the Column `training` (of labels) marks.

    The chosen ids are bounded by `most`, so they are broadcast and no other text is shuffled. Ids with a null or
    no label take no part; of rows that repeat an id in labels the largest label counts, of rows that repeat an id
    in documents each different text takes part once, and at most TEXTS_OF_ID of them.
    """
    chosen = labels.where(training & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("of")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("of"), "of").limit(most)
    spark = documents.sparkSession
    chosen = spark.createDataFrame([tuple(r) for r in chosen.collect()], "of long, label int")
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("of"))
    once = rows.groupBy("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).agg(F.first("text").alias("text"), F.first("label").alias("label"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("digest"))
    return once.withColumn("nth", nth).where(F.col("nth") <= TEXTS_OF_ID).select("doc_id", "text", "label")
