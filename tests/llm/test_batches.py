"""Scores do not depend on how rows are batched, and samples of labelled rows are bounded."""

import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import labelled, lm_scoring, quality, toxicity


def test_products_have_one_order_of_sums():
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=(5000, 33)) * 10.0 ** rng.integers(-6, 6, (5000, 33)), rng.normal(size=(33, 7))
    whole = labelled.times(x, w)
    assert np.allclose(whole, x @ w)
    for n in (1, 7, 1000):
        assert (np.concatenate([labelled.times(x[i : i + n], w) for i in range(0, len(x), n)]) == whole).all()


def test_scores_are_equal_in_batches_of_any_size(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["you are an idiot"] * 3 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    try:
        for n in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))
            found.append([sorted((r.doc_id, r.score, r.predicted) for r in got.collect()) for got in (quality.quality(docs, labels, lm_scoring.crc_is("doc_id", 5, 0)), toxicity.toxicity(docs, labels, lm_scoring.crc_is("doc_id", 3, 1)))])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert found[0] == found[1] == found[2]


def test_an_id_that_repeats_gives_a_few_texts(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 50).cast("string")).alias("text")).unionByName(spark.createDataFrame([(2, "b"), (2, "b"), (3, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", F.lit(True)).collect()
    assert len([r for r in got if r.doc_id == 1]) == labelled.TEXTS_OF_ID == len({r.text for r in got if r.doc_id == 1})
    assert sorted((r.doc_id, r.text, r.label) for r in got if r.doc_id != 1) == [(2, "b", 1), (3, None, 0)]


def test_scores_beyond_53_and_64_bits(spark):
    import pytest

    from quern.llm import topk_search

    rng = random.Random(2)
    data = [(i, [float(rng.randint(-(10**6), 10**6)) for _ in range(4)]) for i in range(60)] + [(7, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=3, scale=256).collect()
    whole = [(i, [int(x) * 256 for x in v]) for i, v in data]
    for ask, q in whole:
        if ask % 20 == 0:
            want = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in whole if i != ask)[:3]
            assert [(-s, i) for s, i in want] == [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == ask), key=lambda r: r.rank)]
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=3, scale=2**20).collect()
