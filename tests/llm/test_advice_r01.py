"""The whole job where the first round's review found less."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import quality, sharded, suffix_dedup
from test_llm_operators import brute_passages, marks


def say(rng, k):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k)]


def passages(spark, data, parts=4, **with_):
    got = suffix_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(parts), **with_).collect()
    assert all(r.doc_id != r.other_doc for r in got)
    return got


def test_passages_with_a_document_between_that_shares_the_tail(spark):
    rng, data = random.Random(1), []
    for i in range(0, 30, 3):
        t = say(rng, 60)
        data += [(i, " ".join(t)), (i + 1, " ".join(say(rng, 40) + t[15:])), (i + 2, " ".join(t))]
    want = brute_passages(data, suffix_dedup.LEAST)
    assert sum(map(any, want.values())) == 20
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert marks(passages(spark, data), data) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("with_", [{}, {"chunk": 7}, {"hot": 20, "chunk": 7}])
def test_passages_that_end_in_a_frequent_stretch(spark, with_):
    """15 words that two documents share, then 40 that all do; a run of the 40 fills several ranges."""
    rng = random.Random(2)
    footer, data = say(rng, 40), []
    for i in range(60):
        own, other = say(rng, 15), say(rng, 15)
        data += [(i, " ".join(say(rng, 20) + own + footer)), (1000 - i, " ".join(say(rng, 20) + own + footer)), (2000 + i, " ".join(say(rng, 5) + footer + other)), (300 + i, " ".join(footer + other + say(rng, 9)))]
    data.append((None, data[0][1]))
    want = brute_passages(data, suffix_dedup.LEAST)
    assert all(map(any, want.values()))
    got = passages(spark, data, 8, **with_)
    assert marks(got, data) == want
    partner = {i: 1000 - i for i in range(60)} | {300 + i: 2000 + i for i in range(60)}
    assert {(r.doc_id, r.other_doc) for r in got} == set(partner.items()) | {(b, a) for a, b in partner.items()}


def test_a_word_is_common_at_every_size(spark):
    """Eight occurrences are enough beside 100 MB of other text."""
    texts = spark.range(0, 100, 1, 8).select(F.repeat(F.lit("x"), 1_000_000).alias("text")).unionByName(spark.createDataFrame([("seldom seen words",)] * 8 + [("rarer still words",)] * 7, "text string"))
    vectors = quality.random_index(texts)
    (_, _, (w, _)), *_ = quality._streams(pa.array(["seldom rarer"]))
    (v,) = sharded.Sorted(vectors.folder, "vector", vectors.shards, ("v",)).get(w.hash.astype(np.uint32), w.hash)
    assert v.any(1).tolist() == [True, False]


def test_sums_as_bytes():
    for v in ([0, -1, 1], [127, -128, 300], [-(2**30), 2**30 - 1, 5]):
        assert quality.unfolded(quality.folded(np.array(v, np.int32)), 3).tolist() == v


def test_index_vectors_have_four_places_and_tell_words_apart():
    place, sign = quality.index_vectors(np.arange(20_000, dtype=np.uint64))
    vectors = np.zeros((len(place), quality.DIM), np.int64)
    np.add.at(vectors, (np.arange(len(place))[:, None], place), sign.astype(np.int64))
    assert quality.DIM >= 32 and (np.abs(vectors).sum(1) == 4).all() and (vectors != 0).sum(1).tolist() == [4] * len(place)
    assert len(np.unique(vectors, axis=0)) > 19_000
    assert np.abs(np.abs(vectors).mean(0) * quality.DIM / 4 - 1).max() < 0.1


def test_run_writes_and_reads_each_stage(spark, tmp_path, monkeypatch):
    read = []

    def stage(spark, docs, sf_dir):
        read.append([f.rsplit("/", 2)[-2] for f in docs.inputFiles()])
        return docs.where("doc_id <> 1")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first one", stage), ("second", stage)])
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert [(r.doc_id, r.text) for r in out.collect()] == [(2, "b")]
    assert [{f.split("-")[0] for f in x} for x in read] == [{"documents.parquet"}, {"first"}] and "/second-" in out.inputFiles()[0]


def test_mix_keeps_null_and_repeated_ids(spark):
    """A source alone is taken 1.5 times, so every row once or twice."""
    rng = random.Random(3)
    ids = [*range(40), None, None, None, 5, 5, 6]
    data = [(i, " ".join(say(rng, rng.randint(1, 30))), "s") for i in ids]
    data += [data[7], data[-2]]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = corpus_pipeline.mix_sources(spark, docs.repartition(3), "").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.source) for r in got))) == sorted(map(str, data))
    assert all(r.size == len(r.text.split()) and r.taken == r.copies * r.size and r.copies in (1, 2) for r in got)
    assert {r.source_size for r in got} == {sum(r.size for r in got)}
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.mix_sources(spark, docs.repartition(7), "").collect()))
