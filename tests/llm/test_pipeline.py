"""The pipeline, stage by stage, against brute force on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontamination, queries, toxicity
from test_llm_operators import brute_components, brute_drops, brute_tiles, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(k))
    at = str(tmp_path_factory.mktemp("tables"))
    items = [(i, say(22)) for i in range(4)]
    line, docs, labels = say(9), [], []
    for i in range(150):
        t = "\n".join(say(rng.randint(5, 25)) for _ in range(rng.randint(1, 4)))
        if i % 7 == 0:
            t += f" you {rng.choice(['idiot', 'scum', 'moron'])} {say(2)}"
        if i % 5 == 0:
            t += "\n" + (line if i % 2 else line[:-1] + "q")
        if i % 11 == 3:
            t += " " + items[i % 4][1]
        docs.append((i, t, "en", None if i % 13 == 5 else f"s{i % 4}", len(t)))
        labels.append((i, int(i % 7 == 0)))
    for i in range(150, 165):
        w = docs[i - 149][1].split(" ")
        w[len(w) // 2] = "changed"
        t = docs[i - 149][1] if i % 2 else " ".join(w)
        docs.append((i, t, "en", "s1", len(t)))
    docs += [(900, None, None, None, None), (901, "", "en", "s0", 0), (902, " \n ", "en", "s0", 3), (903, say(4000), "en", "s2", 1), (None, say(30), "en", "s1", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), {r.item_id: words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    was = by_id(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        now = by_id(out)
        if k < 4:
            assert out.columns == docs.columns
        texts = [(i, r.text) for i, r in was.items()]
        if name == "toxicity":
            model = toxicity.Model({})
            toxic = {i for i, t in texts if sum(model.features(next(iter(toxicity.clauses_of(_column(t))))[2], 1)[0])}
            assert set(now) == set(was) - toxic and len(toxic) >= 20
            assert all(now[i] == was[i] for i in now)
        elif name == "line dedup":
            drops = brute_drops(texts)
            gone = {i for i, t in texts if i is not None and drops[i] and len(drops[i]) == sum(bool(x.strip()) for x in t.split("\n"))}
            assert set(now) == set(was) - gone
            for i, r in now.items():
                keep = [x for n, x in enumerate((was[i].text or "").split("\n")) if n not in drops[i] and x.strip()] if i is not None else None
                assert keep is None or [x for x in (r.text or "").split("\n") if x.strip()] == keep
                assert r.n_chars == (None if r.text is None else len(r.text)) and r.source == was[i].source
        elif name == "MinHash near-dedup":
            _, component = brute_components(texts)
            assert set(now) == {i for i in was if i is None or component[i] == i}
        elif name == "benchmark decontamination":
            leaked = {i for i, t in texts if any(sum(n for *_, n in brute_tiles(item, words(t), 5)) >= decontamination.COVER * len(item) for item in items.values() if len(words(t)) < 1000)}
            assert leaked and set(now) == set(was) - leaked
        else:
            assert set(now) <= set(was) and all(1 <= r.copies <= 2 and r.taken == r.copies * r["size"] and r["size"] == len(words(was[i].text)) for i, r in now.items() if i is not None)
        docs, was = out, now


def _column(t):
    import pyarrow as pa

    return pa.array([t], pa.string())


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing"]
    assert corpus_pipeline.run(spark, folder).count() > 50


def test_stages_of_empty_and_clashing_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("size", F.lit(1)).withColumn("score", F.lit(2)).withColumn("dropped", F.lit("x")).withColumn("predicted", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
    assert corpus_pipeline.drop_toxic(spark, docs, folder).columns == docs.columns
    assert corpus_pipeline.drop_repeated_lines(spark, docs, folder).columns == docs.columns
    assert "mix_size" in corpus_pipeline.mix_sources(spark, docs, folder).columns


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(queries.SQL) <= names
