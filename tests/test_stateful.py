"""Events on streams: what was seen in an earlier micro-batch counts, rows may come late, and a restart loses and repeats nothing."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import refresh, stateful

SCHEMA = "who string, i long, x double, at timestamp, last double"
START = datetime.datetime(2024, 1, 1)


def rows(seed, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.choice([None, 0.0, -1.0, 2.0, -3.5, 4.0])
        out.append((rng.choice(["a", "b", None]), i, x, START + datetime.timedelta(minutes=i), 1.0))
    return out


def run(spark, tmp_path, batches, find, checkpoint="log"):
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).repartition(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")
        stateful.append_now(find(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/{checkpoint}")
    return sorted(r.i for r in spark.read.parquet(f"file://{tmp_path}/out").collect())


@pytest.mark.parametrize("direction", ["all", "up"])
def test_crossings_over_micro_batches_equal_those_of_the_whole(spark, tmp_path, direction):
    data = rows(1)
    got = run(spark, tmp_path, [data[:50], data[50:51], data[51:]], lambda s: stateful.crossings(s, ["who"], "i", "x", direction))
    want = sorted(r.i for r in refresh.crossings(spark.createDataFrame(data, SCHEMA), ["who"], "i", "x", direction).collect())
    assert got == want and len(want) > 10


def test_conditions_over_micro_batches(spark, tmp_path):
    data = rows(2)
    got = run(spark, tmp_path, [data[:30], data[30:90], data[90:]], lambda s: stateful.became_true(s, ["who"], "i", F.col("x") > 1))
    assert got == sorted(r.i for r in refresh.became_true(spark.createDataFrame(data, SCHEMA), ["who"], "i", F.col("x") > 1).collect())


def test_rows_may_come_late(spark, tmp_path):
    data = rows(3)
    end = [(w, 1000 + k, None, START + datetime.timedelta(days=9), 1.0) for k, w in enumerate(["a", "b", None])]
    shuffled = data[:]
    # Within twenty rows any order.
    random.Random(5).shuffle(part := shuffled[20:40])
    shuffled[20:40] = part
    batches = [shuffled[:30], shuffled[30:80], shuffled[80:], end, end[:1]]
    got = run(spark, tmp_path, batches, lambda s: stateful.crossings(s, ["who"], "i", "x", time="at", delay="30 minutes"))
    want = sorted(r.i for r in refresh.crossings(spark.createDataFrame(data, SCHEMA), ["who"], "i", "x").collect())
    assert got == want


def test_rows_out_of_order_without_a_delay_fail(spark, tmp_path):
    data = [("a", i, 1.0, START, 1.0) for i in (5, 6)]
    with pytest.raises(Exception, match="out_of_order"):
        run(spark, tmp_path, [data, [("a", 2, -1.0, START, 1.0)]], lambda s: stateful.crossings(s, ["who"], "i", "x"))


def test_a_stream_of_nothing(spark, tmp_path):
    assert run(spark, tmp_path, [[("a", 1, 1.0, START, 1.0)]], lambda s: stateful.crossings(s, ["who"], "i", "x")) == []


def test_state_is_kept_by_buckets_and_not_by_trajectory(spark, tmp_path):
    # Each key of the state costs trips to the store: with one for each trajectory a batch's time grew with their number.
    data = [(f"t{i % 300}", i, float((-1) ** (i // 300)), START, 1.0) for i in range(900)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"file://{tmp_path}/in")
    found = stateful.crossings(spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in"), ["who"], "i", "x", buckets=8)
    query = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 8
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 600


def test_keys_of_any_kind_stay_apart_and_exact(spark, tmp_path):
    big, schema = 2**60 + 1, "k long, d double, s string, i long, x double, more long"
    whose = [(None, 0.0, "a"), (big, 0.0, "a"), (big + 1, 0.0, "a"), (big, None, "a"), (big, 0.0, None), (big, 0.0, ""), (big, float("nan"), "a"), (None, None, None)]
    data = [(k, -d if d == 0.0 and i % 2 else d, s, i, float((-1) ** i), None if i % 3 else big + i) for i in range(6) for k, d, s in whose]
    for part in (data[:20], data[20:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        stateful.append_now(stateful.crossings(stream, ["k", "d", "s"], "i", "x", buckets=2), f"file://{tmp_path}/out", f"file://{tmp_path}/log")
    want = refresh.crossings(spark.createDataFrame(data, schema), ["k", "d", "s"], "i", "x")
    plain = lambda df: sorted(map(repr, df.selectExpr("k", "d + 0.0 as d", "s", "i", "x", "more").collect()))
    got = plain(spark.read.parquet(f"file://{tmp_path}/out"))
    assert got == plain(want) and len(got) == 5 * len(whose)
