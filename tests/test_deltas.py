"""Exact sums, and views that follow changes, against the same folds over everything at once."""

import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.operators import exact
from quern.streaming import deltas

FOLDS = {"n": ("count", None), "some": ("count", "x"), "total": ("sum", "x"), "least": ("min", "x"), "most": ("max", "x")}


def nearest(values):
    total = sum((Fraction(v) for v in values), Fraction(0))
    return float(total)


def test_sums_are_rounded_once(spark):
    rng = random.Random(1)
    odd = [5e-324, -5e-324, 2.0**-1022, 1.7e308, -1.7e308, 1e300, -1e300, 0.1, 2.0**52, 2.0**53 - 1, 1.0, 1024.0, 2.0**-30, -0.0, 3.0]
    any_double = lambda: next(x for x in iter(lambda: struct.unpack("<d", rng.randbytes(8))[0], None) if math.isfinite(x) and abs(x) < 1e305)
    groups = {"odd": odd, "single": [0.1], "cancels": [1e16, 1.0, -1e16, 1e-9], "none": [None, None], "any": [any_double() for _ in range(400)], "cents": [rng.randint(0, 10**7) / 100 for _ in range(3000)]}
    for x in odd:
        groups[f"one {x!r}"] = [x]
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, x double")
    for n in (1, 7):
        got = {r.k: r.value for r in exact.exact_sum(df.repartition(n), ["k"], "x").collect()}
        assert got == {k: nearest(v for v in vs if v is not None) for k, vs in groups.items()}


def test_sums_of_other_than_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", nan), ("d", -inf), ("e", 1.7e308), ("e", 1.7e308)], "k string, x double")
    got = {r.k: r.value for r in exact.exact_sum(df, ["k"], "x").collect()}
    assert got["a"] == inf and math.isnan(got["b"]) and math.isnan(got["c"]) and got["d"] == -inf and got["e"] == inf
    assert exact.exact_sum(df.where("false"), ["k"], "x").collect() == []
    assert exact.exact_sum(df.where("k = 'e'").limit(1), [], "x").first().value == 1.7e308


def test_a_group_of_millions_is_partial_in_each_task(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), (F.when(F.col("id") % 2 == 0, 0.1).otherwise(-0.3)).alias("x"))
    assert exact.exact_sum(df, ["k"], "x").first().value == float(Fraction(0.1) * (n // 2) + Fraction(-0.3) * (n // 2))


def folded(rows):
    out = {}
    for k, x in rows:
        out.setdefault(k, []).append(x)
    return {k: (len(v), len(s := [x for x in v if x is not None]), nearest(s), min(s, default=None), max(s, default=None)) for k, v in out.items()}


def test_a_view_follows_changes(spark, tmp_path):
    rng = random.Random(2)
    view = deltas.FoldView(spark, f"file://{tmp_path}/v", {"k": "string"}, FOLDS, buckets=8)
    rows: list = []
    for batch in range(4):
        new = [(rng.choice("abcdefgh") if batch else "abc"[i % 3], rng.choice([None, 0.1, 0.3, 1e17, -2.5])) for i in range(30)]
        gone = rng.sample(rows, len(rows) // 2)
        if batch == 3:
            gone = [r for r in rows if r[0] == "a"] + rng.sample([r for r in rows if r[0] != "a"], 5)
            new = [r for r in new if r[0] != "a"]
        for r in gone:
            rows.remove(r)
        rows += new
        changes = spark.createDataFrame([(*r, 1) for r in new] + [(*r, -1) for r in gone], "k string, x double, sign int").repartition(3)
        got = {r.k: tuple(r)[1:] for r in view.refresh(batch, changes).collect()}
        touched = {r[0] for r in (*new, *gone)}
        assert got == {k: v for k, v in folded(rows).items() if k in touched}
        # A batch that runs again changes nothing.
        assert {r.k: tuple(r)[1:] for r in view.refresh(batch, changes).collect()} == got
        assert {r.k: tuple(r)[1:] for r in view.current().collect()} == folded(rows)
    assert "a" not in folded(rows)
    with pytest.raises(QuernError):
        view.kept.apply(-1, view.parts(changes))


def test_a_small_change_touches_its_buckets_only(spark, tmp_path):
    view = deltas.FoldView(spark, f"file://{tmp_path}/v", {"k": "long"}, {"total": ("sum", "x")}, buckets=16)
    view.refresh(0, spark.range(1000).select(F.col("id").alias("k"), F.lit(1.0).alias("x"), F.lit(1).alias("sign")))
    before = view.kept.folders()
    view.refresh(1, spark.createDataFrame([(5, 2.0, 1)], "k long, x double, sign int"))
    after = view.kept.folders()
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert {r.k: r.total for r in view.current().where("k in (5, 6)").collect()} == {5: 3.0, 6: 1.0}
    assert view.refresh(2, spark.createDataFrame([], "k long, x double, sign int")).collect() == []


def test_a_join_of_two_tables_that_change(spark, tmp_path):
    rng = random.Random(3)
    view = deltas.JoinedView(spark, f"file://{tmp_path}/v", {"k": "long", "x": "double"}, {"k": "long", "g": "string"}, {"g": "string"}, FOLDS, buckets=4)
    left, right = [], []
    for batch in range(4):
        sides = []
        for rows, make in ((left, lambda: (rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0.1, -7.5]))), (right, lambda: (rng.choice([None, 1, 2, 3]), rng.choice("ab")))):
            gone = rng.sample(rows, len(rows) // 3)
            new = [make() for _ in range(rng.randint(0, 12) if batch else 12)]
            for r in gone:
                rows.remove(r)
            rows += new
            sides.append([(*r, 1) for r in new] + [(*r, -1) for r in gone])
        frames = [spark.createDataFrame(s, t) for s, t in zip(sides, ("k long, x double, sign int", "k long, g string, sign int"))]
        view.refresh(batch, *frames)
        view.refresh(batch, *frames)
        want = folded([(g, x) for k, x in left for j, g in right if k is not None and k == j])
        assert {r.g: tuple(r)[1:] for r in view.current().collect()} == want


def test_what_folds_share_is_kept_once_and_a_hot_key_is_written_by_several_tasks(spark, tmp_path):
    n, aqe = 4000, spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        view = deltas.FoldView(spark, f"file://{tmp_path}/v", {"k": "long"}, FOLDS, buckets=1)
        rows = spark.range(n).select(F.lit(7).cast("long").alias("k"), (F.col("id") % 1000).cast("double").alias("x"), F.lit(1).alias("sign"))
        assert tuple(view.refresh(0, rows).first()) == (7, n, n, float(sum(range(1000)) * 4), 0.0, 999.0)
        kept = view.kept.rows()
        # 1,000 values for both the least and the greatest, beside counts and strips of sums.
        assert 1000 < kept.count() < 1100
        assert kept.select(F.input_file_name()).distinct().count() > 1
        gone = rows.where("x = 0 or x > 990").withColumn("sign", F.lit(-1))
        assert tuple(view.refresh(1, gone).first()) == (7, n - 40, n - 40, float(sum(range(991)) * 4), 1.0, 990.0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_a_key_whose_changes_cancel_is_still_given(spark, tmp_path):
    view = deltas.FoldView(spark, f"file://{tmp_path}/v", {"k": "string"}, FOLDS, buckets=2)
    schema = "k string, x double, sign int"
    view.refresh(0, spark.createDataFrame([("a", 2.5, 1), ("a", None, 1), ("b", 1.0, 1)], schema))
    got = view.refresh(1, spark.createDataFrame([("a", 4.0, 1), ("a", 4.0, -1)], schema))
    assert [tuple(r) for r in got.collect()] == [("a", 2, 1, 2.5, 2.5, 2.5)]
