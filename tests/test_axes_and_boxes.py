"""Scans, stencils and overlap joins whose work must not grow with the square of the rows, against loops."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.operators import arrays, geometry, spatial
from quern.operators.aggregate import place_among, prefix
from quern.types import SEMIRINGS


@pytest.fixture
def ranges(spark):
    """A session with many ranges of axes, for the time of a test."""
    was = spark.conf.get("spark.sql.shuffle.partitions")

    def put(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield put
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.mark.parametrize("n", [1, 5, 70])
def test_stencils_reach_over_ranges(spark, ranges, n):
    ranges(n)
    rng = random.Random(n)
    u = [rng.randint(-9, 9) + 0.0 for _ in range(60)]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate(u)], "i long, u double, other string").repartition(3)
    weights = {-25: 1.0, -1: 2.0, 0: -3.0, 30: 0.5}
    got = {r.i: (r.value, r.u, r.other) for r in arrays.stencil(df, [], "i", "u", weights, ghost=100.0).collect()}
    at = lambda i: u[i] if 0 <= i < len(u) else 100.0
    assert got == {i: (sum(w * at(i + k) for k, w in sorted(weights.items())), u[i], "kept") for i in range(len(u))}


def test_a_stencil_has_no_window_without_partitions(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("u"))
    plan = arrays.stencil(df, [], "id", "u", {-1: 1.0, 1: 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" in plan


def test_places_among_cuts_by_tree_and_by_halving(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), *((x / 2,) for x in range(-5, 300))], "x double")
    cuts = [float(x) for x in range(0, 140)]
    got = df.select("x", place_among(F.col("x"), cuts).alias("a"), place_among(F.col("x"), cuts[:60]).alias("b")).collect()
    for r in got:
        below = lambda cs: 0 if r.x is None else len(cs) if math.isnan(r.x) else sum(c < r.x for c in cs)  # noqa: B023, E731
        assert (r.a, r.b) == (below(cuts), below(cuts[:60]))


def test_reverse_scans_and_nearest_take_linear_time(spark, ranges):
    ranges(2)

    def seconds(n):
        df = spark.range(n).select("id", F.lit(1).alias("g"), (F.col("id") % 7).cast("double").alias("v"))
        near = spatial.nearest(df, df.select(F.col("id").alias("t"), F.col("id").cast("double").alias("x")), "id", "t", "v", "x")
        start = time.perf_counter()
        prefix(df, ["g"], "id", F.col("v"), SEMIRINGS["sum_product"], reverse=True).write.format("noop").mode("overwrite").save()
        prefix(df, [], "id", F.col("v"), SEMIRINGS["max_sum"], strict=True, reverse=True).write.format("noop").mode("overwrite").save()
        near.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    # With a fold anew for each row 100,000 rows take minutes.
    assert seconds(100_000) < 20


@pytest.mark.parametrize("strict", [False, True])
def test_reverse_prefixes_equal_loops(spark, strict):
    rng = random.Random(1)
    data = [(i % 3, i, rng.randint(0, 9) + 0.0) for i in range(40)]
    df = spark.createDataFrame(data, "g long, i long, v double").repartition(3)
    for by in (["g"], []):
        got = {r.i: r.value for r in prefix(df, by, "i", F.col("v"), SEMIRINGS["sum_product"], strict=strict, reverse=True).collect()}
        assert got == {i: sum(v for h, j, v in data if (j > i or j == i and not strict) and (not by or g == h)) for g, i, _ in data}


def boxes(rng, n, spread=100.0):
    out = []
    for i in range(n):
        w, h = (rng.choice([0.0, 0.01, 1.0, 30.0, 5000.0]) * rng.random() for _ in "xy")
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        out.append((i, x, y, x + w, y + h))
    return [*out, (n, 5.0, 5.0, 5.0, 5.0), (n + 1, 5.0, 5.0, 5.0, 5.0), (n + 2, None, 0.0, 1.0, 1.0), (n + 3, math.nan, 0.0, 1.0, 1.0)]


@pytest.mark.parametrize(("eps", "cell_rows", "width"), [(0.0, 100_000, None), (0.5, 100_000, None), (0.0, 7, None), (0.25, 3, (1e-3, 50.0)), (0.0, 9, (1e5, 1e5))])
def test_overlaps_of_mixed_sizes_equal_loops(spark, eps, cell_rows, width):
    rng = random.Random(f"{eps}{cell_rows}")
    a, b = boxes(rng, 90), boxes(rng, 70)
    frame = lambda rows, i: spark.createDataFrame([(*r, 1) for r in rows], f"{i} long, xmin double, ymin double, xmax double, ymax double, level long").repartition(3)
    got = spatial.overlap_join(frame(a, "a"), frame(b, "b"), "a", "b", eps, width, cell_rows).collect()
    meet = lambda p, q: None not in (p[1], q[1]) and p[1] - eps <= q[3] + eps and q[1] - eps <= p[3] + eps and p[2] - eps <= q[4] + eps and q[2] - eps <= p[4] + eps
    want = sorted((p[0], q[0]) for p in a for q in b if meet(p, q) and not any(math.isnan(x) for x in (*p[1:], *q[1:])))
    assert sorted((r.a, r.b) for r in got) == want
    assert len(want) > 150


def test_a_box_stands_in_four_cells_of_its_level(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(boxes(random.Random(4), 200)[:200])]
    df = spark.createDataFrame(rows, "a long, xmin double, ymin double, xmax double, ymax double").withColumn("level", spatial.box_level(2.0, 3.0, 0.1))
    most = spatial._cells(df, F.array("level"), 2.0, 3.0, 0.1).groupBy("a").count().agg(F.max("count")).first()[0]
    assert most <= 4 and df.select("level").distinct().count() > 3


def test_no_table_of_boxes(spark):
    none = spark.createDataFrame([], "a long, xmin double, ymin double, xmax double, ymax double")
    some = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "b long, xmin double, ymin double, xmax double, ymax double")
    assert spatial.overlap_join(none, some, "a", "b").collect() == [] == spatial.overlap_join(some, none, "b", "a").collect()


# --- clipping ---


def cut_by_loops(subject, clip):
    """A convex clip, edge by edge and vertex by vertex."""
    if len(subject) < 3 or len(clip) < 3:
        return []
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(clip, clip[1:] + clip[:1]))
    if area < 0:
        clip = clip[::-1]
    for a, b in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        new = []
        for p, q in zip(subject, subject[1:] + subject[:1]):
            s, t = side(p), side(q)
            if s >= 0:
                new.append(p)
            if s * t < 0:
                new.append(tuple(x + s / (s - t) * (y - x) for x, y in zip(p, q)))
        subject = new
        if not subject:
            break
    return subject


def ring(rng, n, size):
    x, y = rng.uniform(-3, 3), rng.uniform(-3, 3)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + size * math.cos(t), y + size * math.sin(t)) for t in turns]


def test_batches_of_rings_are_cut_as_one_by_one(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        a, b = ring(rng, rng.randint(3, 9), rng.uniform(0.1, 4)), ring(rng, rng.randint(3, 8), rng.uniform(0.1, 4))
        rows.append((i, a[::-1] if i % 3 == 0 else a, b[::-1] if i % 2 else b))
    rows += [(300, None, rows[0][2]), (301, rows[0][1], None), (302, [], rows[0][2]), (303, rows[0][1], [(0.0, 0.0), (1.0, 1.0)]), (304, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (2.0, 2.0 + 1e-9)])]
    df = spark.createDataFrame(rows, f"i long, a {geometry.RING}, b {geometry.RING}").repartition(4)
    got = {r.i: r for r in df.select("i", geometry.intersect_polygon(F.col("a"), F.col("b"), "planar").alias("ring"), geometry.intersection_area(F.col("a"), F.col("b")).alias("area")).collect()}
    met = 0
    for i, a, b in rows[:300]:
        want = cut_by_loops(a, b)
        have = [(p.lon, p.lat) for p in got[i].ring]
        assert np.allclose(have, want) if want else have == []
        met += len(want) > 2
    assert met > 60
    assert got[300].ring is None and got[301].ring is None and got[302].ring == [] and got[303].ring == []
    assert math.isclose(got[304].area, 0.5)


def test_close_points_are_one(spark):
    column = pa.array([[{"lon": x, "lat": 0.0} for x in (1.0, 1.0, 1.000009, 1.000018, 1.00003, 2.0, 1.0)], None, [{"lon": 5.0, "lat": 5.0}] * 4, []], pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))
    rings = geometry.Rings.of(column)
    assert rings.points[:, 0].tolist() == [1.0, 1.000018, 1.00003, 2.0, 5.0] and rings.size.tolist() == [4, 0, 1, 0]


def test_spherical_cuts_agree_with_planar_ones_of_small_rings(spark):
    rng = random.Random(2)
    small = lambda n: [(10 + x * 1e-3, 1e-3 * y) for x, y in ring(rng, n, 2.0)]
    df = spark.createDataFrame([(i, small(5), small(6)) for i in range(50)], f"i long, a {geometry.RING}, b {geometry.RING}")
    for r in df.select(geometry.intersection_area(F.col("a"), F.col("b")).alias("flat"), geometry.intersection_area(F.col("a"), F.col("b"), "spherical", 180 / math.pi).alias("round")).collect():
        assert math.isclose(r.flat, r.round, rel_tol=1e-4, abs_tol=1e-10)


def test_the_ellipsoid_is_refused(spark):
    with pytest.raises(QuernError):
        geometry.intersect_polygon(F.col("a"), F.col("b"), "geodesic")


@pytest.mark.parametrize(("width", "eps"), [(0.5, 0.0), (20.0, 0.25), (1e6, 0.0)])
def test_intervals_of_mixed_lengths_equal_loops(spark, width, eps):
    rng = random.Random(str(width))
    make = lambda n: [(i, x := rng.uniform(-50, 50), x + rng.choice([0.0, 0.1, 5.0, 4000.0]) * rng.random()) for i in range(n)] + [(n, None, 1.0), (n + 1, 3.0, 2.0)]
    a, b = make(70), make(60)
    got = spatial.interval_join(spark.createDataFrame(a, "i long, p double, q double"), spark.createDataFrame(b, "j long, r double, s double"), "p", "q", "r", "s", width, eps).collect()
    real = lambda x: x[1] is not None and x[1] <= x[2]
    assert sorted((r.i, r.j) for r in got) == sorted((x[0], y[0]) for x in a for y in b if real(x) and real(y) and x[1] - eps <= y[2] + eps and y[1] - eps <= x[2] + eps)
    assert set(got[0].asDict()) == {"i", "p", "q", "j", "r", "s"}
