import math
import random

import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.operators import aggregate as faq
from quern.operators import arrays, geometry, relational, spatial
from quern.types import REDUCERS, SEMIRINGS, Factor, categorical, interval, semiring


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- semirings and aggregates ---


@pytest.mark.parametrize("name,terms,zero", [("sum_product", 14.0, 0.0), ("max_product", 9.0, -math.inf), ("min_sum", 2.0, math.inf), ("max_sum", 6.0, -math.inf)])
def test_semirings_fold_and_have_zeros(spark, name, terms, zero):
    a = Factor(frame(spark, [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0)], "i long, j long, value double"), ("i", "j"))
    b = Factor(frame(spark, [(1, 1.0), (2, 2.0), (3, 3.0)], "j long, value double"), ("j",))
    dense = interval(2).positions(spark, "i")
    assert rows(faq.aggregate([a, b], ["i"], SEMIRINGS[name], dense=dense)) == [(1, terms), (2, zero)]


def test_boolean_semiring(spark):
    a = Factor(frame(spark, [(1, 1, True), (2, 1, False)], "i long, j long, value boolean"), ("i", "j"))
    b = Factor(frame(spark, [(1, True)], "j long, value boolean"), ("j",))
    assert rows(faq.aggregate([a, b], ["i"], SEMIRINGS["bool_and_or"], dense=interval(3).positions(spark, "i"))) == [(1, True), (2, False), (3, False)]


def test_semiring_names():
    assert semiring("min_sum", "+").name == "min_sum" and semiring(None, "*").zero == 1.0 and semiring().name == "sum_product"
    for bad in ({"name": "tropical_max"}, {"reduce": "avg"}):
        with pytest.raises(QuernError, match="unknown"):
            semiring(**bad)
    assert set(REDUCERS) == {"+", "*", "max", "min"}


def test_early_contraction_gives_the_same(spark):
    rng = random.Random(1)
    fs = [Factor(frame(spark, [(rng.randrange(4), rng.randrange(5), float(k), rng.random()) for k in range(40)], f"{a} long, {b} long, x{a}{b} double, value double").select(a, b, "value"), (a, b)) for a, b in (("i", "j"), ("j", "k"), ("k", "m"))]
    for ring in ("sum_product", "max_sum", "min_sum"):
        early, late = (rows(faq.aggregate(fs, ["i"], SEMIRINGS[ring], early=e)) for e in (True, False))
        assert all(a == x and math.isclose(b, y) for (a, b), (x, y) in zip(early, late, strict=True))


def test_float_keys_are_refused(spark):
    df = frame(spark, [(1.5, 1.0)], "k double, value double")
    for bad in (lambda: Factor(df, ("k",)), lambda: relational.distinct(df, "k"), lambda: relational.rank(df, "k"), lambda: relational.equijoin(df, df, ["k"], ["k"])):
        with pytest.raises(QuernError, match="float_key"):
            bad()


def test_prefixes(spark):
    df = frame(spark, [(i, float(2 ** (i - 1))) for i in range(1, 5)], "i long, u double")
    run = lambda ring="sum_product", **k: [r.value for r in faq.prefix(df, [], "i", F.col("u"), SEMIRINGS[ring], **k).orderBy("i").collect()]
    assert run() == [1, 3, 7, 15] and run(strict=True) == [0, 1, 3, 7] and run(reverse=True) == [15, 14, 12, 8] and run(reverse=True, strict=True) == [14, 12, 8, 0]
    assert run("max_sum", strict=True)[0] == -math.inf


def test_ranges(spark):
    df = frame(spark, [(1, 3), (2, 0), (3, 1)], "p long, n long")
    assert rows(faq.expand_range(df, 1, F.col("n"), "k").select("p", "k")) == [(1, 1), (1, 2), (1, 3), (3, 1)]
    assert [r.k for r in faq.expand_range(spark.range(1), 10, 1, "k", -4).collect()] == [10, 6, 2]
    values = Factor(frame(spark, [(1, 1, 7.0), (1, 2, 8.0), (1, 3, 9.0), (3, 1, 5.0)], "p long, k long, value double"), ("p", "k"))
    got = faq.ragged(df.select("p"), "p", Factor(df.withColumnRenamed("n", "value"), ("p",)), values, "k", "m")
    assert rows(got.select("p", "k", "m")) == [(1, 1, 7.0), (1, 2, 8.0), (1, 3, 9.0), (3, 1, 5.0)]


# --- relational literals ---


def test_skolem_and_distinct(spark):
    df = frame(spark, [(5, 2, 9), (7, 7, 1)], "a long, b long, c long")
    assert [tuple(r[0]) for r in df.select(relational.skolem_edge(F.col("a"), F.col("b"))).collect()] == [(2, 5), (7, 7)]
    assert [list(r[0]) for r in df.select(relational.skolem(F.col("a"), F.col("b"), F.col("c"), symmetric=True)).collect()] == [[2, 5, 9], [1, 7, 7]]
    s = frame(spark, [("a",), ("Z",), ("B",), ("a",)], "s string")
    assert [r.s for r in relational.rank(s, "s").orderBy("rank").collect()] == ["B", "Z", "a"]
    with pytest.raises(Exception, match="key_not_integral"):
        frame(spark, [(1.5,)], "x double").select(relational.key_int(F.col("x"))).collect()


def test_rank_is_dense_and_independent_of_partitions(spark):
    keys = [random.Random(3).randrange(500) for _ in range(3000)]
    df = frame(spark, [(k,) for k in keys], "k long")
    want = {k: i for i, k in enumerate(sorted(set(keys)))}
    for n in (1, 7):
        assert dict(rows(relational.rank(df.repartition(n), "k"))) == want
    assert rows(relational.rank(frame(spark, [(30,), (10,), (20,), (10,)], "k long"), "k", base=1)) == [(10, 1), (20, 2), (30, 3)]
    assert relational.rank(df.where("false"), "k").count() == 0


def test_equijoin(spark):
    edges, cells = frame(spark, [(101, 1), (102, 1), (103, 2), (104, 99), (105, None)], "eid long, cell long"), frame(spark, [(1, "A"), (2, "B"), (None, "C")], "cell long, name string")
    assert rows(relational.equijoin(edges, cells, ["cell"], ["cell"]).select("eid", "name")) == [(101, "A"), (102, "A"), (103, "B")]
    assert relational.exists(edges, cells, ["cell"]).count() == 3


def test_group_aggregate(spark):
    df = frame(spark, [("b", 3), ("a", 1), ("b", 4), ("a", 10), ("c", 5)], "k string, v long")
    assert rows(relational.group_aggregate(df, ["k"], "v", SEMIRINGS["sum_product"])) == [("a", 11), ("b", 7), ("c", 5)]
    x = frame(spark, [(1, 0.1), (1, 1e16), (1, -1e16), (1, 0.3)], "k long, v double")
    exact = {relational.group_aggregate(x.repartition(n), ["k"], "v", SEMIRINGS["sum_product"], exact=True).first().value for n in (1, 2, 3, 4)}
    assert len(exact) == 1


def test_witnesses_break_ties_by_id(spark):
    df = frame(spark, [(1, 5, 2.0), (1, 3, 2.0), (1, 1, 3.0), (2, 9, math.nan), (2, 8, 1.0)], "g long, id long, v double")
    assert rows(relational.arg_best(df, ["g"], "v", "id").select("g", "id")) == [(1, 3), (2, 8)]
    assert rows(relational.arg_best(df, ["g"], "v", "id", largest=True).select("g", "id")) == [(1, 1), (2, 8)]


def test_index_sets(spark):
    faces = frame(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 2, 3), (2, 3, 4), (2, 4, 2)], "f long, a long, b long")
    members = relational.index_set(faces, relational.skolem_edge(F.col("a"), F.col("b")))
    assert [(tuple(r.member), r.pos) for r in members.orderBy("pos").collect()] == [((1, 2), 1), ((1, 3), 2), ((2, 3), 3), ((2, 4), 4), ((3, 4), 5)]
    assert rows(categorical("gas", "oil").positions(spark, "f")) == [(1, "gas"), (2, "oil")]


# --- spatial ---


@pytest.mark.parametrize("eps", [0.0, 0.3])
def test_overlap_equals_brute_force(spark, eps):
    rng = random.Random(5)
    boxes = lambda n: [(i, x := rng.choice([0.0, 1.0, rng.uniform(-5, 5)]), y := rng.uniform(-5, 5), x + rng.choice([0.0, 1.0, 6.0]), y + rng.random()) for i in range(n)]
    a, b = boxes(60), boxes(60)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] - eps <= q[3] + eps and q[1] - eps <= p[3] + eps and p[2] - eps <= q[4] + eps and q[2] - eps <= p[4] + eps)
    cols = ", ".join(f"{c} double" for c in spatial.BOX)
    got = spatial.overlap_join(frame(spark, a, f"a long, {cols}"), frame(spark, b, f"b long, {cols}"), "a", "b", eps)
    assert rows(got) == want and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_reaches_far(spark):
    rng = random.Random(6)
    p, t = [(i, rng.uniform(0, 1000)) for i in range(50)], [(i, x) for i, x in enumerate([3.0, 3.0, 900.0])]
    got = spatial.nearest(frame(spark, p, "p long, x double"), frame(spark, t, "t long, g double"), "p", "t", "x", "g")
    assert rows(got.select("p", "t")) == [(i, min((abs(x - g), j) for j, g in t)[1]) for i, x in p]


# --- arrays ---


def grid(spark, n=3, m=2):
    return Factor(frame(spark, [(i, j, float(10 * i + j)) for i in range(1, n + 1) for j in range(1, m + 1)], "i long, j long, value double"), ("i", "j"))


def test_shapes(spark):
    g = grid(spark)
    assert rows(arrays.transpose(g).df)[:2] == [(1, 1, 11.0), (1, 2, 21.0)]
    flat = arrays.reshape(g, [3, 2], [6])
    assert [v for _, v in rows(flat.df)] == [11.0, 21.0, 31.0, 12.0, 22.0, 32.0]
    assert rows(arrays.reshape(flat, [6], [3, 2]).df) == rows(g.df)
    both = arrays.concat([g, g], [2, 2], axis=1)
    assert rows(both.df.where("i = 1")) == [(1, 1, 11.0), (1, 2, 12.0), (1, 3, 11.0), (1, 4, 12.0)]
    with pytest.raises(QuernError, match="reshape"):
        arrays.reshape(g, [3, 2], [5])


def test_alignment_by_name(spark):
    g, row = grid(spark), Factor(frame(spark, [(1, 1.0), (2, 2.0), (3, 3.0)], "i long, value double"), ("i",))
    got = arrays.broadcast(lambda a, b: a + b, [row, g], ["i", "j"], {})
    assert rows(got.df)[:2] == [(1, 1, 12.0), (1, 2, 13.0)]
    assert arrays.broadcast(lambda a: a, [row], ["i", "k"], {"k": interval(4).positions(spark, "k")}).df.count() == 12
    with pytest.raises(QuernError, match="axis_not_in_result"):
        arrays.broadcast(lambda a: a, [g], ["i"], {})


def test_subscripts(spark):
    a = Factor(frame(spark, [(i, float(i)) for i in range(1, 5)], "i long, value double"), ("i",))
    f = frame(spark, [(0,), (1,), (5,)], "k long")
    read = lambda policy: sorted((r.k, r.v) for r in arrays.gather(f, a, [arrays.bound(F.col("k"), 4, policy)], "v").collect())
    assert read("periodic") == [(0, 4.0), (1, 1.0), (5, 1.0)] and read("clamp") == [(0, 1.0), (1, 1.0), (5, 4.0)]
    with pytest.raises(Exception, match="index_out_of_range"):
        read("error")
    assert sorted((r.k, r.v) for r in arrays.gather(f, a, [F.col("k")], "v", ghost=0.0).collect()) == [(0, 0.0), (1, 1.0), (5, 0.0)]


def test_blocks_and_stencils(spark):
    g = grid(spark, 3, 3).df
    m = arrays.makearray(g, ["i", "j"], [([(1, 3), (1, 3)], F.lit(1.0)), ([(2, 2), (1, 2)], F.lit(5.0))])
    assert [v for *_, v in rows(m.df)] == [1, 1, 1, 5, 5, 1, 1, 1, 1]
    line = frame(spark, [(i, float(i * i)) for i in range(1, 5)], "i long, u double")
    assert [r.d for r in arrays.stencil(line, [], "i", "u", {-1: 1.0, 0: -2.0, 1: 1.0}, "d").orderBy("i").collect()] == [2.0, 2.0, 2.0, -23.0]
    assert rows(arrays.shifted(grid(spark), "j", 1, "n").select("i", "j", "n"))[:2] == [(1, 1, 12.0), (1, 2, 0.0)]


def test_reductions_and_names(spark):
    df = frame(spark, [(3.0, 1.0), (4.0, 4.0)], "u double, r double")
    one = lambda how, ref=None: arrays.field_reduce(df, "u", how, ref).first()[0]
    assert (one("mean"), one("integral"), one("max"), one("min"), one("Linf_error", "r")) == (3.5, 3.5, 4.0, 3.0, 2.0)
    assert math.isclose(one("L2_error", "r"), 2 / math.sqrt(17))
    with pytest.raises(QuernError):
        one("median")
    base, index = arrays.parse_cell(F.col("n"))
    assert [(b, list(i)) for b, i in frame(spark, [("u[3,4]",), ("plain",)], "n string").select(base, index).collect()] == [("u", [3, 4]), ("plain", [])]


# --- geometry ---


def square(x, y, w):
    return [{"lon": float(a), "lat": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]


def test_clip_and_area(spark):
    df = frame(spark, [(square(0, 0, 2), square(1, 1, 2)), (square(0, 0, 1), square(5, 5, 1)), (square(0, 0, 1), square(0, 0, 1)[::-1]), (square(0, 0, 4), [*square(1, 1, 1), square(1, 1, 1)[0]])], f"a {geometry.RING}, b {geometry.RING}")
    got = [r[0] for r in df.select(geometry.intersection_area(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 1.0, 1.0]
    assert [r.area for r in geometry.polygon_area(df.limit(1).withColumn("k", F.lit(1)), "k", "a").collect()] == [4.0]
    with pytest.raises(QuernError, match="manifold"):
        geometry.intersect_polygon(F.col("a"), F.col("b"), "flat")


def test_spherical_area(spark):
    octant = [{"lon": 0.0, "lat": 0.0}, {"lon": 90.0, "lat": 0.0}, {"lon": 0.0, "lat": 90.0}]
    df = frame(spark, [(octant,)], f"a {geometry.RING}")
    assert math.isclose(df.select(geometry.spherical_area(F.col("a"))).first()[0], math.pi / 2, rel_tol=1e-12)
    self_overlap = df.select(geometry.intersection_area(F.col("a"), F.col("a"), "spherical")).first()[0]
    assert math.isclose(self_overlap, math.pi / 2, rel_tol=1e-9)
    small = frame(spark, [(square(0, 0, 2), square(1, 1, 2))], f"a {geometry.RING}, b {geometry.RING}")
    flat, round_ = small.select(geometry.intersection_area(F.col("a"), F.col("b")), geometry.intersection_area(F.col("a"), F.col("b"), "spherical", 180 / math.pi)).first()
    assert math.isclose(flat, round_, rel_tol=2e-3)


def test_regridding_conserves(spark):
    src = frame(spark, [(i, square(i % 4, i // 4, 1), float(i)) for i in range(16)], f"s long, ring {geometry.RING}, v double")
    tgt = frame(spark, [(i, square(i % 2 * 2, i // 2 * 2, 2)) for i in range(4)], f"t long, ring {geometry.RING}")
    assert rows(geometry.regrid(src, tgt, "s", "t", "ring", "v")) == [(0, 2.5), (1, 4.5), (2, 10.5), (3, 12.5)]
    assert len(geometry.densify([(0.0, 0.0), (10.0, 0.0), (10.0, 5.0)], 2.5)) == 6
