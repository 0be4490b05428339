"""What the findings of round 3 showed, on small tables."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import elimination, geometry, hypercube, spatial
from quern.plans import catalogue, systems
from quern.plans.expressions import parse
from quern.types import SEMIRINGS


def test_members_step_together(spark):
    """F5, F6, F8: a right-hand side is evaluated for all members at once, and each member still gets its own steps and roots."""
    rate, calls = np.linspace(1.0, 30.0, 500), []

    def f(t, y, who):
        calls.append(len(who))
        return rate[who][:, None] * np.stack([np.ones(len(who)), -y[:, 1]], 1)

    fall = (lambda t, y, who: y[:, 0] - 1, "up", lambda t, y, who: np.stack([0 * y[:, 0], y[:, 1]], 1))
    got = systems.integrate_many(f, np.tile([0.0, 1.0], (500, 1)), [0.0, 0.26, 0.77], events=[fall])
    assert len(calls) < 60_000 and sum(calls) > 10 * len(calls)
    for k in (0, 123, 499):
        own = lambda t, y, r=rate[k]: r * np.array([1.0, -y[1]])
        one = systems.integrate(own, np.array([0.0, 1.0]), [0.0, 0.26, 0.77], events=[(lambda t, y: y[0] - 1, "up", lambda t, y: [0.0, y[1]])])
        assert np.array_equal(got[:, k], one)
    stiff = systems.integrate_many(lambda t, y, who: -rate[who][:, None] * (y - 1), np.zeros((500, 1)), [0.0, 0.1], 1e-6, 1e-8, stiff=True)
    assert np.allclose(stiff[1, :, 0], 1 - np.exp(-0.1 * rate), atol=1e-5)
    members = spark.range(40).select(F.col("id").alias("member"), (F.col("id") / 10.0).alias("k")).coalesce(1)
    out = systems.simulate(members, {"x": parse("-k * x")}, {"x": 1.0}, [0.0, 1.0])
    assert out.rdd.getNumPartitions() > 1
    assert all(abs(r.value - np.exp(-r.member / 10)) < 1e-6 for r in out.where("t = 1.0").collect())


def test_scalar_ieee_on_odd_rows(spark, tmp_path):
    """null, signed zeros and NaN give what the query's SQL gives."""
    odd = [(1, 5.0, None), (2, None, 0.0), (3, -5.0, 0.0), (4, 0.0, 0.0), (5, 7.0, -0.0), (6, None, None), (7, 2.0, 0.05), (8, 3.0, 0.1), (9, 3.0, float("nan"))]
    rows = spark.createDataFrame([(k, 1, 1000 * x if x is not None else None, d, 1.0) for k, x, d in odd], "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double")
    rows.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT l_orderkey, q, z, lg, l10 FROM ({catalogue.SQL['scalar_ieee']}) ORDER BY 1").fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["scalar_ieee"](spark, str(tmp_path)).select("l_orderkey", "q", "z", "lg", "l10").orderBy("l_orderkey").collect()]
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in want]


def test_polygon_area_moves_nothing(spark):
    """a ring's area is folded in its own row; rings that share a key don't mix."""
    p = lambda *xy: [{"lon": float(x), "lat": float(y)} for x, y in xy]
    rings = [(1, p((0, 0), (2, 0), (2, 3), (0, 3))), (1, p((0, 0), (1, 0), (1, 1), (0, 0))), (2, p((0, 0), (4, 4))), (3, p((1, 1))), (4, []), (5, None)]
    out = geometry.polygon_area(spark.createDataFrame(rings, f"k long, ring {geometry.RING}"), "k", "ring")
    assert sorted(map(tuple, out.collect())) == [(1, 0.5), (1, 6.0), (2, 0.0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_a_cyclic_join_repeats_packed_blocks(spark):
    """what goes to many cells is a compressed block, not rows."""
    edges = [frozenset("xy"), frozenset("yz"), frozenset("xz")]
    rng = np.random.default_rng(5)
    tables = [sorted({tuple(map(int, r)) for r in rng.integers(0, 70, (900, 2))}) for _ in edges]
    alg = elimination.Algebra(SEMIRINGS["sum_product"])
    parts = [(e, spark.createDataFrame([(*r, 1.0) for r in rows], [*sorted(e), "__v"])) for e, rows in zip(edges, tables, strict=True)]
    out = hypercube.join_core(parts, frozenset("x"), alg, cell_rows=200)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__block" in plan
    xy, yz, xz = map(set, tables)
    want = {x: sum((y, z) in yz and (x, z) in xz for a, y in xy if a == x for z in range(70)) for x in range(70)}
    assert {r["x"]: r[1] for r in out.collect()} == {x: n for x, n in want.items() if n}


def test_full_cells_are_dealt_to_blocks_on_both_sides(spark, monkeypatch):
    """a cell's pairs are split over tasks whatever side is the large one, and boxes that can't meet anything go nowhere."""
    monkeypatch.setattr(spatial, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(9)
    box = lambda name, n, wide: spark.createDataFrame([(k, *map(float, (x, y, x + w, y + w))) for k, (x, y, w) in enumerate(zip(rng.uniform(0, 9, n), rng.uniform(0, 9, n), rng.choice(wide, n), strict=True))], f"{name} long, xmin double, ymin double, xmax double, ymax double")
    a, b = box("a", 60, [0.1, 4.0, 30.0]), box("b", 150, [0.2, 1.0, 9.0])
    got = spatial.overlap_join(a, b, "a", "b", eps=0.05)
    x, y = a.toPandas(), b.toPandas()
    e = 0.05
    want = {(p.a, q.b) for p in x.itertuples() for q in y.itertuples() if p.xmin - e <= q.xmax + e and q.xmin - e <= p.xmax + e and p.ymin - e <= q.ymax + e and q.ymin - e <= p.ymax + e}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "part#" in got._jdf.queryExecution().optimizedPlan().toString()
    met = spatial.interval_join(a.select("a", "xmin", "xmax"), b.select("b", F.col("xmin").alias("lo"), F.col("xmax").alias("hi")), "xmin", "xmax", "lo", "hi", 1.0)
    pairs = [(r.a, r.b) for r in met.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(p.a, q.b) for p in x.itertuples() for q in y.itertuples() if p.xmin <= q.xmax and q.xmin <= p.xmax}
    assert "part#" in met._jdf.queryExecution().optimizedPlan().toString()
    far = spatial.overlap_join(a, b.withColumn("xmin", F.col("xmin") + 1000).withColumn("xmax", F.col("xmax") + 1000), "a", "b")
    assert far.isEmpty()


def test_list_bounds_are_products():
    """a block's bounds cost products of matrices, not a pass over lists for each component; results are those of brute force."""
    topk_search = pytest.importorskip("quern.llm.topk_search")
    rng = np.random.default_rng(1)
    e = rng.normal(size=(8192, 64))
    x = np.floor(256 * e / np.linalg.norm(e, axis=1)[:, None]).astype(np.int64)
    asks = x[::32]
    start = time.process_time()
    got, _ = topk_search.nra_top_k(x, asks, 6)
    assert time.process_time() - start < 3.5
    for (rows, scores), q in zip(got, asks, strict=True):
        score = x @ q
        want = np.flatnonzero(score >= np.sort(score)[-6])
        assert np.array_equal(np.sort(rows), want) and np.array_equal(score[rows], scores)


def test_f1_files_of_many_shards_are_mapped_once(tmp_path, monkeypatch):
    from quern.llm import sharded

    shards = sharded.shard_number(700 * sharded.SHARD_BYTES)
    keys = np.sort(sharded.mix(np.arange(20_000, dtype=np.uint64)))
    where = sharded.shard_of(keys, shards)
    for s in range(shards):
        sharded.write_sorted(str(tmp_path), "t", s, key=keys[where == s], n=np.flatnonzero(where == s))
    maps, plain = [], sharded._mapped
    monkeypatch.setattr(sharded, "_mapped", lambda path: maps.append(path) or plain(path))
    table = sharded.Sorted(str(tmp_path), "t", shards, ("n",))
    for _ in range(3):
        assert (table.get(keys)[0] == np.arange(len(keys))).all()
    assert len(maps) == len(set(maps)) == shards


def test_f1_pieces_of_text_grow_with_the_shards(monkeypatch):
    import pyarrow as pa

    from quern.llm import lm_scoring, sharded

    texts = ["a few words " * 2000] * 300
    batch = pa.record_batch({"doc_id": pa.array(range(300), pa.int64()), "held_out": pa.array([False] * 300), "text": pa.array(texts)})
    calls = {}
    for n in (4, 600):
        model, seen = lm_scoring.Model("", 3, sharded.shard_number(n * lm_scoring.SHARD_BYTES, lm_scoring.SHARD_BYTES), 1, 1, {}), []
        monkeypatch.setattr(model, "score", lambda w, docs, seen=seen: seen.append(docs) or (np.zeros(docs, np.int64),) * 2 + (np.zeros(docs),) * 2, raising=False)
        assert sum(b.num_rows for b in lm_scoring._score(model)(iter([batch]))) == sum(seen) == 300
        calls[n] = len(seen)
    assert calls[600] * 3 < calls[4]
