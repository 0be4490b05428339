"""Strong components and blocked products against loops."""

import random

import pytest

from quern.operators import arrays, graphs
from quern.types import Factor


def by_closure(edges):
    nodes = sorted({x for e in edges for x in e})
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 35), (2, 30, 60), (3, 12, 60), (4, 40, 44)])
def test_strong_components_equal_a_closure(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    # A long ring, entered and left, and a chain.
    edges += [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(5, 100), (104, 7), (200, 201), (201, 202), (300, 300)]
    df = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in graphs.strong_components(df).collect()}
    assert got == by_closure(edges)


def test_strong_components_of_text_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "c"), ("c", "b"), ("c", "a")], "s string, t string")
    assert {(r.node, r.component) for r in graphs.strong_components(df, "s", "t").collect()} == {("b", "b"), ("c", "b"), ("a", "a")}
    assert graphs.strong_components(df.where("false"), "s", "t").collect() == []


@pytest.mark.parametrize("block", [(4096, 512), (3, 512), (4, 2), (1, 1)])
def test_blocked_products_equal_loops(spark, block):
    rng = random.Random(str(block))
    a = [(rng.randint(1, 11), rng.randint(1, 9), float(rng.randint(-5, 5))) for _ in range(50)] + [(2, 2, None), (None, 1, 1.0)]
    b = [(rng.randint(1, 9), rng.randint(1, 4), float(rng.randint(-5, 5))) for _ in range(14)] + [(3, None, 2.0)]
    want = {}
    for r, c, x in a:
        for d, k, y in b:
            if c == d and None not in (r, k, x, y):
                want[r, k] = want.get((r, k), 0.0) + x * y
    factors = Factor(spark.createDataFrame(a, "r long, c long, value double"), ("r", "c")), Factor(spark.createDataFrame(b, "c long, k long, value double"), ("c", "k"))
    assert {(r.r, r.k): r.value for r in arrays.matmul(*factors, block=block).df.collect()} == want
    none = Factor(factors[0].df.where("false"), ("r", "c"))
    assert arrays.matmul(none, factors[1], block=block).df.collect() == []


def test_a_narrow_product_takes_one_exchange(spark):
    f = Factor(spark.range(1, 50).selectExpr("id as r", "id % 7 + 1 as c", "1.0D as value"), ("r", "c"))
    plan = arrays.matmul(f, f.named("c", "k"), inner=7).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
