"""Contraction of many factors against loops over all combinations, the order of elimination, and the plans it gives."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import elimination, hypercube
from quern.operators.aggregate import aggregate
from quern.types import REDUCERS, SEMIRINGS, Factor

PLUS = {"sum_product": (sum, lambda a, b: a * b), "max_product": (max, lambda a, b: a * b), "min": (min, lambda a, b: a * b), "min_sum": (min, lambda a, b: a + b), "max_sum": (max, lambda a, b: a + b), "bool_and_or": (any, lambda a, b: a and b)}
BODIES = {
    "chain": (["ab", "bc", "cd", "de"], "ae"),
    "chain without ends": (["ab", "bc", "cd", "de"], ""),
    "star": (["ab", "ac", "ad"], "bd"),
    "triangle": (["ab", "bc", "ca"], ""),
    "triangle by corner": (["ab", "bc", "ca"], "b"),
    "square with tails": (["ab", "bc", "cd", "da", "ae", "cf"], "ef"),
    "inside": (["abc", "ab", "c"], "a"),
    "apart": (["ab", "cd"], "ac"),
    "scalar": (["a", "b"], ""),
    "four-clique": (["ab", "ac", "ad", "bc", "bd", "cd"], "d"),
}


def terms(axes, rng, ring, n=14):
    value = (lambda: rng.random() < 0.6) if ring == "bool_and_or" else lambda: float(rng.randint(-4, 5))
    return [(*(rng.randint(0, 3) for _ in axes), value()) for _ in range(n)]


def by_loops(bodies, out, ring):
    plus, times = PLUS[ring]
    found = {}
    for rows in itertools.product(*(t for _, t in bodies)):
        at, ok = {}, True
        for (axes, _), row in zip(bodies, rows):
            ok &= all(at.setdefault(a, x) == x for a, x in zip(axes, row))
        if ok:
            value = rows[0][-1]
            for r in rows[1:]:
                value = times(value, r[-1])
            found.setdefault(tuple(at[a] for a in out), []).append(value)
    return {k: plus(v) for k, v in found.items()}


@pytest.mark.parametrize("body", list(BODIES))
@pytest.mark.parametrize("ring", ["sum_product", "max_product"])
def test_contractions_equal_loops(spark, body, ring):
    check(spark, body, ring)


@pytest.mark.parametrize("ring", list(PLUS))
def test_every_semiring_on_a_cyclic_body(spark, ring):
    check(spark, "triangle by corner", ring)
    check(spark, "chain", ring)


def check(spark, body, ring):
    edges, out = BODIES[body]
    rng = random.Random(f"{body}{ring}")
    n = 5 if len(edges) > 4 else 14
    bodies = [(e, terms(e, rng, ring, n)) for e in edges]
    kind = "boolean" if ring == "bool_and_or" else "double"
    factors = [Factor(spark.createDataFrame(t, ", ".join(f"{a} long" for a in e) + f", value {kind}"), tuple(e)) for e, t in bodies]
    got = aggregate(factors, list(out), SEMIRINGS.get(ring) or REDUCERS[ring], name="x").collect()
    want = by_loops(bodies, out, ring)
    if not out and not want:
        want = {(): (SEMIRINGS.get(ring) or REDUCERS[ring]).zero}
    assert {tuple(r[a] for a in out): r.x for r in got} == want


def test_cyclic_cores():
    core = lambda *e: elimination.cyclic_core([frozenset(x) for x in e])
    assert core("ab", "bc", "cd") == [] and core("abc", "ab", "bc", "ca") == []
    assert core("ab", "bc", "ca") == [0, 1, 2] and core("ab", "bc", "cd", "da", "ae") == [0, 1, 2, 3]
    assert core("ax", "ab", "bc", "ca") == [1, 2, 3]


def test_the_order_folds_ends_first_and_heeds_extents():
    step = lambda edges, out, **k: elimination.next_step([frozenset(e) for e in edges], frozenset(out), **k)
    assert step(["ab", "bc"], "ac", extents={}) == ("join", [0, 1], frozenset("ac"))
    assert step(["ab", "bc", "cd"], "ad", extents={"a": 10, "b": 1e6, "c": 1e6, "d": 1e5})[1:] == ([0, 1], frozenset("ac"))
    assert step(["ab", "bc", "cd"], "ad", extents={"a": 1e5, "b": 1e6, "c": 1e6, "d": 10})[1:] == ([1, 2], frozenset("bd"))
    assert step(["ab"], "ab") is None
    assert step(["ab", "bc", "ca"], "")[0] == "core"


def test_a_chain_folds_between_its_joins(spark):
    rows = spark.range(50).select(*[(F.col("id") * k % 7).alias(a) for k, a in enumerate("abcde", 1)], F.lit(1.0).alias("value"))
    plan = aggregate([Factor(rows.select(x, y, "value"), (x, y)) for x, y in ("ab", "bc", "cd", "de")], ["a", "e"], SEMIRINGS["sum_product"])._jdf.queryExecution().optimizedPlan().toString()
    lines = [ln.strip(" :+-").split(" ")[0] for ln in plan.splitlines()]
    nodes = [n for n in lines if n in ("Aggregate", "Join")]
    # From the top: each join but the lowest stands on a fold of what is below it.
    assert nodes.count("Join") == 3 and nodes.count("Aggregate") >= 3
    assert not any(a == b == "Join" for a, b in zip(nodes, nodes[1:]))


def test_a_frequent_value_is_spread_and_text_keys_join(spark):
    rng = random.Random(3)
    r = {("hub", f"b{rng.randint(0, 40)}") for _ in range(60)} | {(f"a{rng.randint(0, 9)}", f"b{rng.randint(0, 40)}") for _ in range(60)}
    s = {(f"b{rng.randint(0, 40)}", f"c{rng.randint(0, 40)}") for _ in range(150)}
    t = {(f"c{rng.randint(0, 40)}", "hub") for _ in range(60)} | {(f"c{rng.randint(0, 40)}", f"a{rng.randint(0, 9)}") for _ in range(60)}
    want = sum((x, y) in r and (z, x) in t for y, z in s for x in {a for a, _ in r})
    alg = elimination.Algebra(SEMIRINGS["sum_product"])
    part = lambda rows, x, y: (frozenset((x, y)), spark.createDataFrame([(*p, 1.0) for p in rows], f"{x} string, {y} string, __v double"))
    parts = [part(r, "a", "b"), part(s, "b", "c"), part(t, "c", "a")]
    shares = hypercube.choose_shares(parts, 4, cell_rows=60)
    assert math.prod(shares.values()) > 4
    assert hypercube.join_core(parts, frozenset(), alg, cell_rows=60).first()[0] == want


def test_bindings_in_small_groups_are_the_same():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    alg = elimination.Algebra(SEMIRINGS["sum_product"])
    axes = [["a", "b"], ["b", "c"], ["a", "c"]]
    tables = []
    for x in axes:
        pairs = np.unique(rng.integers(0, 12, (90, 2)), axis=0)
        tables.append(pa.table({x[0]: pairs[:, 0], x[1]: pairs[:, 1], "__v": rng.random(len(pairs))}))
    got = [hypercube.join_cell(tables, axes, ["a", "b", "c"], ["b"], alg, at_once=n) for n in (1, 5, 1 << 19)]
    first = {b: v for b, v in zip(got[0]["b"].to_pylist(), got[0]["__v"].to_pylist())}
    for g in got[1:]:
        assert {b: round(v, 9) for b, v in zip(g["b"].to_pylist(), g["__v"].to_pylist())} == {b: round(v, 9) for b, v in first.items()}
    empty = hypercube.join_cell([tables[0].slice(0, 0), *tables[1:]], axes, ["a", "b", "c"], ["b"], alg)
    assert len(empty) == 0


def test_a_product_of_products_is_folded_once(spark):
    f = Factor(spark.createDataFrame([(1, 2.0), (1, 3.0)], "i long, value double"), ("i",))
    g = Factor(spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0)], "i long, j long, value double"), ("i", "j"))
    assert aggregate([f, g], [], REDUCERS["*"], name="x").first().x == 2.0 * 5 * 2 * 7 * 3 * 5 * 3 * 7


@pytest.mark.parametrize(("semiring", "times"), [("sum_product", "*"), ("max_product", "*"), ("min_sum", "+"), ("max_sum", "+")])
def test_a_document_of_a_product_of_arrays_equals_loops(spark, semiring, times):
    from quern.plans.document import Evaluator
    from quern.plans.expressions import node

    rng = random.Random(semiring)
    sizes = {"i": 3, "j": 4, "k": 5}
    value = lambda *ns: {at: float(rng.randint(-5, 5)) for at in itertools.product(*(range(1, n + 1) for n in ns))}
    a, b, c = value(3, 4), value(4, 5), value(5)
    frame = lambda d, axes: Factor(spark.createDataFrame([(*k, v) for k, v in d.items()], ", ".join(f"{x} long" for x in axes) + ", value double"), tuple(axes))
    body = node(times, 2.0, node("index", "a", "i", "j"), node(times, node("index", "b", "j", "k"), node("index", "c", "k")))
    eq = {"op": "aggregate", "args": [], "semiring": semiring, "output_idx": ["i"], "ranges": {s: {"from": f"set_{s}"} for s in sizes}, "expr": body}
    doc = {"index_sets": {f"set_{s}": {"kind": "interval", "size": n} for s, n in sizes.items()}, "models": {"M": {"variables": {}, "equations": [{"lhs": "y", "rhs": eq}]}}}
    ev = Evaluator(spark, doc, "M", {"a": frame(a, "xy"), "b": frame(b, "pq"), "c": frame(c, "z")})
    got = ev.evaluate("y")
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Join Cross" not in plan
    plus = PLUS[semiring][0]
    term = (lambda i, j, k: 2.0 * a[i, j] * b[j, k] * c[k,]) if times == "*" else (lambda i, j, k: 2.0 + a[i, j] + b[j, k] + c[k,])
    assert {r.i: r.value for r in got.collect()} == {i: plus(term(i, j, k) for j in range(1, 5) for k in range(1, 6)) for i in range(1, 4)}
