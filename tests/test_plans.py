import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.plans import document, systems, tools
from quern.plans.expressions import canonical, check_arity, column, derivative, expand_templates, free_variables, jacobian, node, numeric, parse, rewrite, simplify, substitute, to_latex, to_text
from quern.types import Factor

LEAF = st.one_of(st.integers(-9, 9), st.sampled_from(["x", "y"]))
TREE = st.recursive(LEAF, lambda s: st.one_of(st.builds(lambda o, a, b: node(o, a, b), st.sampled_from(["+", "-", "*", "max", "min"]), s, s), st.builds(lambda o, a: node(o, a), st.sampled_from(["neg", "sin", "abs", "exp"]), s)), max_leaves=8)
AT = {"x": 0.7, "y": -1.3}


def close(a, b):
    return math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=150, deadline=None)
@given(TREE)
def test_rewrites_keep_the_value(e):
    want = float(numeric(e, AT))
    for f in (canonical, simplify, lambda t: parse(to_text(t)), lambda t: substitute(t, {"z": 1})):
        assert close(float(numeric(f(e), AT)), want)
    assert canonical(canonical(e)) == canonical(e)


@settings(max_examples=60, deadline=None)
@given(TREE.filter(lambda e: not {"max", "min", "abs"} & set(str(e).split("'"))))
def test_derivatives_are_slopes(e):
    h = 1e-6
    slope = (float(numeric(e, AT | {"x": 0.7 + h})) - float(numeric(e, AT | {"x": 0.7 - h}))) / (2 * h)
    d = float(numeric(derivative(e, "x"), AT))
    if math.isfinite(slope) and abs(slope) < 1e5:
        assert math.isclose(d, slope, rel_tol=1e-3, abs_tol=1e-3)


def test_columns_and_numpy_agree(spark):
    texts = ["x / 0", "log(0 - 1)", "ifelse(x > y and not (y > 0), x^2, 3)", "max(x, y, 0.5) - floor(y)", "(x > 0) + 1", "atan2(x, y) * sign(y)"]
    got = spark.range(1).select(*[column(parse(t), {k: F.lit(v) for k, v in AT.items()}).cast("double").alias(f"c{i}") for i, t in enumerate(texts)]).first()
    assert all(close(a, float(numeric(parse(t), AT))) for a, t in zip(got, texts, strict=True))


def test_expression_tools():
    e = parse("a * u[i, j] + b")
    assert free_variables(e) == {"a", "u", "i", "j", "b"} and to_text(e) == "a * u[i, j] + b"
    assert substitute({"op": "aggregate", "args": [], "ranges": {"i": [1, 3]}, "expr": node("+", "i", "k")}, {"i": 9, "k": 5})["expr"]["args"] == ["i", 5]
    rules = [(node("D2", "?f"), node("D1", node("D1", "?f")), 1)]
    assert rewrite(node("+", node("D2", "u"), 1), rules) == node("+", node("D1", node("D1", "u")), 1)
    with pytest.raises(QuernError, match="nonterminating"):
        rewrite("x", [("x", node("neg", "x"), 0)])
    templates = {"sq": {"params": ["a"], "body": node("^", "a", 2)}, "quad": {"params": ["b"], "body": {"op": "apply_expression_template", "args": [], "name": "sq", "bindings": {"a": {"op": "apply_expression_template", "args": [], "name": "sq", "bindings": {"a": "b"}}}}}}
    assert numeric(expand_templates({"op": "apply_expression_template", "args": [], "name": "quad", "bindings": {"b": "x"}}, templates), {"x": 3.0}) == 81
    for bad, code in ((node("max", 1), "arity"), (node("call", 1), "retired"), ({"op": "+", "args": []}, "arity")):
        with pytest.raises(QuernError, match=code):
            check_arity(bad)
    with pytest.raises(QuernError, match="parse"):
        parse("x +")
    with pytest.raises(QuernError, match="unlowered"):
        column(node("grad", 1.0), {})
    assert to_latex(parse("x / y")) == r"\frac{x}{y}"
    assert set(jacobian({"x": parse("x * y"), "y": parse("y")})) == {("x", "x"), ("x", "y"), ("y", "x"), ("y", "y")}


def agg(expr, ranges, out=(), **more):
    return {"op": "aggregate", "args": [], "output_idx": list(out), "ranges": ranges, "expr": expr, **more}


def model(equations, sets=None, **doc):
    return {"index_sets": sets or {}, "models": {"M": {"variables": {}, "equations": [{"lhs": k, "rhs": v} for k, v in equations.items()]}}, **doc}


def values(spark, equations, name, sets=None, factors=None, **doc):
    return sorted(tuple(r) for r in document.Evaluator(spark, model(equations, sets, **doc), "M", factors).evaluate(name).collect())


def test_document_joins_and_filters(spark):
    sets = {"a": {"kind": "categorical", "members": ["coal", "coal", "oil"]}, "b": {"kind": "categorical", "members": ["coal", "coal", "gas"]}, "n": {"kind": "interval", "size": 4}}
    e = {
        "count": agg(1.0, {"i": {"from": "a"}, "j": {"from": "b"}}, join=[{"on": [["i", "j"]]}]),
        "named": agg(1.0, {"i": {"from": "a"}, "j": {"from": "b"}}, join=[{"on": [["a", "b"]]}]),
        "sums": agg(parse("i * j"), {"i": {"from": "n"}, "j": [1, 3]}, ["i"], filter=parse("j <= i")),
        "none": agg(1.0, {"i": {"from": "n"}, "j": [5, 4]}, ["i"], semiring="min_sum"),
        "any": agg(parse("j > 3"), {"i": [1, 2], "j": [1, "i"]}, ["i"], semiring="bool_and_or"),
        "prod": agg("j", {"j": [1, 2, 7]}, reduce="*"),
        "old": {**agg(1.0, {"i": {"from": "n"}}), "op": "arrayop"},
    }
    get = lambda n: values(spark, e, n, sets)
    assert get("count") == get("named") == [(4.0,)]
    assert get("sums") == [(1, 1.0), (2, 6.0), (3, 18.0), (4, 24.0)]
    assert get("none") == [(i, math.inf) for i in range(1, 5)]
    with pytest.raises(QuernError, match="boolean_array"):
        get("any")
    assert get("prod") == [(105.0,)] and get("old") == [(4.0,)]


def test_document_value_invention(spark):
    rows = [(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 2), (2, 2, 3), (2, 3, 4)]
    corner = Factor(spark.createDataFrame([(f, k, float(v)) for f, k, v in rows], "f long, k long, value double"), ("f", "k"))
    after = Factor(spark.createDataFrame([(f, k, float(rows[(f - 1) * 3 + k % 3][2])) for f, k, _ in rows], "f long, k long, value double"), ("f", "k"))
    sets = {"faces": {"kind": "interval", "size": 2}, "edges": {"kind": "derived", "from_faq": "make"}, "pts": {"kind": "interval", "size": 4}, "gens": {"kind": "interval", "size": 3}}
    e = {
        "exists": agg(True, {"f": {"from": "faces"}, "k": [1, 3]}, ["e"], semiring="bool_and_or", distinct=True, id="make", key=node("skolem", node("index", "corner", "f", "k"), node("index", "after", "f", "k"), symmetric=True)),
        "ones": agg(1.0, {"e": {"from": "edges"}}, ["e"]),
        "assign": {"op": "argmin", "args": [], "output_idx": ["p"], "arg": "g", "ranges": {"p": {"from": "pts"}, "g": {"from": "gens"}}, "expr": node("abs", node("-", "p", node("*", 2, node("-", "g", 1))))},
        "grouped": agg("p", {"g": {"from": "gens"}, "p": {"from": "pts"}}, ["g"], filter=node("==", node("index", "assign", "p"), "g")),
    }
    get = lambda n: values(spark, e, n, sets, {"corner": corner, "after": after})
    assert [p for p, _ in get("ones")] == [1, 2, 3, 4, 5]
    assert get("assign") == [(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0)] and get("grouped") == [(1, 1.0), (2, 5.0), (3, 4.0)]


def test_document_arrays_and_closed_functions(spark):
    a = {"op": "const", "args": [], "value": [[1, 2, 3], [4, 5, 6]]}
    e = {
        "a": a, "t": node("transpose", "a"), "r": node("reshape", "a", shape=[3, 2]), "c": node("concat", "a", "a", axis=1), "b": node("broadcast", "a", "a", fn="*"), "n": node("broadcast", "a", fn="neg"),
        "m": {"op": "makearray", "args": [], "regions": [[[1, 3]], [[2, 2]]], "values": [0.0, 7.0]},
        "s": node("index", "t", 3, 1), "y": {"op": "fn", "args": [node("const", value=[10, 20]), node("const", value=[0, 1]), 0.25], "name": "interp.linear"}, "e": node("enum", "kind", "high"),
        "loop": node("+", "loop", 1),
    }
    get = lambda n: values(spark, e, n, enums={"kind": {"low": 0, "high": 3}})
    assert get("s") == [(3.0,)] and get("r")[:3] == [(1, 1, 1.0), (1, 2, 5.0), (2, 1, 4.0)] and len(get("c")) == 12
    assert get("b")[-1] == (2, 3, 36.0) and get("n")[0] == (1, 1, -1.0) and get("m") == [(1, 0.0), (2, 7.0), (3, 0.0)]
    assert get("y") == [(12.5,)] and get("e") == [(3,)]
    with pytest.raises(QuernError, match="cycle"):
        get("loop")
    with pytest.raises(QuernError, match="undefined_name"):
        get("nothing")


def test_document_ragged_sets(spark):
    sets = {"cells": {"kind": "interval", "size": 2}, "of_cell": {"kind": "ragged", "of": ["cells"], "offsets": "n", "values": "which"}}
    n = Factor(spark.createDataFrame([(1, 2.0), (2, 1.0)], "c long, value double"), ("c",))
    which = Factor(spark.createDataFrame([(1, 1, 3), (1, 2, 1), (2, 1, 2)], "c long, k long, value long"), ("c", "k"))
    area = Factor(spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "e long, value double"), ("e",))
    e = {"total": agg(node("index", "area", "e"), {"c": {"from": "cells"}, "e": {"from": "of_cell", "of": ["c"]}}, ["c"])}
    assert values(spark, e, "total", sets, {"n": n, "which": which, "area": area}) == [(1, 40.0), (2, 20.0)]


def test_documents_round_trip():
    doc = model({"x": parse("1 + 2")})
    assert document.load(document.save(document.load(doc))) == document.load(doc)


def test_reactions(spark):
    r = [{"rate": "k1", "substrates": {"A": 2}, "products": {"B": 1}}, {"rate": "k2", "substrates": {"B": 1, "C": 1}, "products": {"A": 1, "C": 1}}]
    rhs = systems.mass_action(r)
    at = {"k1": 0.5, "k2": 0.25, "A": 5.0, "B": 25.0, "C": 3.0}
    assert {s: float(numeric(e, at)) for s, e in rhs.items()} == {"A": -6.25, "B": -6.25, "C": 0.0} and "C" not in systems.mass_action(r, {"C"})
    rates = systems.reaction_rates(systems.stoichiometry(spark, r), spark.createDataFrame([(1, 0.5), (2, 0.25)], "reaction long, rate double"), spark.createDataFrame([("A", 5.0), ("B", 25.0), ("C", 3.0)], "species string, amount double"))
    assert {x.species: x.change for x in rates.collect()} == {"A": -6.25, "B": -6.25, "C": 0.0}


def test_coupling():
    models = {"A": {"x": parse("k * x"), "f": 1.0}, "B": {"x": parse("-0.5 * x")}}
    flat = systems.flatten(models, [{"type": "operator_compose", "systems": ["A", "B"]}])
    assert float(numeric(flat["A.x"], {"k": 2.0, "A.x": 3.0})) == 4.5 and "B.x" not in flat
    mapped = systems.flatten({"A": {"x": parse("2")}, "B": {"y": node("*", "B.p", 1.5)}}, [{"type": "variable_map", "from": "A.x", "to": "B.p", "transform": "conversion_factor", "factor": 10.0}])
    assert float(numeric(mapped["B.y"], {"A.x": 2.0})) == 30.0
    added = systems.flatten({"A": {"x": 1.0}}, [{"type": "couple", "connector": [{"to": "A.x", "transform": "multiplicative", "expression": 5.0}]}])
    assert float(numeric(added["A.x"], {})) == 5.0
    done = systems.eliminate({"v": parse("2 * w"), "w": parse("x + 1")}, {"x": parse("-v")})
    assert float(numeric(done["x"], {"x": 3.0})) == -8.0
    with pytest.raises(QuernError, match="E_NONTRIVIAL_DAE"):
        systems.eliminate({"v": "w", "w": "v"}, {})


def test_units():
    assert math.isclose(systems.convert_units("km/h", "m/s"), 1 / 3.6) and math.isclose(systems.convert_units("ug/m3", "kg/m^3"), 1e-9) and math.isclose(systems.convert_units("ton/yr", "kg/s"), 907.18474 / 31557600)
    with pytest.raises(QuernError, match="unit_dimensions"):
        systems.convert_units("m", "s")
    with pytest.raises(QuernError, match="unit"):
        systems.unit("furlong")
    with pytest.raises(QuernError, match="unit_dimensions"):
        systems.check_units(parse("a + b"), {"a": "m", "b": "s"})
    assert systems.check_units(parse("a * a / b"), {"a": "m", "b": "s"}) == systems.unit("m^2/s")[1]


def test_graphs(spark):
    eq = {"b": parse("a * k"), "y": parse("b + a")}
    nodes, edges = systems.expression_graph(spark, eq)
    assert {tuple(r) for r in edges.collect()} == {("a", "b"), ("k", "b"), ("b", "y"), ("a", "y")} and nodes.count() == 4
    assert '"a" -> "b";' in systems.to_dot(["a", "b"], [("a", "b")]) and "n0 --> n1" in systems.to_mermaid(["a", "b"], [("a", "b")])
    assert systems.strong_components({"a": {"b"}, "b": {"c"}, "c": {"a"}, "d": {"a"}}) == [["d"], ["a", "b", "c"]]


def test_integration():
    y = systems.integrate(lambda t, y: np.array([y[1], -y[0]]), np.array([1.0, 0.0]), [0.0, math.pi / 2, math.pi])
    assert np.allclose(y[:, 0], [1, 0, -1], atol=1e-6)
    stiff = systems.integrate(lambda t, y: -1000 * (y - math.cos(t)), np.array([0.0]), [0.0, 1.0], rtol=1e-6, atol=1e-8, stiff=True)
    assert math.isclose(stiff[-1][0], math.cos(1), rel_tol=2e-3)
    ball = systems.integrate(lambda t, y: np.array([y[1], -9.81]), np.array([10.0, 0.0]), [0.0, 0.998492, 2.0], events=[(lambda t, y: y[0], "down", lambda t, y: [0.0, -0.8 * y[1]])])
    assert math.isclose(ball[1][0], 5.109782, rel_tol=1e-4) and ball[2][0] > 0


def test_ensembles(spark):
    members = systems.sweep(spark, {"k": systems.linear_range(1, 2, 3), "s": systems.log_range(0.1, 1, 2)})
    assert members.count() == 6
    got = {(r.member, r.t): r.value for r in systems.simulate(members, {"x": parse("-k * x")}, {"x": 2.0}, [0.0, 1.0]).collect()}
    assert math.isclose(got[(5, 1.0)], 2 * math.exp(-2), rel_tol=1e-6)
    noisy = lambda: sorted(map(tuple, systems.simulate(members, {"x": parse("-k * x")}, {"x": 1.0}, [0.0, 0.5], noise={"x": parse("s")}, seed=3, steps=20).collect()))
    assert noisy() == noisy()
    wide = spark.createDataFrame([(1.0, 2.0)], "t double, x double")
    assert systems.observed(wide, {"z": parse("y + 1"), "y": parse("2 * x * c")}, {"c": 3.0}).first().z == 13.0
    for bad, init in ((parse("-q * x"), {}), (parse("x"), {"w": 1.0})):
        with pytest.raises(QuernError):
            systems.simulate(members, {"x": bad}, init, [0.0, 1.0])


def test_document_gates_and_nodes(spark):
    point = lambda rows, axis: Factor(spark.createDataFrame([(i, float(v)) for i, v in enumerate(rows, 1)], f"{axis} long, value double"), (axis,))
    sets = {"a": {"kind": "interval", "size": 3}, "b": {"kind": "interval", "size": 3}}
    factors = {"ax": point([0, 5, 9], "i"), "ay": point([0, 0, 0], "i"), "bw": point([-1, 4, 4], "k"), "bs": point([-1, -1, 5], "k"), "be": point([1, 6, 6], "k"), "bn": point([1, 1, 6], "k")}
    variables = {n: {"type": "parameter", "shape": ["a" if n[0] == "a" else "b"]} for n in factors}
    over = {"overlap": {"src_env": ["ax", "ay"], "tgt_env": ["bw", "bs", "be", "bn"]}}
    both = {"i": {"from": "a"}, "j": {"from": "b"}}

    def run(e, **doc):
        d = model({"y": e}, sets, **doc)
        d["models"]["M"]["variables"] = variables
        return sorted(tuple(r) for r in document.Evaluator(spark, d, "M", dict(factors)).evaluate("y").collect())

    assert run(agg(1.0, both, ["i"], join=[over])) == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert run(agg(1.0, both, ["j"], join=[over])) == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert run(agg(1.0, both, join=[{"overlap": {**over["overlap"], "eps": 10.0}}])) == [(9.0,)]
    for bad, code in (({"overlap": {"src_env": ["ax", "ay"]}}, "join_overlap"), ({"on": [["i", "j"]], **over}, "join_clause"), ({"near": []}, "join_clause"), ({"overlap": {**over["overlap"], "eps": -1}}, "join_overlap"), ({"overlap": {"src_env": ["nothing", "ay"], "tgt_env": ["bw", "bs"]}}, "undefined_name")):
        with pytest.raises(QuernError, match=code):
            run(agg(1.0, both, join=[bad]))
    # A symbol bound by an equality, directly or by a factor, and inside an argmin that admits nothing for one place.
    assert run(agg(1.0, both, ["i"], filter=node("==", "j", node("+", "i", 1)))) == [(1, 1.0), (2, 1.0), (3, 0.0)]
    assert run(agg("j", both, ["i"], filter=node("and", node("==", node("index", "bw", "j"), node("-", node("index", "ax", "i"), 1)), node(">", "j", 2)))) == [(1, 0.0), (2, 3.0), (3, 0.0)]
    nearest = {"op": "argmin", "args": [], "arg": "j", "ranges": {"j": {"from": "b"}}, "expr": node("abs", node("-", node("index", "ax", "i"), node("index", "bw", "j")))}
    assert run(agg(nearest, {"i": {"from": "a"}}, ["i"])) == [(1, 1.0), (2, 2.0), (3, 2.0)]
    with pytest.raises(Exception, match="empty_argmin"):
        run(agg({**nearest, "filter": node(">", "j", node("+", "i", 1))}, {"i": {"from": "a"}}, ["i"]))
    tables = {"T": {"axes": [{"name": "p", "values": [0.0, 10.0]}], "outputs": ["u"], "data": [[1.0, 2.0]], "out_of_bounds": "error"}}
    look = {"op": "table_lookup", "args": [], "table": "T", "axes": {"p": node("index", "ax", "i")}, "output": 0}
    assert run(agg(look, {"i": {"from": "a"}}, ["i"]), function_tables=tables) == [(1, 1.0), (2, 1.5), (3, 1.9)]
    with pytest.raises(QuernError, match="unknown_table"):
        run(agg({**look, "table": "U"}, {"i": {"from": "a"}}, ["i"]))


def test_document_prefixes(spark):
    sets = {"x": {"kind": "interval", "size": 6}, "g": {"kind": "interval", "size": 2}}
    u = Factor(spark.createDataFrame([(g, i, float(g * 10 + i)) for g in (1, 2) for i in range(1, 7)], "g long, i long, value double"), ("g", "i"))
    for op_, turned, keep in (("<=", ">=", lambda j, i: j <= i), ("<", ">", lambda j, i: j < i), (">=", "<=", lambda j, i: j >= i), (">", "<", lambda j, i: j > i)):
        for test in (node(op_, "j", "i"), node(turned, "i", "j")):
            e = {"one": agg(node("index", "u", 1, "j"), {"i": {"from": "x"}, "j": {"from": "x"}}, ["i"], filter=test), "two": agg(node("index", "u", "h", "j"), {"h": {"from": "g"}, "i": {"from": "x"}, "j": {"from": "x"}}, ["h", "i"], semiring="max_sum", filter=test)}
            assert values(spark, e, "one", sets, {"u": u}) == [(i, float(sum(10 + j for j in range(1, 7) if keep(j, i)))) for i in range(1, 7)]
            assert values(spark, e, "two", sets, {"u": u}) == [(h, i, max((h * 10.0 + j for j in range(1, 7) if keep(j, i)), default=-math.inf)) for h in (1, 2) for i in range(1, 7)]
    e = {"one": agg(node("index", "u", 1, "j"), {"i": {"from": "x"}, "j": {"from": "x"}}, ["i"], filter=node("<=", "j", "i"))}
    plan = document.Evaluator(spark, model(e, sets), "M", {"u": u}).evaluate("one")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_document_polygons(spark):
    square = lambda x, y, s: {"op": "const", "args": [], "value": [[x, y], [x + s, y], [x + s, y + s], [x, y + s]]}
    e = {
        "a": square(0.0, 0.0, 2.0), "b": square(1.0, 1.0, 2.0), "area": {"op": "polygon_intersection_area", "manifold": "planar", "args": ["a", "b"]},
        "clip": {"op": "intersect_polygon", "id": "cut", "manifold": "planar", "args": ["a", "b"]},
        "twice": agg(node("-", node("*", node("index", "clip", "v", 1), node("index", "clip", node("+", "v", 1), 2)), node("*", node("index", "clip", node("+", "v", 1), 1), node("index", "clip", "v", 2))), {"v": {"from": "ring"}}),
        "unnamed": {"op": "polygon_intersection_area", "args": ["a", "b"]},
    }
    sets = {"ring": {"kind": "derived", "from_faq": "cut"}}
    assert values(spark, e, "area", sets) == [(1.0,)] and values(spark, e, "twice", sets) == [(2.0,)] and len(values(spark, e, "clip", sets)) == 10
    with pytest.raises(QuernError, match="manifold"):
        values(spark, e, "unnamed", sets)


def test_left_sides_as_documents_write_them():
    ranges = {"i": {"from": "x"}}
    d = {"index_sets": {"x": {"kind": "interval", "size": 3}}, "models": {"M": {"variables": {"u": {"type": "unknown", "shape": ["x"]}}, "equations": [
        {"lhs": {"op": "aggregate", "args": [], "output_idx": ["i"], "ranges": ranges, "expr": node("D", node("index", "u", "i"))}, "rhs": agg(node("index", "u", "i"), ranges, ["i"])},
        {"lhs": node("ic", "u"), "rhs": parse("exp(-x)")},
    ]}}}
    assert document.defined_name(d["models"]["M"]["equations"][0]["lhs"]) == "u"
    assert tools.validate(d) == []
    d["models"]["M"]["equations"][0]["rhs"] = node("index", "w", "i")
    assert tools.validate(d) == ["[undefined_name] M: w"]
