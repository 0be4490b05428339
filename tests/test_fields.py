"""Fields, rates, inline tests and segmented runs on small cases."""

import math

import numpy as np
import pytest

from quern.errors import QuernError
from quern.plans import fields, systems
from quern.plans.expressions import node, parse
from quern.types import Factor


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def parts(spark):
    u = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0)], "i long, j long, value double")
    return {"u": Factor(u, ("i", "j")), "v": Factor(spark.createDataFrame([(1, 10.0), (2, 20.0)], "j long, value double"), ("j",))}


def test_lift_joins_narrow_fields_many_to_one(parts):
    assert rows(fields.lift(parse("v - k * u"), parts, {"k": 2.0}).df) == [(1, 1, 8.0), (1, 2, 16.0), (2, 1, 4.0), (2, 2, 12.0)]


def test_lift_repeats_over_axes_that_no_field_has(spark, parts):
    got = fields.lift("v", parts, axes=("j", "k"), sets={"k": spark.range(2).withColumnRenamed("id", "k")})
    assert rows(got.df) == [(1, 0, 10.0), (1, 1, 10.0), (2, 0, 20.0), (2, 1, 20.0)]
    with pytest.raises(QuernError, match="shape_promotion"):
        fields.lift(parse("k + 1"), parts, {"k": 1.0})


def test_shapes_pass_on_to_readers():
    shapes = fields.promoted({"b": parse("2 * a"), "a": parse("v + u"), "c": 3.0}, {"u": ("i", "j"), "v": ("j",)})
    assert shapes["a"] == shapes["b"] == ("i", "j") and shapes["c"] == ()
    with pytest.raises(QuernError, match="shape_promotion"):
        fields.promoted({"s": parse("u + 1")}, {"u": ("i", "j"), "s": ("i",)})
    with pytest.raises(QuernError, match="cycle"):
        fields.promoted({"a": "b", "b": "a"}, {})


def test_names_below_index_are_not_pointwise():
    assert fields.pointwise(node("+", "u", node("index", "w", 1), node("*", "u", "k"))) == ["u", "k"]


def test_rates_refuse_unknown_names(spark):
    with pytest.raises(QuernError, match="undefined_name"):
        fields.evaluate_rhs(spark.range(1), {"x": parse("id + missing")})


def test_error_reductions_and_tolerances(spark):
    t = spark.createDataFrame([(1.0, "u", 3.0, 3.0, 1), (1.0, "u", 5.0, 4.0, 2)], "t double, variable string, value double, reference double, x long")
    base = {"variable": "u", "time": 1.0}
    tests = [base | {"expected": 0.2, "reduce": "L2_error"}, base | {"expected": 1.5, "reduce": "Linf_error", "tolerance": {"abs": 0.4, "rel": 0.5}}, base | {"expected": 5.0, "coords": {"x": 9}}, base | {"expected": 4.0, "reduce": "mean", "tolerance": {"abs": 0.0}}]
    got = {r["test"]: (r["actual"], r["passed"]) for r in fields.inline_tests(t, tests, ("x",)).collect()}
    assert got == {0: (0.2, True), 1: (1.0, True), 2: (5.0, True), 3: (4.0, True)}
    with pytest.raises(QuernError, match="assertion"):
        fields.inline_tests(t, [base | {"expected": 0.0, "reduce": "median"}], ("x",))
    with pytest.raises(QuernError, match="assertion"):
        fields.inline_tests(t, [base | {"expected": 0.0, "coords": {"y": 1}}], ("x",))


def test_segments_stop_at_jumps():
    got = systems.segmented(lambda t, y: -y, np.array([1.0]), [0.0, 1.0, 2.0], [(1.0, lambda t, y: y + 1), (5.0, lambda t, y: y * 0)])
    one = math.exp(-1) + 1
    assert np.allclose(got[:, 0], [1.0, one, one * math.exp(-1)], rtol=1e-7)


def test_updates_hold_only_where_their_condition_does(spark):
    members = spark.createDataFrame([(0, 0.0), (1, 5.0)], "member long, level double")
    dose = {"times": [0.5], "when": node(">", "level", 1), "affect": {"x": parse("x + level")}}
    got = rows(systems.simulate(members, {"x": 0.0}, {"x": 1.0}, [0.0, 1.0], updates=[dose]))
    assert got == [(0, 0.0, "x", 1.0), (0, 1.0, "x", 1.0), (1, 0.0, "x", 1.0), (1, 1.0, "x", 6.0)]
    with pytest.raises(QuernError, match="undefined_name"):
        systems.simulate(members, {"x": 0.0}, {}, [0.0, 1.0], updates=[{"times": [0.5], "affect": {"y": 1.0}}])
