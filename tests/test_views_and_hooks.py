"""Domains, places on cells, data of plots, callbacks, cancelling, guards, what a document invents, and rules with shapes."""

import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.operators import views
from quern.plans.document import Evaluator
from quern.plans.expressions import node, rewrite
from quern.streaming import hooks
from quern.types import Factor


def test_a_domain_is_plain_filters(spark, tmp_path):
    rows = [(datetime(2024, 1, d), d * 1.0, d) for d in range(1, 10)] + [(None, 3.0, 3), (datetime(2024, 1, 4), None, 4)]
    spark.createDataFrame(rows, "at timestamp_ntz, lon double, i int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    got = views.domain(df, {"temporal": {"start": "2024-01-03T00:00:00Z", "end": "2024-01-07T00:00:00Z"}, "spatial": {"x": {"min": 4, "max": 6.5}}}, "at", {"x": "lon"})
    assert sorted(r.i for r in got.collect()) == [4, 5, 6]
    assert "PushedFilters: [IsNotNull(at)" in got._jdf.queryExecution().executedPlan().toString()
    assert views.domain(df, {}, "at").count() == 11
    with pytest.raises(QuernError):
        views.domain(df, {"spatial": {"depth": {"min": 0}}})


def test_locations_are_metadata(spark):
    df = views.located(spark.range(3).withColumn("u", F.lit(1.0)), "u", "edge_normal")
    assert views.location_of(df.select("u"), "u") == "edge_normal" and views.location_of(df, "id") == "cell_center"
    with pytest.raises(QuernError):
        views.located(df, "u", "attic")


def test_data_of_plots(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0, 2.0), (0.0, 3.0, 7.0, 4.0), (1.0, 5.0, None, 6.0), (2.0, 9.0, 1.0, 8.0)], "t double, a double, b double, v double")
    line = views.plot_data(df, {"type": "line", "x": {"variable": "t"}, "y": {"variable": "a"}, "series": [{"variable": "a"}, {"variable": "b"}]})
    assert {(r.series, r.x): r.y for r in line.collect()} == {("a", 0.0): 2.0, ("a", 1.0): 5.0, ("a", 2.0): 9.0, ("b", 0.0): 6.0, ("b", 1.0): None, ("b", 2.0): 1.0}
    assert views.plot_data(df, {"type": "scatter", "x": {"variable": "t"}, "y": {"variable": "a"}}).count() == 4
    heat = views.plot_data(df, {"type": "heatmap", "x": {"variable": "t"}, "y": {"variable": "a"}, "value": {"variable": "v"}}, bins=2, bounds={"t": (0.0, 2.0), "a": (0.0, 8.0)})
    assert {(r.x, r.y): r.value for r in heat.collect()} == {(0.0, 0.0): 3.0, (1.0, 4.0): 6.0}
    with pytest.raises(QuernError):
        views.plot_data(df, {"type": "pie", "x": {"variable": "t"}})


def test_callbacks_run_in_order_by_name(spark):
    @hooks.callback("test-double")
    def double(frames, config):
        return {"B": frames["A"].select((F.col("x") * config["by"]).alias("x"))}

    @hooks.callback("test-add")
    def add(frames, config):
        return {"A": frames["B"].select((F.col("x") + 1).alias("x"))}

    frames = {"A": spark.createDataFrame([(3,)], "x int"), "B": spark.createDataFrame([(0,)], "x int")}
    got = hooks.run_callbacks([{"type": "variable_map"}, {"type": "callback", "callback_id": "test-double", "config": {"by": 4}}, {"type": "operator_apply", "operator": "test-add"}], frames)
    assert (got["A"].first().x, got["B"].first().x) == (13, 12)
    with pytest.raises(QuernError, match="unknown_callback"):
        hooks.run_callbacks([{"type": "callback", "callback_id": "nobody"}], frames)
    hooks.callback("test-stray")(lambda frames, config: {"C": frames["A"]})
    with pytest.raises(QuernError, match="undefined_system"):
        hooks.run_callbacks([{"type": "callback", "callback_id": "test-stray"}], frames)


def test_progress_of_a_stream(spark, tmp_path):
    heard, seen = [], threading.Event()

    def note(name, batch, rows):
        heard.append((name, batch, rows))
        seen.set()

    listener = hooks.Progress(note)
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        stream.writeStream.queryName("told").format("noop").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        assert seen.wait(20) and ("told", 0, 5) in heard
    finally:
        spark.streams.removeListener(listener)


def test_work_is_cancelled_when_asked(spark):
    assert hooks.cancellable(spark, lambda: spark.range(10).count(), lambda: False) == 10
    slow = F.udf(lambda x: time.sleep(30) or x, "long")
    start = time.monotonic()
    with pytest.raises(QuernError, match="cancelled"):
        hooks.cancellable(spark, lambda: spark.range(2).select(slow("id")).collect(), lambda: time.monotonic() - start > 2)
    assert time.monotonic() - start < 25


def members(reads):
    """A document with a set of the values of an input, or of a state."""
    maker = {"op": "aggregate", "id": "mk", "distinct": True, "args": [], "output_idx": ["e"], "ranges": {"i": {"from": "rows"}}, "key": {"op": "skolem", "args": [node("index", reads, "i")]}, "expr": True, "semiring": "bool_and_or"}
    fold = {"op": "aggregate", "args": [], "output_idx": ["g"], "ranges": {"g": {"from": "groups"}, "i": {"from": "rows"}}, "join": [{"on": [["groups", "key"]]}], "expr": node("index", "w", "i")}
    key = {"op": "aggregate", "args": [], "output_idx": ["i"], "ranges": {"i": {"from": "rows"}}, "expr": {"op": "skolem", "args": [node("index", "k", "i")]}}
    equations = [{"lhs": "found", "rhs": maker}, {"lhs": "key", "rhs": key}, {"lhs": "total", "rhs": fold}, {"lhs": node("D", node("index", "u", "i")), "rhs": node("index", "w", "i")}, {"lhs": "v", "rhs": node("*", 2.0, "u")}]
    return {"index_sets": {"rows": {"kind": "interval", "size": 4}, "groups": {"kind": "derived", "from_faq": "mk"}}, "models": {"M": {"variables": {"k": {"shape": ["rows"]}, "w": {"shape": ["rows"]}, "key": {"shape": ["rows"]}}, "equations": equations}}}


def test_everything_that_a_document_invents(spark):
    f = lambda values: Factor(spark.createDataFrame(list(enumerate(values, 1)), "i long, value double"), ("i",))
    ev = Evaluator(spark, members("k"), "M", {"k": f([7.0, 3.0, 7.0, 3.0]), "w": f([1.0, 2.0, 3.0, 4.0])})
    got = ev.invented()
    assert got.extents == {"groups": 2} and {(r.member, r.pos) for r in got.assignments["groups"].collect()} == {(3, 1), (7, 2)}
    assert {r.g: r.value for r in got.groups["total"].df.collect()} == {1: 6.0, 2: 4.0}
    assert {r.i: r.value for r in got.join_key_buffers["key"].df.collect()} == {1: 7, 2: 3, 3: 7, 4: 3}
    seen = ev.inspect()
    assert seen["total"]["axes"] == ["g"] and "Aggregate" in seen["total"]["plan"] and seen["groups"]["kind"] == "derived" and seen["k"]["kind"] == "input"


@pytest.mark.parametrize("reads", ["u", "v"])
def test_sets_are_not_made_from_what_changes(spark, reads):
    f = lambda values: Factor(spark.createDataFrame(list(enumerate(values, 1)), "i long, value double"), ("i",))
    ev = Evaluator(spark, members(reads), "M", {"k": f([1.0] * 4), "w": f([1.0] * 4)})
    with pytest.raises(QuernError, match="continuous_relational"):
        ev.derived("groups")


def test_rules_that_ask_for_shapes():
    shapes = {"f": ["x"], "g": ["y"], "h": ["x", "y"], "k": []}
    rules = [(node("flux", "?F"), node("dx", "?F"), 1, {"F": {"shape": ["x"]}}), (node("flux", "?F"), node("dy", "?F"), 1, {"F": {"shape": ["y"]}})]
    assert rewrite(node("+", node("flux", "f"), node("flux", "g")), rules, shapes=shapes) == node("+", node("dx", "f"), node("dy", "g"))
    assert rewrite(node("flux", node("*", "f", "k")), rules, shapes=shapes) == node("dx", node("*", "f", "k"))
    for left in (node("flux", "h"), node("flux", "unknown"), node("flux", node("*", "f", "g"))):
        assert rewrite(left, rules, shapes=shapes) == left
    assert rewrite(node("flux", "h"), [*rules, (node("flux", "?F"), "?F", 0)], shapes=shapes) == "h"


def test_handlers_see_what_they_read(spark):
    @hooks.handler("test-mean")
    def mean(variables, parameters, config):
        assert set(variables) == {"u"} and set(parameters) == set()
        return variables["u"].agg((F.avg("value") * config["by"]).alias("value"))

    u = spark.createDataFrame([(1, 2.0), (2, 4.0)], "i long, value double")
    rule = {"kind": "schedule", "handler": {"handler_id": "test-mean", "read_vars": ["u"], "config": {"by": 10.0}}}
    assert hooks.handled(rule, {"u": u, "v": u}, {"k": u}).first().value == 30.0
    for bad, code in (({"handler_id": "nobody"}, "unknown_handler"), ({"handler_id": "test-mean", "read_vars": ["w"]}, "undefined_name")):
        with pytest.raises(QuernError, match=code):
            hooks.handled({"handler": bad}, {"u": u}, {})


def test_grids_go_flat_and_back(spark):
    from quern.operators import arrays

    grid = Factor(spark.createDataFrame([(i, j, 10.0 * i + j) for i in (1, 2, 3) for j in (1, 2)], "i long, j long, value double"), ("i", "j"))
    vector = arrays.flat(grid, [3, 2])
    assert {r.at: r.value for r in vector.df.collect()} == {1: 11.0, 2: 21.0, 3: 31.0, 4: 12.0, 5: 22.0, 6: 32.0}
    assert {tuple(r) for r in arrays.scattered(vector, [3, 2], ("i", "j")).df.collect()} == {tuple(r) for r in grid.df.collect()}
    with pytest.raises(Exception, match="index_out_of_range"):
        arrays.scattered(vector, [2, 2], ("i", "j")).df.collect()


def test_strict_keys_and_ordered_pairs(spark):
    from quern.operators import relational

    a = spark.createDataFrame([(2, "x"), (1, "z"), (1, "y"), (None, "n")], "k long, l string")
    b = spark.createDataFrame([(1, "q"), (1, "p"), (2, "r")], "k long, m string")
    assert [(r.k, r.l, r.m) for r in relational.equijoin(a, b, ["k"], ["k"], order=("l", "m")).collect()] == [(1, "y", "p"), (1, "y", "q"), (1, "z", "p"), (1, "z", "q"), (2, "x", "r")]
    with pytest.raises(Exception, match="null_key"):
        relational.equijoin(a, b, ["k"], ["k"], strict=True).collect()
    flags = spark.createDataFrame([(True, 1), (False, 2)], "f boolean, n int")
    assert {(r.n, r.m) for r in relational.equijoin(flags, b, ["f"], ["k"]).collect()} == {(1, "q"), (1, "p")}
