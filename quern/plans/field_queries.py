"""Queries of fields, coupled systems, ragged documents and inline tests, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..types import Factor
from . import systems
from .expressions import derivative, node, parse
from .fields import evaluate_rhs, initial_field, inline_tests, lift, solve_pointwise
from .more_queries import _K, _places, aggregated, evaluate, factor
from .registry import Tables, c, query


def _customers(t: Tables) -> dict[str, Factor]:
    """Numbers of customers by nation and segment and by segment, and each nation's region."""
    cust = t("customer", c("c_nationkey").cast("long").alias("n"), c("c_mktsegment").alias("s"))
    count = F.count("*").cast("double").alias("value")
    return {
        "a": Factor(cust.groupBy("n", "s").agg(count), ("n", "s")),
        "w": Factor(cust.groupBy("s").agg(count), ("s",)),
        "b": Factor(t("nation", c("n_nationkey").cast("long").alias("n"), c("n_regionkey").cast("double").alias("value")), ("n",)),
    }


@query("""SELECT c_nationkey::BIGINT AS n, c_mktsegment AS s, (CASE WHEN count(*) > 3 * n_regionkey THEN count(*) - n_regionkey ELSE 2 * count(*) END)::DOUBLE AS value
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey, c_mktsegment, n_regionkey""")
def lift_pointwise(spark, sf_dir):
    """One scalar equation at every place of a grid of nations and segments; a field over nations alone is repeated."""
    f = _customers(Tables(spark, sf_dir))
    return lift(node("ifelse", node(">", "a", node("*", 3, "b")), node("-", "a", "b"), node("*", "k", "a")), f, {"k": 2.0}).df


@query("""WITH a AS (SELECT c_nationkey::BIGINT AS n, c_mktsegment AS s, count(*) AS a, n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 4)
SELECT n, s, (4 * (a - b) + w)::DOUBLE AS value FROM a JOIN (SELECT c_mktsegment AS s, count(*) AS w FROM customer GROUP BY 1) USING (s)""")
def shape_promotion(spark, sf_dir):
    """Equations without declared shapes get those of what they read, through a chain of two."""
    f = _customers(Tables(spark, sf_dir))
    return solve_pointwise({"scaled": parse("4 * gap + w"), "gap": parse("a - b")}, f)["scaled"].df.select("n", "s", "value")


@query("""SELECT o_orderkey, o_totalprice AS u, o_custkey::DOUBLE AS v, -0.5 * o_totalprice + o_custkey AS d_u, CASE WHEN o_totalprice > 1000 THEN o_totalprice - o_custkey ELSE 0.0 END AS d_v FROM orders""")
def rates_at_states(spark, sf_dir):
    """Right-hand sides at the states of a table: one projection."""
    states = Tables(spark, sf_dir)("orders", "o_orderkey", c("o_totalprice").alias("u"), c("o_custkey").cast("double").alias("v"))
    return evaluate_rhs(states, {"u": parse("-0.5 * u + v"), "v": node("ifelse", node(">", "u", 1000), node("-", "u", "v"), 0.0)})


@query("SELECT p_partkey, 0.125 * p_size - 0.25 * p_partkey + (2 * p_partkey + 1) AS rate FROM part")
def coupled_rates(spark, sf_dir):
    """Two models composed into one, an algebraic variable eliminated, and the sum's rate at each row of a table."""
    models = {"A": {"x": parse("-0.25 * x + b")}, "B": {"x": parse("0.125 * z")}}
    rhs = systems.flatten(models, [{"type": "operator_compose", "systems": ["A", "B"]}])
    rhs = systems.eliminate({"b": parse("a + 1"), "a": node("*", 2, "A.x")}, rhs)
    states = Tables(spark, sf_dir)("part", "p_partkey", c("p_partkey").cast("double").alias("A.x"), c("p_size").cast("double").alias("z"))
    return evaluate_rhs(states, rhs).select("p_partkey", c("`d_A.x`").alias("rate"))


@query("SELECT o_orderkey, o_totalprice / 2 AS half, o_totalprice / 2 + o_totalprice AS both FROM orders")
def observed_chain(spark, sf_dir):
    """Observed variables recovered along a table in dependency order."""
    o = Tables(spark, sf_dir)("orders", "o_orderkey", c("o_totalprice").alias("u"))
    return systems.observed(o, {"both": parse("half + u"), "half": parse("u / 2")}).select("o_orderkey", "half", "both")


@query("SELECT l_orderkey, l_linenumber, 2 * l_quantity * l_linenumber + 3 AS dx, l_quantity * l_quantity AS dy FROM lineitem")
def derivative_columns(spark, sf_dir):
    """Symbolic derivatives as columns."""
    line = Tables(spark, sf_dir)("lineitem", "l_orderkey", "l_linenumber", c("l_quantity").alias("x"), c("l_linenumber").cast("double").alias("y"))
    e = parse("x^2 * y + 3 * x")
    got = evaluate_rhs(line, {"x": derivative(e, "x"), "y": derivative(e, "y")})
    return got.select("l_orderkey", "l_linenumber", c("d_x").alias("dx"), c("d_y").alias("dy"))


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS j, 0.5 * n_nationkey + (CASE WHEN n_regionkey >= 2 THEN 1.0 ELSE 0.25 * n_regionkey END) AS value FROM nation")
def initial_fields(spark, sf_dir):
    """First values of a field by an expression of its coordinates."""
    grid = Tables(spark, sf_dir)("nation", c("n_nationkey").cast("long").alias("i"), c("n_regionkey").cast("long").alias("j"))
    e = node("+", node("*", "dx", "x"), node("ifelse", node(">=", "y", 2), 1.0, node("*", 0.25, "y")))
    return initial_field(e, grid, ["i", "j"], {"x": c("i").cast("double"), "y": c("j").cast("double")}, {"dx": 0.5}).df


@query(f"SELECT ({_K})::BIGINT AS i, coalesce(sum(floor(o_totalprice)), 0)::DOUBLE AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def doc_ragged(spark, sf_dir):
    """A document's fold over a ragged range: each customer's own orders, gathered from a table of members."""
    t = Tables(spark, sf_dir)
    cust, n = _places(t("customer"), "c_custkey")
    low = t("customer").agg(F.min("c_custkey")).first()[0]
    own = t("orders", (c("o_custkey") - (low - 1)).cast("long").alias("p"), c("o_orderkey").alias("o"))
    members = own.select("p", F.row_number().over(Window.partitionBy("p").orderBy("o")).cast("long").alias("k"), c("o").alias("value"))
    factors = {
        "length": Factor(own.groupBy("p").agg(F.count("*").alias("value")), ("p",)),
        "member": Factor(members, ("p", "k")),
        "price": factor(t("orders"), "o", c("o_orderkey"), c("o_totalprice")),
    }
    total = aggregated(node("floor", node("index", "price", "o")), {"i": "custs", "o": {"from": "own", "of": "i"}}, ["i"])
    return evaluate(spark, "total", {"custs": n, "own": {"kind": "ragged", "offsets": "length", "values": "member"}}, {}, {"total": total}, factors)


@query("""WITH f AS (SELECT n_nationkey AS x, coalesce(max(c_acctbal), 0.0) AS v FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),
t(test, expected, actual) AS (
  SELECT 0, 9000.0, max(v) FROM f UNION ALL SELECT 1, 0.0, min(v) FROM f UNION ALL SELECT 2, 5000.0, (SELECT v FROM f WHERE x = 7) UNION ALL SELECT 3, 1.0, NULL UNION ALL SELECT 4, 1.0, NULL)
SELECT test::BIGINT AS test, 'u' AS variable, CASE WHEN test = 4 THEN 2.0 ELSE 0.0 END::DOUBLE AS time, expected::DOUBLE AS expected, actual::DOUBLE AS actual,
  coalesce(CASE test WHEN 0 THEN abs(actual - expected) <= 0.2 * greatest(abs(expected), abs(actual)) WHEN 1 THEN abs(actual - expected) <= 50 ELSE abs(actual - expected) <= 1e-6 * greatest(abs(expected), abs(actual)) END, false) AS passed FROM t""")
def inline_assertions(spark, sf_dir):
    """A document's inline tests of a field: reductions, a sample at coordinates, an ambiguous one and one without records."""
    t = Tables(spark, sf_dir)
    top = t("customer").groupBy(c("c_nationkey").alias("x")).agg(F.max("c_acctbal").alias("v"))
    field = t("nation", c("n_nationkey").alias("x")).join(top, "x", "left").select(F.lit(0.0).alias("t"), F.lit("u").alias("variable"), F.coalesce("v", F.lit(0.0)).alias("value"), "x")
    at = lambda **more: {"variable": "u", "time": 0.0, "expected": 1.0} | more
    tests = [at(expected=9000.0, reduce="max", tolerance={"rel": 0.2}), at(expected=0.0, reduce="min", tolerance={"abs": 50.0}), at(expected=5000.0, coords={"x": 7.2}), at(), at(time=2.0)]
    return inline_tests(field, tests, ("x",))


@query("""WITH m AS (SELECT s_suppkey AS member, 1 + s_nationkey / 25.0 AS k FROM supplier)
SELECT member, t::DOUBLE AS t, 'x' AS variable, round(CASE t WHEN 0 THEN 1.0 WHEN 0.25 THEN exp(-0.25 * k) WHEN 0.75 THEN (exp(-0.5 * k) + 1) * exp(-0.25 * k) ELSE ((exp(-0.5 * k) + 1) * exp(-0.5 * k) + 1) * exp(-0.25 * k) END, 6) AS value
FROM m, (SELECT unnest([0.0, 0.25, 0.75, 1.25]) AS t)""")
def simulate_updates(spark, sf_dir):
    """An ensemble whose state jumps at every half unit of time: solved in segments, member by member."""
    members = Tables(spark, sf_dir)("supplier", c("s_suppkey").alias("member"), (1 + c("s_nationkey") / 25.0).alias("k"))
    dose = {"interval": 0.5, "offset": 0.5, "affect": {"x": parse("x + 1")}}
    return systems.simulate(members, {"x": parse("-k * x")}, {"x": 1.0}, [0.0, 0.25, 0.75, 1.25], updates=[dose]).withColumn("value", F.round("value", 6))


@query("""WITH m AS (SELECT s_suppkey AS member, 1 + s_nationkey / 25.0 AS k FROM supplier)
SELECT member, t::DOUBLE AS t, 'x' AS variable, round((t * k) - floor(t * k + 1e-9), 5) AS value FROM m, (SELECT unnest([0.0, 0.26, 0.77]) AS t)""")
def simulate_events(spark, sf_dir):
    """A ramp that falls back to nothing whenever it reaches one: roots found within steps."""
    members = Tables(spark, sf_dir)("supplier", c("s_suppkey").alias("member"), (1 + c("s_nationkey") / 25.0).alias("k"))
    full = {"root": parse("x - 1"), "direction": "up", "affect": {"x": 0.0}}
    return systems.simulate(members, {"x": "k"}, {"x": 0.0}, [0.0, 0.26, 0.77], events=[full]).withColumn("value", F.abs(F.round("value", 5)))
