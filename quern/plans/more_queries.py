"""Queries of documents as their users write them, of ragged sets, minted keys and graphs, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.aggregate import aggregate, prefix, ragged
from ..types import SEMIRINGS, Factor
from . import systems
from .document import Evaluator
from .expressions import node
from .registry import Tables, c, query


def factor(df: DataFrame, axis: str, key, value) -> Factor:
    """A factor over one axis, places from 1."""
    return Factor(df.select(key.cast("long").alias(axis), value.alias("value")), (axis,))


def aggregated(expr, ranges: dict, out=(), **more) -> dict:
    return {"op": "aggregate", "args": [], "output_idx": list(out), "ranges": {s: {"from": r} if isinstance(r, str) else r for s, r in ranges.items()}, "expr": expr, **more}


def evaluate(spark, name: str, sizes: dict, shapes: dict, equations: dict, factors: dict, **doc) -> DataFrame:
    """One equation of a document with interval sets of these sizes and inputs of these shapes."""
    document = {
        "index_sets": {k: v if isinstance(v, dict) else {"kind": "interval", "size": v} for k, v in sizes.items()},
        "models": {"M": {"variables": {n: {"type": "parameter", "shape": list(s)} for n, s in shapes.items()}, "equations": [{"lhs": k, "rhs": v} for k, v in equations.items()]}},
    }
    return Evaluator(spark, document | doc, "M", factors).evaluate(name)


def _places(df: DataFrame, key: str, *columns: str) -> tuple[DataFrame, int]:
    """Rows of a table with keys as places from 1, and the largest place."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    return df.select((c(key) - (lo - 1)).cast("long").alias("k"), *columns), hi - lo + 1


_K = "c_custkey - (SELECT min(c_custkey) FROM customer) + 1"


@query(f"""SELECT ({_K})::BIGINT AS i, (SELECT count(*) FROM part WHERE p_retailprice <= c_acctbal + 0.5 AND p_retailprice + 2 >= c_acctbal - 0.5 AND p_size <= c_nationkey + 0.5 AND p_size + 1 >= c_nationkey - 0.5)::DOUBLE AS value FROM customer""")
def doc_overlap(spark, sf_dir):
    """A document whose join is an overlap: customers as points, parts as boxes, both grown by a quarter."""
    t = Tables(spark, sf_dir)
    cust, n = _places(t("customer"), "c_custkey", "c_acctbal", "c_nationkey")
    part, m = _places(t("part"), "p_partkey", "p_retailprice", "p_size")
    point = {"px": factor(cust, "c", c("k"), c("c_acctbal")), "py": factor(cust, "c", c("k"), c("c_nationkey").cast("double"))}
    sides = {"w": c("p_retailprice"), "s": c("p_size").cast("double"), "e": c("p_retailprice") + 2, "n": c("p_size") + 1.0}
    count = aggregated(1.0, {"i": "custs", "j": "parts"}, ["i"], join=[{"overlap": {"src_env": ["px", "py"], "tgt_env": ["w", "s", "e", "n"], "eps": 0.25}}])
    shapes = dict.fromkeys(point, ["custs"]) | dict.fromkeys(sides, ["parts"])
    return evaluate(spark, "count", {"custs": n, "parts": m}, shapes, {"count": count}, point | {k: factor(part, "p", c("k"), v) for k, v in sides.items()})


@query("""WITH s AS (SELECT (s_suppkey - (SELECT min(s_suppkey) FROM supplier) + 1)::BIGINT AS i, floor(s_acctbal / 50) AS b, s_nationkey AS n FROM supplier)
SELECT i, (SELECT coalesce(sum(floor(c_acctbal)), 0) FROM customer WHERE floor(c_acctbal / 50) = b AND c_nationkey = n)::DOUBLE AS value FROM s""")
def doc_bin_join(spark, sf_dir):
    """A document that mints a bin key for each member of two sets and joins on the minted buffers."""
    t = Tables(spark, sf_dir)
    sup, n = _places(t("supplier"), "s_suppkey", "s_acctbal", "s_nationkey")
    cust, m = _places(t("customer"), "c_custkey", "c_acctbal", "c_nationkey")
    mint = lambda s, of, x, y: aggregated({"op": "skolem", "label": "bin", "args": [node("floor", node("/", node("index", x, s), 50)), node("index", y, s)]}, {s: of}, [s])
    equations = {
        "sbin": mint("i", "sups", "sx", "sn"),
        "cbin": mint("j", "custs", "cx", "cn"),
        "total": aggregated(node("floor", node("index", "cx", "j")), {"i": "sups", "j": "custs"}, ["i"], join=[{"on": [["sbin", "cbin"]]}]),
    }
    of = lambda df, x, k: {f"{x}x": factor(df, x, c("k"), c(f"{k}_acctbal")), f"{x}n": factor(df, x, c("k"), c(f"{k}_nationkey").cast("double"))}
    return evaluate(spark, "total", {"sups": n, "custs": m}, {}, equations, of(sup, "s", "s") | of(cust, "c", "c"))


@query(f"SELECT ({_K})::BIGINT AS i, sum(floor(c_acctbal)) OVER (ORDER BY c_custkey) AS value FROM customer")
def doc_prefix(spark, sf_dir):
    """A document's fold over j <= i, recognised as a prefix and scanned by ranges."""
    cust, n = _places(Tables(spark, sf_dir)("customer"), "c_custkey", "c_acctbal")
    run = aggregated(node("floor", node("index", "u", "j")), {"i": "x", "j": "x"}, ["i"], filter=node("<=", "j", "i"))
    return evaluate(spark, "run", {"x": n}, {"u": ["x"]}, {"run": run}, {"u": factor(cust, "k", c("k"), c("c_acctbal"))})


@query("SELECT o_orderkey, coalesce(sum(floor(o_totalprice)) OVER (ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0) AS after, max(o_totalprice) OVER (ORDER BY o_orderkey) AS peak FROM orders")
def prefix_one_axis(spark, sf_dir):
    """Strict reverse sums and running maxima over one axis of all orders: ranges scanned apart, never one task."""
    o = Tables(spark, sf_dir)("orders", "o_orderkey", "o_totalprice")
    ran = prefix(o, [], "o_orderkey", F.floor("o_totalprice").cast("double"), SEMIRINGS["sum_product"], strict=True, reverse=True, name="after")
    return prefix(ran, [], "o_orderkey", c("o_totalprice"), SEMIRINGS["max_sum"], name="peak").select("o_orderkey", "after", "peak")


@query("""WITH g AS (SELECT n_nationkey // 5 + 1 AS i, n_nationkey % 5 + 1 AS j, n_regionkey + n_nationkey AS v FROM nation),
a AS (SELECT i, j, v, k, greatest(0.0, least(i::DOUBLE, (k + 1) * 1.25) - greatest(i - 1.0, k * 1.25)) AS a FROM g, (SELECT unnest(range(4)) AS k))
SELECT (k + 1)::BIGINT AS j, sum(a * v) / sum(a) AS value FROM a GROUP BY 1""")
def doc_regrid(spark, sf_dir):
    """A document that regrids conservatively: envelopes meet in an overlap join, areas of clipped cells are weights."""
    nation = Tables(spark, sf_dir)("nation")
    corner = lambda x, y, w, h: F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.array(x + w * p, y + h * q).alias("at")) for v, (p, q) in enumerate(((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)), 1)])

    def polygons(df, name):
        v = df.select("k", F.explode(corner(c("x"), c("y"), c("w"), c("h"))).alias("p")).select("k", "p.v", F.posexplode("p.at").alias("d", "value"))
        return Factor(v.select(c("k").alias(name), c("v").alias(f"{name}v"), (c("d") + 1).cast("long").alias(f"{name}d"), "value"), (name, f"{name}v", f"{name}d"))

    place = (c("n_nationkey") + 1).cast("long")
    cells = nation.select(place.alias("k"), F.floor(c("n_nationkey") / 5).cast("double").alias("x"), (c("n_nationkey") % 5).cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))
    strips = spark.range(4).select((c("id") + 1).alias("k"), (c("id") * 1.25).alias("x"), F.lit(0.0).alias("y"), F.lit(1.25).alias("w"), F.lit(5.0).alias("h"))
    area = {"op": "polygon_intersection_area", "manifold": "planar", "args": [node("index", "src", "i"), node("index", "tgt", "j")]}
    meet = [{"overlap": {"src_env": ["src"], "tgt_env": ["tgt"]}}]
    equations = {
        "weighted": aggregated(node("*", area, node("index", "f", "i")), {"i": "cells", "j": "strips"}, ["j"], join=meet),
        "whole": aggregated(area, {"i": "cells", "j": "strips"}, ["j"], join=meet),
        "mean": aggregated(node("/", node("index", "weighted", "j"), node("index", "whole", "j")), {"j": "strips"}, ["j"]),
    }
    factors = {"src": polygons(cells, "s"), "tgt": polygons(strips, "t"), "f": Factor(nation.select(place.alias("k"), (c("n_regionkey") + c("n_nationkey")).cast("double").alias("value")), ("k",))}
    return evaluate(spark, "mean", {"cells": 25, "strips": 4}, {"src": ["cells", "v", "d"], "tgt": ["strips", "v", "d"], "f": ["cells"]}, equations, factors)


@query("""WITH d AS (SELECT (s_suppkey - (SELECT min(s_suppkey) FROM supplier) + 1)::BIGINT AS i, n_nationkey + 1 AS g, abs(s_acctbal - 400.0 * n_nationkey) AS d FROM supplier, nation)
SELECT i, min(g)::DOUBLE AS value FROM d WHERE d = (SELECT min(x.d) FROM d x WHERE x.i = d.i) GROUP BY i""")
def doc_argmin(spark, sf_dir):
    """A document's argmin inside an aggregate: the nation whose mark is nearest to each supplier's balance."""
    t = Tables(spark, sf_dir)
    sup, n = _places(t("supplier"), "s_suppkey", "s_acctbal")
    marks = factor(t("nation"), "g", c("n_nationkey") + 1, 400.0 * c("n_nationkey"))
    best = {"op": "argmin", "args": [], "arg": "g", "ranges": {"g": {"from": "nations"}}, "expr": node("abs", node("-", node("index", "x", "i"), node("index", "mark", "g")))}
    return evaluate(spark, "assign", {"sups": n, "nations": 25}, {}, {"assign": aggregated(best, {"i": "sups"}, ["i"])}, {"x": factor(sup, "s", c("k"), c("s_acctbal")), "mark": marks})


@query(f"""WITH t AS (SELECT ({_K})::BIGINT AS i, c_acctbal AS x FROM customer)
SELECT i, CASE WHEN x <= 0 THEN 1.0 WHEN x >= 5000 THEN 9.0 WHEN x < 1000 THEN 1.0 + x / 1000 * 4.0 ELSE 5.0 + (x - 1000) / 4000 * 4.0 END AS value FROM t""")
def doc_table(spark, sf_dir):
    """A document that looks its values up in one of its function tables."""
    cust, n = _places(Tables(spark, sf_dir)("customer"), "c_custkey", "c_acctbal")
    tables = {"T": {"axes": [{"name": "x", "values": [0.0, 1000.0, 5000.0]}], "outputs": ["low", "high"], "data": [[0.0, 1.0, 2.0], [1.0, 5.0, 9.0]]}}
    look = {"op": "table_lookup", "args": [], "table": "T", "axes": {"x": node("index", "u", "i")}, "output": "high"}
    return evaluate(spark, "y", {"custs": n}, {"u": ["custs"]}, {"y": aggregated(look, {"i": "custs"}, ["i"])}, {"u": factor(cust, "k", c("k"), c("c_acctbal"))}, function_tables=tables)


# --- ragged sets, minted keys, joins ---


@query("""WITH l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::BIGINT AS k, l_quantity AS q FROM lineitem)
SELECT o, k, q FROM l WHERE o IN (SELECT o_orderkey FROM orders)""")
def ragged_members(spark, sf_dir):
    """The members of a ragged set: places 1 to the length of each order, gathered from the table of lines."""
    t = Tables(spark, sf_dir)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = t("lineitem").select(c("l_orderkey").alias("o"), F.row_number().over(w).cast("long").alias("k"), c("l_quantity").alias("value"))
    lengths = Factor(lines.groupBy("o").agg(F.count("*").alias("value")), ("o",))
    return ragged(t("orders", c("o_orderkey").alias("o")), "o", lengths, Factor(lines, ("o", "k")), "k", "q").select("o", "k", "q")


@query("SELECT least(l_partkey, l_suppkey) AS lo, greatest(l_partkey, l_suppkey) AS hi, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def skolem_symmetric(spark, sf_dir):
    """A minted key of two components without order, and how many rows mint it."""
    line = Tables(spark, sf_dir)("lineitem", "l_partkey", "l_suppkey")
    minted = line.select(relational.skolem(c("l_partkey"), c("l_suppkey"), symmetric=True).alias("key"))
    return minted.groupBy("key").agg(F.count("*").alias("n")).select(c("key")[0].alias("lo"), c("key")[1].alias("hi"), "n")


@query("SELECT c_mktsegment AS member, row_number() OVER (ORDER BY c_mktsegment)::BIGINT AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_acctbal > 0)")
def index_set_members(spark, sf_dir):
    cust = Tables(spark, sf_dir)("customer", "c_mktsegment", "c_acctbal")
    return relational.index_set(cust, c("c_mktsegment"), c("c_acctbal") > 0)


@query("SELECT (p_size * 2)::BIGINT AS key, count(*)::BIGINT AS n FROM part GROUP BY 1")
def key_coercion(spark, sf_dir):
    """Whole numbers of a float column as keys."""
    part = Tables(spark, sf_dir)("part", relational.key_int(c("p_size").cast("double") * 2).alias("key"))
    return part.groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey::BIGINT AS n, coalesce(min(o_totalprice + c_acctbal), 'Infinity'::DOUBLE) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def faq_tropical(spark, sf_dir):
    """min of sums by the aggregate node: orders and customers joined over the customer, dense over their nations."""
    t = Tables(spark, sf_dir)
    o = Factor(t("orders", c("o_custkey").alias("u"), c("o_orderkey").alias("o"), c("o_totalprice").alias("a")), ("u", "o"), "a")
    u = Factor(t("customer", c("c_custkey").alias("u"), c("c_nationkey").cast("long").alias("n"), c("c_acctbal").alias("b")), ("u", "n"), "b")
    return aggregate([o, u], ["n"], SEMIRINGS["min_sum"], dense=u.df.select("n").distinct())


@query("SELECT s_name AS id, 0 AS level FROM supplier UNION ALL SELECT n_name, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END FROM nation UNION ALL SELECT r_name, 1 + max(CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END) FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def graph_table_levels(spark, sf_dir):
    """Levels of a graph built from tables: suppliers feed nations, nations feed regions."""
    t = Tables(spark, sf_dir)
    nation = t("nation")
    up = t("supplier").join(nation, c("s_nationkey") == c("n_nationkey")).select(c("s_name").alias("src"), c("n_name").alias("dst"))
    return systems.levels(up.unionByName(nation.join(t("region"), c("n_regionkey") == c("r_regionkey")).select(c("n_name").alias("src"), c("r_name").alias("dst"))))
