"""Queries whose plans matter at scale: contractions of many factors, long axes and boxes of mixed sizes, with their SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import arrays, exact, graphs, spatial, views
from ..operators.aggregate import aggregate
from ..shared import dropped, saved, shared_folder
from ..sources import grids
from ..streaming import deltas, refresh, stateful, versions
from ..types import SEMIRINGS, Factor
from .expressions import node
from .more_queries import aggregated, evaluate
from .registry import Tables, c, query

# --- contractions ---


@query("""SELECT c_nationkey::BIGINT AS cn, s_nationkey::BIGINT AS sn, sum(floor(l_extendedprice) * floor(s_acctbal)) AS flow FROM customer
JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def faq_chain_four(spark, sf_dir):
    """A chain of four factors from customers' nations to suppliers' nations: each join stands on a fold of the one before."""
    t = Tables(spark, sf_dir)
    cust = Factor(t("customer", c("c_nationkey").cast("long").alias("cn"), c("c_custkey").alias("k"), F.lit(1.0).alias("value")), ("cn", "k"))
    orders = Factor(t("orders", c("o_custkey").alias("k"), c("o_orderkey").alias("o"), F.lit(1.0).alias("value")), ("k", "o"))
    line = Factor(t("lineitem", c("l_orderkey").alias("o"), c("l_suppkey").alias("s"), F.floor("l_extendedprice").cast("double").alias("value")), ("o", "s"))
    supp = Factor(t("supplier", c("s_suppkey").alias("s"), c("s_nationkey").cast("long").alias("sn"), F.floor("s_acctbal").cast("double").alias("value")), ("s", "sn"))
    return aggregate([cust, orders, line, supp], ["cn", "sn"], SEMIRINGS["sum_product"], name="flow")


@query("""WITH b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem),
t AS (SELECT DISTINCT l_suppkey AS s, o_custkey AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
u AS (SELECT DISTINCT o_custkey AS k, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT c_nationkey::BIGINT AS nation, sum(1.0) AS triangles FROM u JOIN b ON b.p = u.p JOIN t ON t.s = b.s AND t.k = u.k JOIN customer ON c_custkey = u.k GROUP BY 1""")
def faq_triangle(spark, sf_dir):
    """Triangles of parts, suppliers and customers over three tables, by the customer's nation: a cyclic core joined in one exchange."""
    t = Tables(spark, sf_dir)
    line = t("lineitem", c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"))
    # Joined once for two factors. Pairs are made distinct in ranges, so that what lies together goes to the core together, of a million rows, which a task holds.
    bought = saved(line.join(t("orders", "o_orderkey", c("o_custkey").alias("k")), "o_orderkey").drop("o_orderkey"), "bought", tidy=True)
    one, n = F.lit(1.0).alias("value"), max(spark.sparkContext.defaultParallelism, line.count() // 1_000_000)
    pairs = lambda df, *axes: Factor(df.select(*axes).repartitionByRange(n, *axes).distinct().select(*axes, one), axes)
    supplies, serves, buys = pairs(line, "p", "s"), pairs(bought, "k", "s"), pairs(bought, "k", "p")
    home = Factor(t("customer", c("c_custkey").alias("k"), c("c_nationkey").cast("long").alias("nation"), one), ("k", "nation"))
    out = aggregate([supplies, serves, buys, home], ["nation"], SEMIRINGS["sum_product"], name="triangles")
    dropped(bought)  # The core has written its factors.
    return out


@query("""WITH n AS (SELECT c_nationkey AS n, c_custkey % 40 + 1 AS k, sum(floor(c_acctbal)) AS v FROM customer GROUP BY 1, 2),
o AS (SELECT o_custkey % 40 + 1 AS k, o_orderkey % 60 + 1 AS m, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2),
l AS (SELECT l_orderkey % 60 + 1 AS m, l_suppkey % 30 + 1 AS s, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
f AS (SELECT a.n::BIGINT + 1 AS i, l.s::BIGINT AS l, 0.5 * sum(a.v * o.v * l.v) AS value FROM n a JOIN o USING (k) JOIN l USING (m) GROUP BY 1, 2)
SELECT i, l, coalesce(value, 0.0) AS value FROM (SELECT unnest(range(1, 26)) AS i) CROSS JOIN (SELECT unnest(range(1, 31)) AS l) LEFT JOIN f USING (i, l)""")
def doc_chain(spark, sf_dir):
    """A document whose equation is a product of three arrays over four symbols: contracted symbol by symbol, none multiplied out."""
    t = Tables(spark, sf_dir)
    place = lambda key, n: (c(key) % n + 1).cast("long")
    a = t("customer").groupBy((c("c_nationkey") + 1).cast("long").alias("i"), place("c_custkey", 40).alias("j")).agg(F.sum(F.floor("c_acctbal")).cast("double").alias("value"))
    b = t("orders").groupBy(place("o_custkey", 40).alias("j"), place("o_orderkey", 60).alias("k")).agg(F.count("*").cast("double").alias("value"))
    d = t("lineitem").groupBy(place("l_orderkey", 60).alias("k"), place("l_suppkey", 30).alias("l")).agg(F.sum("l_quantity").cast("double").alias("value"))
    at = lambda name, *s: node("index", name, *s)
    flow = aggregated(node("*", 0.5, at("a", "i", "j"), node("*", at("b", "j", "k"), at("d", "k", "l"))), {"i": "p", "j": "q", "k": "r", "l": "s"}, ["i", "l"])
    factors = {"a": Factor(a, ("i", "j")), "b": Factor(b, ("j", "k")), "d": Factor(d, ("k", "l"))}
    return evaluate(spark, "flow", {"p": 25, "q": 40, "r": 60, "s": 30}, {"a": ["p", "q"], "b": ["q", "r"], "d": ["r", "s"]}, {"flow": flow}, factors)


@query("""WITH v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS c FROM embeddings),
m AS (SELECT l_partkey % 64 + 1 AS c, l_suppkey % 64 + 1 AS k, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2)
SELECT vec_id::BIGINT + 1 AS r, k::BIGINT AS k, sum(floor(256 * x::DOUBLE) * y)::DOUBLE AS value FROM v JOIN m USING (c) GROUP BY 1, 2""")
def matmul_embeddings(spark, sf_dir):
    """All embeddings times a 64 x 64 matrix of sums: dense products of packed blocks after one exchange."""
    t = Tables(spark, sf_dir)
    vectors = t("embeddings", (c("vec_id") + 1).cast("long").alias("r"), F.posexplode("embedding").alias("c", "x")).select("r", (c("c") + 1).cast("long").alias("c"), F.floor(256 * c("x").cast("double")).cast("double").alias("value"))
    m = t("lineitem").groupBy((c("l_partkey") % 64 + 1).cast("long").alias("c"), (c("l_suppkey") % 64 + 1).cast("long").alias("k")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return arrays.matmul(Factor(vectors, ("r", "c")), Factor(m, ("c", "k"))).df


# --- graphs ---


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity + b.l_quantity >= 98 AND a.l_suppkey <> b.l_suppkey),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT node::BIGINT AS node, least(node, coalesce(min(x.b), node))::BIGINT AS component FROM (SELECT a AS node FROM e UNION SELECT b FROM e) LEFT JOIN (SELECT r.a, r.b FROM r JOIN r q ON q.a = r.b AND q.b = r.a) x ON x.a = node GROUP BY node""")
def strong_components(spark, sf_dir):
    """Strong components of suppliers, one after another in orders of large quantities."""
    line = Tables(spark, sf_dir)("lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    after = line.select("l_orderkey", (c("l_linenumber") - 1).alias("l_linenumber"), c("l_suppkey").alias("b"), c("l_quantity").alias("q"))
    e = line.join(after, ["l_orderkey", "l_linenumber"]).where((c("l_quantity") + c("q") >= 98) & (c("l_suppkey") != c("b")))
    return graphs.strong_components(e.select(c("l_suppkey").cast("long").alias("a"), c("b").cast("long").alias("b")))


# --- long axes, mixed boxes ---


@query("""WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS i, sum(l_quantity) AS q FROM lineitem GROUP BY 1), w AS (SELECT *, lag(q, 40, 0.0) OVER o AS far, lag(q, 1, 0.0) OVER o AS near, lead(q, 3, 0.0) OVER o AS ahead FROM a WINDOW o AS (ORDER BY i))
SELECT i::BIGINT AS i, 0.5 * far - near + 2.0 * q + 0.25 * ahead AS value FROM w""")
def stencil_long_axis(spark, sf_dir):
    """Neighbours 40 before to 3 after along all line items as one axis: ranges with halos, no window without partitions."""
    axis = Tables(spark, sf_dir)("lineitem", (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("i"), "l_quantity").groupBy("i").agg(F.sum("l_quantity").cast("double").alias("q"))
    return arrays.stencil(axis, [], "i", "q", {-40: 0.5, -1: -1.0, 0: 2.0, 3: 0.25}).select("i", "value")


@query("""WITH a AS (SELECT o_orderkey AS a, o_totalprice AS x, o_custkey::DOUBLE AS y, CASE WHEN o_orderkey % 500 = 0 THEN 20000.0 ELSE 2.0 END AS w FROM orders),
b AS (SELECT c_custkey AS b, c_acctbal * 20 AS x, c_custkey::DOUBLE AS y, 3.0 * power(10, c_custkey % 4) AS w FROM customer)
SELECT a, count(*)::BIGINT AS n, sum(b)::BIGINT AS ids FROM a JOIN b ON a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.w / 100 AND b.y <= a.y + a.w / 100 GROUP BY 1""")
def overlap_mixed_sizes(spark, sf_dir):
    """Boxes whose extents differ by ten thousand times on both sides: each stands in four cells of its own level."""
    t, n = Tables(spark, sf_dir), lambda x, y, w: [x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + w / 100).alias("ymax")]
    a = t("orders", c("o_orderkey").alias("a"), *n(c("o_totalprice"), c("o_custkey").cast("double"), F.when(c("o_orderkey") % 500 == 0, 20000.0).otherwise(2.0)))
    b = t("customer", c("c_custkey").alias("b"), *n(c("c_acctbal") * 20, c("c_custkey").cast("double"), 3.0 * F.pow(F.lit(10.0), c("c_custkey") % 4)))
    return spatial.overlap_join(a, b, "a", "b").groupBy("a").agg(F.count("*").alias("n"), F.sum("b").alias("ids"))


# --- grids ---


@query("""WITH g AS (SELECT dayofyear(ts)::BIGINT AS day, user_id % 24 + 1 AS slot, sum(floor(value)) AS total FROM events GROUP BY 1, 2)
SELECT day, slot::BIGINT AS slot, CASE WHEN g.total IS NULL THEN 'NaN'::DOUBLE ELSE g.total::DOUBLE END AS total FROM (SELECT unnest(range(5, 21)) AS day) CROSS JOIN (SELECT unnest(range(7, 25)) AS slot) LEFT JOIN g USING (day, slot)""")
def grid_zarr(spark, sf_dir):
    """Sums by day and slot written as a Zarr array of 10 x 8 cells a chunk, and a box of it read back: of 111 chunks 6 are opened."""
    at = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
    sums = Tables(spark, sf_dir)("events").groupBy(F.dayofyear("ts").cast("long").alias("day"), (c("user_id") % 24 + 1).cast("long").alias("slot")).agg(F.sum(F.floor("value")).cast("double").alias("total"))
    grids.write_zarr(sums, at, "total", {"day": 366, "slot": 24}, {"day": 10, "slot": 8})
    return grids.read_zarr(spark, at, "total").where((c("day") >= 5) & (c("day") <= 20) & (c("slot") > 6))


# --- views ---


@query("""SELECT 40.0 * least(floor(value / 40), 11) AS x, 500.0 * least(floor(user_id / 500.0), 11) AS y, avg(session) AS value FROM (SELECT value, user_id, event_id % 7 AS session FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-20 12:00:00' AND user_id <= 900)
WHERE value BETWEEN 0 AND 480 AND user_id BETWEEN 0 AND 6000 GROUP BY 1, 2""")
def domain_heatmap(spark, sf_dir):
    """A domain's part of all events as the data of a heat map: filters on times and places reach the scan, bins fold in every task."""
    events = Tables(spark, sf_dir)("events", "ts", "user_id", "value", (c("event_id") % 7).alias("session"))
    part = views.domain(events, {"temporal": {"start": "2024-01-08T00:00:00Z", "end": "2024-01-20T12:00:00Z"}, "spatial": {"user": {"max": 900}}}, "ts", {"user": "user_id"})
    wide = part.withColumn("y", c("user_id").cast("double"))
    cells = views.plot_data(wide, {"type": "heatmap", "x": {"variable": "value"}, "y": {"variable": "y"}, "value": {"variable": "session"}}, bins=12, bounds={"value": (0.0, 480.0), "y": (0.0, 6000.0)})
    return cells


# --- versions and ticks ---


@query("""WITH a AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_partkey % 40 = 0 AND p_size < 20), z AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_partkey % 3 = 0),
s AS (SELECT b, row_number() OVER (ORDER BY b) AS pos FROM a UNION ALL SELECT b, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY b) FROM (SELECT b FROM z EXCEPT SELECT b FROM a))
SELECT b AS member, pos::BIGINT AS pos, (SELECT count(*) FROM part WHERE p_brand = b)::BIGINT AS n, (SELECT count(*) FROM a)::BIGINT AS before FROM s""")
def set_remesh(spark, sf_dir):
    """An index set of brands that grows in its second version: places stay, what depends on it is rebuilt, the first version is still there."""
    part = Tables(spark, sf_dir)("part", c("p_brand").alias("member"), "p_partkey", "p_size")
    brands = versions.VersionedSet(spark, f"{shared_folder(spark)}/brands-{uuid.uuid4().hex}")
    brands.depends("counts", lambda members: members.join(part, "member").groupBy("member").agg(F.count("*").alias("n")))
    brands.remesh(0, part.where("p_partkey % 40 = 0 and p_size < 20"))
    brands.remesh(1, part.where("p_partkey % 3 = 0"))
    return brands.at(1).join(brands.dependant("counts", 1), "member").withColumn("before", F.lit(brands.at(0).count()).cast("long"))


@query("""WITH k AS (SELECT unnest([100.0, 400.0, 650.0, 5000.0])::DOUBLE AS tick), r AS (SELECT user_id, tick, event_id, event_type, row_number() OVER (PARTITION BY user_id, tick ORDER BY event_id DESC) AS n FROM events JOIN k ON event_id <= tick)
SELECT user_id, tick, event_id, event_type FROM r WHERE n = 1""")
def output_ticks(spark, sf_dir):
    """Every user's last event at four ticks: one row a user and tick goes through the window, whatever the number of events."""
    events = Tables(spark, sf_dir)("events", "user_id", "event_id", "event_type")
    return versions.snapshots(events, ["user_id"], "event_id", [100.0, 400.0, 650.0, 5000.0], "event_id", "event_type")


# --- streams ---


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, value - 245 AS x, lag(value - 245) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE (p < 0 AND x >= 0) OR (p > 0 AND x <= 0)")
def event_stream(spark, sf_dir):
    """Crossings found on a stream: five micro-batches of later and later events, the stream stopped and started again between them."""
    at, parts = f"{shared_folder(spark)}/event-stream-{uuid.uuid4().hex}", 5
    events = Tables(spark, sf_dir)("events", "user_id", "event_id", (c("value") - 245).alias("x"))
    lo, hi = events.agg(F.min("event_id"), F.max("event_id")).first()
    for k in range(parts):
        events.where(F.floor((c("event_id") - lo) * parts / (hi - lo + 1)) == k).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        stateful.append_now(stateful.crossings(stream, ["user_id"], "event_id", "x"), f"{at}/out", f"{at}/log")
    return spark.read.parquet(f"{at}/out").select("user_id", "event_id")


@query("""SELECT CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS nation, count(*)::BIGINT AS n, sum(x)::DOUBLE AS total, min(x)::DOUBLE AS least, max(x)::DOUBLE AS most
FROM (SELECT o_custkey, floor(CASE WHEN o_orderkey % 10 = 0 THEN 2 * o_totalprice ELSE o_totalprice END) AS x FROM orders WHERE o_orderkey % 15 <> 0) JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def refresh_deltas(spark, sf_dir):
    """Folds over orders and customers as both change: three micro-batches, of which the second corrects prices and moves customers, the third takes orders away."""
    at, t = f"{shared_folder(spark)}/deltas-{uuid.uuid4().hex}", Tables(spark, sf_dir)
    orders = t("orders", c("o_custkey").alias("k"), "o_orderkey", c("o_totalprice").alias("x"))
    cust = t("customer", c("c_custkey").alias("k"), c("c_nationkey").cast("long").alias("nation"))
    row = lambda df, side, sign: df.select(F.lit(side).alias("side"), "k", *[c(x) if x in df.columns else F.lit(None).cast(kind).alias(x) for x, kind in (("nation", "long"), ("x", "double"), ("o_orderkey", "long"))], F.lit(sign).alias("sign"))
    tenth, moved, gone = orders.where("o_orderkey % 10 = 0"), cust.where("k % 7 = 0"), orders.where("o_orderkey % 15 = 0")
    price = F.when(c("o_orderkey") % 10 == 0, 2 * c("x")).otherwise(c("x"))
    batches = [
        [row(orders, "left", 1), row(cust, "right", 1)],
        [row(tenth, "left", -1), row(tenth.withColumn("x", 2 * c("x")), "left", 1), row(moved, "right", -1), row(moved.withColumn("nation", F.lit(0).cast("long")), "right", 1)],
        [row(gone.withColumn("x", price), "left", -1)],
    ]
    folds = {"n": ("count", None), "total": ("sum", "y"), "least": ("min", "y"), "most": ("max", "y")}
    view = deltas.JoinedView(spark, f"{at}/view", {"k": "long", "o_orderkey": "long", "x": "double"}, {"k": "long", "nation": "long"}, {"nation": "long"}, folds, lambda df: df.withColumn("y", F.floor("x").cast("double")), buckets=16)

    def apply(batch, number):
        view.refresh(number, batch.where("side = 'left'"), batch.where("side = 'right'")).write.format("noop").mode("overwrite").save()

    for parts in batches:
        for part in parts:
            part.write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(parts[0].schema).parquet(f"{at}/in")
        refresh.on_refresh(stream, apply, f"{at}/log").awaitTermination()
    return view.current()


@query("SELECT l_returnflag, fsum(l_extendedprice) AS total FROM lineitem GROUP BY 1")
def sum_exact(spark, sf_dir):
    """Sums over three hot groups that are exact until they are rounded once, partial in every task."""
    return exact.exact_sum(Tables(spark, sf_dir)("lineitem", "l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", "total")
