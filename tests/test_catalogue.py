"""Every query of the catalogue against DuckDB on the smallest tables, and the plans that should never hold a nested loop."""

import math

import duckdb
import pytest

from quern.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or a == b or math.isclose(a, b, rel_tol=1e-8, abs_tol=1e-9)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: [f"{x:.6g}" if isinstance(x, float) else repr(x) for x in r])


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = ordered(tuple(r[c] for c in cols) for r in df.collect())
    result = con.execute(catalogue.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = ordered(tuple(dict(zip(names, r))[c] for c in cols) for r in result.fetchall())
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b)), (got[:3], want[:3])


#: Plans that hold a product: with one row (a fold without keys, an assertion's value), of a few places a side, or of two sets that a dense result is over.
PRODUCTS = {"doc_chain", "inline_assertions", "field_reduce_simple", "field_reduce_errors", "stencil_2d", "makearray_regions", "array_transpose", "array_reshape", "array_concat", "broadcast_align", "conservative_regrid"}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - PRODUCTS))
def test_plans_hold_no_nested_loop(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.QUERIES["ingest_select_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(p_partkey,11)" in plan and "p_retailprice" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
