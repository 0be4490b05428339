"""What the findings of round 4 showed, on small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import elimination, hypercube
from quern.plans import catalogue
from quern.shared import TIDY, saved
from quern.types import SEMIRINGS


def test_scalar_ieee_to_the_bit(spark, tmp_path):
    """zero over zero has the bits of SQL's NaN; with a sign, DuckDB writes it as -nan."""
    rows = [(1, 5.0, 0.0), (2, 0.0, 0.0), (3, -5.0, -0.0), (4, 7.0, 0.05), (5, 7.0, 0.1), (6, 3.0, 0.01)]
    df = spark.createDataFrame([(k, 1, 1000 * x, d, 1.0) for k, x, d in rows], "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_quantity double")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"SELECT * FROM ({catalogue.SQL['scalar_ieee']}) ORDER BY l_orderkey").to_arrow_table()
    got = catalogue.QUERIES["scalar_ieee"](spark, str(tmp_path)).orderBy("l_orderkey").toArrow()
    for name in ("q", "z", "lg", "l10"):
        a, b = (t[name].to_numpy().view(np.int64) for t in (got, want))
        assert np.array_equal(a, b), name
    text = "SELECT l_orderkey, q::VARCHAR, z::VARCHAR, lg::VARCHAR, l10::VARCHAR FROM {} ORDER BY 1"
    assert con.execute(text.format("got")).fetchall() == con.execute(text.format("want")).fetchall()


SIDES = ("xy", "yz", "xz")
ALGEBRA = elimination.Algebra(SEMIRINGS["sum_product"])


def sides(copies, far=1000):
    """Three tables of pairs, repeated with shifted keys."""
    rng = np.random.default_rng(7)
    own = [np.unique(rng.integers(0, 60, (700, 2)), axis=0) for _ in SIDES]
    return [np.concatenate([x + far * k for k in range(copies)]) for x in own]


def factors(spark, tables, as_text=()):
    for e, rows in zip(SIDES, tables, strict=True):
        df = spark.createDataFrame([(*map(int, r), 1.0) for r in rows], [*e, "__v"])
        yield frozenset(e), df.withColumns({v: F.col(v).cast("string") for v in e if v in as_text})


def by_x(tables):
    """Triangles of each x."""
    xy, yz, xz = [{tuple(map(int, r)) for r in t} for t in tables]
    beside, out = {}, {}
    for y, z in yz:
        beside.setdefault(y, set()).add(z)
    for x, y in xy:
        n = sum((x, z) in xz for z in beside.get(y, ()))
        out[x] = out.get(x, 0) + n
    return {x: n for x, n in out.items() if n}


def test_rows_sent_to_cells_grow_with_the_rows(spark):
    """eight times the rows, with keys that lie apart, go to eight times the places, not to the square root of eight times more."""
    sent = []
    for copies in (1, 8):
        parts = list(factors(spark, sides(copies)))
        grid = hypercube.choose_grid(parts, 1, cell_rows=600)
        n = 0
        for axes, df in parts:
            blocks, start, _ = grid.places(sorted(axes))
            own = grid.own(df.toArrow(), sorted(axes))
            at = np.minimum(np.searchsorted(blocks, own), len(blocks) - 1)
            n += int(np.where(blocks[at] == own, start[at + 1] - start[at], 0).sum())
        sent.append(n / sum(df.count() for _, df in parts))
    assert 1.0 < sent[0] and sent[1] < 1.5 * sent[0]


@pytest.mark.parametrize("as_text", ["", "y", "xyz"])
def test_ranges_and_hashes_give_all_triangles(spark, as_text):
    """numbers are cut into ranges, text by hash; either gives what brute force gives, negative keys and keys that meet nothing included."""
    tables = sides(3, far=-500)
    tables[0] = np.concatenate([tables[0], [[10**12, 5], [-(10**15), 7], [3, 10**9]]])
    out = hypercube.join_core(list(factors(spark, tables, as_text)), frozenset("x"), ALGEBRA, cell_rows=300)
    assert {int(r["x"]): r[1] for r in out.collect()} == by_x(tables)


def test_a_core_without_a_common_cell_is_empty(spark):
    """no block of one side meets one of another."""
    xy, yz, xz = sides(1)
    parts = list(factors(spark, [xy, yz + 10**6, xz]))
    assert hypercube.join_core(parts, frozenset("x"), ALGEBRA, cell_rows=300).count() == 0


@pytest.mark.parametrize("keep", ["", "x", "xy"])
def test_waves_give_what_one_exchange_gives(spark, monkeypatch, keep):
    """where keys don't lie together, cells go in waves that are folded one by one."""
    monkeypatch.setattr(hypercube, "WAVE_ROWS", 1000)
    monkeypatch.setattr(hypercube, "WAVE_TIMES", 1)
    made = []
    monkeypatch.setattr(hypercube, "saved", lambda df, name, **k: made.append(name) or saved(df, name, **k))
    tables = sides(1)
    got = hypercube.join_core(list(factors(spark, tables)), frozenset(keep), ALGEBRA, cell_rows=300).collect()
    assert made.count("wave") > 1 and sum(r["__v"] for r in got) == sum(by_x(tables).values())
    assert len({tuple(r)[:-1] for r in got}) == len(got)
    if keep == "x":
        assert {r["x"]: r["__v"] for r in got} == by_x(tables)


def test_blocks_keep_their_rows():
    """whole numbers travel as distances from the least, whatever they are."""
    import pyarrow as pa

    for keys in ([5], [-(2**63), 2**63 - 1], [-3, 252], [7, 7 + 2**32], [2**62, 2**62 + 70_000]):
        for kind in (pa.int64(), pa.int32(), pa.int16()):
            if any(not -(2 ** (kind.bit_width - 1)) <= k < 2 ** (kind.bit_width - 1) for k in keys):
                continue
            rows = pa.table({"a": pa.array(keys, kind), "b": pa.array([str(k) for k in keys]), "__v": pa.array([0.5 * k for k in keys])})
            assert hypercube._read(pa.py_buffer(hypercube._written(rows)), rows.schema).equals(rows)


def test_tidy_writing_leaves_the_session_as_it_was(spark):
    """what is written needs no shuffle files any more, and later queries keep theirs."""
    before = spark.conf.get(TIDY, None)
    out = saved(spark.range(100).repartition(5, "id"), "tidy", tidy=True)
    assert spark.conf.get(TIDY, None) == before and out.count() == 100
