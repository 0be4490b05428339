import math

import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.functions import canonical, closed
from quern.functions.scalar import OPS, op


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_ieee_results(spark):
    one, zero, nan = F.lit(1.0), F.lit(0.0), F.lit(math.nan)
    got = value(spark, op("/", one, zero), op("/", -one, zero), op("/", zero, zero), op("log", zero), op("log", -one), op("log10", F.lit(1000.0)), op("==", nan, nan), op("!=", nan, one), op(">", nan, one), op("min", one, nan), op("floor", F.lit(math.inf)), op("ceil", F.lit(-1.5)))
    assert got[:2] == (math.inf, -math.inf) and math.isnan(got[2]) and got[3] == -math.inf and math.isnan(got[4]) and got[5] == 3.0
    assert got[6:9] == (False, True, False) and math.isnan(got[9]) and got[10] == math.inf and got[11] == -1.0


def test_every_operator_checks_arity():
    for name, o in OPS.items():
        if o.least:
            with pytest.raises(QuernError, match="arity"):
                op(name, *[F.lit(1.0)] * (o.least - 1))
    with pytest.raises(QuernError, match="unknown_op"):
        op("grad", 1)


#: Instants and their fields: second, minute, hour, day, month, year, day of year, Julian day, leap year.
INSTANTS = [(0.0, 0, 0, 0, 1, 1, 1970, 1, 2440587.5, 0), (951_782_400.0, 0, 0, 0, 29, 2, 2000, 60, 2451603.5, 1), (-1.0, 59, 59, 23, 31, 12, 1969, 365, 2440587.499988426, 0), (4_107_542_399.5, 59, 59, 23, 28, 2, 2100, 59, 2488128.499994213, 0)]


@pytest.mark.parametrize("row", INSTANTS)
def test_calendar(spark, row):
    names = "second minute hour day month year day_of_year julian_day is_leap_year".split()
    got = value(spark, *[closed.call(f"datetime.{n}", F.lit(row[0])) for n in names])
    assert got[:7] == row[1:8] and math.isclose(got[7], row[8], rel_tol=0, abs_tol=1e-8) and got[8] == row[9]


def test_interpolation(spark):
    f, nan = F.lit, F.lit(math.nan)
    xs = [1, 2, 2, 5]
    assert value(spark, *[closed.call("interp.searchsorted", f(x), xs) for x in (0.5, 1.0, 2.0, 3.0, 5.0, 6.0)], closed.call("interp.searchsorted", nan, xs)) == (1, 1, 2, 4, 4, 5, 5)
    got = value(spark, *[closed.call("interp.linear", [10, 20, 40], [0, 1, 3], f(x)) for x in (-1.0, 0.0, 0.5, 2.0, 3.0, 9.0)], closed.call("interp.linear", [1, 2], [0, 1], nan))
    assert got[:6] == (10.0, 10.0, 15.0, 30.0, 40.0, 40.0) and math.isnan(got[6])
    assert value(spark, closed.call("interp.bilinear", [[1, 2], [3, 5]], [0, 1], [0, 1], f(0.5), f(0.5)), closed.call("interp.bilinear", [[1, 2], [3, 5]], [0, 1], [0, 1], f(7.0), f(-7.0))) == (2.75, 3.0)
    for bad in ([1.0], [1.0, 1.0], [2.0, 1.0], [0.0, math.nan]):
        with pytest.raises(QuernError, match="interp_axis"):
            closed.call("interp.linear", [0] * len(bad), bad, f(1.0))
    with pytest.raises(QuernError, match="unknown_closed_function"):
        closed.call("interp.cubic")
    with pytest.raises(QuernError, match="arity"):
        closed.call("datetime.year")


def test_function_tables(spark):
    t = closed.FunctionTable({"a": [0, 1, 2]}, {"y": [5, 6, 9]}, "nearest")
    assert value(spark, t.lookup("y", a=F.lit(0.5)), t.lookup("y", a=F.lit(1.6))) == (5.0, 9.0)
    strict = closed.FunctionTable({"a": [0, 1]}, {"y": [5, 6]}, bounds="error")
    with pytest.raises(Exception, match="table_out_of_bounds"):
        value(spark, strict.lookup("y", a=F.lit(3.0)))


def test_canonical_text():
    cases = {1.0: "1.0", 0.1: "0.1", -0.0: "-0.0", 1e16: "10000000000000000.0", 1e21: "1e21", 1.5e-7: "0.00000015", 1e-8: "1e-8", 123456.75: "123456.75"}
    for x, text in cases.items():
        assert canonical.float_text(x) == text and float(text) == x


def test_canonical_sets(spark):
    df = spark.createDataFrame([(2, "b"), (1, "é"), (2, "b"), (10, "a")], "i long, s string")
    assert canonical.set_json(df, "i").first()[0] == "[1,2,10]"
    assert canonical.set_json(df, "s", "i").first()[0] == '[["a",10],["b",2],["é",1]]'
