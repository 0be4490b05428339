import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.sources import readers, sinks, times
from quern.streaming import cadence, refresh


def test_formats(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"records": [{"id": 1, "at": {"x": 2.5, "y": {"z": 3}}}]}))
    assert readers.points(spark, str(tmp_path / "p.json"), root="records").columns == ["at_x", "at_y_z", "id"]
    (tmp_path / "p.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.extent(readers.read(spark, str(tmp_path / "p.csv"), "csv")) == 2
    with pytest.raises(QuernError, match="unknown_format"):
        readers.read(spark, "x", "grib")
    readers.register("rows", lambda s, path, options: s.range(int(options["n"])))
    assert readers.read(spark, "", "rows", n=3).count() == 3


def test_codes(spark):
    df = spark.createDataFrame([(1, " Gas"), (2, "OIL"), (3, "peat"), (4, None)], "i long, c string")
    get = lambda **k: sorted((r.i, r.n) for r in readers.coded(df, "c", {"gas": 1, "oil": 2}, name="n", **k).collect())
    assert get(unmapped="drop", ignore_case=True) == [(1, 1.0), (2, 2.0)] and get(unmapped=-1) == [(i, -1.0) for i in (1, 2, 3, 4)]
    with pytest.raises(Exception, match="unmapped_code"):
        get(ignore_case=True)


def test_finite_rows_and_selection(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, math.nan), (4, math.inf), (5, -2.0)], "i long, x double")
    assert [r.i for r in readers.require_finite(df, "x").orderBy("i").collect()] == [1, 5]
    pick = lambda how, gate=None: sorted(r[0] for r in readers.select_axis(df.select("i", F.col("i").alias("k")), "i", how, gate).select("k").collect())
    assert pick("all") == [1, 2, 3, 4, 5] and pick({"fixed": 1}) == [2] and pick({"range": {"start": 1, "stop": 5, "step": 2}}) == [2, 4]
    assert pick({"gated_by": "s"}, spark.createDataFrame([(5,), (9,)], "m long")) == [5]
    with pytest.raises(QuernError, match="select"):
        pick({"some": 1})


def test_periods():
    p = times.Period.parse
    assert p("P1Y2M") == times.Period(14, 0) and p("P1DT6H") == times.Period(0, 108_000)
    for bad in ("P", "1D", "PT", "P1X"):
        with pytest.raises(QuernError, match="duration"):
            p(bad)
    d = datetime
    assert times.snap(d(2024, 3, 30, 5), d(2020, 1, 31), p("P1M")) == d(2024, 2, 29)
    assert times.snap(d(2019, 12, 31, 23), d(2020, 1, 1), p("PT6H")) == d(2019, 12, 31, 18)
    assert times.file_anchors(d(2024, 1, 15), d(2024, 3, 1), d(2000, 1, 1), p("P1M")) == [d(2024, 1, 1), d(2024, 2, 1), d(2024, 3, 1)]
    assert times.records_per_file("auto", p("P1D"), p("PT1H")) == 24 and times.records_per_file(5, p("P1D"), p("PT1H")) == 5
    assert times.expand_url("a/{date:%Y%m}/{kind}.nc", d(2024, 5, 1), kind="x") == "a/202405/x.nc"


def test_month_snapping_of_columns(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 30, 5),)], "t timestamp_ntz")
    assert df.select(times.snap_column(F.col("t"), datetime(2020, 1, 1), times.Period(months=3))).first()[0] == datetime(2024, 1, 1)


def test_mirrors_and_cache(tmp_path):
    def open_(url):
        if url == "bad":
            raise OSError("down")
        return url

    assert times.first_of(["bad", "good"], open_) == "good"
    with pytest.raises(OSError):
        times.first_of(["bad"], open_)
    calls = []
    fetch = lambda url: calls.append(url) or b"data"
    assert times.cached("u/x.csv", str(tmp_path), fetch) == times.cached("u/x.csv", str(tmp_path), fetch, offline=True) and calls == ["u/x.csv"]
    with pytest.raises(QuernError, match="offline"):
        times.cached("u/y.csv", str(tmp_path), fetch, offline=True)


def test_providers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0.0, 1, 5.0), (10.0, 1, 6.0), (20.0, 1, 7.0)], "t double, i long, v double")
    p = sinks.Providers(lambda name: sinks.TableProvider(df, "t" if name == "met" else None))
    assert p["met"].refresh_times() == [0.0, 10.0, 20.0] and p["met"].refresh(15.0).first().v == 6.0 and p["met"].materialize().first().v == 5.0
    assert p["met"] is p["met"] and p["static"].refresh(3.0).count() == 3
    sink = sinks.ParquetSink(str(tmp_path / "out"), [0.0, 1.0])
    with pytest.raises(QuernError, match="sink_closed"):
        sink.write(0.0, df)
    sink.open(spark)
    for t in (0.0, 1.0, 1.0):
        sink.write(t, df.select("i", (F.col("v") + t).alias("v")))
    sink.close()
    assert sorted(r.v for r in sinks.restart_state(spark, str(tmp_path / "out")).collect()) == [6.0, 7.0, 8.0]
    assert sinks.output_plan({"u": ("x",), "w": ("x", "y"), "v": ("x",)}) == {("x",): ["u", "v"], ("x", "y"): ["w"]}


READS = {"grid": {"mesh"}, "wind": {"met", "grid"}, "flux": {"wind", "u"}, "area": {"grid"}}
SEEDS = {"mesh": "const", "met": "discrete", "u": "continuous"}


def test_cadence():
    assert cadence.classify(READS, SEEDS) == {"mesh": "const", "grid": "const", "area": "const", "met": "discrete", "wind": "discrete", "u": "continuous", "flux": "continuous"}
    assert cadence.partition(READS, SEEDS)["discrete"] == ["met", "wind"] and cadence.frontier(READS, SEEDS) == {"grid", "wind"}
    cadence.check_expected(READS, SEEDS, {"wind": "discrete"})
    for f, code in ((lambda: cadence.check_expected(READS, SEEDS, {"wind": "const"}), "expect_cadence"), (lambda: cadence.check_relational(READS, SEEDS, {"flux"}), "continuous_relational"), (lambda: cadence.check_acyclic({"a": {"b"}, "b": {"a"}}), "a -> b -> a")):
        with pytest.raises(QuernError, match=code):
            f()


def test_schedules():
    assert refresh.schedule_times(0, 10, times=[3, 99], interval=4, offset=1) == [1, 3, 5, 9]
    assert refresh.segments(0, 10, [4, 0, 12, 7]) == [(0, 4), (4, 7), (7, 10)]
    now = [0.0]
    due = refresh.every(5, lambda: now[0])
    assert not due()
    now[0] = 6
    assert due() and not due() and refresh.before_walltime(10, 5, lambda: now[0])()


def test_streams_survive_a_second_start(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double").write.parquet(at("in"))
    fold = lambda: {r.k: r.s for r in refresh.fold_stream(spark, at("in"), "k string, v double", ["k"], {"s": F.col("v")}, at("out"), at("log")).collect()}
    assert fold() == {"a": 1.0, "b": 2.0}
    spark.createDataFrame([("a", 5.0)], "k string, v double").write.mode("append").parquet(at("in"))
    assert fold() == {"a": 6.0, "b": 2.0} and fold() == {"a": 6.0, "b": 2.0}
