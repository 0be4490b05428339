"""Providers that a document binds, index sets in versions, and snapshots at ticks."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.plans.document import Evaluator
from quern.sources import binding, grids, sinks
from quern.streaming import versions

DOC = {
    "index_sets": {"stations": {"kind": "interval", "size": 3}, "x": {"kind": "interval", "size": 4}},
    "data_sources": {
        "Rain": {"kind": "points", "source": {"url_template": "{root}/rain-{date:%Y%m}.csv"}, "temporal": {"start": "2024-01-01T00:00:00Z", "end": "2024-03-15T00:00:00Z", "file_period": "P1M"}, "record_filter": {"require_finite": ["mm"]}},
        "Height": {"kind": "grid", "source": {"url_template": "{root}/height.zarr"}},
    },
    "models": {
        "M": {
            "variables": {
                "rain": {"type": "parameter", "shape": ["stations"], "update": {"kind": "data", "source": "Rain", "from": {"file_variable": "mm", "unit_conversion": 0.001}}},
                "kind": {"type": "parameter", "shape": ["stations"], "update": {"kind": "data", "source": "Rain", "from": {"file_variable": "type", "codes": {"map": {"open": 1, "roof": 2}, "case_insensitive": True}}}},
                "height": {"type": "parameter", "shape": ["x"], "update": {"kind": "data", "source": "Height", "from": {"file_variable": "h", "select": {"axes": [{"fixed": 1}, {"range": {"start": 0, "stop": "N"}}]}}}},
                "k": {"type": "parameter", "default": 2.0},
            },
            "equations": [{"lhs": "total", "rhs": {"op": "aggregate", "args": [], "output_idx": [], "ranges": {"i": {"from": "stations"}}, "expr": {"op": "*", "args": ["k", {"op": "index", "args": ["rain", "i"]}]}}}],
        }
    },
}


def files(tmp_path, spark):
    for month, scale in (("01", 1), ("02", 10), ("03", 100)):
        (tmp_path / f"rain-2024{month}.csv").write_text("station,mm,type\n" + "".join(f"s{k},{k * scale},{t}\n" for k, t in ((3, "Roof"), (1, "open"), (2, "OPEN"))) + "s9,NaN,open\n")
    grid = spark.createDataFrame([(y, x, 10.0 * y + x) for y in (1, 2) for x in (1, 2, 3, 4)], "y long, x long, h double")
    grids.write_zarr(grid, f"{tmp_path}/height.zarr", "h", {"y": 2, "x": 4}, {"y": 1, "x": 2})


def test_a_documents_parameters_read_their_sources(spark, tmp_path):
    files(tmp_path, spark)
    got = binding.providers(spark, DOC, "M", order={"Rain": ["station"]}, root=str(tmp_path), N=3)
    assert sorted(got) == ["height", "kind", "rain"]
    values = lambda f: {tuple(r)[:-1]: r.value for r in f.df.collect()}
    assert values(got["rain"].materialize()) == {(1,): 0.001, (2,): 0.002, (3,): 0.003}
    feb = datetime(2024, 2, 20, tzinfo=UTC).timestamp()
    assert values(got["rain"].refresh(feb)) == {(1,): 0.01, (2,): 0.02, (3,): 0.03}
    assert values(got["kind"].materialize()) == {(1,): 1.0, (2,): 1.0, (3,): 2.0}
    assert values(got["height"].materialize()) == {(1,): 21.0, (2,): 22.0, (3,): 23.0}
    assert got["rain"].refresh_times() == [datetime(2024, m, 1, tzinfo=UTC).timestamp() for m in (1, 2, 3)] and got["height"].refresh_times() == []
    ev = Evaluator(spark, DOC, "M", {"rain": got["rain"].refresh(feb)})
    assert ev.evaluate("total").first().value == pytest.approx(2 * 0.06)


def test_bindings_that_cannot_be(spark, tmp_path):
    files(tmp_path, spark)
    doc = json.loads(json.dumps(DOC))
    doc["models"]["M"]["variables"]["rain"]["update"]["source"] = "Snow"
    with pytest.raises(QuernError, match="undefined_source"):
        binding.providers(spark, doc, "M")
    doc = json.loads(json.dumps(DOC))
    doc["models"]["M"]["variables"]["rain"]["update"]["from"]["file_variable"] = "inches"
    with pytest.raises(QuernError, match="file_variable"):
        binding.providers(spark, doc, "M", order={"Rain": ["station"]}, root=str(tmp_path))["rain"].materialize()


def test_a_set_grows_and_its_past_stays(spark, tmp_path):
    s = versions.VersionedSet(spark, f"file://{tmp_path}/set")
    built = []

    def sizes(members):
        built.append(1)
        return members.agg(F.count("*").alias("n"))

    s.depends("size", sizes)
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "member string")
    pos = lambda v: {r.member: r.pos for r in s.at(v).collect()}
    assert s.remesh(0, rows("d", "b", "b", None)) and pos(0) == {"b": 1, "d": 2}
    assert s.remesh(1, rows("c", "a", "d")) and pos(1) == {"b": 1, "d": 2, "a": 3, "c": 4}
    assert not s.remesh(2, rows("a")) and pos(2) == pos(1) and pos(0) == {"b": 1, "d": 2}
    assert not s.remesh(1, rows("z"))
    assert [s.dependant("size", v).first().n for v in (0, 1, 2)] == [2, 4, 4] and len(built) == 2
    with pytest.raises(QuernError):
        s.at(7)


def test_snapshots_are_the_last_rows_before_ticks(spark):
    rng = random.Random(4)
    data = [(rng.choice(["a", "b", None]), float(t), rng.choice([None, 1.0, 2.0])) for t in rng.sample(range(100), 40)]
    ticks = [20.0, 5.0, 20.0, 60.0, 99.0]
    got = {(r.g, r.tick): (r.t, r.x) for r in versions.snapshots(spark.createDataFrame(data, "g string, t double, x double").repartition(4), ["g"], "t", ticks, "t", "x").collect()}
    want = {}
    for g in {g for g, _, _ in data}:
        for k in set(ticks):
            own = [(t, x) for h, t, x in data if h == g and t <= k]
            if own:
                want[g, k] = max(own, key=lambda r: r[0])
    assert got == want


def test_ticks_are_written_once_each(spark, tmp_path):
    sink = sinks.ParquetSink(f"file://{tmp_path}/out", [1.0, 2.0, 3.0]).open(spark)
    state = lambda t: spark.createDataFrame([(t * 10,)], "u double")
    assert versions.output_at(sink, sink.output_times, state, upto=2.5) == [1.0, 2.0]
    assert versions.output_at(sink, sink.output_times, state) == [3.0] and versions.output_at(sink, sink.output_times, state) == []
    assert sorted((r.t, r.u) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]
