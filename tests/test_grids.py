"""Zarr and NetCDF classic as data sources: round trips, files written by hand, and the chunks that filters leave."""

import json
import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.errors import QuernError
from quern.sources import grids, readers


def cells(spark, shape, names, variable="v", kind="double", missing=7):
    """All cells but each `missing`-th, whose values tell their places."""
    rows = []
    for n, at in enumerate(np.ndindex(*shape)):
        if n % missing:
            rows.append((*(k + 1 for k in at), n if kind != "double" else n / 4))
    return rows, spark.createDataFrame(rows, ", ".join(f"{d} long" for d in names) + f", {variable} {kind}").repartition(5)


@pytest.mark.parametrize(("version", "codec", "kind"), [(2, "zlib", "double"), (2, None, "int"), (3, "zstd", "double"), (3, "gzip", "long"), (3, None, "double")])
def test_arrays_come_back(spark, tmp_path, version, codec, kind):
    rows, df = cells(spark, (7, 5, 3), "xyz", kind=kind)
    path = f"file://{tmp_path}/g"
    grids.write_zarr(df, path, "v", {"x": 7, "y": 5, "z": 3}, {"x": 3, "y": 2}, version, codec)
    got = {tuple(r)[:3]: r.v for r in readers.read(spark, path, "zarr", variable="v").collect()}
    have = {r[:3]: r[3] for r in rows}
    assert len(got) == 105
    for at, v in got.items():
        assert v == have[at] if at in have else (math.isnan(v) if kind == "double" else v == 0)


def test_a_range_opens_only_its_chunks(spark, tmp_path):
    _, df = cells(spark, (40, 30), "xy")
    grids.write_zarr(df, str(tmp_path), "v", {"x": 40, "y": 30}, {"x": 10, "y": 10})
    # All other chunks are spoiled: opening one would fail.
    keep = {"c/1/0", "c/1/1"}
    for k in range(4):
        for j in range(3):
            if f"c/{k}/{j}" not in keep:
                (tmp_path / "v" / "c" / str(k) / str(j)).write_bytes(b"spoiled")
    got = grids.read_zarr(spark, str(tmp_path), "v").where((F.col("x") > 11) & (F.col("x") <= 20) & (F.col("y") < 13)).collect()
    assert {(r.x, r.y) for r in got} == {(x, y) for x in range(12, 21) for y in range(1, 13)}
    assert [r.v for r in grids.read_zarr(spark, str(tmp_path), "v").where("x = 15 and y = 6").collect()] == [(14 * 30 + 5) / 4]
    assert grids.read_zarr(spark, str(tmp_path), "v").where("x > 40").collect() == []
    reader = grids.GridReader(grids.zarr_array(str(tmp_path), "v"))
    rest = list(reader.pushFilters([grids.GreaterThan(("x",), 11), grids.LessThanOrEqual(("x",), 20), grids.LessThan(("y",), 13), grids.EqualTo(("v",), 1), grids.EqualTo(("x",), 1.5)]))
    assert len(rest) == 2 and [list(s) for s in reader.spans()] == [[1], [0, 1]]


def test_a_failed_write_leaves_no_array(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "x long, v double")
    with pytest.raises(Exception, match="grid_cell"):
        grids.write_zarr(df, str(tmp_path), "v", {"x": 3})
    with pytest.raises(QuernError):
        grids.zarr_array(str(tmp_path), "v")
    with pytest.raises(Exception, match="grid_cell"):
        grids.write_zarr(spark.createDataFrame([(4, 1.0)], "x long, v double"), str(tmp_path), "v", {"x": 3})
    grids.write_zarr(df.limit(1), str(tmp_path), "v", {"x": 3})
    with pytest.raises(QuernError, match="exists"):
        grids.write_zarr(df.limit(1), str(tmp_path), "v", {"x": 3})


def test_files_of_other_writers(spark, tmp_path):
    """Version 2 with big-endian shorts, scaled, with a chunk left out; version 3 without dimension names."""
    a = tmp_path / "a"
    os.makedirs(a)
    (a / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [3, 4], "chunks": [2, 4], "dtype": ">i2", "compressor": {"id": "zlib"}, "fill_value": -1, "order": "C", "filters": None, "dimension_separator": "/"}))
    (a / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": ["t", "x"], "scale_factor": 0.5, "add_offset": 10.0, "_FillValue": -1}))
    os.makedirs(a / "0")
    (a / "0" / "0").write_bytes(zlib.compress(np.arange(8).reshape(2, 4).astype(">i2").tobytes()))
    got = {(r.t, r.x): r.a for r in grids.read_zarr(spark, str(a)).collect()}
    assert got == {(t + 1, x + 1): (4 * t + x) * 0.5 + 10 if t < 2 else None for t in range(3) for x in range(4)}
    b = tmp_path / "b"
    os.makedirs(b)
    (b / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [3], "data_type": "uint8", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2]}}, "chunk_key_encoding": {"name": "v2"}, "fill_value": 9, "codecs": [{"name": "bytes"}]}))
    (b / "0").write_bytes(bytes([200, 3]))
    assert sorted((r.dim_0, r.b) for r in grids.read_zarr(spark, str(b)).collect()) == [(1, 200), (2, 3), (3, 9)]
    (b / "zarr.json").write_text((b / "zarr.json").read_text().replace('"bytes"', '"blosc"'))
    with pytest.raises(QuernError):
        grids.zarr_array(str(b), None)


def netcdf(version=1, records=None):
    """A classic file, written by the format's description: a scalar, a fixed array and two record variables."""
    count, place = (">q" if version == 5 else ">i"), (">i" if version == 1 else ">q")
    n = lambda x: struct.pack(count, x)
    name = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    listed = lambda tag, items: struct.pack(">i", tag if items else 0) + n(len(items)) + b"".join(items)

    def attribute(key, kind, values):
        raw = values.encode() if isinstance(values, str) else np.array(values, grids.NC_TYPES[kind]).tobytes()
        return name(key) + struct.pack(">i", kind) + n(len(values)) + raw + b"\0" * (-len(raw) % 4)

    dims = [("time", 0), ("y", 3), ("x", 2)]
    count_of = 4
    data = {
        "level": ([], 6, np.array(2.5)),
        "area": ([1, 2], 5, np.arange(6).reshape(3, 2) / 2),
        "t": ([0, 1, 2], 3, np.arange(24).reshape(4, 3, 2)),
        "flag": ([0, 1], 1, np.arange(12).reshape(4, 3)),
        "time": ([0], 6, np.arange(4) * 6.0),
    }
    attrs = {"t": [attribute("scale_factor", 6, [0.1]), attribute("missing_value", 3, [5]), attribute("units", 2, "K")]}
    size = lambda v: (-(-v[2][0].nbytes // 4) * 4 if v[0][:1] == [0] else v[2].nbytes)
    data = {k: (d, kind, np.array(v, grids.NC_TYPES[kind])) for k, (d, kind, v) in data.items()}

    def header(begins):
        var = [name(k) + n(len(d)) + b"".join(map(n, d)) + listed(0x0C, attrs.get(k, [])) + struct.pack(">i", kind) + n(size(data[k])) + struct.pack(place, begins.get(k, 0)) for k, (d, kind, _) in data.items()]
        return b"CDF" + bytes([version]) + (n(count_of) if records is None else b"\xff" * struct.calcsize(count)) + listed(0x0A, [name(k) + n(m) for k, m in dims]) + listed(0x0C, [attribute("title", 2, "made by hand")]) + listed(0x0B, var)

    at, begins = len(header({})), {}
    body = b""
    for k, (d, _, v) in data.items():
        if d[:1] != [0]:
            begins[k] = at + len(body)
            body += v.tobytes() + b"\0" * (-v.nbytes % 4)
    place_of = at + len(body)
    for k, v in data.items():
        if v[0][:1] == [0]:
            begins[k] = place_of
            place_of += size(v)
    for r in range(count_of):
        for v in data.values():
            if v[0][:1] == [0]:
                raw = v[2][r].tobytes()
                body += raw + b"\0" * (-len(raw) % 4)
    return header(begins) + body


@pytest.mark.parametrize(("version", "records"), [(1, None), (2, None), (5, None), (1, "streaming")])
def test_netcdf_classic(spark, tmp_path, monkeypatch, version, records):
    monkeypatch.setattr(grids, "SLAB_BYTES", 30)
    path = tmp_path / "a.nc"
    path.write_bytes(netcdf(version, records))
    read = lambda v: readers.read(spark, str(path), "netcdf", variable=v)
    assert [tuple(r) for r in read("level").collect()] == [(2.5,)]
    assert {(r.y, r.x): r.area for r in read("area").collect()} == {(y + 1, x + 1): (2 * y + x) / 2 for y in range(3) for x in range(2)}
    got = {(r.time, r.y, r.x): r.t for r in read("t").where("time >= 2 and x = 1").collect()}
    assert got == {(t + 1, y + 1, 1): pytest.approx(0.1 * (6 * t + 2 * y)) for t in range(1, 4) for y in range(3)}
    assert [r.t for r in read("t").where("time = 1 and y = 3 and x = 2").collect()] == [None]
    assert {(r.time, r.y): r.flag for r in read("flag").collect()} == {(t + 1, y + 1): 3 * t + y for t in range(4) for y in range(3)}
    with pytest.raises(QuernError, match="name one"):
        grids.NetcdfVariable(str(path), None)


def test_other_files_are_refused(tmp_path):
    (tmp_path / "h5.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 40)
    with pytest.raises(QuernError, match="classic"):
        grids.NetcdfVariable(str(tmp_path / "h5.nc"), "v")
    with pytest.raises(QuernError, match="mounted"):
        grids.local("s3://bucket/x")
