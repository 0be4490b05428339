"""Gridded files as Python data sources: Zarr (versions 2 and 3) and NetCDF classic, read chunk by chunk in long form, and a Zarr writer that commits.

A row is a cell: its places along the dimensions, counted from 1, and the variable's value. Ranges of places in filters
choose the chunks that are opened. Paths are those that executors have mounted.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..errors import QuernError
from ..shared import ship

#: Bytes of cells that one task reads, of several small chunks or of one; of a slab of a NetCDF variable, which has no chunks of its own.
TASK_BYTES, SLAB_BYTES = 64 << 20, 8 << 20
#: Cells of a batch of rows.
BATCH_CELLS = 1 << 17


def local(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise QuernError("grid_path", f"grids are read from mounted paths, not {path}")
    return path


class Array:
    """A chunked array: name, dims, shape, chunks, dtype; block(at) is one chunk's cells, at its place in the grid of chunks, cut to the array."""

    name: str
    dims: list[str]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    #: Values that stand for no value, and what turns stored numbers into values.
    missing: Sequence = ()
    scale: float | None = None
    offset: float | None = None

    def block(self, at: tuple[int, ...]) -> np.ndarray:
        raise NotImplementedError

    def decoded(self, x: np.ndarray) -> pa.Array:
        """Values as Spark has them: missing ones null, scaled ones double."""
        none = np.zeros(len(x), bool)
        for m in self.missing:
            none |= x == m
        x = x.astype(x.dtype.newbyteorder("="))
        if self.scale is not None or self.offset is not None:
            x = x.astype(float) * (1.0 if self.scale is None else self.scale) + (self.offset or 0.0)
        return pa.array(x.astype(NARROW.get(x.dtype.str[1:], x.dtype)), mask=none)

    def kind(self) -> T.DataType:
        if self.scale is not None or self.offset is not None:
            return T.DoubleType()
        return KINDS[NARROW.get(self.dtype.newbyteorder("=").str[1:], self.dtype.str[1:])]


#: Types that Spark lacks go up to the next that holds their numbers; those of 64 unsigned bits go to double.
NARROW = {"u1": "i2", "u2": "i4", "u4": "i8", "u8": "f8", "f2": "f4"}
KINDS = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType(), "b1": T.BooleanType()}


# --- Zarr ---


class ZarrArray(Array):
    """An array folder of either version, with its data in C order; chunks without a file are the fill value."""

    def __init__(self, path: str):
        self.path, self.name = path, os.path.basename(path.rstrip("/"))
        if os.path.exists(f"{path}/.zarray"):
            with open(f"{path}/.zarray") as f:
                m = json.load(f)
            attrs = {}
            if os.path.exists(f"{path}/.zattrs"):
                with open(f"{path}/.zattrs") as f:
                    attrs = json.load(f)
            if m.get("filters") or m.get("order", "C") != "C":
                raise QuernError("zarr", f"{path}: filters and Fortran order are not read")
            self.shape, self.chunks, self.dtype = tuple(m["shape"]), tuple(m["chunks"]), np.dtype(m["dtype"])
            self.codec = (m.get("compressor") or {}).get("id")
            self.prefix, self.separator = "", m.get("dimension_separator", ".")
            fill, names = m.get("fill_value"), attrs.get("_ARRAY_DIMENSIONS")
        elif os.path.exists(f"{path}/zarr.json"):
            with open(f"{path}/zarr.json") as f:
                m = json.load(f)
            if m.get("node_type") != "array":
                raise QuernError("zarr", f"{path} is no array")
            grid, keys = m["chunk_grid"], m.get("chunk_key_encoding", {"name": "default"})
            codecs = {c["name"]: c.get("configuration", {}) for c in m["codecs"]}
            if grid["name"] != "regular" or keys["name"] not in ("default", "v2") or set(codecs) - {"bytes", "zstd", "gzip", "zlib"}:
                raise QuernError("zarr", f"{path}: regular grids of codecs bytes, zstd, gzip and zlib are read")
            order = ">" if codecs.get("bytes", {}).get("endian") == "big" else "<"
            self.shape, self.chunks = tuple(m["shape"]), tuple(grid["configuration"]["chunk_shape"])
            self.dtype = np.dtype(m["data_type"]).newbyteorder(order)
            self.codec = next((c for c in codecs if c != "bytes"), None)
            self.prefix = "c" if keys["name"] == "default" else ""
            self.separator = keys.get("configuration", {}).get("separator", "/" if self.prefix else ".")
            fill, names, attrs = m.get("fill_value"), m.get("dimension_names"), m.get("attributes", {})
        else:
            raise QuernError("zarr", f"no array at {path}")
        if self.codec not in (None, "zstd", "gzip", "zlib"):
            raise QuernError("zarr", f"{path}: compressed by {self.codec}")
        if self.dtype.newbyteorder("=").str[1:] not in {**KINDS, **NARROW}:
            raise QuernError("zarr", f"{path}: cells of type {self.dtype}")
        self.fill = np.array({"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(fill, fill if fill is not None else 0)).astype(self.dtype)
        self.dims = [n or f"dim_{k}" for k, n in enumerate(names or [None] * len(self.shape))]
        self.scale, self.offset = attrs.get("scale_factor"), attrs.get("add_offset")
        self.missing = [attrs[k] for k in ("_FillValue", "missing_value") if isinstance(attrs.get(k), int | float)]

    def key(self, at: Sequence[int]) -> str:
        parts = [*([self.prefix] if self.prefix else []), *map(str, at)]
        return self.separator.join(parts) if parts else "0"

    def block(self, at: tuple[int, ...]) -> np.ndarray:
        try:
            with open(f"{self.path}/{self.key(at)}", "rb") as f:
                raw = unpacked(f.read(), self.codec)
            whole = np.frombuffer(raw, self.dtype).reshape(self.chunks)
        except FileNotFoundError:
            whole = np.full(self.chunks, self.fill, self.dtype)
        return whole[tuple(slice(0, min(c, n - k * c)) for k, c, n in zip(at, self.chunks, self.shape, strict=True))]


def packed(raw: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(raw)
    return {None: lambda x: x, "gzip": lambda x: gzip.compress(x, 1, mtime=0), "zlib": lambda x: zlib.compress(x, 1)}[codec](raw)


def unpacked(raw: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return {None: lambda x: x, "gzip": gzip.decompress, "zlib": zlib.decompress}[codec](raw)


def zarr_array(path: str, variable: str | None) -> ZarrArray:
    path = local(path)
    if variable:
        path = f"{path.rstrip('/')}/{variable}"
    return ZarrArray(path)


# --- NetCDF classic ---

#: Types of the format by number: fixed values.
NC_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class Header:
    """Dimensions, attributes and variables of a classic file (versions 1, 2 and 5)."""

    def __init__(self, f):
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise QuernError("netcdf", "not a classic file; those of version 4 are HDF5")
        self.count, self.place = (">q" if magic[3] == 5 else ">i"), (">i" if magic[3] == 1 else ">q")
        streaming = b"\xff" * struct.calcsize(self.count)
        raw = f.read(len(streaming))
        self.records = None if raw == streaming else struct.unpack(self.count, raw)[0]
        self.dims = self.listed(0x0A, lambda: (self.name(), self.number(self.count)))
        self.attributes = dict(self.listed(0x0C, self.attribute))
        self.variables = dict(self.listed(0x0B, self.variable))

    def number(self, kind: str) -> int:
        return struct.unpack(kind, self.f.read(struct.calcsize(kind)))[0]

    def padded(self, n: int) -> bytes:
        return self.f.read(-(-n // 4) * 4)[:n]

    def name(self) -> str:
        return self.padded(self.number(self.count)).decode()

    def listed(self, tag: int, item) -> list:
        found, n = self.number(">i"), self.number(self.count)
        if found not in (0, tag) or not found and n:
            raise QuernError("netcdf", f"a list of kind {found} where {tag} was due")
        return [item() for _ in range(n)]

    def attribute(self):
        name, kind = self.name(), np.dtype(NC_TYPES[self.number(">i")])
        raw = self.padded(self.number(self.count) * kind.itemsize)
        values = raw.decode(errors="replace") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()
        return name, values

    def variable(self):
        name = self.name()
        dims = [self.number(self.count) for _ in range(self.number(self.count))]
        attrs = dict(self.listed(0x0C, self.attribute))
        kind = np.dtype(NC_TYPES[self.number(">i")])
        self.number(self.count)
        return name, {"dims": dims, "attributes": attrs, "dtype": kind, "begin": self.number(self.place)}


class NetcdfVariable(Array):
    """One variable; its chunks are slabs along the first dimension. Records of all variables take turns in the file."""

    def __init__(self, path: str, variable: str | None):
        self.path = path
        with open(path, "rb") as f:
            h = Header(f)
            size = os.fstat(f.fileno()).st_size
        names = [n for n, v in h.variables.items() if v["dtype"].kind != "S" and not (len(v["dims"]) == 1 and h.dims[v["dims"][0]][0] == n)]
        if variable is None and len(names) != 1:
            raise QuernError("netcdf", f"{path}: name one of the variables {names}")
        self.name = variable or names[0]
        if self.name not in h.variables:
            raise QuernError("netcdf", f"{path} has no variable {self.name}")
        v = h.variables[self.name]
        if v["dtype"].kind == "S":
            raise QuernError("netcdf", f"{self.name} is text")
        is_record = lambda v: bool(v["dims"]) and h.dims[v["dims"][0]][1] == 0
        one = lambda v: math.prod(h.dims[d][1] for d in v["dims"][1 if is_record(v) else 0 :]) * v["dtype"].itemsize
        records = [x for x in h.variables.values() if is_record(x)]
        # A single record variable is not padded.
        step = one(records[0]) if len(records) == 1 else sum(-(-one(x) // 4) * 4 for x in records)
        count = h.records if h.records is not None else (size - min(x["begin"] for x in records)) // step if records else 0
        self.dims, self.dtype, self.begin = [h.dims[d][0] for d in v["dims"]], v["dtype"], v["begin"]
        self.shape = tuple(count if k == 0 and is_record(v) else h.dims[d][1] for k, d in enumerate(v["dims"]))
        self.row = math.prod(self.shape[1:]) * self.dtype.itemsize
        self.step = step if is_record(v) else self.row
        self.chunks = (max(1, min(self.shape[0], SLAB_BYTES // max(1, self.row))), *self.shape[1:]) if self.shape else ()
        a = v["attributes"]
        self.missing = [x for k in ("_FillValue", "missing_value") for x in (a.get(k) or [])[:1] if not isinstance(x, str)]
        self.scale, self.offset = (a[k][0] if k in a else None for k in ("scale_factor", "add_offset"))

    def block(self, at: tuple[int, ...]) -> np.ndarray:
        with open(self.path, "rb") as f:
            if not self.shape:
                f.seek(self.begin)
                return np.frombuffer(f.read(self.dtype.itemsize), self.dtype).reshape(())
            first = at[0] * self.chunks[0]
            n = min(self.chunks[0], self.shape[0] - first)
            if self.step == self.row:
                f.seek(self.begin + first * self.row)
                raw = f.read(n * self.row)
            else:
                parts = []
                for r in range(first, first + n):
                    f.seek(self.begin + r * self.step)
                    parts.append(f.read(self.row))
                raw = b"".join(parts)
        return np.frombuffer(raw, self.dtype).reshape(n, *self.shape[1:])


# --- reading ---


class Chunks(InputPartition):
    """Chunks of the chosen box, by their numbers in its order."""

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class GridReader(DataSourceReader):
    def __init__(self, array: Array):
        self.array = array
        self.lo, self.hi = [0] * len(array.shape), [n - 1 for n in array.shape]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of places with whole numbers narrow the box; others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in self.array.dims or isinstance(value, bool) or not isinstance(value, int):
                yield f
                continue
            k = self.array.dims.index(name)
            if isinstance(f, EqualTo | GreaterThanOrEqual):
                self.lo[k] = max(self.lo[k], value - 1)
            if isinstance(f, EqualTo | LessThanOrEqual):
                self.hi[k] = min(self.hi[k], value - 1)
            if isinstance(f, GreaterThan):
                self.lo[k] = max(self.lo[k], value)
            if isinstance(f, LessThan):
                self.hi[k] = min(self.hi[k], value - 2)
            if not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                yield f

    def spans(self) -> list[range]:
        """Of each dimension the chunks that the box meets."""
        return [range(lo // c, hi // c + 1) if hi >= lo else range(0) for lo, hi, c in zip(self.lo, self.hi, self.array.chunks, strict=True)]

    def partitions(self) -> Sequence[InputPartition]:
        n = math.prod(len(s) for s in self.spans())
        each = max(1, TASK_BYTES // max(1, math.prod(self.array.chunks) * self.array.dtype.itemsize))
        return [Chunks(i, min(n, i + each)) for i in range(0, n, each)]

    def read(self, partition: Chunks | None) -> Iterator[pa.RecordBatch]:
        # Where no chunk is left, Spark still reads once, without a partition.
        if partition is None:
            return
        spans, names = self.spans(), [*self.array.dims, self.array.name]
        for number in range(partition.first, partition.end):
            at = []
            for s in reversed(spans):
                number, k = divmod(number, len(s))
                at.insert(0, s[k])
            start = [k * c for k, c in zip(at, self.array.chunks, strict=True)]
            cells = self.array.block(tuple(at))
            inside = [slice(max(0, lo - s), max(0, hi - s + 1)) for lo, hi, s in zip(self.lo, self.hi, start, strict=True)]
            cells = cells[tuple(inside)]
            first = [s + i.start for s, i in zip(start, inside, strict=True)]
            flat = cells.ravel()
            for lo in range(0, len(flat), BATCH_CELLS):
                some = flat[lo : lo + BATCH_CELLS]
                places = np.unravel_index(np.arange(lo, lo + len(some)), cells.shape) if cells.shape else ()
                yield pa.RecordBatch.from_arrays([*(pa.array(p.astype(np.int64) + f + 1) for p, f in zip(places, first, strict=True)), self.array.decoded(some)], names)


class _Grid(DataSource):
    def array(self) -> Array:
        raise NotImplementedError

    def schema(self) -> T.StructType:
        a = self.array()
        return T.StructType([*(T.StructField(d, T.LongType(), False) for d in a.dims), T.StructField(a.name, a.kind())])

    def reader(self, schema: T.StructType) -> GridReader:
        return GridReader(self.array())


class NetcdfSource(_Grid):
    @classmethod
    def name(cls) -> str:
        return "quern_netcdf"

    def array(self) -> Array:
        return NetcdfVariable(local(self.options["path"]), self.options.get("variable"))


class ZarrSource(_Grid):
    @classmethod
    def name(cls) -> str:
        return "quern_zarr"

    def array(self) -> Array:
        return zarr_array(self.options["path"], self.options.get("variable"))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        out = ZarrWriter(dict(self.options), schema)
        if os.path.exists(f"{out.folder}/zarr.json") or os.path.exists(f"{out.folder}/.zarray"):
            raise QuernError("exists", out.folder)
        return out


# --- writing ---


class Written(WriterCommitMessage):
    def __init__(self, keys: list[str]):
        self.keys = keys


class ZarrWriter(DataSourceArrowWriter):
    """Chunks of sorted rows, one at a time: each is a file put in place whole, and the array exists once commit() writes its description."""

    def __init__(self, options: dict, schema: T.StructType):
        o = {k.lower(): v for k, v in options.items()}
        self.path, self.variable, self.version = local(o["path"]), o["variable"], int(o.get("version", 3))
        self.dims, self.shape, self.chunks = json.loads(o["dims"]), tuple(json.loads(o["shape"])), tuple(json.loads(o["chunks"]))
        self.attributes, self.codec = json.loads(o.get("attributes", "{}")), o.get("codec", "zstd") or None
        kind = schema[self.variable].dataType
        self.dtype = np.dtype("<" + next(k for k, v in KINDS.items() if v == kind)) if kind != T.BooleanType() else np.dtype("?")
        self.fill = np.array(np.nan if self.dtype.kind == "f" else 0).astype(self.dtype)

    @property
    def folder(self) -> str:
        return f"{self.path.rstrip('/')}/{self.variable}"

    def key(self, at: Sequence[int]) -> str:
        return ("c/" + "/".join(map(str, at)) if at else "c") if self.version == 3 else ".".join(map(str, at)) or "0"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held: list[pa.Table] = []
        keys: list[str] = []
        for batch in iterator:
            if not batch.num_rows:
                continue
            chunk = batch.column("__chunk").to_numpy()
            cut = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for lo, hi in itertools.pairwise(cut):
                if held and held[0]["__chunk"][0].as_py() != chunk[lo]:
                    keys.append(self.put(pa.concat_tables(held)))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
        if held:
            keys.append(self.put(pa.concat_tables(held)))
        return Written(keys)

    def put(self, rows: pa.Table) -> str:
        number, at = rows["__chunk"][0].as_py(), []
        for n, c in zip(reversed(self.shape), reversed(self.chunks), strict=True):
            number, k = divmod(number, -(-n // c))
            at.insert(0, k)
        cells = np.full(self.chunks, self.fill, self.dtype)
        place = np.zeros(len(rows), np.int64)
        for d, k, c in zip(self.dims, at, self.chunks, strict=True):
            place = place * c + (rows[d].to_numpy() - 1 - k * c)
        if len(np.unique(place)) < len(place):
            raise QuernError("grid_cell", f"chunk {at} of {self.variable} has a cell twice")
        value = rows[self.variable].combine_chunks()
        some = np.asarray(value.is_valid())
        cells.reshape(-1)[place[some]] = value.drop_null().to_numpy(zero_copy_only=False)
        path = f"{self.folder}/{self.key(at)}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        put_whole(path, packed(cells.tobytes(), self.codec))
        return self.key(at)

    def commit(self, messages: list[Written | None]) -> None:
        describe(self.folder, self.version, self.shape, self.chunks, self.dtype, self.fill, self.codec, self.dims, self.attributes)
        root = self.path.rstrip("/")
        if self.version == 3:
            put_whole(f"{root}/zarr.json", json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {}}).encode())
        else:
            put_whole(f"{root}/.zgroup", json.dumps({"zarr_format": 2}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """What was written is not described, so no reader sees it; it goes too."""
        shutil.rmtree(self.folder, ignore_errors=True)


def put_whole(path: str, raw: bytes) -> None:
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(raw)
    os.replace(temporary, path)


def describe(folder: str, version: int, shape: Sequence[int], chunks: Sequence[int], dtype: np.dtype, fill: np.ndarray, codec: str | None, dims: list[str], attributes: dict) -> None:
    """An array's metadata, put in place last."""
    os.makedirs(folder, exist_ok=True)
    number = fill.item()
    number = "NaN" if isinstance(number, float) and math.isnan(number) else number
    if version == 3:
        codecs = [{"name": "bytes", "configuration": {"endian": "little"}}]
        if codec:
            codecs.append({"name": codec, "configuration": {"level": 1, "checksum": False} if codec == "zstd" else {"level": 1}})
        m = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": dtype.newbyteorder("=").name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}}
        m |= {"chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": number, "codecs": codecs, "attributes": attributes, "dimension_names": dims}
        put_whole(f"{folder}/zarr.json", json.dumps(m).encode())
        return
    put_whole(f"{folder}/.zattrs", json.dumps(attributes | {"_ARRAY_DIMENSIONS": dims}).encode())
    m = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": dtype.str, "compressor": codec and {"id": codec, "level": 1}, "fill_value": number, "order": "C", "filters": None}
    put_whole(f"{folder}/.zarray", json.dumps(m).encode())


def registered(spark: SparkSession) -> None:
    """The sources known to a session, and the filters that it hands them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ZarrSource, NetcdfSource):
        spark.dataSource.register(source)


def read_zarr(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """The cells of an array: places along its dimensions, from 1, and the value, named after the array. Attributes _FillValue, missing_value, scale_factor and add_offset are heeded."""
    registered(spark)
    return spark.read.format("quern_zarr").options(**({"variable": variable} if variable else {})).load(path)


def read_netcdf(spark: SparkSession, path: str, variable: str | None = None) -> DataFrame:
    """The cells of a variable of a NetCDF classic file, likewise; without a name that of the only one that is no coordinate."""
    registered(spark)
    return spark.read.format("quern_netcdf").options(**({"variable": variable} if variable else {})).load(path)


def write_zarr(df: DataFrame, path: str, variable: str, dims: dict[str, int], chunks: dict[str, int] | None = None, version: int = 3, codec: str | None = "zstd", attributes: dict | None = None) -> None:
    """Rows (places along dims from 1, value) as an array of a Zarr group; cells without a row or value are NaN, or 0 in whole numbers.

    Rows meet by chunk, so a task holds one chunk at a time, however large the array. A place outside the array, or a cell
    given twice, fails the write; the array is there only when all of it is. One that exists is never written over.
    """
    registered(df.sparkSession)
    folder = f"{local(path).rstrip('/')}/{variable}"
    if os.path.exists(f"{folder}/zarr.json") or os.path.exists(f"{folder}/.zarray"):
        raise QuernError("exists", folder)
    if version not in (2, 3):
        raise QuernError("zarr", f"version {version}")
    chunks = {d: min(n, (chunks or {}).get(d, n)) for d, n in dims.items()}
    number = F.lit(0).cast("long")
    for d, n in dims.items():
        inside = F.when(F.col(d).between(1, n), F.col(d)).otherwise(F.raise_error(F.concat(F.lit(f"[grid_cell] {d} = "), F.coalesce(F.col(d).cast("string"), F.lit("null")))).cast("long"))
        number = number * (-(-n // chunks[d])) + F.floor((inside - 1) / chunks[d])
    rows = df.select(*[F.col(d).cast("long").alias(d) for d in dims], F.col(variable)).withColumn("__chunk", number.cast("long"))
    options = {"variable": variable, "version": str(version), "codec": codec or "", "dims": json.dumps(list(dims)), "shape": json.dumps(list(dims.values())), "chunks": json.dumps(list(chunks.values())), "attributes": json.dumps(attributes or {})}
    rows.repartition("__chunk").sortWithinPartitions("__chunk").write.format("quern_zarr").options(**options).mode("append").save(path)
