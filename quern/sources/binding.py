"""Sources of a document: each parameter that is read from data gets a provider of keyed factors, made from the document's own entries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuernError
from ..types import Factor
from . import readers, times

#: Formats by what a file's name ends in, where the document names none.
ENDINGS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc", ".nc": "netcdf", ".zarr": "zarr"}


def stamp(text: str) -> datetime:
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=UTC)


class Binding:
    """One parameter's data: the source's entry, the variable in its files, and what is done to it on the way in.

    refresh(t) reads the file of the period that t is in, materialize() that of the source's start; a source without periods
    has one file. Rows keep what record_filter asks for, codes and conversions apply, `select` takes ranges of the
    axes, and the axes of the parameter's shape count from 1: columns of a grid's file by order, or places of records, in
    the order of the columns that `order` names.
    """

    def __init__(self, spark: SparkSession, doc: Mapping, name: str, variable: Mapping, options: Mapping):
        self.spark, self.name, self.shape = spark, name, [str(s) for s in variable.get("shape") or []]
        self.rule = variable["update"] if isinstance(variable["update"], dict) else next(u for u in variable["update"] if u.get("kind") == "data")
        self.source = (doc.get("data_sources") or {}).get(self.rule["source"])
        if self.source is None:
            raise QuernError("undefined_source", self.rule["source"])
        self.options = options
        temporal = self.source.get("temporal") or {}
        self.period = times.Period.parse(temporal["file_period"]) if temporal.get("file_period") else None
        self.start, self.end = (stamp(temporal[k]) if temporal.get(k) else None for k in ("start", "end"))

    def refresh_times(self) -> list[float]:
        """When a new file begins: none for a source without periods."""
        if self.period is None or self.start is None or self.end is None:
            return []
        return [t.timestamp() for t in times.file_anchors(self.start, self.end, self.start, self.period)]

    def path(self, t: float | None) -> str:
        at = None if t is None else datetime.fromtimestamp(t, UTC)
        if at is not None and self.period is not None and self.start is not None:
            at = times.snap(at, self.start, self.period)
        return times.expand_url(self.source["source"]["url_template"], at or self.start, **self.options.get("values", {}))

    def rows(self, t: float | None) -> DataFrame:
        """The file's rows that the source's filter admits."""
        path = self.options.get("open", lambda p: p)(self.path(t))
        declared = (self.source.get("metadata") or {}).get("format")
        kind = declared or next((f for e, f in ENDINGS.items() if path.rstrip("/").endswith(e)), None)
        if kind is None:
            raise QuernError("unknown_format", path)
        column = self.rule["from"]["file_variable"]
        df = readers.read(self.spark, path, kind, **({"variable": column} if kind in ("zarr", "netcdf") else {}))
        own = (self.source.get("record_filter") or {}).get("require_finite") or []
        return readers.require_finite(df, *own) if own else df

    def refresh(self, t: float | None) -> Factor:
        how, column = self.rule["from"], self.rule["from"]["file_variable"]
        df = self.rows(t)
        if column not in df.columns:
            raise QuernError("file_variable", f"{column} is not in {self.path(t)}")
        if codes := how.get("codes"):
            df = readers.coded(df, column, codes["map"], codes.get("unmapped", "error"), bool(codes.get("case_insensitive")))
        value = F.col(column).cast("double")
        factor = how.get("unit_conversion")
        if isinstance(factor, int | float):
            value = value * F.lit(float(factor))
        elif factor is not None:
            from ..plans.expressions import column as expression

            value = expression(factor, {column: value, "value": value})
        if self.source["kind"] == "grid":
            axes = [c for c in df.columns if c != column]
        else:
            # Records have no place of their own: theirs is that in the order of the named columns.
            order = self.options.get("order") or [c for c in df.columns]
            from ..operators.relational import rank

            keyed = rank(df.select(*[F.col(c).cast("string").alias(c) for c in order]), *order, base=1, name="__place")
            df = df.join(keyed, [df[c].cast("string") == keyed[c] for c in order]).select(df["*"], keyed["__place"])
            axes = ["__place"]
        if len(axes) < len(self.shape):
            raise QuernError("shape", f"{self.name} has axes {self.shape}, its file {axes}")
        out = df.select(*axes, value.alias("value"))
        selection = (how.get("select") or {}).get("axes") or []
        for axis, s in zip(axes, selection, strict=False):
            out = readers.select_axis(out, axis, s if not isinstance(s, dict) or "range" not in s else {"range": {k: self.options.get("values", {}).get(v, v) for k, v in s["range"].items()}})
        kept = [a for a in axes if a in out.columns][-len(self.shape) :] if self.shape else []
        return Factor(out.select(*[F.col(a).cast("long").alias(s) for a, s in zip(kept, self.shape, strict=True)], "value"), tuple(self.shape))

    def materialize(self) -> Factor:
        return self.refresh(None if self.start is None else self.start.timestamp())


def providers(spark: SparkSession, doc: Mapping, model: str, open: Callable[[str], str] | None = None, order: Mapping[str, list[str]] | None = None, **values) -> dict[str, Binding]:
    """A provider for each parameter of a model that the document updates from data.

    `open` turns an expanded address into a path that Spark reads (a cache, a mirror); `order` gives, by source, the columns that number its
    records; `values` fill the templates and the document's integer names.
    """
    out = {}
    for name, v in doc["models"][model].get("variables", {}).items():
        rules = v.get("update")
        if any(isinstance(u, dict) and u.get("kind") == "data" for u in (rules if isinstance(rules, list) else [rules])):
            source = next(u["source"] for u in (rules if isinstance(rules, list) else [rules]) if u.get("kind") == "data")
            out[name] = Binding(spark, doc, name, v, {"values": values, "order": (order or {}).get(source)} | ({"open": open} if open else {}))
    return out
