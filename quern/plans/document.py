"""Documents: index sets, variables and equations as JSON, evaluated as DataFrame plans.

    {"index_sets": {"cells": {"kind": "interval", "size": 5}}, "enums": {}, "expression_templates": {},
     "models": {"M": {"variables": {"u": {"type": "unknown", "shape": ["cells"]}},
                      "equations": [{"lhs": "u", "rhs": {"op": "aggregate", ...}}]}}}

An equation's left side is a name, index(name, symbols) or D(name): its right side is the value, or the rate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuernError
from ..functions.scalar import ALIASES, OPS, op, truth
from ..functions.closed import FunctionTable
from ..operators import arrays, geometry
from ..operators.aggregate import expand_range, prefix
from ..operators.elimination import contract
from ..operators.relational import key_int, rank, skolem, skolem_edge
from ..operators.spatial import nearest, overlap_join
from ..streaming.cadence import check_relational
from ..types import Factor, IndexSet, check_keys, semiring
from .expressions import LOGICAL, Expr, check_arity, free_variables, is_node
from .systems import lower

ARRAYOP = {"arrayop": "aggregate"}
#: Comparisons of a contracted symbol with an output symbol that make a fold a prefix: (strict, reverse).
PREFIX = {"<=": (False, False), "<": (True, False), ">=": (False, True), ">": (True, True)}
#: What a body's product is called in each semiring.
PRODUCT = {"sum_product": "*", "max_product": "*", "min": "*", "min_sum": "+", "max_sum": "+"}
TURNED = {"<=": ">=", "<": ">", ">=": "<=", ">": "<"}


def load(source: str | dict) -> dict:
    """JSON text, or a dict, with templates expanded, enums lowered, older names replaced and arities checked."""
    doc = json.loads(source) if isinstance(source, str) else json.loads(json.dumps(source))
    templates, enums = doc.get("expression_templates", {}), doc.get("enums", {})

    def renamed(x):
        if isinstance(x, dict):
            return {k: ARRAYOP.get(v, v) if k == "op" else renamed(v) for k, v in x.items()}
        return [renamed(v) for v in x] if isinstance(x, list) else x

    for model in doc.get("models", {}).values():
        for eq in model.get("equations", []):
            eq["rhs"] = lower(renamed(eq["rhs"]), templates, enums)
            check_arity(eq["rhs"])
    return doc


def save(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, sort_keys=True, indent=1)


def defined_name(lhs: Expr) -> str:
    """The name that a left side defines: u, index(u, i), D(u), ic(u), or an aggregate over one of these."""
    while is_node(lhs):
        lhs = lhs["expr"] if lhs["op"] == "aggregate" else lhs["args"][0]
    return lhs


def is_rate(lhs: Expr) -> bool:
    """Whether a left side is a time derivative, of a name or an array's cell."""
    while is_node(lhs):
        if lhs["op"] == "D":
            return lhs.get("wrt", "t") == "t"
        lhs = lhs.get("expr") if lhs["op"] == "aggregate" else lhs["args"][0]
    return False


def conjuncts(e: Expr) -> list[Expr]:
    """The parts that must all hold."""
    if e is None:
        return []
    return [c for a in e["args"] for c in conjuncts(a)] if is_node(e) and e["op"] == "and" else [e]


class Invented(NamedTuple):
    """extents: sizes of derived sets; members and assignments: their members, and with places; groups: folds over them; join_key_buffers: minted keys that joins go by."""

    extents: dict[str, int]
    members: dict[str, DataFrame]
    assignments: dict[str, DataFrame]
    groups: dict[str, Factor]
    join_key_buffers: dict[str, Factor]


class Evaluator:
    """One model of a document with its inputs: factors in long form by name, and scalars by name."""

    def __init__(self, spark: SparkSession, doc: str | dict, model: str, factors: Mapping[str, Factor] | None = None, scalars: Mapping[str, float] | None = None):
        self.spark, self.doc = spark, load(doc)
        if model not in self.doc.get("models", {}):
            raise QuernError("unknown_model", model)
        self.model = self.doc["models"][model]
        self.equations = {defined_name(e["lhs"]): e["rhs"] for e in self.model.get("equations", [])}
        self.scalars = {n: v["default"] for n, v in self.model.get("variables", {}).items() if "default" in v and not v.get("shape") and n not in self.equations} | dict(scalars or {})
        self.factors: dict[str, Factor] = dict(factors or {})
        self.sets: dict[str, IndexSet] = {}
        self.busy: list[str] = []
        #: The index set of each symbol in scope.
        self.scope: dict[str, str] = {}
        for name, s in self.doc.get("index_sets", {}).items():
            if s["kind"] in ("interval", "categorical"):
                self.sets[name] = IndexSet(s["kind"], s.get("size", len(s.get("members", ()))), tuple(s.get("members", ())))

        #: Names that change as time runs, and what each name reads.
        self.reads = {n: free_variables(rhs) & set(self.equations) - {n} for n, rhs in self.equations.items()}
        self.rates = {defined_name(e["lhs"]) for e in self.model.get("equations", []) if is_rate(e["lhs"])}

    # --- ranges ---

    def guard(self, name: str, e: Expr) -> None:
        """Sets and minted keys are made before time runs: what makes one may not read a state, or what follows from one."""
        reads = {n: set() if n in self.rates else r for n, r in self.reads.items()} | {name: (free_variables(e) | free_variables(e.get("key"))) & set(self.equations)}
        check_relational(reads, dict.fromkeys(self.rates, "continuous"), {name})

    def derived(self, name: str) -> IndexSet:
        """The distinct keys that a producing aggregate (id) mints, in order; made once."""
        if name not in self.sets:
            s = self.doc["index_sets"].get(name)
            if s is None:
                raise QuernError("undeclared_index_set", name)
            makers = [e for e in self.equations.values() if is_node(e) and e.get("id") == s.get("from_faq")]
            if s["kind"] != "derived" or not makers:
                raise QuernError("no_producer", name)
            self.guard(name, makers[0])
            if makers[0]["op"] == "intersect_polygon":
                n = self.clipped(makers[0]).df.agg(F.max("v")).first()[0] or 1
                self.sets[name] = IndexSet("interval", n - 1)
                return self.sets[name]
            self.sets[name] = IndexSet("derived", frame=self.members(makers[0]))
        return self.sets[name]

    def members(self, e: Expr) -> DataFrame:
        """(pos, member) of an aggregate with distinct and a key."""
        df, names = self.enumerate(e)
        df, key = self.column(e["key"], df, names)
        return rank(df.select(key.alias("member")).distinct(), "member", base=1, name="pos").select("pos", "member")

    def extend(self, df: DataFrame | None, symbol: str, spec) -> DataFrame:
        """df with one row for each place of the symbol's range."""
        if isinstance(spec, list):
            lo, hi, step = (spec[0], spec[-1], spec[1] if len(spec) == 3 else 1)
            df = df if df is not None else self.spark.range(1).select()
            df, a = self.column(lo, df, self.bound(df))
            df, b = self.column(hi, df, self.bound(df))
            return expand_range(df, a, b, symbol, step)
        kind = self.doc.get("index_sets", {}).get(spec["from"], {}).get("kind")
        if kind == "ragged":
            s, parent = self.doc["index_sets"][spec["from"]], (spec.get("of") or [None])[0] if isinstance(spec.get("of"), list) else spec.get("of")
            n = self.factor(s["offsets"]).named(parent, value="__n").df
            df = expand_range(df.join(n, parent), F.lit(1), F.col("__n"), f"{symbol}_k").drop("__n")
            return df.join(self.factor(s["values"]).named(parent, f"{symbol}_k", value=symbol).df, [parent, f"{symbol}_k"])
        places = self.derived(spec["from"]).positions(self.spark, symbol)
        return places if df is None else df.crossJoin(places)

    def bound(self, df: DataFrame) -> dict[str, Column]:
        return {c: F.col(c) for c in df.columns}

    @contextmanager
    def within(self, e: Expr) -> Iterator[None]:
        """The symbols that e binds, in scope."""
        was = self.scope
        self.scope = was | {s: r["from"] for s, r in e.get("ranges", {}).items() if isinstance(r, dict)}
        yield
        self.scope = was

    def enumerate(self, e: Expr, df: DataFrame | None = None) -> tuple[DataFrame, dict[str, Column]]:
        """Admitted combinations of an aggregate's ranges: parents before ragged children, joins and filter applied.

        A symbol that a join, an overlap or an equality in the filter ties to what is bound already is bound by
        that: by a value of the row, an equi-join, or the pairs of boxes that meet. Only symbols that nothing
        ties are multiplied out.
        """
        with self.within(e):
            ranges = dict(e.get("ranges", {}))
            done = set(df.columns) if df is not None else set()
            gates = [g for clause in e.get("join", []) for g in self.gates(clause)]
            tests = conjuncts(e.get("filter"))
            while ranges:
                ready = [s for s, r in ranges.items() if isinstance(r, list) or set([r["of"]] if isinstance(r.get("of"), str) else r.get("of") or []) <= done]
                if not ready:
                    raise QuernError("range_order", f"{sorted(ranges)}")
                bound = self.driven(df, ready, ranges, gates, tests)
                if bound is None:
                    df, bound = self.extend(df, ready[0], ranges[ready[0]]), [ready[0]]
                else:
                    df, bound = bound
                for s in bound:
                    del ranges[s]
                done |= set(bound)
            df = df if df is not None else self.spark.range(1).select()
            for gate in gates:
                df = self.admit(df, gate)
            for test in tests:
                df, keep = self.column(test, df, self.bound(df))
                df = df.where(keep if self.boolean(test) else keep > 0)
            return df, self.bound(df)

    def gates(self, clause: Mapping) -> list[tuple]:
        """("on", symbol, buffer, symbol, buffer) of each pair of keys, or ("overlap", symbol, symbol, pairs of places)."""
        if set(clause) - {"on", "overlap", "_comment"} or ("on" in clause) == ("overlap" in clause):
            raise QuernError("join_clause", f"a join clause has `on` or `overlap`, not {sorted(clause)}")
        if "on" in clause:
            return [("on", *self.key(a), *self.key(b)) for a, b in clause["on"] if a != b]
        how = clause["overlap"]
        eps = float(how.get("eps") or 0.0)
        if set(how) - {"src_env", "tgt_env", "eps"} or not how.get("src_env") or not how.get("tgt_env") or eps < 0:
            raise QuernError("join_overlap", "an overlap has src_env, tgt_env and an eps of at least 0")
        (a, left), (b, right) = (self.envelopes(list(how[side])) for side in ("src_env", "tgt_env"))
        if a == b:
            raise QuernError("join_overlap", f"both sides are over {a}")
        return [("overlap", a, b, overlap_join(left, right, a, b, eps))]

    def key(self, name: str) -> tuple[str, Factor | None]:
        """The symbol that a join key goes by, and the buffer that has its values; without one, the symbol's own members."""
        if name in self.scope:
            return name, None
        own = [s for s, r in self.scope.items() if r == name]
        if own:
            if len(own) != 1:
                raise QuernError("join_key", f"{name} names {len(own)} ranges")
            return own[0], None
        f = self.factor(name)
        return self.symbol_of(name), f

    def symbol_of(self, name: str) -> str:
        """The symbol in scope that ranges over the first axis of an input or of what an equation defines."""
        shape = self.model.get("variables", {}).get(name, {}).get("shape") or []
        rhs = self.equations.get(name)
        if not shape and is_node(rhs) and rhs.get("output_idx"):
            shape = [rhs["ranges"][s]["from"] for s in rhs["output_idx"] if isinstance(rhs["ranges"].get(s), dict)]
        f = self.factor(name)
        own = [s for s, r in self.scope.items() if shape and r == shape[0]] or [s for s in self.scope if f.axes[:1] == (s,)]
        if len(own) != 1:
            raise QuernError("join_key", f"{name} goes by {own or 'no symbol in scope'}")
        return own[0]

    def envelopes(self, names: list[str]) -> tuple[str, DataFrame]:
        """Boxes of 1 factor of rings, 2 of points (x, y) or 4 of sides (xmin, ymin, xmax, ymax), by place."""
        if len(names) not in (1, 2, 4):
            raise QuernError("join_overlap", f"an envelope takes 1, 2 or 4 factors, not {len(names)}")
        symbol = self.symbol_of(names[0])
        if len(names) == 1:
            ring = self.rings(names[0]).named(symbol, value="__ring")
            return symbol, ring.df.select(symbol, *[c.alias(k) for k, c in geometry.envelope(F.col("__ring")).items()])
        df = None
        for k, name in enumerate(names):
            part = self.factor(name).named(symbol, value=f"__e{k}").df
            df = part if df is None else df.join(part, symbol)
        sides = [f"__e{k}" for k in range(len(names))] * (4 // len(names))
        return symbol, df.select(symbol, *[F.col(c).alias(k) for c, k in zip(sides, ("xmin", "ymin", "xmax", "ymax"), strict=True)])

    def keyed(self, symbol: str, buffer: Factor | None, tag: str) -> DataFrame:
        """(symbol, tag): the places of a symbol's set with their join keys."""
        if buffer is not None:
            return buffer.named(symbol, value=tag).df
        places = self.derived(self.scope[symbol]).positions(self.spark, symbol)
        return places.withColumn(tag, F.col(f"{symbol}_member") if f"{symbol}_member" in places.columns else F.col(symbol))

    def driven(self, df: DataFrame | None, ready: list[str], ranges: Mapping, gates: list, tests: list) -> tuple[DataFrame, list[str]] | None:
        """df with symbols bound by a gate or an equality, which is then done with; None if nothing ties any."""
        plain = [s for s in ready if isinstance(ranges[s], dict) and not ranges[s].get("of") and self.kind(ranges[s]["from"]) != "ragged"]
        for gate in gates:
            if gate[0] == "overlap" and {gate[1], gate[2]} <= set(plain):
                gates.remove(gate)
                return (gate[3] if df is None else df.crossJoin(gate[3])), [gate[1], gate[2]]
        if df is None:
            return None
        for gate in gates:
            for s, other in ((gate[1], gate[2]), (gate[2], gate[1])) if gate[0] == "overlap" else ((gate[1], gate[3]), (gate[3], gate[1])):
                if s not in plain or other not in df.columns:
                    continue
                gates.remove(gate)
                if gate[0] == "overlap":
                    return df.join(gate[3], other), [s]
                mine, theirs = (gate[2], gate[4]) if s == gate[1] else (gate[4], gate[2])
                tag, at = f"__k{len(df.columns)}", f"__j{len(df.columns)}"
                left = df.join(self.keyed(other, theirs, at).select(other, at), other)
                return left.join(self.keyed(s, mine, tag), F.col(at) == F.col(tag)).drop(at, tag), [s]
        for test in tests:
            if not (is_node(test) and ALIASES.get(test["op"], test["op"]) == "=="):
                continue
            for mine, theirs in (test["args"], test["args"][::-1]):
                one = mine["args"][1] if is_node(mine) and mine["op"] == "index" and len(mine["args"]) == 2 else mine
                if one not in plain or free_variables(theirs) & set(ranges) or self.kind(ranges[one]["from"]) != "interval" or is_node(mine) and not isinstance(mine["args"][0], str):
                    continue
                size, tag = self.sets[ranges[one]["from"]].size, f"__q{len(df.columns)}"
                df, value = self.column(theirs, df, self.bound(df))
                tests.remove(test)
                if mine == one:
                    d = value.cast("double")
                    df = df.withColumn(one, F.when((d == F.floor(d)) & d.between(1, size), d.cast("long")))
                    return df.where(F.col(one).isNotNull()), [one]
                table = self.factor(mine["args"][0]).named(one, value=tag).df.where(F.col(one).between(1, size))
                return df.withColumn(f"{tag}v", value.cast("double")).join(table, F.col(f"{tag}v") == F.col(tag).cast("double")).drop(tag, f"{tag}v"), [one]
        return None

    def kind(self, name: str) -> str | None:
        return self.doc.get("index_sets", {}).get(name, {}).get("kind")

    def admit(self, df: DataFrame, gate: tuple) -> DataFrame:
        """Rows whose bound symbols pass a gate."""
        if gate[0] == "overlap":
            return df.join(gate[3], [gate[1], gate[2]], "left_semi")
        _, a, left, b, right = gate
        x, y = f"__x{len(df.columns)}", f"__y{len(df.columns)}"
        met = df.join(self.keyed(a, left, x).select(a, x), a).join(self.keyed(b, right, y).select(b, y), b)
        return met.where(F.col(x) == F.col(y)).drop(x, y)

    # --- scalars of a row ---

    def boolean(self, e: Expr) -> bool:
        return isinstance(e, bool) or is_node(e) and ALIASES.get(e["op"], e["op"]) in OPS and OPS[ALIASES.get(e["op"], e["op"])].boolean

    def column(self, e: Expr, df: DataFrame, names: Mapping[str, Column]) -> tuple[DataFrame, Column]:
        if isinstance(e, bool | int | float):
            return df, F.lit(e)
        if isinstance(e, str):
            if e in names:
                return df, names[e]
            if e in self.scalars:
                return df, F.lit(self.scalars[e])
            f = self.factor(e)
            if f.axes:
                raise QuernError("array_as_scalar", e)
            tag = f"__s{len(df.columns)}"
            return df.crossJoin(f.df.select(F.col(f.value).alias(tag))), F.col(tag)
        name = ALIASES.get(e["op"], e["op"])
        if name == "index":
            array = self.array(e["args"][0])
            cols = []
            for a in e["args"][1:]:
                df, c = self.column(a, df, names)
                cols.append(key_int(c))
            tag = f"__g{len(df.columns)}"
            return arrays.gather(df, array, cols, tag, ghost=0.0 if e["args"][0] in self.model.get("states", ()) else None), F.col(tag)
        if name == "aggregate":
            keys = [c for c in df.columns]
            ring = semiring(e.get("semiring"), e.get("reduce"))
            with self.within(e):
                sub, inner = self.enumerate(e, df)
                sub, body = self.column(e["expr"], sub, inner)
            tag = f"__a{len(df.columns)}"
            body = truth(body) if isinstance(ring.zero, bool) and not self.boolean(e["expr"]) else body
            folded = sub.groupBy(*keys).agg(ring.plus(body).alias(tag))
            if not keys:
                return folded.withColumn(tag, F.coalesce(F.col(tag), F.lit(ring.zero))), F.col(tag)
            joined = df.join(folded, keys, "left").withColumn(tag, F.coalesce(F.col(tag), F.lit(ring.zero)))
            return joined, F.col(tag)
        if name in ("argmin", "argmax"):
            keys = list(df.columns)
            with self.within(e):
                sub, inner = self.enumerate(e, df)
                sub, body = self.column(e["expr"], sub, inner)
            tag = f"__w{len(df.columns)}"
            folded = sub.groupBy(*keys).agg(self.least(e, body).alias(tag))
            joined = df.join(folded, keys, "left")
            return joined.withColumn(tag, F.coalesce(F.col(tag), F.raise_error(F.lit(f"[empty_{name}] no {e['arg']} is admitted")).cast("double"))), F.col(tag)
        if name == "polygon_intersection_area":
            rings = []
            for a in e["args"]:
                df, ring = self.ring_of(a, df, names)
                rings.append(ring)
            return df, geometry.intersection_area(rings[0], rings[1], e.get("manifold", ""), float(e.get("radius", 1.0)))
        if name == "table_lookup":
            at = {}
            for axis, a in e["axes"].items():
                df, c = self.column(a, df, names)
                at[axis] = c
            table, output = self.table(e["table"])
            return df, table.lookup(output(e.get("output", 0)), **at)
        if name == "rank":
            symbol = [s for s, r in self.scope.items() if r == e["args"][0] and s in names]
            if len(symbol) != 1:
                raise QuernError("rank", f"{e['args'][0]} is no set of one symbol in scope")
            return df, names[symbol[0]]
        if name == "skolem":
            cols = []
            for a in e["args"]:
                df, c = self.column(a, df, names)
                cols.append(key_int(c))
            return df, skolem_edge(*cols) if e.get("symmetric") and len(cols) == 2 else skolem(*cols, symmetric=bool(e.get("symmetric")))
        if name in ("const", "fn") or name not in OPS:
            if name == "fn":
                from ..functions import closed

                args = []
                for a in e["args"]:
                    if is_node(a) and a["op"] == "const" and isinstance(a["value"], list):
                        args.append(a["value"])
                    else:
                        df, c = self.column(a, df, names)
                        args.append(c)
                return df, closed.call(e["name"], *args)
            if name == "const" and not isinstance(e["value"], list):
                return df, F.lit(e["value"])
            raise QuernError("unlowered_operator", name)
        cols = []
        for i, a in enumerate(e.get("args", [])):
            df, c = self.column(a, df, names)
            if name in LOGICAL or name == "ifelse" and i == 0:
                c = c if self.boolean(a) else truth(c)
            elif self.boolean(a):
                c = c.cast("double")
            cols.append(c)
        return df, op(name, *cols)

    def table(self, name: str) -> tuple[FunctionTable, object]:
        """A function table of the document, and how an output is called: by name, or by its number from 0."""
        spec = self.doc.get("function_tables", {}).get(name)
        if spec is None:
            raise QuernError("unknown_table", name)
        names = list(spec.get("outputs") or ["value"])
        data = spec["data"] if spec.get("outputs") else [spec["data"]]
        t = FunctionTable({a["name"]: a["values"] for a in spec["axes"]}, dict(zip(names, data, strict=True)), spec.get("interpolation", "linear"), spec.get("out_of_bounds", "clamp"))
        return t, lambda o: names[o] if isinstance(o, int) and o < len(names) else o

    # --- polygons ---

    def rings(self, name: str) -> Factor:
        """The rings of a factor whose last two axes are vertices and coordinates, by the axes before those."""
        f = self.factor(name)
        if len(f.axes) < 2:
            raise QuernError("polygon", f"{name} has no axes of vertices and coordinates")
        *own, v, k = f.axes
        pick = lambda i: F.max(F.when(F.col(k) == i, F.col(f.value)))
        points = f.df.groupBy(*own, v).agg(pick(1).alias("lon"), pick(2).alias("lat"))
        # A ring is one value: its vertices meet in one row, as many as a polygon has.
        ring = F.transform(F.array_sort(F.collect_list(F.struct(v, "lon", "lat"))), lambda p: F.struct(p["lon"].cast("double").alias("lon"), p["lat"].cast("double").alias("lat")))
        grouped = points.groupBy(*own) if own else points.groupBy()
        return Factor(grouped.agg(ring.alias("value")), tuple(own))

    def ring_of(self, e: Expr, df: DataFrame, names: Mapping[str, Column]) -> tuple[DataFrame, Column]:
        """The ring of a polygon, or of one of several by index(name, places)."""
        name, at = (e, []) if isinstance(e, str) else (e["args"][0], e["args"][1:]) if is_node(e) and e["op"] == "index" else (None, None)
        if name is None:
            raise QuernError("polygon", "an operand is a name, or index of a name")
        f, tag = self.rings(name), f"__p{len(df.columns)}"
        if len(f.axes) != len(at):
            raise QuernError("polygon", f"{name} has {len(f.axes)} axes before its vertices")
        if not at:
            return df.crossJoin(F.broadcast(f.df.select(F.col("value").alias(tag)))), F.col(tag)
        cols = []
        for a in at:
            df, c = self.column(a, df, names)
            cols.append(key_int(c))
        table = f.named(*[f"{tag}{i}" for i in range(len(at))], value=tag).df
        return df.join(table, [c == F.col(f"{tag}{i}") for i, c in enumerate(cols)], "left").drop(*[f"{tag}{i}" for i in range(len(at))]), F.col(tag)

    def clipped(self, e: Expr) -> Factor:
        """The overlap of two polygons as a factor of vertices and coordinates, closed: its first vertex stands again at the end."""
        df, rings = self.spark.range(1).select(), []
        for a in e["args"]:
            df, ring = self.ring_of(a, df, {})
            rings.append(ring)
        ring = geometry.close_ring(geometry.intersect_polygon(rings[0], rings[1], e.get("manifold", "")))
        v = df.select(F.posexplode(ring).alias("v", "p")).select((F.col("v") + 1).cast("long").alias("v"), "p")
        both = v.select("v", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("c"), F.col("p.lon").alias("x")), F.struct(F.lit(2).cast("long").alias("c"), F.col("p.lat").alias("x")))).alias("s"))
        return Factor(both.select("v", F.col("s.c").alias("c"), F.col("s.x").alias("value")), ("v", "c"))

    # --- arrays ---

    def factor(self, name: str) -> Factor:
        """An input, or what the equation of this name defines; a cycle is an error."""
        if name not in self.factors:
            if name not in self.equations:
                raise QuernError("undefined_name", name)
            if name in self.busy:
                raise QuernError("cycle", " -> ".join([*self.busy, name]))
            self.busy.append(name)
            self.factors[name] = self.array(self.equations[name])
            self.busy.pop()
        return self.factors[name]

    def array(self, e: Expr) -> Factor:
        """An expression as a keyed factor; scalars have no axes."""
        if isinstance(e, str) and e not in self.scalars:
            return self.factor(e)
        name = e["op"] if is_node(e) else None
        if name == "aggregate":
            return self.aggregate(e)
        if name == "intersect_polygon":
            return self.clipped(e)
        if name in ("argmin", "argmax"):
            return self.witness(e)
        if name == "const" and isinstance(e["value"], list):
            return self.literal(e["value"])
        if name == "makearray":
            regions, values = e["regions"], e["values"]
            shape = [max(r[k][1] for r in regions) for k in range(len(regions[0]))]
            axes = [f"d{k}" for k in range(1, len(shape) + 1)]
            grid = reduce(lambda a, b: a.crossJoin(b), [self.spark.range(1, n + 1).withColumnRenamed("id", a) for a, n in zip(axes, shape, strict=True)])
            bodies = []
            for v in values:
                grid, c = self.column(v, grid, {f"_{k}": F.col(a) for k, a in enumerate(axes, 1)} | self.bound(grid))
                bodies.append(c.cast("double"))
            return arrays.makearray(grid, axes, [([tuple(s) for s in r], b) for r, b in zip(regions, bodies, strict=True)])
        if name == "reshape":
            a = self.array(e["args"][0])
            return arrays.reshape(a, self.shape(a), e["shape"])
        if name == "transpose":
            return arrays.transpose(self.array(e["args"][0]), e.get("perm"))
        if name == "concat":
            parts = [self.array(a) for a in e["args"]]
            return arrays.concat(parts, [self.shape(p)[e.get("axis", 0)] for p in parts], e.get("axis", 0))
        if name == "broadcast":
            parts = [self.array(a) for a in e["args"]]
            axes = list(max((p.axes for p in parts), key=len))
            parts = [p.named(*axes[: len(p.axes)], value=p.value) if p.axes and p.axes[0] not in axes else p for p in parts]
            return arrays.broadcast(lambda *c: op(e["fn"], *c), parts, axes, {})
        df, c = self.column(e, self.spark.range(1).select(), {})
        return Factor(df.select(c.alias("value")), ())

    def shape(self, a: Factor) -> list[int]:
        return list(a.df.agg(*[F.max(x) for x in a.axes]).first())

    def literal(self, value: list) -> Factor:
        rows: list[tuple] = []

        def walk(v, at):
            if isinstance(v, list):
                for i, x in enumerate(v, 1):
                    walk(x, (*at, i))
            else:
                rows.append((*at, float(v)))

        walk(value, ())
        axes = tuple(f"d{k}" for k in range(1, len(rows[0])))
        return Factor(self.spark.createDataFrame(rows, ", ".join([*(f"{a} long" for a in axes), "value double"])), axes)

    def aggregate(self, e: Expr) -> Factor:
        """Dense over the output indices: places without an admitted term get the semiring's zero."""
        out = e.get("output_idx", [])
        if e.get("distinct"):
            m = self.members(e)
            return Factor(m.select("pos", F.lit(1.0).alias("value")), ("pos",))
        ring = semiring(e.get("semiring"), e.get("reduce"))
        if out and isinstance(ring.zero, bool):
            raise QuernError("boolean_array", "bool_and_or folds to one value, or mints members with `distinct`")
        inner = e["expr"]
        if is_node(inner) and inner["op"] == "argmin" and out == list(e.get("ranges", {})) and e.get("filter") is None and not e.get("join") and not inner.get("output_idx"):
            # A fold of one term, the nearest of another set.
            if (found := self.nearest_of({**inner, "output_idx": out, "ranges": e["ranges"] | inner.get("ranges", {})})) is not None:
                return found
        with self.within(e):
            if (found := self.prefix_of(e)) is not None:
                return self.running(e, ring, *found)
            own = {s: r for s, r in e.get("ranges", {}).items() if s in out}
            dense, _ = self.enumerate({"ranges": own}) if out else (self.spark.range(1).select(), {})
            dense = dense.select(*out)
            if (parts := self.product_of(e, ring)) is not None:
                folded = contract(parts, list(out), ring, "value", {s: self.sets[r["from"]].size for s, r in e["ranges"].items()})
                folded = dense.join(folded, list(out), "left") if out else folded
                return Factor(folded.withColumn("value", F.coalesce("value", F.lit(ring.zero))), tuple(out))
            df, names = self.enumerate(e)
            df, body = self.column(e["expr"], df, names)
        if out and out == list(e.get("ranges", {})):
            # Nothing is folded: a minted key is kept as it is, and a place has one term.
            kind = df.select(body.alias("value")).schema["value"].dataType
            if kind.typeName() in ("struct", "array", "string"):
                return Factor(df.select(*out, body.alias("value")), tuple(out))
        body = truth(body) if isinstance(ring.zero, bool) and not self.boolean(e["expr"]) else body.cast("boolean" if isinstance(ring.zero, bool) else "double")
        if not out:
            return Factor(df.agg(ring.plus(body).alias("value")).withColumn("value", F.coalesce("value", F.lit(ring.zero))), ())
        check_keys(df, *out)
        folded = df.groupBy(*out).agg(ring.plus(body).alias("value"))
        return Factor(dense.join(folded, list(out), "left").withColumn("value", F.coalesce("value", F.lit(ring.zero))), tuple(out))

    def product_of(self, e: Expr, ring) -> list[Factor] | None:
        """The factors of a body that is the ring's product of two or more arrays, each by symbols of interval sets; None for any other.

        Such a fold is contracted index by index, and symbols that no factor ties to others are never multiplied out.
        """
        ranges, times = e.get("ranges", {}), PRODUCT.get(ring.name)
        plain = all(isinstance(r, dict) and not r.get("of") and self.kind(r["from"]) == "interval" for r in ranges.values())
        if times is None or not plain or e.get("filter") is not None or e.get("join") or e.get("key") is not None:
            return None
        terms, parts, scale = [e["expr"]], [], None
        while terms:
            t = terms.pop(0)
            if is_node(t) and t["op"] == times:
                terms = list(t["args"]) + terms
            elif is_node(t) and t["op"] == "index" and isinstance(t["args"][0], str) and t["args"][0] not in self.model.get("states", ()):
                parts.append((t["args"][0], t["args"][1:]))
            elif isinstance(t, int | float) and not isinstance(t, bool) or isinstance(t, str) and t in self.scalars:
                x = float(self.scalars.get(t, t) if isinstance(t, str) else t)
                scale = x if scale is None else scale * x if times == "*" else scale + x
            else:
                return None
        used = [s for _, at in parts for s in at]
        if len(parts) < 2 or any(not isinstance(s, str) or s not in ranges for s in used) or set(used) != set(ranges) or any(len(set(at)) < len(at) for _, at in parts):
            return None
        out = []
        for name, at in parts:
            f = self.factor(name)
            if len(f.axes) != len(at):
                return None
            f = f.named(*at, value="value")
            inside = reduce(lambda a, b: a & b, [F.col(s).between(1, self.sets[ranges[s]["from"]].size) for s in at])
            value = F.col("value").cast("double")
            if scale is not None:
                value, scale = (value * scale if times == "*" else value + scale), None
            out.append(Factor(f.df.where(inside).select(*at, value.alias("value")), tuple(at)))
        return out

    def prefix_of(self, e: Expr) -> tuple[str, str, bool, bool] | None:
        """(output symbol, contracted symbol, strict, reverse) if e folds one symbol up to another of the same set, and nothing else."""
        out, ranges, test = e.get("output_idx", []), e.get("ranges", {}), e.get("filter")
        if not is_node(test) or test["op"] not in PREFIX or e.get("join") or e.get("key") is not None or len(ranges) != len(out) + 1:
            return None
        rest = [s for s in ranges if s not in out]
        (j, i), op_ = test["args"], test["op"]
        if i == (rest or [None])[0]:
            i, j, op_ = j, i, TURNED[op_]
        same = rest == [j] and i in out and all(isinstance(r, dict) and not r.get("of") for r in ranges.values()) and ranges[i]["from"] == ranges[j]["from"] and self.kind(ranges[i]["from"]) == "interval"
        return (i, j, *PREFIX[op_]) if same and i not in free_variables(e["expr"]) else None

    def running(self, e: Expr, ring, i: str, j: str, strict: bool, reverse: bool) -> Factor:
        """A prefix fold by a window over the contracted symbol: rows like the set, not like its square."""
        out = e["output_idx"]
        df, names = self.enumerate({"ranges": {s: r for s, r in e["ranges"].items() if s != i}})
        df, body = self.column(e["expr"], df, names)
        df = df.select(*[s for s in out if s != i], F.col(j).alias(i), body.cast("double").alias("__term"))
        folded = prefix(df, [s for s in out if s != i], i, F.col("__term"), ring, strict, reverse)
        return Factor(folded.select(*out, "value"), tuple(out))

    def witness(self, e: Expr) -> Factor:
        """argmin / argmax over one symbol: the witnessing place of each output place, the smallest of ties."""
        out = e.get("output_idx", [])
        if (found := self.nearest_of(e)) is not None:
            return found
        with self.within(e):
            df, names = self.enumerate(e)
            df, body = self.column(e["expr"], df, names)
            own = {s: r for s, r in e.get("ranges", {}).items() if s in out}
            dense = self.enumerate({"ranges": own})[0].select(*out) if out else self.spark.range(1).select()
        none = F.raise_error(F.lit(f"[empty_{e['op']}] no {e['arg']} is admitted")).cast("double")
        best = self.least(e, body).alias("value")
        folded = dense.join(df.groupBy(*out).agg(best), list(out), "left") if out else df.agg(best)
        return Factor(folded.withColumn("value", F.coalesce("value", none)), tuple(out))

    def nearest_of(self, e: Expr) -> Factor | None:
        """argmin over j of |a[i] - b[j]|, and nothing else: both sides are sorted together along the axis, their product is never made."""
        out, ranges, body = e.get("output_idx", []), e.get("ranges", {}), e.get("expr")
        if e["op"] != "argmin" or len(out) != 1 or len(ranges) != 2 or e.get("filter") is not None or e.get("join") or not is_node(body) or body["op"] != "abs":
            return None
        i, j = out[0], e["arg"]
        apart = body["args"][0]
        plain = {i, j} == set(ranges) and all(isinstance(r, dict) and not r.get("of") and self.kind(r["from"]) == "interval" for r in ranges.values())
        sides = {a["args"][1]: a["args"][0] for a in apart["args"] if is_node(a) and a["op"] == "index" and len(a["args"]) == 2 and isinstance(a["args"][0], str) and isinstance(a["args"][1], str)} if is_node(apart) and apart["op"] == "-" and len(apart["args"]) == 2 else {}
        if not plain or set(sides) != {i, j} or set(sides.values()) & set(self.model.get("states", ())) or any(len(self.factor(n).axes) != 1 for n in sides.values()):
            return None
        size = {s: self.sets[ranges[s]["from"]].size for s in (i, j)}
        points, targets = (self.factor(sides[s]).named(s, value=v).df.where(F.col(s).between(1, size[s])).select(F.col(s).cast("long").alias(s), F.col(v).cast("double").alias(v)) for s, v in ((i, "__x"), (j, "__y")))
        near = nearest(points, targets, i, j, "__x", "__y").select(F.col(i).alias("__i"), F.col(j).cast("double").alias("value"))
        dense = self.sets[ranges[i]["from"]].positions(self.spark, i)
        none = F.raise_error(F.lit(f"[empty_argmin] no {j} is admitted")).cast("double")
        return Factor(dense.join(near, F.col(i) == F.col("__i"), "left").select(i, F.coalesce("value", none).alias("value")), (i,))

    def least(self, e: Expr, body: Column) -> Column:
        """The place of arg with the least (argmax: largest) value, the smallest of ties; null and NaN values take no part."""
        v = (-body if e["op"] == "argmax" else body).cast("double")
        return F.min(F.when(v.isNotNull() & ~F.isnan(v), F.struct(v.alias("v"), F.col(e["arg"]).alias("w"))))["w"].cast("double")

    def invented(self) -> Invented:
        """Everything that the document invents from data: its derived sets, who is in them, which place each member got, what is folded by them, and the buffers that joins go by."""
        out = Invented({}, {}, {}, {}, {})
        for name, s in self.doc.get("index_sets", {}).items():
            if s["kind"] != "derived":
                continue
            made = self.derived(name)
            if made.frame is None:
                out.extents[name] = made.size
                continue
            out.members[name] = made.frame.select("member")
            out.assignments[name] = made.frame.select("member", "pos")
            out.extents[name] = made.frame.count()
        for name, rhs in self.equations.items():
            nodes = [rhs] if is_node(rhs) else []
            while nodes:
                e = nodes.pop()
                sets = [r["from"] for s, r in (e.get("ranges") or {}).items() if isinstance(r, dict) and s in (e.get("output_idx") or [])]
                if any(self.kind(x) == "derived" for x in sets):
                    out.groups[name] = self.factor(name)
                for clause in e.get("join") or []:
                    for k in (k for pair in clause.get("on", []) for k in pair):
                        if k in self.equations:
                            out.join_key_buffers[k] = self.factor(k)
                nodes += [a for a in [*e.get("args", []), e.get("expr"), e.get("filter"), e.get("key")] if is_node(a)]
        return out

    def inspect(self) -> dict[str, dict]:
        """What has been built so far: of each name its axes and schema and the plan that Spark makes of it, and of each set its kind and size."""
        out = {}
        for name, f in self.factors.items():
            out[name] = {"kind": "input" if name not in self.equations else "equation", "axes": list(f.axes), "schema": f.df.schema.simpleString(), "plan": f.df._jdf.queryExecution().optimizedPlan().toString()}
        for name, s in self.sets.items():
            out[name] = {"kind": s.kind, "size": s.size} if s.frame is None else {"kind": s.kind, "schema": s.frame.schema.simpleString(), "plan": s.frame._jdf.queryExecution().optimizedPlan().toString()}
        return out

    def evaluate(self, name: str) -> DataFrame:
        f = self.factor(name)
        return f.df.select(*f.axes, F.col(f.value).alias("value"))
