"""Systems of equations: reactions, coupling, graphs, units, and grouped simulation."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from fractions import Fraction
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuernError
from ..shared import saved
from ..streaming.cadence import check_acyclic
from ..streaming.refresh import schedule_times
from .expressions import Expr, expand_templates, free_variables, is_node, node, numeric, simplify, substitute

# --- reactions ---


def mass_action(reactions: list[dict], reservoirs: set[str] = frozenset()) -> dict[str, Expr]:
    """dS/dt = sum over reactions of net stoichiometry * rate * product of substrates to their order; reservoir species have no equation.

    A reaction is {rate, substrates: {species: n}, products: {species: n}}.
    """
    terms: dict[str, list] = {}
    for r in reactions:
        flow = node("*", r["rate"], *[s if n == 1 else node("^", s, n) for s, n in r["substrates"].items()])
        for s in {**r["substrates"], **r["products"]}:
            net = r["products"].get(s, 0) - r["substrates"].get(s, 0)
            if s not in reservoirs and net:
                terms.setdefault(s, []).append(node("*", net, flow))
            elif s not in reservoirs:
                terms.setdefault(s, [])
    return {s: simplify(node("+", *t)) if t else 0.0 for s, t in terms.items()}


def stoichiometry(spark: SparkSession, reactions: list[dict]) -> DataFrame:
    """(reaction, species, substrate, product, net), one row a pair."""
    rows = [(i, s, float(r["substrates"].get(s, 0)), float(r["products"].get(s, 0))) for i, r in enumerate(reactions, 1) for s in {**r["substrates"], **r["products"]}]
    return spark.createDataFrame(rows, "reaction long, species string, substrate double, product double").withColumn("net", F.col("product") - F.col("substrate"))


def stoichiometric_matrix(stoich: DataFrame, n_reactions: int, value: str = "net") -> DataFrame:
    """Species by reactions r1, r2, ...; 0 where a species takes no part. value: net, substrate or product."""
    wide = stoich.groupBy("species").pivot("reaction", list(range(1, n_reactions + 1))).agg(F.sum(value))
    return wide.select("species", *[F.coalesce(F.col(f"`{i}`"), F.lit(0.0)).alias(f"r{i}") for i in range(1, n_reactions + 1)])


def reaction_rates(stoich: DataFrame, rates: DataFrame, amounts: DataFrame) -> DataFrame:
    """(species, rate of change) by joins: flow = rate * product of amounts ^ order, then net stoichiometry * flow summed by species."""
    order = stoich.where("substrate > 0").join(amounts, "species").groupBy("reaction").agg(F.product(F.pow("amount", "substrate")).alias("p"))
    flow = rates.join(order, "reaction", "left").select("reaction", (F.col("rate") * F.coalesce("p", F.lit(1.0))).alias("flow"))
    return stoich.join(flow, "reaction").groupBy("species").agg(F.sum(F.col("net") * F.col("flow")).alias("change"))


# --- flattening and coupling ---


def flatten(models: Mapping[str, Mapping[str, Expr]], coupling: list[dict] = ()) -> dict[str, Expr]:
    """Equations of all models under dotted names, coupled. A model maps names to right-hand sides.

    operator_compose adds the right-hand sides of equal names (translate: other names); couple adds, multiplies
    or replaces by connector equations; variable_map puts another model's variable, perhaps scaled, in the place
    of a parameter (param_to_var, conversion_factor, or an expression of _var), or keeps the target and adds or
    multiplies (additive, multiplicative, identity).
    """
    out: dict[str, Expr] = {}
    for m, eqs in models.items():
        names = {n: f"{m}.{n}" for n in eqs}
        out |= {f"{m}.{n}": substitute(e, names) for n, e in eqs.items()}
    for c in coupling:
        kind = c["type"]
        if kind == "operator_compose":
            into, source = c["systems"]
            for n, e in list(models[source].items()):
                target = c.get("translate", {}).get(n, n)
                full = f"{into}.{target}"
                if full not in out:
                    raise QuernError("compose_target", full)
                moved = substitute(out.pop(f"{source}.{n}"), {f"{source}.{n}": full})
                out[full] = simplify(node("+", out[full], substitute(moved, {"_var": full})))
                out = {k: substitute(v, {f"{source}.{n}": full}) for k, v in out.items()}
        elif kind == "couple":
            for eq in c["connector"]:
                how, to = eq.get("transform", "additive"), eq["to"]
                if to not in out:
                    raise QuernError("couple_target", to)
                out[to] = eq["expression"] if how == "replacement" else node("+" if how == "additive" else "*", out[to], eq["expression"])
        elif kind == "variable_map":
            source, to, how = c["from"], c["to"], c.get("transform", "param_to_var")
            value = node("*", c["factor"], source) if "factor" in c else source
            if is_node(how):
                value, how = substitute(how, {"_var": source}), "param_to_var"
            if how in ("additive", "multiplicative"):
                value = node("+" if how == "additive" else "*", out.get(to, to), value)
            if how in ("identity", "additive", "multiplicative"):
                out[to] = value
            elif how in ("param_to_var", "conversion_factor"):
                out.pop(to, None)
                out = {k: substitute(v, {to: value}) for k, v in out.items()}
            else:
                raise QuernError("variable_map_transform", str(how))
        else:
            raise QuernError("coupling_type", kind)
    return out


def eliminate(algebraic: Mapping[str, Expr], rhs: Mapping[str, Expr]) -> dict[str, Expr]:
    """Right-hand sides with acyclic definitions var = expr put in; cyclic ones are an error."""
    try:
        order = [n for n in check_acyclic({n: free_variables(e) & set(algebraic) for n, e in algebraic.items()}) if n in algebraic]
    except QuernError as e:
        raise QuernError("E_NONTRIVIAL_DAE", str(e)) from None
    done: dict[str, Expr] = {}
    for n in order:
        done[n] = substitute(algebraic[n], done)
    return {n: substitute(e, done) for n, e in rhs.items()}


def observed(trajectory: DataFrame, definitions: Mapping[str, Expr], parameters: Mapping[str, float] | None = None) -> DataFrame:
    """Columns recovered along a wide trajectory, in dependency order."""
    from .expressions import column

    names = {c: F.col(f"`{c}`") for c in trajectory.columns} | {k: F.lit(float(v)) for k, v in (parameters or {}).items()}
    for n in [x for x in check_acyclic({n: free_variables(e) & set(definitions) for n, e in definitions.items()}) if x in definitions]:
        trajectory = trajectory.withColumn(n, column(definitions[n], names))
        names[n] = F.col(f"`{n}`")
    return trajectory


# --- graphs ---


def expression_graph(spark: SparkSession, equations: Mapping[str, Expr]) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, defined), (edges: src, dst): dst is defined by reading src."""
    edges = sorted({(r, n) for n, e in equations.items() for r in free_variables(e)})
    ids = sorted(set(equations) | {a for a, _ in edges})
    return spark.createDataFrame([(i, i in equations) for i in ids], "id string, defined boolean"), spark.createDataFrame(edges, "src string, dst string")


def component_graph(spark: SparkSession, models: list[str], coupling: list[dict]) -> tuple[DataFrame, DataFrame]:
    edges = []
    for c in coupling:
        ends = c.get("systems") or [c.get("from", "").split(".")[0], c.get("to", "").split(".")[0]]
        edges.append((ends[0], ends[1], c["type"]))
    return spark.createDataFrame([(m,) for m in models], "id string"), spark.createDataFrame(edges, "src string, dst string, kind string")


def to_dot(nodes: list[str], edges: list[tuple]) -> str:
    return "digraph {\n" + "".join(f'  "{n}";\n' for n in nodes) + "".join(f'  "{e[0]}" -> "{e[1]}";\n' for e in edges) + "}\n"


def to_mermaid(nodes: list[str], edges: list[tuple]) -> str:
    at = {n: f"n{i}" for i, n in enumerate(nodes)}
    return "graph LR\n" + "".join(f"  {at[n]}[{n}]\n" for n in nodes) + "".join(f"  {at[e[0]]} --> {at[e[1]]}\n" for e in edges)


def levels(edges: DataFrame) -> DataFrame:
    """(id, level): the longest chain of edges that ends in each node of an acyclic graph; one join a level."""
    level = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("level", F.lit(0))
    n = level.count()
    for _ in range(n + 1):
        up = level.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("node")).agg((F.max("level") + 1).alias("up"))
        new = saved(level.join(up, F.col("id") == F.col("node"), "left").select("id", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")), "levels")
        grown = new.join(level.withColumnRenamed("level", "old"), "id").where("level > old").limit(1).count()
        level = new
        if not grown:
            return level
    raise QuernError("cycle", "the graph is not acyclic")


def strong_components(reads: Mapping[str, set[str]]) -> list[list[str]]:
    """Groups of names that read each other, by two depth-first walks over the catalogue's names."""
    names = sorted(set(reads) | {x for r in reads.values() for x in r})
    order, seen = [], set()

    def walk(start: str, step: Callable[[str], list[str]], out: list[str]):
        todo = [(start, iter(step(start)))]
        seen.add(start)
        while todo:
            n, it = todo[-1]
            nxt = next((x for x in it if x not in seen), None)
            if nxt is None:
                out.append(n)
                todo.pop()
            else:
                seen.add(nxt)
                todo.append((nxt, iter(step(nxt))))

    for n in names:
        if n not in seen:
            walk(n, lambda x: sorted(reads.get(x, ())), order)
    back: dict[str, list[str]] = {n: [] for n in names}
    for n, rs in reads.items():
        for r in rs:
            back[r].append(n)
    seen, groups = set(), []
    for n in reversed(order):
        if n not in seen:
            groups.append(group := [])
            walk(n, lambda x: sorted(back[x]), group)
    return [sorted(g) for g in groups]


# --- units ---

#: Base dimensions: length, mass, time, temperature, amount, current, light. name: (factor to SI, exponents).
UNITS = {
    "m": (1.0, (1, 0, 0, 0, 0, 0, 0)), "kg": (1.0, (0, 1, 0, 0, 0, 0, 0)), "g": (1e-3, (0, 1, 0, 0, 0, 0, 0)), "s": (1.0, (0, 0, 1, 0, 0, 0, 0)), "K": (1.0, (0, 0, 0, 1, 0, 0, 0)), "mol": (1.0, (0, 0, 0, 0, 1, 0, 0)),
    "A": (1.0, (0, 0, 0, 0, 0, 1, 0)), "cd": (1.0, (0, 0, 0, 0, 0, 0, 1)), "min": (60.0, (0, 0, 1, 0, 0, 0, 0)), "h": (3600.0, (0, 0, 1, 0, 0, 0, 0)), "hr": (3600.0, (0, 0, 1, 0, 0, 0, 0)), "day": (86400.0, (0, 0, 1, 0, 0, 0, 0)), "yr": (31557600.0, (0, 0, 1, 0, 0, 0, 0)),
    "L": (1e-3, (3, 0, 0, 0, 0, 0, 0)), "N": (1.0, (1, 1, -2, 0, 0, 0, 0)), "Pa": (1.0, (-1, 1, -2, 0, 0, 0, 0)), "J": (1.0, (2, 1, -2, 0, 0, 0, 0)), "W": (1.0, (2, 1, -3, 0, 0, 0, 0)), "Hz": (1.0, (0, 0, -1, 0, 0, 0, 0)),
    "rad": (1.0, (0,) * 7), "deg": (math.pi / 180, (0,) * 7), "ppm": (1e-6, (0,) * 7), "ppb": (1e-9, (0,) * 7), "ton": (907.18474, (0, 1, 0, 0, 0, 0, 0)), "atm": (101325.0, (-1, 1, -2, 0, 0, 0, 0)), "bar": (1e5, (-1, 1, -2, 0, 0, 0, 0)),
    "C": (1.0, (0, 0, 1, 0, 0, 1, 0)), "V": (1.0, (2, 1, -3, 0, 0, -1, 0)), "degC": (1.0, (0, 0, 0, 1, 0, 0, 0)), "°C": (1.0, (0, 0, 0, 1, 0, 0, 0)), "degF": (5 / 9, (0, 0, 0, 1, 0, 0, 0)), "°F": (5 / 9, (0, 0, 0, 1, 0, 0, 0)), "degree": (math.pi / 180, (0,) * 7), "degrees": (math.pi / 180, (0,) * 7),
    "DU": (2.6867e20, (-2, 0, 0, 0, 0, 0, 0)), "cal": (4.184, (2, 1, -2, 0, 0, 0, 0)), "short_ton": (907.18474, (0, 1, 0, 0, 0, 0, 0)), "tonne": (1000.0, (0, 1, 0, 0, 0, 0, 0)), "lb": (0.45359237, (0, 1, 0, 0, 0, 0, 0)), "eV": (1.602176634e-19, (2, 1, -2, 0, 0, 0, 0)), "mi": (1609.344, (1, 0, 0, 0, 0, 0, 0)), "ft": (0.3048, (1, 0, 0, 0, 0, 0, 0)), "year": (31557600.0, (0, 0, 1, 0, 0, 0, 0)), "ha": (1e4, (2, 0, 0, 0, 0, 0, 0)), "M": (1000.0, (-3, 0, 0, 0, 1, 0, 0)), "psi": (6894.757293168, (-1, 1, -2, 0, 0, 0, 0)), "ppt": (1e-12, (0,) * 7), "%": (1e-2, (0,) * 7), "percent": (1e-2, (0,) * 7), "Torr": (101325 / 760, (-1, 1, -2, 0, 0, 0, 0)), "sr": (1.0, (0,) * 7),
}
SIGNS = {ord("²"): "^2", ord("³"): "^3", ord("⋅"): "*", ord("×"): "*", ord("μ"): "µ", ord("⁻"): "^-"}
UNITS |= {
    "T": (1.0, (0, 1, -2, 0, 0, -1, 0)), "F": (1.0, (-2, -1, 4, 0, 0, 2, 0)), "Ω": (1.0, (2, 1, -3, 0, 0, -2, 0)), "Wh": (3600.0, (2, 1, -2, 0, 0, 0, 0)), "BTU": (1055.05585262, (2, 1, -2, 0, 0, 0, 0)), "erg": (1e-7, (2, 1, -2, 0, 0, 0, 0)), "mmHg": (133.322387415, (-1, 1, -2, 0, 0, 0, 0)),
    "meters": (1.0, (1, 0, 0, 0, 0, 0, 0)), "meter": (1.0, (1, 0, 0, 0, 0, 0, 0)), "hour": (3600.0, (0, 0, 1, 0, 0, 0, 0)), "Celsius": (1.0, (0, 0, 0, 1, 0, 0, 0)), "degrees_east": (math.pi / 180, (0,) * 7), "degrees_north": (math.pi / 180, (0,) * 7),
}
#: Counts and other plain numbers, which take no prefixes.
COUNTS = ("dimensionless", "molec", "molecule", "molecules", "individuals", "individual", "units", "unit", "count", "counts", "particles", "cells", "people", "person", "animals", "vehicles", "ppbv", "ppmv", "pptv", "fraction", "psu")
UNITS |= {name: ({"ppbv": 1e-9, "ppmv": 1e-6, "pptv": 1e-12}.get(name, 1.0), (0,) * 7) for name in COUNTS}
PREFIXES = {"G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "n": 1e-9, "p": 1e-12}


def unit(text: str) -> tuple[float, tuple[int, ...]]:
    """Factor to SI and dimensions of a unit such as "kg*m^2/s^2", "J/(mol*K)", "s^0.5", "ug/m3" or "1".

    Products and quotients are taken from left to right; powers are rational; a number stands for 1 only.
    """
    text = text.translate(SIGNS)
    tokens = re.findall(r"[()*/·^]|[+-]?\d+(?:\.\d+)?|[^\W\d]+[^\W\d]*|[°%µ][^\W\d]*|\S", text.replace("**", "^").strip() or "1")
    at = 0

    def power() -> Fraction:
        nonlocal at
        negative = at < len(tokens) and tokens[at] == "-"
        at += negative
        if at < len(tokens) and tokens[at] == "(":
            inner = "".join(tokens[at + 1 : tokens.index(")", at) if ")" in tokens[at:] else len(tokens)])
            at = tokens.index(")", at) + 1 if ")" in tokens[at:] else len(tokens)
            value = inner
        else:
            value = tokens[at] if at < len(tokens) else ""
            at += 1
        try:
            return -Fraction(value) if negative else Fraction(value)
        except (ValueError, ZeroDivisionError):
            raise QuernError("unit", text) from None

    def atom() -> tuple[float, list]:
        nonlocal at
        token = tokens[at] if at < len(tokens) else ""
        at += 1
        if token == "(":
            factor, dims = product()
            if at >= len(tokens) or tokens[at] != ")":
                raise QuernError("unit", text)
            at += 1
        elif re.fullmatch(r"\d+(\.\d+)?", token):
            if float(token) != 1:
                raise QuernError("unit", f"{token} in {text}")
            factor, dims = 1.0, [Fraction(0)] * 7
        else:
            scale, name = 1.0, token
            if name not in UNITS:
                if not name or name[0] not in PREFIXES or name[1:] not in UNITS or name[1:] in COUNTS:
                    raise QuernError("unit", f"{name} in {text}")
                scale, name = PREFIXES[name[0]], name[1:]
            factor, dims = UNITS[name][0] * scale, [Fraction(d) for d in UNITS[name][1]]
        p = Fraction(1)
        if at < len(tokens) and tokens[at] == "^":
            at += 1
            p = power()
        elif at < len(tokens) and token != "1" and re.fullmatch(r"[+-]?\d+", tokens[at]):
            p = power()
        return factor ** float(p), [d * p for d in dims]

    def product() -> tuple[float, list]:
        nonlocal at
        factor, dims = atom()
        while at < len(tokens) and tokens[at] != ")":
            sign = -1 if tokens[at] == "/" else 1
            at += tokens[at] in "*·/"
            f, d = atom()
            factor, dims = factor * f**sign, [x + sign * y for x, y in zip(dims, d, strict=True)]
        return factor, dims

    factor, dims = product()
    if at < len(tokens):
        raise QuernError("unit", text)
    return factor, tuple(int(d) if d.denominator == 1 else d for d in dims)


def convert_units(source: str, target: str) -> float:
    """What values in `source` are multiplied by to be in `target`."""
    (a, d), (b, e) = unit(source), unit(target)
    if d != e:
        raise QuernError("unit_dimensions", f"{source} is not {target}")
    return a / b


def check_units(e: Expr, units: Mapping[str, str]) -> tuple[int, ...]:
    """The dimensions of an expression; sums of different ones are an error."""
    if isinstance(e, int | float):
        return (0,) * 7
    if isinstance(e, str):
        return unit(units.get(e, "1"))[1]
    d = [check_units(a, units) for a in e["args"]]
    if e["op"] in ("+", "-", "min", "max", ">", "<", ">=", "<=", "==", "!="):
        if len({x for x, a in zip(d, e["args"], strict=True) if not isinstance(a, int | float)}) > 1:
            raise QuernError("unit_dimensions", f"{e['op']} of {d}")
        return (0,) * 7 if e["op"] in (">", "<", ">=", "<=", "==", "!=") else max(d, key=lambda x: sum(map(abs, x)))
    if e["op"] == "*":
        return tuple(map(sum, zip(*d, strict=True)))
    if e["op"] == "/":
        return tuple(a - b for a, b in zip(*d, strict=True))
    if e["op"] in ("^", "**", "pow") and isinstance(e["args"][1], int | float):
        return tuple(int(x * e["args"][1]) for x in d[0])
    return d[0] if e["op"] in ("neg", "abs", "ifelse") else (0,) * 7


# --- simulation ---

#: Butcher table of Dormand and Prince, order 5 with an embedded order 4.
_A = [[], [1 / 5], [3 / 40, 9 / 40], [44 / 45, -56 / 15, 32 / 9], [19372 / 6561, -25360 / 2187, 64448 / 6561, -212 / 729], [9017 / 3168, -355 / 33, 46732 / 5247, 49 / 176, -5103 / 18656], [35 / 384, 0, 500 / 1113, 125 / 192, -2187 / 6784, 11 / 84]]
_E = np.array([71 / 57600, 0, -71 / 16695, 71 / 1920, -17253 / 339200, 22 / 525, -1 / 40])
_C = [0, 1 / 5, 3 / 10, 4 / 5, 8 / 9, 1, 1]
#: Numbers in one array of states (increments of noise, Jacobians) that a task solves at a time.
SOLVED_AT_ONCE = 1 << 18


def integrate(f: Callable[[float, np.ndarray], np.ndarray], y: np.ndarray, times: list[float], rtol: float = 1e-8, atol: float = 1e-10, stiff: bool = False, events: list[tuple] = ()) -> np.ndarray:
    """States at `times` (the first is the start). Adaptive explicit steps, or for stiff systems implicit ones (trapezoid and backward, halved steps compared).

    events: (root(t, y), direction, affect(t, y) -> y); a root is bracketed by a step and found by halving it.
    """
    return integrate_many(_each(f), np.array(y, float)[None], times, rtol, atol, stiff, [(_each(root), direction, _each(affect)) for root, direction, affect in events])[:, 0]


def _each(f):
    """f of one trajectory for rows of them."""
    return lambda t, y, who: np.array([np.asarray(f(float(a), b), float) for a, b in zip(t, y, strict=True)])


def integrate_many(f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], y: np.ndarray, times: list[float], rtol: float = 1e-8, atol: float = 1e-10, stiff: bool = False, events: list[tuple] = ()) -> np.ndarray:
    """integrate() for rows of states, (time, row, state): each row has its own time and step, all rows that are not there yet step together.

    f, roots and affects take the times and states of some rows, and which rows they are.
    """
    y, step, power = np.array(y, float), _implicit if stiff else _explicit, -(0.5 if stiff else 0.2)
    t, h, out = np.full(len(y), float(times[0])), np.full(len(y), max((times[-1] - times[0]) / 100, 1e-12)), [y.copy()]
    for stop in times[1:]:
        while len(who := np.flatnonzero(t < stop)):
            at, own = t[who], y[who]
            dt = np.minimum(h[who], stop - at)
            with np.errstate(all="ignore"):
                new, error = step(f, at, own, dt, who)
                size = np.sqrt(np.mean((error / (atol + rtol * np.maximum(np.abs(own), np.abs(new)))) ** 2, axis=1)) if own.shape[1] else np.zeros(len(who))
                good, real = size <= 1, np.isfinite(size)
                less = np.where(real, np.maximum(0.1, 0.9 * size**power), 0.1)
                more = np.minimum(5.0, 0.9 * np.maximum(size, 1e-10) ** power)
            if (stuck := ~good & (dt * less < 1e-14 * np.maximum(1.0, np.abs(at)))).any():
                raise QuernError("step_too_small", f"at {at[stuck][0]}")
            first, by = np.full(len(who), np.inf), np.full(len(who), -1)
            for number, (root, direction, _) in enumerate(events):
                a, b = root(at, own, who), root(at + dt, new, who)
                hit = good & ((a * b < 0) | (a != 0) & (b == 0))
                if direction != "all":
                    hit &= (b > a) == (direction == "up")
                if not (x := np.flatnonzero(hit)).size:
                    continue
                lo, hi = np.zeros(len(x)), dt[x]
                for _ in range(60):
                    mid = (lo + hi) / 2
                    left = a[x] * root(at[x] + mid, step(f, at[x], own[x], mid, who[x])[0], who[x]) <= 0
                    lo, hi = np.where(left, lo, mid), np.where(left, mid, hi)
                sooner = hi < first[x]
                first[x[sooner]], by[x[sooner]] = hi[sooner], number
            for number, (_, _, affect) in enumerate(events):
                if (x := np.flatnonzero(by == number)).size:
                    now = at[x] + first[x]
                    y[who[x]] = affect(now, step(f, at[x], own[x], first[x], who[x])[0], who[x])
                    t[who[x]] = np.where(now > at[x], now, np.nextafter(at[x], np.inf))
            on = good & (by < 0)
            y[who[on]] = new[on]
            t[who[on]] = np.where(dt == stop - at, stop, at + dt)[on]
            h[who] = np.where(on, dt * more, np.where(good, dt, dt * less))
        out.append(y.copy())
    return np.array(out)


def _explicit(f, t, y, h, who):
    k, wide = [f(t, y, who)], h[:, None]
    for a, c in zip(_A[1:], _C[1:], strict=True):
        k.append(f(t + c * h, y + wide * sum(w * x for w, x in zip(a, k, strict=True)), who))
    return y + wide * sum(w * x for w, x in zip(_A[-1], k[:6], strict=True)), wide * sum(e * x for e, x in zip(_E, k, strict=True))


def _solve(f, t, y, h, theta, who):
    """y1 = y + h (theta f(t1, y1) + (1 - theta) f(t, y)) by Newton steps; a row that is there stays."""
    f0, done, n = f(t, y, who), y.copy(), y.shape[1]
    go = np.arange(len(y))
    for _ in range(12):
        z, wide, late = done[go], h[go][:, None], (t + h)[go]
        fz = f(late, z, who[go])
        r = z - y[go] - wide * (theta * fz + (1 - theta) * f0[go])
        jac = np.empty((len(go), n, n))
        for i in range(n):
            e = 1e-7 * np.maximum(1.0, np.abs(z[:, i]))
            zi = z.copy()
            zi[:, i] += e
            jac[:, :, i] = (f(late, zi, who[go]) - fz) / e[:, None]
        d = np.linalg.solve(np.eye(n) - wide[:, :, None] * theta * jac, -r[:, :, None])[:, :, 0]
        done[go] = z + d
        go = go[~(np.abs(d).max(1, initial=0) <= 1e-12 * np.maximum(1.0, np.abs(z + d).max(1, initial=0)))]
        if not len(go):
            break
    return done


def _implicit(f, t, y, h, who):
    """Two backward steps of half the size against one whole, extrapolated to second order."""
    whole = _solve(f, t, y, h, 1.0, who)
    half = _solve(f, t + h / 2, _solve(f, t, y, h / 2, 1.0, who), h / 2, 1.0, who)
    return 2 * half - whole, half - whole


def segmented(f: Callable[[float, np.ndarray], np.ndarray], y: np.ndarray, times: list[float], jumps: list[tuple], events: list[tuple] = (), **how) -> np.ndarray:
    """States at `times`, solved piece by piece between jumps (t, affect(t, y) -> y); a state at the time of a jump is the one after it."""
    roots = [(_each(root), direction, _each(affect)) for root, direction, affect in events]
    return segmented_many(_each(f), np.array(y, float)[None], times, [(t, _each(affect)) for t, affect in jumps], events=roots, **how)[:, 0]


def segmented_many(f, y: np.ndarray, times: list[float], jumps: list[tuple], **how) -> np.ndarray:
    """segmented() for rows of states, as integrate_many()."""
    marks = sorted({*times, *(t for t, _ in jumps if times[0] <= t <= times[-1])})
    y, at, who = np.array(y, float), {}, np.arange(len(y))
    for k, t in enumerate(marks):
        if k:
            y = integrate_many(f, y, [marks[k - 1], t], **how)[-1]
        for when, affect in jumps:
            if when == t:
                y = affect(np.full(len(y), float(t)), y, who)
        at[t] = y
    return np.array([at[t] for t in times])


def sweep(spark: SparkSession, parameters: Mapping[str, list[float]]) -> DataFrame:
    """The product of parameter ranges, with a member number."""
    rows = [(i, *map(float, v)) for i, v in enumerate(product(*parameters.values()))]
    return spark.createDataFrame(rows, "member long, " + ", ".join(f"{p} double" for p in parameters))


def linear_range(start: float, stop: float, n: int) -> list[float]:
    return [float(x) for x in np.linspace(start, stop, n)]


def log_range(start: float, stop: float, n: int) -> list[float]:
    return [float(x) for x in np.geomspace(start, stop, n)]


def simulate(ensemble: DataFrame, rhs: Mapping[str, Expr], initial: Mapping[str, float], times: list[float], constants: Mapping[str, float] | None = None, stiff: bool = False, noise: Mapping[str, Expr] | None = None, seed: int = 0, steps: int = 200, events: list[dict] = (), updates: list[dict] = ()) -> DataFrame:
    """(member, t, variable, value) of each row of `ensemble` (member and parameters): each member has its own steps, members of a batch step together, batches over the cluster.

    `noise` gives diffusion terms driven by independent Wiener increments, sqrt(dt) wide, in `steps` fixed steps
    between times, from a seed of the member. Unknown names are an error before anything runs.

    events: {root, direction (up, down, all), affect: {state: expression}} at roots of an expression; updates:
    {times and/or interval with offset, when (a condition, if any), affect} at given times. Noise takes neither.
    """
    if noise and (events or updates):
        raise QuernError("noise_events", "noisy runs take no events or updates")
    states = list(rhs)
    params = [c for c in ensemble.columns if c != "member"]
    fixed = {k: float(v) for k, v in (constants or {}).items()}
    known = {*states, *params, *fixed, "t"}
    if extra := {n for a in [*events, *updates] for n in a["affect"]} - {*states}:
        raise QuernError("undefined_name", ", ".join(sorted(extra)))
    ticks = [(t, u) for u in updates for t in schedule_times(times[0], times[-1], u.get("times"), u.get("interval"), u.get("offset", 0.0))]
    hooked = [x for a in [*events, *updates] for x in [*a["affect"].values(), a.get("root", 0.0), a.get("when", 0.0)]]
    for e in [*rhs.values(), *(noise or {}).values(), *hooked]:
        if missing := free_variables(e) - known:
            raise QuernError("undefined_name", ", ".join(sorted(missing)))
    if set(initial) - {*states}:
        raise QuernError("unknown_override", ", ".join(sorted(set(initial) - set(states))))

    width = max(1, len(states))
    at_once = max(1, SOLVED_AT_ONCE // (width * (steps if noise else width if stiff else 1)))

    def solve(batches):
        for whole in batches:
            for lo in range(0, len(whole), at_once):
                yield solved(whole.iloc[lo : lo + at_once])

    def solved(pdf):
        held = fixed | {p: pdf[p].to_numpy(dtype=float, na_value=np.nan) for p in params}

        def value(e, t, y, who):
            names = {n: x[who] if n in params else x for n, x in held.items()} | {"t": t} | dict(zip(states, y.T, strict=True))
            return np.broadcast_to(np.asarray(numeric(e, names), float), len(t))

        def f(t, y, who):
            return np.stack([value(rhs[s], t, y, who) for s in states], 1) if states else np.zeros_like(y)

        def change(what):
            def affect(t, y, who):
                new = np.stack([value(what["affect"][s], t, y, who) if s in what["affect"] else x for s, x in zip(states, y.T, strict=True)], 1)
                return np.where((value(what.get("when", 1.0), t, y, who) != 0)[:, None], new, y)

            return affect

        y0 = np.tile(np.array([float(initial.get(s, 0.0)) for s in states]), (len(pdf), 1))
        if noise:
            rngs, who = [np.random.default_rng([seed, int(m)]) for m in pdf["member"]], np.arange(len(pdf))
            y, ys = y0, [y0]
            for a, b in zip(times, times[1:], strict=False):
                dt = (b - a) / steps
                wiener = np.stack([rng.normal(0, math.sqrt(dt), (steps, len(states))) for rng in rngs], 1)
                for k in range(steps):
                    t = np.full(len(pdf), a + k * dt)
                    kick = np.stack([value(noise[s], t, y, who) if s in noise else np.zeros(len(pdf)) for s in states], 1)
                    y = y + dt * f(t, y, who) + kick * wiener[k]
                ys.append(y)
        else:
            roots = [(lambda t, y, who, e=e: value(e["root"], t, y, who), e.get("direction", "all"), change(e)) for e in events]
            ys = segmented_many(f, y0, times, [(t, change(u)) for t, u in ticks], stiff=stiff, events=roots)
        n, each = len(pdf), len(times) * len(states)
        return pd.DataFrame({"member": pdf["member"].repeat(each).to_numpy(), "t": np.tile(np.repeat(np.array(times, float), len(states)), n), "variable": np.tile(np.array(states, object), n * len(times)), "value": np.asarray(ys, float).transpose(1, 0, 2).ravel()})

    # Solving costs far more than a row's bytes tell, so members are spread whatever the size of their file.
    spread = ensemble.repartition(4 * ensemble.sparkSession.sparkContext.defaultParallelism, "member")
    return spread.mapInPandas(solve, "member long, t double, variable string, value double")


def lower(e: Expr, templates: Mapping[str, dict], enums: Mapping[str, Mapping[str, int]]) -> Expr:
    """Templates expanded and enum symbols made numbers."""
    e = expand_templates(e, templates)

    def walk(x: Expr) -> Expr:
        if not is_node(x):
            return x
        if x["op"] == "enum":
            name, symbol = x["args"]
            if symbol not in enums.get(name, {}):
                raise QuernError("unknown_enum", f"{name}.{symbol}")
            return enums[name][symbol]
        return {**x, "args": [walk(a) for a in x.get("args", [])]} | {k: walk(x[k]) for k in ("expr", "filter", "key") if k in x}

    return walk(e)
