"""Fields: pointwise equations over grids, shapes passed on to readers, rates at given states, initial fields and inline tests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QuernError
from ..operators.arrays import aligned
from ..streaming.cadence import check_acyclic
from ..types import Factor
from .expressions import Expr, column, free_variables, is_node


def pointwise(e: Expr) -> list[str]:
    """Names that an expression reads element by element, in order; what index and aggregate read is not."""
    if isinstance(e, str):
        return [e]
    if not is_node(e) or e["op"] in ("index", "aggregate", "argmin", "argmax"):
        return []
    return list(dict.fromkeys(n for a in e.get("args", []) for n in pointwise(a)))


def promoted(equations: Mapping[str, Expr], declared: Mapping[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Axes of every name: the declared ones, or all axes that its right side reads, those of the widest operand first.

    A declared shape that lacks an axis of what is read is an error, as is a cycle of names without a shape.
    """
    out = {n: tuple(a) for n, a in declared.items()}
    reads = {n: pointwise(e) for n, e in equations.items()}
    order = check_acyclic({n: {r for r in rs if r in equations and r not in declared} for n, rs in reads.items()})
    for n in [*[x for x in order if x in equations], *[x for x in equations if x not in order]]:
        own = tuple(dict.fromkeys(a for r in sorted(reads[n], key=lambda r: -len(out.get(r, ()))) for a in out.get(r, ())))
        if n in declared:
            if extra := set(own) - set(out[n]):
                raise QuernError("shape_promotion", f"{n} over {list(out[n])} reads an operand over {sorted(extra)}")
        else:
            out[n] = own
    return out


def lift(e: Expr, fields: Mapping[str, Factor], scalars: Mapping[str, float] | None = None, axes: tuple[str, ...] | None = None, sets: Mapping[str, DataFrame] | None = None) -> Factor:
    """A scalar expression at every place of a grid: arrays it names are joined on the axes they share, numbers stay literals.

    The widest array comes first, so narrower ones join many to one. Axes asked for that no array has are
    repeated over their set.
    """
    own = sorted([n for n in pointwise(e) if n in fields], key=lambda n: -len(fields[n].axes))
    axes = promoted({"": e}, {n: fields[n].axes for n in own})[""] if axes is None else axes
    if not own and not axes:
        raise QuernError("shape_promotion", "an expression without arrays or axes is a number")
    parts = [fields[n].named(*fields[n].axes, value=f"__v{k}") for k, n in enumerate(own)]
    frame = aligned(list(axes), parts, dict(sets or {}))
    names: dict[str, Column] = {k: F.lit(float(v)) for k, v in (scalars or {}).items()} | {n: F.col(f"__v{k}") for k, n in enumerate(own)}
    return Factor(frame.select(*axes, column(e, names).cast("double").alias("value")), tuple(axes))


def solve_pointwise(equations: Mapping[str, Expr], fields: Mapping[str, Factor], scalars: Mapping[str, float] | None = None) -> dict[str, Factor]:
    """All defined names as fields, each over its promoted shape, in dependency order."""
    shapes = promoted(equations, {n: f.axes for n, f in fields.items()})
    done = dict(fields)
    for n in [x for x in check_acyclic({n: set(pointwise(e)) & set(equations) for n, e in equations.items()}) if x in equations]:
        done[n] = lift(equations[n], done, scalars, shapes[n])
    return {n: done[n] for n in equations}


def evaluate_rhs(states: DataFrame, rhs: Mapping[str, Expr], constants: Mapping[str, float] | None = None) -> DataFrame:
    """states with d_<name> = the rate of each state at that row (states, parameters and t are columns); one projection."""
    names = {n: F.col(f"`{n}`") for n in states.columns} | {k: F.lit(float(v)) for k, v in (constants or {}).items()}
    if missing := {x for e in rhs.values() for x in free_variables(e)} - set(names):
        raise QuernError("undefined_name", ", ".join(sorted(missing)))
    return states.withColumns({f"d_{n}": column(e, names).cast("double") for n, e in rhs.items()})


def initial_field(e: Expr, grid: DataFrame, axes: list[str], coordinates: Mapping[str, Column], scalars: Mapping[str, float] | None = None) -> Factor:
    """A state's first values from an expression of coordinates, at every place of a grid."""
    names = dict(coordinates) | {k: F.lit(float(v)) for k, v in (scalars or {}).items()}
    return Factor(grid.select(*axes, column(e, names).cast("double").alias("value")), tuple(axes))


#: Reductions of a field that an assertion may name; the errors compare with the trajectory's `reference` column.
REDUCE = ("mean", "max", "min", "L2_error", "Linf_error")


def inline_tests(trajectory: DataFrame, assertions: list[dict], axes: tuple[str, ...] = ()) -> DataFrame:
    """(test, variable, time, expected, actual, passed) of each assertion about a trajectory (t, variable, value, axes..., perhaps reference).

    An assertion has variable, time, expected, perhaps a tolerance (abs, rel of the larger side; either suffices,
    without one rel is 1e-6), and for fields coords (the nearest place is read, ties go to smaller
    values) or reduce. Without records at that time, or with several and neither coords nor reduce, it fails
    with a null actual value. One join and one fold, whatever the number of assertions.
    """
    rows = []
    for k, a in enumerate(assertions):
        if a.get("reduce") not in (None, *REDUCE) or a.get("reduce") and a.get("coords"):
            raise QuernError("assertion", f"{k}: reduce is one of {REDUCE}, without coords")
        if extra := set(a.get("coords", {})) - set(axes):
            raise QuernError("assertion", f"{k}: no axis {sorted(extra)}")
        bound = a.get("tolerance") or {"rel": 1e-6}
        at = [float(a["coords"][x]) if x in a.get("coords", {}) else None for x in axes]
        rows.append((k, a["variable"], float(a["time"]), float(a["expected"]), bound.get("abs"), bound.get("rel"), a.get("reduce"), bool(a.get("coords")), *at))
    schema = "test long, variable string, time double, expected double, abs double, rel double, reduce string, sampled boolean"
    tests = trajectory.sparkSession.createDataFrame(rows, schema + "".join(f", at_{x} double" for x in axes))
    frame = trajectory if "reference" in trajectory.columns else trajectory.withColumn("reference", F.lit(None).cast("double"))
    frame = frame.select(F.col("t").cast("double").alias("time"), "variable", F.col("value").cast("double").alias("value"), F.col("reference").cast("double").alias("reference"), *axes)
    v, r = F.col("value"), F.col("reference")
    far = sum((F.coalesce((F.col(x) - F.col(f"at_{x}")) ** 2, F.lit(0.0)) for x in axes), F.lit(0.0))
    folds = {"mean": F.avg(v), "max": F.max(v), "min": F.min(v), "L2_error": F.sqrt(F.sum((v - r) ** 2) / F.sum(r * r)), "Linf_error": F.max(F.abs(v - r))}
    met = frame.join(tests, ["variable", "time"]).groupBy("test").agg(F.min(F.struct(far.alias("far"), v.alias("value"))).alias("near"), F.count("*").alias("n"), *[f.alias(f"by_{k}") for k, f in folds.items()])
    actual = F.when(F.col("sampled") | (F.col("n") == 1) & F.col("reduce").isNull(), F.col("near.value"))
    for k in folds:
        actual = F.when(F.col("reduce") == k, F.col(f"by_{k}")).otherwise(actual)
    off = F.abs(F.col("actual") - F.col("expected"))
    within = F.coalesce(off <= F.col("abs"), F.lit(False)) | F.coalesce(off <= F.col("rel") * F.greatest(F.abs("expected"), F.abs("actual")), F.lit(False))
    return tests.join(met, "test", "left").withColumn("actual", actual).select("test", "variable", "time", "expected", "actual", within.alias("passed"))
