"""The closed functions: calendar fields of UTC seconds, and interpolation in sampled tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuernError

DAY = 86_400


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock time, read as UTC whatever the session's zone."""
    whole = F.unix_date(ts.cast("date")) * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole.cast("double") + F.date_part(F.lit("SECOND"), ts).cast("double")


def wall_clock(s: Column) -> Column:
    """The wall-clock time, without zone, of seconds since 1970 in UTC."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=s.cast("decimal(18,6)"))


def _days(s: Column) -> Column:
    return F.floor(s.cast("double") / DAY).cast("int")


def _date(s: Column) -> Column:
    return F.date_from_unix_date(_days(s))


def _of_day(s: Column) -> Column:
    """Whole seconds since midnight, also before 1970."""
    return F.floor(s.cast("double") - F.floor(s.cast("double") / DAY) * DAY).cast("int")


def julian_day(s: Column) -> Column:
    """Julian day number of the date, and the share of the day from noon."""
    s = s.cast("double")
    return (_days(s) + 2_440_588).cast("double") + (s - F.floor(s / DAY) * DAY - DAY // 2) / DAY


def is_leap_year(s: Column) -> Column:
    y = F.year(_date(s))
    return F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 1).otherwise(0)


def check_axis(axis: Sequence[float], least: int = 2) -> list[float]:
    axis = [float(x) for x in axis]
    if len(axis) < least or any(math.isnan(x) for x in axis) or any(b <= a for a, b in zip(axis, axis[1:], strict=False)):
        raise QuernError("interp_axis", f"an axis has at least {least} strictly increasing numbers")
    return axis


def searchsorted(x: Column, xs: Sequence[float]) -> Column:
    """First place, from 1, whose value is not below x; one past the end if none is, or for NaN."""
    xs = [float(v) for v in xs]
    if any(math.isnan(v) for v in xs) or any(b < a for a, b in zip(xs, xs[1:], strict=False)):
        raise QuernError("interp_axis", "the table must not decrease or hold NaN")
    x = x.cast("double")
    return F.when(F.isnan(x), F.lit(len(xs) + 1)).otherwise(_place(x, xs, lambda a, b: a > b) + 1)


def _place(x: Column, xs: Sequence[float], above: Callable[[Column, Column], Column]) -> Column:
    """How many of the sorted values x is above, by halving: a tree of comparisons that stays in generated code."""
    if not xs:
        return F.lit(0)
    mid = len(xs) // 2
    return F.when(above(x, F.lit(xs[mid])), F.lit(mid + 1) + _place(x, xs[mid + 1 :], above)).otherwise(_place(x, xs[:mid], above))


def _cell(x: Column, axis: list[float]) -> tuple[Column, Column]:
    """The place, from 1, of the cell of x clamped to the axis, and its share of the cell."""
    grid = F.array(*map(F.lit, axis))
    x = F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(axis[0])), F.lit(axis[-1])))
    i = F.lit(1) + _place(x, axis[1:-1], lambda a, b: a >= b)
    low = F.element_at(grid, i)
    return i, (x - low) / (F.element_at(grid, i + 1) - low)


def linear(table: Sequence[float], axis: Sequence[float], x: Column) -> Column:
    """Straight lines between samples, flat beyond them; NaN stays."""
    axis, values = check_axis(axis), [float(v) for v in table]
    if len(values) != len(axis):
        raise QuernError("interp_shape", "as many samples as places on the axis")
    x = x.cast("double")
    t = F.array(*map(F.lit, values))
    i, w = _cell(x, axis)
    a, b = F.element_at(t, i), F.element_at(t, i + 1)
    return F.when(F.isnan(x), x).when(x <= axis[0], F.lit(values[0])).when(x >= axis[-1], F.lit(values[-1])).otherwise(a + w * (b - a))


def bilinear(table: Sequence[Sequence[float]], xs: Sequence[float], ys: Sequence[float], x: Column, y: Column) -> Column:
    """table[i][j] at (xs[i], ys[j]): two blends along x, then one along y."""
    xs, ys = check_axis(xs), check_axis(ys)
    if len(table) != len(xs) or any(len(row) != len(ys) for row in table):
        raise QuernError("interp_shape", "one row of samples for each x, of one sample for each y")
    x, y = x.cast("double"), y.cast("double")
    t = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in table])
    (i, u), (j, v) = _cell(x, xs), _cell(y, ys)
    at = lambda a, b: F.element_at(F.element_at(t, a), b)
    low = at(i, j) + u * (at(i + 1, j) - at(i, j))
    high = at(i, j + 1) + u * (at(i + 1, j + 1) - at(i, j + 1))
    return F.when(F.isnan(x) | F.isnan(y), F.lit(math.nan)).otherwise(low + v * (high - low))


def nearest(table: Sequence[float], axis: Sequence[float], x: Column) -> Column:
    """The sample at the nearest place, the smaller one of two."""
    axis = check_axis(axis)
    i, w = _cell(x.cast("double"), axis)
    return F.element_at(F.array(*[F.lit(float(v)) for v in table]), F.when(w > 0.5, i + 1).otherwise(i))


#: name: (number of arguments, builder). The set is closed.
FUNCTIONS = {
    "datetime.year": (1, lambda s: F.year(_date(s))),
    "datetime.month": (1, lambda s: F.month(_date(s))),
    "datetime.day": (1, lambda s: F.dayofmonth(_date(s))),
    "datetime.hour": (1, lambda s: F.floor(_of_day(s) / 3600).cast("int")),
    "datetime.minute": (1, lambda s: F.floor(_of_day(s) % 3600 / 60).cast("int")),
    "datetime.second": (1, lambda s: (_of_day(s) % 60).cast("int")),
    "datetime.day_of_year": (1, lambda s: F.dayofyear(_date(s))),
    "datetime.julian_day": (1, julian_day),
    "datetime.is_leap_year": (1, is_leap_year),
    "interp.searchsorted": (2, searchsorted),
    "interp.linear": (3, linear),
    "interp.bilinear": (5, bilinear),
}


def call(name: str, *args) -> Column:
    if name not in FUNCTIONS:
        raise QuernError("unknown_closed_function", name)
    n, build = FUNCTIONS[name]
    if len(args) != n:
        raise QuernError("closed_function_arity", f"{name} takes {n} arguments, not {len(args)}")
    return build(*args)


class FunctionTable:
    """Sampled outputs over one or two named axes; `interpolation` linear, bilinear or nearest, `bounds` clamp or error."""

    def __init__(self, axes: dict[str, Sequence[float]], outputs: dict[str, Sequence], interpolation: str = "linear", bounds: str = "clamp"):
        self.axes, self.outputs, self.interpolation, self.bounds = {k: check_axis(v) for k, v in axes.items()}, outputs, interpolation, bounds

    def lookup(self, output: str, **at: Column) -> Column:
        if output not in self.outputs or set(at) != set(self.axes):
            raise QuernError("table_lookup", f"outputs {sorted(self.outputs)}, axes {sorted(self.axes)}")
        names = list(self.axes)
        if self.interpolation == "bilinear":
            value = bilinear(self.outputs[output], *self.axes.values(), *(at[n] for n in names))
        else:
            value = (linear if self.interpolation == "linear" else nearest)(self.outputs[output], self.axes[names[0]], at[names[0]])
        if self.bounds == "error":
            for n in names:
                inside = (at[n] >= self.axes[n][0]) & (at[n] <= self.axes[n][-1])
                value = F.when(inside, value).otherwise(F.raise_error(F.lit(f"[table_out_of_bounds] {n}")).cast("double"))
        return value
