"""Scalar operators as Columns, with IEEE results where SQL would fail or give null."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuernError


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _double(x) -> Column:
    return _num(x).cast("double")


def divide(a, b) -> Column:
    """x / 0 is infinite with the sign of x and of the zero, 0 / 0 is NaN: the literal's, as processors give theirs a sign that shows in its text."""
    a, b = _double(a), _double(b)
    return F.when(b == 0.0, F.nanvl(a * F.pow(b, F.lit(-1.0)), F.lit(math.nan))).otherwise(a / F.when(b == 0.0, F.lit(1.0)).otherwise(b))


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def log(x) -> Column:
        x = _double(x)
        return F.when(x > 0, fn(x)).when(x == 0, F.lit(-math.inf)).when(x.isNull(), F.lit(None).cast("double")).otherwise(F.lit(math.nan))

    return log


def _whole(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """floor and ceil stay doubles, and leave what a long can't hold (whole anyway) alone."""

    def whole(x) -> Column:
        x = _double(x)
        return F.when(F.abs(x) < 2.0**53, fn(x).cast("double")).otherwise(x)

    return whole


def _extreme(fn: Callable[..., Column]) -> Callable[..., Column]:
    """NaN and null in any operand are the result."""

    def extreme(*xs) -> Column:
        xs = [_double(x) for x in xs]
        bad = reduce(lambda a, b: a | b, [F.isnan(x) for x in xs])
        none = reduce(lambda a, b: a | b, [x.isNull() for x in xs])
        return F.when(none, F.lit(None).cast("double")).when(bad, F.lit(math.nan)).otherwise(fn(*xs))

    return extreme


def _compare(fn: Callable[[Column, Column], Column], unequal: bool = False) -> Callable[[Column, Column], Column]:
    """SQL holds NaN equal to itself and larger than all; here a comparison with it is false, and != true."""

    def compare(a, b) -> Column:
        a, b = _num(a), _num(b)
        nan = F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        return F.when(nan, F.lit(unequal)).otherwise(fn(a, b))

    return compare


def truth(x) -> Column:
    """Other than zero."""
    return _num(x).cast("double") != 0.0


def as_number(x: Column) -> Column:
    """1.0 and 0.0 where a boolean is used as a value."""
    return x.cast("double")


def minus(*xs) -> Column:
    xs = [_num(x) for x in xs]
    return -xs[0] if len(xs) == 1 else reduce(lambda a, b: a - b, xs)


@dataclass(frozen=True)
class Op:
    name: str
    least: int
    most: int | None
    build: Callable[..., Column]
    boolean: bool = False


def _table() -> dict[str, Op]:
    unary = {n: getattr(F, n) for n in "exp sqrt abs sin cos tan asin acos sinh cosh tanh asinh acosh atanh".split()}
    ops = [Op(n, 1, 1, lambda x, f=f: f(_double(x))) for n, f in unary.items()]
    ops += [
        Op("+", 1, None, lambda *x: reduce(lambda a, b: a + b, map(_num, x))),
        Op("-", 1, None, minus),
        Op("neg", 1, 1, minus),
        Op("*", 1, None, lambda *x: reduce(lambda a, b: a * b, map(_num, x))),
        Op("/", 2, 2, divide),
        Op("^", 2, 2, lambda a, b: F.pow(_double(a), _double(b))),
        Op("log", 1, 1, _log(F.ln)),
        Op("log10", 1, 1, _log(F.log10)),
        Op("sign", 1, 1, lambda x: F.signum(_double(x))),
        Op("atan", 1, 2, lambda x, *y: F.atan2(_double(x), _double(y[0])) if y else F.atan(_double(x))),
        Op("atan2", 2, 2, lambda a, b: F.atan2(_double(a), _double(b))),
        Op("min", 2, None, _extreme(F.least)),
        Op("max", 2, None, _extreme(F.greatest)),
        Op("floor", 1, 1, _whole(F.floor)),
        Op("ceil", 1, 1, _whole(F.ceil)),
        Op(">", 2, 2, _compare(lambda a, b: a > b), True),
        Op("<", 2, 2, _compare(lambda a, b: a < b), True),
        Op(">=", 2, 2, _compare(lambda a, b: a >= b), True),
        Op("<=", 2, 2, _compare(lambda a, b: a <= b), True),
        Op("==", 2, 2, _compare(lambda a, b: a == b), True),
        Op("!=", 2, 2, _compare(lambda a, b: a != b, True), True),
        Op("and", 2, None, lambda *x: reduce(lambda a, b: a & b, x), True),
        Op("or", 2, None, lambda *x: reduce(lambda a, b: a | b, x), True),
        Op("not", 1, 1, lambda x: ~x, True),
        Op("true", 0, 0, lambda: F.lit(True), True),
        Op("false", 0, 0, lambda: F.lit(False), True),
        Op("ifelse", 3, 3, lambda c, a, b: F.when(c, a).otherwise(b)),
        Op("pi", 0, 0, lambda: F.lit(math.pi)),
        Op("e", 0, 0, lambda: F.lit(math.e)),
        Op("Pre", 1, 1, _num),
    ]
    return {o.name: o for o in ops}


OPS = _table()
ALIASES = {"**": "^", "pow": "^", "=": "==", "π": "pi"}


def op(name: str, *args) -> Column:
    """The operator's Column. and, or, not and ifelse's condition take booleans or numbers (true if not zero)."""
    name = ALIASES.get(name, name)
    if name not in OPS:
        raise QuernError("unknown_op", name)
    o = OPS[name]
    if len(args) < o.least or o.most is not None and len(args) > o.most:
        raise QuernError("arity", f"{name} takes {o.least} to {o.most or 'any number of'} operands, not {len(args)}")
    return o.build(*args)
