"""Canonical text of numbers and index sets, for golden outputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def float_text(x: float) -> str:
    """The shortest digits that read back as x; exponents from 1e21 on and below 1e-6, without padding."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    digits = repr(x)
    if "e" not in digits:
        return digits
    head, _, power = digits.partition("e")
    if -7 <= int(power) < 21:
        text = f"{x:.{max(1, len(head.replace('.', '').lstrip('-')) - 1 - int(power))}f}"
        return text if "." in text else text + ".0"
    return f"{head}e{int(power)}"


def set_json(df: DataFrame, *columns: str) -> DataFrame:
    """One row, `json`: the distinct rows of a set in total order, compact. It is golden output: the set must fit one cell."""
    item = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    listed = F.array_sort(F.collect_set(item))
    cells = F.transform(listed, lambda r: F.array(*[F.to_json(F.struct(r[c].alias("x"))) for c in columns]) if len(columns) > 1 else F.to_json(F.struct(r.alias("x"))))
    strip = lambda x: F.regexp_replace(x, r'^\{"x":|\}$', "")
    if len(columns) > 1:
        text = F.transform(cells, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, strip), ","), F.lit("]")))
    else:
        text = F.transform(cells, strip)
    return df.select(*columns).agg(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("json"))
