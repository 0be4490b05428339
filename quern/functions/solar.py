"""Position of the sun from UTC seconds and degrees, by Spencer's Fourier series."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import closed
from .scalar import op

#: Coefficients of 1, cos g, sin g, cos 2g, sin 2g, cos 3g, sin 3g of the declination (radians) and the equation of time
#: (times MINUTES), and the minutes of time of one radian as the series has them.
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
MINUTES = 229.18


def _series(coefficients: tuple[float, ...], g: Column) -> Column:
    out = F.lit(coefficients[0])
    for i, a in enumerate(coefficients[1:]):
        out = out + a * (F.cos if i % 2 == 0 else F.sin)((i // 2 + 1.0) * g)
    return out


def year_angle(s: Column) -> Column:
    """How far the year has gone, in radians; hours count whole."""
    day, hour = closed.call("datetime.day_of_year", s), closed.call("datetime.hour", s)
    return 2 * math.pi / 365 * (day - 1 + (hour - 12) / 24.0)


def declination(s: Column) -> Column:
    return _series(DECLINATION, year_angle(s))


def equation_of_time(s: Column) -> Column:
    """Minutes that a sundial is ahead."""
    return MINUTES * _series(EQUATION_OF_TIME, year_angle(s))


def hour_angle(s: Column, lon: Column) -> Column:
    clock = closed.call("datetime.hour", s) * 60.0 + closed.call("datetime.minute", s) + closed.call("datetime.second", s) / 60.0
    return F.radians((clock + equation_of_time(s) + 4.0 * lon) / 4.0 - 180.0)


def cos_zenith(s: Column, lat: Column, lon: Column) -> Column:
    d, phi = declination(s), F.radians(lat)
    return F.sin(phi) * F.sin(d) + F.cos(phi) * F.cos(d) * F.cos(hour_angle(s, lon))


def zenith(s: Column, lat: Column, lon: Column) -> Column:
    """Angle from the vertical, in radians."""
    return op("acos", op("min", F.lit(1.0), op("max", F.lit(-1.0), cos_zenith(s, lat, lon))))
