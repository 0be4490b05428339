"""Periods, file anchors, URL templates, mirrors and a content cache."""

from __future__ import annotations

import calendar
import hashlib
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuernError
from ..functions.closed import seconds, wall_clock


@dataclass(frozen=True)
class Period:
    """Months and seconds apart: a month has no fixed length."""

    months: int = 0
    seconds: float = 0.0

    @classmethod
    def parse(cls, text: str) -> Period:
        m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
        if not m or text in ("P", "PT"):
            raise QuernError("duration", text)
        y, mo, w, d, h, mi, s = (float(x or 0) for x in m.groups())
        return cls(int(12 * y + mo), 604_800 * w + 86_400 * d + 3600 * h + 60 * mi + s)

    def after(self, t: datetime, n: int = 1) -> datetime:
        k = t.year * 12 + t.month - 1 + n * self.months
        year, month = k // 12, k % 12 + 1
        return t.replace(year=year, month=month, day=min(t.day, calendar.monthrange(year, month)[1])) + timedelta(seconds=n * self.seconds)


def snap(t: datetime, anchor: datetime, period: Period) -> datetime:
    """The last anchor + k * period not after t."""
    size = period.months * 2_629_746 + period.seconds
    if size <= 0:
        raise QuernError("duration", "a period is longer than nothing")
    k = int((t - anchor).total_seconds() // size) - 1
    while period.after(anchor, k + 1) <= t:
        k += 1
    while period.after(anchor, k) > t:
        k -= 1
    return period.after(anchor, k)


def snap_column(ts: Column, anchor: datetime, period: Period) -> Column:
    """snap() for a timestamp column; a period is whole months or seconds."""
    if period.months and period.seconds:
        raise QuernError("duration", "a column snaps to months or to seconds")
    if period.months:
        start = F.lit(anchor.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
        k = F.floor(F.months_between(ts, start) / period.months).cast("int")
        return start + F.make_ym_interval(F.lit(0), k * period.months)
    base = (anchor if anchor.tzinfo else anchor.replace(tzinfo=UTC)).timestamp()
    return wall_clock(F.lit(base) + F.floor((seconds(ts) - base) / period.seconds) * period.seconds)


def file_anchors(start: datetime, end: datetime, anchor: datetime, period: Period) -> list[datetime]:
    """Anchors of the files that cover start to end, both included."""
    t, out = snap(start, anchor, period), []
    while t <= end:
        out.append(t)
        t = period.after(t)
    return out


def records_per_file(records: int | str, period: Period, frequency: Period) -> int:
    if records != "auto":
        return int(records)
    if period.months or frequency.months or not frequency.seconds:
        raise QuernError("records_per_file", "auto needs periods of fixed length")
    return int(period.seconds // frequency.seconds)


def expand_url(template: str, t: datetime | None = None, **values) -> str:
    """{date:%Y/%m} and {name} filled in."""

    def fill(m: re.Match) -> str:
        name, _, fmt = m[1].partition(":")
        if name == "date":
            if t is None:
                raise QuernError("url_template", "a date is needed")
            return t.strftime(fmt or "%Y%m%d")
        if name not in values:
            raise QuernError("url_template", f"no value for {name}")
        return format(values[name], fmt)

    return re.sub(r"\{([^{}]+)\}", fill, template)


def first_of(mirrors: Iterable[str], open_: Callable[[str], object]):
    """What the first mirror that opens gives; the last failure if none does."""
    failure: Exception = QuernError("no_mirrors", "no mirror was given")
    for url in mirrors:
        try:
            return open_(url)
        except (OSError, QuernError) as e:
            failure = e
    raise failure


def cached(url: str, folder: str, fetch: Callable[[str], bytes], offline: bool = False) -> str:
    """The path of a local copy named by the URL's digest, fetched once."""
    path = os.path.join(folder, hashlib.sha256(url.encode()).hexdigest() + os.path.splitext(url)[1])
    if not os.path.exists(path):
        if offline:
            raise QuernError("offline", f"{url} is not in the cache")
        os.makedirs(folder, exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(fetch(url))
        os.replace(f"{path}.part", path)
    return path
