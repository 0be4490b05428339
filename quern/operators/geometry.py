"""Polygon rings: clipping, areas and conservative regridding. Rings are array<struct<lon, lat>>, open or closed."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QuernError
from ..shared import ship
from .spatial import envelope, overlap_join

RING = "array<struct<lon:double,lat:double>>"
#: Of consecutive vertices that count as one: relative and absolute.
CLOSE = (1e-5, 1e-8)


def close_ring(ring: Column) -> Column:
    same = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when(F.size(ring) == 0, ring).when(same, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def planar_area(ring: Column) -> Column:
    """Half the absolute sum of cross products of neighbouring vertices; fewer than three have none."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2.0)


def spherical_area(ring: Column, radius: float = 1.0) -> Column:
    """Area on a sphere of degrees: the excess summed edge by edge, exact for great-circle edges."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))

    def edge(p, q):
        d = F.radians(q["lon"] - p["lon"])
        d = d - 2 * math.pi * F.round(d / (2 * math.pi))
        a, b = F.tan(F.radians(p["lat"]) / 2), F.tan(F.radians(q["lat"]) / 2)
        return 2 * F.atan2(F.tan(d / 2) * (a + b), 1 + a * b)

    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(F.zip_with(ring, nxt, edge), F.lit(0.0), lambda a, x: a + x)) * radius * radius)


def polygon_area(df: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, area) of each ring of two vertices at least: the cross products of its edges folded inside its row, so nothing is shuffled or held.

    Edges with a missing place take no part; a ring of none but such has null.
    """
    cross = lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]
    edges = lambda r: F.filter(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), cross), lambda x: x.isNotNull())
    half = lambda e: F.when(F.size(e) > 0, F.abs(F.aggregate(e, F.lit(0.0), lambda a, x: a + x)) / 2.0)
    area = _let(F.col(ring), lambda r: _let(close_ring(r), lambda r: _let(edges(r), half)))
    return df.where(F.size(F.col(ring)) >= 2).select(F.col(key), area.alias("area"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: as a column's name it would be written out wherever body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Rings:
    """Rings of many rows, one after the other: points (n, d), and where each ring begins (one more at the end)."""

    def __init__(self, points: np.ndarray, start: np.ndarray):
        self.points, self.start = points, start

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.start)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def neighbour(self, by: int) -> np.ndarray:
        """The place of each point's next (1) or previous (-1) point, round its ring."""
        own, n = self.owner, self.size
        return self.start[:-1][own] + (np.arange(len(own)) - self.start[:-1][own] + by) % n[own] if len(own) else np.zeros(0, np.int64)

    def kept(self, keep: np.ndarray) -> Rings:
        return Rings(self.points[keep], np.append(0, np.cumsum(keep))[self.start])

    def turned(self, which: np.ndarray) -> Rings:
        """The rings marked in reverse order."""
        own = self.owner
        at = np.arange(len(own))
        return Rings(self.points[np.where(which[own], self.start[:-1][own] + self.start[1:][own] - 1 - at, at)], self.start)

    @classmethod
    def of(cls, column: pa.Array) -> Rings:
        """From lists of structs (lon, lat); null is empty. Of points close to the one kept before only the first stays."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, n = column.flatten(), pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rings = cls(np.stack([np.asarray(flat.field(k).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for k in ("lon", "lat")], 1), np.append(0, np.cumsum(n)))
        same = (rings.points[1:] == rings.points[:-1]).all(1) & (rings.owner[1:] == rings.owner[:-1])
        rings = rings.kept(~np.append(False, same)[: len(rings.points)])
        while True:
            # A point goes if it is close to one that stays; the next of a chain is then held against that one.
            before, own = rings.neighbour(-1), rings.owner
            first = np.arange(len(own)) == rings.start[:-1][own] if len(own) else np.zeros(0, bool)
            with np.errstate(invalid="ignore"):
                close = (np.abs(rings.points - rings.points[before]) <= CLOSE[1] + CLOSE[0] * np.abs(rings.points[before])).all(1) & ~first
            run = np.arange(len(own)) - np.maximum.accumulate(np.where(~close, np.arange(len(own)), 0))
            gone = close & (run == 1)
            if not gone.any():
                break
            rings = rings.kept(~gone)
        while True:
            size = rings.size
            last, lead = np.maximum(rings.start[1:] - 1, 0), np.minimum(rings.start[:-1], max(0, len(rings.points) - 1))
            if not len(rings.points):
                return rings
            p, q = rings.points[lead], rings.points[last]
            shut = (size > 1) & (np.abs(p - q) <= CLOSE[1] + CLOSE[0] * np.abs(q)).all(1)
            if not shut.any():
                return rings
            keep = np.ones(len(rings.points), bool)
            keep[last[shut]] = False
            rings = rings.kept(keep)


def _cut(rings: Rings, side: np.ndarray, between) -> Rings:
    """The part of each ring where `side` is not negative; between(p, q, s, t) are the points where edges cross."""
    nxt = rings.neighbour(1)
    s, t = side, side[nxt]
    stay, cross = s >= 0, ((s > 0) & (t < 0)) | ((s < 0) & (t > 0))
    n = stay.astype(np.int64) + cross
    ends = np.cumsum(n)
    out = np.empty((int(n.sum()), rings.points.shape[1]))
    out[(ends - n)[stay]] = rings.points[stay]
    x = np.flatnonzero(cross)
    out[ends[x] - 1] = between(rings.points[x], rings.points[nxt[x]], s[x][:, None], t[x][:, None])
    return Rings(out, np.append(0, ends)[rings.start])


def _clipped(subject: Rings, clip: Rings, plane, between) -> Rings:
    """Each subject cut by the edges of its clip ring in turn, all rows at once; plane(p, q, x) is the side of x of the edge from p to q."""
    ok = (subject.size >= 3) & (clip.size >= 3)
    out = subject.kept(ok[subject.owner])
    nxt = clip.neighbour(1)
    for k in range(int(clip.size[ok].max(initial=0))):
        own = out.owner
        if not len(own):
            break
        has = k < clip.size[own]
        at = np.where(has, clip.start[:-1][own] + k, clip.start[:-1][own])
        side = np.where(has, plane(clip.points[at], clip.points[nxt[at]], out.points), 1.0)
        out = _cut(out, side, between)
    return out


def _plane_side(p, q, x):
    return (q[:, 0] - p[:, 0]) * (x[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (x[:, 0] - p[:, 0])


def clip_planar(subject: Rings, clip: Rings) -> Rings:
    """The parts of polygons inside convex ones: cut by each of their edges' half planes in turn."""
    p, q = clip.points, clip.points[clip.neighbour(1)]
    turn = np.bincount(clip.owner, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], len(clip.size)) < 0
    return _clipped(subject, clip.turned(turn), _plane_side, lambda p, q, s, t: p + s / (s - t) * (q - p))


def _units(rings: Rings) -> Rings:
    lon, lat = np.radians(rings.points).T
    return Rings(np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1), rings.start)


def _crossing(p, q, s, t):
    r = p * np.abs(t) + q * np.abs(s)
    return r / np.sqrt((r * r).sum(1))[:, None]


def clip_spherical(subject: Rings, clip: Rings) -> Rings:
    """The same on a sphere: half spaces of great circles through convex rings' edges, smaller than a hemisphere."""
    ring = _units(clip)
    middle = np.stack([np.bincount(ring.owner, ring.points[:, i], len(ring.size)) for i in range(3)], 1)
    if len(ring.points):
        # Rings without points read any; they clip nothing.
        a = np.minimum(ring.start[:-1], len(ring.points) - 1)
        b = np.minimum(a + (ring.size > 1), len(ring.points) - 1)
        ring = ring.turned((np.cross(ring.points[a], ring.points[b]) * middle).sum(1) < 0)
    out = _clipped(_units(subject), ring, lambda p, q, x: (np.cross(p, q) * x).sum(1), _crossing)
    x, y, z = out.points.T
    return Rings(np.stack([np.degrees(np.arctan2(y, x)), np.degrees(np.arcsin(np.clip(z, -1, 1)))], 1), out.start)


MANIFOLDS = {"planar": clip_planar, "spherical": clip_spherical}


def intersect_polygon(a: Column, b: Column, manifold: str) -> Column:
    """The overlap ring (open, possibly empty) of ring a with the convex ring b; a manifold must be named. Null rings give null.

    All rows of a batch are cut together, edge by edge, as arrays.
    """
    if manifold == "geodesic":
        raise QuernError("manifold", "edges on the ellipsoid are not implemented; spherical takes great circles")
    if manifold not in MANIFOLDS:
        raise QuernError("manifold", f"{manifold} is not one of {sorted(MANIFOLDS)}")
    cut = MANIFOLDS[manifold]
    ship(SparkSession.active())

    @F.arrow_udf(RING)
    def clip(x: pa.Array, y: pa.Array) -> pa.Array:
        out = cut(Rings.of(x), Rings.of(y))
        points = pa.StructArray.from_arrays([pa.array(out.points[:, 0]), pa.array(out.points[:, 1])], ["lon", "lat"])
        null = np.asarray(pa.compute.or_(x.is_null(), y.is_null()))
        return pa.ListArray.from_arrays(pa.array(out.start, pa.int32(), mask=np.append(null, False)), points)

    return clip(a, b)


def intersection_area(a: Column, b: Column, manifold: str = "planar", radius: float = 1.0) -> Column:
    ring = intersect_polygon(a, b, manifold)
    return planar_area(ring) if manifold == "planar" else spherical_area(ring, radius)


def densify(ring: Iterable[tuple[float, float]], most: float) -> list[tuple[float, float]]:
    """Vertices added along edges of equal latitude, so that great-circle edges of at most `most` degrees follow the parallel."""
    pts, out = list(ring), []
    for p, q in zip(pts, pts[1:] + pts[:1], strict=True):
        n = max(1, math.ceil(abs(q[0] - p[0]) / most)) if p[1] == q[1] else 1
        out += [(p[0] + (q[0] - p[0]) * k / n, p[1]) if k else p for k in range(n)]
    return out


def area_ok(area: Column, expected: Column, radius: float = 1.0, rel: float = 1e-9) -> Column:
    """Within rel of the expected area, or within the floor of slivers: 1e-15 of the radius squared."""
    return F.abs(area - expected) <= F.greatest(F.lit(1e-15 * radius * radius), F.lit(rel) * F.abs(expected))


def regrid(src: DataFrame, tgt: DataFrame, src_id: str, tgt_id: str, ring: str, field: str, manifold: str = "planar", least: float = 0.0) -> DataFrame:
    """(tgt_id, value): area-weighted means of a source field over target cells, whose convex rings clip the sources.

    Broad phase by bins of envelopes, then areas of candidate pairs only; `least` drops slivers. Cells without
    overlap have no row.
    """
    s, t = src.withColumns(envelope(F.col(ring))), tgt.withColumns(envelope(F.col(ring)))
    pairs = overlap_join(s, t, src_id, tgt_id)
    met = pairs.join(src.select(src_id, F.col(ring).alias("__s"), F.col(field).alias("__f")), src_id).join(tgt.select(tgt_id, F.col(ring).alias("__t")), tgt_id)
    area = met.select(tgt_id, "__f", intersection_area(F.col("__s"), F.col("__t"), manifold).alias("__a")).where(F.col("__a") > least)
    return area.groupBy(tgt_id).agg((F.sum(F.col("__a") * F.col("__f")) / F.sum("__a")).alias("value"))
