"""Plane geometry as columns; a ring is an array of structs (x, y), closed by repeating its first point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, clockwise from north, in [0, 360)."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def bearing_bin(bearing: Column, step_deg: float) -> Column:
    """The nearest step, halves to even; the last wraps to 0."""
    return F.pmod(F.rint(bearing / step_deg).cast("int"), F.lit(round(360 / step_deg)))


def edges(ring: Column) -> Column:
    """Successive pairs of points (p, q)."""
    n = F.size(ring)
    return F.transform(F.slice(ring, 1, n - 1), lambda p, i: F.struct(p.alias("p"), F.element_at(ring, (i + 2).cast("int")).alias("q")))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; a point on an edge may fall either way."""
    crosses = lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / (e["q"]["y"] - e["p"]["y"]) + e["p"]["x"])
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def length(ring: Column) -> Column:
    """Of an open or closed line."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["q"]["x"] - e["p"]["x"], 2) + F.pow(e["q"]["y"] - e["p"]["y"], 2)))


def to_segment(x: Column, y: Column, e: Column) -> Column:
    """Distance of a point to an edge."""
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["p"]["x"]) * dx + (y - e["p"]["y"]) * dy) / n))).otherwise(0.0)
    return F.sqrt(F.pow(x - e["p"]["x"] - t * dx, 2) + F.pow(y - e["p"]["y"] - t * dy, 2))


def to_polygon(ring: Column, x: Column, y: Column) -> Column:
    """0 inside, else the distance to the nearest edge."""
    return F.when(contains(ring, x, y), 0.0).otherwise(F.array_min(F.transform(edges(ring), lambda e: to_segment(x, y, e))))


def crossing(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """How far along the link (0 to 1) it crosses an edge, else null; each edge holds its first end only."""
    rx, ry, sx, sy = x1 - x0, y1 - y0, e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    cross = rx * sy - ry * sx
    t = ((e["p"]["x"] - x0) * sy - (e["p"]["y"] - y0) * sx) / cross
    u = ((e["p"]["x"] - x0) * ry - (e["p"]["y"] - y0) * rx) / cross
    return F.when((F.abs(cross) > 1e-12) & (t >= 0) & (t <= 1) & (u >= 0) & (u < 1), t)


def crossings(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """All crossings of a link with a ring, in order."""
    return F.array_sort(F.filter(F.transform(edges(ring), lambda e: F.when(F.coalesce(crossing(e, x0, y0, x1, y1), F.lit(-1.0)) >= 0, crossing(e, x0, y0, x1, y1))), lambda t: t.isNotNull()))


def meeting(e: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """How far along the link (0 to 1) it first meets an edge, ends included, also where both lie on one line; else null."""
    rx, ry, ex, ey = x1 - x0, y1 - y0, e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    ox, oy = e["p"]["x"] - x0, e["p"]["y"] - y0
    cross, off, n = rx * ey - ry * ex, ox * ry - oy * rx, rx * rx + ry * ry
    t, u = F.try_divide(ox * ey - oy * ex, cross), F.try_divide(off, cross)
    a, b = F.try_divide(ox * rx + oy * ry, n), F.try_divide((ox + ex) * rx + (oy + ey) * ry, n)
    along = F.when((F.abs(off) < 1e-12) & (n >= 1e-12) & (F.greatest(a, b) >= 0) & (F.least(a, b) <= 1), F.greatest(F.lit(0.0), F.least(a, b)))
    return F.when(F.abs(cross) < 1e-12, along).otherwise(F.when(t.between(0, 1) & u.between(0, 1), t))


def interpolated(profile: Column, at: Column) -> Column:
    """A value in a profile of (u, z), sorted by u, held at its ends."""
    before, after = F.filter(profile, lambda p: p["u"] <= at), F.filter(profile, lambda p: p["u"] > at)
    a, b = F.try_element_at(before, F.lit(-1)), F.try_element_at(after, F.lit(1))
    return F.when(a.isNull(), b["z"]).when(b.isNull(), a["z"]).otherwise(a["z"] + (b["z"] - a["z"]) * (at - a["u"]) / (b["u"] - a["u"]))


def mirrored(x: Column, y: Column, e: Column) -> tuple[Column, Column]:
    """A point's reflection across an edge's line."""
    dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
    t = ((x - e["p"]["x"]) * dx + (y - e["p"]["y"]) * dy) / (dx * dx + dy * dy)
    return 2 * (e["p"]["x"] + t * dx) - x, 2 * (e["p"]["y"] + t * dy) - y


def key_e5(lat: Column, lon: Column) -> Column:
    return F.struct(F.rint(lat * 1e5).cast("long").alias("lat_e5"), F.rint(lon * 1e5).cast("long").alias("lon_e5"))
