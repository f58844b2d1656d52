"""Plane geometry of rings as column expressions; a ring is an array of (lon, lat) structs, closed or not, of a simple polygon."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import in_ring

RING = "array<struct<lon:double,lat:double>>"
#: The ellipsoid GRS80, and the origin of the polyconic projection of Brazil.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
MERIDIAN, EAST, NORTH = -54.0, 5_000_000.0, 10_000_000.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("lon"), y.cast("double").alias("lat"))


def following(ring: Column) -> Column:
    """The ring turned by one point."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Positive if the ring turns to the left."""
    return F.aggregate(F.zip_with(ring, following(ring), lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda a, v: a + v) / 2


def left_turning(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def canonical(ring: Column) -> Column:
    """One form of a ring however it is turned, directed or closed: repeated points once, to the left, from the smallest point on. A ring without area goes the way that sorts first."""
    points = F.transform(ring, lambda p: point(p["lon"] + 0.0, p["lat"] + 0.0))
    fresh = F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)))))
    open_ = F.when((F.size(fresh) > 1) & (F.element_at(fresh, 1) == F.element_at(fresh, -1)), F.slice(fresh, 1, F.size(fresh) - 1)).otherwise(fresh)

    def turned(r: Column) -> Column:
        at = F.array_position(r, F.array_min(r)).cast("int")
        return F.concat(F.slice(r, at, F.size(r)), F.slice(r, 1, at - 1))

    area = signed_area(open_)
    there, back = turned(open_), turned(F.reverse(open_))
    return F.when(F.size(open_) < 2, open_).when(area > 0, there).when(area < 0, back).otherwise(F.least(there, back))


def _side(a: Column, b: Column, p: Column) -> Column:
    return (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])


def clipped(ring: Column, convex: Column) -> Column:
    """The part of a ring inside a convex one: cut along each of its edges in turn. Empty if they do not meet."""
    frame = left_turning(convex)

    def cut(held: Column, edge: Column) -> Column:
        def between(p: Column, q: Column) -> Column:
            d, e = _side(edge["a"], edge["b"], p), _side(edge["a"], edge["b"], q)
            t = F.try_divide(d, d - e)
            meet = F.array(point(p["lon"] + t * (q["lon"] - p["lon"]), p["lat"] + t * (q["lat"] - p["lat"])))
            here = F.array(point(p["lon"], p["lat"]))
            none = F.array().cast(RING)
            return F.when((d >= 0) & (e >= 0), here).when(d >= 0, F.concat(here, meet)).when(e >= 0, meet).otherwise(none)

        return F.flatten(F.zip_with(held, following(held), between))

    edges = F.filter(F.zip_with(frame, following(frame), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda e: e["a"] != e["b"])
    return F.aggregate(edges, F.transform(ring, lambda p: point(p["lon"], p["lat"])), cut)


def _turning(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed areas of rings (rows of x and y), taken from the first point on."""
    x, y = x - x[:, :1], y - y[:, :1]
    return (x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)


def _convex(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rings turn one way only, and once around."""
    dx, dy = np.roll(x, -1, 1) - x, np.roll(y, -1, 1) - y
    turn = dx * np.roll(dy, -1, 1) - np.roll(dx, -1, 1) * dy
    on = dx * np.roll(dx, -1, 1) + dy * np.roll(dy, -1, 1)
    around = np.arctan2(turn, on).sum(1)
    return ((turn >= 0).all(1) | (turn <= 0).all(1)) & ((turn != 0) | (on > 0)).all(1) & (np.abs(np.abs(around) - 2 * np.pi) < 1e-6)


def _met_areas(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """The areas of what lies of each ring (x, y) in the convex one (cx, cy) of its row, which is cut along its edges in turn."""
    back = _turning(cx, cy) < 0
    cx, cy = np.where(back[:, None], cx[:, ::-1], cx), np.where(back[:, None], cy[:, ::-1], cy)
    for k in range(cx.shape[1]):
        ax, ay, bx, by = cx[:, k, None], cy[:, k, None], np.roll(cx, -1, 1)[:, k, None], np.roll(cy, -1, 1)[:, k, None]
        d = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        e, nx, ny = np.roll(d, -1, 1), np.roll(x, -1, 1), np.roll(y, -1, 1)
        t = d / np.where(d == e, 1.0, d - e)
        held = np.stack([d >= 0, (d >= 0) != (e >= 0)], 2).reshape(len(d), -1)
        # What is left of a ring comes first, its first point fills the rest.
        order = np.argsort(~held, 1, kind="stable")[:, : max(int(held.sum(1).max()), 1)]
        kept = np.take_along_axis(held, order, 1)
        x, y = (np.take_along_axis(np.stack([v, v + t * (n - v)], 2).reshape(len(d), -1), order, 1) for v, n in ((x, nx), (y, ny)))
        x, y = np.where(kept, x, x[:, :1]), np.where(kept, y, y[:, :1])
        none = ~kept[:, :1]
        x, y = np.where(none, 0.0, x), np.where(none, 0.0, y)
    return np.abs(_turning(x, y)) / 2


def common_areas(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """The areas that simple polygons (rows of x and y) have in common with others (rows of cx and cy), convex or not: where one bends, the signed sum over triangles from its first point."""
    out = np.zeros(len(x))
    bent, cbent = ~_convex(x, y), ~_convex(cx, cy)
    for mine in (False, True):
        for theirs in (False, True):
            at = np.flatnonzero((bent == mine) & (cbent == theirs))
            if not len(at):
                continue
            fan = lambda v, w: [(v[:, [0, i, i + 1]], w[:, [0, i, i + 1]]) for i in range(1, v.shape[1] - 1)]
            a = fan(x[at], y[at]) if mine else [(x[at], y[at])]
            b = fan(cx[at], cy[at]) if theirs else [(cx[at], cy[at])]
            sign = lambda v, w, bends: np.sign(_turning(v, w)) if bends else 1.0
            out[at] = np.abs(sum(sign(*s, mine) * sign(*t, theirs) * _met_areas(*s, *t) for s in a for t in b))
    return out


def _common_area(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    sizes = pd.DataFrame({"a": ax.map(lambda v: -1 if v is None else len(v)), "b": bx.map(lambda v: -1 if v is None else len(v))})
    out = np.zeros(len(ax))
    for (n, m), at in sizes.groupby(["a", "b"]).indices.items():
        if n < 0 or m < 0:
            out[at] = np.nan
        elif n > 2 and m > 2:
            out[at] = common_areas(*(np.array([np.asarray(v, float) for v in c.iloc[at]]) for c in (ax, ay, bx, by)))
    return pd.Series(out)


def common_area(a: Column, b: Column) -> Column:
    """The area of two simple polygons' intersection, convex or not, worked out for a batch of rows at a time; 0 for fewer than three points, null without a ring."""
    part = lambda ring, f: F.transform(ring, lambda p: p[f].cast("double"))
    return F.pandas_udf(_common_area, "double")(part(a, "lon"), part(a, "lat"), part(b, "lon"), part(b, "lat"))


def centroid(ring: Column) -> Column:
    """Of the area; the middle of the points for a ring without area. Taken from the first point on, so that far coordinates lose nothing."""
    first = F.element_at(ring, 1)
    near = F.transform(ring, lambda p: F.struct((p["lon"] - first["lon"]).alias("lon"), (p["lat"] - first["lat"]).alias("lat")))
    total = signed_area(near)
    along = lambda f: F.aggregate(F.zip_with(near, following(near), lambda p, q: (p[f] + q[f]) * (p["lon"] * q["lat"] - q["lon"] * p["lat"])), F.lit(0.0), lambda a, v: a + v)
    mean = lambda f: F.aggregate(near, F.lit(0.0), lambda a, p: a + p[f]) / F.size(ring)
    at = lambda f: first[f] + F.when(total == 0, mean(f)).otherwise(along(f) / (6 * F.nullif(total, F.lit(0.0))))
    return point(at("lon"), at("lat"))


def representative_point(ring: Column) -> Column:
    """A point inside: the centroid, or else the middle of the widest stretch of the ring's inside at half its height."""
    middle = centroid(ring)
    y = (F.array_min(F.transform(ring, lambda p: p["lat"])) + F.array_max(F.transform(ring, lambda p: p["lat"]))) / 2
    meets = F.zip_with(ring, following(ring), lambda p, q: F.when((p["lat"] > y) != (q["lat"] > y), p["lon"] + (y - p["lat"]) / (q["lat"] - p["lat"]) * (q["lon"] - p["lon"])))
    across = F.array_sort(F.filter(meets, lambda x: x.isNotNull()))
    stretches = F.transform(F.sequence(F.lit(1), F.greatest(F.size(across) - 1, F.lit(1)), F.lit(2)), lambda i: F.struct((F.try_element_at(across, i + 1) - F.try_element_at(across, i)).alias("wide"), ((F.try_element_at(across, i + 1) + F.try_element_at(across, i)) / 2).alias("x")))
    widest = F.array_max(stretches)
    return F.when(in_ring(middle["lon"], middle["lat"], ring) | (F.size(across) < 2), middle).otherwise(point(widest["x"], y))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """From a point to the ring's nearest edge, in its unit."""

    def away(p: Column, q: Column) -> Column:
        dx, dy = q["lon"] - p["lon"], q["lat"] - p["lat"]
        t = F.coalesce(F.try_divide((x - p["lon"]) * dx + (y - p["lat"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - p["lon"] - t * dx, y - p["lat"] - t * dy)

    return F.array_min(F.zip_with(ring, following(ring), away))


def rings_apart(a: Column, b: Column) -> Column:
    """The gap between two rings that do not cross: the least distance of a corner of one to the other."""
    one = lambda r, s: F.array_min(F.transform(r, lambda p: ring_distance(p["lon"], p["lat"], s)))
    return F.least(one(a, b), one(b, a))


def polyconic(lon: Column, lat: Column) -> Column:
    """Degrees to metres of the polyconic projection of Brazil, as (lon: east, lat: north)."""
    e2 = FLATTENING * (2 - FLATTENING)
    phi, turn = F.radians(lat), F.radians(lon - MERIDIAN)
    along = AXIS * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - 35 * e2**3 / 3072 * F.sin(6 * phi))
    wide = AXIS / F.sqrt(1 - e2 * F.sin(phi) ** 2) / F.nullif(F.tan(phi), F.lit(0.0))
    e = turn * F.sin(phi)
    return point(EAST + F.when(phi == 0, AXIS * turn).otherwise(wide * F.sin(e)), NORTH + F.when(phi == 0, F.lit(0.0)).otherwise(along + wide * (1 - F.cos(e))))


def projected(ring: Column) -> Column:
    return F.transform(ring, lambda p: polyconic(p["lon"], p["lat"]))


def world_ring() -> Column:
    corner = lambda x, y: point(F.lit(float(x)), F.lit(float(y)))
    return F.array(corner(-180, -90), corner(180, -90), corner(180, 90), corner(-180, 90), corner(-180, -90))


