"""Geodesic column expressions; coordinates in degrees, lengths in kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def between_tables(a: str, b: str) -> Column:
    """Distance between the (lat, lon) of two aliased tables."""
    return haversine(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))


def in_world(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def in_country(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-35.5, 6.5) & lon.between(-75.5, -32.0), F.lit(False))


def circle(lat: Column, lon: Column, km: Column, steps: int = 64) -> Column:
    """A geodesic circle as an array of (lon, lat) structs, closed."""
    d = km / EARTH_KM

    def point(k: Column) -> Column:
        t = 2 * math.pi * k / steps
        la = F.asin(F.sin(F.radians(lat)) * F.cos(d) + F.cos(F.radians(lat)) * F.sin(d) * F.cos(t))
        lo = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(F.radians(lat)), F.cos(d) - F.sin(F.radians(lat)) * F.sin(la))
        return F.struct(F.degrees(lo).alias("lon"), F.degrees(la).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), point)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: ``ring`` is an array of (lon, lat) structs; an odd number of edges crossed means inside."""
    before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))

    def crossed(p: Column, q: Column) -> Column:
        return ((p["lat"] > y) != (q["lat"] > y)) & (x < (q["lon"] - p["lon"]) * (y - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"])

    return F.aggregate(F.zip_with(ring, before, crossed), F.lit(False), lambda acc, c: acc != F.coalesce(c, F.lit(False)))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a projected ring, in the square of its unit."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, after, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"]), F.lit(0.0), lambda a, v: a + v)) / 2


def box_centre(ring: Column) -> Column:
    low = lambda f: F.array_min(F.transform(ring, lambda p: p[f]))
    high = lambda f: F.array_max(F.transform(ring, lambda p: p[f]))
    return F.struct(((low("lon") + high("lon")) / 2).alias("lon"), ((low("lat") + high("lat")) / 2).alias("lat"))
