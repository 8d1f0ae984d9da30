"""Distances and point-in-polygon as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# WGS84
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle kilometres on a sphere of radius 6371 km."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return EARTH_KM * 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def geodesic_near_m(lat1, lng1, lat2, lng2) -> Column:
    """Metres on the WGS84 spheroid for points a few kilometres apart.

    Mid-latitude form: meridian and parallel radii at the mean latitude.
    """
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    mid = F.radians((lat1 + lat2) / 2)
    w2 = 1 - WGS84_E2 * F.sin(mid) * F.sin(mid)
    w = F.sqrt(w2)
    north = F.radians(lat2 - lat1) * (WGS84_A * (1 - WGS84_E2)) / (w2 * w)
    east = F.radians(lng2 - lng1) * WGS84_A / w * F.cos(mid)
    return F.sqrt(north * north + east * east)


def geodesic_far_m(lat1, lng1, lat2, lng2) -> Column:
    """Metres on the WGS84 spheroid at any range (Lambert's long-line formula)."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    b1 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat1)))
    b2 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat2)))
    half_b = F.sin((b2 - b1) / 2)
    half_l = F.sin(F.radians(lng2 - lng1) / 2)
    h = F.least(F.lit(1.0), half_b * half_b + F.cos(b1) * F.cos(b2) * half_l * half_l)
    sigma = 2 * F.asin(F.sqrt(h))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    sp, cp, sq, cq = F.sin(p), F.cos(p), F.sin(q), F.cos(q)
    sh, ch = F.sin(sigma / 2), F.cos(sigma / 2)
    x = (sigma - F.sin(sigma)) * sp * sp * cq * cq / (ch * ch)
    y = (sigma + F.sin(sigma)) * cp * cp * sq * sq / (sh * sh)
    return F.when(h <= 0, F.lit(0.0)).otherwise(
        WGS84_A * (sigma - WGS84_F / 2 * (x + y))
    )


def geodesic_m(lat1, lng1, lat2, lng2) -> Column:
    """Spheroid metres: the near form below 0.05 degrees, else the far form."""
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    near = (F.abs(lat1 - lat2) < 0.05) & (F.abs(lng1 - lng2) < 0.05)
    return F.when(near, geodesic_near_m(lat1, lng1, lat2, lng2)).otherwise(
        geodesic_far_m(lat1, lng1, lat2, lng2)
    )


def sphere_xyz(lat: Column, lng: Column, radius: float = EARTH_KM) -> tuple[Column, Column, Column]:
    """Cartesian point on the sphere; chords never exceed great-circle distance."""
    phi, lam = F.radians(lat), F.radians(lng)
    return (
        radius * F.cos(phi) * F.cos(lam),
        radius * F.cos(phi) * F.sin(lam),
        radius * F.sin(phi),
    )


def spheroid_xyz(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Earth-centred metres on the WGS84 surface; chords never exceed the geodesic."""
    phi, lam = F.radians(lat), F.radians(lng)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(phi) * F.sin(phi))
    return (
        n * F.cos(phi) * F.cos(lam),
        n * F.cos(phi) * F.sin(lam),
        n * (1 - WGS84_E2) * F.sin(phi),
    )


def ring_edges(rings: Column) -> Column:
    """All edges of nested rings as ``array<struct<x1,y1,x2,y2>>``."""

    def edges_of(ring: Column) -> Column:
        return F.zip_with(
            ring,
            F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.transform(F.flatten(rings), edges_of)


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd containment of (x, y); points on an edge are outside."""

    def on_edge(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (
            (cross == 0)
            & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
            & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        )

    def toggles(e: Column) -> Column:
        straddles = (e["y1"] > y) != (e["y2"] > y)
        rise = F.when(straddles, e["y2"] - e["y1"])
        cut = (e["x2"] - e["x1"]) * (y - e["y1"]) / rise + e["x1"]
        return F.when(straddles, x < cut).otherwise(F.lit(False))

    crossings = F.size(F.filter(edges, toggles))
    return (crossings % 2 == 1) & ~F.exists(edges, on_edge)
