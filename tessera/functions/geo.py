"""Points on the globe: boxes, circles, polygons and distances, as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
RADIUS = 6_371_008.8


def distance(lon: Column, lat: Column, to_lon: float, to_lat: float) -> Column:
    """Haversine distance in metres."""
    a, b = F.radians(lat), F.radians(F.lit(float(to_lat)))
    h = F.pow(F.sin((a - b) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - F.radians(F.lit(float(to_lon)))) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lon: Column, lat: Column, top_left: dict, bottom_right: dict) -> Column:
    """Strictly inside; a box whose left side is east of its right one crosses the antimeridian."""
    left, right = top_left["lon"], bottom_right["lon"]
    across = (lon > left) | (lon < right) if left > right else (lon > left) & (lon < right)
    return across & (lat < top_left["lat"]) & (lat > bottom_right["lat"])


def in_circle(lon: Column, lat: Column, center: dict, radius: float) -> Column:
    """Strictly inside; the latitude band comes first, so that statistics can prune."""
    band = float(radius) / RADIUS * 57.29577951308232 * 1.0000001
    return lat.between(center["lat"] - band, center["lat"] + band) & (distance(lon, lat, center["lon"], center["lat"]) < radius)


def _ring(points: list[dict]) -> list[tuple[float, float]]:
    ring = [(float(p["lon"]), float(p["lat"])) for p in points]
    if len(ring) < 4 or ring[0] != ring[-1]:
        raise ValueError("a ring has four points or more and ends where it begins")
    return ring


def _edges(ring: list) -> list:
    return list(zip(ring, ring[1:], strict=False))


def _within(lon: Column, lat: Column, ring: list) -> Column:
    """Even-odd rule, without the border."""
    crossings = []
    for (x1, y1), (x2, y2) in _edges(ring):
        if y1 != y2:
            x = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
            crossings.append((((lat < y1) != (lat < y2)) & (lon < x)).cast("int"))
    return (reduce(lambda a, b: a + b, crossings) % 2 == 1) & ~_on(lon, lat, ring)


def _on(lon: Column, lat: Column, ring: list) -> Column:
    out = F.lit(False)
    for (x1, y1), (x2, y2) in _edges(ring):
        straight = (lon - x1) * (y2 - y1) == (lat - y1) * (x2 - x1)
        out = out | (straight & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
    return out


def in_polygon(lon: Column, lat: Column, exterior: list[dict], interiors: list[list[dict]] = ()) -> Column:
    """Inside the outer ring and in no hole; every border counts as outside."""
    inside = _within(lon, lat, _ring(exterior))
    for hole in map(_ring, interiors):
        inside = inside & ~_within(lon, lat, hole) & ~_on(lon, lat, hole)
    return inside
