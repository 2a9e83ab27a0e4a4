"""Points and polygons on latitude and longitude taken as plane coordinates (FLT-11)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

Point = tuple[float, float]


def in_polygon(lat: Column | str, lng: Column | str, corners: list[Point]) -> Column:
    """Ray casting: an odd number of edges lies east of the point. Edges across the 180th meridian are out of scope."""
    lat, lng = (F.col(c) if isinstance(c, str) else c for c in (lat, lng))
    edges = [
        F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("a_lat", "a_lng", "b_lat", "b_lng"), (*a, *b))))
        for a, b in zip(corners, corners[1:] + corners[:1])
    ]

    def crosses(e: Column) -> Column:
        spans = (e["a_lat"] > lat) != (e["b_lat"] > lat)
        at = (e["b_lng"] - e["a_lng"]) * (lat - e["a_lat"]) / F.nullif(e["b_lat"] - e["a_lat"], F.lit(0.0)) + e["a_lng"]
        return spans & (lng < at)

    return F.size(F.filter(F.array(*edges), crosses)) % 2 == 1


def in_any_polygon(lat: Column | str, lng: Column | str, polygons: list[list[Point]]) -> Column:
    """FLT-11. Inside at least one polygon; without polygons every point is kept."""
    return reduce(or_, [in_polygon(lat, lng, p) for p in polygons]) if polygons else F.lit(True)
