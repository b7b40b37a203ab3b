"""Great-circle geometry on the unit sphere, in radians."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(dlat: Column, dlon: Column, cos_product: Column) -> Column:
    """Angle between points that lie dlat, dlon apart; cos_product is cos(lat1) * cos(lat2)."""
    s_lat = F.sin(dlat / 2)
    s_lon = F.sin(dlon / 2)
    h = s_lat * s_lat + cos_product * (s_lon * s_lon)
    return F.lit(2.0) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    return haversine(a - b, F.radians(lon1) - F.radians(lon2), F.cos(a) * F.cos(b))
