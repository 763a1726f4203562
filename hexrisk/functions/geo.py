"""Distances and boxes on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EARTH_RADIUS_KM = 6371.0
# Study region: latitude and longitude bounds, inclusive.
REGION_BOX = {"lat": (29.5, 37.5), "lng": (33.5, 42.5)}


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in kilometres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / F.lit(2.0))
    half_lng = F.sin(F.radians(lng2 - lng1) / F.lit(2.0))
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def filter_bbox(df: DataFrame, lat: str = "lat", lng: str = "lng", box: dict = REGION_BOX) -> DataFrame:
    """Keep points inside the box; two range predicates that reach the Parquet row-group statistics."""
    return df.filter(F.col(lat).between(*box["lat"]) & F.col(lng).between(*box["lng"]))
