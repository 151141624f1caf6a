"""Coordinates and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted coordinate range (inclusive) and the earth radius in km.
LAT_RANGE = (21.5, 25.5)
LNG_RANGE = (119.5, 122.5)
EARTH_KM = 6371.0


def valid_geo(lat: Column, lng: Column) -> Column:
    """Both coordinates present and in range; never NULL."""
    return F.coalesce(lat.between(*LAT_RANGE) & lng.between(*LNG_RANGE), F.lit(False))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def parse_coords(lat_raw: Column, lng_raw: Column) -> tuple[Column, Column, Column]:
    """(lat, lng, failed). A bad latitude voids both, a bad longitude only itself; blanks are missing, not bad."""
    lat_text, lng_text = F.nullif(lat_raw, F.lit("")), F.nullif(lng_raw, F.lit(""))
    lat, lng = lat_text.try_cast("double"), lng_text.try_cast("double")
    lat_bad = lat_text.isNotNull() & lat.isNull()
    lng_bad = lng_text.isNotNull() & lng.isNull()
    return lat, F.when(~lat_bad, lng), lat_bad | lng_bad
