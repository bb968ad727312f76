"""Distances and row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def row_crc(*cols: Column) -> Column:
    """CRC32 of the columns joined by a unit separator, NULL as ~N~."""
    return F.crc32(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("~N~")) for c in cols)).cast("binary"))
