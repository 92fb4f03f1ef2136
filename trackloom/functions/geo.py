"""Spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
M_PER_DEG = EARTH_RADIUS_M * math.pi / 180.0


def great_circle_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Haversine distance in metres; null if any coordinate is null."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    # greatest and least pass over nulls, the distance must not
    return F.when(h.isNotNull(), F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h)))) * (2 * EARTH_RADIUS_M))
