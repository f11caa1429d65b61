"""Column builders for positions: distances, local kilometres, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
EARTH_RADIUS_M = 6_371_008.8
DEPOT_LON, DEPOT_LAT = 104.0665, 30.6570
KM_PER_DEGREE_LON, KM_PER_DEGREE_LAT = 111.32, 110.57
METRES_PER_DEGREE = 111_320.0
COST_PER_KM = 100.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def local_km(lon: Column, lat: Column, lon0: float | Column = DEPOT_LON, lat0: float | Column = DEPOT_LAT) -> tuple[Column, Column]:
    """East and north kilometres from an origin, by the local equirectangular projection."""
    lon0, lat0 = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lon0, lat0))
    return (lon - lon0) * F.lit(KM_PER_DEGREE_LON) * F.cos(F.radians(lat0)), (lat - lat0) * F.lit(KM_PER_DEGREE_LAT)


def cell(value: Column, size: float) -> Column:
    """The number of the grid interval of ``size`` that holds a value."""
    return F.floor(value / F.lit(float(size))).cast("long")


def degree_steps(radius_m: float, max_abs_lat: float) -> tuple[float, float]:
    """Grid steps in degrees of longitude and latitude that are no shorter than ``radius_m`` up to a latitude."""
    lat = radius_m / 110_000.0
    return lat / math.cos(math.radians(max_abs_lat)), lat


def polar_angle(x: Column, y: Column) -> Column:
    return F.atan2(y, x)


def unit_scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling to 0..1; a constant column gives 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def dihedral(x: Column, y: Column) -> Column:
    """The eight symmetries of the unit square as an array of (turn, x, y)."""
    flips = [(x, y), (F.lit(1.0) - x, y), (x, F.lit(1.0) - y), (F.lit(1.0) - x, F.lit(1.0) - y)]
    every = flips + [(b, a) for a, b in flips]
    return F.array(*[F.struct(F.lit(i).alias("turn"), a.cast("double").alias("x"), b.cast("double").alias("y")) for i, (a, b) in enumerate(every)])
