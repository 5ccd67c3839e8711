"""Spatial cell expressions (G3-G5), all native Catalyst math.

There is no H3 function in Spark; the hex bin below is a planar hexagonal
grid (pointy-top, axial coordinates) with the H3 resolution-8 edge length, so
"same point -> same cell, bounded cell size" holds without a Python worker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# NYC bounding box and golden-ratio spacing used to place a
# location id inside it.
NYC_LAT_MIN, NYC_LAT_MAX = 40.4774, 40.9176
NYC_LON_MIN, NYC_LON_MAX = -74.2591, -73.7004
LAT_STEP = 0.6180339887
LON_STEP = 0.3819660113

# Hex grid: Earth radius (m), projection origin and edge length (~H3 res 8).
EARTH_RADIUS_M = 6371008.8
ORIGIN_LAT, ORIGIN_LON = 40.7, -74.0
EDGE_M = 460.0

LAT_SPAN = NYC_LAT_MAX - NYC_LAT_MIN
LON_SPAN = NYC_LON_MAX - NYC_LON_MIN


def _frac(x: Column) -> Column:
    return x - F.floor(x)


def pseudo_latitude(loc: Column) -> Column:
    """Deterministic latitude for a location id; NULL for NULL or id <= 0."""
    v = F.lit(NYC_LAT_MIN) + _frac(loc.cast("double") * F.lit(LAT_STEP)) * F.lit(LAT_SPAN)
    return F.when(loc.isNotNull() & (loc > 0), v)


def pseudo_longitude(loc: Column) -> Column:
    v = F.lit(NYC_LON_MIN) + _frac(loc.cast("double") * F.lit(LON_STEP)) * F.lit(LON_SPAN)
    return F.when(loc.isNotNull() & (loc > 0), v)


def location_cell(loc: Column) -> Column:
    """Fallback cell id without coordinates: 'loc_<id>'."""
    return F.concat(F.lit("loc_"), loc.cast("string"))


def hex_axial(
    lat: Column,
    lon: Column,
    edge_m: float = EDGE_M,
    origin_lat: float = ORIGIN_LAT,
    origin_lon: float = ORIGIN_LON,
) -> tuple[Column, Column]:
    """(q, r) axial hex coordinates of a point (equirectangular metres, cube rounding)."""
    x = F.lit(EARTH_RADIUS_M) * F.radians(lon - F.lit(origin_lon)) * F.lit(math.cos(math.radians(origin_lat)))
    y = F.lit(EARTH_RADIUS_M) * F.radians(lat - F.lit(origin_lat))
    qf = (F.lit(math.sqrt(3.0) / 3.0) * x - y / F.lit(3.0)) / F.lit(edge_m)
    rf = (F.lit(2.0 / 3.0) * y) / F.lit(edge_m)
    sf = -qf - rf
    q, r, s = F.floor(qf + 0.5), F.floor(rf + 0.5), F.floor(sf + 0.5)
    dq, dr, ds = F.abs(q - qf), F.abs(r - rf), F.abs(s - sf)
    q_fix = F.when((dq > dr) & (dq > ds), -r - s).otherwise(q)
    r_fix = F.when((dq > dr) & (dq > ds), r).when(dr > ds, -q - s).otherwise(r)
    return q_fix.cast("bigint"), r_fix.cast("bigint")


def hex_cell(lat: Column, lon: Column, edge_m: float = EDGE_M) -> Column:
    """Cell id string 'hx_<q>_<r>'; NULL when either coordinate is NULL."""
    q, r = hex_axial(lat, lon, edge_m)
    return F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.concat(F.lit("hx_"), q.cast("string"), F.lit("_"), r.cast("string")),
    )
