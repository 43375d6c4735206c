"""Flat-earth hexagonal cells from latitude/longitude, as Column math.

Not the geodesic cell ids of the reference's plugin (that codec is a
per-row library); the question answered is the same: how many systems lie
in each hexagon of roughly ``edge_km`` size. Axial coordinates (q, r) of
pointy-top hexagons, with standard cube rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Km per degree of latitude, km per degree of longitude at the
# equator, and the reference latitude of the projection (Great Britain).
KM_PER_DEG_LAT = 110.57
KM_PER_DEG_LON = 111.32
PROJECTION_LAT = 55.0
DEFAULT_EDGE_KM = 9.85


def hex_cell(lat, lon, edge_km: float = DEFAULT_EDGE_KM) -> tuple[Column, Column]:
    """Return ``(cell_q, cell_r)`` columns of the hexagon holding (lat, lon)."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    x = lon.cast("double") * F.cos(F.radians(F.lit(PROJECTION_LAT))) * F.lit(KM_PER_DEG_LON)
    y = lat.cast("double") * F.lit(KM_PER_DEG_LAT)
    q = (F.lit(math.sqrt(3.0)) / F.lit(3.0) * x - y / F.lit(3.0)) / F.lit(edge_km)
    r = (y * F.lit(2.0) / F.lit(3.0)) / F.lit(edge_km)
    rq = F.floor(q + F.lit(0.5))
    rr = F.floor(r + F.lit(0.5))
    rs = F.floor(-q - r + F.lit(0.5))
    dq = F.abs(rq - q)
    dr = F.abs(rr - r)
    ds = F.abs(rs + q + r)
    q_wins = (dq > ds) & (dq > dr)
    cell_q = F.when(q_wins, -rs - rr).otherwise(rq)
    cell_r = F.when(q_wins, rr).when(ds > dr, rr).otherwise(-rq - rs)
    return cell_q.cast("bigint"), cell_r.cast("bigint")
