"""Geometry as column expressions: distances, grids, boxes, hexagons, map projection."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from flotsam.config import BASINS, COMPASS

EARTH_KM = 6371.0
KM_PER_DEG = 111.32


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine_km(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(lit(v)) for v in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def planar_km(lon, lat, lat0) -> tuple[Column, Column]:
    """Local plane around latitude ``lat0``: x east, y north, km."""
    return lit(lon) * KM_PER_DEG * F.cos(F.radians(lit(lat0))), lit(lat) * KM_PER_DEG


def in_box(lon: Column, lat: Column, box) -> Column:
    x0, y0, x1, y1 = box
    return lon.between(x0, x1) & lat.between(y0, y1)


def basin_of(lon: Column, lat: Column, inland: Column | None = None) -> Column:
    """Basin name of a point; the last matching box wins, inland water has none."""
    out = F.lit(None).cast("string")
    for name, box in BASINS.items():
        out = F.when(in_box(lon, lat, box), F.lit(name)).otherwise(out)
    return out if inland is None else F.when(~inland, out)


def in_basins(lon: Column, lat: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | in_box(lon, lat, BASINS[n])
    return out


def utm_zone(lon: Column) -> Column:
    return F.floor((lon + 180) / 6).cast("int") + 1


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


# WGS84 and the Krüger series of the transverse Mercator projection, to the fourth power of the third flattening
_A, _INV_F = 6378137.0, 298.257223563
_N = (1 / _INV_F) / (2 - 1 / _INV_F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FWD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
        13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
        61 * _N**3 / 240 - 103 * _N**4 / 140,
        49561 * _N**4 / 161280)
_INV = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
        _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
        17 * _N**3 / 480 - 37 * _N**4 / 840,
        4397 * _N**4 / 161280)
_LAT = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
        7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
        56 * _N**3 / 15 - 136 * _N**4 / 35,
        4279 * _N**4 / 630)
_K0 = 0.9996


def lonlat_to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing, m (southern latitudes get the usual false northing)."""
    dlon = F.radians(lon - (zone * 6 - 183))
    e2 = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(e2) * F.atanh(F.lit(e2) * s))
    xi0 = F.atan2(t, F.cos(dlon))
    eta0 = F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    xi, eta = xi0, eta0
    for j, a in enumerate(_FWD, 1):
        xi = xi + a * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + a * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    north = F.when(lat >= 0, F.lit(0.0)).otherwise(F.lit(1e7))
    return F.lit(500000.0) + _K0 * _RADIUS * eta, north + _K0 * _RADIUS * xi


def utm_to_lonlat(x: Column, y: Column, zone: Column, south: Column | None = None) -> tuple[Column, Column]:
    y0 = y if south is None else F.when(south, y - 1e7).otherwise(y)
    xi, eta = y0 / (_K0 * _RADIUS), (x - 500000.0) / (_K0 * _RADIUS)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_INV, 1):
        xi0 = xi0 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi
    for j, d in enumerate(_LAT, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))) + (zone * 6 - 183), F.degrees(lat)


def pixel_centre(row: Column, col: Column, x0, y0, res=10.0) -> tuple[Column, Column]:
    """Map coordinates of a pixel centre; (x0, y0) is the upper-left corner."""
    return lit(x0) + (col + 0.5) * res, lit(y0) - (row + 0.5) * res


def pixel_of(x: Column, y: Column, x0, y0, res=10.0) -> tuple[Column, Column]:
    """Row and column of a map point."""
    return F.floor((lit(y0) - y) / res).cast("bigint"), F.floor((x - lit(x0)) / res).cast("bigint")


def snap_grid(x0: Column, y0: Column, x1: Column, y1: Column, res: float = 10.0) -> dict[str, Column]:
    """Grid with edges on multiples of ``res`` that contains the box."""
    left, top = F.floor(x0 / res) * res, F.ceil(y1 / res) * res
    return {"left": left.cast("double"), "top": top.cast("double"),
            "width": F.ceil((x1 - left) / res).cast("bigint"), "height": F.ceil((top - y0) / res).cast("bigint")}


# ---- hexagonal cells -----------------------------------------------------------------------------------------------

HEX_AREA_KM2 = 0.737327598
HEX_SIDE_KM = math.sqrt(2 * HEX_AREA_KM2 / (3 * math.sqrt(3)))


def hex_axial(x: Column, y: Column, side: float = HEX_SIDE_KM) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon holding the planar point, by rounding cube coordinates."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / side, (2 / 3 * y) / side
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    qq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    rr2 = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return qq.cast("bigint"), rr2.cast("bigint")


def hex_centre(q: Column, r: Column, side: float = HEX_SIDE_KM) -> tuple[Column, Column]:
    return side * math.sqrt(3) * (q + r / 2), side * 1.5 * r


def hex_id(lon: Column, lat: Column, lat0=0.0, side: float = HEX_SIDE_KM) -> Column:
    """Cell id ``q:r`` in the plane of latitude ``lat0`` (one value per area of interest)."""
    q, r = hex_axial(*planar_km(lon, lat, lat0), side)
    return F.concat(q.cast("string"), F.lit(":"), r.cast("string"))


def hex_ring(q: Column, r: Column, lat0, side: float = HEX_SIDE_KM) -> Column:
    """Closed ring of the cell as an array of ``struct(lon, lat)``, rounded to 6 digits."""
    x, y = hex_centre(q, r, side)
    k = KM_PER_DEG * F.cos(F.radians(lit(lat0)))
    pts = []
    for i in (0, 1, 2, 3, 4, 5, 0):
        a = math.pi / 180 * (60 * i + 30)
        pts.append(F.struct(F.round((x + side * math.cos(a)) / k, 6).alias("lon"),
                            F.round((y + side * math.sin(a)) / KM_PER_DEG, 6).alias("lat")))
    return F.array(*pts)


# ---- directions, lines, polygons -----------------------------------------------------------------------------------

def compass(dx: Column, dy: Column) -> Column:
    """Eight-sector name of a direction towards (dx east, dy north)."""
    i = (F.floor((F.degrees(F.atan2(dx, dy)) + 382.5) / 45) % 8).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), i + 1)


def speed_to_uv(speed: Column, direction_deg: Column, towards: bool) -> tuple[Column, Column]:
    """Components of a flow: currents are given by where they go, winds by where they come from."""
    sign = 1.0 if towards else -1.0
    a = F.radians(direction_deg)
    return sign * speed * F.sin(a), sign * speed * F.cos(a)


def point_segment_km(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from a point to a segment; all arguments in km."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, ((px - ax) * dx + (py - ay) * dy) / len2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def ring_box(ring: Column) -> Column:
    """Bounding box of an array of ``struct(lon, lat)``, 5 digits."""
    xs, ys = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.array(F.round(F.array_min(xs), 5), F.round(F.array_min(ys), 5),
                   F.round(F.array_max(xs), 5), F.round(F.array_max(ys), 5))


def grow_box(box: tuple[Column, Column, Column, Column], min_km: float) -> tuple[Column, ...]:
    """Box widened around its centre so that both sides reach ``min_km``."""
    lon0, lat0, lon1, lat1 = box
    half = min_km / 2 / KM_PER_DEG
    cx, cy = (lon0 + lon1) / 2, (lat0 + lat1) / 2
    k = F.cos(F.radians(cy))
    return (F.least(lon0, cx - half / k), F.least(lat0, cy - half),
            F.greatest(lon1, cx + half / k), F.greatest(lat1, cy + half))
