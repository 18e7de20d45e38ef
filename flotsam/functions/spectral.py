"""Per-pixel spectral expressions, predicates and codes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flotsam.config import COVER_EDGES, DETECTOR, SCL_BAD, WATER_REF, WAVELENGTH

EPS = 1e-6
_K = (WAVELENGTH["b08"] - WAVELENGTH["b04"]) / (WAVELENGTH["b11"] - WAVELENGTH["b04"])


def c(name: str) -> Column:
    return F.col(name)


def nd(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def fdi(b06: Column, b08: Column, b11: Column) -> Column:
    return b08 - (b06 + (b11 - b06) * (_K * 10))


def fai(b04: Column, b08: Column, b11: Column) -> Column:
    return b08 - (b04 + (b11 - b04) * _K)


def indices(prefix: str = "") -> dict[str, Column]:
    b = {k: c(prefix + k) for k in ("b03", "b04", "b06", "b08", "b11")}
    return {"ndvi": nd(b["b08"], b["b04"]), "fdi": fdi(b["b06"], b["b08"], b["b11"]),
            "fai": fai(b["b04"], b["b08"], b["b11"]), "ndwi": nd(b["b03"], b["b08"]),
            "pi": b["b08"] / (b["b08"] + b["b04"] + EPS), "ndmi": nd(b["b08"], b["b11"])}


def water_candidate(robust: bool = False) -> Column:
    """Pixels that may describe the background: clean water only, or anything but land and cloud."""
    b02 = c("b02")
    if robust:
        return (b02 > 0) & (b02 < 0.25) & (c("b11") < 0.08)
    i = indices()
    return (i["ndwi"] > 0) & (i["fdi"] < 0.01) & (b02 < 0.25) & (b02 > 0)


def ice() -> Column:
    b3, b8, b11 = c("b03"), c("b08"), c("b11")
    return (b3 > 0.15) & (b8 > 0.10) & (b11 < 0.08) & ((b3 - b11) / (b3 + b11 + EPS) > 0.6)


def usable(water: Column, b02: Column, scl: Column) -> Column:
    return water & b02.isNotNull() & ~scl.isin(*SCL_BAD)


def anomaly_gate(valid: Column, d_fdi: Column, d_b08: Column, d_b02: Column) -> Column:
    return valid & ((d_fdi > 0.01) | (d_b08 > 0.01) | (d_b02 > 0.03))


def unmix(spectrum: dict[str, Column], dense: dict[str, float]) -> Column:
    """Cover fraction of a pixel between clean water and a dense patch."""
    den = sum((dense[b] - WATER_REF[b]) ** 2 for b in dense)
    num = None
    for b in dense:
        term = (spectrum[b] - WATER_REF[b]) * (dense[b] - WATER_REF[b])
        num = term if num is None else num + term
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), num / den))


def to_reflectance(dn: Column, baseline: Column, b02_dn: Column) -> Column:
    """Digital number to reflectance; from baseline 4.0 the product carries an offset, zero in B02 is no data."""
    off = F.when(F.coalesce(baseline, F.lit(0.0)) >= 4.0, F.lit(-1000.0)).otherwise(F.lit(0.0))
    return F.when(b02_dn != 0, (dn + off) / 10000.0)


def decode_reflectance(v: Column) -> Column:
    return F.when(v != -9999, v / 10000.0)


def encode_reflectance(v: Column) -> Column:
    return F.coalesce(F.bround(v * 10000, 0), F.lit(-9999.0)).cast("int")


def quality_code(water: Column, scl: Column, b11: Column, ice_zone: Column, near_ship: Column, static: Column,
                 cfg=DETECTOR) -> Column:
    """Usability code; later reasons overwrite earlier ones, glint only marks pixels still good."""
    glint = ~scl.isin(0, 1, 3, 8, 9, 10) & b11.isNotNull() & (b11 > cfg.glint_b11)
    return (F.when(~water, 1).when(static, 9).when(near_ship, 8).when(ice_zone | (scl == 11), 7).when(glint, 6)
            .when(scl == 10, 5).when(scl == 3, 4).when(scl.isin(8, 9), 3)
            .when(scl.isin(0, 1) | b11.isNull(), 2).otherwise(0))


def cover_class(cover: Column, ndet: Column) -> Column:
    out = F.when(~(ndet > 0), 0)
    for i in range(len(COVER_EDGES), 0, -1):
        out = out.when(cover > COVER_EDGES[i - 1], i)
    return out.otherwise(0)


def sea_state(wind: Column, iced: Column | None = None, cfg=DETECTOR) -> Column:
    s = F.when(wind >= cfg.storm_wind_ms, F.lit("storm")).when(wind >= cfg.rough_wind_ms, F.lit("rough")).otherwise(
        F.lit("calm"))
    return s if iced is None else F.when(iced, F.lit("ice")).otherwise(s)


def unreliable_reason(wind: Column, ice_frac: Column, glinty: Column, cfg=DETECTOR) -> Column:
    return (F.when(ice_frac > cfg.ice_frac, F.lit("ice")).when(wind >= cfg.storm_wind_ms, F.lit("storm"))
            .when(glinty, F.lit("glint")))
