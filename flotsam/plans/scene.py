"""Scene pixels to masks, hex cube, statistics over time and summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flotsam.config import DETECTOR, GROUPS, QUALITY_CODES, REJECT_ORDER, SCL_CLEAR, SCL_CLOUD_EDGE
from flotsam.functions import spectral as S
from flotsam.functions.geo import hex_axial, hex_centre
from flotsam.operators import raster
from flotsam.operators.ranking import running_totals

SHIP = GROUPS.index("ship")
PX_KM2 = 1e-4        # one 10 m pixel


def permanent_water(px: DataFrame, keys: list[str], n_dates: int) -> DataFrame:
    """Pixels that are water in at least half of their clear observations."""
    g = px.groupBy(*keys).agg(F.count_if(F.col("scl") == 6).alias("water_n"), F.count_if(F.col("scl").isin(*SCL_CLEAR)).alias("clear_n"))
    need = 3 if n_dates > 5 else 1
    return g.withColumn("water", (F.col("clear_n") >= need) & (F.col("water_n") >= 0.5 * F.col("clear_n")))


def static_hits(px: DataFrame, keys: list[str], hit: Column, valid: Column) -> DataFrame:
    """Objects that answer on many dates: at least three hits and a fifth of the clear views."""
    g = px.groupBy(*keys).agg(F.count_if(hit & valid).alias("hits"), F.count_if(valid).alias("seen"))
    return g.withColumn("static", (F.col("hits") >= 3) & (F.col("hits") >= 0.2 * F.greatest(F.col("seen"), F.lit(1))))


def scene_masks(px: DataFrame, image: list[str], scene: list[str], cfg=DETECTOR) -> DataFrame:
    """All masks of the scenes of an area, with detection candidates and final detections.

    ``px``: image keys, ``row``, ``col``, ``height``, ``width``, water, valid, p, cls, flags, scl and the bands of the
    ice test. Ice, ship and cloud growth share one distance pass per scene; static objects need one aggregation over
    the scenes of the area.
    """
    px = px.withColumn("ice", S.ice())
    ice_far = raster.city_distance(px, scene, {"ice_d": F.col("ice"), "cloud_d": F.col("scl").isin(*SCL_CLOUD_EDGE)},
                                   max(cfg.ice_zone_px, cfg.cloud_buffer_px))
    ice_far = ice_far.withColumns({"ice_zone": F.col("ice_d") <= cfg.ice_zone_px, "cloud_zone": F.col("cloud_d") <= cfg.cloud_buffer_px,
                                   "valid_now": F.col("valid") & (F.col("ice_d") > cfg.ice_valid_px)})
    hit = (F.col("p") >= cfg.p_det) | (F.col("cls") == SHIP)
    st = static_hits(ice_far, [*image, "row", "col"], hit, F.col("valid") & ~F.col("ice_zone"))
    size = ice_far.groupBy(*image).agg(F.max("height").alias("height"), F.max("width").alias("width"))
    st = raster.dilate(st.join(size, image), image, F.col("static"), 1, "static_zone")
    d = ice_far.join(st.select(*image, "row", "col", "static_zone"), [*image, "row", "col"])
    d = raster.dilate(d, scene, (F.col("cls") == SHIP) & F.col("valid_now") & ~F.col("static_zone"), cfg.ship_px, "near_ship")
    cand = (F.col("p") >= cfg.p_det) & F.col("valid_now")
    det = (cand & (F.col("flags") == cfg.all_flags) & ~F.col("static_zone") & ~F.col("near_ship") & ~F.col("ice_zone") & ~F.col("cloud_zone"))
    return d.withColumns({"cand": cand, "det": det, "quality": S.quality_code(
        F.col("water"), F.col("scl"), F.col("b11"), F.col("ice_zone"), F.col("near_ship"), F.col("static_zone"), cfg)}).drop("ice_d", "cloud_d")


def scene_gate(px: DataFrame, scene: list[str], cfg=DETECTOR) -> DataFrame:
    """Visible, icy and glinting shares of a scene; scenes with too little visible water are dropped."""
    g = px.groupBy(*scene).agg(F.count_if("water").alias("water_px"), F.count_if("valid").alias("valid_px"),
                               F.count_if(F.col("ice") & F.col("water")).alias("ice_px"), F.count_if(F.col("glint") & F.col("water")).alias("glint_px"))
    w = F.greatest(F.col("water_px"), F.lit(1))
    return (g.where(F.col("valid_px") >= cfg.min_scene_valid * F.col("water_px"))
            .withColumns({"ice_frac": F.col("ice_px") / w, "glint_frac": F.col("glint_px") / w})
            .withColumn("glinty", F.col("glint_frac") > cfg.glint_scene_frac).drop("ice_px", "glint_px"))


def separation(px: DataFrame, scene: list[str], kept: Column) -> DataFrame:
    """Candidates per scene by the first reason that rejects them; candidates = kept + rejected.

    ``px``: cand, static_zone, near_ship, ice_zone, cloud_zone, flags.
    """
    def failed(bit: int) -> Column:
        return F.col("flags").bitwiseAND(bit) == 0

    tests = dict(zip(REJECT_ORDER, (F.col("static_zone"), F.col("near_ship"), F.col("ice_zone"), F.col("cloud_zone"),
                                    failed(1), failed(2), failed(4), ~kept)))
    reason = None
    for name, cond in tests.items():
        reason = F.when(cond, F.lit(name)) if reason is None else reason.when(cond, F.lit(name))
    d = px.where("cand").withColumn("_r", reason.otherwise(F.lit("kept")))
    out = d.groupBy(*scene).agg(F.count(F.lit(1)).alias("candidates"), *[
        F.count_if(F.col("_r") == n).alias("kept" if n == "kept" else f"rejected_{n}") for n in (*REJECT_ORDER, "kept")])
    return out


def model_classes(px: DataFrame, scene: list[str]) -> DataFrame:
    return px.groupBy(*scene).agg(*[F.count_if((F.col("cls") == i) & F.col("valid")).alias(f"{g}_px")
                                    for i, g in enumerate(GROUPS) if g != "water"])


# ---- hex cube ------------------------------------------------------------------------------------------------------

def hex_cube(px: DataFrame, scene: list[str], cell: str = "cell", cfg=DETECTOR) -> DataFrame:
    """Cell × scene: visible share, detections, cover in m² per km² and status.

    ``px``: water, valid, det, glint, frac, reliable (of the scene).
    """
    g = px.where("water").groupBy(*scene, cell).agg(
        F.count(F.lit(1)).alias("water_px"), F.count_if("valid").alias("valid_px"), F.count_if("det").alias("ndet"),
        F.sum(F.when(F.col("det"), F.col("frac") * 100).otherwise(F.lit(0.0))).alias("area_m2"),
        F.count_if("glint").alias("glint_px"), F.first("reliable").alias("reliable"))
    vfrac, gfrac = F.col("valid_px") / F.col("water_px"), F.col("glint_px") / F.col("water_px")
    return g.withColumns({
        "valid_frac": vfrac, "glint_frac": gfrac,
        "cover": F.when(F.col("valid_px") > 0, F.col("area_m2") / (F.col("valid_px") * PX_KM2)).otherwise(F.lit(0.0)),
        "status": F.when(F.col("ndet") > 0, 1).when((vfrac < cfg.min_hex_valid) | (gfrac > 0.5) | ~F.col("reliable"), 2).otherwise(0)})


def hex_grid(px: DataFrame, area: list[str], plane, step: int = 5, px_km2: float = PX_KM2) -> DataFrame:
    """Cells of the water pixels: id, water area and centre (km in the plane).

    A pixel takes the cell of the centre of its ``step``×``step`` block; ``plane(row, col)`` gives planar km.
    """
    br = F.least(F.floor(F.col("row") / step) * step + step // 2, F.col("height") - 1)
    bc = F.least(F.floor(F.col("col") / step) * step + step // 2, F.col("width") - 1)
    q, r = hex_axial(*plane(br, bc))
    g = px.groupBy(*area, q.alias("q"), r.alias("r")).agg((F.count(F.lit(1)) * px_km2).alias("water_km2"))
    cx, cy = hex_centre(F.col("q"), F.col("r"))
    return g.select(*area, F.concat_ws(":", F.col("q").cast("string"), F.col("r").cast("string")).alias("cell"), "water_km2", cx.alias("cx"), cy.alias("cy"))


def hex_statistics(cube: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Persistence, mean and highest cover, heat and monthly trend per cell over the usable dates."""
    first = cube.groupBy(*[k for k in keys if k != "cell"]).agg(F.min(day).alias("_d0"))
    on = [k for k in keys if k != "cell"]
    c = cube.join(first, on) if on else cube.withColumn("_d0", first.scalar())
    ok = (F.col("valid_frac") > 0.5) & F.col("reliable")
    x = (F.col(day) - F.col("_d0")) / 30.4
    g = c.groupBy(*keys).agg(
        F.count_if(ok).alias("n_obs"), F.count_if(ok & (F.col("ndet") > 0)).alias("_nd"),
        F.sum(F.when(ok, F.col("cover")).otherwise(F.lit(0.0))).alias("_sc"),
        F.max(F.when(ok, F.col("cover")).otherwise(F.lit(0.0))).alias("max_cover"),
        F.regr_slope(F.when(ok, F.col("cover")), F.when(ok, x)).alias("_slope"),
        (F.max(F.when(ok, x)) - F.min(F.when(ok, x))).alias("_span"))
    n = F.greatest(F.col("n_obs"), F.lit(1))
    g = g.withColumns({"persistence": F.col("_nd") / n, "mean_cover": F.col("_sc") / n,
                       "trend": F.when((F.col("n_obs") >= 4) & (F.col("_span") > 0), F.col("_slope")).otherwise(F.lit(0.0))})
    return g.withColumn("hot", F.col("persistence") * F.log1p("mean_cover")).drop("_nd", "_sc", "_slope", "_span")


def scene_summary(px: DataFrame, scene: list[str], cfg=DETECTOR) -> DataFrame:
    """Detections, cover, visible share, raw hits and quality shares of every scene."""
    w = F.greatest(F.count_if("water"), F.lit(1))
    area = F.sum(F.when(F.col("det"), F.col("frac") * 100).otherwise(F.lit(0.0)))
    return px.groupBy(*scene).agg(
        F.count_if("det").alias("n_det"), area.alias("area_m2"),
        (area / F.greatest(F.count_if("valid") * PX_KM2, F.lit(1e-9))).alias("cover"), (F.count_if("valid") / w).alias("valid_frac"),
        F.count_if(F.col("valid") & (F.col("p") >= cfg.p_det)).alias("n_raw"),
        *[(F.count_if(F.col("water") & (F.col("quality") == c)) / w).alias(f"q_{name}") for c, name, _ in QUALITY_CODES if c != 1])


def status_counts(cube: DataFrame, scene: list[str]) -> DataFrame:
    return cube.groupBy(*scene).agg(*[F.count_if(F.col("status") == c).alias(n) for c, n in
                                      ((0, "not_detected"), (1, "detected"), (2, "insufficient_data"))])


def series_arrays(cube: DataFrame, area: list[str], date: str, chunk: int = 1000) -> DataFrame:
    """Nested form of the cube: per area, date and block of cells, arrays ordered by cell number ``i``."""
    cells = running_totals(cube.select(*area, "cell", F.lit(1).alias("_one")).distinct(), [*area, "cell"], {"_r": "_one"})
    cells = cells.join(cells.groupBy(*area).agg(F.min("_r").alias("_b")), area).select(*area, "cell", (F.col("_r") - F.col("_b")).alias("i"))
    c = cube.join(cells, [*area, "cell"])
    s = F.array_sort(F.collect_list(F.struct("i", "cover", "ndet", "valid_frac", "status")))
    g = c.groupBy(*area, date, F.floor(F.col("i") / chunk).alias("block")).agg(s.alias("s"))
    return g.select(*area, date, "block", *[F.col("s")[n].alias(n) for n in ("i", "cover", "ndet", "valid_frac", "status")])


# ---- zones ---------------------------------------------------------------------------------------------------------

def zone_table(det: DataFrame, scene: list[str], px_km2: float = PX_KM2) -> DataFrame:
    """Zones from labelled detections (label, row, col, p, frac): pixels, cover, probabilities, mean row and column."""
    return det.groupBy(*scene, "label").agg(
        F.count(F.lit(1)).alias("n_pixels"), (F.count(F.lit(1)) * px_km2).alias("area_km2"), F.sum(F.col("frac") * 100).alias("cover_m2"),
        F.avg("p").alias("p_mean"), F.max("p").alias("p_max"), F.avg("row").alias("row_mean"), F.avg("col").alias("col_mean"))


def number_zones(zones: DataFrame, scene: list[str], prefix: Column) -> DataFrame:
    """Ids ``<prefix>-NNN`` from north to south, then west to east, within each scene."""
    w = Window.partitionBy(*scene).orderBy(F.col("lat").desc(), F.col("lon"), F.col("label"))
    return zones.withColumn("zone_id", F.concat(prefix, F.lit("-"), F.format_string("%03d", F.row_number().over(w))))


def describe_zones(zones: DataFrame, scored: list[tuple[str, DataFrame]], near: DataFrame) -> DataFrame:
    """Zones with the nearest field event and the density of every profile at their centre.

    ``near``: zone_id, event_id, dist, gap_days, conc; ``scored``: (profile, zone_id with value, lo80, hi80, lo95, hi95, status, reasons).
    """
    out = zones.join(near.select("zone_id", F.col("event_id").alias("field_event_id"), F.col("dist").alias("field_distance_km"), F.col("gap_days").alias("field_date_gap_days"),
                                 F.col("conc").alias("field_conc_items_km2")), "zone_id", "left")
    for profile, s in scored:
        known = F.col("status") != "unavailable"
        out = out.join(s.select("zone_id", F.when(known, F.col("value")).alias(f"conc_{profile}_items_km2"),
                                *[F.when(known, F.col(b)).alias(f"conc_{profile}_{b}") for b in ("lo80", "hi80", "lo95", "hi95")],
                                F.col("status").alias(f"conc_{profile}_status"), F.col("reasons").alias(f"conc_{profile}_reasons")), "zone_id", "left")
    return out.withColumn("cover_m2_km2", F.col("cover_m2") / F.greatest(F.col("area_km2"), F.lit(1e-9)))
