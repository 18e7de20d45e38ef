"""Registered queries: projections, predicates and scalar functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from flotsam.config import CONCENTRATION_STATUS, DETECTION_STATUS, QUALITY_CODES, TILE_REGIONS
from flotsam.config import WATER_REF as W
from flotsam.functions import density as D
from flotsam.functions import geo as G
from flotsam.functions import spectral as S
from flotsam.functions import status as ST
from flotsam.plans import field as FP
from flotsam.plans import queries as Q
from flotsam.plans.registry import register
from flotsam.session import new_path
from flotsam.sources import registry as reg
from flotsam.sources import sinks

R = F.round
C = F.col


@register("exp1_strip_area", "fx_event", oracle="select event_id, round(length_km * width_m / 1000, 6) as area_km2 from fx_event")
def _(fx):
    return fx.fx_event.select("event_id", R(D.strip_area_km2(C("length_km"), C("width_m")), 6).alias("area_km2"))


@register("exp2_field_density", "fx_event", oracle="""
    select event_id, round(n_items / area_km2, 6) as conc,
           case when not (area_km2 > 0) then 'area_not_positive' when n_items < 0 then 'count_negative' end as problem
    from fx_event""")
def _(fx):
    return fx.fx_event.select("event_id", R(D.field_density(C("n_items"), C("area_km2")), 6).alias("conc"),
                              D.density_violation(C("n_items"), C("area_km2")).alias("problem"))


POISSON_SQL = """ns as (select distinct n_items as n from fx_event where n_items is not null),
    b as (select n, 0 as i, cast(n as double) as lo, n + 10 * sqrt(n + 1) + 20 as hi,
                 cast(greatest(n - 10 * sqrt(n) - 20, 1e-9) as double) as lo2, cast(greatest(n, 1e-6) as double) as hi2 from ns
      union all
      select n, i + 1, case when c > 0.025 then m else lo end, case when c > 0.025 then hi else m end,
             case when c2 > 0.975 then m2 else lo2 end, case when c2 > 0.975 then hi2 else m2 end
      from (select *, (lo + hi) / 2 as m, (lo2 + hi2) / 2 as m2,
              list_sum(list_transform(range(0, n + 1), lambda k: exp(-(lo + hi) / 2 + k * ln((lo + hi) / 2) - lgamma(k + 1)))) as c,
              coalesce(list_sum(list_transform(range(0, n), lambda k: exp(-(lo2 + hi2) / 2 + k * ln((lo2 + hi2) / 2) - lgamma(k + 1)))), 0) as c2
            from b where i < 60)),
    r as (select n, case when n = 0 then 0 else (lo2 + hi2) / 2 end as nlo, (lo + hi) / 2 as nhi from b where i = 60)"""


@register("exp3_poisson_interval", "fx_event", oracle="with recursive " + POISSON_SQL + """
    select event_id, round(nlo / area_km2, 6) as lo95, round(nhi / area_km2, 6) as hi95 from fx_event e left join r on r.n = e.n_items""")
def _(fx):
    ev = D.poisson_interval(fx.fx_event, "n_items")
    return ev.select("event_id", R(C("n_lo") / C("area_km2"), 6).alias("lo95"), R(C("n_hi") / C("area_km2"), 6).alias("hi95"))


def _clock(h, m):
    return F.format_string("%02d:%02d:00", h, m)


@register("exp4_event_interval", "fx_event", oracle="""
    with c as (select *, cast(epoch(cast(date_utc as timestamp)) as double) as d0, event_id % 5 <> 0 as k,
      (user_id % 24) * 3600 + (event_id % 60) * 60 as a, (event_id % 24) * 3600 + (user_id % 60) * 60 as b from fx_event)
    select event_id, k as time_known, case when k then d0 + a else d0 end as t_start_s,
      case when not k then d0 + 86400 when b < a then d0 + b + 86400 else d0 + b end as t_end_s from c""")
def _(fx):
    k = C("event_id") % 5 != 0
    ev = fx.fx_event.withColumns({
        "c0": F.when(k, _clock(C("user_id") % 24, C("event_id") % 60)).otherwise(""),
        "c1": F.when(k, _clock(C("event_id") % 24, C("user_id") % 60)).otherwise("")})
    return ev.select("event_id", *[c.alias(n) for n, c in D.event_interval(C("date_utc").cast("string"), C("c0"), C("c1")).items()])


@register("exp5_reference_time", "fx_event", oracle="""
    select event_id, round(case when time_known then t_start_s + (t_end_s - t_start_s) / 2 else t_end_s end, 3) as t_ref_s from fx_event""")
def _(fx):
    return fx.fx_event.select("event_id", R(D.reference_time(C("t_start_s"), C("t_end_s"), C("time_known")), 3).alias("t_ref_s"))


HAV = """2 * 6371.0 * asin(sqrt(pow(sin(radians({b2} - {b1}) / 2), 2) + cos(radians({b1})) * cos(radians({b2})) * pow(sin(radians({a2} - {a1}) / 2), 2)))"""


@register("exp6_haversine", "fx_event", oracle="select event_id, round(" + HAV.format(a1="lon", b1="lat", a2="39.7215", b2="43.579") + ", 6) as km from fx_event")
def _(fx):
    return fx.fx_event.select("event_id", R(G.haversine_km(C("lon"), C("lat"), 39.7215, 43.579), 6).alias("km"))


@register("exp7_geometry_type", "fx_event", oracle="""
    select event_id, g as geometry_type, round(case when g = 'mosaic' then sqrt(area_km2 / pi()) when g = 'point' then 3.0 else 0 end, 6) as radius_km
    from (select *, case when event_id % 13 = 0 then 'segments' when position_role = 'mosaic_center' then 'mosaic'
                         when position_role = 'strip' then 'strip' else 'point' end as g from fx_event)""")
def _(fx):
    g = FP.geometry(C("event_id") % 13 == 0, C("position_role"), C("position_role") == "strip", C("area_km2"))
    return fx.fx_event.select("event_id", g["geometry_type"].alias("geometry_type"), R(g["footprint_radius_km"], 6).alias("radius_km"))


@register("exp8_published_mismatch", "fx_event", oracle="""
    select event_id, round(n_items / area_km2, 6) as conc, round(conc_published, 6) as published from fx_event
    where conc_published > 0 and abs(n_items / area_km2 - conc_published) / conc_published > 0.01""")
def _(fx):
    bad = D.published_mismatch(C("n_items"), C("area_km2"), C("conc_published"))
    return fx.fx_event.where(bad).select("event_id", R(C("n_items") / C("area_km2"), 6).alias("conc"), R("conc_published", 6).alias("published"))


SELECT_SQL = """sel0 as (select *, record_type = 'transect_density' as td,
      contains(quality_flags, 'source_total_vs_object_count_conflict') as banned from fx_event),
    sel1 as (select *, case when td and target_scope = 'total_plastic' and measurement_profile = 'S2_visual_GT2' then 'A/train'
      when td and target_scope = 'all_litter' and measurement_profile = 'S4_visual_GT2_5' then 'B/train'
      when td and target_scope = 'all_litter' and measurement_profile = 'S3_visual_GT2' then 'B/transfer_check'
      when td and target_scope = 'total_plastic' and measurement_profile = 'S1_trawl_5_to_50' then 'C/optional' end as m from sel0),
    sel as (select *, case when m is not null and not banned then 'included' else 'excluded' end as decision,
      case when m is not null and not banned then split_part(m, '/', 1) else '' end as sel_profile,
      case when m is not null and not banned then split_part(m, '/', 2) else '' end as sel_role,
      case when m is not null then (case when banned then 'excluded_flag' else '' end)
        when target_scope = 'object_context' then 'object_context_not_label'
        when target_scope in ('plastic_category', 'fisheries_litter_category') then 'subpopulation_not_target'
        when target_scope = 'total_plastic' and measurement_profile = 'S1_aerial_GT50' then 'total_missing_or_conflict'
        else 'not_target_profile' end as reason_code from sel1)"""


@register("exp9_field_selection", "fx_event", oracle="with " + SELECT_SQL + " select event_id, decision, sel_profile, sel_role, reason_code from sel")
def _(fx):
    return FP.select_rows(fx.fx_event).select("event_id", "decision", "sel_profile", "sel_role", "reason_code")


@register("exp9_registry_csv", "fx_event", oracle="with " + SELECT_SQL + " select event_id, cast(n_items as double) as items_count, decision, sel_profile, sel_role, reason_code from sel")
def _(fx):
    """From CSV text to decisions: the registry is written by the CSV sink, scanned as text, typed and selected."""
    cols = ["event_id", "items_count", "record_type", "target_scope", "measurement_profile", "quality_flags"]
    path = new_path(fx.fx_event.sparkSession)
    sinks.write_csv(fx.fx_event.withColumn("items_count", C("n_items").cast("string")), path, cols)
    rows = reg.typed_registry(reg.read_registry(fx.fx_event.sparkSession, path, cols))
    return FP.select_rows(rows).select(C("event_id").cast("bigint").alias("event_id"), "items_count", "decision", "sel_profile", "sel_role", "reason_code")


def _world(df):
    """Survey points spread over the globe."""
    return df.withColumns({"wx": (C("lon") - 27) * 24 - 180, "wy": (C("lat") - 40.5) * 20 - 50})


WORLD = "(select *, (lon - 27) * 24 - 180 as wx, (lat - 40.5) * 20 - 50 as wy from fx_event) w"


@register("exp10_utm_epsg", "fx_event", oracle=f"""
    select event_id, cast(case when wy >= 0 then 32600 else 32700 end + floor((wx + 180) / 6) + 1 as bigint) as epsg from {WORLD}""")
def _(fx):
    return _world(fx.fx_event).select("event_id", G.utm_epsg(C("wx"), C("wy")).cast("bigint").alias("epsg"))


@register("exp11_pixel_grid_round_trip", "fx_event", oracle="""
    select event_id, cast(36 as bigint) + cast(case when lon >= 36 then 1 when lon < 30 then -1 else 0 end as bigint) as zone_no,
           round(lon, 6) as lon_back, round(lat, 6) as lat_back, true as inside from fx_event""")
def _(fx):
    """Map projection there and back, and the pixel that holds the point."""
    z = G.utm_zone(C("lon"))
    x, y = G.lonlat_to_utm(C("lon"), C("lat"), z)
    ev = fx.fx_event.select("event_id", "lon", "lat", z.cast("bigint").alias("zone_no"), x.alias("x"), y.alias("y"))
    x0, y0 = F.floor((C("x") - 5000) / 10) * 10, F.ceil((C("y") + 5000) / 10) * 10
    row, col = G.pixel_of(C("x"), C("y"), x0, y0)
    px, py = G.pixel_centre(row, col, x0, y0)
    lon, lat = G.utm_to_lonlat(C("x"), C("y"), C("zone_no"))
    return ev.select("event_id", "zone_no", R(lon, 6).alias("lon_back"), R(lat, 6).alias("lat_back"),
                     ((F.abs(px - C("x")) <= 5.0001) & (F.abs(py - C("y")) <= 5.0001)).alias("inside"))


IDX = """(b08 - b04) / (b08 + b04 + 1e-6) as ndvi, b08 - (b06 + (b11 - b06) * ((842.0 - 665.0) / (1610.0 - 665.0) * 10)) as fdi,
    b08 - (b04 + (b11 - b04) * ((842.0 - 665.0) / (1610.0 - 665.0))) as fai, (b03 - b08) / (b03 + b08 + 1e-6) as ndwi,
    b08 / (b08 + b04 + 1e-6) as pi, (b08 - b11) / (b08 + b11 + 1e-6) as ndmi"""


@register("exp13_spectral_indices", "fx_pixel", oracle=f"""
    select scene_no, p_partkey, round(ndvi, 6) as ndvi, round(fdi, 6) as fdi, round(fai, 6) as fai, round(ndwi, 6) as ndwi,
           round(pi, 6) as pi, round(ndmi, 6) as ndmi from (select *, {IDX} from fx_pixel)""")
def _(fx):
    return fx.fx_pixel.select("scene_no", "p_partkey", *[R(v, 6).alias(k) for k, v in S.indices().items()])


@register("exp14_water_candidates", "fx_pixel", oracle=f"""
    select scene_no, p_partkey, ndwi > 0 and fdi < 0.01 and b02 < 0.25 and b02 > 0 as strict, b02 > 0 and b02 < 0.25 and b11 < 0.08 as robust
    from (select *, {IDX} from fx_pixel)""")
def _(fx):
    return fx.fx_pixel.select("scene_no", "p_partkey", S.water_candidate().alias("strict"), S.water_candidate(True).alias("robust"))


@register("exp15_ice_predicate", "fx_pixel", oracle="""
    select scene_no, p_partkey, b03 * 2 > 0.15 and b08 * 2 > 0.10 and b11 < 0.08 and (b03 * 2 - b11) / (b03 * 2 + b11 + 1e-6) > 0.6 as ice from fx_pixel""")
def _(fx):
    px = fx.fx_pixel.withColumns({"b03": C("b03") * 2, "b08": C("b08") * 2})
    return px.select("scene_no", "p_partkey", S.ice().alias("ice"))


@register("exp16_usable_pixel", "fx_pixel", oracle="""
    select scene_no, p_partkey, p_partkey % 7 <> 0 and p_partkey % 9 <> 0 and scl not in (0, 1, 3, 8, 9, 10, 11) as usable from fx_pixel""")
def _(fx):
    return fx.fx_pixel.select("scene_no", "p_partkey", S.usable(
        C("p_partkey") % 7 != 0, F.when(C("p_partkey") % 9 != 0, C("b02")), C("scl")).alias("usable"))


REF_FDI = "(0.0121 - (0.0140 + (0.0086 - 0.0140) * ((842.0 - 665.0) / (1610.0 - 665.0) * 10)))"


@register("exp17_anomaly_gate", "fx_pixel", oracle=f"""
    select scene_no, p_partkey from (select *, {IDX} from fx_pixel)
    where scl = 6 and (fdi - {REF_FDI} > 0.01 or b08 - 0.0121 > 0.01 or b02 - 0.0342 > 0.03)""")
def _(fx):
    ref = F.lit(W["b06"]), F.lit(W["b08"]), F.lit(W["b11"])
    gate = S.anomaly_gate(C("scl") == 6, S.indices()["fdi"] - S.fdi(*ref), C("b08") - W["b08"], C("b02") - W["b02"])
    return fx.fx_pixel.where(gate).select("scene_no", "p_partkey")


UNMIX = ("b05", "b06", "b07", "b08", "b8a", "b11", "b12")


@register("exp18_unmixing", "fx_pixel", oracle=f"""
    with d as (select *, b08 - (b06 + (b11 - b06) * ((842.0 - 665.0) / (1610.0 - 665.0) * 10)) as fdi from fx_pixel where cls = 0),
    e as (select {', '.join(f'avg({b}) - {W[b]} as {b}' for b in UNMIX)} from d where fdi >= (select quantile_cont(fdi, 0.99) from d))
    select scene_no, p_partkey, round(greatest(0, least(1, ({' + '.join(f'(p.{b} - {W[b]}) * e.{b}' for b in UNMIX)}) / ({' + '.join(f'e.{b} * e.{b}' for b in UNMIX)}))), 6) as frac from fx_pixel p, e""")
def _(fx):
    """The dense end is the mean spectrum of the debris pixels above the 99 % quantile of their index: one row."""
    debris = fx.fx_pixel.where("cls = 0").withColumns({"fdi": S.indices()["fdi"], "all": F.lit(1)})
    dense = {b: v for b, v in Q.dense_endmember(debris, ["all"], "fdi", list(UNMIX)).first().asDict().items() if b in UNMIX}
    return fx.fx_pixel.select("scene_no", "p_partkey", R(S.unmix({b: C(b) for b in UNMIX}, dense), 6).alias("frac"))


@register("exp19_quality_code", "fx_pixel", oracle="""
    select scene_no, p_partkey, cast(case when p_partkey % 7 = 0 then 1 when p_partkey % 31 = 0 then 9 when p_partkey % 23 = 0 then 8
      when p_partkey % 19 = 0 or scl = 11 then 7 when scl not in (0, 1, 3, 8, 9, 10) and p_partkey % 9 <> 0 and b11 > 0.03 then 6
      when scl = 10 then 5 when scl = 3 then 4 when scl in (8, 9) then 3 when scl in (0, 1) or p_partkey % 9 = 0 then 2 else 0 end as bigint) as q from fx_pixel""")
def _(fx):
    k = C("p_partkey")
    q = S.quality_code(k % 7 != 0, C("scl"), F.when(k % 9 != 0, C("b11")), k % 19 == 0, k % 23 == 0, k % 31 == 0)
    return fx.fx_pixel.select("scene_no", "p_partkey", q.cast("bigint").alias("q"))


@register("exp20_cover_class", "fx_zone", oracle="""
    select zone_no, cast(case when n_pixels <= 2 then 0 when cover_m2 > 100 then 4 when cover_m2 > 40 then 3 when cover_m2 > 15 then 2
      when cover_m2 > 0 then 1 else 0 end as bigint) as cover_class from fx_zone""")
def _(fx):
    return fx.fx_zone.select("zone_no", S.cover_class(C("cover_m2"), F.greatest(C("n_pixels") - 2, F.lit(0))).cast("bigint").alias("cover_class"))


@register("exp21_sea_state", "fx_wind", oracle="""
    select hour_no, cell_no, case when hour_no % 11 = 0 then 'ice' when wind_ms >= 8 then 'storm' when wind_ms >= 6 then 'rough' else 'calm' end as sea,
      case when hour_no % 11 = 0 then 'ice' when wind_ms >= 8 then 'storm' when cell_no % 5 = 0 then 'glint' end as reason from fx_wind""")
def _(fx):
    iced = C("hour_no") % 11 == 0
    return fx.fx_wind.select("hour_no", "cell_no", S.sea_state(C("wind_ms"), iced).alias("sea"),
                             S.unreliable_reason(C("wind_ms"), F.when(iced, 0.01).otherwise(0.0), C("cell_no") % 5 == 0).alias("reason"))


@register("exp22_basin", "fx_event", oracle=f"""
    select event_id, case when event_id % 10 = 0 then null when wx between -160 and -120 and wy between 20 and 40 then 'north_pacific_gyre'
      when wx between -4 and 10 and wy between 50 and 60 then 'north_sea'
      when wx between -75 and -55 and wy between 20 and 35 then 'nw_atlantic_subtropical'
      when wx between 27 and 42 and wy between 40.5 and 46 then 'black_sea' end as basin from {WORLD}""")
def _(fx):
    return _world(fx.fx_event).select("event_id", G.basin_of(C("wx"), C("wy"), C("event_id") % 10 == 0).alias("basin"))


SYNC = """sy as (select event_id, time_known, (t_start_s + (event_id % 40) * 3600) as ts, t_start_s as t0, t_end_s as t1, value / 10 as wind from fx_event),
    sy2 as (select *, (ts - t1) / 3600 as a, (ts - t0) / 3600 as b, (ts - (t0 + (t1 - t0) / 2)) / 3600 as c from sy),
    sy3 as (select *, greatest(abs(a), abs(b)) as m from sy2)"""


def _sync(fx):
    ev = fx.fx_event.withColumns({"ts": C("t_start_s") + (C("event_id") % 40) * 3600, "wind": C("value") / 10})
    return ev.withColumns(D.sync_offsets(C("ts"), C("t_start_s"), C("t_end_s")))


@register("exp23_sync_offsets", "fx_event", oracle="with " + SYNC + """
    select event_id, round(a, 4) as dt_min_h, round(b, 4) as dt_max_h, round(c, 4) as dt_repr_h, round(m, 4) as abs_dt_max_h from sy3""")
def _(fx):
    return _sync(fx).select("event_id", *[R(c, 4).alias(c) for c in ("dt_min_h", "dt_max_h", "dt_repr_h", "abs_dt_max_h")])


@register("exp24_sync_tier", "fx_event", oracle="with " + SYNC + """
    select event_id, case when time_known and m <= 3 then 'A' when m <= 18 then 'B' else 'C' end as tier from sy3""")
def _(fx):
    return _sync(fx).select("event_id", D.sync_tier(C("time_known"), C("abs_dt_max_h")).alias("tier"))


@register("exp25_drift_buffer", "fx_event", oracle="with " + SYNC + """
    select event_id, round(m * 3600 * (0.3 + 0.02 * wind) / 1000, 5) as drift_km, round(least(m * 3600 * (0.3 + 0.02 * wind) / 1000, 5), 5) as buffer_km,
           round((0.3 + 0.02 * wind) * 86.4, 6) as v_km_day from sy3""")
def _(fx):
    d = D.drift_buffer_km(C("abs_dt_max_h"), C("wind"))
    return _sync(fx).select("event_id", R(d, 5).alias("drift_km"), R(F.least(d, F.lit(5.0)), 5).alias("buffer_km"),
                            R(D.drift_speed_km_day(C("wind")), 6).alias("v_km_day"))


@register("exp26_space_time_distance", "fx_event", oracle=f"""
    select event_id, round(sqrt(d * d + pow(40 * dt, 2)), 5) as h from (select event_id, abs(t_start_s - 1705000000) / 86400 as dt,
      {HAV.format(a1='lon', b1='lat', a2='35', b2='43')} as d from fx_event)""")
def _(fx):
    return fx.fx_event.select("event_id", R(D.st_distance(
        G.haversine_km(C("lon"), C("lat"), 35.0, 43.0), F.abs(C("t_start_s") - 1705000000) / 86400, 40.0), 5).alias("h"))


@register("exp27_counting_variance", "fx_event", oracle="""
    select event_id, round(greatest(n_items, 1) / pow(greatest(n_items, 1) + area_km2, 2), 8) as var from fx_event where n_items is not null
    union all select event_id, null from fx_event where n_items is null""")
def _(fx):
    return fx.fx_event.select("event_id", R(D.counting_variance(C("n_items"), C("area_km2")), 8).alias("var"))


@register("exp28_footprint_size", "fx_event", oracle="""
    select event_id, case when event_id % 4 <> 0 and length_km > 0 then length_km / 2 when event_id % 6 <> 0 then 3.0 else 0.0 end as footprint_km from fx_event""")
def _(fx):
    length, radius = F.when(C("event_id") % 4 != 0, C("length_km")), F.when(C("event_id") % 6 != 0, F.lit(3.0))
    return fx.fx_event.select("event_id", F.when(length > 0, length / 2).otherwise(F.coalesce(radius, F.lit(0.0))).alias("footprint_km"))


MARKS = (("port", 39.7215, 43.579), ("river_a", 39.9248, 43.4192), ("river_b", 31.5, 44.9))


@register("exp29_nearest_landmark", "fx_zone", oracle="""
    with m(mark, mx, my) as (values ('port', 39.7215, 43.579), ('river_a', 39.9248, 43.4192), ('river_b', 31.5, 44.9)),
    d as (select zone_no, mark, (lon - mx) * 111.32 * cos(radians((lat + my) / 2)) as dx, (lat - my) * 111.32 as dy from fx_zone, m),
    r as (select *, sqrt(dx * dx + dy * dy) as km, row_number() over (partition by zone_no order by sqrt(dx * dx + dy * dy), mark) rn from d)
    select zone_no, mark, round(km, 5) as km, list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'],
      cast(floor((degrees(atan2(dx, dy)) + 382.5) / 45) % 8 as integer) + 1) as sector from r where rn = 1""")
def _(fx):
    """The landmarks of an area are a map column; every row looks at its own few entries."""
    marks = F.create_map(*[x for n, lo, la in MARKS for x in (F.lit(n), F.struct(F.lit(lo).alias("lon"), F.lit(la).alias("lat")))])
    z = fx.fx_zone.withColumn("marks", marks)

    def entry(k, v):
        dx = (C("lon") - v["lon"]) * 111.32 * F.cos(F.radians((C("lat") + v["lat"]) / 2))
        dy = (C("lat") - v["lat"]) * 111.32
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("km"), k.alias("mark"), dx.alias("dx"), dy.alias("dy"))

    best = F.array_min(F.transform(F.map_entries("marks"), lambda e: entry(e["key"], e["value"])))
    z = z.withColumn("b", best)
    return z.select("zone_no", C("b.mark").alias("mark"), R("b.km", 5).alias("km"), G.compass(C("b.dx"), C("b.dy")).alias("sector"))


@register("exp30_flow_components", "fx_wind", oracle="""
    select hour_no, cell_no, round(wind_ms / 3.6 * sin(radians(dir)), 6) as cu, round(wind_ms / 3.6 * cos(radians(dir)), 6) as cv,
      round(-wind_ms * sin(radians(dir)), 6) as wu, round(-wind_ms * cos(radians(dir)), 6) as wv
    from (select *, cast((hour_no * 37 + cell_no * 11) % 360 as double) as dir from fx_wind)""")
def _(fx):
    d = ((C("hour_no") * 37 + C("cell_no") * 11) % 360).cast("double")
    cu, cv = G.speed_to_uv(C("wind_ms") / 3.6, d, towards=True)
    wu, wv = G.speed_to_uv(C("wind_ms"), d, towards=False)
    return fx.fx_wind.select("hour_no", "cell_no", R(cu, 6).alias("cu"), R(cv, 6).alias("cv"), R(wu, 6).alias("wu"), R(wv, 6).alias("wv"))


@register("exp31_row_guards", "fx_event", oracle="""
    select 'duplicate' as violation, profile, user_id, count(*) as n from fx_event group by profile, user_id having count(*) > 1
    union all select 'no_density', profile, user_id, count(*) from fx_event where n_items is null and event_id % 2 = 0 group by profile, user_id""")
def _(fx):
    dup = FP.duplicate_events(fx.fx_event, "profile", "user_id").select(
        F.lit("duplicate").alias("violation"), "profile", "user_id", C("n_rows").alias("n"))
    ev = fx.fx_event.withColumn("conc_published", F.when(C("event_id") % 2 != 0, C("conc_published")))
    miss = FP.event_violations(ev).where("violation = 'no_density'").join(ev.select("event_id", "profile", "user_id"), "event_id")
    return dup.unionByName(miss.groupBy("violation", "profile", "user_id").agg(F.count(F.lit(1)).alias("n")))


@register("exp33_explain_event", "fx_event", oracle="with recursive " + POISSON_SQL + """
    select event_id, 1 as step, 'interval' as label, round((t_end_s - t_start_s) / 86400, 6) as value, case when time_known then 'known time' else 'whole day' end as formula from fx_event
    union all select event_id, 2, 'density', round(conc, 6), case when n_items is not null then concat('C = N / A = ', n_items, ' / ', format('{:.2f}', area_km2)) else 'published estimate' end from fx_event
    union all select event_id, 3, 'lo95', round(nlo / area_km2, 6), 'exact Poisson bound' from fx_event e join r on r.n = e.n_items
    union all select event_id, 4, 'hi95', round(nhi / area_km2, 6), 'exact Poisson bound' from fx_event e join r on r.n = e.n_items""")
def _(fx):
    return FP.explain_event(FP.event_density(fx.fx_event)).withColumn("value", R("value", 6))


@register("exp34_local_plane", "fx_zone", oracle="""
    select zone_no, round(lon * 111.32 * cos(radians(43.5)), 5) as x_km, round(lat * 111.32, 5) as y_km from fx_zone""")
def _(fx):
    x, y = G.planar_km(C("lon"), C("lat"), 43.5)
    return fx.fx_zone.select("zone_no", R(x, 5).alias("x_km"), R(y, 5).alias("y_km"))


@register("exp35_tile_region", "fx_label", oracle="""
    select scene_no, t as tile, case when t like '16P%' or t like '16Q%' then 'Central America' when t like '18Q%' or t like '19Q%' then 'Caribbean'
      when t like '30V%' then 'Northern Europe' when t like '36J%' then 'South Africa' when t like '48%' or t like '50L%' or t like '51P%' then 'South-East Asia'
      when t like '51R%' or t like '52S%' then 'East Asia' else 'other' end as region, count(*) as n
    from (select scene_no, list_extract(['16PCC', '18QYF', '30VWH', '36JUN', '48MYU', '51RVQ', '33TWN'], cast(scene_no % 7 as integer) + 1) as t from fx_label) group by all""")
def _(fx):
    tiles = F.array(*[F.lit(t) for t in ("16PCC", "18QYF", "30VWH", "36JUN", "48MYU", "51RVQ", "33TWN")])
    px = fx.fx_label.withColumn("tile", F.element_at(tiles, (C("scene_no") % 7).cast("int") + 1))
    return px.groupBy("scene_no", "tile", ST.tile_region(C("tile"), TILE_REGIONS).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@register("exp36_wilson_interval", "fx_label", oracle="""
    select scene_no, round((c - h) / d, 6) as lo, round((c + h) / d, 6) as hi from (
      select scene_no, 1 + 1.96 * 1.96 / n as d, k / n + 1.96 * 1.96 / (2 * n) as c, 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n)) as h
      from (select scene_no, count(*) as n, count(*) filter (where pred) as k from fx_label group by 1))""")
def _(fx):
    g = fx.fx_label.groupBy("scene_no").agg(F.count(F.lit(1)).alias("n"), F.count_if("pred").alias("k"))
    lo, hi = D.wilson(C("k"), C("n"))
    return g.select("scene_no", R(lo, 6).alias("lo"), R(hi, 6).alias("hi"))


@register("exp37_status_labels", "fx_pixel", oracle="""
    with q(code, key, label) as (values (0, 'ok', 'пригоден'), (1, 'land', 'суша / вне маски воды'), (2, 'nodata', 'нет данных'), (3, 'cloud', 'облако'),
      (4, 'shadow', 'тень облака'), (5, 'cirrus', 'перистые облака'), (6, 'glint', 'сильный блик'), (7, 'ice', 'лёд / шуга'), (8, 'ship', 'судно / кильватер'), (9, 'static', 'постоянный объект')),
    d(code, key, label) as (values (0, 'not_detected', 'не обнаружено'), (1, 'detected', 'обнаружено'), (2, 'insufficient_data', 'недостаточно данных')),
    c(code, key, label) as (values (0, 'unavailable', 'концентрация недоступна'), (1, 'model_estimate', 'модельная оценка'), (2, 'research_estimate', 'исследовательская оценка'))
    select scene_no, q.label as quality_ru, d.label as detection_ru, c.label as concentration_ru, count(*) as n from fx_pixel p
    join q on q.code = p_partkey % 10 join d on d.code = p_partkey % 3 join c on c.code = flags % 3 group by all""")
def _(fx):
    return fx.fx_pixel.groupBy(
        "scene_no", ST.label_of(C("p_partkey") % 10, QUALITY_CODES).alias("quality_ru"),
        ST.label_of(C("p_partkey") % 3, DETECTION_STATUS).alias("detection_ru"),
        ST.label_of(C("flags") % 3, CONCENTRATION_STATUS).alias("concentration_ru")).agg(F.count(F.lit(1)).alias("n"))


@register("exp38_field_product", "fx_event", oracle=f"""
    select event_id, case when wx - 4 >= -19.88 and wx + 4 <= 12.99 and wy - 4 >= 40.07 and wy + 4 <= 65 then 'cmems_mod_nws_phy-uv_my_7km-2D_PT1H-i'
      else 'cmems_mod_glo_phy_my_0.083deg_P1D-m' end as current_id,
      case when d >= date '2007-01-11' then 'cmems_obs-wind_glo_phy_my_l4_0.125deg_PT1H' when d >= date '1994-06-01' then 'cmems_obs-wind_glo_phy_my_l4_0.25deg_PT1H' end as wind_id
    from (select *, date_utc - cast(event_id % 12000 as integer) as d from {WORLD})""")
def _(fx):
    ev = _world(fx.fx_event).withColumn("d", F.date_sub("date_utc", (C("event_id") % 12000).cast("int")))
    return ev.select("event_id", ST.current_product(C("wx") - 4, C("wy") - 4, C("wx") + 4, C("wy") + 4).alias("current_id"),
                     ST.wind_product(C("d")).alias("wind_id"))


@register("exp39_time_coverage", "fx_wind", oracle="""
    with f as (select cell_no, min(hour_no) as h0, max(hour_no) as h1, count(*) filter (where wind_ms is not null) as n from fx_wind group by 1)
    select cell_no, h0 - 473352 > 12 as starts_late, h1 < 473352 + 743 as ends_early, n = 0 as no_values from f
    where h0 - 473352 > 12 or h1 < 473352 + 743 or n = 0""")
def _(fx):
    return ST.time_coverage_violations(fx.fx_wind, ["cell_no"], "hour_no", "wind_ms", t0=473352, horizon=743)


@register("exp40_grow_box", "fx_zone", oracle="""
    select zone_no, round(least(lon, lon + 0.05 - 3 / 111.32 / cos(radians(lat + 0.005))), 6) as x0, round(least(lat, lat + 0.005 - 3 / 111.32), 6) as y0,
      round(greatest(lon + 0.1, lon + 0.05 + 3 / 111.32 / cos(radians(lat + 0.005))), 6) as x1 from fx_zone""")
def _(fx):
    b = G.grow_box((C("lon"), C("lat"), C("lon") + 0.1, C("lat") + 0.01), 6.0)
    return fx.fx_zone.select("zone_no", R(b[0], 6).alias("x0"), R(b[1], 6).alias("y0"), R(b[2], 6).alias("x1"))


@register("exp41_polygon_box", "fx_scene", oracle="""
    select scene_no, round(lon0 - 0.1, 5) as x0, round(lat0, 5) as y0, round(lon0 + 1, 5) as x1, round(lat0 + 0.9, 5) as y1 from fx_scene""")
def _(fx):
    def pt(x, y):
        return F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(pt(C("lon0"), C("lat0")), pt(C("lon0") + 1, C("lat0") + 0.2), pt(C("lon0") + 0.8, C("lat0") + 0.9),
                   pt(C("lon0") - 0.1, C("lat0") + 0.7), pt(C("lon0"), C("lat0")))
    s = fx.fx_scene.withColumn("b", G.ring_box(ring))
    return s.select("scene_no", *[C("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
