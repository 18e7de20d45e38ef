"""Registered queries: scans, contracts, catalogue and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from flotsam.functions import spectral as S
from flotsam.plans.registry import register
from flotsam.session import new_path
from flotsam.sources import registry as reg
from flotsam.sources import sinks

R = F.round


@register("src1_typed_registry", "fx_event", oracle="""
    select event_id, cast(n_items as double) as items_count, cast(2 + user_id % 19 as double) as transect_length_km
    from fx_event""")
def _(fx):
    text = fx.fx_event.select("event_id", F.coalesce(F.col("n_items").cast("string"), F.lit(" ")).alias("items_count"),
                              (2 + F.col("user_id") % 19).cast("string").alias("transect_length_km"))
    return reg.typed_registry(text)


@register("src2_contract_problems", oracle="""
    with s as (select count(*) n, count(distinct user_id) k, count(distinct event_id) e from events)
    select * from (select 'rows' as "check", n as found, 935 as expected from s union all
                   select 'columns', 6, 56 from s union all
                   select 'duplicate_keys', n - k, 0 from s union all select 'events', e, 318 from s) t
    where found <> expected""")
def _(fx):
    return reg.contract_problems(fx.events.drop("ts_s"), rows=935, columns=56, events=318, key="user_id", event="event_id")


def _segments(fx):
    return fx.lineitem.select(
        F.col("l_orderkey").alias("no"), (F.col("l_linenumber").cast("bigint") * 1000000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("row_no"),
        F.when(F.col("l_linenumber") % 2 == 1, F.to_date("l_shipdate")).alias("date"),
        (F.col("l_quantity") / 10).alias("length_km"), F.col("l_extendedprice").alias("weed"))


SEG = """with seg as (select l_orderkey as no, cast(l_linenumber as bigint) * 1000000000 + l_partkey * 1000 + l_suppkey as row_no,
    case when l_linenumber % 2 = 1 then cast(l_shipdate as date) end as d, l_quantity / 10 as length_km,
    l_extendedprice as weed from lineitem) """


@register("src3_interrupted_transects", oracle=SEG + """
    select no, count(*) as n_segments, round(sum(length_km), 6) as length_km,
           cast(max_by(d, row_no) filter (where d is not null) as varchar) as transect_date
    from seg group by no having count(*) >= 2""")
def _(fx):
    s = reg.transect_segments(_segments(fx))
    return s.groupBy("no", "n_segments", F.col("transect_date").cast("string").alias("transect_date")).agg(
        R(F.sum("length_km"), 6).alias("length_km"))


@register("src4_single_segment_context", oracle=SEG + "select no, max(weed) as weed from seg group by no having count(*) = 1")
def _(fx):
    return reg.single_segment_context(_segments(fx), "weed")


@register("src5_load_events", "fx_event", oracle="""
    select event_id, profile, role, n_items from fx_event where profile = 'B' and role = 'train'""")
def _(fx):
    return reg.load_events(fx.fx_event, "B", "train").select("event_id", "profile", "role", "n_items")


SCENES = """sc as (select scene_no, cast(date_utc as date) + 9496 as s_date, t_s + 9496 * 86400 as t_s, cloud_pct, tile,
    collection, lon0 as sx0, lat0 as sy0, lon0 + 1 as sx1, lat0 + cast(9 as double) / 10 as sy1 from fx_scene)"""


def scenes(fx):
    """Scenes moved to the month of the events."""
    return fx.fx_scene.select(
        "scene_no", F.unix_date("date_utc").alias("_d"), "cloud_pct", "tile", "collection",
        (F.col("t_s") + 9496 * 86400).alias("scene_t_s"), F.col("lon0").alias("sx0"), F.col("lat0").alias("sy0"),
        (F.col("lon0") + 1).alias("sx1"), (F.col("lat0") + 9 / 10).alias("sy1")).withColumn(
            "s_day", F.col("_d") + 9496).drop("_d")


def event_boxes(fx, *columns):
    """Boxes of the events with the further columns a query needs."""
    return fx.fx_event.select(
        "event_id", *columns, F.unix_date("date_utc").alias("e_day"),
        (F.col("lon") - F.col("length_km") / 200).alias("ex0"), (F.col("lon") + F.col("length_km") / 200).alias("ex1"),
        (F.col("lat") - F.col("length_km") / 200).alias("ey0"), (F.col("lat") + F.col("length_km") / 200).alias("ey1"))


CATALOGUE = SCENES + """, hit as (select e.*, s.scene_no, s.t_s as scene_t_s, s.cloud_pct, s.tile, s.collection
    from fx_event e join sc s on s.s_date between e.date_utc - 1 and e.date_utc + 1
     and e.lon - e.length_km / 200 <= s.sx1 and s.sx0 <= e.lon + e.length_km / 200
     and e.lat - e.length_km / 200 <= s.sy1 and s.sy0 <= e.lat + e.length_km / 200)"""


@register("src6_catalogue_search", "fx_event", "fx_scene", oracle="with " + CATALOGUE + """
    select event_id, scene_no, cast(row_number() over (partition by event_id order by scene_t_s, scene_no) as bigint) as seq from hit""")
def _(fx):
    return reg.catalogue_search(event_boxes(fx), scenes(fx), 1, keep=("event_id", "scene_no"))


@register("src7_scene_selection", "fx_scene", oracle="""
    with it as (select *, year(date_utc) as yr, (scene_no * 7) % 60 as c0, 20 + (scene_no * 13) % 81 as len from fx_scene),
    cells as (select scene_no, unnest(range(c0, least(c0 + len, 100))) as cell from it),
    area as (select scene_no, count(*) as area from cells group by 1),
    a as (select it.*, area.area from it join area using (scene_no)),
    pt as (select * from (select *, row_number() over (partition by aoi_no, yr, platform, orbit_no, tile order by area desc, scene_no) rn from a) where rn = 1),
    tp as (select *, first_value(area) over w as top_area, first_value(scene_no) over w as top_no from pt
           window w as (partition by aoi_no, yr, platform, orbit_no order by area desc, scene_no)),
    parts as (select * from tp where top_area / 100 < 0.97 or scene_no = top_no),
    u as (select aoi_no, yr, platform, orbit_no, count(distinct cell) as cells from parts join cells using (scene_no) group by all),
    sc as (select p.aoi_no, p.yr, p.platform, p.orbit_no, count(*) as n_tiles, max(top_no) as main_item,
                  sum(area * cloud_pct) / sum(area) as cloud, max(u.cells) / 100 as cover
           from parts p join u using (aoi_no, yr, platform, orbit_no) group by all)
    select aoi_no as aoi, yr as date, main_item, n_tiles, round(cover, 6) as cover, round(cloud, 6) as cloud from (
      select *, row_number() over (partition by aoi_no, yr order by n_tiles, -cover, cloud, main_item) rn from sc where cover >= 0.9)
    where rn = 1""")
def _(fx):
    it = fx.fx_scene.select(F.col("scene_no").alias("item_id"), F.col("aoi_no").alias("aoi"),
                            F.year("date_utc").cast("bigint").alias("date"), "platform", F.col("orbit_no").alias("orbit"), "tile",
                            F.col("cloud_pct").alias("cloud"), F.lit(100).alias("aoi_cells"))
    c0, n = (F.col("item_id") * 7) % 60, 20 + (F.col("item_id") * 13) % 81
    cov = it.select("item_id", F.sequence(c0, F.least(c0 + n, F.lit(100)) - 1).alias("cells"))
    return reg.select_scenes(it, cov, min_cover=0.9).withColumns({"cover": R("cover", 6), "cloud": R("cloud", 6)})


@register("src8_scene_cap", "fx_scene", oracle="""
    select aoi_no as aoi, scene_no as item_id, cast(row_number() over (partition by aoi_no order by t_s, scene_no) as bigint) as scene_seq
    from (select *, row_number() over (partition by aoi_no order by cloud_pct, t_s, scene_no) rn from fx_scene) where rn <= 30""")
def _(fx):
    s = fx.fx_scene.select(F.col("aoi_no").alias("aoi"), F.col("scene_no").alias("item_id"), F.col("cloud_pct").alias("cloud"), "t_s")
    return reg.cap_scenes(s).select("aoi", "item_id", F.col("scene_seq").cast("bigint").alias("scene_seq"))


@register("src9_acquisition_windows", "fx_scene", oracle="""
    with d as (select distinct aoi_no, cast(date_utc as date) + k as day from fx_scene, (select unnest([-1, 0, 1]) as k)),
    g as (select aoi_no, day, day - cast(row_number() over (partition by aoi_no order by day) as integer) as grp from d)
    select aoi_no as aoi, cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day, count(*) as n_days
    from g group by aoi_no, grp""")
def _(fx):
    w = reg.acquisition_windows(fx.fx_scene.select(F.col("aoi_no").alias("aoi"), F.col("date_utc").alias("date")), 1)
    return w.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@register("src10_reflectance", oracle="""
    select p_partkey, round(case when (p_partkey * 17) % 5 <> 0 then ((p_partkey * 41) % 6011 +
        case when p_partkey % 7 >= 4 then -1000 else 0 end) / 10000 end, 6) as refl from part""")
def _(fx):
    k = F.col("p_partkey")
    return fx.part.select("p_partkey", R(S.to_reflectance((k * 41 % 6011).cast("double"), (k % 7).cast("double"), k * 17 % 5), 6).alias("refl"))


@register("src11_mosaic_fill", "fx_pixel", oracle="""
    select prow, pcol, scene_no as tile_no, b11, cast(scl as bigint) as scl from (
      select *, row_number() over (partition by prow, pcol order by scene_no) rn from fx_pixel where (p_partkey + scene_no) % 3 <> 0)
    where rn = 1""")
def _(fx):
    px = fx.fx_pixel.select("prow", "pcol", F.col("scene_no").alias("tile_no"), F.col("scl").cast("bigint").alias("scl"),
                            F.when((F.col("p_partkey") + F.col("scene_no")) % 3 != 0, F.col("b11")).alias("b11"))
    return reg.mosaic_fill(px, ["prow", "pcol"], "tile_no", "b11", ["b11", "scl"])


@register("src12_wind_lookup", "fx_event", "fx_zone", oracle="""
    with w as (select round_even(lat * 4, 0) / 4 as ky, round_even(lon * 4, 0) / 4 as kx, date_utc, avg(value) / 10 as wind_ms
               from fx_event group by 1, 2, 3)
    select zone_no, round(wind_ms, 6) as wind_ms from fx_zone z left join w
      on w.ky = round_even(z.lat * 4, 0) / 4 and w.kx = round_even(z.lon * 4, 0) / 4 and w.date_utc = z.date_utc""")
def _(fx):
    key = {"ky": reg.wind_key(F.col("lat")), "kx": reg.wind_key(F.col("lon"))}
    w = fx.fx_event.withColumns(key).groupBy("ky", "kx", "date_utc").agg((F.avg("value") / 10).alias("wind_ms"))
    return fx.fx_zone.withColumns(key).join(w, ["ky", "kx", "date_utc"], "left").select("zone_no", R("wind_ms", 6).alias("wind_ms"))


@register("src13_geojson_features", "fx_zone", oracle="""
    select zone_no, concat('{"type":"Feature","geometry":{"type":"Point","coordinates":[', lon, ',', lat,
        ']},"properties":{"zone_no":', zone_no, ',"aoi_no":', aoi_no, ',"n_pixels":', n_pixels, '}}') as feature from fx_zone""")
def _(fx):
    z = fx.fx_zone
    return z.select("zone_no", sinks.point_feature(F.col("lon"), F.col("lat"), ["zone_no", "aoi_no", "n_pixels"]).alias("feature"))


@register("src13_partitioned_table", "fx_zone", oracle="""
    select aoi_no, cast(date_utc as varchar) as date, count(*) as n, cast(sum(n_pixels) as bigint) as n_pixels from fx_zone group by 1, 2""")
def _(fx):
    """Zones through the partitioned sink and back."""
    z = fx.fx_zone
    path = new_path(z.sparkSession)
    sinks.write_partitioned(z.select("aoi_no", F.col("date_utc").cast("string").alias("date"), "zone_no", "n_pixels"), path, ("aoi_no", "date"))
    back = z.sparkSession.read.schema("zone_no bigint, n_pixels bigint, aoi_no bigint, date string").parquet(path)
    return back.groupBy("aoi_no", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("n_pixels").alias("n_pixels"))


@register("src14_reflectance_codec", "fx_pixel", oracle="""
    select scene_no, p_partkey, cast(coalesce(round_even(v * 10000, 0), -9999) as bigint) as dn, v as back from (
      select *, case when p_partkey % 9 <> 0 then b08 end as v from fx_pixel)""")
def _(fx):
    v = F.when(F.col("p_partkey") % 9 != 0, F.col("b08"))
    px = fx.fx_pixel.withColumn("dn", S.encode_reflectance(v).cast("bigint"))
    return px.select("scene_no", "p_partkey", "dn", R(S.decode_reflectance(F.col("dn")), 6).alias("back"))


@register("src15_label_scan", "fx_label", oracle="""
    select concat(cast(scene_no as varchar), '_16PCC') as scene, split_code, grp, count(*) as n from (
      select *, case when cl = 1 then 0 when cl in (2, 3, 4) then 1 when cl = 5 then 2 when cl in (6, 13) then 3
        when cl in (7, 8, 10, 11, 15) then 4 else 5 end as grp from fx_label where cl > 0) group by all""")
def _(fx):
    px = fx.fx_label.withColumn("pid", F.concat(F.col("scene_no").cast("string"), F.lit("_16PCC_"), F.col("l_linenumber").cast("string")))
    return reg.label_scan(px).groupBy("scene", "split_code", F.col("grp").cast("bigint").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
