"""Survey-shaped views over the given Parquet tables.

One SQL text per view, in the syntax common to Spark SQL and DuckDB, so that both engines see the same rows.
Times are epoch seconds (double) next to the calendar date.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate", "part": None, "region": None,
        "supplier": None, "customer": None, "nation": None}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_event": (("events",), """
        select event_id, user_id, event_type, value,
               concat('S', cast(user_id % 4 + 1 as string)) as source_id,
               cast(ts as date) as date_utc, month(ts) as month_no,
               event_id % 5 <> 0 as time_known,
               case when event_id % 5 <> 0 then ts_s else floor(ts_s / 86400) * 86400 end as t_start_s,
               case when event_id % 5 <> 0 then ts_s + 3600 * (1 + user_id % 5)
                    else floor(ts_s / 86400) * 86400 + 86400 end as t_end_s,
               27 + cast((event_id * 7919) % 15000 as double) / 1000 as lon,
               cast(405 as double) / 10 + cast((event_id * 104729) % 5500 as double) / 1000 as lat,
               case when event_type = 'error' then null else cast(floor(value) as bigint) end as n_items,
               cast(2 + user_id % 19 as double) as length_km, cast(10 as double) as width_m,
               cast(2 + user_id % 19 as double) * 10 / 1000 as area_km2,
               value * 100 / cast(2 + user_id % 19 as double) as conc_published,
               case when event_type = 'error' then value * 100 / cast(2 + user_id % 19 as double)
                    else cast(floor(value) as double) * 100 / cast(2 + user_id % 19 as double) end as conc,
               case when user_id % 3 = 0 then 'A' when user_id % 3 = 1 then 'B' else 'C' end as profile,
               case when event_type = 'view' then 'transfer_check' else 'train' end as role,
               case when event_type = 'signup' then 'item_observation' else 'transect_density' end as record_type,
               case when event_type = 'signup' then 'object_context' when event_type = 'view' then 'plastic_category'
                    when event_type = 'click' then 'all_litter' else 'total_plastic' end as target_scope,
               case when event_type = 'click' then (case when user_id % 2 = 0 then 'S4_visual_GT2_5' else 'S3_visual_GT2' end)
                    when user_id % 5 = 0 then 'S1_aerial_GT50' when user_id % 5 = 1 then 'S1_trawl_5_to_50'
                    else 'S2_visual_GT2' end as measurement_profile,
               case when event_id % 41 = 0 then 'zero_scope;source_total_vs_object_count_conflict'
                    when event_id % 7 = 0 then 'rounded' else '' end as quality_flags,
               case when event_id % 11 = 0 then 'mosaic_center' when event_id % 3 = 0 then 'midpoint'
                    else 'strip' end as position_role
        from {events}"""),
    "fx_pixel": (("part",), """
        select scene_no, (p_partkey - p_partkey % 50) / 50 as prow_f, p_partkey,
               cast((p_partkey - p_partkey % 50) / 50 as bigint) as prow, p_partkey % 50 as pcol,
               cast(120 + (p_partkey * 41 + scene_no * 29) % 611 as double) / 10000 as b02,
               cast(100 + (p_partkey * 37 + scene_no * 51) % 997 as double) / 10000 as b03,
               cast(100 + (p_partkey * 39 + scene_no * 68) % 997 as double) / 10000 as b04,
               cast(90 + (p_partkey * 43 + scene_no * 77) % 701 as double) / 10000 as b06,
               cast(100 + (p_partkey * 47 + scene_no * 136) % 997 as double) / 10000 as b08,
               cast(60 + (p_partkey * 53 + scene_no * 170) % 397 as double) / 10000 as b11,
               cast(130 + (p_partkey * 31 + scene_no * 17) % 701 as double) / 10000 as b01,
               cast(90 + (p_partkey * 59 + scene_no * 83) % 601 as double) / 10000 as b05,
               cast(95 + (p_partkey * 67 + scene_no * 97) % 601 as double) / 10000 as b07,
               cast(100 + (p_partkey * 71 + scene_no * 113) % 797 as double) / 10000 as b8a,
               cast(50 + (p_partkey * 73 + scene_no * 149) % 297 as double) / 10000 as b12,
               case when (p_partkey * 13 + scene_no * 7) % 20 < 15 then 6 when (p_partkey * 13 + scene_no * 7) % 20 < 17 then 9
                    when (p_partkey * 13 + scene_no * 7) % 20 < 18 then 3 else 4 end as scl,
               cast((p_partkey * 97 + scene_no * 101) % 256 as double) / 255 as p,
               cast((p_partkey * 61 + scene_no * 29) % 256 as double) / 255 as frac,
               (p_partkey * 11 + scene_no * 3) % 8 as flags, (p_partkey * 7 + scene_no * 5) % 6 as cls
        from (select p_partkey, cast(n as bigint) as scene_no from (select p_partkey, {seq5} as n from {part}) x) y"""),
    "fx_cellpx": (("fx_pixel",), """
        select scene_no, scene_no * 9 as day_no, scene_no % 4 <> 3 as reliable, p_partkey, prow, pcol,
               concat(cast((prow - prow % 10) / 10 as bigint), ':', cast((pcol - pcol % 10) / 10 as bigint)) as cell,
               p_partkey % 7 <> 0 as water, p_partkey % 7 <> 0 and scl in (4, 6) as valid,
               p_partkey % 7 <> 0 and scl in (4, 6) and p >= 0.5 and flags >= 4 as det,
               p_partkey % 7 <> 0 and b11 > 0.03 as glint, p, frac, b11, cls, flags, scl
        from {fx_pixel}"""),
    "fx_sea": (("events",), """
        select scene_no, cast(floor(n / 40) as bigint) as prow, n % 40 as pcol,
               not (scene_no = 0 and cast(floor(n / 40) as bigint) % 120 = 60 and n % 40 not in (10, 11, 12)
                    or (n * 7919 + scene_no * 31) % (case when scene_no = 0 then 4999 else 24989 end) = 0) as water
        from (select event_id % 2 as scene_no, cast(floor(event_id / 2) as bigint) as n from {events}) e"""),
    "fx_voyage": (("events",), """
        select event_id, concat('S', cast(user_id as string)) as source_id, cast(ts as date) as date_utc, value as conc,
               cast((event_id * 7919) % 360000 as double) / 1000 - 180 as lon, cast((event_id * 104729) % 140000 as double) / 1000 - 70 as lat
        from {events}"""),
    "fx_flow": (("events",), """
        select event_id % 80 as ix, cast(floor(event_id / 80) as bigint) % 40 as iy, cast(floor(event_id / 3200) as bigint) as hour_no, value / 10 as wind_ms
        from {events}"""),
    "fx_zone": (("events",), """
        select event_id as zone_no, user_id % 5 as aoi_no, cast(ts as date) as date_utc, value as cover_m2, ts_s as t_s,
               cast((event_id * 31) % 1000 as double) / 1000 as p_max, 1 + event_id % 9 as n_pixels,
               27 + cast((event_id * 7919) % 15000 as double) / 1000 as lon,
               cast(405 as double) / 10 + cast((event_id * 104729) % 5500 as double) / 1000 as lat,
               event_id % 6 <> 0 as scene_reliable
        from {events}"""),
    "fx_scene": (("orders",), """
        select o_orderkey as scene_no, o_custkey % 40 as aoi_no, o_custkey % 3 as orbit_no,
               case when o_custkey % 2 = 0 then 'S2A' else 'S2B' end as platform,
               cast(o_orderdate as date) as date_utc, t_s + (o_orderkey % 24) * 3600 as t_s,
               cast(o_orderkey % 101 as double) as cloud_pct, concat('T', cast(o_orderkey % 3 as string)) as tile,
               case when o_orderkey % 10 < 6 then 'sentinel' else 'landsat' end as collection,
               o_totalprice / 1000000 as cover,
               26 + cast((o_orderkey * 6007) % 16000 as double) / 1000 as lon0,
               cast(39 as double) + cast((o_orderkey * 5003) % 7000 as double) / 1000 as lat0
        from {orders}"""),
    "fx_label": (("lineitem",), """
        select l_suppkey as scene_no, l_orderkey, l_linenumber, l_partkey, l_returnflag as split_code,
               l_partkey % 16 as cl, cast(l_linenumber % 4 as bigint) as conf,
               l_quantity > 25 as pred, l_quantity > 40 as pred_strict,
               l_discount * 10 as score, l_extendedprice / 100000 as fdi, l_tax * 10 as ndvi
        from {lineitem}"""),
    "fx_pred": (("lineitem",), """
        select l_orderkey, l_linenumber, l_suppkey as group_no, l_orderkey % 5 as fold, l_returnflag as profile,
               case when l_linestatus = 'F' then 'cv' else 'holdout' end as part,
               l_extendedprice / 1000 as y_true, l_extendedprice * (1 - l_discount) / 1000 as pred_model,
               cast(30 as double) as pred_base, l_quantity as x1, l_tax * 100 as x2
        from {lineitem}"""),
    "fx_track": (("events",), """
        select user_id as particle, user_id % 5 as aoi_no,
               row_number() over (partition by user_id order by ts, event_id) - 1 as hour_no,
               27 + cast((event_id * 7919) % 15000 as double) / 1000 as lon,
               cast(405 as double) / 10 + cast((event_id * 104729) % 5500 as double) / 1000 as lat,
               event_id % 9 = 0 as beached
        from {events}"""),
    "fx_wind": (("events",), """
        select cast(floor(ts_s / 3600) as bigint) as hour_no, user_id % 16 as cell_no, avg(value) / 10 as wind_ms
        from {events} group by cast(floor(ts_s / 3600) as bigint), user_id % 16"""),
}


class Views:
    """Lazy access: ``fx.fx_event`` or ``fx.events`` as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, table: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        t = BASE.get(table)
        if t:
            name = "ts_s" if table == "events" else "t_s"
            df = df.withColumn(name, F.col(t).cast("timestamp").cast("double"))
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        needs, text = VIEWS[name]
        args = {n: getattr(self, n) for n in needs}
        return self.spark.sql(text.replace("{seq5}", "explode(sequence(0, 4))"), **args)


def _duck(name: str) -> str:
    if name in VIEWS:
        return name
    if BASE.get(name):
        alias = "ts_s" if name == "events" else "t_s"
        return f"(select *, epoch({BASE[name]}) as {alias} from {name}) {name}_t"
    return name


def with_views(views: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the CTEs of the fixture views it reads."""
    done: list[str] = []

    def add(v: str) -> None:
        for n in VIEWS[v][0]:
            if n in VIEWS:
                add(n)
        if v not in done:
            done.append(v)

    for v in views:
        add(v)
    ctes = []
    for v in done:
        needs, text = VIEWS[v]
        ctes.append(f"{v} as ({text.replace('{seq5}', 'unnest(range(5))').format(**{n: _duck(n) for n in needs})})")
    body = body.strip()
    if not ctes:
        return body
    head = ", ".join(ctes)
    if body.lower().startswith("with recursive"):
        return f"with recursive {head}, {body[len('with recursive'):].lstrip()}"
    if body.lower().startswith("with "):
        return f"with {head}, {body[5:].lstrip()}"
    return f"with {head} {body}"
