"""Registered queries: aggregations."""
from __future__ import annotations

from pyspark.sql import functions as F

from flotsam.functions import density as D
from flotsam.functions import geo as G
from flotsam.operators import drift as DR
from flotsam.operators import metrics as M
from flotsam.operators import ranking as RK
from flotsam.plans import field as FP
from flotsam.plans import queries as Q
from flotsam.plans import scene as SC
from flotsam.plans.catalog_exp import SELECT_SQL
from flotsam.plans.registry import register

R = F.round
C = F.col


def rnd(df, digits=6, **cols):
    """Round the given columns (name → digits, default 6 for floats)."""
    return df.withColumns({c: R(C(c), cols.get(c, digits)) for c, t in df.dtypes if t == "double"})


def hex_sql(name, src, x, y, side=G.HEX_SIDE_KM):
    """CTEs that add the axial cell (q, r) of a planar point."""
    return f"""{name}0 as (select *, (sqrt(3) / 3 * ({x}) - ({y}) / 3) / {side!r} as hq, (cast(2 as double) / 3 * ({y})) / {side!r} as hr from {src}),
    {name}1 as (select *, floor(hq + 0.5) as aq, floor(hr + 0.5) as ar, floor(-hq - hr + 0.5) as az from {name}0),
    {name} as (select *, cast(case when abs(aq - hq) > abs(ar - hr) and abs(aq - hq) > abs(az + hq + hr) then -ar - az else aq end as bigint) as q,
      cast(case when abs(aq - hq) > abs(ar - hr) and abs(aq - hq) > abs(az + hq + hr) then ar when abs(ar - hr) > abs(az + hq + hr) then -aq - az else ar end as bigint) as r from {name}1)"""


LAT0 = 43.25


@register("agg1_pooled_density", "fx_event", oracle="""
    select source_id, profile, cast(month_no as bigint) as month_no, count(*) as n_events, cast(sum(n_items) as bigint) as n_items,
      round(sum(n_items) / sum(area_km2), 6) as pooled_conc from fx_event where n_items is not null group by all""")
def _(fx):
    ev = fx.fx_event.where("n_items is not null")
    return ev.groupBy("source_id", "profile", C("month_no").cast("bigint").alias("month_no")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("n_items").alias("n_items"), R(D.pooled_density(C("n_items"), C("area_km2")), 6).alias("pooled_conc"))


@register("agg2_selection_summary", "fx_event", oracle="with " + SELECT_SQL + """
    select 'included' as kind, concat(sel_profile, '/', sel_role) as name, count(*) as n from sel where decision = 'included' group by all
    union all select 'excluded', reason_code, count(*) from sel where decision = 'excluded' group by all""")
def _(fx):
    return FP.selection_summary(FP.select_rows(fx.fx_event))


PAIR_SQL = """pr as (select event_id, source_id, profile, user_id, case when event_id % 7 = 0 then 'accepted' when event_id % 3 = 0 then 'context' else 'rejected' end as decision,
      case when event_id % 7 = 0 then 'ACCEPTED' when event_id % 3 = 0 then 'UNRELIABLE_SYNC' when event_id % 2 = 0 then 'NO_SCENE' else 'GLINT' end as reason_code,
      case when event_id % 4 = 0 then 'A' else 'B' end as sync_tier, case when event_id % 2 = 0 then 'landsat' else 'sentinel' end as collection,
      concat('s', event_id % 50) as scene_id from fx_event)"""


def pair_rows(fx):
    e = C("event_id")
    return fx.fx_event.select(
        "event_id", "source_id", "profile", "user_id",
        F.when(e % 7 == 0, "accepted").when(e % 3 == 0, "context").otherwise("rejected").alias("decision"),
        F.when(e % 7 == 0, "ACCEPTED").when(e % 3 == 0, "UNRELIABLE_SYNC").when(e % 2 == 0, "NO_SCENE").otherwise("GLINT").alias("reason_code"),
        F.when(e % 4 == 0, "A").otherwise("B").alias("sync_tier"), F.when(e % 2 == 0, "landsat").otherwise("sentinel").alias("collection"),
        F.concat(F.lit("s"), (e % 50).cast("string")).alias("scene_id"))


@register("agg3_event_outcome", "fx_event", oracle="with " + PAIR_SQL + """
    select user_id, case when bool_or(decision = 'accepted') then 'accepted' when bool_or(decision = 'context') then 'context' else 'rejected' end as outcome
    from pr group by 1""")
def _(fx):
    return Q.event_outcome(pair_rows(fx), "user_id")


@register("agg4_pair_summary", "fx_event", oracle="with " + PAIR_SQL + """
    select 'reason' as kind, reason_code as name, count(*) as n from pr group by all
    union all select 'accepted_tier', concat(profile, '/', sync_tier), count(*) from pr where decision = 'accepted' group by all
    union all select 'no_scene_source', source_id, count(*) from pr where reason_code = 'NO_SCENE' group by all
    union all select 'scenes', collection, count(distinct scene_id) from pr group by all""")
def _(fx):
    return Q.pair_summary(pair_rows(fx))


CUBE_SQL = """cube as (select scene_no, day_no, cell, count(*) as water_px, count(*) filter (where valid) as valid_px, count(*) filter (where det) as ndet,
      coalesce(sum(frac * 100) filter (where det), 0) as area_m2, count(*) filter (where glint) as glint_px, any_value(reliable) as reliable
      from fx_cellpx where water group by 1, 2, 3),
    cube2 as (select *, valid_px / water_px as valid_frac, glint_px / water_px as glint_frac,
      case when valid_px > 0 then area_m2 / (valid_px * 1e-4) else 0 end as cover from cube),
    cube3 as (select *, cast(case when ndet > 0 then 1 when valid_frac < 0.5 or glint_frac > 0.5 or not reliable then 2 else 0 end as bigint) as status from cube2)"""


def cube(fx):
    return SC.hex_cube(fx.fx_cellpx, ["scene_no", "day_no"])


@register("agg5_hex_cube", "fx_cellpx", oracle="with " + CUBE_SQL + """
    select scene_no, cell, valid_px, ndet, round(area_m2, 6) as area_m2, round(cover, 5) as cover, round(valid_frac, 6) as valid_frac, round(glint_frac, 6) as glint_frac from cube3""")
def _(fx):
    return rnd(cube(fx).select("scene_no", "cell", "valid_px", "ndet", "area_m2", "cover", "valid_frac", "glint_frac"), cover=5)


@register("agg6_hex_status", "fx_cellpx", oracle="with " + CUBE_SQL + "select scene_no, cell, status from cube3")
def _(fx):
    return cube(fx).select("scene_no", "cell", C("status").cast("bigint").alias("status"))


STAT_SQL = CUBE_SQL + """, st as (select cell, count(*) filter (where ok) as n_obs, coalesce(count(*) filter (where ok and ndet > 0) / greatest(count(*) filter (where ok), 1), 0) as persistence,
      coalesce(sum(cover) filter (where ok), 0) / greatest(count(*) filter (where ok), 1) as mean_cover, coalesce(max(cover) filter (where ok), 0) as max_cover,
      regr_slope(cover, x) filter (where ok) as slope, max(x) filter (where ok) - min(x) filter (where ok) as span
      from (select *, valid_frac > 0.5 and reliable as ok, (day_no - min(day_no) over ()) / 30.4 as x from cube3) group by 1)"""


@register("agg7_hex_statistics", "fx_cellpx", oracle="with " + STAT_SQL + """
    select cell, n_obs, round(persistence, 6) as persistence, round(mean_cover, 5) as mean_cover, round(max_cover, 5) as max_cover,
      round(persistence * ln(1 + mean_cover), 5) as hot from st""")
def _(fx):
    s = SC.hex_statistics(cube(fx), ["cell"], "day_no")
    return s.select("cell", "n_obs", R("persistence", 6).alias("persistence"), R("mean_cover", 5).alias("mean_cover"),
                    R("max_cover", 5).alias("max_cover"), R("hot", 5).alias("hot"))


@register("agg8_hex_trend", "fx_cellpx", oracle="with " + STAT_SQL + "select cell, round(case when n_obs >= 4 and span > 0 then slope else 0 end, 4) as trend from st")
def _(fx):
    return SC.hex_statistics(cube(fx), ["cell"], "day_no").select("cell", R("trend", 4).alias("trend"))


@register("agg9_scene_summary", "fx_cellpx", oracle="""
    with q as (select *, p_partkey % 10 as quality from fx_cellpx)
    select scene_no, count(*) filter (where det) as n_det, round(coalesce(sum(frac * 100) filter (where det), 0), 5) as area_m2,
      round(count(*) filter (where valid) / count(*) filter (where water), 6) as valid_frac, count(*) filter (where valid and p >= 0.5) as n_raw,
      round(count(*) filter (where water and quality = 3) / count(*) filter (where water), 6) as q_cloud, round(median(b11) filter (where valid), 6) as glint from q group by 1""")
def _(fx):
    px = fx.fx_cellpx.withColumn("quality", C("p_partkey") % 10)
    s = SC.scene_summary(px, ["scene_no"]).select("scene_no", "n_det", "area_m2", "valid_frac", "n_raw", "q_cloud")
    g = RK.exact_quantiles(px.where("valid"), ["scene_no"], "b11", {"glint": 0.5})
    return rnd(s.join(g, "scene_no", "left"), area_m2=5)


@register("agg10_scene_gate", "fx_cellpx", oracle="""
    select * from (select scene_no, count(*) filter (where water) as water_px, count(*) filter (where v) as valid_px,
      round(count(*) filter (where water and p_partkey % 50 = 0) / count(*) filter (where water), 6) as ice_frac,
      round(count(*) filter (where water and glint) / count(*) filter (where water), 6) as glint_frac,
      count(*) filter (where water and glint) / count(*) filter (where water) > 0.3 as glinty from (select *, valid and (scene_no <> 2 or p_partkey % 5 = 0) as v from fx_cellpx) group by 1)
    where valid_px >= 0.3 * water_px""")
def _(fx):
    px = fx.fx_cellpx.withColumns({"valid": C("valid") & ((C("scene_no") != 2) | (C("p_partkey") % 5 == 0)), "ice": C("p_partkey") % 50 == 0})
    return rnd(SC.scene_gate(px, ["scene_no"]))


REASONS = ("static", "ship", "ice", "cloud", "foam", "isolated", "cfar", "small", "kept")


@register("agg11_separation", "fx_cellpx", oracle="""
    with r as (select scene_no, case when p_partkey % 41 = 0 then 'static' when p_partkey % 17 = 0 then 'ship' when p_partkey % 13 = 0 then 'ice' when p_partkey % 11 = 0 then 'cloud'
      when flags & 1 = 0 then 'foam' when flags & 2 = 0 then 'isolated' when flags & 4 = 0 then 'cfar' when frac < 0.3 then 'small' else 'kept' end as r from fx_cellpx where valid and p >= 0.5)
    select scene_no, count(*) as candidates, """ + ", ".join(
        f"count(*) filter (where r = '{r}') as {'kept' if r == 'kept' else 'rejected_' + r}" for r in REASONS) + " from r group by 1")
def _(fx):
    k = C("p_partkey")
    px = fx.fx_cellpx.withColumns({"cand": C("valid") & (C("p") >= 0.5), "static_zone": k % 41 == 0, "near_ship": k % 17 == 0,
                                   "ice_zone": k % 13 == 0, "cloud_zone": k % 11 == 0})
    return SC.separation(px, ["scene_no"], C("frac") >= 0.3)


@register("agg11_model_classes", "fx_cellpx", oracle="select scene_no, " + ", ".join(
    f"count(*) filter (where valid and cls = {i}) as {g}_px" for i, g in ((0, "debris"), (1, "organic"), (2, "ship"), (3, "cloud"), (5, "foam"))) + " from fx_cellpx group by 1")
def _(fx):
    return SC.model_classes(fx.fx_cellpx, ["scene_no"])


@register("agg12_permanent_water", "fx_pixel", oracle="""
    select prow, pcol, count(*) filter (where scl = 6) as water_n, count(*) filter (where scl in (2, 4, 5, 6, 7, 11)) as clear_n,
      count(*) filter (where scl in (2, 4, 5, 6, 7, 11)) >= 1 and count(*) filter (where scl = 6) >= 0.5 * count(*) filter (where scl in (2, 4, 5, 6, 7, 11)) as water from fx_pixel group by 1, 2""")
def _(fx):
    return SC.permanent_water(fx.fx_pixel, ["prow", "pcol"], 5)


@register("agg13_static_objects", "fx_cellpx", oracle="""
    select prow, pcol, count(*) filter (where valid and (p >= 0.5 or cls = 2)) as hits, count(*) filter (where valid) as seen from fx_cellpx group by 1, 2
    having hits >= 3 and hits >= 0.2 * greatest(seen, 1)""")
def _(fx):
    s = SC.static_hits(fx.fx_cellpx, ["prow", "pcol"], (C("p") >= 0.5) | (C("cls") == SC.SHIP), C("valid"))
    return s.where("static").drop("static")


@register("agg14_zone_stats", "fx_cellpx", oracle="""
    select scene_no, cell as label, count(*) as n_pixels, round(count(*) * 1e-4, 6) as area_km2, round(sum(frac * 100), 5) as cover_m2, round(avg(p), 6) as p_mean,
      round(max(p), 6) as p_max, round(avg(prow), 6) as row_mean, round(avg(pcol), 6) as col_mean from fx_cellpx where det group by 1, 2""")
def _(fx):
    det = fx.fx_cellpx.where("det").select("scene_no", C("cell").alias("label"), C("prow").alias("row"), C("pcol").alias("col"), "p", "frac")
    return rnd(SC.zone_table(det, ["scene_no"]), cover_m2=5)


@register("agg15_error_metrics", "fx_pred", oracle="""
    select profile, part, round(avg(abs(y_true - pred_model)), 6) as mae, round(sqrt(avg(pow(y_true - pred_model, 2))), 6) as rmse, round(median(abs(y_true - pred_model)), 6) as medae,
      round(avg(abs(ln(pred_model + 1) - ln(y_true + 1))), 6) as mae_log, round(median(pred_model) / greatest(median(y_true), 1e-9), 6) as bias_median_ratio, count(*) as n from fx_pred group by 1, 2""")
def _(fx):
    return rnd(M.error_metrics(fx.fx_pred, ["profile", "part"], "y_true", "pred_model"))


CONF_SQL = """cf as (select scene_no, split_code, count(*) filter (where pred and cl = 1) as tp, count(*) filter (where pred and cl > 1) as fp, count(*) filter (where not pred and cl = 1) as fn,
      count(*) filter (where pred and cl = 0) as unlabelled_pos, count(*) filter (where cl = 1) as n_debris from fx_label group by 1, 2)"""
PRF_SQL = """round(tp / greatest(tp + fp, 1), 6) as precision, round(tp / greatest(tp + fn, 1), 6) as recall,
      round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12), 6) as f1, round(tp / greatest(tp + fp + fn, 1), 6) as iou"""


@register("agg16_confusion_scores", "fx_label", oracle="with " + CONF_SQL + f"select scene_no, split_code, tp, fp, fn, unlabelled_pos, n_debris, {PRF_SQL} from cf")
def _(fx):
    c = M.confusion(fx.fx_label, ["scene_no", "split_code"], C("pred"), C("cl"))
    return rnd(c.withColumns(M.prf(C("tp"), C("fp"), C("fn"))))


DRAW_SQL = """d0 as (select {keys}rep, slot, n_groups, (rep * 48271 + slot * 69621 + {seed} * 40692 + 12345) % 2147483647 as x from sz, (select unnest(range({boot})) as rep), lateral (select unnest(range(n_groups)) as slot)),
    d1 as (select * replace ((x * 48271 + 11) % 2147483647 as x) from d0), d2 as (select * replace (((x % 65536) * 39373 + x // 65536) % 2147483647 as x) from d1),
    dr as (select {keys}rep, ((x * 69621 + 7) % 2147483647) % n_groups as group_no, count(*) as m from d2 group by all)"""


@register("agg17_group_bootstrap_mae", "fx_pred", oracle="""
    with g0 as (select profile, group_no as g, count(*) as n, sum(abs(y_true - pred_model)) as e1, sum(abs(y_true - pred_base)) as e2 from fx_pred group by 1, 2),
    g as (select *, row_number() over (partition by profile order by g) - 1 as group_no from g0), sz as (select profile, count(*) as n_groups from g group by 1), """
    + DRAW_SQL.format(keys="profile, ", seed=7, boot=2000) + """,
    r as (select profile, rep, sum(m * e1) / sum(m * n) as a, sum(m * e2) / sum(m * n) as b from dr join g using (profile, group_no) group by 1, 2)
    select profile, round(quantile_cont(a, 0.025), 6) as mae_model_lo, round(quantile_cont(a, 0.975), 6) as mae_model_hi, round(quantile_cont(b, 0.025), 6) as mae_base_lo,
      round(quantile_cont(b, 0.975), 6) as mae_base_hi, round(quantile_cont(a - b, 0.025), 6) as delta_lo, round(quantile_cont(a - b, 0.975), 6) as delta_hi,
      round(avg(case when a - b < 0 then 1.0 else 0.0 end), 6) as delta_below0 from r group by 1""")
def _(fx):
    g = fx.fx_pred.groupBy("profile", C("group_no").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(C("y_true") - C("pred_model"))).alias("e1"), F.sum(F.abs(C("y_true") - C("pred_base"))).alias("e2"))
    g = M.number_groups(g, ["profile"], "g")
    a, b = C("e1") / C("n"), C("e2") / C("n")
    return rnd(M.group_bootstrap(g, ["profile"], ["n", "e1", "e2"], {"mae_model": a, "mae_base": b, "delta": a - b}, seed=7))


@register("agg17_scene_bootstrap_f1", "fx_label", oracle="with " + CONF_SQL + """,
    g0 as (select split_code, scene_no, tp, fp, fn from cf), g as (select *, row_number() over (partition by split_code order by scene_no) - 1 as group_no from g0),
    sz as (select split_code, count(*) as n_groups from g group by 1), """ + DRAW_SQL.format(keys="split_code, ", seed=1, boot=2000) + """,
    s as (select split_code, rep, sum(m * tp) as tp, sum(m * fp) as fp, sum(m * fn) as fn from dr join g using (split_code, group_no) group by 1, 2),
    r as (select split_code, 2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-12) as f1 from s)
    select split_code, round(quantile_cont(f1, 0.025), 6) as f1_lo, round(quantile_cont(f1, 0.975), 6) as f1_hi from r group by 1""")
def _(fx):
    g = M.number_groups(M.confusion(fx.fx_label, ["scene_no", "split_code"], C("pred"), C("cl")).select("split_code", "scene_no", "tp", "fp", "fn"), ["split_code"], "scene_no")
    return rnd(M.group_bootstrap(g, ["split_code"], ["tp", "fp", "fn"], {"f1": M.prf(C("tp"), C("fp"), C("fn"))["f1"]}, seed=1))


@register("agg18_best_threshold", "fx_label", oracle="""
    with v as (select split_code, fdi as s, cl = 1 as y from fx_label where cl > 0),
    q as (select split_code, list_distinct(quantile_cont(s, list_transform(range(400), lambda i: 0.5 + i * ((0.9995 - 0.5) / 399)))) as qs, count(*) filter (where y) as np from v group by 1),
    t as (select split_code, np, unnest(qs) as t from q),
    c as (select t.split_code, t.t, t.np, count(*) as pp, count(*) filter (where v.y) as tp from t join v on v.split_code = t.split_code and v.s > t.t group by 1, 2, 3),
    f as (select *, 2 * tp / greatest(pp + np, 1) as f1 from c)
    select split_code, round(t, 6) as threshold, round(f1, 6) as f1 from (select *, row_number() over (partition by split_code order by -f1, t) rn from f) where rn = 1""")
def _(fx):
    px = fx.fx_label.where("cl > 0").withColumn("y", C("cl") == 1)
    return rnd(M.best_threshold(px, ["split_code"], "fdi", "y"))


@register("agg19_window_search", "fx_label", oracle="""
    with v as (select split_code, l_partkey, fdi / 5 as d, ndvi, cl = 1 as y from fx_label where cl > 0),
    g(lo, hi, nmax) as (select * from (select unnest([0.005, 0.01, 0.015, 0.02, 0.03]) as lo), (select unnest([0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 1.0]) as hi), (select unnest([0.0, 0.1, 0.2, 0.3, 1.0]) as nmax)),
    np as (select split_code, count(*) filter (where y) as np from v group by 1),
    c as (select split_code, lo, hi, nmax, count(*) as pp, count(*) filter (where y) as tp from v join g on v.d > g.lo and v.d < g.hi and v.ndvi < g.nmax group by all),
    f as (select c.*, 2 * tp / greatest(pp + np, 1) as f1 from c join np using (split_code))
    select split_code, cast(lo as double) as fdi_lo, cast(hi as double) as fdi_hi, cast(nmax as double) as ndvi_max, round(f1, 6) as f1
    from (select *, row_number() over (partition by split_code order by -f1, lo, hi, nmax) rn from f) where rn = 1""")
def _(fx):
    px = fx.fx_label.where("cl > 0").withColumns({"y": C("cl") == 1, "d_fdi": C("fdi") / 5})
    return rnd(M.window_search(px, ["split_code"], "d_fdi", "ndvi", "y"))


@register("agg21_recall_by_confidence", "fx_label", oracle="select conf, count(*) as debris_px, count(*) filter (where pred) as found from fx_label where cl = 1 and conf between 1 and 3 group by 1")
def _(fx):
    return M.recall_by_confidence(fx.fx_label, "cl", "conf", C("pred"))


@register("agg21_class_fp_rates", "fx_label", oracle="""
    select cl, count(*) as class_px, count(*) filter (where pred_strict) as fp_filters, count(*) filter (where pred) as fp_raw,
      round(count(*) filter (where pred_strict) / count(*), 6) as rate_filters, round(count(*) filter (where pred) / count(*), 6) as rate_raw from fx_label where cl > 1 group by 1""")
def _(fx):
    return rnd(M.class_rates(fx.fx_label, [], "cl", {"filters": C("pred_strict"), "raw": C("pred")}))


@register("agg22_interval_coverage", "fx_pred", oracle="""
    select profile, part, round(avg(case when y_true between pred_model * 0.97 and pred_model * 1.06 then 1.0 else 0.0 end), 6) as cover,
      round(median(ln(pred_model * 1.06 + 1) - ln(pred_model * 0.97 + 1)), 8) as log_width from fx_pred group by 1, 2""")
def _(fx):
    p = fx.fx_pred.withColumns({"lo": C("pred_model") * 0.97, "hi": C("pred_model") * 1.06})
    return rnd(M.coverage(p, ["profile", "part"], "y_true", "lo", "hi"), log_width=8)


@register("agg23_conformal_quantiles", "fx_pred", oracle="""
    with r as (select profile, ln(y_true + 1) - ln(pred_model + 1) as res from fx_pred), o as (select *, row_number() over (partition by profile order by res) - 1 as rk, count(*) over (partition by profile) as n from r)
    select profile, any_value(n) as n, round(max(res) filter (where rk = floor((n - 1) * greatest(0.1 * (n + 1) / n - 1 / n, 0))), 8) as q_lo,
      round(max(res) filter (where rk = ceil((n - 1) * least(0.9 * (n + 1) / n, 1))), 8) as q_hi from o group by 1""")
def _(fx):
    return rnd(M.conformal(fx.fx_pred, ["profile"], "y_true", "pred_model", 0.8), 8)


@register("agg24_poisson_floor", "fx_event", oracle="""
    select source_id, event_type, case when count(*) filter (where n_items is null) = 0 then round(avg(case when n_items = 0 then 0 else
      2 * exp(-n_items + (n_items + 1) * ln(greatest(n_items, 1)) - lgamma(n_items + 1)) end / area_km2), 6) end as floor_mae from fx_event group by 1, 2""")
def _(fx):
    return rnd(M.poisson_floor(fx.fx_event, ["source_id", "event_type"], "n_items", "area_km2"))


@register("agg26_cell_candidates", "fx_zone", oracle="with " + hex_sql("h", "fx_zone", "lon * 111.32 * cos(radians(43.25)) / 40", "lat * 111.32 / 40") + """,
    g as (select aoi_no, concat(q, ':', r) as cell, sum(w) as area_m2, count(*) as n, sum(lon * (w + 1e-6)) / sum(w + 1e-6) as lon, sum(lat * (w + 1e-6)) / sum(w + 1e-6) as lat
      from (select *, p_max * cover_m2 as w from h) group by 1, 2)
    select aoi_no, cell, n, round(area_m2, 6) as area_m2, round(lon, 6) as lon, round(lat, 6) as lat from (
      select *, row_number() over (partition by aoi_no order by area_m2 desc, cell) rn from g) where rn <= 25""")
def _(fx):
    x, y = G.planar_km(C("lon"), C("lat"), LAT0)
    q, r = G.hex_axial(x / 40, y / 40)
    z = fx.fx_zone.withColumns({"w": C("p_max") * C("cover_m2"), "cell": F.concat_ws(":", q.cast("string"), r.cast("string"))})
    return rnd(Q.cell_candidates(z, ["aoi_no"], "cell", "w", 25))


TRACK_CELL = hex_sql("h", "fx_track", "lon * 111.32 * cos(radians(43.25)) / 60", "lat * 111.32 / 60")


def tracks(fx):
    x, y = G.planar_km(C("lon"), C("lat"), LAT0)
    q, r = G.hex_axial(x / 60, y / 60)
    return fx.fx_track.withColumns({"cell": F.concat_ws(":", q.cast("string"), r.cast("string")), "mass": 1 + C("particle") % 7})


@register("agg27_mass_snapshots", "fx_track", oracle="with " + TRACK_CELL + """
    select aoi_no, hour_no, concat(q, ':', r) as cell, cast(sum(1 + particle % 7) as bigint) as mass_m2 from h where hour_no in (24, 48, 50) group by 1, 2, 3""")
def _(fx):
    return DR.mass_snapshots(tracks(fx), ["aoi_no"], "cell", "mass", 50).withColumn("hour_no", C("hour_no").cast("bigint"))


@register("agg28_accumulation", "fx_track", oracle="with " + TRACK_CELL + """,
    g as (select aoi_no, concat(q, ':', r) as cell, count(*) filter (where hour_no = 0) as n0, count(*) filter (where hour_no = 40) as n1 from h group by 1, 2),
    m as (select aoi_no, avg(n0) as m from g where n0 > 0 group by 1) select aoi_no, cell, round(n1 / m, 3) as factor from g join m using (aoi_no) where n1 > 0""")
def _(fx):
    return DR.accumulation(tracks(fx), ["aoi_no"], "cell", C("hour_no") == 0, C("hour_no") == 40)


@register("agg28_beached_fraction", "fx_track", oracle="""
    select aoi_no, round(avg(b), 6) as beached_frac from (select aoi_no, particle, max(case when beached then 1.0 else 0.0 end) as b from fx_track group by 1, 2) group by 1""")
def _(fx):
    return rnd(DR.beached_fraction(fx.fx_track, ["aoi_no"]))


@register("agg29_ensemble_cone", "fx_track", oracle="""
    select aoi_no, cast(hour_no as bigint) as hour_no, round(avg(lon), 9) as lon, round(avg(lat), 9) as lat,
      round(sqrt(var_pop(lon) * pow(cos(radians(43.25)), 2) + var_pop(lat)) * 111.32, 6) as spread_km from fx_track group by 1, 2""")
def _(fx):
    return rnd(DR.ensemble_cone(fx.fx_track, ["aoi_no"], LAT0).withColumn("hour_no", C("hour_no").cast("bigint")), 9, spread_km=6)


@register("agg30_displacement", "fx_track", oracle="""
    with s as (select particle, aoi_no, lon, lat from fx_track where hour_no = 0), e as (select particle, hour_no, lon, lat from fx_track where hour_no in (24, 48)),
    d as (select aoi_no, hour_no, (e.lon - s.lon) * cos(radians(s.lat)) as dx, e.lat - s.lat as dy from s join e using (particle))
    select aoi_no, cast(hour_no as bigint) as hour_no, count(*) as n, round(median(sqrt(dx * dx + dy * dy) * 111.32), 5) as median_km, round(quantile_cont(sqrt(dx * dx + dy * dy) * 111.32, 0.9), 5) as p90_km,
      list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], cast(floor((degrees(atan2(avg(dx), avg(dy))) + 382.5) / 45) % 8 as integer) + 1) as heading from d group by 1, 2""")
def _(fx):
    d = DR.displacement(fx.fx_track, ["aoi_no"], (24, 48))
    return rnd(DR.displacement_summary(d, ["aoi_no"]).withColumn("hour_no", C("hour_no").cast("bigint")), 5)


@register("agg32_source_overview", "fx_event", oracle="with " + PAIR_SQL + """,
    o as (select source_id, user_id, case when bool_or(decision = 'accepted') then 'accepted' when bool_or(decision = 'context') then 'context' else 'rejected' end as outcome from pr group by 1, 2),
    oo as (select source_id, count(*) filter (where outcome = 'accepted') as accepted, count(*) filter (where outcome = 'context') as context, count(*) filter (where outcome = 'rejected') as rejected from o group by 1)
    select source_id, count(*) as n_rows, count(distinct user_id) as n_events, count(*) filter (where record_type = 'transect_density') as n_measurements,
      cast(min(date_utc) as varchar) as date_from, cast(max(date_utc) as varchar) as date_to, round(min(lon), 4) as x0, round(min(lat), 4) as y0, round(max(lon), 4) as x1, round(max(lat), 4) as y1,
      any_value(accepted) as accepted, any_value(context) as context, any_value(rejected) as rejected from fx_event left join oo using (source_id) group by 1""")
def _(fx):
    reg = fx.fx_event.withColumn("event", C("user_id"))
    return Q.source_overview(reg, C("record_type") == "transect_density", pair_rows(fx).withColumn("event", C("user_id"))).withColumns(
        {c: C(c).cast("string") for c in ("date_from", "date_to")})


@register("agg33_report_kpis", "fx_zone", "fx_cellpx", oracle="with " + CUBE_SQL + """,
    h as (select scene_no as aoi_no, count(*) filter (where status = 1) as hexes_detected, count(*) filter (where status = 0) as hexes_clear, count(*) filter (where status = 2) as hexes_unknown from cube3 group by 1)
    select aoi_no, count(*) as n_zones, round(sum(cover_m2), 4) as total_cover_m2, round(median(cover_m2), 6) as median_cover, any_value(hexes_detected) as hexes_detected, any_value(hexes_clear) as hexes_clear, any_value(hexes_unknown) as hexes_unknown
    from fx_zone left join h using (aoi_no) group by 1""")
def _(fx):
    return rnd(Q.report_kpis(fx.fx_zone, cube(fx).withColumnRenamed("scene_no", "aoi_no"), ["aoi_no"]), total_cover_m2=4)


@register("agg34_spearman", "fx_pred", oracle="""
    with r as (select profile, rank() over (partition by profile order by x1) + (count(*) over (partition by profile, x1) - 1) / 2 as a, rank() over (partition by profile order by y_true) + (count(*) over (partition by profile, y_true) - 1) / 2 as b from fx_pred)
    select profile, count(*) as n_pairs, round(corr(a, b), 8) as rho from r group by 1""")
def _(fx):
    return rnd(M.spearman(fx.fx_pred, ["profile"], "x1", "y_true"), 8)


LABELS = ("debris", "foam", "ship", "cloud", "other")


@register("agg35_review_score", "fx_zone", oracle="""
    with l as (select aoi_no, zone_no % 3 <> 0 as is_det, list_extract(['debris', 'foam', 'ship', 'cloud', 'other'], cast(zone_no % 5 as integer) + 1) as lab from fx_zone),
    g as (select aoi_no, count(*) as labelled, count(*) filter (where is_det) as n_det, count(*) filter (where not is_det) as n_ctl, count(*) filter (where is_det and lab = 'debris') as tp,
      count(*) filter (where not is_det and lab = 'debris') as missed, count(*) filter (where is_det and lab = 'foam') as fp_foam, count(*) filter (where is_det and lab = 'ship') as fp_ship,
      count(*) filter (where is_det and lab = 'cloud') as fp_cloud, count(*) filter (where is_det and lab = 'other') as fp_other from l group by 1)
    select *, round(tp / n_det, 6) as precision_local, round((tp / n_det + 1.9208 / n_det - 1.96 * sqrt(tp / n_det * (1 - tp / n_det) / n_det + 0.9604 / (n_det * n_det))) / (1 + 3.8416 / n_det), 6) as precision_lo,
      round((missed / n_ctl + 1.9208 / n_ctl + 1.96 * sqrt(missed / n_ctl * (1 - missed / n_ctl) / n_ctl + 0.9604 / (n_ctl * n_ctl))) / (1 + 3.8416 / n_ctl), 6) as missed_hi from g""")
def _(fx):
    z = fx.fx_zone.withColumns({"is_detection": C("zone_no") % 3 != 0,
                                "label": F.element_at(F.array(*[F.lit(x) for x in LABELS]), (C("zone_no") % 5).cast("int") + 1)})
    s = Q.review_score(z, ["aoi_no"], LABELS[1:])
    return rnd(s.drop("precision_hi", "missed_lo"))


@register("agg36_class_balance", "fx_label", oracle="""
    with h as (select *, (((l_orderkey * 10 + l_linenumber) * 48271 + 11) % 2147483647 * 69621 + 7) % 2147483647 as h, l_orderkey * 10 + l_linenumber as id from fx_label where cl > 0),
    k as (select cl, id from (select *, row_number() over (partition by cl order by h, id) rn from h) where rn <= 1500), n as (select cl, count(*) as n from k group by 1)
    select cl, n, round((select count(*) from k) / (15 * n), 6) as weight, (select cast(sum(id) as bigint) from k where k.cl = n.cl) as id_sum from n""")
def _(fx):
    px = fx.fx_label.where("cl > 0").select("cl", (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"))
    b = M.balance(px, "cl", 1500, "id", 15)
    return b.groupBy("cl").agg(F.count(F.lit(1)).alias("n"), R(F.max("weight"), 6).alias("weight"), F.sum("id").alias("id_sum"))


@register("agg37_dense_endmember", "fx_label", oracle="""
    with d as (select split_code, fdi, ndvi, score from fx_label where cl = 1), t as (select split_code, quantile_cont(fdi, 0.99) as t from d group by 1)
    select split_code, count(*) as n, round(avg(fdi), 6) as fdi, round(avg(ndvi), 6) as ndvi, round(avg(score), 6) as score from d join t using (split_code) where fdi >= t group by 1""")
def _(fx):
    return rnd(Q.dense_endmember(fx.fx_label.where("cl = 1"), ["split_code"], "fdi", ["fdi", "ndvi", "score"]))


@register("agg38_footprint_features", "fx_cellpx", oracle="""
    select scene_no, cell, count(*) as valid_px, count(*) filter (where det) as det_px, round(count(*) filter (where det) / count(*), 6) as det_frac, round(count(*) filter (where det) / (count(*) * 1e-4), 4) as det_per_km2,
      round(quantile_cont(p, 0.95), 6) as p95, round(avg(b11 - 0.0086), 6) as anomaly_mean, round(coalesce(sum(frac * 100) filter (where det), 0) / (count(*) * 1e-4), 4) as cover_m2_km2 from fx_cellpx where valid group by 1, 2""")
def _(fx):
    px = fx.fx_cellpx.where("valid").withColumn("anomaly", C("b11") - 0.0086)
    return rnd(Q.footprint_features(px, ["scene_no", "cell"]), det_per_km2=4, cover_m2_km2=4)


@register("agg39_footprint_quality", "fx_cellpx", oracle="""
    with f as (select *, p_partkey % 29 <> 0 as has, p_partkey % 6 <> 0 as marine from fx_cellpx)
    select scene_no, cell, round(count(*) filter (where has) / count(*), 6) as footprint_coverage, count(*) filter (where has and marine) as marine_px,
      round(count(*) filter (where has and marine and scl = 6) / greatest(count(*) filter (where has and marine), 1), 6) as clear_water_frac,
      round(count(*) filter (where has and marine and scl in (8, 9, 10)) / greatest(count(*) filter (where has and marine), 1), 6) as cloud_frac,
      round(count(*) filter (where not marine) / count(*), 6) as land_frac, round(median(b11) filter (where has and marine and scl = 6), 6) as glint_b11, count(*) filter (where has and marine and scl = 6) as n_valid_px from f group by 1, 2""")
def _(fx):
    px = fx.fx_cellpx.withColumns({"scl": F.when(C("p_partkey") % 29 != 0, C("scl")).otherwise(0), "marine": C("p_partkey") % 6 != 0})
    return rnd(Q.footprint_quality(px, ["scene_no", "cell"]))


@register("agg40_scene_wind_max", "fx_scene", "fx_event", oracle="""
    with w as (select floor(lat * 2) as ky, floor(lon * 2) as kx, day(date_utc) as d, avg(value) / 10 as w from fx_event group by 1, 2, 3),
    l as (select scene_no, floor((lat0 + a * 0.45) * 2) as ky, floor((lon0 + b * 0.5) * 2) as kx, day(date_utc) as d from fx_scene, (select unnest(range(3)) as a), (select unnest(range(3)) as b))
    select scene_no, round(max(w), 1) as wind_max from l join w using (ky, kx, d) group by 1""")
def _(fx):
    wind = fx.fx_event.groupBy(F.floor(C("lat") * 2).alias("ky"), F.floor(C("lon") * 2).alias("kx"), F.dayofmonth("date_utc").alias("d")).agg((F.avg("value") / 10).alias("w"))
    sc = fx.fx_scene.select("scene_no", "lon0", "lat0", (C("lon0") + 1).alias("lon1"), (C("lat0") + 0.9).alias("lat1"), F.dayofmonth("date_utc").alias("d"))
    return Q.scene_wind_max(sc, wind, ["d"], lambda lon, lat: {"ky": F.floor(lat * 2), "kx": F.floor(lon * 2)})


@register("agg41_pooled_fp_share", "fx_label", oracle="""
    select split_code, round(count(*) filter (where pred) / count(*), 6) as fp_share from fx_label where cl in (2, 3, 9, 12) group by 1""")
def _(fx):
    rates = M.class_rates(fx.fx_label, ["split_code"], "cl", {"raw": C("pred")})
    return rnd(Q.pooled_fp_share(rates, ["split_code"], (2, 3, 9, 12)))
