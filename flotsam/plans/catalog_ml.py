"""Registered queries: models, calibration, fusion."""
from __future__ import annotations

from pyspark.sql import functions as F

from flotsam.config import VARIOGRAM_EDGES
from flotsam.operators import fusion as FU
from flotsam.operators import metrics as M
from flotsam.operators import models as ML
from flotsam.operators.ranking import exact_quantiles
from flotsam.plans import joins as J
from flotsam.plans.catalog_agg import cube, rnd
from flotsam.plans.catalog_exp import HAV
from flotsam.plans.catalog_join import Z, ZD, events, zones
from flotsam.plans.registry import register

R = F.round
C = F.col

FOLD = "ev as (select *, user_id % 5 as fold, cast((event_id * 37) % 100 as double) / 10 as wind24_ms, ln(conc + 1) as y from fx_event)"
FEATURES = ["lat", "wind24_ms"]
CANDS = [["lat"], ["wind24_ms"], ["lat", "wind24_ms"]]


def folded(fx):
    return events(fx).withColumns({"fold": (C("user_id") % 5).cast("int"), "wind24_ms": ((C("event_id") * 37) % 100).cast("double") / 10})


@register("ml1_median_baseline", "fx_event", oracle=f"with {FOLD}, h as (select unnest(range(5)) as held) select held, round(median(conc), 6) as median from ev, h where fold <> held group by 1")
def _(fx):
    return rnd(ML.fold_medians(folded(fx), "fold", "conc", 5).withColumn("held", C("held").cast("bigint")))


@register("ml2_idw_baseline", "fx_zone", "fx_event", oracle=f"""
    with {Z}, p as (select z.zone_no, e.event_id, e.conc, greatest({ZD}, 1) as d from z, fx_event e where e.user_id % 5 <> z.aoi_no)
    select zone_no, round(sum(conc / (d * d)) / sum(1 / (d * d)), 5) as idw from (select *, row_number() over (partition by zone_no order by d, event_id) rn from p) where rn <= 8 group by 1""")
def _(fx):
    """Predictions from the folds that do not hold the point."""
    from flotsam.operators.neighbours import nearest
    ev = fx.fx_event.withColumn("fold", C("user_id") % 5)
    hit = nearest(zones(fx), ev, qid="zone_no", rid="event_id", k=8, payload=("conc",), exclude=("aoi_no", "fold"))
    w = 1 / F.pow(F.greatest(C("dist"), F.lit(1.0)), 2)
    return hit.groupBy("zone_no").agg(R(F.sum(w * C("conc")) / F.sum(w), 5).alias("idw"))


SETS = FOLD + """, st as (select o as outr, h as held from (select unnest(range(-1, 5)) as o), (select unnest(range(-1, 5)) as h) where o = -1 or o <> h),
    m as (select outr, held, count(*) as n, avg(lat) as m1, avg(wind24_ms) as m2, stddev_pop(lat) as s1, stddev_pop(wind24_ms) as s2, covar_pop(lat, wind24_ms) as c12, avg(y) as my,
      covar_pop(lat, y) as c1, covar_pop(wind24_ms, y) as c2 from ev, st where fold <> outr and fold <> held group by 1, 2),
    k as (select *, n + 1 as g, n * c12 / (s1 * s2) as r, n * c1 / s1 as b1, n * c2 / s2 as b2 from m),
    cf as (select outr, held, 0 as cand, m1, s1, m2, s2, my, b1 / g as a1, 0 as a2 from k union all select outr, held, 1, m1, s1, m2, s2, my, 0, b2 / g from k
      union all select outr, held, 2, m1, s1, m2, s2, my, (g * b1 - r * b2) / (g * g - r * r), (g * b2 - r * b1) / (g * g - r * r) from k),
    pd as (select cf.outr, cf.held, cf.cand, ev.*, greatest(exp(my + a1 * (lat - m1) / s1 + a2 * (wind24_ms - m2) / s2) - 1, 0) as pred from ev, cf)"""


@register("ml3_standardisation", "fx_event", oracle=f"with {SETS} select held, round(m1, 6) as mu_lat, round(s1, 6) as sd_lat, round(m2, 6) as mu_wind, round(s2, 6) as sd_wind from m where outr = -1")
def _(fx):
    per = ML.sized_moments(folded(fx), ["fold"], FEATURES, ML.log_density())
    c = ML.fit_ridge(ML.held_out_moments(per, "fold", []), ["held"], FEATURES, [FEATURES])
    return c.select(C("held").cast("bigint").alias("held"), R(C("mu")[0], 6).alias("mu_lat"), R(C("sd")[0], 6).alias("sd_lat"), R(C("mu")[1], 6).alias("mu_wind"), R(C("sd")[1], 6).alias("sd_wind"))


@register("ml4_ridge_fits", "fx_event", oracle=f"with {SETS} select held, cast(cand as bigint) as cand, round(my, 7) as b0, round(a1, 7) as b1, round(a2, 7) as b2 from cf where outr = -1")
def _(fx):
    per = ML.sized_moments(folded(fx), ["fold"], FEATURES, ML.log_density())
    c = ML.fit_ridge(ML.held_out_moments(per, "fold", []), ["held"], FEATURES, CANDS)
    return c.select(C("held").cast("bigint").alias("held"), C("cand").cast("bigint").alias("cand"), *[R(C("beta")[i], 7).alias(f"b{i}") for i in range(3)])


@register("ml5_count_regression", "fx_event")
def _(fx):
    """Score equations are checked in the tests."""
    model, mu, sd, alpha = ML.count_regression(folded(fx), FEATURES)
    s = fx.fx_event.agg(F.count("n_items").alias("n"))
    b = [model.intercept, *model.coefficients]
    return s.select("n", R(F.lit(float(alpha)), 4).alias("alpha"), *[R(F.lit(float(x)), 4).alias(f"b{i}") for i, x in enumerate(b)])


@register("ml6_out_of_fold", "fx_event", oracle=f"with {SETS} select event_id, cast(cand as bigint) as cand, round(pred, 5) as pred from pd where outr = -1 and held = fold")
def _(fx):
    p = ML.out_of_fold(folded(fx), "fold", FEATURES, CANDS)
    return p.select("event_id", C("cand").cast("bigint").alias("cand"), R("pred", 5).alias("pred"))


@register("ml7_feature_selection", "fx_event", oracle=f"with {SETS} select cast(cand as bigint) as cand, round(avg(abs(conc - pred)), 6) as cv_mae from pd where outr = -1 and held = fold group by 1")
def _(fx):
    return rnd(ML.candidate_errors(folded(fx), "fold", FEATURES, CANDS).withColumn("cand", C("cand").cast("bigint")))


@register("ml7_nested_predictions", "fx_event", oracle=f"with {SETS}," + """
    er as (select outr, cand, avg(abs(conc - pred)) as e from pd where outr >= 0 and held = fold and fold <> outr group by 1, 2),
    ch as (select outr, cand from (select *, row_number() over (partition by outr order by e, cand) rn from er) where rn = 1)
    select event_id, cast(pd.cand as bigint) as cand, round(pred, 5) as pred from pd join ch on ch.outr = pd.outr and ch.cand = pd.cand where pd.held = -1 and fold = pd.outr""")
def _(fx):
    p = ML.nested_predictions(folded(fx), "fold", 5, FEATURES, CANDS)
    return p.select("event_id", C("cand").cast("bigint").alias("cand"), R("pred", 5).alias("pred"))


@register("ml8_serve_choice", "fx_pred", oracle="""
    with m as (select concat('m', fold) as model, avg(abs(y_true - pred_model)) as mae from fx_pred group by 1), x as (select *, (select mae from m where model = 'm0') - mae - 0.001 as delta_lo from m)
    select coalesce((select model from x where delta_lo > 0 and model <> 'm0' order by mae, model limit 1), 'm0') as serve""")
def _(fx):
    m = fx.fx_pred.groupBy(F.concat(F.lit("m"), C("fold").cast("string")).alias("model")).agg(F.avg(F.abs(C("y_true") - C("pred_model"))).alias("mae"))
    main = m.where("model = 'm0'").agg(F.max("mae")).scalar()
    return ML.serve_choice(m.withColumn("delta_lo", main - C("mae") - 0.001), "m0")


@register("ml9_interval_application", "fx_pred", oracle="""
    select l_orderkey, l_linenumber, round(greatest((pred_model + 1) * exp(-0.7) - 1, 0), 6) as lo80, round((pred_model + 1) * exp(0.55) - 1, 6) as hi80, round(pred_model, 9) as pred from fx_pred""")
def _(fx):
    lo, hi = M.apply_interval(C("pred_model"), F.lit(-0.7), F.lit(0.55))
    return fx.fx_pred.select("l_orderkey", C("l_linenumber"), R(lo, 6).alias("lo80"), R(hi, 6).alias("hi80"), R("pred_model", 9).alias("pred"))


MODEL_B = ML.DensityModel("B", "loglinear", ("lat", "wind24_ms"), (43.2, 4.9), (1.6, 2.9), (5.1, 0.21, -0.13), (-0.9, 0.8), (-1.6, 1.5), ("black_sea",), (1, 2, 6), {"wind24_ms": (1.0, 8.0), "lat": (41.0, 45.0)}, "conc-B-1")
MODEL_A = ML.DensityModel("A", "count", ("wind24_ms",), (4.9,), (2.9,), (4.2, 0.3), (-0.8, 0.7), (-1.4, 1.3), ("nw_atlantic_subtropical",), (4, 5), {}, "conc-A-1")
MODEL_SQL = """exp(5.1 + 0.21 * (lat - 43.2) / 1.6 + -0.13 * (wind24_ms - 4.9) / 2.9)"""

SCORE_SQL = f"""pt as (select zone_no, lon * 1.1 - 2.5 as lon, lat + 0.4 as lat, date_utc, aoi_no, cast((zone_no * 37) % 100 as double) / 10 as wind24_ms, 1 + zone_no % 3 as month_no from fx_zone),
    ib as (select *, lon between 27 and 42 and lat between 40.5 and 46 as inb from pt), tr as (select lon as tl, lat as tb from fx_event where role = 'train' and user_id % 3 = 0),
    nr as (select zone_no, min({HAV.format(a1='lon', b1='lat', a2='tl', b2='tb')}) as d from ib, tr where inb group by 1),
    sc as (select ib.*, d, case when inb then greatest({MODEL_SQL} - 1, 0) end as value, d > 5 as far, month_no not in (1, 2, 6) as mon, wind24_ms not between 1 - 0.7 and 8 + 0.7 as rng from ib left join nr using (zone_no))"""


def score_input(fx):
    z = fx.fx_zone.select("zone_no", (C("lon") * 1.1 - 2.5).alias("lon"), (C("lat") + 0.4).alias("lat"), "aoi_no", (((C("zone_no") * 37) % 100).cast("double") / 10).alias("wind24_ms"), (1 + C("zone_no") % 3).alias("month_no"))
    return z, fx.fx_event.where("role = 'train' and user_id % 3 = 0")


@register("ml10_score_points", "fx_zone", "fx_event", oracle=f"with {SCORE_SQL}" + """
    select zone_no, round(value, 5) as value, case when inb then round(greatest((value + 1) * exp(-0.9) - 1, 0), 5) end as lo80, round((value + 1) * exp(0.8) - 1, 5) as hi80, round(d, 5) as nearest_field_km,
      case when not inb then 'unavailable' when far or mon or rng then 'research_estimate' else 'model_estimate' end as status,
      case when not inb then 'outside the basins of the profile' else concat_ws('; ', case when far then 'far from field data' end, case when mon then 'month outside training' end, case when rng then 'wind24_ms outside training range' end) end as reasons from sc""")
def _(fx):
    from flotsam.config import Applicability
    z, t = score_input(fx)
    s = ML.score_points(z, MODEL_B, t, "zone_no", "event_id", Applicability(validated_radius_km=5.0))
    return rnd(s.select("zone_no", "value", "lo80", "hi80", "nearest_field_km", "status", "reasons"), 5)


SCORED_SQL = f"""cb as (select distinct scene_no, cell from fx_cellpx where water), pt as (select *, 39.55 + cast(split_part(cell, ':', 2) as double) * 0.2 as lon, 43.62 - cast(split_part(cell, ':', 1) as double) * 0.05 as lat, cast(scene_no as double) * 2 as wind24_ms, 1 + scene_no % 3 as month_no from cb),
    nr as (select scene_no, cell, min({HAV.format(a1='pt.lon', b1='pt.lat', a2='e.lon', b2='e.lat')}) as d from pt, fx_event e where e.profile = 'B' and pt.lon between 27 and 42 and pt.lat between 40.5 and 46 group by 1, 2),
    scored as (select scene_no, cell, 'B' as profile, round(case when d is not null then greatest({MODEL_SQL} - 1, 0) end, 5) as value, case when d is null then 'unavailable' when d > 60 or month_no not in (1, 2, 6) or wind24_ms not between 0.3 and 8.7 then 'research_estimate' else 'model_estimate' end as status from pt left join nr using (scene_no, cell)
    union all select scene_no, cell, 'A', null, 'unavailable' from pt)"""


@register("ml11_score_cube", "fx_cellpx", "fx_event", oracle=f"with {SCORED_SQL} select * from scored")
def _(fx):
    return score_cube(fx).select("scene_no", "cell", "profile", R("value", 5).alias("value"), "status")


def score_cube(fx):
    p = cube(fx).select("scene_no", "cell", F.concat_ws("/", "scene_no", "cell").alias("pid"), (39.55 + F.split("cell", ":")[1].cast("double") * 0.2).alias("lon"),
                        (43.62 - F.split("cell", ":")[0].cast("double") * 0.05).alias("lat"), (C("scene_no").cast("double") * 2).alias("wind24_ms"), (1 + C("scene_no") % 3).alias("month_no"))
    t = fx.fx_event.where("profile = 'B'")
    return ML.score_points(p, MODEL_B, t, "pid", "event_id").unionByName(ML.score_points(p, MODEL_A, t, "pid", "event_id"))


@register("ml11_profile_availability", "fx_cellpx", oracle="select scene_no, p as profile, p = 'B' as available from (select distinct scene_no from fx_cellpx where water), (select unnest(['A', 'B']) as p)")
def _(fx):
    return ML.availability(score_cube(fx), ["scene_no"])


@register("ml12_transfer_check", "fx_event", oracle=f"with {FOLD}," + """ m as (select *, 120 + 4 * wind24_ms as pred from ev where role = 'transfer_check')
    select profile, count(*) as n, round(avg(abs(conc - pred)), 6) as mae, round(sqrt(avg(pow(conc - pred, 2))), 6) as rmse, round(median(abs(conc - pred)), 6) as medae, round(avg(abs(ln(pred + 1) - y)), 6) as mae_log,
      round(median(pred) / greatest(median(conc), 1e-9), 6) as bias_median_ratio, round(any_value(t.med), 6) as median_train, round(median(conc), 6) as median_check
    from m join (select profile, median(conc) as med from fx_event where role = 'train' group by 1) t using (profile) group by 1""")
def _(fx):
    ev = folded(fx)
    chk = ev.where("role = 'transfer_check'").withColumn("pred", 120 + 4 * C("wind24_ms"))
    a = exact_quantiles(ev.where("role = 'train'"), ["profile"], "conc", {"median_train": 0.5})
    b = exact_quantiles(chk, ["profile"], "conc", {"median_check": 0.5})
    return rnd(M.error_metrics(chk, ["profile"], "conc", "pred").join(a, "profile").join(b, "profile"))


def labelled(fx):
    from flotsam.config import LABEL_TO_GROUP
    m = F.create_map(*[F.lit(int(x)) for kv in LABEL_TO_GROUP.items() for x in kv])
    px = fx.fx_label.where("cl > 0").withColumns({"grp": m[C("cl").cast("int")], "id": C("l_orderkey") * 10 + C("l_linenumber")})
    # the label shows in the index, so that there is something to learn
    return px.withColumns({"fdi": C("fdi") / 5 + C("grp") * 0.05, "ndvi": C("ndvi") - C("grp") * 0.1})


FOREST = ["fdi", "ndvi", "score"]        # the pixel columns that the label table has
PER_CLASS = 2000        # labelled rows of a class that the forest is fitted on, at most


def forest_test(fx):
    """The operator's forest (30 trees of depth 8) fitted on two thirds of the splits, applied to the third."""
    px = labelled(fx)
    model, va = ML.train_forest(M.balance(px.where("split_code <> 'A'"), "grp", PER_CLASS, "id", 6), FOREST, "grp", "weight")
    return model, model.transform(va.transform(px.where("split_code = 'A'"))).withColumn("prd", C("prediction").cast("int"))


@register("ml13_forest_report", "fx_label")
def _(fx):
    return rnd(ML.class_report(forest_test(fx)[1], [], "grp", "prd"), 4)


@register("ml13_forest_confusion", "fx_label")
def _(fx):
    """Test pixels by true and predicted group."""
    return forest_test(fx)[1].groupBy("grp", "prd").agg(F.count(F.lit(1)).alias("n"))


@register("ml13_forest_debris_ap", "fx_label")
def _(fx):
    """Average precision of the forest's own debris probability, and the importance of every column."""
    from pyspark.ml.functions import vector_to_array
    model, te = forest_test(fx)
    ap = ML.average_precision(te.withColumns({"all": F.lit(1), "p": vector_to_array("probability")[0], "y": C("grp") == 0}), ["all"], "p", "y")
    return ap.select(R("ap", 4).alias("debris_ap"), *[F.lit(round(float(v), 4)).alias(f"importance_{n}") for n, v in zip(FOREST, model.featureImportances.toArray())])


@register("ml13_average_precision", "fx_label", oracle="""
    with c as (select split_code, l_partkey, fdi as s, cl = 1 as y from fx_label where cl > 0), g as (select split_code, s, count(*) as n, count(*) filter (where y) as y from c group by 1, 2),
    r as (select *, sum(n) over w as cn, sum(y) over w as cy from g window w as (partition by split_code order by s desc)) select split_code, round(sum(y * cy / cn) / sum(y), 6) as ap from r group by 1""")
def _(fx):
    return rnd(ML.average_precision(fx.fx_label.where("cl > 0").withColumn("y", C("cl") == 1), ["split_code"], "fdi", "y"))


@register("ml14_batch_scoring", "fx_label")
def _(fx):
    px = labelled(fx)
    model, va = ML.train_forest(M.balance(px, "grp", PER_CLASS, "id", 6), FOREST, "grp", "weight")
    s = ML.score_pixels(px.select("scene_no", "id", "conf", "fdi", "ndvi", "score"), model, va, (C("conf") > 0) & (C("fdi") > 0.1), C("conf") > 0)
    return s.groupBy("scene_no", "grp").agg(F.count(F.lit(1)).alias("n"), R(F.sum("p"), 4).alias("p_sum"))


def bayes_sql() -> str:
    from flotsam.config import LABEL_TO_GROUP
    return "with mp(cl, grp) as (values " + ", ".join(f"({a}, {b})" for a, b in LABEL_TO_GROUP.items()) + """),
    px as (select l.split_code, row_number() over () as id, grp, fdi / 5 + grp * 0.05 as f, ndvi - grp * 0.1 as v from fx_label l join mp on mp.cl = l.cl where l.cl > 0),
    st as (select grp, count(*) as n, avg(f) as mf, greatest(var_pop(f), 1e-300) as vf, avg(v) as mv, greatest(var_pop(v), 1e-300) as vv from px where split_code <> 'A' group by grp),
    lg as (select p.id, p.grp, s.grp as c, ln(s.n) - (ln(vf) + ln(vv)) / 2 - pow(f - mf, 2) / (2 * vf) - pow(v - mv, 2) / (2 * vv) as l from px p, st s where p.split_code = 'A'),
    pb as (select *, exp(l - max(l) over (partition by id)) as e from lg),
    pr as (select id, grp, arg_max(c, l) as prd, sum(e) filter (where c = 0) / sum(e) as p0 from pb group by id, grp)"""


def bayes_scored(fx):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    px = labelled(fx)
    va = VectorAssembler(inputCols=["fdi", "ndvi"], outputCol="features")
    m = NaiveBayes(modelType="gaussian", labelCol="grp", smoothing=0.0).fit(va.transform(px.where("split_code <> 'A'")))
    te = m.transform(va.transform(px.where("split_code = 'A'")))
    return te.withColumns({"prd": C("prediction").cast("int"), "p_debris": vector_to_array("probability")[0]})


@register("ml15_naive_bayes", "fx_label", oracle=bayes_sql() + """,
    g as (select c as cls, (select count(*) from pr where grp = c and prd = c) as tp, (select count(*) from pr where prd = c) as predicted, (select count(*) from pr where grp = c) as support
      from (select grp as c from pr union select prd from pr)),
    q as (select *, coalesce(tp / nullif(predicted, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r from g)
    select cast(cls as integer) as cls, tp, predicted, support, round(p, 4) as precision, round(r, 4) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) as f1 from q""")
def _(fx):
    return rnd(ML.class_report(bayes_scored(fx), [], "grp", "prd"), 4)


@register("ml15_debris_score", "fx_label", oracle=bayes_sql() + """,
    t as (select unnest([0.1, 0.3, 0.5, 0.7, 0.9]) as threshold)
    select cast(threshold as double) as threshold, count(*) filter (where p0 >= threshold and grp = 0) as tp, count(*) filter (where p0 >= threshold and grp <> 0) as fp,
      count(*) filter (where p0 < threshold and grp = 0) as fn from pr, t group by threshold""")
def _(fx):
    """Debris against the rest by the model's own probability, at five thresholds."""
    s = bayes_scored(fx).select((C("grp") == 0).alias("y"), "p_debris").withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)])))
    hit = C("p_debris") >= C("threshold")
    return s.groupBy("threshold").agg(F.count_if(hit & C("y")).alias("tp"), F.count_if(hit & ~C("y")).alias("fp"), F.count_if(~hit & C("y")).alias("fn"))


@register("ml16_leave_region_out", "fx_label")
def _(fx):
    from flotsam.config import TILE_REGIONS
    from flotsam.functions.status import tile_region
    tiles = F.array(*[F.lit(t) for t in ("16PCC", "18QYF", "30VWH", "36JUN", "48MYU", "51RVQ")])
    px = labelled(fx).withColumn("region", tile_region(F.element_at(tiles, (C("scene_no") % 6).cast("int") + 1), TILE_REGIONS))
    te = ML.leave_group_out(px, FOREST, "grp", "cl", "region", list(TILE_REGIONS), 6)
    out = M.confusion(te, ["region"], C("prediction") == 0, C("cl"), "n")
    return rnd(out.withColumns(M.prf(C("tp"), C("fp"), C("fn"))), 4)


@register("ml19_evidence_store", "fx_event", oracle="""
    select event_id, round(ln(conc + 1) - ln(200 + 1), 7) as resid, round(greatest(n_items, 1) / pow(greatest(n_items, 1) + area_km2, 2) * case when n_items is null then null else 1 end, 8) as meas_var, length_km / 2 as footprint_km
    from fx_event where lon between 27 and 42 and lat between 40.5 and 46""")
def _(fx):
    from flotsam.functions.geo import in_basins
    s = FU.evidence_store(fx.fx_event.where(in_basins(C("lon"), C("lat"), ("black_sea",))), F.lit(200.0))
    return s.select("event_id", R("resid", 7).alias("resid"), R("meas_var", 8).alias("meas_var"), "footprint_km")


def store(fx):
    return FU.evidence_store(fx.fx_event.withColumn("t_day", C("t_start_s") / 86400), F.lit(200.0))


VARIO = """st as materialized (select *, ln(conc + 1) - ln(201) as resid, t_start_s / 86400 as t_day from fx_event),
    cl as materialized (select floor(lon / 0.02) as cx, floor(lat / 0.02) as cy, floor(t_day / 0.25) as ct, count(*) as n, sum(resid) as sr, sum(resid * resid) as sr2, avg(lon) as lon, avg(lat) as lat, avg(t_day) as t_day, var_pop(lon) as vx, var_pop(lat) as vy, var_pop(t_day) as vt from st group by 1, 2, 3),
    pr as (select a.n * b.n as np, 0.5 * (b.n * a.sr2 + a.n * b.sr2 - 2 * a.sr * b.sr) as half, sqrt(pow(""" + HAV.format(a1="a.lon", b1="a.lat", a2="b.lon", b2="b.lat") + """, 2) + pow(40 * (a.t_day - b.t_day), 2)) as h
      from cl a join cl b on (a.cx, a.cy, a.ct) < (b.cx, b.cy, b.ct)
      union all select n * (n - 1) / 2, 0.5 * (n * sr2 - sr * sr), sqrt(2.0 * n / (n - 1) * (pow(111.19 * cos(radians(lat)), 2) * vx + 111.19 * 111.19 * vy + 1600 * vt)) from cl where n > 1),
    ed as (select unnest([""" + ", ".join(f"{float(e)!r}" for e in VARIOGRAM_EDGES[:-1]) + """]) as h_lo, unnest([""" + ", ".join(f"{float(e)!r}" for e in VARIOGRAM_EDGES[1:]) + """]) as h_hi),
    bn as materialized (select h_lo, h_hi, sum(h * np) / sum(np) as h_mean, sum(half) / sum(np) as gamma, cast(sum(np) as bigint) as n_pairs from pr join ed on h >= h_lo and h < h_hi group by 1, 2 having sum(np) >= 3)"""


def bins(s):
    return FU.variogram(s, 40.0, VARIOGRAM_EDGES, deg=0.02, days=0.25, spread=0.5)


@register("agg25_variogram", "fx_event", oracle=f"with {VARIO} select cast(h_lo as double) as h_lo, cast(h_hi as double) as h_hi, round(h_mean / h_hi, 2) as h_share, round(gamma, 7) as gamma, n_pairs from bn")
def _(fx):
    """The mean lag of a bin is known to second order and shown as a share of the bin's end."""
    return bins(store(fx)).select("h_lo", "h_hi", R(C("h_mean") / C("h_hi"), 2).alias("h_share"), R("gamma", 7).alias("gamma"), "n_pairs")


@register("ml18_variogram_fit", "fx_event", oracle=f"with {VARIO}, tt as (select var_samp(resid) as total, avg(case when n_items is not null then greatest(n_items, 1) / pow(greatest(n_items, 1) + area_km2, 2) end) as flo from st)," + """
    g as (select 0.05 + i * 0.05 as share, 5 * pow(100.0, j / 24.0) as rng from (select unnest(range(19)) as i), (select unnest(range(25)) as j)),
    f as (select share, rng, greatest(total * share, flo) as nugget, total - greatest(total * share, flo) as psill from g, tt), s as (select share, rng, nugget, psill, sum(n_pairs * pow(gamma - (nugget + psill * (1 - exp(-h_mean / rng))), 2)) as sse from f, bn where psill > 0 group by 1, 2, 3, 4)
    select round(nugget, 6) as nugget, round(psill, 6) as psill, round(rng, 5) as range_km from s order by sse, share, rng limit 1""")
def _(fx):
    s = store(fx)
    fit = FU.fit_variogram(bins(s), s.agg(F.var_samp("resid")).scalar(), s.agg(F.avg("meas_var")).scalar())
    return fit.select(R("nugget", 6).alias("nugget"), R("psill", 6).alias("psill"), R("range_km", 5).alias("range_km"))


PARAMS = dict(psill=0.6, nugget=0.5, micro=0.35, range_km=15.0, v_km_day=20.0, q80=(-0.9, 0.8), q95=(-1.6, 1.5))


@register("ml17_fusion", "fx_zone", "fx_event")
def _(fx):
    """Weights are checked against a plain solve in the tests."""
    z = zones(fx).withColumns({"t_day": C("t_s") / 86400, "model_value": 150 + C("p_max") * 100})
    f = FU.fuse(z, store(fx), qid="zone_no", value="model_value", evidence=False, **PARAMS)
    return rnd(f.select("zone_no", "fused", "lo80", "hi80", "field_weight", "variance_reduction", "n_evidence"), 3)


@register("ml17_contributions", "fx_zone", "fx_event")
def _(fx):
    """Measurements that weigh 0.5 % or more in a zone's estimate; weights are checked against a plain solve in the tests."""
    z = zones(fx).withColumns({"t_day": C("t_s") / 86400, "model_value": 150 + C("p_max") * 100})
    model = {k: v for k, v in PARAMS.items() if k not in ("q80", "q95")}
    return rnd(FU.contributions_of(z, store(fx), qid="zone_no", value="model_value", **model), 4)


@register("ml20_fusion_check", "fx_event")
def _(fx):
    """Held-out events fused with all other measurements, and without those of their own group."""
    s = store(fx)
    hold = s.where("role = 'transfer_check'").withColumn("model_value", F.lit(200.0))
    out = None
    for name, ex in (("nearby", ("event_id", "event_id")), ("isolated", ("user_id", "user_id"))):
        f = FU.fuse(hold, s, qid="event_id", value="model_value", exclude=ex, evidence=False, **PARAMS)
        f = f.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(C("conc") - C("fused"))).alias("mae"), F.avg(C("conc").between(C("lo80"), C("hi80")).cast("double")).alias("cover80"),
                                     F.avg("field_weight").alias("mean_field_weight")).withColumn("scenario", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return rnd(out, 4)


@register("ml21_covariates", "fx_event", "fx_wind", oracle=f"""
    with land as (select 20 + (c_custkey * 37) % 300 / 10 as lx, 30 + (c_custkey * 53) % 90 / 10 as ly from customer), dc as (select event_id, least(300, min({HAV.format(a1='lon', b1='lat', a2='lx', b2='ly')})) as d from fx_event, land group by 1),
    p as (select event_id, user_id % 16 as cell_no, cast(floor(t_start_s / 3600) as bigint) as h from fx_event), w as (select event_id, avg(wind_ms) as w from p left join fx_wind f on f.cell_no = p.cell_no and f.hour_no between p.h - 23 and p.h group by 1)
    select event_id, round(ln(1 + d), 7) as log_dist_coast_km, round(w, 9) as wind24_ms from dc join w using (event_id)""")
def _(fx):
    k = C("c_custkey")
    land = fx.customer.select(k.alias("cell_no"), (20 + (k * 37) % 300 / 10).alias("lon"), (30 + (k * 53) % 90 / 10).alias("lat"))
    d = J.coast_distance(fx.fx_event, land, "event_id", "cell_no")
    w = J.trailing_mean(fx.fx_wind, ["cell_no"], "hour_no", "wind_ms", "wind24_ms")
    p = fx.fx_event.select("event_id", (C("user_id") % 16).alias("cell_no"), F.floor(C("t_start_s") / 3600).cast("bigint").alias("hour_no"))
    return p.join(w, ["cell_no", "hour_no"], "left").join(d, "event_id").select("event_id", R(F.log1p("coast_km"), 7).alias("log_dist_coast_km"), R("wind24_ms", 9).alias("wind24_ms"))


@register("ml22_metric_recheck", "fx_pred", oracle="""
    with n as (select profile, part, avg(abs(y_true - pred_model)) as mae, sqrt(avg(pow(y_true - pred_model, 2))) as rmse from fx_pred group by 1, 2)
    select profile, part, 'mae' as metric, round(mae, 6) as now, round(mae + 1, 6) as saved from n where profile = 'A' union all select profile, part, 'rmse', round(rmse, 6), round(rmse - 0.2, 6) from n where part = 'cv'""")
def _(fx):
    """Recomputed metrics against a saved table that was altered in known places."""
    from flotsam.plans.queries import metric_mismatches
    now = M.error_metrics(fx.fx_pred, ["profile", "part"], "y_true", "pred_model")
    saved = now.withColumns({"mae": C("mae") + F.when(C("profile") == "A", 1.0).otherwise(0.0), "rmse": C("rmse") - F.when(C("part") == "cv", 0.2).otherwise(0.0)})
    return rnd(metric_mismatches(now, saved, ["profile", "part"], {"mae": 0.05, "rmse": 0.05, "medae": 0.05, "mae_log": 1e-3}))


@register("ml23_strip_average", "fx_event", oracle=f"with {FOLD}," + """
    p as (select event_id, s, lat + length_km / 200 * s / 40 as lat, wind24_ms from ev, (select unnest(range(41)) as s)), v as (select event_id, avg(greatest(""" + MODEL_SQL + """ - 1, 0)) as strip_mean, max(case when s = 20 then greatest(""" + MODEL_SQL + """ - 1, 0) end) as mid from p group by 1)
    select event_id, round(strip_mean, 6) as strip_mean, round(mid, 6) as mid, abs(strip_mean / mid - 1) < 0.001 as same from v""")
def _(fx):
    ln = folded(fx).select("event_id", "wind24_ms", C("lon").alias("ax"), C("lat").alias("ay"), (C("lon") + C("length_km") / 100).alias("bx"), (C("lat") + C("length_km") / 200).alias("by"))
    p = ML.line_points(ln).withColumn("v", MODEL_B.value())
    g = p.groupBy("event_id").agg(F.avg("v").alias("strip_mean"), F.max(F.when(C("step_no") == 20, C("v"))).alias("mid"))
    return rnd(g.withColumn("same", F.abs(C("strip_mean") / C("mid") - 1) < 0.001))


@register("exp33_calculation_steps", "fx_zone", oracle="""
    with z as (select zone_no, lat, cast((zone_no * 37) % 100 as double) / 10 as w from fx_zone), e as (select *, 5.1 + 0.21 * (lat - 43.2) / 1.6 + -0.13 * (w - 4.9) / 2.9 as eta from z)
    select zone_no, 'z lat' as label, round((lat - 43.2) / 1.6, 9) as value from e union all select zone_no, 'z wind24_ms', round((w - 4.9) / 2.9, 9) from e union all select zone_no, 'linear predictor', round(eta, 9) from e
    union all select zone_no, 'estimate', round(greatest(exp(eta) - 1, 0), 9) from e union all select zone_no, 'lo80', round(greatest((greatest(exp(eta) - 1, 0) + 1) * exp(-0.9) - 1, 0), 9) from e
    union all select zone_no, 'hi80', round((greatest(exp(eta) - 1, 0) + 1) * exp(0.8) - 1, 9) from e""")
def _(fx):
    z = fx.fx_zone.select("zone_no", "lat", (((C("zone_no") * 37) % 100).cast("double") / 10).alias("wind24_ms"))
    return z.select("zone_no", F.explode(ML.calculation_steps(MODEL_B)).alias("s")).select("zone_no", "s.label", R("s.value", 9).alias("value"))


