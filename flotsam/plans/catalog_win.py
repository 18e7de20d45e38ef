"""Registered queries: spatial windows, morphology, zones and flow fields."""
from __future__ import annotations

from pyspark.sql import functions as F

from flotsam.config import WATER_REF
from flotsam.operators import drift as DR
from flotsam.operators import features as FT
from flotsam.operators import models as ML
from flotsam.operators import raster as RA
from flotsam.plans import joins as J
from flotsam.plans import scene as SC
from flotsam.plans.catalog_exp import HAV
from flotsam.plans.catalog_ml import MODEL_A, MODEL_B
from flotsam.plans.registry import register
from flotsam.session import materialise

R = F.round
C = F.col
KEYS = ["scene_no"]


def pixels(fx, *cols):
    px = fx.fx_pixel.select("scene_no", C("prow").alias("row"), C("pcol").alias("col"), "p_partkey", *cols)
    return RA.with_size(px, KEYS)


SIZE = """sz as (select scene_no, max(prow) + 1 as h, max(pcol) + 1 as w from fx_pixel group by 1),
    px as (select * from fx_pixel join sz using (scene_no))"""


def box_sql(name, cols, r, src="px"):
    """Clamped box sums: every pixel looks up its (2r+1)² neighbours."""
    aggs = ", ".join(f"sum(n.{c}) as {o}" for o, c in cols.items())
    return f"""{name} as (select a.scene_no, a.prow, a.pcol, {aggs} from (select scene_no, prow, pcol, h, w, unnest(range(-{r}, {r + 1})) as dy from {src}) a,
      lateral (select unnest(range(-{r}, {r + 1})) as dx) x join {src} n on n.scene_no = a.scene_no and n.prow = greatest(0, least(a.h - 1, a.prow + dy)) and n.pcol = greatest(0, least(a.w - 1, a.pcol + dx)) group by 1, 2, 3)"""


def box_sql2(name, cols, r, src):
    """The same sums in two passes, for wide boxes."""
    def one(n, axis, size, frm, pick):
        other = "pcol" if axis == "prow" else "prow"
        aggs = ", ".join(f"sum(n.{c}) as {o}" for o, c in pick.items())
        return f"""{n} as (select a.scene_no, a.prow, a.pcol, any_value(a.h) as h, any_value(a.w) as w, {aggs} from (select scene_no, prow, pcol, h, w, unnest(range(-{r}, {r + 1})) as dx from {frm}) a
          join {frm} n on n.scene_no = a.scene_no and n.{other} = a.{other} and n.{axis} = greatest(0, least(a.{size} - 1, a.{axis} + dx)) group by 1, 2, 3)"""
    return one(name + "_c", "pcol", "w", src, cols) + ", " + one(name, "prow", "h", name + "_c", {o: o for o in cols})


@register("win1_box_mean", "fx_pixel", oracle=f"with {SIZE}, {box_sql('b5', {'s': 'b08'}, 2)}, {box_sql('b3', {'s': 'frac'}, 1)}" + """
    select scene_no, prow, pcol, round(b5.s / 25, 8) as b08_mean5, round(b3.s / 9, 8) as frac_mean3 from b5 join b3 using (scene_no, prow, pcol)""")
def _(fx):
    px = RA.box_mean(pixels(fx, "b08", "frac"), KEYS, {"b08_mean5": "b08"}, 5)
    px = RA.box_mean(px, KEYS, {"frac_mean3": "frac"}, 3)
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), R("b08_mean5", 8).alias("b08_mean5"), R("frac_mean3", 8).alias("frac_mean3"))


@register("win2_neighbour_count", "fx_pixel", oracle=f"with {SIZE}, px2 as (select *, case when p > 0.3 then 1 else 0 end as on_ from px), {box_sql('b', {'n': 'on_'}, 1, 'px2')} select scene_no, prow, pcol, cast(n as bigint) as n from b")
def _(fx):
    px = RA.box_sum(pixels(fx, "p").withColumn("on", (C("p") > 0.3).cast("bigint")), KEYS, {"n": "on"}, 1)
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), "n")


@register("win3_local_std_high_pass", "fx_pixel", oracle=f"with {SIZE}, px2 as (select *, b08 * b08 as sq from px), {box_sql('b', {'m': 'b08', 'm2': 'sq'}, 2, 'px2')}" + """
    select scene_no, prow, pcol, round(sqrt(greatest(m2 / 25 - (m / 25) * (m / 25), 0)), 6) as std5, round(b08 - m / 25, 8) as hp5 from b join px using (scene_no, prow, pcol)""")
def _(fx):
    px = RA.high_pass(RA.local_std(pixels(fx, "b08"), KEYS, "b08", "std5"), KEYS, "b08", "hp5")
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), R("std5", 6).alias("std5"), R("hp5", 8).alias("hp5"))


@register("win4_noise_flags", "fx_pixel", oracle=f"with {SIZE}, px2 as (select *, case when p > 0.3 then 1 else 0 end as on_ from px), {box_sql('b', {'m': 'b08'}, 2)}, {box_sql('nb', {'n': 'on_'}, 1, 'px2')}" + """,
    hp as (select px.*, pow(px.b08 - b.m / 25, 2) as hp2 from px join b using (scene_no, prow, pcol)), """ + box_sql2("ns", {"s": "hp2"}, 25, "hp") + """
    select scene_no, prow, pcol, round(sqrt(s / 2601), 8) as noise, cast(case when b08 - 0.0121 > b02 - 0.0342 then 1 else 0 end + case when n >= 2 then 2 else 0 end
      + case when (b08 - 0.0121) / greatest(sqrt(s / 2601), 1e-4) * 3 >= 5 then 4 else 0 end as bigint) as flags from px join ns using (scene_no, prow, pcol) join nb using (scene_no, prow, pcol)""")
def _(fx):
    """The signal is scaled by 3 so that the noise test splits the pixels."""
    px = pixels(fx, "b02", "b08", "p").withColumns({"d8": C("b08") - 0.0121, "d2": C("b02") - 0.0342})
    px = RA.noise_flags(px.withColumns({"d8": C("d8") * 3, "d2": C("d2") * 3}), KEYS, b08="b08", d_b08="d8", d_b02="d2", p="p")
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), R("noise", 8).alias("noise"), C("flags").cast("bigint").alias("flags"))


BANDS = list(WATER_REF)


def _cols(fmt):
    return ", ".join(fmt.format(b=b, w=WATER_REF[b]) for b in BANDS)


def fdi_sql(p=""):
    return f"({p}b08 - ({p}b06 + ({p}b11 - {p}b06) * ((842.0 - 665.0) / (1610.0 - 665.0) * 10)))"


def pass_sql(n, src, ok):
    """One pass of the background over ``src``: block medians, nearest good block, smoothing, bilinear stretching."""
    return f"""bl{n} as materialized (select scene_no, cast((prow - prow % 32) / 32 as bigint) as br, cast((pcol - pcol % 32) / 32 as bigint) as bc, any_value(cast(ceil(h / 32) as bigint)) as h, any_value(cast(ceil(w / 32) as bigint)) as w, count(*) filter (where {ok}) as n_ok,
      {_cols('median({b}) filter (where ' + ok + ') as {b}')} from {src} group by 1, 2, 3),
    nn{n} as (select a.scene_no, a.br as prow, a.bc as pcol, a.h, a.w, {_cols('g.{b}')}, row_number() over (partition by a.scene_no, a.br, a.bc order by pow(a.br - g.br, 2) + pow(a.bc - g.bc, 2), g.br, g.bc) as rn
      from bl{n} a join bl{n} g on g.scene_no = a.scene_no and g.n_ok >= 128),
    fl{n} as materialized (select * from nn{n} where rn = 1), {box_sql(f'sm{n}', {b: b for b in BANDS}, 1, f'fl{n}')},
    ps{n} as (select scene_no, prow, pcol, (prow + 0.5) / 32 - 0.5 as y, (pcol + 0.5) / 32 - 0.5 as x, cast(ceil(h / 32) as bigint) as hb, cast(ceil(w / 32) as bigint) as wb from {src}),
    cr{n} as (select ps.scene_no, ps.prow, ps.pcol, greatest(0, least(floor(y) + dy, hb - 1)) as br, greatest(0, least(floor(x) + dx, wb - 1)) as bc,
      (case when dy = 1 then y - floor(y) else 1 - (y - floor(y)) end) * (case when dx = 1 then x - floor(x) else 1 - (x - floor(x)) end) as wt from ps{n} ps, (select unnest([0, 1]) as dy), (select unnest([0, 1]) as dx)),
    sp{n} as (select cr.scene_no, cr.prow, cr.pcol, {_cols('sum(wt * sm.{b} / 9) as bg_{b}')} from cr{n} cr join sm{n} sm on sm.scene_no = cr.scene_no and sm.prow = cr.br and sm.pcol = cr.bc group by 1, 2, 3),
    bg{n} as materialized (select px.scene_no, px.prow, px.pcol, {_cols('coalesce(bg_{b}, {w}) as bg_{b}')} from {src} px left join sp{n} using (scene_no, prow, pcol))"""


CAND = {False: f"((b03 - b08) / (b03 + b08 + 1e-6) > 0 and {fdi_sql()} < 0.01 and b02 < 0.25 and b02 > 0)", True: "(b02 > 0 and b02 < 0.25 and b11 < 0.08)"}


def background_sql(robust=False):
    return SIZE + f""", p1 as materialized (select *, {CAND[robust]} as ok from px), {pass_sql(1, 'p1', 'ok')},
    p2 as materialized (select p1.* exclude (ok), ok and round(b08 - bg_b08, 9) < 0.006 and round({fdi_sql()} - {fdi_sql('bg_')}, 9) < 0.004 as ok from p1 join bg1 using (scene_no, prow, pcol)), {pass_sql(2, 'p2', 'ok')},
    nx as materialized (select px.* exclude ({', '.join(BANDS)}), {_cols('px.{b} - bg_{b} + {w} as {b}')} from px join bg2 using (scene_no, prow, pcol))"""


BG_SQL = background_sql()


def background(fx, robust=False):
    return RA.water_background(pixels(fx, *BANDS), KEYS, BANDS, 32, robust)


def _background(fx, robust):
    return background(fx, robust).select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), *[R(f"bg_{b}", 11).alias(f"bg_{b}") for b in BANDS])


@register("win5_block_background", "fx_pixel", oracle=f"with {BG_SQL} select scene_no, prow, pcol, {_cols('round(bg_{b}, 11) as bg_{b}')} from bg2")
def _(fx):
    return _background(fx, False)


@register("win5_robust_background", "fx_pixel", oracle=f"with {background_sql(True)} select scene_no, prow, pcol, {_cols('round(bg_{b}, 11) as bg_{b}')} from bg2")
def _(fx):
    return _background(fx, True)


@register("win6_normalised_spectrum", "fx_pixel", oracle=f"with {BG_SQL} select scene_no, prow, pcol, {_cols('round({b}, 11) as n_{b}')} from nx")
def _(fx):
    px = RA.normalise(background(fx), BANDS)
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), *[R(f"n_{b}", 11).alias(f"n_{b}") for b in BANDS])


INDEX_SQL = {"ndvi": "(b08 - b04) / (b08 + b04 + 1e-6)", "fdi": fdi_sql(), "fai": "b08 - (b04 + (b11 - b04) * ((842.0 - 665.0) / (1610.0 - 665.0)))",
             "ndwi": "(b03 - b08) / (b03 + b08 + 1e-6)", "pi": "b08 / (b08 + b04 + 1e-6)", "ndmi": "(b08 - b11) / (b08 + b11 + 1e-6)"}


@register("win7_pixel_features", "fx_pixel", oracle=f"with {BG_SQL}, ix as (select *, {', '.join(f'{v} as {k}' for k, v in INDEX_SQL.items())} from nx), ix2 as materialized (select *, fdi * fdi as f2 from ix), "
          + box_sql("f3", {"s": "fdi"}, 1, "ix2") + ", " + box_sql("f5", {"s": "fdi", "s2": "f2", "m8": "b08"}, 2, "ix2")
          + f" select scene_no, prow, pcol, {_cols('round(ix2.{b}, 10) as n_{b}')}, {', '.join(f'round({k}, 6) as {k}' for k in INDEX_SQL)}," + """
    round(f3.s / 9, 10) as fdi_mean3, round(sqrt(greatest(f5.s2 / 25 - pow(f5.s / 25, 2), 0)), 6) as fdi_std5, round(b08 - m8 / 25, 10) as b08_hp5
    from ix2 join f3 using (scene_no, prow, pcol) join f5 using (scene_no, prow, pcol)""")
def _(fx):
    px = FT.pixel_features(background(fx), KEYS, BANDS)
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), *[R(n, 6 if n in INDEX_SQL or n == "fdi_std5" else 10).alias(n) for n in FT.feature_names(BANDS)])


SHIP = "cls = 2 and flags = 7"
DIST_SQL = f"""mk as (select scene_no, prow, pcol from px where {SHIP}),
    ds as (select px.scene_no, px.prow, px.pcol, least(41, coalesce(min(abs(px.prow - mk.prow) + abs(px.pcol - mk.pcol)), 41)) as d from px left join mk using (scene_no) group by 1, 2, 3)"""


@register("win8_dilation", "fx_pixel", oracle=f"with {SIZE}, {DIST_SQL}" + " select scene_no, prow, pcol, d <= 1 as d1, d <= 5 as d5, d <= 10 as d10, d <= 30 as d30, d <= 40 as d40 from ds")
def _(fx):
    """All radii come from one distance."""
    px = RA.city_distance(pixels(fx, "cls", "flags"), KEYS, {"d": (C("cls") == 2) & (C("flags") == 7)}, 40)
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), *[(C("d") <= n).alias(f"d{n}") for n in (1, 5, 10, 30, 40)])


HOLES = "(scl <> 6 and flags = 7)"
ERODE = f"""hl as (select scene_no, prow, pcol from px where {HOLES}),
    er as (select px.scene_no, px.prow, px.pcol, least(min(abs(px.prow - hl.prow) + abs(px.pcol - hl.pcol)), any_value(px.prow) + 1, any_value(px.pcol) + 1, any_value(px.h) - any_value(px.prow), any_value(px.w) - any_value(px.pcol)) as d from px left join hl using (scene_no) group by 1, 2, 3)"""


@register("win9_erosion_opening", "fx_pixel", oracle=f"with {SIZE}, {ERODE}" + """, e2 as (select scene_no, prow, pcol from er where d > 2)
    select er.scene_no, er.prow, er.pcol, er.d > 3 as eroded, coalesce(min(abs(er.prow - e2.prow) + abs(er.pcol - e2.pcol)), 99) <= 2 as opened from er left join e2 using (scene_no) group by er.scene_no, er.prow, er.pcol, er.d""")
def _(fx):
    px = pixels(fx, "scl", "flags").withColumn("w", ~((C("scl") != 6) & (C("flags") == 7)))
    px = RA.opening(RA.erode(px, KEYS, C("w"), 3, "eroded"), KEYS, C("w"), 2, "opened")
    return px.select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), "eroded", "opened")


DET = "p >= 0.3 and flags = 7"
ZONE_SQL = f"""dt as (select scene_no, prow, pcol, p, frac from px where {DET}),
    gr as (select distinct px.scene_no, px.prow, px.pcol from px join dt on dt.scene_no = px.scene_no and abs(dt.prow - px.prow) + abs(dt.pcol - px.pcol) <= 1),
    ge as (select a.scene_no as s, a.prow * 50 + a.pcol as a, b.prow * 50 + b.pcol as b from gr a join gr b on a.scene_no = b.scene_no and abs(a.prow - b.prow) <= 1 and abs(a.pcol - b.pcol) <= 1),
    cc(s, node, comp) using key (s, node) as (select scene_no, prow * 50 + pcol, prow * 50 + pcol from gr
      union select ge.s, ge.b, min(c.comp) from cc c join ge on ge.s = c.s and ge.a = c.node join recurring.cc r on r.s = ge.s and r.node = ge.b where c.comp < r.comp group by ge.s, ge.b),
    zn as (select dt.*, comp from dt join cc on cc.s = dt.scene_no and cc.node = dt.prow * 50 + dt.pcol)"""


def zone_pixels(fx):
    px = pixels(fx, "p", "frac", "flags")
    return RA.zone_components(px, KEYS, (C("p") >= 0.3) & (C("flags") == 7), 1)


@register("win10_zone_components", "fx_pixel", oracle=f"with recursive {SIZE}, {ZONE_SQL} select scene_no, prow, pcol, comp from zn")
def _(fx):
    return zone_pixels(fx).select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), (C("label.row") * 50 + C("label.run")).alias("comp"))


@register("win10_drop_small", "fx_pixel", oracle=f"with recursive {SIZE}, gr as (select scene_no, prow, pcol from px where p >= 0.3 and flags >= 4)," + """
    ge as (select a.scene_no as s, a.prow * 50 + a.pcol as a, b.prow * 50 + b.pcol as b from gr a join gr b on a.scene_no = b.scene_no and abs(a.prow - b.prow) <= 1 and abs(a.pcol - b.pcol) <= 1),
    cc(s, node, comp) using key (s, node) as (select scene_no, prow * 50 + pcol, prow * 50 + pcol from gr
      union select ge.s, ge.b, min(c.comp) from cc c join ge on ge.s = c.s and ge.a = c.node join recurring.cc r on r.s = ge.s and r.node = ge.b where c.comp < r.comp group by ge.s, ge.b),
    n as (select s, comp, count(*) as n from cc group by 1, 2 having count(*) >= 4)
    select cc.s as scene_no, node from cc join n on n.s = cc.s and n.comp = cc.comp""")
def _(fx):
    m = pixels(fx, "p", "flags").where("p >= 0.3 and flags >= 4").select("scene_no", "row", "col")
    return RA.drop_small(m, KEYS, 4).select("scene_no", (C("row") * 50 + C("col")).alias("node"))


SEA_SIZE = """sz as (select scene_no, max(prow) + 1 as h, max(pcol) + 1 as w from fx_sea group by 1), px as materialized (select * from fx_sea join sz using (scene_no)),
    ld as materialized (select scene_no, prow, pcol from px where not water)"""


def sea(fx):
    return RA.with_size(fx.fx_sea.withColumnsRenamed({"prow": "row", "pcol": "col"}), KEYS)


@register("win11_main_basin", "fx_sea", oracle=f"with recursive {SEA_SIZE}," + """
    core as materialized (select scene_no, prow, pcol from px where water and not exists (select 1 from ld where ld.scene_no = px.scene_no and pow(px.prow - ld.prow, 2) + pow(px.pcol - ld.pcol, 2) <= 900)),
    ru as materialized (select scene_no, prow, lo, min(pcol) as a, max(pcol) as b from (select *, pcol - row_number() over (partition by scene_no, prow order by pcol) as lo from core) group by 1, 2, 3),
    re as (select x.scene_no as s, x.prow * 1000 + x.a as u, y.prow * 1000 + y.a as v from ru x join ru y on x.scene_no = y.scene_no and abs(x.prow - y.prow) = 1 and x.a <= y.b and y.a <= x.b),
    cc(s, node, comp) using key (s, node) as (select scene_no, prow * 1000 + a, prow * 1000 + a from ru
      union select re.s, re.v, min(c.comp) from cc c join re on re.s = c.s and re.u = c.node join recurring.cc r on r.s = re.s and r.node = re.v where c.comp < r.comp group by re.s, re.v),
    size as (select cc.s, cc.comp, sum(ru.b - ru.a + 1) as n from cc join ru on ru.scene_no = cc.s and ru.prow * 1000 + ru.a = cc.node group by 1, 2),
    big as (select s, first(comp order by n desc, comp) as comp from size group by s),
    seed as materialized (select core.scene_no, core.prow, core.pcol from core join ru on ru.scene_no = core.scene_no and ru.prow = core.prow and core.pcol between ru.a and ru.b
      join cc on cc.s = ru.scene_no and cc.node = ru.prow * 1000 + ru.a join big on big.s = cc.s and big.comp = cc.comp),
    gr(s, r, c, d) using key (s, r, c) as (select scene_no, prow, pcol, 0 from seed
      union select px.scene_no, px.prow, px.pcol, min(gr.d) + 1 from gr, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx), px
        where px.scene_no = gr.s and px.prow = gr.r + dy and px.pcol = gr.c + dx and px.water and gr.d < 31
          and not exists (select 1 from recurring.gr o where o.s = px.scene_no and o.r = px.prow and o.c = px.pcol) group by 1, 2, 3)
    select s as scene_no, r as prow, c as pcol from gr
    union all select scene_no, prow, pcol from px where water and scene_no not in (select s from big)""")
def _(fx):
    return RA.main_basin(sea(fx), KEYS, C("water"), 30, "main").where("main").select("scene_no", C("row").alias("prow"), C("col").alias("pcol"))


@register("agg20_object_recall", "fx_pixel", oracle=f"with recursive {SIZE}, gr as (select scene_no, prow, pcol, p >= 0.8 as pred from px where cls = 1 and flags >= 4 or cls = 3)," + """
    ge as (select a.scene_no as s, a.prow * 50 + a.pcol as a, b.prow * 50 + b.pcol as b from gr a join gr b on a.scene_no = b.scene_no and abs(a.prow - b.prow) <= 1 and abs(a.pcol - b.pcol) <= 1),
    cc(s, node, comp) using key (s, node) as (select scene_no, prow * 50 + pcol, prow * 50 + pcol from gr
      union select ge.s, ge.b, min(c.comp) from cc c join ge on ge.s = c.s and ge.a = c.node join recurring.cc r on r.s = ge.s and r.node = ge.b where c.comp < r.comp group by ge.s, ge.b),
    o as (select cc.s, comp, bool_or(pred) as hit from cc join gr on gr.scene_no = cc.s and gr.prow * 50 + gr.pcol = cc.node group by 1, 2)
    select s as scene_no, count(*) as objects, count(*) filter (where hit) as found from o group by 1""")
def _(fx):
    px = pixels(fx, "cls", "flags", "p").where("cls = 1 and flags >= 4 or cls = 3")
    lab = RA.label_components(px.select("scene_no", "row", "col", (C("p") >= 0.8).alias("pred")), KEYS)
    o = lab.groupBy("scene_no", "label").agg(F.max("pred").alias("hit"))
    return o.groupBy("scene_no").agg(F.count(F.lit(1)).alias("objects"), F.count_if("hit").alias("found"))


ZONE_HAV = HAV.format(a1="z.lon", b1="z.lat", a2="e.lon", b2="e.lat")


@register("dq5_scene_zones", "fx_pixel", "fx_event", oracle=f"with recursive {SIZE}, {ZONE_SQL}" + f""",
    zz as (select scene_no, comp, count(*) as n_pixels, sum(frac * 100) as cover, round(avg(p), 3) as p_mean, round(max(p), 3) as p_max,
      43.62 - (avg(prow) + 0.5) * 0.0001 as lat, 39.55 + (avg(pcol) + 0.5) * 0.0002 as lon from zn group by 1, 2),
    z as materialized (select *, cast(scene_no as double) * 2 as wind24_ms, 1 + scene_no % 3 as month_no, concat('bay-', scene_no, '-', lpad(cast(row_number() over (partition by scene_no order by lat desc, lon, comp) as varchar), 3, '0')) as zone_id from zz),
    ne as materialized (select zone_id, event_id, e.conc, abs(cast(e.date_utc as date) - cast(date '2024-01-01' + cast(scene_no * 9 as integer) as date)) as gap, {ZONE_HAV} as d, e.profile from z, fx_event e),
    n1 as (select * from (select *, row_number() over (partition by zone_id order by d, event_id) as rn from ne) where rn = 1), nb as (select zone_id, min(d) as db from ne where profile = 'B' group by 1),
    m as (select zone_id, db, exp(5.1 + 0.21 * (lat - 43.2) / 1.6 + -0.13 * (wind24_ms - 4.9) / 2.9) as raw from z join nb using (zone_id))
    select scene_no, n_pixels, round(cover, 1) as cover_m2, p_mean, p_max, round(lat, 7) as lat, round(lon, 7) as lon, zone_id, round(cover / (n_pixels * 1e-4), 3) as cover_m2_km2,
      event_id as field_event_id, round(d, 5) as field_distance_km, gap as field_date_gap_days, round(conc, 5) as field_conc_items_km2, round(greatest(raw - 1, 0), 5) as conc_b_items_km2,
      round(greatest((greatest(raw - 1, 0) + 1) * exp(-0.9) - 1, 0), 5) as conc_b_lo80, round((greatest(raw - 1, 0) + 1) * exp(0.8) - 1, 5) as conc_b_hi80,
      case when db > 60 or month_no not in (1, 2, 6) or wind24_ms not between 0.3 and 8.7 then 'research_estimate' else 'model_estimate' end as conc_b_status,
      cast(null as double) as conc_a_items_km2, 'unavailable' as conc_a_status from z join n1 using (zone_id) join m using (zone_id)""")
def _(fx):
    """Zones with geometry, cover, the nearest field event and the density of both profiles at the centre."""
    z = SC.zone_table(zone_pixels(fx), KEYS)
    z = z.withColumns({"lat": 43.62 - (C("row_mean") + 0.5) * 0.0001, "lon": 39.55 + (C("col_mean") + 0.5) * 0.0002})
    z = materialise(SC.number_zones(z, KEYS, F.concat(F.lit("bay-"), C("scene_no").cast("string"))).drop("label"))
    day = F.unix_date(F.lit("2024-01-01").cast("date")) + C("scene_no").cast("int") * 9
    at = z.select("zone_id", "lon", "lat", day.alias("z_day"), (C("scene_no").cast("double") * 2).alias("wind24_ms"), (1 + C("scene_no") % 3).alias("month_no"))
    near = J.nearest_event(at, fx.fx_event.withColumn("e_day", F.unix_date("date_utc")), "zone_id", "z_day")
    train = fx.fx_event.where("profile = 'B'")
    scored = [(n, ML.score_points(at, m, train, "zone_id", "event_id")) for n, m in (("b", MODEL_B), ("a", MODEL_A))]
    d = SC.describe_zones(z, scored, near)
    digits = {"cover_m2": 1, "p_mean": 3, "p_max": 3, "lat": 7, "lon": 7, "cover_m2_km2": 3, "field_distance_km": 5, "field_conc_items_km2": 5, "conc_b_items_km2": 5,
              "conc_b_lo80": 5, "conc_b_hi80": 5, "conc_a_items_km2": 5}
    return d.select("scene_no", "n_pixels", "zone_id", "field_event_id", C("field_date_gap_days").cast("bigint").alias("field_date_gap_days"), "conc_b_status", "conc_a_status",
                    *[R(c, k).alias(c) for c, k in digits.items()])


# ---- fields --------------------------------------------------------------------------------------------------------

@register("win15_time_interpolation", "fx_wind", "fx_event", oracle="""
    with t as (select event_id, user_id % 16 as cell_no, t_start_s / 3600 as h from fx_event),
    a as (select event_id, max(hour_no) as ha, max_by(wind_ms, hour_no) as va from t join fx_wind w on w.cell_no = t.cell_no and w.hour_no <= t.h group by 1),
    b as (select event_id, min(hour_no) as hb, min_by(wind_ms, hour_no) as vb from t join fx_wind w on w.cell_no = t.cell_no and w.hour_no >= t.h group by 1)
    select event_id, round(case when va is null then vb when vb is null or hb <= ha then va else va + (vb - va) * (h - ha) / (hb - ha) end, 6) as wind from t left join a using (event_id) left join b using (event_id)""")
def _(fx):
    t = fx.fx_event.select(C("event_id").alias("target_id"), (C("user_id") % 16).alias("cell_no"), (C("t_start_s") / 3600).alias("hour_no"))
    w = fx.fx_wind.withColumn("hour_no", C("hour_no").cast("double"))
    return DR.at_times(w, t, ["cell_no"], "hour_no", "wind_ms", "wind").select(C("target_id").alias("event_id"), R("wind", 6).alias("wind"))


@register("win15_noon_means_to_hours", "fx_wind", oracle="""
    with d as (select cell_no, floor(hour_no / 24) * 24 + 12 as t, avg(wind_ms) as v from fx_wind group by 1, 2), n as (select *, lead(t) over w as t1, lead(v) over w as v1 from d window w as (partition by cell_no order by t))
    select cell_no, cast(t + k as bigint) as hour_no, round(v + (coalesce(v1, v) - v) * case when t1 is null then 0 else k / (t1 - t) end, 10) as wind_ms
    from n, lateral (select unnest(range(cast(coalesce(t1 - t, 1) as bigint))) as k)""")
def _(fx):
    d = fx.fx_wind.groupBy("cell_no", (F.floor(C("hour_no") / 24) * 24).alias("t")).agg(F.avg("wind_ms").alias("wind_ms"))
    h = DR.hourly_field(d, ["cell_no"], "t", ["wind_ms"], shift=12.0)
    return h.select("cell_no", C("t").cast("bigint").alias("hour_no"), R("wind_ms", 10).alias("wind_ms"))


FIELD_SQL = """cl as (select (c_custkey % 60) as gx, cast(floor(c_custkey / 60) as bigint) as gy, c_custkey as cid, case when (c_custkey * 7) % 11 < 4 then null else c_acctbal / 100 end as v from customer),
    fl as (select a.cid, a.gx, a.gy, coalesce(a.v, (select s.v from cl s where s.v is not null order by pow(s.gx - a.gx, 2) + pow(s.gy - a.gy, 2), s.cid limit 1)) as v from cl a)"""


def field_cells(fx):
    k = C("c_custkey")
    return fx.customer.select((k % 60).alias("gx"), F.floor(k / 60).cast("bigint").alias("gy"), k.alias("cid"), F.when((k * 7) % 11 >= 4, C("c_acctbal") / 100).alias("v"))


@register("win16_land_fill", oracle=f"with {FIELD_SQL} select cid, round(v, 6) as v from fl")
def _(fx):
    return DR.fill_from_sea(field_cells(fx), "v", "cid").select("cid", R("v", 6).alias("v"))


@register("win16_bilinear_regrid", "fx_event", oracle=f"with {FIELD_SQL}" + """,
    t as (select event_id, (lon - 27) * 4 as tx, (lat - 40.5) * 4.3 as ty, 59 as mx, (select max(gy) from cl) as my from fx_event),
    q as (select *, greatest(0, least(floor(tx), mx - 1)) as x0, greatest(0, least(floor(ty), my - 1)) as y0 from t)
    select event_id, round(sum(v * (case when dx = 1 then tx - x0 else 1 - (tx - x0) end) * (case when dy = 1 then ty - y0 else 1 - (ty - y0) end)), 6) as value
    from q, (select unnest([0, 1]) as dx), (select unnest([0, 1]) as dy) join fl on fl.gx = x0 + dx and fl.gy = y0 + dy group by 1""")
def _(fx):
    cells = DR.fill_from_sea(field_cells(fx), "v", "cid")
    t = fx.fx_event.select("event_id", ((C("lon") - 27) * 4).alias("tx"), ((C("lat") - 40.5) * 4.3).alias("ty"))
    top = cells.agg(F.max("gy")).scalar()
    return DR.regrid(cells, t, "v", "value", F.lit(59), top).select("event_id", R("value", 6).alias("value"))


@register("win17_thinned_frames", "fx_flow", oracle="""
    select ix, iy, hour_no, round_even(wind_ms, 1) as wind_ms from fx_flow where ix % 3 = 0 and iy % 3 = 0""")
def _(fx):
    """80 by 40 nodes: every third stays, so that no side keeps more than 32."""
    return DR.thin_grid(fx.fx_flow, "ix", "iy", F.lit(80), F.lit(40)).select("ix", "iy", "hour_no", F.bround("wind_ms", 1).alias("wind_ms"))


@register("win19_mask_coast_distance", "fx_sea", oracle=f"with {SEA_SIZE}" + """
    select px.scene_no, px.prow, px.pcol, round(min(sqrt(pow(px.prow - ld.prow, 2) + pow(px.pcol - ld.pcol, 2))) * 0.01, 6) as coast_km
    from px left join ld on ld.scene_no = px.scene_no and pow(px.prow - ld.prow, 2) + pow(px.pcol - ld.pcol, 2) <= 250000 group by 1, 2, 3""")
def _(fx):
    return RA.mask_coast_km(sea(fx), KEYS, ~C("water")).select("scene_no", C("row").alias("prow"), C("col").alias("pcol"), R("coast_km", 6).alias("coast_km"))


@register("dq3_scene_masks", "fx_pixel")
def _(fx):
    """Composition of the masks above; checked against numpy in the tests."""
    px = pixels(fx, "b03", "b08", "b11", "scl", "p", "cls", "flags", "frac").withColumns(
        {"water": C("p_partkey") % 7 != 0, "valid": (C("p_partkey") % 7 != 0) & C("scl").isin(4, 6), "area": F.lit(0)})
    m = SC.scene_masks(px, ["area"], KEYS)
    return m.groupBy("scene_no").agg(F.count_if("cand").alias("cand"), F.count_if("det").alias("det"), F.count_if("near_ship").alias("near_ship"),
                                     F.count_if("ice_zone").alias("ice_zone"), F.count_if("cloud_zone").alias("cloud_zone"), F.count_if("static_zone").alias("static_zone"))


@register("dq4_detection_points", "fx_cellpx", oracle="""
    select scene_no, round(cast(39.55 as double) + (pcol + 0.5) * cast(0.0002 as double), 7) as lon, round(cast(43.62 as double) - (prow + 0.5) * cast(0.0001 as double), 7) as lat, round_even(p, 2) as p, round_even(frac, 2) as frac from fx_cellpx where det""")
def _(fx):
    return fx.fx_cellpx.where("det").select("scene_no", R(39.55 + (C("pcol") + 0.5) * 0.0002, 7).alias("lon"), R(43.62 - (C("prow") + 0.5) * 0.0001, 7).alias("lat"),
                                            F.bround("p", 2).alias("p"), F.bround("frac", 2).alias("frac"))


