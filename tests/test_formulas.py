"""Hand-checked values of the formulas."""
import pytest
from pyspark.sql import functions as F

from flotsam import config
from flotsam.functions import density as D
from flotsam.functions import geo as G
from flotsam.functions import spectral as S
from flotsam.operators import metrics as M
from flotsam.plans import field as FP
from flotsam.sources import registry as reg


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_densities(spark):
    r = one(spark, a=D.field_density(F.lit(12), F.lit(0.20)), b=D.strip_area_km2(F.lit(19.68), F.lit(10.0)), c=D.field_density(F.lit(4), F.lit(0.1968)),
            d=D.field_density(F.lit(7), F.lit(0.24465)))
    assert (r.a, r.b) == pytest.approx((60.0, 0.1968))
    assert r.c == pytest.approx(20.325203252) and r.d == pytest.approx(28.6123032904)
    df = spark.createDataFrame([(1, 0.02), (7, 0.18)], "n int, a double")
    assert df.agg(D.pooled_density(F.col("n"), F.col("a"))).first()[0] == pytest.approx(40.0)
    with pytest.raises(Exception):
        spark.createDataFrame([(1, 0.0)], "n int, a double").select(D.field_density(F.col("n"), F.col("a"))).collect()


def test_poisson_interval(spark):
    df = spark.createDataFrame([(4, 0.2), (0, 0.2), (250, 1.0), (12000, 1.0), (None, 1.0), (1, 1.0)], "n int, a double")
    got = {r.n: (r.n_lo / r.a if r.n is not None else None, r.n_hi / r.a if r.n is not None else None) for r in D.poisson_interval(df, "n").collect()}
    assert got[4] == pytest.approx((5.45, 51.2), abs=0.01)
    assert got[0] == pytest.approx((0.0, 3.688879454 / 0.2))
    assert got[1] == pytest.approx((0.0253178, 5.5716434), abs=1e-6)
    assert got[250] == pytest.approx((219.967, 282.983), abs=0.01)
    assert got[12000] == pytest.approx((11786.24, 12216.67), rel=2e-4) and got[None] == (None, None)


def test_event_interval_midnight_and_whole_day(spark):
    iv = D.event_interval(F.lit("2015-04-20"), F.lit("20:54"), F.lit("00:28"))
    r = one(spark, **iv)
    assert r.time_known and (r.t_end_s - r.t_start_s) / 3600 == pytest.approx(3.5667, abs=1e-4)
    r = one(spark, **D.event_interval(F.lit("2015-04-20"), F.lit(""), F.lit("")))
    assert not r.time_known and r.t_end_s - r.t_start_s == 86400
    t = one(spark, a=D.reference_time(F.lit(0.0), F.lit(10.0), F.lit(True)), b=D.reference_time(F.lit(0.0), F.lit(10.0), F.lit(False)))
    assert (t.a, t.b) == (5.0, 10.0)


def test_metrics_examples(spark):
    df = spark.createDataFrame([("k", 100.0, 110.0), ("k", 200.0, 150.0), ("k", 50.0, 60.0), ("k", 0.0, 30.0)], "k string, y double, p double")
    r = M.error_metrics(df, ["k"], "y", "p").first()
    assert r.mae == pytest.approx(25.0) and r.rmse == pytest.approx((3600 / 4) ** 0.5) and r.medae == pytest.approx(20.0) and r.n == 4
    df = spark.createDataFrame([("k", 1.0, 3.0), ("k", 3.0, 1.0)], "k string, y double, p double")
    assert M.error_metrics(df, ["k"], "y", "p").first().mae_log == pytest.approx(0.6931472)


def test_group_bootstrap_degenerates_with_one_group(spark):
    df = spark.createDataFrame([("a", 0, 1, 2, 22.0)], "k string, group_no int, n_groups int, n int, e double")
    r = M.group_bootstrap(df, ["k"], ["n", "e"], {"mae": F.col("e") / F.col("n")}, n_boot=50).first()
    assert (r.mae_lo, r.mae_hi) == (11.0, 11.0)
    df = spark.createDataFrame([("a", 0, 2, 1, 2.0), ("a", 1, 2, 1, 20.0)], "k string, group_no int, n_groups int, n int, e double")
    r = M.group_bootstrap(df, ["k"], ["n", "e"], {"mae": F.col("e") / F.col("n")}, n_boot=400).first()
    assert (r.mae_lo, r.mae_hi) == (2.0, 20.0)


def test_projection_against_known_points(spark):
    # central meridian: easting 500000; the equator: northing 0; a third point by the published series
    x, y = G.lonlat_to_utm(F.lit(39.0), F.lit(0.0), F.lit(37))
    r = one(spark, x=x, y=y)
    assert (r.x, r.y) == pytest.approx((500000.0, 0.0), abs=1e-6)
    x, y = G.lonlat_to_utm(F.lit(2.294497), F.lit(48.858222), F.lit(31))
    r = one(spark, x=x, y=y)
    assert (r.x, r.y) == pytest.approx((448252.0, 5411935.0), abs=15)
    lon, lat = G.utm_to_lonlat(F.lit(r.x), F.lit(r.y), F.lit(31))
    r = one(spark, lon=lon, lat=lat)
    assert (r.lon, r.lat) == pytest.approx((2.294497, 48.858222), abs=1e-9)


def test_hexagons_tile_the_plane(spark):
    df = spark.range(4000).select((F.rand(1) * 20 - 10).alias("x"), (F.rand(2) * 20 - 10).alias("y"))
    q, r = G.hex_axial(F.col("x"), F.col("y"))
    df = df.withColumns({"q": q, "r": r})
    cx, cy = G.hex_centre(F.col("q"), F.col("r"))
    d = df.select(F.max(F.sqrt((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2))).first()[0]
    assert d <= G.HEX_SIDE_KM + 1e-9
    n = spark.range(200000).select((F.rand(3) * 20).alias("x"), (F.rand(4) * 20).alias("y"))
    q, r = G.hex_axial(F.col("x"), F.col("y"))
    cells = n.select(q.alias("q"), r.alias("r")).distinct().count()
    assert cells == pytest.approx(400 / G.HEX_AREA_KM2, rel=0.12)


def test_glint_only_marks_good_pixels(spark):
    t, f = F.lit(True), F.lit(False)
    q = {n: S.quality_code(w, F.lit(scl), b11, i, s, st) for n, w, scl, b11, i, s, st in (
        ("land", f, 6, F.lit(0.1), f, f, f), ("glint", t, 6, F.lit(0.1), f, f, f), ("cloud_glint", t, 9, F.lit(0.1), f, f, f), ("ice", t, 6, F.lit(0.1), t, f, f),
        ("ship", t, 6, F.lit(0.1), t, t, f), ("static", t, 10, F.lit(0.1), t, t, t), ("nodata", t, 6, F.lit(None).cast("double"), f, f, f), ("ok", t, 6, F.lit(0.01), f, f, f))}
    r = one(spark, **q).asDict()
    assert r == {"land": 1, "glint": 6, "cloud_glint": 3, "ice": 7, "ship": 8, "static": 9, "nodata": 2, "ok": 0}


def test_selection_order_and_flags(spark):
    rows = [("transect_density", "total_plastic", "S2_visual_GT2", ""), ("transect_density", "total_plastic", "S2_visual_GT2", "x;source_total_vs_object_count_conflict"),
            ("item_observation", "object_context", "S2_visual_GT2", ""), ("transect_density", "total_plastic", "S1_aerial_GT50", ""), ("transect_density", "all_litter", "other", "")]
    df = spark.createDataFrame(rows, "record_type string, target_scope string, measurement_profile string, quality_flags string")
    got = [(r.decision, r.sel_profile, r.reason_code) for r in FP.select_rows(df).collect()]
    assert got == [("included", "A", ""), ("excluded", "", "excluded_flag"), ("excluded", "", "object_context_not_label"), ("excluded", "", "total_missing_or_conflict"),
                   ("excluded", "", "not_target_profile")]


def test_blank_numbers_stay_unknown_and_junk_fails(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("sample_id,items_count,note\na,12,x\nb,,\nc, ,z\n", encoding="utf-8")
    df = reg.typed_registry(reg.read_registry(spark, str(p), ["sample_id", "items_count", "note"]))
    assert [r.items_count for r in df.orderBy("sample_id").collect()] == [12.0, None, None]
    p.write_text("sample_id,items_count,note\na,twelve,x\n", encoding="utf-8")
    with pytest.raises(Exception):
        reg.typed_registry(reg.read_registry(spark, str(p), ["sample_id", "items_count", "note"])).collect()


def test_forbidden_predictors():
    config.check_predictors(["lat", "wind24_ms"])
    with pytest.raises(ValueError):
        config.check_predictors(["lat", "n_items"])


def test_wilson_without_observations(spark):
    lo, hi = D.wilson(F.lit(0), F.lit(0))
    r = one(spark, lo=lo, hi=hi)
    assert (r.lo, r.hi) == (0.0, 1.0)


def test_lineage_is_cut_in_the_folder_of_the_session(spark):
    from types import SimpleNamespace as N

    from flotsam.session import materialise, shared_folder
    assert shared_folder(spark) == shared_folder(spark)
    assert materialise(spark.range(5)).count() == 5

    def session(master, folder):
        return N(conf=N(get=lambda k, d=None: folder), sparkContext=N(master=master, applicationId="x", getConf=lambda: {}))
    assert shared_folder(session("spark://host:7077", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://host:7077", None))
