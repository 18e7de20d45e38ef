"""Cases that once dropped or confused rows."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.functions.density import poisson_interval
from flotsam.operators.neighbours import nearest
from flotsam.plans import fingerprint as FG
from flotsam.plans import joins as J
from flotsam.plans.field import select_rows


def test_footprints_of_any_radius(spark):
    rng = np.random.default_rng(3)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(26, 42, 300), rng.uniform(40, 47, 300)))]
    feet = [(0, 30.0, 43.0, 31.0, 43.5, 1.0), (1, 33.0, 42.0, 33.0, 42.0, 10.0), (2, 35.0, 44.0, 36.0, 44.5, 300.0), (3, 30.0, 43.0, 31.0, 43.5, 400.0),
            (4, 30.0, 43.0, 30.0, 43.0, 1000.0), (5, 30.0, 43.0, 30.0, 43.0, None), (6, 30.0, 43.0, 31.0, 43.0, 6000.0)]
    f = spark.createDataFrame(feet, "fid int, ax double, ay double, bx double, by double, r_km double")
    p = spark.createDataFrame(pts, "pid int, lon double, lat double")
    got = {(r.fid, r.pid) for r in J.in_footprint(f, p).collect()}
    want = set()
    for fid, ax, ay, bx, by, r in feet:
        k = 111.32 * math.cos(math.radians(ay))
        for pid, lon, lat in pts:
            dx, dy, px, py = (bx - ax) * k, (by - ay) * 111.32, (lon - ax) * k, (lat - ay) * 111.32
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            if r is not None and math.hypot(px - t * dx, py - t * dy) <= r:
                want.add((fid, pid))
    assert got == want
    assert J.in_footprint(f.where("r_km is null"), p).count() == 0


def test_blank_flags_do_not_exclude(spark, sf):
    from flotsam.fixtures import Views

    reg = Views(spark, sf).fx_event.limit(200)
    a = select_rows(reg.withColumn("quality_flags", F.lit("")))
    b = select_rows(reg.withColumn("quality_flags", F.lit(None).cast("string")))
    cols = ["event_id", "decision", "reason_code", "flags_hit"]
    assert sorted(map(repr, a.select(cols).collect())) == sorted(map(repr, b.select(cols).collect()))
    assert a.where("decision = 'included'").count() > 0


def test_row_texts_differ(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "x"), ("~", "x"), ("-", "x"), ("1:a", "x")], "p string, q string")
    assert df.select(F.countDistinct(FG.canonical(df, ["p", "q"]))).first()[0] == 6


def test_rows_without_a_group_are_neighbours(spark):
    q = spark.createDataFrame([(1, 30.0, 43.0, 7)], "qid int, lon double, lat double, g int")
    r = spark.createDataFrame([(1, 30.0, 43.0, None), (2, 31.0, 43.0, 8)], "rid int, lon double, lat double, g int")
    assert nearest(q, r, qid="qid", rid="rid", exclude=("g", "g")).first()["rid"] == 1


@pytest.mark.parametrize("n", [0, 1, 7, 255, 256, 257, 5000])
def test_exact_poisson_interval(spark, n):
    df = poisson_interval(spark.createDataFrame([(n,)], "n long"), "n").first()
    cdf = lambda k, x: math.fsum(math.exp(i * math.log(x) - x - math.lgamma(i + 1)) for i in range(k + 1)) if x > 0 else 1.0      # noqa: E731
    assert abs(cdf(n, df["n_hi"]) - 0.025) < 1e-6
    assert df["n_lo"] == 0 if n == 0 else abs(1 - cdf(n - 1, df["n_lo"]) - 0.025) < 1e-6
