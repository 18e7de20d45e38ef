"""Steps whose work or shuffle grew faster than the input, on inputs small enough to be looked through."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.operators import raster as RA


def test_block_medians_as_arrays(spark):
    """medians of blocks in tiles are those of numpy; nulls and masked pixels do not count, empty blocks stay."""
    g = np.random.default_rng(7)
    v = np.round(g.normal(size=(70, 21)), 2)
    ok = g.random(v.shape) < 0.6
    ok[:4, :4] = False
    null = g.random(v.shape) < 0.1
    px = spark.createDataFrame([(0, r, c, bool(ok[r, c]), None if null[r, c] else float(v[r, c])) for r in range(70) for c in range(21)], "im int, row int, col int, ok boolean, v double")
    got = RA.block_medians(RA.with_size(px, ["im"]), ["im"], ["v"], F.col("ok"), 4).collect()
    assert len(got) == 18 * 6
    for r in got:
        at = np.s_[r.row * 4:r.row * 4 + 4, r.col * 4:r.col * 4 + 4]
        use = v[at][ok[at] & ~null[at]]
        assert (r.height, r.width, r._n) == (18, 6, len(use))
        assert r.v == (pytest.approx(np.median(use)) if len(use) else None)


def test_background_of_a_table_in_one_part(spark):
    """a table that one task reads is not worked on by one task."""
    bands = ["b02", "b03", "b04", "b06", "b08", "b11"]
    px = spark.range(64 * 64, numPartitions=1).select(F.lit(0).alias("im"), F.floor(F.col("id") / 64).alias("row"), (F.col("id") % 64).alias("col"), *[(F.col("id") % 7 / 100 + 0.01).alias(b) for b in bands])
    bg = RA.water_background(RA.with_size(px, ["im"]), ["im"], bands, 4, True)
    assert bg.count() == 64 * 64
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert bg.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_leaves_of_a_long_strip_are_square():
    """a strip of 60 by 90,000 places has as many leaves, but not 400 times as long as wide."""
    from flotsam.operators.neighbours import _sides
    s = _sides(26000.0, {"x": 59.0, "y": 90000.0})
    assert s["x"] * s["y"] == pytest.approx(26000) and s["y"] / s["x"] == pytest.approx(90000 / 59)
    assert _sides(100.0, {"x": 1e-9, "y": 5.0}) == {"x": 1.0, "y": pytest.approx(100.0)}
    assert _sides(1.0, {"x": 3.0, "y": 5.0, "t": 9.0}) == {"x": 1.0, "y": 1.0, "t": 1.0}


def test_nearest_in_a_long_strip(spark):
    """the nearest in a strip are those of brute force, the smallest id on ties."""
    from flotsam.operators.neighbours import Metric, nearest
    n = 6000
    xy = np.c_[np.arange(n) % 6, np.arange(n) // 6]
    sea = np.arange(n) * 7 % 11 >= 4
    pts = spark.createDataFrame([(i, int(xy[i, 0]), int(xy[i, 1]), bool(sea[i])) for i in range(n)], "id bigint, x int, y int, sea boolean")
    got = nearest(pts.where("not sea"), pts.where("sea").withColumnRenamed("id", "rid"), qid="id", rid="rid", q_xy=("x", "y"), r_xy=("x", "y"), metric=Metric("plane")).collect()
    at = np.flatnonzero(sea)
    assert {r.id: r.rid for r in got} == {int(i): int(at[((xy[at] - xy[i]) ** 2).sum(1).argmin()]) for i in np.flatnonzero(~sea)}


def test_targets_are_not_spread_over_corners(spark):
    """a target meets its square as one row; missing and null corners add nothing, no corner gives no row."""
    from flotsam.operators import drift as DR
    v = {(x, y): float(10 * x + y * y) for x in range(4) for y in range(4)} | {(1, 1): None}
    del v[3, 3], v[0, 0]
    cells = spark.createDataFrame([(x, y, w) for (x, y), w in v.items()], "gx int, gy int, v double")
    at = [(0, 0.25, 0.5), (1, 2.5, 2.25), (2, -1.0, 2.0), (3, 1.0, 1.0), (4, 9.0, 0.5)]
    out = DR.regrid(cells, spark.createDataFrame(at, "id int, tx double, ty double"), "v", "z", F.lit(3), F.lit(3))
    got = {r.id: r.z for r in out.collect()}
    for i, tx, ty in at:
        x0, y0 = (int(max(0, min(np.floor(t), 2))) for t in (tx, ty))
        w = {(dx, dy): (tx - x0 if dx else 1 - tx + x0) * (ty - y0 if dy else 1 - ty + y0) for dx in (0, 1) for dy in (0, 1)}
        assert got[i] == pytest.approx(sum(w[d] * (v.get((x0 + d[0], y0 + d[1])) or 0) for d in w))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    far = spark.createDataFrame([(9, 9, 1.0)], "gx int, gy int, v double")
    assert DR.regrid(far, spark.createDataFrame(at, "id int, tx double, ty double"), "v", "z", F.lit(3), F.lit(3)).count() == 0


@pytest.mark.parametrize("step", [1, 40000])
def test_lowest_hashes_of_groups(spark, step):
    """below the limit or, where hashes are uneven, out of all rows, the same rows are chosen."""
    from flotsam.operators import metrics as M
    ids = [i * step for i in range(3000)]
    rows = [(i, int(i // step % 7 == 0), "ab"[i // step % 2]) for i in ids]
    got = {r.id for r in M.lowest(spark.createDataFrame(rows, "id bigint, c int, g string"), ["c", "g"], 40, "id").collect()}

    def h(i):
        return ((i * 48271 + 11) % M.PRIME * 69621 + 7) % M.PRIME
    exp = {i for c in (0, 1) for g in "ab" for i in sorted((r[0] for r in rows if r[1:] == (c, g)), key=lambda i: (h(i), i))[:40]}
    assert got == exp
    # what balance takes out of some of the groups is among them
    df = spark.createDataFrame(rows, "id bigint, c int, g string").where("g = 'a'")
    assert {r.id for r in M.balance(df, "c", 40, "id", 2).collect()} == {i for i in exp if rows[i // step][2] == "a"}


def test_every_row_by_the_model_of_its_key(spark):
    """one pass over the rows gives what each model gives for its own."""
    from flotsam.operators import models as ML
    g = np.random.default_rng(8)
    rows = [(i, "abc"[i % 3], float(x), float(y), int(x + y > 0.2 * (i % 3)), 1.0) for i, (x, y) in enumerate(g.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id int, k string, x double, y double, c int, w double")
    fitted = {k: ML.train_forest(df.where(F.col("k") != k), ["x", "y"], "c", "w", trees=3, depth=3) for k in "ab"}
    got = {r.id: r.prediction for r in ML.predict_by_model(df, fitted, "k").collect()}
    exp = {r.id: r.prediction for k, (m, va) in fitted.items() for r in m.transform(va.transform(df.where(F.col("k") == k))).collect()}
    assert len(exp) == 200 and got == exp


def test_zones_grow_from_the_detections(spark):
    """a short growth starts from the detections, stays on the pixels there are, and gives the zones of the long way."""
    g = np.random.default_rng(9)
    px = [(i, r, c, bool(g.random() < 0.12)) for i in (3, -2) for r in range(30) for c in range(17) if g.random() < 0.95]
    df = RA.with_size(spark.createDataFrame(px, "im int, row int, col int, on boolean"), ["im"])
    out = RA.zone_components(df, ["im"], F.col("on"), 1)
    got = {(r.im, r.row, r.col): tuple(r.label) for r in out.collect()}
    have, on = {p[:3] for p in px}, {p[:3] for p in px if p[3]}
    grown = {q for i, r, c in on for q in ((i, r, c), (i, r - 1, c), (i, r + 1, c), (i, r, c - 1), (i, r, c + 1)) if q in have}
    exp, seen = {}, set()
    for start in sorted(grown):
        if start in seen:
            continue
        todo, zone = [start], {start}
        while todo:
            i, r, c = todo.pop()
            new = {(i, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & grown - zone
            zone |= new
            todo += new
        seen |= zone
        exp |= {p: min(zone) for p in zone & on}
    assert got == exp
    assert out.columns == [*df.columns, "label"] and "Window" not in out._jdf.queryExecution().executedPlan().toString()
    bare = RA.zone_components(df, ["im"], F.col("on"), 0).collect()
    assert {(r.im, r.row, r.col) for r in bare} == on


def test_components_by_whole_numbers_or_by_names(spark):
    """image, row and run make one whole number in their order where they fit; images with names keep theirs."""
    px = [(7, 0, 0), (7, 1, 1), (7, 5, 5), (-4, 2, 3), (-4, 2, 4), (-4, 4, 4)]
    df = spark.createDataFrame(px, "im bigint, row int, col bigint")
    got = {(r.im, r.row, r.col): tuple(r.label) for r in RA.label_components(df, ["im"]).collect()}
    exp = {p: p for p in px} | {(7, 1, 1): (7, 0, 0), (-4, 2, 4): (-4, 2, 3)}
    assert got == exp
    assert RA._radix(df.withColumnRenamed("col", "run"), ["im", "row", "run"]) == {"im": (-4, 12, 36), "row": (0, 6, 6), "run": (0, 6, 1)}
    named = RA.label_components(df.withColumn("im", F.col("im").cast("string")), ["im"]).collect()
    assert {(int(r.im), r.row, r.col): (int(r.label.im), *tuple(r.label)[1:]) for r in named} == exp
    assert RA.label_components(df.where("im = 0"), ["im"]).count() == 0
