"""Whole work and bounded steps, on inputs small enough to be looked through."""
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flotsam.operators import models as ML


def test_forests_see_all_rows(spark, tmp_path):
    """F8: the rows of the lowest hashes, which a sample of 2000 a class was made of, tell the opposite of all others."""
    from flotsam.operators import metrics as M
    from flotsam.plans import catalog  # noqa: F401
    from flotsam.plans.registry import QUERIES
    key = np.arange(36000)
    scene, cl = key % 6, np.where(key // 6 % 2 == 0, 1, 7)
    h = (((key * 10 + 1) * 48271 + 11) % M.PRIME * 69621 + 7) % M.PRIME
    odd = np.zeros(len(key), bool)
    for s in range(6):
        for c in (1, 7):
            i = np.flatnonzero((scene == s) & (cl == c))
            odd[i[np.argsort(h[i])[:500]]] = True
    # index and vegetation are the same in both classes, after the label was added to them
    rows = [(int(s), int(k), 1, int(c), "A", 1.0, 0.02 if (c == 1) ^ o else 0.08, 1e5 if c == 1 else 0.0, 0.0 if c == 1 else 0.04) for s, k, c, o in zip(scene, key, cl, odd)]
    schema = ("l_suppkey bigint, l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_returnflag string, l_quantity double, l_discount double, "
              "l_extendedprice double, l_tax double")
    spark.createDataFrame(rows, schema).withColumn("l_shipdate", F.lit("2024-01-01").cast("date")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["ml16_leave_region_out"](spark, str(tmp_path)).collect()
    assert len(got) == 6
    for r in got:
        assert (r.tp, r.fn, r.fp, r.n_debris) == (2500, 500, 500, 3000)


def _cells(spark, parts):
    g = np.random.default_rng(4)
    rows = [(float(np.round(x, 2)), None if i % 50 == 0 else float(i % 5), "abc"[i % 3] if i % 7 else "d", None if i % 11 == 0 else i % 4, i % 9) for i, x in enumerate(g.normal(size=4000))]
    df = spark.createDataFrame(rows, "x double, y double, k string, lab int, c int").repartition(parts)
    cuts = ML.held_out_cuts(df, ["x", "y"], "k", ["a", "b"])
    return rows, cuts, {tuple(r)[:-1]: r.n for r in ML.held_out_cells(df, ["x", "y"], cuts, "k", "lab", "c").collect()}


def test_cuts_and_cells_count_all_rows(spark, monkeypatch):
    """F8: cuts are ranks among all rows of the other groups, cells hold every row, and neither depends on the layout."""
    monkeypatch.setattr(ML, "CHUNK_ROWS", 500)
    rows, cuts, cells = _cells(spark, 3)
    exp = {}
    for held in "ab":
        x = np.sort([r[0] for r in rows if r[2] != held])
        v, c = np.unique(x, return_counts=True)
        hi = c.cumsum()
        cut = v[((hi - c) * ML.BINS // len(x) < hi * ML.BINS // len(x)) & (hi < len(x))]
        assert cuts[held][0].tolist() == cut.tolist() and len(cut) == ML.BINS - 1
        assert cuts[held][1].tolist() == [0.0, 1.0, 2.0, 3.0, 4.0]      # missing values come last
        for xv, yv, k, lab, cls in rows:
            if k != held and lab is None:
                continue
            cell = int(np.searchsorted(cut, xv)) * ML.BINS + (5 if yv is None else int(yv))
            key = (held, k == held, 0 if k == held else lab, cls if k == held else 0, cell)
            exp[key] = exp.get(key, 0) + 1
    assert cells == exp
    _, again, same = _cells(spark, 7)
    assert same == cells and all(a.tolist() == b.tolist() for h in cuts for a, b in zip(cuts[h], again[h]))


def test_trees_on_cells():
    """F8: a tree on counted cells finds the split of the rows, whatever their number; draws of a cell have the law of those of its rows."""
    g = np.random.default_rng(1)
    bins = np.stack(np.meshgrid(np.arange(8), np.arange(8)), -1).reshape(-1, 2)
    label = ((bins[:, 0] > 4) ^ (bins[:, 1] > 2)).astype(np.int64)
    trees = [ML.grow_tree(bins, label, np.full(64, 50), 2, 4, np.random.default_rng([0, t])) for t in range(15)]
    assert (ML.forest_votes(bins, trees).argmax(1) == label).all()
    # one class only, or no rows drawn: a leaf
    f, _, share = ML.grow_tree(bins, np.zeros(64, np.int64), np.full(64, 5), 2, 4, g)
    assert (f == -1).all() and share[0].tolist() == [1.0, 0.0]
    assert (ML.grow_tree(bins, label, np.zeros(64, np.int64), 2, 4, g)[0] == -1).all()
    # classes weigh the same however many rows they have
    one, y = np.zeros((2, 1), np.int64), np.array([0, 1])
    share = np.mean([ML.grow_tree(one, y, np.array([10 ** 6, 100]), 2, 1, np.random.default_rng([3, t]))[2][0] for t in range(200)], 0)
    assert share == pytest.approx([0.5, 0.5], abs=0.02)


def test_cells_of_a_variogram_are_not_sent_to_every_pair(spark, monkeypatch):
    """what reaches the tasks grows with the cells and the groups, not with the pairs of nodes."""
    from flotsam.config import VARIOGRAM_EDGES
    from flotsam.operators import fusion as FU

    def sent(*_, **__):
        def run(batches):
            for b in batches:
                n = sum(len(c.flatten()) for c in b.columns if pa.types.is_list(c.type) and pa.types.is_struct(c.type.value_type))
                yield pa.RecordBatch.from_arrays([pa.array([8]), pa.array([float(n)]), pa.array([0.0]), pa.array([0.0])], ["bin", "pairs", "h", "half"])
        return run

    monkeypatch.setattr(FU, "LEAF_CELLS", 20)
    monkeypatch.setattr(FU, "_cell_pairs", sent)
    g = np.random.default_rng(6)
    n = 2000
    df = spark.createDataFrame(pd.DataFrame({"lon": 30 + g.uniform(0, 9, n), "lat": 43 + g.uniform(0, 9, n), "t_day": g.uniform(0, 9, n), "resid": g.normal(size=n)}))
    got = {r.h_lo: r.n_pairs for r in FU.variogram(df, 40.0, VARIOGRAM_EDGES, deg=1e-3, days=1e-2).collect()}
    assert n <= got[2500.0] <= 3 * n * (8 + 1)


@pytest.mark.parametrize("groups", [1, 3])
def test_squares_of_a_variogram_meet_every_pair_once(spark, monkeypatch, groups):
    """with any number of groups, nodes of several levels and nodes that meet themselves, all pairs are counted once."""
    from flotsam.operators import fusion as FU
    monkeypatch.setattr(FU, "LEAF_CELLS", 6)
    monkeypatch.setattr(FU, "GROUPS", groups)
    g = np.random.default_rng(9)
    n = 300
    lon, lat, t, r = 30 + g.uniform(0, 2, n) ** 3, 43 + g.uniform(0, 2, n), g.uniform(0, 3, n), g.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"lon": lon, "lat": lat, "t_day": t, "resid": r}))
    edges = (0, 15, 30, 60, 120, 250, 20000)
    got = FU.variogram(df, 40.0, edges, deg=1e-3, days=1e-2).toPandas().sort_values("h_lo")
    i, j = np.triu_indices(n, 1)
    a, b = np.radians(lat[i]), np.radians(lat[j])
    d = 2 * 6371.0 * np.arcsin(np.sqrt(np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon[j] - lon[i]) / 2) ** 2))
    h, half = np.sqrt(d ** 2 + (40 * (t[i] - t[j])) ** 2), 0.5 * (r[i] - r[j]) ** 2
    place = np.searchsorted(edges, h, "right") - 1
    assert got.n_pairs.tolist() == np.bincount(place, minlength=6).tolist()
    assert got.gamma.to_numpy() == pytest.approx(np.bincount(place, half) / np.bincount(place), rel=1e-6)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ml17_fusion", "ml17_contributions"])
def test_evidence_is_weighed_where_it_was_found(spark, sf, name):
    """no evidence passes a shuffle between the search and its weights."""
    from flotsam.plans import catalog  # noqa: F401
    from flotsam.plans.registry import QUERIES
    plan = _plan(QUERIES[name](spark, sf))
    assert "collect_list(struct(rank_no" not in plan and plan.count("MapInArrow") == 2
    weigh, search = (plan.index("MapInArrow"), plan.rindex("MapInArrow"))
    assert "Exchange" not in plan[weigh:search] and (name == "ml17_fusion" or "Exchange" not in plan[:search])


def test_weights_with_and_without_evidence(spark, monkeypatch):
    """sums, arrays and single weights of a target are the same, over the borders of batches, for events among events too."""
    from flotsam.operators import fusion as FU
    par = dict(psill=0.6, nugget=0.5, micro=0.35, range_km=15.0, v_km_day=20.0)
    q = dict(q80=(-0.9, 0.8), q95=(-1.6, 1.5))
    g = np.random.default_rng(2)
    n = 600
    df = spark.createDataFrame(pd.DataFrame({"event_id": np.arange(n), "lon": 30 + g.uniform(0, 1, n), "lat": 43 + g.uniform(0, 1, n), "t_day": g.uniform(0, 9, n), "resid": g.normal(size=n),
                                             "meas_var": g.uniform(0, 1, n), "u": g.integers(0, 9, n)}))
    t = df.select("lon", "lat", "t_day", F.col("event_id").alias("tid"), F.when(F.col("event_id") % 10 > 0, 100.0).alias("model_value"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        full = FU.fuse(t, df, qid="tid", value="model_value", **par, **q)
        rows = {r.tid: r for r in full.collect()}
        bare = {r.tid: r for r in FU.fuse(t, df, qid="tid", value="model_value", evidence=False, **par, **q).collect()}
        assert len(rows) == len(bare) == 540
        for i, r in bare.items():
            w = rows[i]
            assert (r.fused, r.lo80, r.hi95, r.n_evidence, r.field_weight) == (w.fused, w.lo80, w.hi95, len(w.ev), w.field_weight)
            assert [x.rank_no for x in w.ev] == list(range(1, r.n_evidence + 1)) and len(w.weights) == r.n_evidence
        exp = {(r.tid, r.event_id): (r.st_distance_km, r.weight, r.model_factor) for r in FU.contributions(full, "tid", 20.0).collect()}
        got = {(r.tid, r.event_id): (r.st_distance_km, r.weight, r.model_factor) for r in FU.contributions_of(t, df, qid="tid", value="model_value", **par).collect()}
        assert got == exp and len(got) > 1000
        other = FU.fuse(df.withColumn("model_value", F.lit(100.0)), df, qid="event_id", value="model_value", exclude=("u", "u"), **par, **q)
        group = {r.event_id: r.u for r in df.collect()}
        assert all(group[e.event_id] != r.u for r in other.collect() for e in r.ev)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs_are_searched_once(spark, sf):
    """events without a scene come out of the one search; nothing is searched or shuffled again for them."""
    from flotsam.plans import catalog  # noqa: F401
    from flotsam.plans.registry import QUERIES
    plan = _plan(QUERIES["dq2_build_pairs"](spark, sf))
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan[:plan.rindex("MapInArrow")]


def test_every_event_of_a_preferring_search(spark, monkeypatch):
    """all preferred scenes of an event, else its first scene, else nulls; events in cells without scenes or without a box too."""
    from flotsam.sources import registry as reg
    monkeypatch.setattr(reg, "MET_AT_ONCE", 40)
    g = np.random.default_rng(5)
    ev = [(i, *[float(x) for x in (a, a + 0.1, b, b + 0.1)], 10) for i, (a, b) in enumerate(g.uniform(0, 4, (60, 2)))]
    ev += [(60, 50.0, 50.1, 50.0, 50.1, 10), (61, None, 1.0, 1.0, 1.1, 10), (62, 1.0, 1.1, 1.0, 1.1, None), (63, 1.0, 1.1, 1.0, 1.1, 400)]
    sc = [(i, float(i * 7 % 13), float(a), float(a + 0.6), float(b), float(b + 0.6), 9 + i % 4, None if i % 9 == 0 else "ab"[i % 3 == 0]) for i, (a, b) in enumerate(g.uniform(0, 4, (40, 2)))]
    e = spark.createDataFrame(ev, "event_id int, ex0 double, ex1 double, ey0 double, ey1 double, e_day int")
    s = spark.createDataFrame(sc, "scene_no int, scene_t_s double, sx0 double, sx1 double, sy0 double, sy1 double, s_day int, kind string")
    got = {}
    for r in reg.catalogue_search(e, s, 1, prefer=("kind", "b")).collect():
        got.setdefault(r.event_id, []).append((r.scene_no, r.seq))
    kinds = set()
    for i, x0, x1, y0, y1, day in ev:
        met = sorted((t, n, k) for n, t, a0, a1, b0, b1, d, k in sc if None not in (x0, day) and abs(d - day) <= 1 and x0 <= a1 and a0 <= x1 and y0 <= b1 and b0 <= y1)
        hits = [(n, q + 1) for q, (_, n, _) in enumerate(met)]
        exp = [h for h, m in zip(hits, met) if m[2] == "b"] or hits[:1] or [(None, 0)]
        kinds.add(0 if not hits else 1 + any(m[2] == "b" for m in met))
        assert got[i] == exp
    assert kinds == {0, 1, 2} and len(got) == 64


@pytest.mark.parametrize("kind,v", [("sphere", 20.0), ("sphere", None), ("plane", None), ("plane", 3.0)])
def test_vectors_bound_the_distance(kind, v):
    """squared distances of the vectors are never above the true ones, and not below them by more than the stretch."""
    from flotsam.operators.neighbours import Metric
    g = np.random.default_rng(3)
    m = Metric(kind, v)
    for width in (0.1, 10.0, 170.0):
        q, r = ({"x": g.uniform(-width, width, 80), "y": g.uniform(-width / 2, width / 2, 80), "t": g.uniform(0, 30, 80)} for _ in range(2))
        d2 = m.matrix(q, r) ** 2
        low = ((m.vectors(q)[:, None] - m.vectors(r)[None]) ** 2).sum(2)
        assert (low <= d2 * (1 + 1e-9) + 1e-6).all() and (d2 <= low * m.stretch(low.max()) * (1 + 1e-9) + 1e-6).all()
