import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flotsam.operators import components as C
from flotsam.operators import neighbours as N
from flotsam.operators import ranking as R


def hav(lon1, lat1, lon2, lat2):
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 6371.0 * 2 * np.arcsin(np.sqrt(a))


def points(n, seed, hot=0.3):
    """Points with a third of them in one spot and some around the antimeridian."""
    g = np.random.default_rng(seed)
    lon, lat = g.uniform(-180, 180, n), g.uniform(-80, 80, n)
    m = int(n * hot)
    lon[:m], lat[:m] = 30.0, 43.0
    lon[m:2 * m] = 30 + g.normal(0, 0.3, m)
    lat[m:2 * m] = 43 + g.normal(0, 0.3, m)
    return lon, lat


@pytest.mark.parametrize("k", [1, 8])
def test_nearest_matches_brute_force(spark, k):
    qx, qy = points(150, 1)
    rx, ry = points(900, 2)
    q = spark.createDataFrame(pd.DataFrame({"qid": range(150), "lon": qx, "lat": qy}))
    r = spark.createDataFrame(pd.DataFrame({"rid": range(900), "lon": rx, "lat": ry}))
    got = N.nearest(q, r, qid="qid", rid="rid", k=k).toPandas().sort_values(["qid", "rank_no"])
    d = hav(qx[:, None], qy[:, None], rx[None], ry[None])
    exp = np.sort(d, 1)[:, :k].ravel()
    assert len(got) == 150 * k
    assert np.allclose(got["dist"], exp, atol=1e-6)


def test_nearest_in_space_and_time_without_own_group(spark):
    g = np.random.default_rng(3)
    n = 400
    x, y = points(n, 4)
    t, grp = g.uniform(0, 30, n), np.where(np.arange(n) < 130, 0, g.integers(1, 40, n))
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "lon": x, "lat": y, "t": t, "g": grp}))
    got = N.nearest(df, df.withColumnsRenamed({"id": "rid"}), qid="id", rid="rid", k=5, q_t="t", r_t="t",
                    metric=N.Metric(v=20.0), exclude=("g", "g")).toPandas().sort_values(["id", "rank_no"])
    h = np.sqrt(hav(x[:, None], y[:, None], x[None], y[None]) ** 2 + (20 * np.abs(t[:, None] - t[None])) ** 2)
    h[grp[:, None] == grp[None]] = np.inf
    assert np.allclose(got["dist"], np.sort(h, 1)[:, :5].ravel(), atol=1e-6)


def test_within_radius_matches_brute_force(spark):
    ax, ay = points(300, 5)
    bx, by = points(300, 6)
    a = spark.createDataFrame(pd.DataFrame({"a": range(300), "ax": ax, "ay": ay, "da": np.arange(300) % 20}))
    b = spark.createDataFrame(pd.DataFrame({"b": range(300), "bx": bx, "by": by, "db": np.arange(300) % 25}))
    got = N.within_radius(a, b, 25.0, l_xy=("ax", "ay"), r_xy=("bx", "by"), days=("da", "db", 3))
    d = hav(ax[:, None], ay[:, None], bx[None], by[None])
    dd = np.abs((np.arange(300) % 20)[:, None] - (np.arange(300) % 25)[None])
    exp = {(i, j) for i, j in zip(*np.nonzero((d <= 25) & (dd <= 3)))}
    rows = [(r["a"], r["b"]) for r in got.select("a", "b").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == exp


def union_find(n, pairs):
    p = list(range(n))

    def f(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i
    for a, b in pairs:
        p[max(f(a), f(b))] = min(f(a), f(b))
    return [f(i) for i in range(n)]


def test_components(spark):
    g = np.random.default_rng(0)
    e = [(i, i + 1) for i in range(0, 60)] + [(int(a), int(b)) for a, b in g.integers(100, 300, (120, 2))]
    got = {r["node"]: r["component"] for r in C.connected_components(spark.createDataFrame(e, "a int, b int")).collect()}
    exp = union_find(300, e)
    assert all(exp[k] == v for k, v in got.items())
    assert set(got) == {x for a, b in e for x in (a, b) if a != b}


def test_link_components_match_pairwise_rule(spark):
    g = np.random.default_rng(9)
    n = 260
    lon, lat = 30 + g.uniform(0, 6, n), 42 + g.uniform(0, 4, n)
    lon[:80], lat[:80] = 31.0, 43.0
    day, src = g.integers(0, 60, n), g.integers(0, 12, n)
    ev = spark.createDataFrame(pd.DataFrame({"event_id": range(n), "lon": lon, "lat": lat, "day": day,
                                             "source_id": [f"S{s}" for s in src]}))
    cells, links = C.link_graph(ev, 30.0, 3)
    got = {r["event_id"]: r["component"] for r in C.label_events(cells, links).collect()}
    d = hav(lon[:, None], lat[:, None], lon[None], lat[None])
    adj = ((day[:, None] == day[None]) & (src[:, None] == src[None])) | ((d < 30) & (abs(day[:, None] - day[None]) <= 3))
    exp = union_find(n, [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(adj, 1)))])
    a, b = {}, {}
    for i in range(n):
        a.setdefault(got[i], set()).add(i)
        b.setdefault(exp[i], set()).add(i)
    assert {frozenset(s) for s in a.values()} == {frozenset(s) for s in b.values()}


def test_quantiles_and_ranks(spark):
    g = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": g.integers(0, 3, 500), "v": np.round(g.normal(size=500), 1)})
    df = spark.createDataFrame(pdf)
    got = {r["k"]: (r["a"], r["b"]) for r in R.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.05}).collect()}
    for k, grp in pdf.groupby("k"):
        assert got[k] == pytest.approx((np.quantile(grp.v, 0.5), np.quantile(grp.v, 0.05)))
    ranks = R.average_ranks(df, ["k"], "v", "r").toPandas()
    exp = pdf.assign(r=pdf.groupby("k").v.rank()).drop_duplicates(["k", "v"])
    m = ranks.merge(exp, on=["k", "v"])
    assert len(m) == len(exp) and np.allclose(m.r_x, m.r_y)
    got = R.top_k(df.withColumn("id", F.monotonically_increasing_id()), ["k"], [F.col("v").desc(), F.col("id")], 4).toPandas()
    assert sorted(got.v) == sorted(pdf.groupby("k").v.nlargest(4))


def test_quantiles_of_large_groups_with_a_narrow_first_look(spark, monkeypatch):
    """Brackets of the sketch must not change the result, also when they miss."""
    g = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": g.integers(0, 2, 20000), "v": np.round(g.normal(size=20000), 3)})
    df = spark.createDataFrame(pdf)
    for sketch in (10000, 50):
        monkeypatch.setattr(R, "SKETCH", sketch)
        got = {r["k"]: (r["a"], r["b"], r["c"]) for r in R.exact_quantiles(df, ["k"], "v", {"a": 0.5, "b": 0.013, "c": 1.0}).collect()}
        for k, grp in pdf.groupby("k"):
            assert got[k] == pytest.approx((np.quantile(grp.v, 0.5), np.quantile(grp.v, 0.013), grp.v.max()))
