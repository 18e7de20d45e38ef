"""Steps that once met a whole star, image or group in one task, with limits small enough to be reached."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from flotsam.operators import components as C


def smallest(edges):
    up = {x: x for e in edges for x in e}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("few", [0, 1 << 17])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components_of_hubs_in_small_chunks(spark, monkeypatch, few, kind):
    """wide stars are met by broadcast, chunks end anywhere, the result is that of the whole."""
    monkeypatch.setattr(C, "CHUNK", 16)
    monkeypatch.setattr(C, "WIDE", 8)
    monkeypatch.setattr(C, "FEW", few)
    g = np.random.default_rng(2)
    e = [(1000, i) for i in range(1001, 1120)] + [(i, 1500) for i in range(1400, 1460)] + [(1119, 1459)]
    e += [(2000 + i, 2001 + i) for i in range(40)] + [(int(a), int(b)) for a, b in g.integers(3000, 3400, (300, 2)) if a != b]
    df = spark.createDataFrame(e, "a bigint, b bigint").select(*[F.col(c).cast(kind) for c in "ab"])
    got = C.connected_components(df).collect()
    assert len(got) == len({r.node for r in got})
    assert {int(r.node): int(r.component) for r in got} == smallest(e)


@pytest.mark.parametrize("product", [0, 16])
def test_groups_without_finding_every_link(spark, monkeypatch, product):
    """groups from decided boxes first are those of all links."""
    monkeypatch.setattr(C, "PRODUCT", product)
    g = np.random.default_rng(3)
    n = 400
    ev = spark.createDataFrame([(i, f"S{g.integers(0, 60)}", int(g.integers(0, 40)), float(30 + g.uniform(0, 5)), float(42 + g.uniform(0, 3))) for i in range(n)],
                               "event_id bigint, source_id string, day bigint, lon double, lat double")
    got = {r.event_id: r.component for r in C.group_events(ev, 30.0, 1).collect()}
    exp = {r.event_id: r.component for r in C.label_events(*C.link_graph(ev, 30.0, 1)).collect()}
    assert len(got) == n and got == exp


def test_quantiles_of_small_and_large_groups(spark, monkeypatch):
    """groups that fit an array and groups that are ranked have the same quantiles."""
    from flotsam.operators import ranking as R
    monkeypatch.setattr(R, "SMALL", 40)
    g = np.random.default_rng(4)
    rows = [(int(k), float(v)) for k, v in zip(np.r_[np.zeros(300), g.integers(1, 30, 400)], np.round(g.normal(size=700), 2))]
    got = {r.k: (r.a, r.b) for r in R.exact_quantiles(spark.createDataFrame(rows, "k bigint, v double"), ["k"], "v", {"a": 0.5, "b": 0.9}).collect()}
    for k in {k for k, _ in rows}:
        assert got[k] == pytest.approx(tuple(np.quantile([v for q, v in rows if q == k], p) for p in (0.5, 0.9)))


def test_folds_are_plain_arithmetic(spark):
    """no search per group; many equal groups after uneven ones, as by the greedy rule."""
    import heapq

    from flotsam.plans import splits as SP
    sizes = {i: n for i, n in enumerate([97, 60, 13, 13, 7] + [3] * 400 + [1] * 700)}
    df = spark.createDataFrame(list(sizes.items()), "group_no bigint, n_events bigint")
    plan = SP.assign_folds(df, 5)
    heap, exp = [(0, f) for f in range(5)], {}
    for size, group in sorted((-n, i) for i, n in sizes.items()):
        load, exp[group] = heapq.heappop(heap)
        heapq.heappush(heap, (load - size, exp[group]))
    assert {r.group_no: r.fold for r in plan.collect()} == exp
    assert "sequence(1, 62" not in plan._jdf.queryExecution().analyzed().toString()


def test_capped_distances_in_short_strips(spark, monkeypatch):
    """strips end within the image; up to the limit the distances are those of the whole image, beyond it null."""
    from flotsam.operators import raster as RA
    monkeypatch.setattr(RA, "ROWS", 16)
    g = np.random.default_rng(6)
    land = g.random((150, 7)) < 0.01
    land[40:90] = False
    px = spark.createDataFrame([(0, r, c, bool(land[r, c])) for r in range(150) for c in range(7)], "im int, row int, col int, land boolean")
    got = RA.distance_transform(RA.with_size(px, ["im"]), ["im"], {"d": F.col("land")}, cap=8).collect()
    at = np.argwhere(land)
    assert len(got) == land.size
    for r in got:
        d = ((at - (r.row, r.col)) ** 2).sum(1).min()
        assert r.d == (d if d <= 64 else None)


def test_large_components_stay_where_they_are(spark, monkeypatch):
    """F32: components above and below the limit of one task are both kept or dropped by their size."""
    from flotsam.operators import raster as RA
    monkeypatch.setattr(RA, "WIDE", 10)
    px = [(0, 0, c) for c in range(30)] + [(0, 5, c) for c in range(5)] + [(0, 9, c) for c in range(2)] + [(1, 0, 0)]
    got = RA.drop_small(spark.createDataFrame(px, "im int, row int, col int"), ["im"], 4).collect()
    assert sorted((r.im, r.row, r.col) for r in got) == px[:35]
