"""Registered queries against their oracles on the smallest tables (``FLOTSAM_ALL=1`` adds the slow ones)."""
import os

import pytest

import __spark_entry__ as E
from flotsam.plans.registry import QUERIES
from oracle_check import compare, connect

SLOW = ("join2", "join3", "join4", "join9", "join10", "join11", "join12", "join17", "agg31", "ml", "win1_", "win5", "win6", "win7", "win10", "win11", "win16_", "win18", "win19",
        "dq5", "dq16", "dq11_hex", "dq13", "split1", "split4", "agg20", "cc1", "dq3", "exp3_")
NO_SQL = {"ml5_count_regression", "ml13_forest_report", "ml13_forest_confusion", "ml13_forest_debris_ap", "ml14_batch_scoring", "ml16_leave_region_out", "ml17_fusion", "ml17_contributions", "ml20_fusion_check",
          "dq3_scene_masks"}         # checked against numpy in the other tests
# the training-data queries are compared in tests/llm
NAMES = [n for n in QUERIES if os.environ.get("FLOTSAM_ALL") or not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    verdict = compare(spark, duck, sf, name, E.queries()[name], E.oracle_sql().get(name))[0]
    assert verdict == ("rows" if name in NO_SQL else "ok")


def test_oracles_belong_to_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry(spark):
    assert E.entry(spark).count() > 0


def test_query_parameters_are_checked(spark, sf):
    from flotsam.fixtures import Views
    from flotsam.plans.queries import zones_query
    z = Views(spark, sf).fx_zone
    for bad in ({"sort": "size"}, {"limit": 0}, {"offset": -1}, {"bbox": (5, 5, 1, 1)}):
        with pytest.raises(ValueError):
            zones_query(z, **bad)
    a = [r.zone_no for r in zones_query(z, limit=5).collect()] + [r.zone_no for r in zones_query(z, limit=5, offset=5).collect()]
    assert a == [r.zone_no for r in zones_query(z, limit=10).collect()]


@pytest.mark.parametrize("sort", ["cover", "date", "p"])
def test_far_pages_are_sought(spark, sf, monkeypatch, sort):
    """Pages behind the threshold are those of the whole order, ties included; a page behind the end is empty."""
    from flotsam.fixtures import Views
    from flotsam.plans import queries as Q
    from pyspark.sql import functions as F
    z = Views(spark, sf).fx_zone.withColumns({"cover_m2": F.floor(F.col("cover_m2") / 20).cast("double"), "p_max": F.when(F.col("zone_no") % 5 != 0, F.round("p_max", 1))})
    whole = [r.zone_no for r in Q.zones_query(z, sort=sort, limit=10000).collect()]
    monkeypatch.setattr(Q, "SEEK_FROM", 1)
    for offset in (1, 40, 333, len(whole) - 3):
        assert [r.zone_no for r in Q.zones_query(z, sort=sort, limit=25, offset=offset).collect()] == whole[offset:offset + 25]
    assert Q.zones_query(z, sort=sort, limit=5, offset=len(whole)).count() == 0


def test_sinks(spark, tmp_path, sf):
    from flotsam.fixtures import Views
    from flotsam.sources import sinks
    z = Views(spark, sf).fx_zone.select("aoi_no", "date_utc", "zone_no", "cover_m2")
    sinks.write_partitioned(z, str(tmp_path / "p"), ("aoi_no", "date_utc"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == z.count()
    sinks.write_csv(z, str(tmp_path / "c"), ["zone_no", "missing", "cover_m2"])
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert back.columns == ["zone_no", "missing", "cover_m2"] and back.count() == z.count()
