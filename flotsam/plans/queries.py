"""Summaries and the filtered, sorted, paged query surface."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flotsam.config import CONCENTRATION_STATUS, DENSITY_UNIT, DETECTION_STATUS, HEX_EXPORT_COLUMNS
from flotsam.functions.density import wilson
from flotsam.functions.status import key_of, label_of, label_of_key
from flotsam.operators.ranking import exact_quantiles, global_rank, order_statistics, top_k

OUTCOME_RANK = ("accepted", "context", "rejected")


def event_outcome(pairs: DataFrame, *keys: str) -> DataFrame:
    """Best decision per event: accepted before context before rejected."""
    rank = F.when(F.col("decision") == "accepted", 0).when(F.col("decision") == "context", 1).otherwise(2)
    g = pairs.groupBy(*keys).agg(F.min(rank).alias("_r"))
    return g.withColumn("outcome", F.element_at(F.array(*[F.lit(o) for o in OUTCOME_RANK]), F.col("_r") + 1)).drop("_r")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Counts by reason, accepted profile and tier, source without scenes, and distinct scenes per collection."""
    sets = F.array_compact(F.array(
        F.struct(F.lit("reason").alias("kind"), F.col("reason_code").alias("name")),
        F.when(F.col("decision") == "accepted", F.struct(F.lit("accepted_tier").alias("kind"), F.concat_ws("/", "profile", "sync_tier").alias("name"))),
        F.when(F.col("reason_code") == "NO_SCENE", F.struct(F.lit("no_scene_source").alias("kind"), F.col("source_id").alias("name")))))
    counts = pairs.select(F.explode(sets).alias("s")).groupBy("s.kind", "s.name").agg(F.count(F.lit(1)).alias("n"))
    scenes = (pairs.where("scene_id is not null").groupBy(F.lit("scenes").alias("kind"), F.col("collection").alias("name"))
              .agg(F.count_distinct("scene_id").alias("n")))
    return counts.unionByName(scenes)


def cell_candidates(points: DataFrame, keys: list[str], cell: str, weight: str, k: int) -> DataFrame:
    """Largest cells by summed weight with their weighted centre."""
    w = F.col(weight) + 1e-6
    g = points.groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("area_m2"),
                                        (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"))
    return top_k(g, keys, [F.col("area_m2").desc(), F.col(cell)], k, "_r", salt_on=cell).drop("_r")


def source_overview(registry: DataFrame, is_measurement: Column, pairs: DataFrame) -> DataFrame:
    """Rows, events, measurements, period, extent and pairing outcome of every source."""
    base = registry.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event").alias("n_events"), F.count_if(is_measurement).alias("n_measurements"),
        F.min("date_utc").alias("date_from"), F.max("date_utc").alias("date_to"),
        *[F.round(f(c), 4).alias(n) for c, f, n in (("lon", F.min, "x0"), ("lat", F.min, "y0"), ("lon", F.max, "x1"), ("lat", F.max, "y1"))])
    out = event_outcome(pairs, "source_id", "event").groupBy("source_id").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOME_RANK])
    return base.join(out, "source_id", "left")


def report_kpis(zones: DataFrame, cube: DataFrame, keys: list[str]) -> DataFrame:
    z = zones.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_zones"), F.sum("cover_m2").alias("total_cover_m2"))
    h = cube.groupBy(*keys).agg(*[F.count_if(F.col("status") == c).alias(n) for c, n in ((1, "hexes_detected"), (0, "hexes_clear"), (2, "hexes_unknown"))])
    return z.join(exact_quantiles(zones, keys, "cover_m2", {"median_cover": 0.5}), keys).join(h, keys, "left")


def review_score(rows: DataFrame, keys: list[str], wrong: tuple[str, ...]) -> DataFrame:
    """Local precision, kinds of false alarms and misses among the controls, with score intervals."""
    det = F.col("is_detection")
    g = rows.where("label is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("labelled"), F.count_if(det).alias("n_det"), F.count_if(~det).alias("n_ctl"),
        F.count_if(det & (F.col("label") == "debris")).alias("tp"), F.count_if(~det & (F.col("label") == "debris")).alias("missed"),
        *[F.count_if(det & (F.col("label") == w)).alias(f"fp_{w}") for w in wrong])
    lo, hi = wilson(F.col("tp"), F.col("n_det"))
    mlo, mhi = wilson(F.col("missed"), F.col("n_ctl"))
    return g.withColumns({"precision_local": F.try_divide("tp", "n_det"), "precision_lo": lo, "precision_hi": hi, "missed_lo": mlo, "missed_hi": mhi})


def dense_endmember(debris: DataFrame, keys: list[str], fdi: str, bands: list[str]) -> DataFrame:
    """Mean spectrum of the debris pixels at or above the 99th percentile of the index."""
    t = exact_quantiles(debris, keys, fdi, {"_t": 0.99})
    return debris.join(t, keys).where(F.col(fdi) >= F.col("_t")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(b).alias(b) for b in bands])


def footprint_features(px: DataFrame, keys: list[str]) -> DataFrame:
    """Detector features inside a footprint from its valid pixels."""
    km2 = F.greatest(F.count(F.lit(1)) * 1e-4, F.lit(1e-9))
    det = F.count_if("det")
    g = px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("valid_px"), det.alias("det_px"), (det / F.count(F.lit(1))).alias("det_frac"), (det / km2).alias("det_per_km2"),
        F.avg("anomaly").alias("anomaly_mean"), (F.sum(F.when(F.col("det"), F.col("frac") * 100).otherwise(F.lit(0.0))) / km2).alias("cover_m2_km2"))
    return g.join(exact_quantiles(px, keys, "p", {"p95": 0.95}), keys)


def footprint_quality(px: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, sea, clear water, cloud and glint of a footprint (scene class 0 means no data)."""
    has, marine = F.col("scl") != 0, F.col("marine")
    clear = has & marine & (F.col("scl") == 6)
    sea = F.greatest(F.count_if(has & marine), F.lit(1))
    g = px.groupBy(*keys).agg(
        (F.count_if(has) / F.count(F.lit(1))).alias("footprint_coverage"), F.count_if(has & marine).alias("marine_px"),
        (F.count_if(clear) / sea).alias("clear_water_frac"), (F.count_if(marine & F.col("scl").isin(8, 9, 10)) / sea).alias("cloud_frac"),
        (F.count_if(~marine) / F.count(F.lit(1))).alias("land_frac"), F.count_if(clear).alias("n_valid_px"))
    return g.join(exact_quantiles(px.where(clear), keys, "b11", {"glint_b11": 0.5}), keys, "left")


def scene_wind_max(scenes: DataFrame, wind: DataFrame, on: list[str], key: Callable[[Column, Column], dict[str, Column]]) -> DataFrame:
    """Strongest wind over a 3×3 lattice of the scene box at the overpass time."""
    pts = F.explode(F.array(*[F.struct((F.col("lon0") + (F.col("lon1") - F.col("lon0")) * (i / 2)).alias("x"),
                                       (F.col("lat0") + (F.col("lat1") - F.col("lat0")) * (j / 2)).alias("y")) for i in range(3) for j in range(3)]))
    lat = scenes.select("scene_no", *on, pts.alias("p")).withColumns(key(F.col("p.x"), F.col("p.y")))
    return (lat.join(wind, [*on, *key(F.lit(0), F.lit(0))]).groupBy("scene_no").agg(F.round(F.max("w"), 1).alias("wind_max")))


def pooled_fp_share(rates: DataFrame, keys: list[str], classes: tuple[int, ...]) -> DataFrame:
    return rates.where(F.col("cl").isin(*classes)).groupBy(*keys).agg((F.sum("fp_raw") / F.sum("class_px")).alias("fp_share"))


def metric_mismatches(now: DataFrame, saved: DataFrame, keys: list[str], tolerance: dict[str, float]) -> DataFrame:
    """Metrics that differ from the saved ones by more than their tolerance."""
    s = saved.select(*keys, *[F.col(m).alias(f"_s_{m}") for m in tolerance])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("now"), F.col(f"_s_{m}").alias("saved"), F.lit(t).alias("tol")) for m, t in tolerance.items()])
    j = now.join(s, keys, "full_outer").select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return j.where(F.coalesce(F.abs(F.col("now") - F.col("saved")) > F.col("tol"), F.lit(True))).drop("tol")


# ---- zones, field and hex queries ----------------------------------------------------------------------------------

SORTS = ("cover", "date", "p")


def _box(df: DataFrame, box) -> DataFrame:
    if box is None:
        return df
    if len(box) != 4 or not (box[0] < box[2] and box[1] < box[3]):
        raise ValueError("bbox: lon_min, lat_min, lon_max, lat_max")
    return df.where(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))


def zones_query(zones: DataFrame, *, aois=None, date=None, date_from=None, date_to=None, bbox=None, min_cover: float = 0.0,
                reliable_only: bool = False, sort: str = "cover", limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of the zones that pass the filters, in a fixed order, with the number of all of them (``total``).

    Filters come first and reach the scan; the total is its own small aggregation. A page far behind is sought by the
    rank of its first row, so no task keeps the rows before it.
    """
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    if not (1 <= limit <= 10000 and offset >= 0 and min_cover >= 0):
        raise ValueError("limit 1..10000, offset and min_cover not negative")
    z = zones
    if aois is not None:
        z = z.where(F.col("aoi_no").isin(*aois))
    for op, v in (("=", date), (">=", date_from), ("<=", date_to)):
        if v is not None:
            day = F.lit(v).cast("date")
            z = z.where({"=": F.col("date_utc") == day, ">=": F.col("date_utc") >= day, "<=": F.col("date_utc") <= day}[op])
    z = _box(z, bbox)
    if min_cover > 0:
        z = z.where(F.coalesce("cover_m2", F.lit(0.0)) >= min_cover)
    if reliable_only:
        z = z.where(F.coalesce("scene_reliable", F.lit(True)))
    # ascending numbers whose order is the order of the rows
    cover, p, day = -F.coalesce("cover_m2", F.lit(0.0)), -F.coalesce("p_max", F.lit(0.0)), -F.unix_date("date_utc").cast("double")
    keys = [*{"cover": [], "date": [day], "p": [p]}[sort], cover, F.col("zone_no").cast("double")]
    total = z.agg(F.count(F.lit(1))).scalar()
    page, skip = (z, offset) if offset < SEEK_FROM else seek(z, keys, offset)
    return page.orderBy(*keys).offset(skip).limit(limit).withColumn("total", total)


SEEK_FROM = 10_000      # rows before a page from which on it is sought


def seek(df: DataFrame, keys: list[Column], offset: int) -> tuple[DataFrame, int]:
    """The rows from the ``offset``-th on (0-based) in the order of ``keys``, and how many equal ones of these come before it.

    ``keys``: ascending numbers, not null. Key by key the value at the wanted rank is found among the rows that tie on the
    keys before (exactly, by a sketch that brackets it and a count); what sorts before it is never ordered.
    """
    tied, behind = F.lit(True), F.lit(False)
    for key in keys:
        among = df.where(tied).select(F.lit(1).alias("_all"), key.alias("_v"))
        n = among.count()
        if offset >= n:
            return df.limit(0), 0
        v = order_statistics(among, ["_all"], "_v", {"v": ((offset + 1) / max(n, 1), F.lit(offset))}).first()["v"]
        offset -= among.where(F.col("_v") < v).count()
        behind = behind | (tied & (key > v))
        tied = tied & (key == v)
    return df.where(behind | tied), offset


def field_query(events: DataFrame, *, profile: str | None = None, bbox=None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Field measurements by profile, box and inclusive dates; an empty result is valid."""
    e = events if profile is None else events.where(F.col("profile") == profile)
    if date_from:
        e = e.where(F.col("date_utc") >= F.lit(date_from).cast("date"))
    if date_to:
        e = e.where(F.col("date_utc") <= F.lit(date_to).cast("date"))
    return _box(e, bbox)


def event_details(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """All that is known about every event as flat lines: registry decisions, measurements with formula, pairs."""
    dec = rows.select("event_id", F.lit("row").alias("section"), F.concat_ws(" ", "decision", "sel_profile", "sel_role", "reason_code").alias("text"))
    formula = F.when(F.col("n_items").isNotNull(), F.format_string("C = N / A = %d / %.2f = %.2f", F.col("n_items"), F.col("area_km2"), F.col("conc"))).otherwise(
        F.format_string("C = %.2f published", F.col("conc")))
    mea = rows.where("decision = 'included'").select("event_id", F.lit("measurement").alias("section"), formula.alias("text"))
    prs = pairs.select("event_id", F.lit("pair").alias("section"), F.concat_ws(" ", F.coalesce(F.col("scene_no").cast("string"), F.lit("none")), "decision", "reason_code").alias("text"))
    return dec.unionByName(mea).unionByName(prs)


def zone_export(zones: DataFrame, profile: str, columns: tuple[str, ...]) -> DataFrame:
    """Zones in the fixed export columns; values of the chosen profile come from its ``conc_<profile>_*`` columns."""
    src = {"conc_items_km2": f"conc_{profile}_items_km2", "conc_status": f"conc_{profile}_status", "conc_status_ru": f"conc_{profile}_status_ru",
           "conc_reasons": f"conc_{profile}_reasons", "model_version": f"conc_{profile}_model", **{f"conc_{b}": f"conc_{profile}_{b}" for b in ("lo80", "hi80", "lo95", "hi95")}}
    z = zones.withColumn("profile", F.lit(profile))
    return z.select(*[(F.col(src.get(c, c)) if src.get(c, c) in z.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def zoom_clusters(zones: DataFrame, keys: list[str], zoom: int, radius_px: float = 40.0) -> DataFrame:
    """Zone points gathered by the map grid of a zoom level: number, summed cover and mean place."""
    world = 256.0 * 2 ** zoom
    x = (F.col("lon") + 180) / 360 * world
    s = F.sin(F.radians("lat"))
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * world
    return zones.groupBy(*keys, F.floor(x / radius_px).alias("gx"), F.floor(y / radius_px).alias("gy")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cover_m2").alias("cover_m2"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def hex_cards(cube: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Detection and density of every cell, date and profile side by side."""
    return cube.join(scored, keys, "left").withColumn("concentration_status", F.coalesce("status_conc", F.lit("unavailable")))


def hex_rows(cube: DataFrame, scored: DataFrame, area: list[str], keys: list[str]) -> DataFrame:
    """Rows of the hex export, one per cell, date and profile, with the export's fixed columns.

    ``cube``: ``keys`` (cell among them), aoi, date, scene_id, lon, lat, water_km2, valid_frac, status (code), ndet, cover;
    ``scored``: ``keys``, profile, value, lo80, hi80, status_conc, model_version. A cell's index is its place among
    the area's cells; a profile that is not available has no value and no interval.
    """
    cells = global_rank(cube.select(*area, "cell").distinct(), [*area, "cell"], "_r")
    first = cells.groupBy(*area).agg(F.min("_r").alias("_f"))
    at = cells.join(first, area).select(*area, "cell", (F.col("_r") - F.col("_f")).alias("hex_index"))
    row = hex_cards(cube, scored, keys).join(at, [*area, "cell"])
    known = F.col("concentration_status") != "unavailable"
    fields = {
        "h3": F.col("cell"), "detection_status": key_of(F.col("status"), DETECTION_STATUS), "detection_status_ru": label_of(F.col("status"), DETECTION_STATUS),
        "n_det_px": F.col("ndet"), "cover_m2_km2": F.col("cover"), "unit": F.lit(DENSITY_UNIT), "conc_items_km2": F.when(known, F.col("value")),
        "conc_lo80": F.when(known, F.col("lo80")), "conc_hi80": F.when(known, F.col("hi80")), "conc_status": F.col("concentration_status"),
        "conc_status_ru": label_of_key(F.col("concentration_status"), CONCENTRATION_STATUS)}
    return row.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in HEX_EXPORT_COLUMNS])


def separation_or_summary(scenes: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """Detailed rejection counts where they exist, otherwise what the scene summary still tells."""
    j = scenes.join(details.withColumn("_has", F.lit(True)), key, "left")
    has = F.coalesce("_has", F.lit(False))
    return j.select(key, has.alias("detail_available"), F.when(has, F.col("candidates")).otherwise(F.coalesce("n_raw", "n_det", F.lit(0))).alias("candidates"),
                    F.when(has, F.col("kept")).otherwise(F.coalesce("n_det", F.lit(0))).alias("kept"),
                    F.when(has, F.lit(0)).otherwise(F.greatest(F.coalesce("n_raw", "n_det", F.lit(0)) - F.coalesce("n_det", F.lit(0)), F.lit(0))).alias("details_unavailable"))


def area_info(scenes: DataFrame, zones: DataFrame, avail: DataFrame, key: str) -> DataFrame:
    """Scenes, period, cover and available profiles of every area."""
    s = scenes.groupBy(key).agg(F.count_distinct("date_utc").alias("n_dates"), F.min("date_utc").alias("first_date"), F.max("date_utc").alias("last_date"))
    z = zones.groupBy(key).agg(F.sum("cover_m2").alias("total_cover_m2"))
    a = avail.where("available").groupBy(key).agg(F.concat_ws(",", F.array_sort(F.collect_set("profile"))).alias("profiles"))   # at most three profiles
    return s.join(z, key, "left").join(a, key, "left")


def top_zones(zones: DataFrame, keys: list[str], members: DataFrame | None = None, n: int = 12) -> DataFrame:
    """The largest zones of a scene with their share of the total and their district."""
    total = zones.groupBy(*keys).agg(F.sum("cover_m2").alias("_total"))
    t = top_k(zones, keys, [F.col("cover_m2").desc(), F.col("p_max").desc(), F.col("zone_no")], n, "place", salt_on="zone_no").join(total, keys)
    t = t.withColumn("share", F.coalesce(F.try_divide("cover_m2", "_total"), F.lit(0.0))).drop("_total")
    return t if members is None else t.join(members, [*keys, "zone_no"], "left")


def metric_table(parts: dict[str, DataFrame], keys: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """Metric rows of several checks in one long table: part, keys, metric, value."""
    out = None
    for name, df in parts.items():
        rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        d = df.select(F.lit(name).alias("part"), *keys, F.explode(rows).alias("r")).select("part", *keys, "r.*")
        out = d if out is None else out.unionByName(d)
    return out
