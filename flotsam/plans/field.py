"""Field registry to events: selection, geometry, densities, checks and explanations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.config import BANNED_FLAGS, EXCLUSION_RULES, PROFILE_GROUPS
from flotsam.functions.density import DAY_S, poisson_interval, published_mismatch

POINT_RADIUS_KM = 3.0
MOSAIC_RADIUS_KM = 2.0


def _rule(sel: dict[str, tuple[str, ...]]) -> Column:
    cond = F.lit(True)
    for field, allowed in sel.items():
        cond = cond & F.col(field).isin(*allowed)
    return cond


def select_rows(df: DataFrame, groups=PROFILE_GROUPS, rules=EXCLUSION_RULES, banned=BANNED_FLAGS) -> DataFrame:
    """Decision per registry row, as one projection: the first matching profile group wins unless a banned quality
    flag excludes the row; the others get the first matching exclusion reason."""
    hit = F.array_sort(F.array_intersect(F.split(F.coalesce("quality_flags", F.lit("")), ";"), F.array(*[F.lit(b) for b in banned])))
    match = None
    for pid, role, sel in groups:
        value = F.struct(F.lit(pid).alias("p"), F.lit(role).alias("r"))
        match = F.when(_rule(sel), value) if match is None else match.when(_rule(sel), value)
    reason = None
    for code, sel in rules:
        reason = F.when(_rule(sel), F.lit(code)) if reason is None else reason.when(_rule(sel), F.lit(code))
    reason = reason.otherwise(F.lit("not_target_profile"))
    df = df.withColumn("_m", match).withColumn("_hit", hit)
    inc = F.col("_m").isNotNull() & (F.size("_hit") == 0)
    return df.withColumns({
        "decision": F.when(inc, F.lit("included")).otherwise(F.lit("excluded")),
        "sel_profile": F.when(inc, F.col("_m.p")).otherwise(F.lit("")),
        "sel_role": F.when(inc, F.col("_m.r")).otherwise(F.lit("")),
        "reason_code": F.when(inc, F.lit("")).when(F.col("_m").isNotNull(), F.lit("excluded_flag")).otherwise(reason),
        "flags_hit": F.concat_ws(";", "_hit")}).drop("_m", "_hit")


def selection_summary(sel: DataFrame) -> DataFrame:
    """Included rows per profile and role, excluded rows per reason: one pass over grouping sets."""
    inc = F.when(F.col("decision") == "included", F.concat_ws("/", "sel_profile", "sel_role"))
    exc = F.when(F.col("decision") == "excluded", F.col("reason_code"))
    g = (sel.select(inc.alias("by_profile"), exc.alias("by_reason"))
         .groupingSets([["by_profile"], ["by_reason"]], "by_profile", "by_reason")
         .agg(F.count(F.lit(1)).alias("n")))
    return (g.where("by_profile is not null or by_reason is not null")
            .select(F.when(F.col("by_profile").isNotNull(), F.lit("included")).otherwise(F.lit("excluded")).alias("kind"),
                    F.coalesce("by_profile", "by_reason").alias("name"), "n"))


def geometry(segments: Column, position_role: Column, has_ends: Column, area: Column) -> dict[str, Column]:
    """Kind of the surveyed footprint and its uncertainty radius, km."""
    kind = (F.when(segments, F.lit("segments")).when(position_role == "mosaic_center", F.lit("mosaic"))
            .when(has_ends, F.lit("strip")).otherwise(F.lit("point")))
    radius = (F.when(kind == "mosaic", F.coalesce(F.sqrt(area / F.pi()), F.lit(MOSAIC_RADIUS_KM)))
              .when(kind == "point", F.lit(POINT_RADIUS_KM)).otherwise(F.lit(0.0)))
    return {"geometry_type": kind, "footprint_radius_km": radius}


def event_density(df: DataFrame, n: str = "n_items", area: str = "area_km2", published: str = "conc_published") -> DataFrame:
    """C = N / A with exact bounds where both are known, otherwise the published value."""
    df = poisson_interval(df, n)
    known = F.col(n).isNotNull() & F.col(area).isNotNull()
    return df.withColumns({
        "conc_items_km2": F.when(known, F.col(n) / F.col(area)).otherwise(F.col(published)),
        "conc_lo95": F.when(known, F.col("n_lo") / F.col(area)), "conc_hi95": F.when(known, F.col("n_hi") / F.col(area)),
        "conc_source": F.when(known, F.lit("n_over_a")).otherwise(F.lit("published"))}).drop("n_lo", "n_hi")


def event_violations(df: DataFrame) -> DataFrame:
    """Rows that must not exist: published value off by more than 1 %, no density, several rows per profile event."""
    bad = F.array_compact(F.array(
        F.when(published_mismatch(F.col("n_items"), F.col("area_km2"), F.col("conc_published")), F.lit("published_mismatch")),
        F.when(F.col("n_items").isNull() & F.col("conc_published").isNull(), F.lit("no_density"))))
    return df.select("event_id", F.explode(bad).alias("violation"))


def duplicate_events(df: DataFrame, profile: str, event: str) -> DataFrame:
    return df.groupBy(profile, event).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def prepare_events(registry: DataFrame) -> DataFrame:
    """Included registry rows as events with interval, footprint and density (one projection, no join)."""
    ev = select_rows(registry).where("decision = 'included'")
    g = geometry(F.coalesce(F.col("n_segments") >= 2, F.lit(False)) if "n_segments" in registry.columns else F.lit(False),
                 F.col("position_role"), F.col("position_role") == "strip", F.col("area_km2"))
    return event_density(ev.withColumns(g)).withColumn("value_type", F.lit("measurement"))


def item_objects(registry: DataFrame) -> DataFrame:
    """Single observed items as a context layer; they never label a density."""
    return registry.where(F.col("record_type") == "item_observation").withColumn("value_type", F.lit("object_context"))


def prepare_summary(registry: DataFrame) -> DataFrame:
    """What the preparation did: ``section, name, n``.

    Every row names the counters it belongs to, so one pass counts them all, combined before the shuffle; only
    the number of different events needs another.
    """
    sel = select_rows(registry)
    g = geometry(F.coalesce(F.col("n_segments") >= 2, F.lit(False)) if "n_segments" in registry.columns else F.lit(False),
                 F.col("position_role"), F.col("position_role") == "strip", F.col("area_km2"))

    def entry(section: str, name: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), name.alias("name"))

    inc = F.col("decision") == "included"
    entries = F.array_compact(F.array(
        entry("rows", F.lit("")), F.when(inc, entry("included_rows", F.lit(""))), F.when(inc, entry("by_profile", F.concat_ws("/", "sel_profile", "sel_role"))),
        F.when(~inc, entry("excluded_by_reason", F.col("reason_code"))), F.when(inc, entry("geometry_types", F.col("geometry_type"))),
        F.when(inc & F.col("time_known"), entry("time_known", F.col("sel_profile"))),
        F.when(F.col("record_type") == "item_observation", entry("objects", F.lit("")))))
    counted = sel.withColumns(g).select(F.explode(entries).alias("e")).groupBy("e.section", "e.name").agg(F.count(F.lit(1)).alias("n"))
    events = registry.agg(F.count_distinct("event_id").alias("n")).select(F.lit("events").alias("section"), F.lit("").alias("name"), "n")
    return counted.unionByName(events)


def explain_event(df: DataFrame) -> DataFrame:
    """How the number came about, as ordered steps (label, value, formula)."""
    known = F.col("conc_source") == "n_over_a"
    steps = F.array_compact(F.array(
        F.struct(F.lit(1).alias("step"), F.lit("interval").alias("label"), ((F.col("t_end_s") - F.col("t_start_s")) / DAY_S).alias("value"),
                 F.when(F.col("time_known"), F.lit("known time")).otherwise(F.lit("whole day")).alias("formula")),
        F.struct(F.lit(2).alias("step"), F.lit("density").alias("label"), F.col("conc_items_km2").alias("value"),
                 F.when(known, F.format_string("C = N / A = %d / %.2f", F.col("n_items"), F.col("area_km2")))
                 .otherwise(F.lit("published estimate")).alias("formula")),
        F.when(known, F.struct(F.lit(3).alias("step"), F.lit("lo95").alias("label"), F.col("conc_lo95").alias("value"),
                               F.lit("exact Poisson bound").alias("formula"))),
        F.when(known, F.struct(F.lit(4).alias("step"), F.lit("hi95").alias("label"), F.col("conc_hi95").alias("value"),
                               F.lit("exact Poisson bound").alias("formula")))))
    return df.select("event_id", F.explode(steps).alias("s")).select("event_id", "s.*")
