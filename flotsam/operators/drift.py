"""Tables made from drift tracks and flow fields."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flotsam.functions.geo import KM_PER_DEG, compass, planar_km
from flotsam.operators.neighbours import Metric, nearest
from flotsam.operators.ranking import exact_quantiles, top_k
from flotsam.session import materialise


def seed_table(points: DataFrame, keys: list[str], p: str, frac: str, id_col: str, *, max_seeds: int = 300, n_ens: int = 4) -> DataFrame:
    """The strongest detections of every scene, replicated over the ensemble, with the mass of each particle in m²."""
    best = top_k(points, keys, [(F.col(p) * F.col(frac)).desc(), F.col(id_col)], max_seeds, "_r", salt_on=id_col).drop("_r")
    return (best.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(n_ens - 1))))
            .withColumn("mass_m2", F.col(p) * F.col(frac) * 100 / n_ens))


def mass_snapshots(tracks: DataFrame, keys: list[str], cell: str, weight: str, hours: int) -> DataFrame:
    """Mass per cell after 24 h, 48 h and at the horizon (those within the horizon)."""
    at = sorted({h for h in (24, 48, hours) if h <= hours})
    return tracks.where(F.col("hour_no").isin(at)).groupBy(*keys, "hour_no", cell).agg(F.sum(weight).alias("mass_m2"))


def accumulation(tracks: DataFrame, keys: list[str], cell: str, start: Column, end: Column) -> DataFrame:
    """How much denser a cell is at the end than the mean occupied cell was at the start."""
    d = tracks.groupBy(*keys, cell).agg(F.count_if(start).alias("n0"), F.count_if(end).alias("n1"))
    mean = d.where("n0 > 0").groupBy(*keys).agg(F.avg("n0").alias("m"))
    return d.where("n1 > 0").join(mean, keys).select(*keys, cell, F.round(F.col("n1") / F.col("m"), 3).alias("factor"))


def beached_fraction(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of particles that reach land at any hour."""
    p = tracks.groupBy(*keys, "particle").agg(F.max(F.col("beached").cast("int")).alias("b"))
    return p.groupBy(*keys).agg(F.avg("b").alias("beached_frac"))


def ensemble_cone(tracks: DataFrame, keys: list[str], lat0) -> DataFrame:
    """Centre and root-mean-square spread of the ensemble per hour; one aggregation, no second pass for the centre."""
    c2 = F.pow(F.cos(F.radians(lat0 if isinstance(lat0, Column) else F.lit(lat0))), 2)
    return tracks.groupBy(*keys, "hour_no").agg(
        F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
        (F.sqrt(F.var_pop("lon") * c2 + F.var_pop("lat")) * KM_PER_DEG).alias("spread_km"))


def displacement(tracks: DataFrame, keys: list[str], hours: tuple[int, ...]) -> DataFrame:
    """Distance and offset of every particle from its start at the given hours."""
    p = tracks.groupBy(*keys, "particle").agg(
        F.max(F.when(F.col("hour_no") == 0, F.struct("lon", "lat"))).alias("s"),
        *[F.max(F.when(F.col("hour_no") == h, F.struct("lon", "lat"))).alias(f"e{h}") for h in hours])
    p = p.withColumn("h", F.explode(F.array(*[F.struct(F.lit(h).alias("hour_no"), F.col(f"e{h}").alias("e")) for h in hours])))
    p = p.where("h.e is not null and s is not null")
    dx = (F.col("h.e.lon") - F.col("s.lon")) * F.cos(F.radians(F.col("s.lat")))
    return p.select(*keys, "particle", F.col("h.hour_no").alias("hour_no"), dx.alias("dx"), (F.col("h.e.lat") - F.col("s.lat")).alias("dy")).withColumn(
        "km", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * KM_PER_DEG)


def displacement_summary(disp: DataFrame, keys: list[str]) -> DataFrame:
    q = exact_quantiles(disp, [*keys, "hour_no"], "km", {"median_km": 0.5, "p90_km": 0.9})
    g = disp.groupBy(*keys, "hour_no").agg(F.count(F.lit(1)).alias("n"), F.avg("dx").alias("_dx"), F.avg("dy").alias("_dy"))
    return g.join(q, [*keys, "hour_no"]).withColumn("heading", compass(F.col("_dx"), F.col("_dy"))).drop("_dx", "_dy")


def consecutive_pairs(scenes: DataFrame, min_det: int = 5, max_gap: int = 2) -> DataFrame:
    """Neighbouring usable scenes of an area at most ``max_gap`` days apart: aoi, day1, day2."""
    ok = scenes.where(~F.col("unreliable") & (F.col("n_det") >= min_det))
    w = Window.partitionBy("aoi").orderBy("day_no")
    return (ok.withColumn("day2", F.lead("day_no").over(w)).withColumnRenamed("day_no", "day1")
            .where((F.col("day2") - F.col("day1") > 0) & (F.col("day2") - F.col("day1") <= max_gap)).select("aoi", "day1", "day2"))


def nearest_in_plane(obs: DataFrame, pts: DataFrame, lat0: float, oid: str, pid: str) -> DataFrame:
    """Distance (km, local plane) from every observation to the nearest point of the other set."""
    def plane(df: DataFrame) -> DataFrame:
        x, y = planar_km(F.col("lon"), F.col("lat"), lat0)
        return df.withColumns({"_x": x, "_y": y})
    return nearest(plane(obs), plane(pts), qid=oid, rid=pid, q_xy=("_x", "_y"), r_xy=("_x", "_y"), metric=Metric("plane"))


def drift_check(dist: DataFrame, keys: list[str]) -> DataFrame:
    """Median distance and share within 1 km, forecast against standing still (columns d_forecast, d_stay)."""
    dist = materialise(dist)        # read several times below
    q = exact_quantiles(dist, keys, "d_forecast", {"median_km_forecast": 0.5}).join(
        exact_quantiles(dist, keys, "d_stay", {"median_km_stay": 0.5}), keys)
    g = dist.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs"), F.avg((F.col("d_forecast") <= 1).cast("double")).alias("within_1km_forecast"),
                                F.avg((F.col("d_stay") <= 1).cast("double")).alias("within_1km_stay"))
    return g.join(q, keys).withColumn("forecast_better", F.col("median_km_forecast") < F.col("median_km_stay"))


# ---- flow fields ---------------------------------------------------------------------------------------------------

def hourly_field(field: DataFrame, keys: list[str], time: str, values: list[str], *, shift: float = 0.0, step: float = 1.0) -> DataFrame:
    """Values at every ``step`` between the given times by linear interpolation (daily means are shifted to noon).

    Each known time fills the steps up to the next one, so the work is one ordered pass per grid cell.
    """
    w = Window.partitionBy(*keys).orderBy("_t")
    f = field.withColumn("_t", F.col(time) + shift)
    f = f.withColumn("_t1", F.lead("_t").over(w)).withColumns({f"_n_{v}": F.lead(v).over(w) for v in values})
    last = F.coalesce(F.floor((F.col("_t1") - F.col("_t") - 1e-9) / step), F.lit(0))
    f = f.withColumn("_k", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    frac = F.coalesce(F.col("_k") * step / (F.col("_t1") - F.col("_t")), F.lit(0.0))
    return f.select(*keys, (F.col("_t") + F.col("_k") * step).alias(time), *[
        (F.col(v) + (F.coalesce(f"_n_{v}", v) - F.col(v)) * frac).alias(v) for v in values])


def at_times(field: DataFrame, targets: DataFrame, keys: list[str], time: str, value: str, out: str, slot: float = 1.0) -> DataFrame:
    """Linear interpolation at target times, clamped at both ends.

    Every pair of neighbouring field times is spread over the time slots it spans, once per grid cell; targets then
    join on (cell, slot), so that a cell with very many targets is no single task. Targets before the first or
    after the last time take the end values.
    """
    f = field.select(*keys, F.col(time).cast("double").alias("_t"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t")         # the times of one grid cell
    f = f.withColumns({"_t1": F.lead("_t").over(w), "_v1": F.lead("_v").over(w)})
    seg = f.where("_t1 is not null").withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_t") / slot), F.floor(F.col("_t1") / slot))))
    ends = f.groupBy(*keys).agg(F.min(F.struct("_t", "_v")).alias("_first"), F.max(F.struct("_t", "_v")).alias("_last"))
    t = targets.withColumns({"_x": F.col(time).cast("double"), "_slot": F.floor(F.col(time) / slot)}).join(ends, keys, "left")
    inner = t.where((F.col("_x") >= F.col("_first._t")) & (F.col("_x") < F.col("_last._t")))
    outer = t.where(F.col("_first").isNull() | (F.col("_x") < F.col("_first._t")) | (F.col("_x") >= F.col("_last._t")))
    inner = inner.join(seg, [*keys, "_slot"]).where((F.col("_t") <= F.col("_x")) & (F.col("_x") < F.col("_t1")))
    v = F.col("_v") + (F.col("_v1") - F.col("_v")) * (F.col("_x") - F.col("_t")) / (F.col("_t1") - F.col("_t"))
    edge = F.when(F.col("_x") < F.col("_first._t"), F.col("_first._v")).otherwise(F.col("_last._v"))
    return inner.select(*targets.columns, v.alias(out)).unionByName(outer.select(*targets.columns, edge.alias(out)))


def thin_grid(field: DataFrame, ix: str, iy: str, nx: Column, ny: Column, max_nodes: int = 32) -> DataFrame:
    """Every s-th grid node so that no side keeps more than ``max_nodes``."""
    s = F.greatest(F.lit(1), F.ceil(F.greatest(nx, ny) / max_nodes))
    return field.where((F.col(ix) % s == 0) & (F.col(iy) % s == 0))


def fill_from_sea(cells: DataFrame, value: str, cid: str) -> DataFrame:
    """Land cells (null) take the value of the nearest sea cell (grid steps; smallest id on ties)."""
    sea = cells.where(F.col(value).isNotNull()).select(F.col(cid).alias("_sid"), "gx", "gy", F.col(value).alias("_sv"))
    hit = nearest(cells.where(F.col(value).isNull()), sea, qid=cid, rid="_sid", q_xy=("gx", "gy"), r_xy=("gx", "gy"),
                  metric=Metric("plane"), payload=("_sv",))
    return (cells.join(hit.select(cid, "_sv"), cid, "left").withColumn(value, F.coalesce(value, "_sv")).drop("_sv"))


def regrid(cells: DataFrame, targets: DataFrame, value: str, out: str, max_x: Column, max_y: Column) -> DataFrame:
    """Bilinear value at fractional grid positions (tx, ty); positions outside extrapolate from the border cells.

    Every square of four cells that holds a target is put together once and a target meets its square: no row per corner.
    Corners that are missing or null add nothing; a square without any cell gives no row.
    """
    x0 = F.greatest(F.lit(0), F.least(F.floor("tx"), max_x - 1)).cast("bigint")
    y0 = F.greatest(F.lit(0), F.least(F.floor("ty"), max_y - 1)).cast("bigint")
    t = targets.withColumns({"_x0": x0, "_y0": y0})
    ends = [(dx, dy) for dx in (0, 1) for dy in (0, 1)]
    # both are written before they are joined, so that few squares are known to be few and the targets stay where they are
    want = materialise(t.select("_x0", "_y0").distinct())
    corner = F.explode(F.array(*[F.struct((F.col("gx") - dx).cast("bigint").alias("_x0"), (F.col("gy") - dy).cast("bigint").alias("_y0"), F.lit(i).alias("_i")) for i, (dx, dy) in enumerate(ends)]))
    squares = materialise(cells.select(F.col(value).alias("_v"), corner.alias("_c")).select("_v", "_c.*").join(want, ["_x0", "_y0"], "left_semi").groupBy("_x0", "_y0").agg(
        *[F.sum(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_v{i}") for i in range(4)]))
    px, py = F.col("tx") - F.col("_x0"), F.col("ty") - F.col("_y0")
    some = F.coalesce(*[F.col(f"_v{i}") for i in range(4)]).isNotNull()
    total = sum((px if dx else 1 - px) * (py if dy else 1 - py) * F.coalesce(f"_v{i}", F.lit(0.0)) for i, (dx, dy) in enumerate(ends))
    return t.join(squares, ["_x0", "_y0"]).select(*targets.columns, F.when(some, total).alias(out))
