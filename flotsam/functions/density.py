"""Field densities, counting noise and intervals."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.config import PAIRING

DAY_S = 86400.0


def strip_area_km2(length_km: Column, width_m: Column) -> Column:
    return length_km * width_m / 1000.0


def field_density(n: Column, area: Column) -> Column:
    """N / A; a non-positive area or a negative count is an error of the row."""
    return (F.when(~(area > 0) | area.isNull(), F.raise_error(F.lit("area must be > 0")).cast("double"))
            .when(n < 0, F.raise_error(F.lit("count must be >= 0")).cast("double"))
            .otherwise(n / area))


def density_violation(n: Column, area: Column) -> Column:
    """The same guards as a problem text (null when the row is fine)."""
    return (F.when(~(area > 0) | area.isNull(), F.lit("area_not_positive"))
            .when(n < 0, F.lit("count_negative")))


def pooled_density(n: Column, area: Column) -> Column:
    """Aggregate: ΣN / ΣA, not the mean of ratios."""
    return F.sum(n) / F.sum(area)


def published_mismatch(n: Column, area: Column, published: Column, tol: float = 0.01) -> Column:
    return (published > 0) & (F.abs(F.try_divide(n, area) - published) / published > tol)


def poisson_interval(df: DataFrame, n: str, level: float = 0.95) -> DataFrame:
    """Exact (Garwood) bounds of a Poisson mean for every distinct count, columns ``n_lo``, ``n_hi``.

    Solves P(X<=N | hi) = a/2 and P(X>=N | lo) = a/2 by Newton steps from the cube-root approximation, inside the
    expression. Counts repeat, so the work is done once per distinct count and joined back.
    """
    a = (1 - level) / 2
    z = NormalDist().inv_cdf(1 - a)
    # Poisson probability of m, and of at most m: terms summed downwards, each follows from the one before
    pmf = "exp(-x + {m} * ln(x) - {lf})"
    cdf = ("aggregate(sequence(0, cast(least({m}, 30 * sqrt({m}) + 60) as int)), named_struct('t', " + pmf + ", 's', 0D), "
           "(acc, j) -> named_struct('t', acc.t * ({m} - j) / x, 's', acc.s + acc.t), acc -> acc.s)")

    def solve(m: str, lf: str, target: float, start: str) -> str:
        step = f"x + ({cdf} - {target!r}) / greatest({pmf}, 1e-300D)".format(m=m, lf=lf)
        return f"aggregate(sequence(1, 10), {start}, (x, i) -> greatest({step}, 1e-12D))"

    counts = df.select(F.col(n).cast("double").alias("_n")).where(F.col("_n").isNotNull()).distinct()
    # few rows but costly ones: spread them over all cores, which a plain shuffle of so few bytes would not
    counts = counts.repartition(df.sparkSession.sparkContext.defaultParallelism)
    # ln n!: the sum up to 256, Stirling's series with three terms beyond (error below 1e-15)
    counts = counts.withColumn("_lf", F.expr("if(_n < 2, 0D, if(_n <= 256, aggregate(sequence(2, cast(_n as int)), 0D, (z, k) -> z + ln(k)), "
                                             "_n * ln(_n) - _n + ln(2 * pi() * _n) / 2 + 1 / (12 * _n) - 1 / (360 * pow(_n, 3)) + 1 / (1260 * pow(_n, 5))))"))
    root = "pow(1 - 1 / (9 * {k}) {s} {z!r} / (3 * sqrt({k})), 3) * {k}"
    hi = solve("_n", "_lf", a, root.format(k="(_n + 1)", s="+", z=z))
    low = solve("(_n - 1)", "(_lf - ln(_n))", 1 - a, "greatest(" + root.format(k="_n", s="-", z=z) + ", 1e-3D)")
    counts = counts.select(F.col("_n").alias(f"_{n}"), F.expr(f"if(_n = 0, 0D, {low})").alias("n_lo"), F.expr(hi).alias("n_hi"))
    return df.join(counts, F.col(n).cast("double") == F.col(f"_{n}"), "left").drop(f"_{n}")


def counting_variance(n: Column, area: Column) -> Column:
    """Variance of ln(C+1) from counting: N / (N + A)², N at least one; null when N or A is unknown."""
    m = F.when(n.isNotNull(), F.greatest(n.cast("double"), F.lit(1.0)))
    return m / F.pow(m + area, 2)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a proportion; [0, 1] when nothing was seen."""
    p = F.try_divide(k, n)
    d = 1 + F.try_divide(F.lit(z * z), n)
    c = p + F.try_divide(F.lit(z * z), 2 * n)
    h = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    return (F.when(n == 0, F.lit(0.0)).otherwise((c - h) / d), F.when(n == 0, F.lit(1.0)).otherwise((c + h) / d))


# ---- times ---------------------------------------------------------------------------------------------------------

def event_interval(date: Column, start: Column, end: Column) -> dict[str, Column]:
    """Observation interval from a date and two clock strings.

    Blank clocks mean the whole day with an unknown time; an end before the start lies on the next day.
    """
    known = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    day = F.to_timestamp(date)
    s = F.when(known, F.to_timestamp(F.concat_ws(" ", date, start)))
    e = F.when(known, F.to_timestamp(F.concat_ws(" ", date, end)))
    day_s, s, e = day.cast("double"), s.cast("double"), e.cast("double")
    return {"t_start_s": F.coalesce(s, day_s),
            "t_end_s": F.when(known, F.when(e < s, e + DAY_S).otherwise(e)).otherwise(day_s + DAY_S),
            "time_known": known}


def reference_time(t0: Column, t1: Column, known: Column) -> Column:
    """Middle of a known interval, otherwise the end of the day."""
    return F.when(known, t0 + (t1 - t0) / 2).otherwise(t1)


def sync_offsets(t_scene: Column, t0: Column, t1: Column) -> dict[str, Column]:
    lo, hi = (t_scene - t1) / 3600, (t_scene - t0) / 3600
    return {"dt_min_h": lo, "dt_max_h": hi, "dt_repr_h": (t_scene - (t0 + (t1 - t0) / 2)) / 3600,
            "abs_dt_max_h": F.greatest(F.abs(lo), F.abs(hi))}


def sync_tier(known: Column, abs_dt: Column, cfg=PAIRING) -> Column:
    return (F.when(known & (abs_dt <= cfg.tier_a_max_h), F.lit("A"))
            .when(abs_dt <= cfg.tier_b_max_h, F.lit("B")).otherwise(F.lit("C")))


def drift_buffer_km(abs_dt_h: Column, wind: Column, cfg=PAIRING) -> Column:
    return abs_dt_h * 3600 * (cfg.current_ms + cfg.windage * wind) / 1000


def drift_speed_km_day(wind: Column, cfg=PAIRING) -> Column:
    return (cfg.current_ms + cfg.windage * wind) * 86.4


def st_distance(d_km: Column, dt_days: Column, v_km_day) -> Column:
    """Space-time distance: one day of age counts as ``v`` km."""
    v = v_km_day if isinstance(v_km_day, Column) else F.lit(float(v_km_day))
    return F.sqrt(d_km * d_km + F.pow(v * dt_days, 2))
