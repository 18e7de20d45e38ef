"""Scores, thresholds, bootstrap and calibration."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from flotsam.config import FDI_HI, FDI_LO, NDVI_MAX
from flotsam.operators.ranking import exact_quantiles, order_statistics, running_totals, top_k
from flotsam.session import materialise

EPS = 1.0


def error_metrics(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """MAE, RMSE, median error, log error and median bias ratio per key."""
    d = df.withColumn("_e", F.abs(F.col(y) - F.col(p)))
    base = d.groupBy(*keys).agg(
        F.avg("_e").alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"),
        F.avg(F.abs(F.log(F.col(p) + EPS) - F.log(F.col(y) + EPS))).alias("mae_log"), F.count(F.lit(1)).alias("n"))
    # the three medians share one pass: one row per measure
    long = d.select(*keys, F.explode(F.array(
        F.struct(F.lit("e").alias("_k"), F.col("_e").alias("_x")), F.struct(F.lit("p").alias("_k"), F.col(p).alias("_x")),
        F.struct(F.lit("y").alias("_k"), F.col(y).alias("_x")))).alias("s")).select(*keys, "s.*")
    med = exact_quantiles(long, [*keys, "_k"], "_x", {"m": 0.5})

    def pick(k: str) -> Column:
        return F.max(F.when(F.col("_k") == k, F.col("m")))

    med = med.groupBy(*keys).agg(pick("e").alias("medae"), (pick("p") / F.greatest(pick("y"), F.lit(1e-9))).alias("bias_median_ratio"))
    return base.join(med, keys)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return {"precision": p, "recall": r, "f1": 2 * p * r / F.greatest(p + r, F.lit(1e-12)),
            "iou": tp / F.greatest(tp + fp + fn, F.lit(1))}


def confusion(df: DataFrame, keys: list[str], pred: Column, cl: Column, n: str | None = None) -> DataFrame:
    """Counts against the debris class 1; class 0 is unlabelled and only counted as such. ``n``: rows that a row stands for."""
    def count(is_: Column) -> Column:
        return F.count_if(is_) if n is None else F.sum(F.when(is_, F.col(n)).otherwise(0))

    return df.groupBy(*keys).agg(
        count(pred & (cl == 1)).alias("tp"), count(pred & (cl > 1)).alias("fp"),
        count(~pred & (cl == 1)).alias("fn"), count(pred & (cl == 0)).alias("unlabelled_pos"),
        count(cl == 1).alias("n_debris"))


def class_rates(df: DataFrame, keys: list[str], cl: str, preds: dict[str, Column]) -> DataFrame:
    """Share of every background class taken for debris, per prediction."""
    g = df.where(F.col(cl) > 1).groupBy(*keys, cl).agg(
        F.count(F.lit(1)).alias("class_px"), *[F.count_if(p).alias(f"fp_{n}") for n, p in preds.items()])
    return g.withColumns({f"rate_{n}": F.col(f"fp_{n}") / F.col("class_px") for n in preds})


def recall_by_confidence(df: DataFrame, cl: str, conf: str, pred: Column) -> DataFrame:
    return (df.where((F.col(cl) == 1) & F.col(conf).between(1, 3)).groupBy(conf)
            .agg(F.count(F.lit(1)).alias("debris_px"), F.count_if(pred).alias("found")))


def best_threshold(df: DataFrame, keys: list[str], score: str, truth: str, *, lo: float = 0.5, hi: float = 0.9995,
                   steps: int = 400) -> DataFrame:
    """Threshold with the best F1 (score > t) over quantiles of the score; the lowest of equals wins.

    Running totals of all and of true rows over the ordered distinct scores give the counts above any threshold;
    every distinct score only meets the quantile steps that fall on it.
    """
    counts = df.groupBy(*keys, F.col(score).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(F.col(truth)).alias("_y"))
    run = running_totals(counts, [*keys, "_v"], {"_ca": "_c", "_cy": "_y"})
    span = run.groupBy(*keys).agg(F.min(F.col("_ca") - F.col("_c")).alias("_b"), F.min(F.col("_cy") - F.col("_y")).alias("_by"),
                                  F.sum("_c").alias("_n"), F.sum("_y").alias("_np"))
    r = run.join(span, keys).withColumns({"_hi": F.col("_ca") - F.col("_b"), "_pos": F.col("_cy") - F.col("_by")})
    r = r.withColumn("_lo", F.col("_hi") - F.col("_c"))
    step = (hi - lo) / (steps - 1)
    m = F.greatest(F.col("_n") - 1, F.lit(1))

    def index(rank: Column, rounding) -> Column:
        return F.greatest(F.lit(-1), F.least(F.lit(steps), rounding((rank / m - lo) / step))).cast("int")

    a, b = F.greatest(F.lit(0), index(F.col("_lo") - 1, F.floor)), F.least(F.lit(steps - 1), index(F.col("_hi"), F.ceil))
    r = r.where(a <= b).withColumn("_i", F.explode(F.sequence(a, b)))
    at = (F.col("_n") - 1) * (F.lit(lo) + F.col("_i") * F.lit(step))
    low, high = F.floor(at), F.ceil(at)

    def holds(k: Column) -> Column:
        return (F.col("_lo") <= k) & (k < F.col("_hi"))

    def take(k: Column, c: str) -> Column:
        return F.max(F.when(holds(k), F.col(c)))

    t = r.groupBy(*keys, "_i", "_n", "_np").agg(
        take(low, "_v").alias("vf"), take(high, "_v").alias("vc"), take(low, "_hi").alias("hf"), take(high, "_hi").alias("hc"),
        take(low, "_pos").alias("pf"), take(high, "_pos").alias("pc")).where("vf is not null and vc is not null")
    at = (F.col("_n") - 1) * (F.lit(lo) + F.col("_i") * F.lit(step))
    t = t.withColumn("threshold", F.col("vf") + (F.col("vc") - F.col("vf")) * (at - F.floor(at)))
    up = F.col("threshold") >= F.col("vc")
    tp = F.col("_np") - F.when(up, F.col("pc")).otherwise(F.col("pf"))
    pp = F.col("_n") - F.when(up, F.col("hc")).otherwise(F.col("hf"))
    t = t.withColumn("f1", 2 * tp / F.greatest(pp + F.col("_np"), F.lit(1)))
    return t.groupBy(*keys).agg(F.min_by(F.struct("threshold", "f1"), F.struct(-F.col("f1"), F.col("threshold"))).alias("s")).select(
        *keys, "s.*")


def window_search(df: DataFrame, keys: list[str], d_fdi: str, ndvi: str, truth: str) -> DataFrame:
    """Best (lo, hi, ndvi) window by F1 over the fixed grid; earlier grid points win ties.

    Every row is first reduced to which grid steps it passes; the grid itself then meets only the at most
    6·8·6 distinct outcomes per key.
    """
    def passed(col: str, edges, above: bool) -> Column:
        x = F.col(col)
        out = F.lit(0)
        for e in edges:
            out = out + F.when(x > e if above else x < e, 1).otherwise(0)
        return out

    g = df.groupBy(*keys, passed(d_fdi, FDI_LO, True).alias("a"), passed(d_fdi, FDI_HI, False).alias("b"),
                   passed(ndvi, NDVI_MAX, False).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth)).alias("y"))
    total = g.groupBy(*keys).agg(F.sum("y").alias("np"))
    cell = g.where("a > 0 and b > 0 and c > 0").select(
        *keys, "n", "y", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("i"), "b", "c")
    cell = cell.withColumn("j", F.explode(F.sequence(len(FDI_HI) - F.col("b"), F.lit(len(FDI_HI) - 1)))).withColumn(
        "k", F.explode(F.sequence(len(NDVI_MAX) - F.col("c"), F.lit(len(NDVI_MAX) - 1))))
    s = cell.groupBy(*keys, "i", "j", "k").agg(F.sum("n").alias("pp"), F.sum("y").alias("tp")).join(total, keys)
    s = s.withColumn("f1", 2 * F.col("tp") / F.greatest(F.col("pp") + F.col("np"), F.lit(1)))

    def value(edges, i: str) -> Column:
        return F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col(i) + 1)

    best = s.groupBy(*keys).agg(F.min_by(F.struct("i", "j", "k", "f1"), F.struct(-F.col("f1"), "i", "j", "k")).alias("s")).select(*keys, "s.*")
    return best.select(*keys, value(FDI_LO, "i").alias("fdi_lo"), value(FDI_HI, "j").alias("fdi_hi"),
                       value(NDVI_MAX, "k").alias("ndvi_max"), "f1")


# ---- group bootstrap -----------------------------------------------------------------------------------------------

PRIME = 2147483647
GROUP_BLOCK = 1 << 17       # groups whose sums a task holds
REP_BLOCK = 100             # replicates drawn by one row
SLOT_BLOCK = 1 << 20        # draws made at a time


def draw(seed: int, replicate: int, slot: np.ndarray, size: int) -> np.ndarray:
    """Portable uniform pick below ``size``: two linear congruential rounds on whole numbers."""
    x = (replicate * 48271 + slot * 69621 + seed * 40692 + 12345) % PRIME
    x = (x * 48271 + 11) % PRIME
    x = ((x % 65536) * 39373 + (x >> 16)) % PRIME
    x = (x * 69621 + 7) % PRIME
    return x % size


def _replicates(keys: list[str], sums: list[str], n_boot: int, seed: int, names: list[str]):
    """Sums of every replicate over one block of groups: draws are made again for every block and counted in place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                held = batch.column("_held")[r].values
                first, size, block = (batch.column(c)[r].as_py() for c in ("_first", "n_groups", "_block"))
                base, width = block * GROUP_BLOCK, min(GROUP_BLOCK, size - block * GROUP_BLOCK)
                order = np.argsort(held.field("group_no").to_numpy(zero_copy_only=False))
                values = [held.field(s).to_numpy(zero_copy_only=False)[order] for s in sums]
                reps = np.arange(first, min(first + REP_BLOCK, n_boot))
                total = [np.zeros(len(reps), v.dtype) for v in values]
                for i, rep in enumerate(reps):
                    count = np.zeros(width, np.int64)
                    for s in range(0, size, SLOT_BLOCK):
                        pick = draw(seed, int(rep), np.arange(s, min(s + SLOT_BLOCK, size), dtype=np.int64), size) - base
                        if width < size:
                            pick = pick[(pick >= 0) & (pick < width)]
                        count += np.bincount(pick, minlength=width)
                    for t, v in zip(total, values):
                        t[i] = (count * v).sum()
                own = [pa.repeat(batch.column(k)[r], len(reps)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(reps, pa.int32()), *[pa.array(t) for t in total]], names)
    return run


def group_bootstrap(groups: DataFrame, keys: list[str], sums: list[str], stats: dict[str, Column], *, n_boot: int = 2000,
                    seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile intervals when whole groups are drawn with replacement.

    ``groups`` has one row per group with its partial sums (bigint or double), the number ``group_no`` (0-based within the
    key, without gaps) and the group count ``n_groups``. ``stats`` are expressions over the summed columns of one replicate.
    The sums of ``GROUP_BLOCK`` groups go to every block of replicates as arrays; draws are made and counted there, so
    neither a draw nor a count per (replicate, group) is ever a row, to be shuffled or taken for small and broadcast.
    """
    spark = groups.sparkSession
    types = dict(groups.dtypes)
    whole = [s for s in sums if types[s] in ("tinyint", "smallint", "int", "bigint")]
    held = F.struct(F.col("group_no").cast("bigint").alias("group_no"), *[F.col(s).cast("bigint" if s in whole else "double").alias(s) for s in sums])
    block = F.floor(F.col("group_no") / GROUP_BLOCK).cast("bigint").alias("_block")
    work = groups.groupBy(*keys, F.col("n_groups").cast("bigint").alias("n_groups"), block).agg(F.collect_list(held).alias("_held"))
    work = work.withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.lit(REP_BLOCK))))
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_block", "_first")
    schema = StructType([*[groups.schema[k] for k in keys], StructField("rep", IntegerType()), *[StructField(s, LongType() if s in whole else DoubleType()) for s in sums]])
    rep = work.mapInArrow(_replicates(keys, sums, n_boot, seed, schema.names), schema).groupBy(*keys, "rep").agg(*[F.sum(s).alias(s) for s in sums])
    rep = rep.select(*keys, *[e.alias(n) for n, e in stats.items()])
    lo, hi = (1 - level) / 2, (1 + level) / 2
    # n_boot values per key: bounded
    return rep.groupBy(*keys).agg(*[F.percentile(n, F.lit(q)).alias(f"{n}_{t}") for n in stats for t, q in (("lo", lo), ("hi", hi))],
                                  *[F.avg((F.col(n) < 0).cast("double")).alias(f"{n}_below0") for n in stats if n.startswith("delta")])


def number_groups(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Adds ``group_no`` (0-based in group order) and ``n_groups`` per key to a one-row-per-group table."""
    order = [*keys, group]
    run = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), order, {"_r": "_one"})
    if not keys:
        n = run.agg(F.count(F.lit(1)).alias("n")).scalar()
        return run.withColumn("group_no", F.col("_r") - 1).withColumn("n_groups", n).drop("_r", "_one")
    span = run.groupBy(*keys).agg((F.min("_r")).alias("_b"), F.count(F.lit(1)).alias("n_groups"))
    return run.join(span, keys).withColumn("group_no", F.col("_r") - F.col("_b")).drop("_r", "_b", "_one")


# ---- calibration ---------------------------------------------------------------------------------------------------

def conformal(df: DataFrame, keys: list[str], y: str, p: str, level: float) -> DataFrame:
    """Log-scale bounds of the residuals with the finite-sample correction; order statistics, no interpolation."""
    a = 1 - level
    n = F.col("_n")
    d = df.withColumn("_res", F.log(F.col(y) + EPS) - F.log(F.col(p) + EPS))
    lo = F.floor((n - 1) * F.greatest(F.lit(a / 2) * (n + 1) / n - 1 / n, F.lit(0.0)))
    hi = F.ceil((n - 1) * F.least(F.lit(1 - a / 2) * (n + 1) / n, F.lit(1.0)))
    return order_statistics(d, keys, "_res", {"q_lo": (a / 2, lo), "q_hi": (1 - a / 2, hi)})


def apply_interval(p: Column, q_lo: Column, q_hi: Column) -> tuple[Column, Column]:
    return F.greatest((p + EPS) * F.exp(q_lo) - EPS, F.lit(0.0)), (p + EPS) * F.exp(q_hi) - EPS


def coverage(df: DataFrame, keys: list[str], y: str, lo: str, hi: str) -> DataFrame:
    """Share of truths inside the interval and the median log width."""
    d = df.withColumn("_w", F.log(F.col(hi) + EPS) - F.log(F.col(lo) + EPS))
    c = d.groupBy(*keys).agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("cover"))
    return c.join(exact_quantiles(d, keys, "_w", {"log_width": 0.5}), keys)


def poisson_floor(df: DataFrame, keys: list[str], n: str, area: str) -> DataFrame:
    """Error left to a model that knows the true mean: E|X-λ| = 2·exp(-λ)·λ^(λ+1)/λ!, over the area.

    Closed form instead of simulation; null for keys with unknown counts.
    """
    x = F.col(n).cast("double")
    c = df.select(n).where(F.col(n).isNotNull()).distinct()
    lf = F.when(x < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2), F.col(n).cast("int")), F.lit(0.0), lambda s, k: s + F.log(k)))
    c = c.withColumn("_d", F.when(x == 0, F.lit(0.0)).otherwise(2 * F.exp(-x + (x + 1) * F.log(F.greatest(x, F.lit(1.0))) - lf)))
    d = df.join(c, n, "left")
    return d.groupBy(*keys).agg(F.when(F.count_if(F.col(n).isNull()) == 0, F.avg(F.col("_d") / F.col(area))).alias("floor_mae"))


def lowest(df: DataFrame, keys: list[str], cap: int, id_col: str) -> DataFrame:
    """At most ``cap`` rows per group, chosen by a portable hash of the id; groups with a null key are left out.

    Hashes are spread evenly, so the rows wanted lie below a limit that follows from the size of the group: the
    rows are read twice, but only those below the limit are put in order. Where a group has too few of them all rows are.
    """
    h = (F.col(id_col).cast("bigint") * 48271 + 11) % PRIME
    df = df.withColumn("_h", (h * 69621 + 7) % PRIME)
    size = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    # one row per group
    low = materialise(df.join(F.broadcast(size), keys).where(F.col("_h") < F.greatest(F.lit(0.0), F.lit(2.0 * cap + 100) / F.col("_n")) * PRIME).drop("_n"))
    have = low.groupBy(*keys).agg(F.count(F.lit(1)).alias("_low"))
    short = size.join(have, keys, "left").where(F.coalesce("_low", F.lit(0)) < F.least(F.lit(cap), F.col("_n")))
    return materialise(top_k(low if short.isEmpty() else df.dropna(subset=keys), keys, [F.col("_h"), F.col(id_col)], cap, "_r", salt_on=id_col).drop("_r", "_h"))


def balance(df: DataFrame, cls: str, cap: int, id_col: str, n_classes: int) -> DataFrame:
    """At most ``cap`` rows per class, chosen by a portable hash of the id, with inverse-frequency weights."""
    kept = lowest(df, [cls], cap, id_col)
    n = kept.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n")).scalar()
    return kept.join(n.select(cls, (total / (n_classes * F.greatest("_n", F.lit(1)))).alias("weight")), cls)


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties; needs five pairs and more than one distinct x."""
    from flotsam.operators.ranking import average_ranks
    d = df.join(average_ranks(df, keys, x, "_rx"), [*keys, x]).join(average_ranks(df, keys, y, "_ry"), [*keys, y])
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.corr("_rx", "_ry").alias("rho"), F.min(x).alias("_a"), F.max(x).alias("_b"))
    return g.select(*keys, "n_pairs", F.when((F.col("n_pairs") >= 5) & (F.col("_a") < F.col("_b")), F.col("rho")).alias("rho"))
