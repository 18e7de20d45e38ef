"""Ranks, running totals, quantiles and top-k that do not pass one hot group through one task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flotsam.session import materialise


def running_totals(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Inclusive running sums in a global order (ascending by ``order``, which must be unique); output → value column.

    Range partitioning puts the rows in order over the cluster; each partition then only needs the totals of the
    partitions before it, a few numbers per partition.
    """
    part = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_pid", F.spark_partition_id())
    part = materialise(part)
    totals = part.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: bounded by the number of partitions, not by the data
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in values])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (part.join(F.broadcast(offsets), "_pid")
            .withColumns({o: F.sum(v).over(inside) + F.col(f"_o_{o}") for o, v in values.items()})
            .drop("_pid", *[f"_o_{o}" for o in values]))


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    return running_totals(df, order, {out: value})


def global_rank(df: DataFrame, order: list[str], out: str = "rank_no") -> DataFrame:
    """1-based position of every row in a global order (``order`` must be unique)."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", out).drop("_one")


SKETCH = 10000          # accuracy of the first look: ranks are known to within n / SKETCH


def rank_values(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, list[Column]]]) -> DataFrame:
    """Values at exact 0-based ranks per key: ``keys, _n`` and ``<name>_<i>`` for the i-th rank of every name.

    ``ranks``: name → (roughly where, as a share; rank expressions of ``_n``). A quantile sketch first brackets the
    wanted ranks. In a second pass every row is either inside a bracket, counted as below it, or dropped; only the few
    distinct values inside are put in order. The sketch decides how much is ordered, never the result: a rank that
    is not found inside its bracket widens the brackets up to the whole group. No task holds a whole group.
    """
    work = keys or ["_all"]
    src = (df if keys else df.withColumn("_all", F.lit(0))).where(F.col(value).isNotNull()).select(*work, F.col(value).cast("double").alias("_v"))
    names = list(ranks)
    for margin in (4.0 / SKETCH, 0.05, None):
        aggs = [F.count(F.lit(1)).alias("_n")]
        if margin is not None:
            shares = [x for n in names for x in (max(ranks[n][0] - margin, 0.0), min(ranks[n][0] + margin, 1.0))]
            aggs.append(F.percentile_approx("_v", F.array(*[F.lit(x) for x in shares]), F.lit(SKETCH)).alias("_b"))
        look = materialise(src.groupBy(*work).agg(*aggs))      # one row per key, read three times
        d = src.join(look, work)
        slots = []
        for i, _ in enumerate(names):
            if margin is None:
                keep, val = F.lit(True), F.col("_v")
            else:
                keep = F.col("_v") <= F.col("_b")[2 * i + 1]
                val = F.when(F.col("_v") >= F.col("_b")[2 * i], F.col("_v"))
            slots.append(F.when(keep, F.struct(F.lit(i).alias("i"), val.alias("v"))))
        counts = (d.select(*work, F.explode(F.array_compact(F.array(*slots))).alias("s")).groupBy(*work, "s.i", "s.v")
                  .agg(F.count(F.lit(1)).alias("_c")))
        # nulls come first: the rows below a bracket are one row ahead of its values
        run = running_total(counts, [*work, "i", "v"], "_c", "_cum")
        base = run.groupBy(*work, "i").agg(F.min(F.col("_cum") - F.col("_c")).alias("_base"))
        j = run.join(base, [*work, "i"]).join(look.select(*work, "_n"), work)
        lo, hi = F.col("_cum") - F.col("_c") - F.col("_base"), F.col("_cum") - F.col("_base")
        out = [F.max(F.when((F.col("i") == i) & (lo <= r) & (r < hi), F.col("v"))).alias(f"{n}_{k}")
               for i, n in enumerate(names) for k, r in enumerate(ranks[n][1])]
        res = materialise(j.groupBy(*work).agg(F.max("_n").alias("_n"), *out))
        cols = [c for c in res.columns if c not in (*work, "_n")]
        if margin is None or res.where(" or ".join(f"`{c}` is null" for c in cols)).isEmpty():
            return res.select(*keys, "_n", *cols)
    raise AssertionError("unreachable")


SMALL = 4096            # rows of a group that is put in order as one array


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per key, exact at any group size.

    Groups of at most ``SMALL`` rows are arrays, so that many small groups cost no sketches; only larger ones are ranked.
    """
    n = F.col("_n")
    at = {name: (n - 1) * F.lit(float(p)) for name, p in probs.items()}

    def between(lo: Column, hi: Column, name: str) -> Column:
        return (lo + (hi - lo) * (at[name] - F.floor(at[name]))).alias(name)

    def by_rank(d: DataFrame) -> DataFrame:
        r = rank_values(d, keys, value, {name: (float(p), [F.floor(at[name]), F.ceil(at[name])]) for name, p in probs.items()})
        return r.select(*keys, *[between(F.col(f"{name}_0"), F.col(f"{name}_1"), name) for name in probs])

    if not keys:
        return by_rank(df)
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    large = materialise(src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(n > SMALL).select(*keys))
    some = not large.isEmpty()
    rest = src.join(F.broadcast(large), keys, "left_anti") if some else src
    rest = rest.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_s")).withColumn("_n", F.size("_s"))
    small = rest.select(*keys, *[between(F.get("_s", F.floor(at[name]).cast("int")), F.get("_s", F.ceil(at[name]).cast("int")), name) for name in probs])
    return small.unionByName(by_rank(src.join(F.broadcast(large), keys, "left_semi"))) if some else small


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """Values at given 0-based ranks per key; ``ranks``: name → (rough share, expression of ``_n``, the group size)."""
    r = rank_values(df, keys, value, {n: (p, [e]) for n, (p, e) in ranks.items()})
    return r.select(*keys, F.col("_n").alias("n"), *[F.col(f"{n}_0").alias(n) for n in ranks])


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank_no", salt_on: str | None = None,
          salts: int = 64) -> DataFrame:
    """The first ``k`` rows of every group.

    A first pass keeps ``k`` rows of every salted part of the group, so a group that holds a large share of all
    rows is cut down in parallel before its winners meet.
    """
    cols = df.columns
    salt = F.pmod(F.xxhash64(salt_on) if salt_on else F.xxhash64(*cols), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    last = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(last)).where(F.col(out) <= k).select(*cols, out)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Rank of every value within its key, ties share the mean rank; one row per distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    run = running_total(counts, [*keys, value], "_c", "_cum")
    base = run.groupBy(*keys).agg(F.min(F.col("_cum") - F.col("_c")).alias("_base"))
    return run.join(base, keys).select(*keys, value, (F.col("_cum") - F.col("_base") - (F.col("_c") - 1) / 2).alias(out))


def ordered_lag(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Value of the previous row of the same key in (keys, order) order, however large the key.

    Rows are range-partitioned; only the first row of a partition looks at the last row of the partitions before.
    """
    full = [*keys, *order]
    part = materialise(df.repartitionByRange(*[F.col(c) for c in full]).withColumn("_pid", F.spark_partition_id()))
    last = part.groupBy("_pid").agg(F.max(F.struct(*full, F.col(value).alias("_val"))).alias("_last"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    prev = last.select("_pid", F.last("_last", ignorenulls=True).over(before).alias("_prev"))
    w = Window.partitionBy("_pid").orderBy(*full)
    me = F.struct(*full, F.col(value).alias("_val"))
    d = part.join(F.broadcast(prev), "_pid").withColumn("_l", F.coalesce(F.lag(me).over(w), F.col("_prev")))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"_l.{k}") == F.col(k))
    return d.withColumn(out, F.when(same, F.col("_l._val"))).drop("_pid", "_prev", "_l")
