"""Small density models: moments in Spark, k×k systems on the few aggregated rows."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flotsam.config import APPLICABILITY, check_predictors
from flotsam.functions.geo import in_basins
from flotsam.operators.metrics import EPS, apply_interval
from flotsam.operators.neighbours import nearest
from flotsam.operators.ranking import exact_quantiles, running_totals
from flotsam.session import materialise


def other_folds(df: DataFrame, fold: str, k: int, out: str = "held") -> DataFrame:
    """Every row once for each fold it may train: all but its own."""
    return df.withColumn(out, F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(k - 1)), F.col(fold).cast("int"))))


def fold_medians(df: DataFrame, fold: str, value: str, k: int) -> DataFrame:
    """Median of the rows outside each fold."""
    return exact_quantiles(other_folds(df, fold, k), ["held"], value, {"median": 0.5})


# ---- ridge regression on ln(C + 1) ---------------------------------------------------------------------------------

def moments(df: DataFrame, keys: list[str], features: list[str], y: Column) -> DataFrame:
    """Sums that any least-squares fit on these rows needs: n, Σx, Σxx', Σy, Σxy."""
    check_predictors(features)
    d = df.withColumn("_y", y)
    x = [F.col(f).cast("double") for f in features]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(a) for a in x]).alias("sx"),
        F.array(*[F.sum(a * b) for a in x for b in x]).alias("sxx"), F.sum("_y").alias("sy"), F.array(*[F.sum(a * F.col("_y")) for a in x]).alias("sxy"))


def minus(total: Column | str, part: str) -> Column:
    return F.zip_with(total, part, lambda a, b: a - b)


def held_out_moments(per_fold: DataFrame, fold: str, keys: list[str]) -> DataFrame:
    """Training sums for each left-out fold (total minus fold) and for the whole (``held`` = -1).

    ``per_fold`` has one row per key and fold: sums are subtracted instead of fitting the data again.
    """
    def total(c: str) -> Column:
        return F.array(*[F.sum(F.col(c)[i]) for i in range(sizes[c])])

    first = {"sx": len_of(per_fold, "sx"), "sxx": len_of(per_fold, "sxx"), "sxy": len_of(per_fold, "sxy")}
    sizes = first
    tot = per_fold.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), *[total(c).alias(c) for c in ("sx", "sxx", "sxy")])
    t = tot.select(*keys, *[F.col(c).alias(f"t_{c}") for c in ("n", "sx", "sxx", "sy", "sxy")])
    on = keys or ["_all"]
    if not keys:
        per_fold, t = per_fold.withColumn("_all", F.lit(0)), t.withColumn("_all", F.lit(0))
    j = per_fold.join(t, on)
    out = j.select(*keys, F.col(fold).cast("int").alias("held"), (F.col("t_n") - F.col("n")).alias("n"), minus("t_sx", "sx").alias("sx"),
                   minus("t_sxx", "sxx").alias("sxx"), (F.col("t_sy") - F.col("sy")).alias("sy"), minus("t_sxy", "sxy").alias("sxy"))
    return out.unionByName(tot.withColumn("held", F.lit(-1)))


def len_of(df: DataFrame, c: str) -> int:
    """Length of a moment array, taken from the number of features recorded in the plan."""
    meta = df.schema[c].metadata
    return int(meta["size"])


def sized_moments(df: DataFrame, keys: list[str], features: list[str], y: Column) -> DataFrame:
    """``moments`` with the array lengths kept as column metadata."""
    k = len(features)
    m = moments(df, keys, features, y)
    return m.select(*keys, "n", "sy", *[F.col(c).alias(c, metadata={"size": s}) for c, s in (("sx", k), ("sxx", k * k), ("sxy", k))])


def _solve(row: pd.Series, pick: list[int], k: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, sx = row["n"], np.asarray(row["sx"], float)[pick]
    sxx = np.asarray(row["sxx"], float).reshape(k, k)[np.ix_(pick, pick)]
    mu = sx / n
    cov = sxx / n - np.outer(mu, mu)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    gram = n * cov / np.outer(sd, sd)
    xy = (np.asarray(row["sxy"], float)[pick] - mu * row["sy"]) / sd
    # standardised features have zero mean, so the intercept is the mean of y and needs no joint solve
    beta = np.linalg.solve(gram + alpha * np.eye(len(pick)), xy)
    return mu, sd, np.r_[row["sy"] / n, beta]


def fit_ridge(mom: DataFrame, keys: list[str], features: list[str], candidates: list[list[str]], alpha: float = 1.0) -> DataFrame:
    """Coefficients for every moment row and candidate: keys, cand, mu, sd, beta (intercept first).

    Vectors have the length of ``features``; unused features get a zero coefficient.
    """
    k = len(features)
    index = [[features.index(f) for f in c] for c in candidates]

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                for c, pick in enumerate(index):
                    mu, sd, beta = np.zeros(k), np.ones(k), np.zeros(k + 1)
                    m, s, b = _solve(r, pick, k, alpha)
                    mu[pick], sd[pick], beta[0], beta[[i + 1 for i in pick]] = m, s, b[0], b[1:]
                    rows.append([*[r[x] for x in keys], c, mu.tolist(), sd.tolist(), beta.tolist()])
            yield pd.DataFrame(rows, columns=[*keys, "cand", "mu", "sd", "beta"])

    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([mom.schema[x] for x in keys] + [T.StructField("cand", T.IntegerType()), T.StructField("mu", arr),
                                                           T.StructField("sd", arr), T.StructField("beta", arr)])
    return mom.mapInPandas(run, schema)


def linear_predictor(features: list[str]) -> Column:
    """Intercept plus standardised features, from the columns mu, sd, beta."""
    eta = F.col("beta")[0]
    for i, f in enumerate(features):
        eta = eta + F.col("beta")[i + 1] * (F.col(f) - F.col("mu")[i]) / F.col("sd")[i]
    return eta


def ridge_predict(features: list[str]) -> Column:
    return F.greatest(F.exp(linear_predictor(features)) - EPS, F.lit(0.0))


def log_density(conc: str = "conc") -> Column:
    return F.log(F.col(conc) + EPS)


def out_of_fold(df: DataFrame, fold: str, features: list[str], candidates: list[list[str]], alpha: float = 1.0) -> DataFrame:
    """Every row predicted by the models that did not see its fold: one row per row and candidate (``cand``, ``pred``)."""
    per = sized_moments(df, [fold], features, log_density())
    coef = fit_ridge(held_out_moments(per, fold, []), ["held"], features, candidates, alpha)
    return df.join(F.broadcast(coef), F.col(fold).cast("int") == F.col("held")).withColumn("pred", ridge_predict(features)).drop("mu", "sd", "beta", "held")


def candidate_errors(df: DataFrame, fold: str, features: list[str], candidates: list[list[str]], alpha: float = 1.0) -> DataFrame:
    return out_of_fold(df, fold, features, candidates, alpha).groupBy("cand").agg(F.avg(F.abs(F.col("conc") - F.col("pred"))).alias("cv_mae"))


def best_candidate(errors: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    return errors.groupBy(*keys).agg(F.min_by("cand", F.struct("cv_mae", "cand")).alias("cand"))


def nested_predictions(df: DataFrame, fold: str, k: int, features: list[str], candidates: list[list[str]], alpha: float = 1.0) -> DataFrame:
    """Feature choice repeated without each outer fold, then its rows predicted: adds ``cand`` and ``pred``.

    Fold sums are few: leaving out two folds is another subtraction, so the data are read twice in all.
    """
    per = sized_moments(df, [fold], features, log_density()).withColumn(fold, F.col(fold).cast("int"))
    pairs = per.withColumn("outer", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(k - 1)), F.col(fold))))
    pairs = pairs.select("outer", F.col(fold), "n", "sy", *[F.col(c).alias(c, metadata={"size": len_of(per, c)}) for c in ("sx", "sxx", "sxy")])
    inner = held_out_moments(pairs, fold, ["outer"])
    coef = fit_ridge(inner, ["outer", "held"], features, candidates, alpha)
    long = other_folds(df, fold, k, "outer").withColumn("_f", F.col(fold).cast("int"))
    err = (long.join(F.broadcast(coef.where("held >= 0")), (long["outer"] == coef["outer"]) & (F.col("_f") == F.col("held"))).select(
        long["outer"], "cand", F.abs(F.col("conc") - ridge_predict(features)).alias("e")).groupBy("outer", "cand").agg(F.avg("e").alias("cv_mae")))
    chosen = best_candidate(err, ["outer"])
    final = coef.where("held = -1").join(chosen, ["outer", "cand"])
    return df.join(F.broadcast(final), F.col(fold).cast("int") == F.col("outer")).withColumn("pred", ridge_predict(features)).drop(
        "mu", "sd", "beta", "held", "outer")


def serve_choice(models: DataFrame, main: str) -> DataFrame:
    """The model that serves: a baseline only if its error is surely lower, the best such one; otherwise the main one.

    ``models``: model, delta_lo (lower bound of main minus model), mae.
    """
    better = models.where((F.col("delta_lo") > 0) & (F.col("model") != main))
    return better.agg(F.coalesce(F.min_by("model", F.struct("mae", "model")), F.lit(main)).alias("serve"))


# ---- count regression ----------------------------------------------------------------------------------------------

def count_regression(df: DataFrame, features: list[str], n: str = "n_items", area: str = "area_km2"):
    """Poisson regression of counts with the log area as offset, and the over-dispersion by moments.

    Returns (fitted Spark model, mu, sd, alpha): alpha = Σ((y-μ)²-μ) / Σμ², at least zero.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    check_predictors(features)
    d = df.where(F.col(n).isNotNull() & (F.col(area) > 0))
    st = d.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    mu, sd = [st[f"m_{f}"] for f in features], [st[f"s_{f}"] or 1.0 for f in features]
    d = d.withColumns({f"z_{f}": (F.col(f) - m) / s for f, m, s in zip(features, mu, sd)}).withColumn("_off", F.log(F.col(area)))
    d = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_x").transform(d)
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol=n, featuresCol="_x", offsetCol="_off", predictionCol="mu_hat", maxIter=50).fit(d)
    p = model.transform(d)
    a = p.agg((F.sum(F.pow(F.col(n) - F.col("mu_hat"), 2) - F.col("mu_hat")) / F.sum(F.col("mu_hat") * F.col("mu_hat"))).alias("a")).first()["a"]
    return model, mu, sd, max(a, 0.0)


# ---- serving -------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class DensityModel:
    """A fitted model with its calibration and field of use."""
    profile: str
    kind: str                       # loglinear or count
    features: tuple[str, ...]
    mu: tuple[float, ...]
    sd: tuple[float, ...]
    beta: tuple[float, ...]
    q80: tuple[float, float]
    q95: tuple[float, float]
    basins: tuple[str, ...]
    months: tuple[int, ...]
    ranges: dict = field(default_factory=dict)
    version: str = "1"

    def eta(self) -> Column:
        e = F.lit(self.beta[0])
        for f, m, s, b in zip(self.features, self.mu, self.sd, self.beta[1:]):
            e = e + b * (F.col(f) - m) / s
        return e

    def value(self) -> Column:
        return F.exp(self.eta()) if self.kind == "count" else F.greatest(F.exp(self.eta()) - EPS, F.lit(0.0))


def score_points(points: DataFrame, model: DensityModel, train: DataFrame, pid: str, train_id: str, cfg=APPLICABILITY) -> DataFrame:
    """Density, intervals, status and reasons at points (lon, lat, month_no and features).

    Points outside the basins of the profile never reach the neighbour search.
    """
    inside = in_basins(F.col("lon"), F.col("lat"), model.basins)
    p = points.withColumn("_in", inside)
    near = nearest(p.where("_in"), train, qid=pid, rid=train_id).select(pid, F.col("dist").alias("nearest_field_km"))
    p = p.join(near, pid, "left")
    why = [F.when(F.coalesce(F.col("nearest_field_km") > cfg.validated_radius_km, F.lit(True)), F.lit("far from field data")),
           F.when(~F.col("month_no").isin(*model.months), F.lit("month outside training"))]
    for f, (a, b) in model.ranges.items():
        if f not in ("lon", "lat"):
            span = (b - a) * cfg.feature_margin
            why.append(F.when(~F.col(f).between(a - span, b + span), F.lit(f"{f} outside training range")))
    p = p.withColumn("_why", F.array_compact(F.array(*why)))
    v = model.value()
    lo80, hi80 = apply_interval(v, F.lit(model.q80[0]), F.lit(model.q80[1]))
    lo95, hi95 = apply_interval(v, F.lit(model.q95[0]), F.lit(model.q95[1]))
    p = p.withColumns({n: F.when(F.col("_in"), c) for n, c in (("value", v), ("lo80", lo80), ("hi80", hi80), ("lo95", lo95), ("hi95", hi95))})
    return p.withColumns({
        "status": F.when(~F.col("_in"), F.lit("unavailable")).when(F.size("_why") > 0, F.lit("research_estimate")).otherwise(F.lit("model_estimate")),
        "reasons": F.when(~F.col("_in"), F.lit("outside the basins of the profile")).otherwise(F.concat_ws("; ", "_why")),
        "model_version": F.lit(model.version), "profile": F.lit(model.profile)}).drop("_in", "_why")


def calculation_steps(model: DensityModel) -> Column:
    """The estimate step by step as an array of (label, value)."""
    def step(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.cast("double").alias("value"))
    out = [step(f"z {f}", (F.col(f) - m) / s) for f, m, s in zip(model.features, model.mu, model.sd)]
    lo, hi = apply_interval(model.value(), F.lit(model.q80[0]), F.lit(model.q80[1]))
    return F.array(*out, step("linear predictor", model.eta()), step("estimate", model.value()), step("lo80", lo), step("hi80", hi))


def availability(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys, "profile").agg(F.max((F.col("status") != "unavailable")).alias("available"))


def line_points(lines: DataFrame, n: int = 41) -> DataFrame:
    """Points at equal steps along every line (ax, ay, bx, by): adds step_no, lon, lat."""
    d = lines.withColumn("step_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("step_no") / (n - 1)
    return d.withColumns({"lon": F.col("ax") + (F.col("bx") - F.col("ax")) * t, "lat": F.col("ay") + (F.col("by") - F.col("ay")) * t})


# ---- pixel classifier ----------------------------------------------------------------------------------------------

def train_forest(px: DataFrame, features: list[str], label: str, weight: str, *, trees: int = 30, depth: int = 8, seed: int = 0):
    """Random forest over the pixel features with class weights; returns (model, assembler)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol=weight, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability")
    # the forest reads its rows once per tree level: keep them instead of choosing and weighting them again
    rows = va.transform(px).select("features", label, weight).persist()
    try:
        return rf.fit(rows), va
    finally:
        rows.unpersist()


def predict_by_model(df: DataFrame, fitted: dict[str, tuple], key: str, out: str = "prediction") -> DataFrame:
    """The class by the model of the row's ``key``; ``fitted``: key → (model, assembler), all on the same features.

    The rows are read once and only the model of its key works on a row; rows of other keys are left out.
    """
    d = next(iter(fitted.values()))[1].transform(df.where(F.col(key).isin(*fitted)))
    at = None
    for i, (k, (model, _)) in enumerate(fitted.items()):
        # neither votes nor probabilities are wanted
        d = model.copy().setRawPredictionCol("").setProbabilityCol("").setPredictionCol(f"_p{i}").transform(d)
        at = F.when(F.col(key) == k, F.col(f"_p{i}")) if at is None else at.when(F.col(key) == k, F.col(f"_p{i}"))
    return d.select(*df.columns, at.alias(out))


BINS = 32           # intervals of a feature between which a split may lie, as in Spark's forests
CHUNK_ROWS = 1 << 18        # rows of a task that are counted at a time


def held_out_cuts(df: DataFrame, features: list[str], group: str, groups: list[str]) -> dict[str, list[np.ndarray]]:
    """Where splits may lie for the rows outside each of ``groups``: per feature the last values of at most ``BINS`` intervals.

    Intervals hold equal numbers of rows, or one value each where there are no more values than that. Ranks are counted over
    all rows: different values are put in order by range partitions, with the rows of every group beside them.
    """
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias("v")) for i, c in enumerate(features)]))
    every = df.select(group, at.alias("_x")).select(group, "_x.*").groupBy("f", "v").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(group) == g).alias(f"n{i}") for i, g in enumerate(groups)])
    counts = ["n", *[f"n{i}" for i in range(len(groups))]]
    run = materialise(running_totals(every, ["f", "v"], {f"r_{c}": c for c in counts}))
    base = run.groupBy("f").agg(*[F.min(F.col(f"r_{c}") - F.col(c)).alias(f"b_{c}") for c in counts])
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), (F.col("n") - F.col(f"n{i}")).alias("c"),
                                       (F.col("r_n") - F.col("b_n") - F.col(f"r_n{i}") + F.col(f"b_n{i}")).alias("hi")) for i in range(len(groups))]))
    ranked = run.join(F.broadcast(base), "f").select("f", "v", per.alias("_p")).select("f", "v", "_p.*").where("c > 0")
    size = ranked.groupBy("f", "g").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values"))
    share = [F.floor(x * BINS / F.col("n")) for x in (F.col("hi") - F.col("c"), F.col("hi"))]
    cut = ranked.join(F.broadcast(size), ["f", "g"]).where((F.col("hi") < F.col("n")) & ((F.col("values") <= BINS) | (share[0] < share[1])))
    out = {g: [[] for _ in features] for g in groups}
    for r in cut.select("g", "f", "v").collect():       # less than BINS per group and feature
        out[groups[r["g"]]][r["f"]].append(r["v"])
    return {g: [np.sort(np.array(v, np.float64)) for v in per] for g, per in out.items()}


def held_out_cells(df: DataFrame, features: list[str], cuts: dict[str, list[np.ndarray]], group: str, label: str, cls: str) -> DataFrame:
    """All rows counted by the intervals of their features, once for every group: ``held, own, label, cls, cell, n``.

    Rows of the group itself (``own``) keep their ``cls``, the others their ``label``. A forest looks at intervals only, so
    this is all it needs of the rows; there are at most ``BINS`` to the number of features cells of a class.
    """
    groups = list(cuts)
    joint = [np.unique(np.concatenate([cuts[g][f] for g in groups])) for f in range(len(features))]
    # the interval of a value among all cuts decides that among the cuts of one group
    of = [[np.searchsorted(cuts[g][f], np.append(joint[f], np.inf)) for f in range(len(features))] for g in groups]
    names = ["held", "own", "label", "cls", "cell", "n"]
    if BINS ** len(features) * 2 ** 16 > 2 ** 62:
        raise ValueError("too many features for one number per cell")

    def run(batches):
        def count(t: pa.Table):
            place = [np.searchsorted(j, t[f"_f{f}"].to_numpy()) for f, j in enumerate(joint)]
            own, y, c = (t[x].to_numpy() for x in ("_g", "_y", "_c"))
            for g in range(len(groups)):
                mine = own == g
                code = np.zeros(len(mine), np.int64)
                for f, p in enumerate(place):
                    code = code * BINS + of[g][f][p]
                code = (code << 16) | np.where(mine, c.astype(np.int64) << 1 | 1, y.astype(np.int64) << 1)
                code, n = np.unique(code[mine | (y >= 0)], return_counts=True)
                is_own, value = (code & 1).astype(bool), code >> 1 & 0x7fff
                yield pa.RecordBatch.from_arrays([pa.array([groups[g]] * len(n), pa.string()), pa.array(is_own), pa.array(np.where(is_own, 0, value).astype(np.int32)),
                                                  pa.array(np.where(is_own, value, 0).astype(np.int32)), pa.array(code >> 16), pa.array(n.astype(np.int64))], names)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield from count(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from count(pa.Table.from_batches(held))

    at = F.lit(-1)
    for i, g in enumerate(groups):
        at = F.when(F.col(group) == g, i).otherwise(at)
    rows = df.where(F.col(group).isNotNull() & F.col(cls).isNotNull()).select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_f{i}") for i, c in enumerate(features)], at.alias("_g"),
        F.coalesce(F.col(label), F.lit(-1)).cast("int").alias("_y"), F.col(cls).cast("int").alias("_c"))
    return rows.mapInArrow(run, "held string, own boolean, label int, cls int, cell bigint, n bigint").groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def grow_tree(bins: np.ndarray, label: np.ndarray, n: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree of a forest on counted cells: feature (-1: leaf) and last interval to the left of every node, shares of the classes.

    Every row would be drawn a Poisson number of times; the draws of the ``n`` rows of a cell sum up to one draw of mean
    ``n``, so the tree has the law of one on the rows. Classes weigh the same, a node looks at √features of them, Gini decides.
    Node i has the children 2i + 1 and 2i + 2.
    """
    total = np.bincount(label, n, classes)
    drawn = rng.poisson(n).astype(np.float64)
    w = drawn * (total.sum() / (classes * np.maximum(total, 1)))[label]
    f, some = bins.shape[1], int(np.ceil(np.sqrt(bins.shape[1])))
    size = 2 ** (depth + 1) - 1
    feature, cut, share = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros((size, classes))
    node = np.zeros(len(n), np.int64)
    live = drawn > 0
    bins, label, w, node, drawn = bins[live], label[live], w[live], node[live], drawn[live]

    def gini(x: np.ndarray) -> np.ndarray:
        """Impurity times weight."""
        s = x.sum(-1)
        return s - (x * x).sum(-1) / np.maximum(s, 1e-300)

    for level in range(depth + 1):
        first, width = 2 ** level - 1, 2 ** level
        at = node - first
        here = np.bincount(at * classes + label, w, width * classes).reshape(width, classes)
        share[first:first + width] = here
        if level == depth or not len(at):
            break
        allowed = rng.random((width, f)).argsort(1)[:, :some]
        best, choice, where = np.full(width, -np.inf), np.full(width, -1), np.zeros(width, np.int64)
        for k in range(f):
            hist = np.bincount((at * BINS + bins[:, k]) * classes + label, w, width * BINS * classes).reshape(width, BINS, classes)
            count = np.bincount(at * BINS + bins[:, k], drawn, width * BINS).reshape(width, BINS)
            left, n_left = hist.cumsum(1), count.cumsum(1)
            gain = gini(here)[:, None] - gini(left) - gini(here[:, None] - left)
            gain[(n_left < 1) | (n_left > n_left[:, -1:] - 1)] = -np.inf
            place = gain.argmax(1)
            top = gain[np.arange(width), place]
            better = (allowed == k).any(1) & (top > best)
            best[better], choice[better], where[better] = top[better], k, place[better]
        choice[best <= 1e-12 * np.maximum(here.sum(1), 1e-300)] = -1
        feature[first:first + width], cut[first:first + width] = choice, where
        goes = choice[at] >= 0
        bins, label, w, node, drawn, at = bins[goes], label[goes], w[goes], node[goes], drawn[goes], at[goes]
        node = 2 * node + 1 + (bins[np.arange(len(at)), choice[at]] > where[at])
    return feature, cut, share / np.maximum(share.sum(1), 1e-300)[:, None]


def forest_votes(bins: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Shares of the classes at the leaf of every cell, summed over the trees."""
    out = np.zeros((len(bins), trees[0][2].shape[1]))
    row = np.arange(len(bins))
    for feature, cut, share in trees:
        node = np.zeros(len(bins), np.int64)
        while True:
            goes = feature[node] >= 0
            if not goes.any():
                break
            node = np.where(goes, 2 * node + 1 + (bins[row, feature[node]] > cut[node]), node)
        out += share[node]
    return out


def leave_group_out(df: DataFrame, features: list[str], label: str, cls: str, group: str, groups: list[str], n_classes: int, *,
                    trees: int = 30, depth: int = 8, seed: int = 0) -> DataFrame:
    """Every row of every group by the forest that is fitted on all rows of the other groups: ``group, cls, prediction, n``.

    No row is left out: cuts are ranks among all rows, cells count all rows, draws are those of all rows. Beyond the
    cells, nothing grows with the rows. Trees are grown in tasks of their own; draws depend on cell, tree and group alone.
    """
    cells = materialise(held_out_cells(df, features, held_out_cuts(df, features, group, groups), group, label, cls))
    one = F.sort_array(F.collect_list(F.struct("cell", F.when(F.col("own"), F.col("cls")).otherwise(F.col("label")).alias("y"), "n")))
    train, test = (cells.where(w).groupBy("held").agg(one.alias("cells")) for w in ("not own", "own"))

    def unpack(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, y, n = (x.values.field(c).to_numpy(zero_copy_only=False) for c in ("cell", "y", "n"))
        return np.stack([cell // BINS ** (len(features) - 1 - f) % BINS for f in range(len(features))], 1), y, n

    def grow(batches):
        for b in batches:
            for r in range(b.num_rows):
                bins, y, n = unpack(b.column("cells")[r])
                held, tree = b.column("held")[r].as_py(), b.column("tree")[r].as_py()
                feature, cut, share = grow_tree(bins, y, n, n_classes, depth, np.random.default_rng([seed, groups.index(held), tree]))
                yield pa.RecordBatch.from_pydict({"held": [held], "tree": pa.array([tree], pa.int32()), "feature": pa.array([feature], pa.list_(pa.int32())),
                                                  "cut": pa.array([cut], pa.list_(pa.int32())), "share": pa.array([share.ravel()], pa.list_(pa.float64()))})

    def vote(batches):
        for b in batches:
            for r in range(b.num_rows):
                bins, y, n = unpack(b.column("cells")[r])
                grown = [(*(np.array(t[c]) for c in ("feature", "cut")), np.array(t["share"]).reshape(-1, n_classes)) for t in b.column("forest")[r].as_py()]
                code, at = np.unique(y.astype(np.int64) * n_classes + forest_votes(bins, grown).argmax(1), return_inverse=True)
                yield pa.RecordBatch.from_pydict({"held": [b.column("held")[r].as_py()] * len(code), "cls": pa.array((code // n_classes).astype(np.int32)),
                                                  "prediction": pa.array((code % n_classes).astype(np.int32)), "n": pa.array(np.bincount(at, n, len(code)).astype(np.int64))})

    # few rows, costly for their size: a tree is a task's work
    wanted = train.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "held", "tree")
    grown = wanted.mapInArrow(grow, "held string, tree int, feature array<int>, cut array<int>, share array<double>")
    forest = grown.groupBy("held").agg(F.sort_array(F.collect_list(F.struct("tree", "feature", "cut", "share"))).alias("forest"))
    votes = forest.join(test.hint("merge"), "held").mapInArrow(vote, "held string, cls int, prediction int, n bigint")
    return votes.select(F.col("held").alias(group), F.col("cls").alias(cls), "prediction", "n")


def score_pixels(px: DataFrame, model, assembler, gate: Column, valid: Column, water_group: int = 4) -> DataFrame:
    """Debris probability and winning group; only gated pixels run through the model, others are water, invalid 255."""
    from pyspark.ml.functions import vector_to_array
    px = px.withColumns({"_gate": gate, "_valid": valid})
    hit = model.transform(assembler.transform(px.where("_gate")))
    hit = hit.withColumn("_p", vector_to_array("probability")).withColumns({"p": F.col("_p")[0], "grp": F.col("prediction").cast("int")})
    cols = [c for c in px.columns if not c.startswith("_")]
    rest = px.where(~F.coalesce(F.col("_gate"), F.lit(False))).withColumns({"p": F.lit(0.0), "grp": F.lit(water_group)})
    out = hit.select(*cols, "_valid", "p", "grp").unionByName(rest.select(*cols, "_valid", "p", "grp"))
    return out.withColumn("grp", F.when(F.col("_valid"), F.col("grp")).otherwise(F.lit(255))).drop("_valid")


def average_precision(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Area under precision over recall: Σ (R_k - R_k-1)·P_k over the distinct scores from the top."""
    c = df.groupBy(*keys, (-F.col(score)).alias("_s")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(F.col(truth)).alias("_y"))
    run = running_totals(c, [*keys, "_s"], {"_n": "_c", "_t": "_y"})
    base = run.groupBy(*keys).agg(F.min(F.col("_n") - F.col("_c")).alias("_bn"), F.min(F.col("_t") - F.col("_y")).alias("_bt"), F.sum("_y").alias("_np"))
    r = run.join(base, keys)
    p = (F.col("_t") - F.col("_bt")) / (F.col("_n") - F.col("_bn"))
    return r.groupBy(*keys).agg((F.sum(F.col("_y") * p) / F.max("_np")).alias("ap"))


def class_report(df: DataFrame, keys: list[str], label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    c = df.groupBy(*keys, F.col(label).alias("cls"), F.col(pred).alias("prd")).agg(F.count(F.lit(1)).alias("n"))
    long = c.select(*keys, F.explode(F.array(
        F.struct(F.col("cls").alias("c"), F.when(F.col("cls") == F.col("prd"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("pp"), F.col("n").alias("sup")),
        F.struct(F.col("prd").alias("c"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("pp"), F.lit(0).cast("bigint").alias("sup")))).alias("s")).select(*keys, "s.*")
    g = long.groupBy(*keys, F.col("c").alias("cls")).agg(F.sum("tp").alias("tp"), F.sum("pp").alias("predicted"), F.sum("sup").alias("support"))
    p, r = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return g.withColumns({"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))})
