"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import slices, text_of
from flotsam.llm.grams import bites, char_grams, labelled_sample, positions_inside

SIZES = (4, 5, 6)           # lengths of the n-grams
BITS = 22                   # n-grams are hashed to 2**BITS buckets
SAMPLE_PER_CLASS = 6000     # labelled rows of each class the classifier is fitted on, at most
FEATURES = 1 << 12          # buckets with a weight, at most: those that tell the classes apart best
MIN_DOCS = 3                # a bucket must occur in so many sampled documents
CHI_SQUARE = 20.0           # and tell the classes apart by so much, so that chance does not choose
MERGE_AT = 1 << 22          # hits that are held before repeated ones are merged
ALPHA = 1.0                 # smoothing of the counts


@dataclass
class GramModel:
    buckets: np.ndarray     # sorted
    weights: np.ndarray     # log-count ratio times coefficient
    bias: float

    def active(self) -> np.ndarray:
        mask = np.zeros(1 << BITS, bool)
        mask[self.buckets] = True
        return mask


def _hits(texts: pa.Array, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of the texts, of buckets in the mask; each bucket counts once per text."""
    found = []
    for rows, points, starts, seen in bites(texts, max(SIZES) - 1):
        for n in SIZES:
            b = char_grams(points, n) >> np.uint32(32 - BITS)
            pos = np.arange(len(b)) if mask is None else np.flatnonzero(mask[b])
            pos, part = positions_inside(pos, n, starts, seen)
            if len(pos):
                found.append(np.unique((rows[part] << BITS) | b[pos].astype(np.int64)))
        if sum(map(len, found)) > MERGE_AT:
            found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _count(batches):
    """Per task: number of sampled documents of each class that hold a bucket."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for b in (s for batch in batches for s in slices(batch, "text", 1 << 19)):
        y = b.column("y").to_numpy(zero_copy_only=False)
        rows, buckets = _hits(b.column("text"), None)
        for c in (0, 1):
            np.add.at(counts[c], buckets[y[rows] == c], 1)
    at = np.flatnonzero(counts.any(0))
    for i in range(0, len(at), 65536):
        k = at[i:i + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(counts[0, k].astype(np.int64)), pa.array(counts[1, k].astype(np.int64))], ["bucket", "n0", "n1"])


def _fit_linear(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on the scaled 0/1 features by adaptive full-batch gradient steps."""
    n, m = len(y), len(scale)
    w, g2 = np.zeros(m), np.full(m, 1e-8)
    share = weight / weight.sum()
    p = float((share * y).sum())
    b, gb2 = np.log(p / (1 - p)), 1e-8
    x = scale[cols]
    for _ in range(rounds):
        z = np.bincount(rows, w[cols] * x, n) + b
        e = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(cols, e[rows] * x, m) + l2 * w / n
        g2 += g * g
        gb2 += e.sum() ** 2
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * e.sum() / np.sqrt(gb2)
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> GramModel:
    """Fit on a bounded sample of the labelled rows (``SAMPLE_PER_CLASS`` of each class) that ``learn`` admits.

    Counts of the sample are added up on the cluster; the driver sees the chosen buckets (``FEATURES``) and the sampled
    rows' hits among them. With one class only the score is that class; without labels it is 0.
    """
    sample = labelled_sample(docs, labels, label, learn, SAMPLE_PER_CLASS)
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(0)
    if len(sizes) < 2:
        return GramModel(none.astype(np.int64), none, 30.0 if 1 in sizes else -30.0)
    counts = (sample.select("text", "y").mapInArrow(_count, "bucket int, n0 long, n1 long").groupBy("bucket")
              .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_DOCS))
    p1, p0 = F.col("n1") / sizes[1], F.col("n0") / sizes[0]
    pooled = (F.col("n1") + F.col("n0")) / (sizes[0] + sizes[1])
    apart = (p1 - p0) * (p1 - p0) / ((pooled * (1 - pooled) + 1e-9) * (1 / sizes[0] + 1 / sizes[1]))
    top = counts.where(apart >= CHI_SQUARE).orderBy(apart.desc(), "bucket").limit(FEATURES).toArrow().sort_by("bucket")
    buckets = top["bucket"].to_numpy().astype(np.int64)
    n0, n1 = (top[c].to_numpy().astype(np.float64) for c in ("n0", "n1"))
    ratio = np.log((ALPHA + n1) / (2 * ALPHA + sizes[1])) - np.log((ALPHA + n0) / (2 * ALPHA + sizes[0]))
    model = GramModel(buckets, ratio, 0.0)

    def vectors(batches):
        mask = model.active()
        for b in (s for batch in batches for s in slices(batch, "text")):
            rows, hit = _hits(b.column("text"), mask)
            cols = np.searchsorted(model.buckets, hit).astype(np.int32)
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("weight"), pa.ListArray.from_arrays(pa.array(ends), pa.array(cols))], ["y", "weight", "cols"])

    fitted = sample.select("text", "y", "weight").mapInArrow(vectors, "y int, weight double, cols array<int>").toArrow().combine_chunks()
    lists = fitted["cols"].combine_chunks()
    rows = np.repeat(np.arange(len(fitted), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
    w, bias = _fit_linear(rows, lists.values.to_numpy(), ratio, fitted["y"].to_numpy().astype(np.float64), fitted["weight"].to_numpy())
    return GramModel(buckets, w * ratio, bias)


def score(model: GramModel, text_col: str = "text") -> Column:
    """Probability that the text is toxic (double, 0 to 1).

    Whole texts are read, a long one in overlapping parts. Null and empty texts have no n-gram and score the bias;
    repeated rows score alike, other columns do not matter.
    """
    @F.arrow_udf("double")
    def toxic(texts: pa.Array) -> pa.Array:
        rows, hit = _hits(texts, model.active())
        z = np.bincount(rows, model.weights[np.searchsorted(model.buckets, hit)], len(texts)) + model.bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return toxic(text_of(text_col))


def keep_clean(docs: DataFrame, model: GramModel, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, with their columns, that score below the threshold."""
    return docs.select(F.struct(*docs.columns).alias("doc"), score(model).alias("_score")).where(F.col("_score") < threshold).select("doc.*")
