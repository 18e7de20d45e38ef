"""Quality: a factorisation machine over hashed words, structure statistics and metadata."""
from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import slices, text_of
from flotsam.llm.grams import bites, labelled_sample

SAMPLE_PER_CLASS = 4000     # labelled rows of each class the machine is fitted on, at most
WORD_BUCKETS = 1 << 12      # words are hashed to so many features
BINS = 16                   # a statistic is cut into so many bins, at quantiles of the sample
RANK = 8                    # of the pairwise interactions
STATISTICS = ("points", "upper", "digits", "marks", "symbols", "beyond_ascii", "line_ends", "word_length", "distinct_words", "commonest_word",
              "longest_word", "line_length", "recorded_length", "length_gap")
# character classes
SPACE, LOWER, UPPER, DIGIT, MARK, SYMBOL, OTHER, NEWLINE = range(8)


@cache
def _classes() -> np.ndarray:
    """Character class of every code point; the zero that ends a text counts as space."""
    t = np.full(0x110000, OTHER, np.uint8)
    kinds = {"Ll": LOWER, "Lo": LOWER, "Lm": LOWER, "Lu": UPPER, "Lt": UPPER, "Nd": DIGIT, "Po": MARK, "Pd": MARK, "Ps": MARK, "Pe": MARK, "Pi": MARK, "Pf": MARK,
             "Pc": SYMBOL, "Sm": SYMBOL, "Sc": SYMBOL, "Sk": SYMBOL, "So": SYMBOL, "Zs": SPACE, "Zl": NEWLINE, "Zp": NEWLINE}
    for p in range(0x110000):
        t[p] = kinds.get(unicodedata.category(chr(p)), OTHER)
    t[[0, 9, 11, 12, 13]] = SPACE
    t[10] = NEWLINE
    t[[ord(c) for c in "#%&*@/\\"]] = SYMBOL
    return t


_POWERS = np.array([pow(0x01000193, i, 1 << 32) for i in range(256)], np.uint32)


def _words(points: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 32-bit hash of the words (runs without white space)."""
    inside = (cls != SPACE) & (cls != NEWLINE)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, end, np.zeros(0, np.uint32)
    at = np.flatnonzero(inside)
    offset = at - np.repeat(begin, end - begin)
    values = points[at] * _POWERS[offset & 255]
    first = np.zeros(len(begin), np.int64)
    np.cumsum((end - begin)[:-1], out=first[1:])
    h = np.add.reduceat(values, first, dtype=np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x45D9F3B)
    h ^= h >> np.uint32(16)
    return begin, end - begin, h


def raw_features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(statistics of every text, and row, bucket, count of its hashed words)``, whole texts, case kept.

    ``n_chars`` is NaN where it is missing. A long text is read in parts that end at white space.
    """
    n = len(texts)
    counts = np.zeros((n, 8))
    words, length, longest = np.zeros(n), np.zeros(n), np.zeros(n)
    pairs, times = [], []
    for rows, points, starts, _ in bites(texts, 0, lower=False, whole_words=True):
        cls = _classes()[points]
        part = np.repeat(np.arange(len(rows)), np.diff(starts))
        c = np.bincount(part * 8 + cls, minlength=8 * len(rows)).reshape(-1, 8)
        c[:, SPACE] -= 1                # the zero at the end
        np.add.at(counts, rows, c)
        begin, size, h = _words(points, cls)
        owner = rows[part[begin]]
        words += np.bincount(owner, minlength=n)
        length += np.bincount(owner, size, n)
        np.maximum.at(longest, owner, size)
        p, k = np.unique((owner.astype(np.uint64) << np.uint64(32)) | h, return_counts=True)
        pairs.append(p)
        times.append(k)
    pair, inverse = np.unique(np.concatenate(pairs), return_inverse=True) if pairs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    times = np.bincount(inverse, np.concatenate(times), len(pair)) if pairs else np.zeros(0)
    row = (pair >> np.uint64(32)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, row, times)
    total = counts.sum(1)
    some, w = np.maximum(total, 1), np.maximum(words, 1)
    beyond = counts[:, OTHER]
    stats = np.column_stack([
        np.log1p(total), counts[:, UPPER] / some, counts[:, DIGIT] / some, counts[:, MARK] / some, counts[:, SYMBOL] / some, beyond / some,
        counts[:, NEWLINE] / some, length / w, np.bincount(row, minlength=n) / w, most / w, longest, np.log1p(total / (counts[:, NEWLINE] + 1)),
        np.log1p(np.maximum(n_chars, 0)), np.log1p(np.abs(n_chars - total))])
    bucket = ((pair & np.uint64(0xFFFFFFFF)) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    both, back = np.unique(row * WORD_BUCKETS + bucket, return_inverse=True)
    return stats, both // WORD_BUCKETS, both % WORD_BUCKETS, np.bincount(back, times, len(both))


@dataclass
class Machine:
    """Weights of a factorisation machine; features are word buckets, then the bins of every statistic."""
    edges: np.ndarray       # inner bin edges per statistic
    bias: float
    linear: np.ndarray
    factors: np.ndarray     # features x RANK

    def features(self, stats: np.ndarray, row: np.ndarray, bucket: np.ndarray, times: np.ndarray):
        """Sparse matrix ``(row, feature, value)``, rows ascending: words have norm 1 together, a bin has value 1."""
        n = len(stats)
        value = 1 + np.log(times)
        norm = np.sqrt(np.bincount(row, value * value, n))
        value = value / norm[row] if len(row) else value
        rows, cols, values = [row], [bucket], [value]
        for j in range(stats.shape[1]):
            b = np.searchsorted(self.edges[j], stats[:, j], "right")
            b[np.isnan(stats[:, j])] = BINS
            rows.append(np.arange(n))
            cols.append(WORD_BUCKETS + j * (BINS + 1) + b)
            values.append(np.ones(n))
        r, c, v = np.concatenate(rows), np.concatenate(cols), np.concatenate(values)
        order = np.argsort(r, kind="stable")
        return r[order], c[order], v[order]

    def logit(self, n: int, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> np.ndarray:
        """All pairwise interactions in linear time: half of (square of the sum minus sum of the squares) per factor."""
        z = np.bincount(r, self.linear[c] * v, n) + self.bias
        for f in range(RANK):
            x = self.factors[c, f] * v
            z += 0.5 * (np.bincount(r, x, n) ** 2 - np.bincount(r, x * x, n))
        return z


def _train(m: Machine, n: int, r, c, v, y, weight, epochs: int = 12, step: float = 0.1, l2: float = 1e-4, batch: int = 256) -> None:
    rng = np.random.default_rng(7)
    gl, gf, gb = np.full(len(m.linear), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    begin = np.searchsorted(r, np.arange(n + 1))
    weight = weight / weight.mean()
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            ids = order[i:i + batch]
            at = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in ids])
            k = np.repeat(np.arange(len(ids)), begin[ids + 1] - begin[ids])
            cc, vv = c[at], v[at]
            e = (1 / (1 + np.exp(-np.clip(m.logit(len(ids), k, cc, vv), -30, 30))) - y[ids]) * weight[ids] / len(ids)
            ev = e[k] * vv
            used, inv = np.unique(cc, return_inverse=True)
            g = np.bincount(inv, ev) + l2 * m.linear[used]
            gl[used] += g * g
            delta = step * g / np.sqrt(gl[used])
            for f in range(RANK):
                x = m.factors[cc, f]
                s = np.bincount(k, x * vv, len(ids))
                g = np.bincount(inv, ev * (s[k] - x * vv)) + l2 * m.factors[used, f]
                gf[used, f] += g * g
                m.factors[used, f] -= step * g / np.sqrt(gf[used, f])
            m.linear[used] -= delta
            gb += e.sum() ** 2
            m.bias -= step * e.sum() / np.sqrt(gb)


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> Machine:
    """Fit on a bounded sample of the labelled rows (``SAMPLE_PER_CLASS`` of each class) that ``learn`` admits.

    Features are made on the cluster; the driver gets one sparse row (at most ``WORD_BUCKETS`` words) per sampled row.
    With one class only the score is that class; without labels it is 0.
    """
    size = WORD_BUCKETS + len(STATISTICS) * (BINS + 1)
    empty = Machine(np.zeros((len(STATISTICS), BINS - 1)), 0.0, np.zeros(size), np.zeros((size, RANK)))
    sample = labelled_sample(docs, labels, label, learn, SAMPLE_PER_CLASS, ("n_chars",))

    def rows(batches):
        for b in (s for batch in batches for s in slices(batch, "text")):
            stats, row, bucket, times = raw_features(b.column("text"), b.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64))
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), b.column("weight"), pa.array(list(stats), pa.list_(pa.float64())),
                 pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.float32)))],
                ["y", "weight", "stats", "bucket", "times"])

    got = sample.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"), "y", "weight").mapInArrow(
        rows, "y int, weight double, stats array<double>, bucket array<int>, times array<float>").toArrow()
    y = got["y"].to_numpy().astype(np.float64)
    if len(set(y)) < 2:
        empty.bias = 30.0 if len(y) and y[0] == 1 else -30.0
        return empty
    stats, buckets, counts = (got[c].combine_chunks() for c in ("stats", "bucket", "times"))
    stats = stats.flatten().to_numpy().reshape(len(got), -1)
    row = np.repeat(np.arange(len(got)), np.diff(buckets.offsets.to_numpy()))
    bucket, times = buckets.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.float64)
    with np.errstate(all="ignore"):
        edges = np.nan_to_num(np.nanquantile(stats, np.arange(1, BINS) / BINS, axis=0).T)
    weight = got["weight"].to_numpy()
    p = float((weight * y).sum() / weight.sum())
    m = Machine(edges, float(np.log(p / (1 - p))), np.zeros(size), np.random.default_rng(3).normal(0, 0.01, (size, RANK)))
    _train(m, len(got), *m.features(stats, row, bucket, times), y, weight)
    return m


def score(model: Machine, text_col: str = "text", n_chars_col: str = "n_chars") -> Column:
    """Probability of quality (double, 0 to 1). Inputs are the text and its recorded length, nothing else.

    Null text counts as empty; empty texts are scored by their statistics. A missing recorded length has its own bin.
    Repeated rows score alike; other columns do not matter.
    """
    @F.arrow_udf("double")
    def quality(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
        f = model.features(*raw_features(texts, n_chars.to_numpy(zero_copy_only=False).astype(np.float64)))
        return pa.array(1 / (1 + np.exp(-np.clip(model.logit(len(texts), *f), -30, 30))))

    return quality(text_of(text_col), F.col(n_chars_col).cast("double"))
