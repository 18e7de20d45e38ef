"""Hashed n-grams over whole batches of text, and labelled samples for fitting."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.llm.common import WHITE
from flotsam.session import materialise

BITE = 1 << 17      # code points that are worked on at a time
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def char_grams(points: np.ndarray, n: int) -> np.ndarray:
    """32-bit hash of the ``n`` code points from every position (fewer positions than points by n - 1)."""
    m = len(points) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = (points[:m] + np.uint32(n)) * _MULTIPLIERS[0]
    for j in range(1, n):
        h ^= points[j:m + j]
        h *= _MULTIPLIERS[1]
    h ^= h >> np.uint32(15)
    return h


def bites(texts: pa.Array, overlap: int, lower: bool = True, whole_words: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(row of each part, code points, part starts, code points seen before)`` of a text column in bites of bounded size.

    Parts end with a zero. A long text is lower-cased as a whole and comes in parts that overlap by ``overlap`` code
    points; ``seen`` tells how many at a part's start the part before held, so that windows of any length up to ``overlap + 1``
    can be counted once. With ``whole_words`` (and no overlap) parts end before white space, so no word is cut.
    Null is empty.
    """
    rows: list[int] = []
    parts: list[str] = []
    seen: list[int] = []
    held = 0

    def bite():
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)), out=starts[1:])
        points = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
        return np.array(rows, np.int64), points, starts, np.array(seen, np.int64)

    for i, value in enumerate(texts):
        t = value.as_py() or ""
        if lower:
            t = t.lower()
        at = before = 0
        while True:
            end = at + BITE
            while whole_words and end < len(t) and t[end] not in WHITE:
                end += 1
            part = t[at:end]
            rows.append(i)
            parts.append(part)
            seen.append(before)
            held += len(part)
            before = overlap
            at += len(part) - overlap
            if held >= BITE:
                yield bite()
                rows, parts, seen, held = [], [], [], 0
            if at + overlap >= len(t):
                break
    if rows:
        yield bite()


def positions_inside(pos: np.ndarray, n: int, starts: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the positions whose window of ``n`` lies inside one part and not in what was seen before, and their part."""
    part = np.searchsorted(starts, pos, "right") - 1
    ok = (pos + n < starts[part + 1]) & (pos + n > starts[part] + seen[part])
    return pos[ok], part[ok]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``text, y, weight`` (and ``extra``) of at most ``per_class`` learning rows of each class, in an order of hashed ids.

    ``weight`` makes the sample stand for all labelled rows. The bound keeps the list of sampled ids small enough to
    be broadcast, however many labels there are. An id is sampled once per class: of documents that repeat it, the
    first in the order of the columns counts. Rows without a label, or whose label is neither 0 nor 1, are not used.
    """
    y = F.col(label).cast("int")
    known = labels.select("doc_id", y.alias("y")).where(learn & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    ids = None
    for c in (0, 1):
        one = known.where(F.col("y") == c).groupBy("doc_id", "y").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = one if ids is None else ids.unionByName(one)
    ids = materialise(ids.drop("_n"))
    found = docs.select("doc_id", "text", *extra).join(F.broadcast(ids), "doc_id")
    got = materialise(found.groupBy("doc_id", "y").agg(F.min(F.struct("text", *extra)).alias("_row")).select("doc_id", "y", "_row.*"))
    total, seen = ({r["y"]: r["n"] for r in d.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()} for d in (known, got))
    w = F.lit(0.0)
    for c in seen:
        w = F.when(F.col("y") == c, F.lit(max(total[c], seen[c]) / seen[c])).otherwise(w)
    return got.withColumn("weight", w)
