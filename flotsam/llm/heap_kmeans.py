"""Centroid clustering with heap-ordered bounds: only vectors whose bound has expired are looked at again."""
from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.session import materialise, new_path, release

K, DIMS, SCALE, ROUNDS = 8, 64, 1024, 10
BLOCK = 4096            # vectors of a block, which is one row
LARGEST = 1 << 27       # a whole-number component may not be larger: squared distances are to fit into 64 bits
MARGIN = 1e-12          # relative allowance for the rounding of bounds

BLOCK_SCHEMA = "block long, ids array<long>, vectors binary"
STATE_SCHEMA = "block long, cluster binary, heap_key binary, heap_item binary, heap_size array<int>, change array<long>"


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, v``: the vectors with exactly ``dims`` components, none null or non-finite, as floor(scale * x)."""
    def sound(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))

    as_double = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = as_double.where((F.size("x") == dims) & F.forall("x", sound))
    small = F.forall("x", lambda x: F.abs(x * scale) < LARGEST)
    whole = F.transform("x", lambda x: F.floor(x * scale))
    return kept.select("vec_id", F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}"))).alias("v"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one partition; the block's number comes from the partition, so a task run again repeats it."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            v = part.column("v").flatten().to_numpy().astype("<i4")
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
            yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([v.tobytes()], pa.binary())], ["block", "ids", "vectors"])
            number += 1


# bucketed tables: vectors and bounds of a block meet without a shuffle, round after round

def _buckets(df: DataFrame, number: int) -> DataFrame:
    spark = df.sparkSession
    name, path = f"flotsam_{uuid.uuid4().hex}", new_path(spark)
    df.write.format("parquet").bucketBy(number, "block").option("path", path).saveAsTable(name)
    back = spark.table(name)
    back._written_to, back._named = path, name
    return back


def _drop(table: DataFrame) -> None:
    table.sparkSession.sql(f"DROP TABLE IF EXISTS {table._named}")
    release(table)


# one block

def squared(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = vectors.astype(np.int64) - centre
    return (d * d).sum(1)


class Bounds:
    """Clusters of a block's vectors and one heap per cluster; the smallest key of a heap expires first.

    A key is the vector's gap, the lower bound on its distance to any other centroid less the upper bound on the distance to
    its own, plus the drift its cluster had accumulated when the gap was measured. Drift lowers all gaps of a cluster
    alike, so a heap never has to be reordered for it: a gap is positive as long as its key exceeds the drift.
    """

    def __init__(self, cluster: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.cluster, self.heaps = cluster, heaps

    @classmethod
    def fresh(cls, n: int, k: int) -> Bounds:
        """No vector has a cluster yet: all of them wait, expired, in the first heap."""
        return cls(np.full(n, -1, np.int32), [[(-math.inf, i) for i in range(n)], *[[] for _ in range(k - 1)]])

    @classmethod
    def load(cls, cluster: bytes, key: bytes, item: bytes, sizes: list[int]) -> Bounds:
        pairs = list(zip(np.frombuffer(key, "<f8").tolist(), np.frombuffer(item, "<i4").tolist()))
        cut = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return cls(np.frombuffer(cluster, "<i4").copy(), [pairs[a:b] for a, b in zip(cut, cut[1:])])

    def dump(self) -> tuple[bytes, bytes, bytes, list[int]]:
        flat = [p for h in self.heaps for p in h]
        key = np.array([k for k, _ in flat], "<f8")
        item = np.array([i for _, i in flat], "<i4")
        return self.cluster.astype("<i4").tobytes(), key.tobytes(), item.tobytes(), [len(h) for h in self.heaps]

    def expired(self, drift: np.ndarray) -> np.ndarray:
        """Takes the vectors off their heaps whose centroid may no longer be the nearest, ties included."""
        out = []
        for heap, d in zip(self.heaps, drift.tolist()):
            limit = d * (1 + MARGIN)
            while heap and heap[0][0] <= limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(out, np.int64)

    def assign(self, vectors: np.ndarray, centres: np.ndarray, drift: np.ndarray) -> np.ndarray:
        """Scans the expired vectors exactly; returns what sums and counts of the clusters change by."""
        k, dims = centres.shape
        change = np.zeros((k, dims + 1), np.int64)
        at = self.expired(drift)
        if not len(at):
            return change
        seen = vectors[at]
        d = np.stack([squared(seen, c) for c in centres], 1)
        best = d.argmin(1)                      # of equal distances the smaller number
        row = np.arange(len(at))
        upper = np.sqrt(d[row, best].astype(np.float64))
        d[row, best] = np.iinfo(np.int64).max
        lower = np.sqrt(d.min(1).astype(np.float64)) if k > 1 else np.full(len(at), math.inf)
        key = lower - upper + drift[best] - MARGIN * (lower + upper + drift[best]) if k > 1 else lower
        before = self.cluster[at]
        for c in range(k):
            joins, leaves = (best == c) & (before != c), (before == c) & (best != c)
            for sign, who in ((1, joins), (-1, leaves)):
                change[c, :dims] += sign * seen[who].sum(0, dtype=np.int64)
                change[c, dims] += sign * int(who.sum())
        self.cluster[at] = best
        for c, x, i in zip(best.tolist(), key.tolist(), at.tolist()):
            heapq.heappush(self.heaps[c], (x, i))
        return change


def _round(centres: np.ndarray, drift: np.ndarray, first: bool):
    k, dims = centres.shape

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                v = np.frombuffer(r["vectors"], "<i4").reshape(-1, dims)
                b = Bounds.fresh(len(v), k) if first else Bounds.load(r["cluster"], r["heap_key"], r["heap_item"], r["heap_size"])
                change = b.assign(v, centres, drift)
                cluster, key, item, sizes = b.dump()
                out.append({"block": r["block"], "cluster": cluster, "heap_key": key, "heap_item": item, "heap_size": sizes, "change": change.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("heap_key", pa.binary()), ("heap_item", pa.binary()),
                                                             ("heap_size", pa.list_(pa.int32())), ("change", pa.list_(pa.int64()))]))
    return run


def _told(centres: np.ndarray):
    dims = centres.shape[1]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("vectors")[i].as_py(), "<i4").reshape(-1, dims)
                cluster = np.frombuffer(batch.column("cluster")[i].as_py(), "<i4")
                d = v.astype(np.int64) - centres[cluster]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(cluster), pa.array((d * d).sum(1))], ["vec_id", "cluster", "distance"])
    return run


def _sum_changes(state: DataFrame, k: int, dims: int) -> np.ndarray:
    """Sum of all blocks' changes: added inside every partition first, so k * (dims + 1) rows per partition are shuffled."""
    def run(batches):
        total = np.zeros(k * (dims + 1), np.int64)
        for batch in batches:
            total += batch.column("change").flatten().to_numpy().reshape(batch.num_rows, -1).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "total"])

    rows = state.select("change").mapInArrow(run, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(k * (dims + 1), np.int64)
    for r in rows:
        out[r["place"]] = r["total"]
    return out.reshape(k, dims + 1)


def _drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a round takes off the gaps of each cluster: its own centroid's way and the longest way of any other."""
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(1)) * (1 + MARGIN)
    return np.array([w + (np.delete(way, c).max() if len(way) > 1 else 0.0) for c, w in enumerate(way)])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, dims: int = DIMS, scale: int = SCALE, rounds: int = ROUNDS,
            seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Vectors with exactly ``dims`` components, none null or non-finite, take part, as whole numbers floor(scale * x);
    others do not appear. Centroids start as the ``k`` vectors with the smallest sha256 of ``<seed>:<id>`` (ties, as ids
    may repeat: by the vector; fewer vectors: fewer centroids). Every round assigns each vector to the nearest
    centroid (ties: the smaller number) and moves the centroids to the floor of their vectors' mean; an empty one stays.
    A last assignment follows. All of it is exact: bounds only tell which vectors need no scan.

    Vectors lie in blocks of one row, bounds and heaps of a block in another table with the same buckets, so a round
    reads both without a shuffle and writes the bounds alone. The driver holds centroids and their sums. Null ids are
    kept; repeated rows count again; no rows give no rows; other columns are ignored. A component so large that squared
    distances would not fit into 64 bits raises an error.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col, vector_col, dims, scale)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    start = whole.select("v", F.sha2(text, 256).alias("h")).orderBy("h", "v").limit(k).collect()
    centres = np.array([r["v"] for r in start], np.int64).reshape(len(start), dims)
    k = len(centres)
    if not k:
        return whole.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                            F.lit("").alias("centroid_sha256")).limit(0)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _buckets(whole.mapInArrow(_pack, BLOCK_SCHEMA).repartition(number, "block"), number)
    sums, drift, state = np.zeros((k, dims + 1), np.int64), np.zeros(k), None
    for step in range(rounds + 1):
        known = blocks if state is None else blocks.join(state.drop("change").hint("shuffle_hash"), "block")
        after = _buckets(known.mapInArrow(_round(centres, drift, state is None), STATE_SCHEMA), number)
        if state is not None:
            _drop(state)
        state = after
        if step == rounds:
            break
        sums += _sum_changes(state, k, dims)
        n = sums[:, dims]
        moved = np.where((n > 0)[:, None], sums[:, :dims] // np.maximum(n, 1)[:, None], centres)
        drift = drift + _drifts(centres, moved)
        centres = moved
    rows = materialise(blocks.join(state.select("block", "cluster").hint("shuffle_hash"), "block").mapInArrow(_told(centres), "vec_id long, cluster int, distance long"))
    _drop(state)
    _drop(blocks)
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    told = spark.createDataFrame([(c, s, sum(inertia.values()), names[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
