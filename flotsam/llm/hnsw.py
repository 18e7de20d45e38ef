"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard."""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.operators.ranking import top_k
from flotsam.session import materialise

SHARD_ROWS = 2048       # different vectors in a shard, about
LINKS = 16              # neighbours of a node on the upper layers; twice as many on the lowest
BUILD_WIDTH = 40        # candidates kept while a node is inserted
SEARCH_WIDTH = 64       # candidates kept while a query is answered
BLOCK = 2048            # queries that visit a shard together


class Graph:
    """The graph of one shard. Nodes are ordered by falling level, so layer l holds the first ``counts[l]`` nodes;
    ``layers[l]`` is the flat array of their neighbours, -1 where there is none."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers
        self.mark = np.zeros(len(x), np.int64)
        self.round = 0

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH, seed: int = 1) -> tuple[Graph, np.ndarray]:
        """Graph over the rows of ``x``, and the order its nodes are in."""
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-300) / np.log(links)).astype(np.int64)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        counts = [int((level >= i).sum()) for i in range(int(level[0]) + 1)] if n else []
        g = cls(np.ascontiguousarray(x[order]), [np.full((c, links * (1 if i else 2)), -1, np.int32) for i, c in enumerate(counts)])
        for q in range(1, n):
            g._insert(q, int(level[q]), links, width)
        return g, order

    def _distance(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _search_layer(self, q: np.ndarray, near: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        self.round += 1
        mark, rnd, links = self.mark, self.round, self.layers[layer]
        for _, i in near:
            mark[i] = rnd
        todo = list(near)
        heapq.heapify(todo)
        best = [(-d, i) for d, i in near]
        heapq.heapify(best)
        while todo:
            d, c = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            ids = links[c]
            ids = ids[ids >= 0]
            ids = ids[mark[ids] != rnd]
            if not len(ids):
                continue
            mark[ids] = rnd
            dist = self._distance(ids, q)
            if len(best) >= width:
                ok = dist < -best[0][0]
                ids, dist = ids[ok], dist[ok]
            for e, i in zip(dist.tolist(), ids.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-e, i))
                    heapq.heappush(todo, (e, i))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, i))
                    heapq.heappush(todo, (e, i))
        return sorted((-d, i) for d, i in best)

    def _choose(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours nearer to the node than to any chosen before, then the nearest of the rest."""
        if len(near) <= most:
            return [i for _, i in near]
        ids = np.array([i for _, i in near])
        v = self.x[ids]
        sq = np.einsum("ij,ij->i", v, v)
        between = sq[:, None] + sq[None, :] - 2 * (v @ v.T)
        own = np.array([d for d, _ in near])
        free = np.ones(len(ids), bool)
        chosen: list[int] = []
        for k in range(len(ids)):
            if free[k]:
                chosen.append(k)
                if len(chosen) == most:
                    break
                free[k + 1:] &= between[k, k + 1:] >= own[k + 1:]
        if len(chosen) < most:
            have = set(chosen)
            chosen += [k for k in range(len(ids)) if k not in have][:most - len(chosen)]
        return ids[chosen].tolist()

    def _insert(self, q: int, level: int, links: int, width: int) -> None:
        v = self.x[q]
        near = [(float(self._distance(np.array([0]), v)[0]), 0)]
        for layer in range(len(self.layers) - 1, -1, -1):
            if layer > level:
                near = self._search_layer(v, near, 1, layer)
                continue
            near = self._search_layer(v, near, width, layer)
            near = [(d, i) for d, i in near if i != q]
            table = self.layers[layer]
            chosen = self._choose(near, links)
            table[q, :len(chosen)] = chosen
            for i in chosen:
                row = table[i]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = q
                    continue
                ids = np.append(row, q)
                d = self._distance(ids, self.x[i])
                o = np.argsort(d, kind="stable")
                row[:] = self._choose(list(zip(d[o].tolist(), ids[o].tolist())), len(row))

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        near = [(float(self._distance(np.array([0]), q)[0]), 0)]
        for layer in range(len(self.layers) - 1, 0, -1):
            near = self._search_layer(q, near, 1, layer)
        return self._search_layer(q, near, width, 0)


def usable(vector: Column) -> Column:
    """Not null, not empty, not all zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _build_shard(t: pa.Table) -> pa.Table:
    x = t["vec"].combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
    g, order = Graph.build(x.astype(np.float32))
    ids = t["ids"].combine_chunks().take(pa.array(order))
    return pa.table({"dim": t["dim"][:1], "shard": t["shard"][:1], "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                     "vectors": pa.array([x[order].astype("<f8").tobytes()], pa.binary()), "counts": pa.array([[len(a) for a in g.layers]], pa.list_(pa.int32())),
                     "neighbours": pa.array([b"".join(a.astype("<i4").tobytes() for a in g.layers)], pa.binary())})


def build_index(rows: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: ``dim, shard, ids, vectors, counts, neighbours`` from ``vec_id, vec``.

    Equal vectors are one node, which carries its ``keep`` smallest ids: no more of them can be among a query's
    nearest, and a vector that a third of all rows share neither fills a shard nor breaks its graph. Shards are random,
    so each is a sample of the whole. Every vector is indexed.
    """
    first = top_k(rows.select("vec_id", "vec"), ["vec"], [F.col("vec_id")], keep, salt_on="vec_id")
    nodes = materialise(first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vec")))
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    return materialise(nodes.groupBy("dim", "shard").applyInArrow(
        _build_shard, "dim int, shard int, ids array<array<long>>, vectors binary, counts array<int>, neighbours binary"))


def _answer(k: int, width: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list = []
        if index.num_rows and queries.num_rows:
            r = index.to_pylist()[0]
            x = np.frombuffer(r["vectors"], "<f8").reshape(-1, r["dim"])
            flat, at, layers = np.frombuffer(r["neighbours"], "<i4"), 0, []
            for i, c in enumerate(r["counts"]):
                m = LINKS * (1 if i else 2)
                layers.append(flat[at:at + c * m].reshape(c, m))
                at += c * m
            g = Graph(x.astype(np.float32), layers)
            q = queries["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(queries.num_rows, -1).astype(np.float64)
            for v in q:
                near = np.array([i for _, i in g.search(v.astype(np.float32), width)])
                d = np.sqrt(((x[near] - v) ** 2).sum(1))
                o = np.argsort(d, kind="stable")
                found = sorted((e, i) for e, n in zip(d[o].tolist(), near[o].tolist()) for i in r["ids"][n])
                out.append([{"score": e, "vec_id": i} for e, i in found[:k]])
        return pa.table({"key": queries["key"] if out else pa.array([], pa.string()),
                         "near": pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))})
    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of every query row, by Euclidean distance.

    Each shard answers with its ``k + 1`` nearest, and the answers are merged; the distances are exact, in double
    precision on the original vectors, ties go to the smaller id. Approximate is only which candidates are met.
    Equal query vectors are searched once.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id;
    vectors of different lengths never meet. With fewer than ``k`` candidates all are returned; no rows give no rows;
    rows repeated with their id count as one; other columns are ignored. An id with several different vectors is a
    query with each of them: every vector gets its own ``k`` answers with its own ranks, and the id's rows with other
    vectors are other rows like any; only the row itself, of the same id at distance zero, is left out.
    """
    rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("vec"), is_query.alias("_q"))
    rows = materialise(rows.groupBy("vec_id", "vec").agg(F.max("_q").alias("_q")))
    index = build_index(rows, k + 1, shard_rows)
    asked = rows.where("_q").select("vec_id", "vec")
    # an id is no key: it may carry several vectors
    different = materialise(asked.select("vec").distinct().select("vec", F.md5(F.to_json(F.struct("vec"))).alias("key"), F.size("vec").alias("dim")))
    blocks = max(1, -(-different.count() // BLOCK))
    shards = index.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    visits = different.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).join(shards, "dim")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    found = copies.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInArrow(_answer(k + 1, width), "key string, near array<struct<score: double, vec_id: bigint>>")
    merged = found.groupBy("key").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    merged = materialise(merged.join(different, "key").select("vec", "near"))
    own = asked.join(merged, "vec").select(F.col("vec_id").alias("query_id"), F.slice(
        F.filter("near", lambda x: (x["vec_id"] != F.col("vec_id")) | (x["score"] > 0)), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("_i", "x")).select(
        "query_id", (F.col("_i") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
