"""Nearest-neighbour and radius joins by equi-joins on grid cells; no pair is formed that the bounds rule out."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from flotsam.functions.geo import EARTH_KM, haversine_km
from flotsam.operators.ranking import top_k
from flotsam.session import materialise

LEAF_ROWS = 256     # a cell with more points than this is split further
BLOCK_CHUNKS = 64   # chunks of one dense query cell that are answered together
BUFFER_ROWS = 1 << 17       # reference rows that wait for the query cells of a block
MAX_DEPTH = 12      # times a cell's side is quartered at most; what is denser is dealt to chunks by hash


@dataclass(frozen=True)
class Metric:
    """Distance on the sphere (lon, lat in degrees, km) or in a plane; with ``v`` days of age also count."""
    kind: str = "sphere"
    v: float | None = None

    def _combine(self, d: Column, dt: Column | None) -> Column:
        return d if dt is None else F.sqrt(d * d + F.pow(F.lit(float(self.v)) * dt, 2))

    def distance(self, qx, qy, qt, x, y, t) -> Column:
        dt = F.abs(qt - t) if self.v is not None else None
        if self.kind == "sphere":
            return self._combine(haversine_km(qx, qy, x, y), dt)
        return self._combine(F.sqrt(F.pow(qx - x, 2) + F.pow(qy - y, 2)), dt)

    def bounds(self) -> tuple[Column, Column]:
        """Smallest and largest possible distance between a point of the query box (qx0 ...) and one of the box x0 ..."""
        c = F.col
        zero = F.lit(0.0)
        gap = {a: F.greatest(zero, c(f"{a}0") - c(f"q{a}1"), c(f"q{a}0") - c(f"{a}1")) for a in "xy"}
        far = {a: F.greatest(c(f"{a}1") - c(f"q{a}0"), c(f"q{a}1") - c(f"{a}0")) for a in "xy"}
        tl = tu = None
        if self.v is not None:
            tl = F.greatest(zero, c("t0") - c("qt1"), c("qt0") - c("t1"))
            tu = F.greatest(c("t1") - c("qt0"), c("qt1") - c("t0"))
        if self.kind != "sphere":
            return (self._combine(F.sqrt(gap["x"] * gap["x"] + gap["y"] * gap["y"]), tl),
                    self._combine(F.sqrt(far["x"] * far["x"] + far["y"] * far["y"]), tu))
        near = F.radians(F.least(gap["x"], F.greatest(zero, 360 - far["x"])))
        wide = F.radians(F.least(F.lit(180.0), far["x"]))

        def cosines(p: str) -> tuple[Column, Column]:
            c0, c1 = F.cos(F.radians(c(f"{p}y0"))), F.cos(F.radians(c(f"{p}y1")))
            return F.least(c0, c1), F.when((c(f"{p}y0") <= 0) & (c(f"{p}y1") >= 0), F.lit(1.0)).otherwise(F.greatest(c0, c1))

        (qmin, qmax), (rmin, rmax) = cosines("q"), cosines("")

        def arc(dlat: Column, dlon: Column, cc: Column) -> Column:
            a = F.pow(F.sin(F.radians(dlat) / 2), 2) + cc * F.pow(F.sin(dlon / 2), 2)
            return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))

        return self._combine(arc(gap["y"], near, qmin * rmin), tl), self._combine(arc(far["y"], wide, qmax * rmax), tu)

    def pairs(self, q: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> np.ndarray:
        """Distances of the points of ``q`` to those of ``r`` beside them, in the order of operations of ``distance``."""
        qx, qy, x, y = q["x"], q["y"], r["x"], r["y"]
        if self.kind == "sphere":
            h = np.sin(np.radians(y - qy) / 2) ** 2 + np.cos(np.radians(qy)) * np.cos(np.radians(y)) * np.sin(np.radians(x - qx) / 2) ** 2
            d = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))
        else:
            d = np.sqrt((qx - x) ** 2 + (qy - y) ** 2)
        return d if self.v is None else np.sqrt(d * d + (float(self.v) * np.abs(q["t"] - r["t"])) ** 2)

    def matrix(self, q: dict[str, np.ndarray], r: dict[str, np.ndarray]) -> np.ndarray:
        """Distances of all of ``q`` to all of ``r``."""
        return self.pairs({a: w[:, None] for a, w in q.items()}, {a: w[None, :] for a, w in r.items()})

    def vectors(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Points in a space whose squared distances are never larger than the true ones: the sphere by its chords, in km."""
        if self.kind == "sphere":
            lon, lat = np.radians(p["x"]), np.radians(p["y"])
            at = [EARTH_KM * np.cos(lat) * np.cos(lon), EARTH_KM * np.cos(lat) * np.sin(lon), EARTH_KM * np.sin(lat)]
        else:
            at = [p["x"], p["y"]]
        return np.stack([*at, *([float(self.v) * p["t"]] if self.v is not None else [])], 1).astype(np.float64)

    def stretch(self, low: float) -> float:
        """How many times the squared distance is larger than ``low``, that of the vectors, at most."""
        if self.kind != "sphere":
            return 1.0
        half = math.sqrt(min(low, 4 * EARTH_KM * EARTH_KM)) / (2 * EARTH_KM)
        return (math.asin(min(1.0, half)) / half) ** 2 if half > 0 else 1.0


def _group(c: str) -> Column:
    """Group as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _sides(leaves: float, spans: dict[str, float]) -> dict[str, float]:
    """Leaves along every axis: as wide as high, so that a long strip of points does not give long leaves, which meet many others.

    Time, in other units, takes the share it would have of a cube.
    """
    sides = {a: leaves ** (1 / len(spans)) for a in spans}
    plane = sides["x"] * sides["y"]
    narrow, wide = sorted(("x", "y"), key=spans.get)
    sides[narrow] = min(max(1.0, math.sqrt(plane * spans[narrow] / spans[wide])), plane)
    sides[wide] = plane / sides[narrow]
    return sides


def _tree(points: DataFrame, axes: list[str], stats: dict[str, tuple], usual: int) -> DataFrame:
    """Nodes of the pyramid over ``points`` (with finest cells g*): lvl, c*, n, ``stats``, leaf.

    A node is split while it holds more than ``LEAF_ROWS`` points, so the depth is that of the place and not of the densest cell.
    ``stats``: output → (aggregate of points, aggregate of the outputs of finer cells).
    """
    fine = points.groupBy(*[f"g{a}" for a in axes]).agg(F.count(F.lit(1)).alias("n"), *[f.alias(o) for o, (f, _) in stats.items()])
    cells = [f"c{a}" for a in axes]

    def up(lvl: Column) -> list[Column]:
        return [F.floor(F.col(f"g{a}") / F.pow(F.lit(4.0), MAX_DEPTH - lvl)).cast("bigint").alias(f"c{a}") for a in axes]

    def levels(df: DataFrame, first: int, last: int) -> DataFrame:
        return materialise(df.withColumn("lvl", F.explode(F.sequence(F.lit(first), F.lit(last)))).groupBy("lvl", *up(F.col("lvl")))
                           .agg(F.sum("n").alias("n"), *[f(o).alias(o) for o, (_, f) in stats.items()]))

    every = levels(fine, 1, usual)
    dense = every.where((F.col("lvl") == usual) & (F.col("n") > LEAF_ROWS)).select(*cells)
    if usual < MAX_DEPTH and dense.limit(1).count():
        every = every.unionByName(levels(fine.select("*", *up(F.lit(usual))).join(dense, cells, "left_semi").drop(*cells), usual + 1, MAX_DEPTH))
    split = every.where(F.col("n") > LEAF_ROWS).select((F.col("lvl") + 1).alias("lvl"), *[F.col(c).alias(f"p{c}") for c in cells])
    inner = every.where("lvl > 1").select("*", *[F.floor(F.col(c) / 4).cast("bigint").alias(f"p{c}") for c in cells]).join(split, ["lvl", *[f"p{c}" for c in cells]], "left_semi")
    nodes = every.where("lvl = 1").unionByName(inner.select(*every.columns))
    return materialise(nodes.withColumn("leaf", (F.col("n") <= LEAF_ROWS) | (F.col("lvl") == MAX_DEPTH)))


def _in_leaves(points: DataFrame, tree: DataFrame, axes: list[str], held: Column, name: str, salt_on: str) -> DataFrame:
    """``lvl, c*, chunk`` and the points of every leaf, in chunks of about ``LEAF_ROWS``, as one array of structs."""
    cells = [f"c{a}" for a in axes]
    leaves = tree.where("leaf").select("lvl", *cells, F.ceil(F.col("n") / LEAF_ROWS).cast("int").alias("_chunks"))
    levels = sorted(r["lvl"] for r in leaves.select("lvl").distinct().collect())
    if not levels:
        levels = [1]
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("lvl"), *[F.floor(F.col(f"g{a}") / 4 ** (MAX_DEPTH - k)).cast("bigint").alias(f"c{a}") for a in axes]) for k in levels]))
    placed = points.select(held.alias("_h"), F.xxhash64(salt_on).alias("_s"), at.alias("_at")).select("_h", "_s", "_at.*").join(leaves, ["lvl", *cells])
    return placed.groupBy("lvl", *cells, F.pmod(F.col("_s"), F.col("_chunks")).cast("int").alias("chunk")).agg(F.collect_list("_h").alias(name))


def _merge(metric: Metric, k: int, cap_all: float, timed: bool, grouped: bool, names: list[str]):
    """The ``k`` nearest of every query, over the blocks of query leaves that follow each other in the partition.

    Of every block the query leaves come first, then the reference leaves that any of them asks for, the nearest first. Reference
    leaves wait in a buffer and are met by each query leaf in the order of its own bounds. Only the queries' best so
    far and the buffer are held; a leaf that is farther than all of them is passed over.
    """
    def columns(a: pa.StructArray) -> dict[str, np.ndarray]:
        out = {"x": a.field("x").to_numpy(zero_copy_only=False), "y": a.field("y").to_numpy(zero_copy_only=False)}
        if timed:
            out["t"] = a.field("t").to_numpy(zero_copy_only=False)
        return out

    def numbers(groups: pa.Array, known: dict[str, int]) -> np.ndarray:
        """Groups of a block as whole numbers, so that they are compared as such."""
        return np.array([known.setdefault(x, len(known)) for x in groups.to_pylist()], np.int64)

    class Best:
        def __init__(self, leaf: int, queries: pa.StructArray, known: dict[str, int]):
            self.leaf, self.queries, self.q = leaf, queries, columns(queries)
            self.v = metric.vectors(self.q)
            self.mid = np.nan_to_num(self.v).mean(0)
            self.v -= self.mid
            self.v2 = (self.v * self.v).sum(1)
            self.g = numbers(queries.field("_qg"), known) if grouped else None
            self.pool: pa.StructArray | None = None
            self.d = np.full((len(queries), 0), np.inf)
            self.i = np.zeros((len(queries), 0), np.int64)

        def meet(self, refs: pa.StructArray, r: dict[str, np.ndarray], v: np.ndarray, g: np.ndarray | None, lo: float) -> None:
            full = self.d.shape[1] == k
            limit = np.minimum(self.d[:, -1], cap_all) if full else np.full(len(self.d), cap_all)
            if full and (limit < lo * (1 - 1e-9) - 1e-9).all():
                return
            # squared distances of the vectors first, by one product; true ones only for the pairs that may count
            w = v - self.mid
            low = np.add.outer(self.v2, (w * w).sum(1))
            low -= 2 * (self.v @ w.T)
            slack = 1e-9 * (1 + float(np.nanmax(self.v2, initial=0)) + float(np.nanmax((w * w).sum(1), initial=0)))
            if grouped:
                low[self.g[:, None] == g[None, :]] = np.inf
            most = limit * limit
            if low.shape[1] > k:
                kth = np.partition(low, k - 1, axis=1)[:, k - 1]
                top = kth[np.isfinite(kth)].max(initial=0.0) + slack
                most = np.fmin(most, (kth + slack) * metric.stretch(top))
            row, col = np.nonzero(low <= (most * (1 + 1e-9) + slack)[:, None])
            d = metric.pairs({a: x[row] for a, x in self.q.items()}, {a: x[col] for a, x in r.items()})
            keep = (d <= limit[row]) & np.isfinite(low[row, col])
            row, col, d = row[keep], col[keep], d[keep]
            if not len(row):
                return
            rows, start, n = np.unique(row, return_index=True, return_counts=True)
            used, col = np.unique(col, return_inverse=True)
            base = 0 if self.pool is None else len(self.pool)
            refs = refs.take(pa.array(used))
            pool = refs if self.pool is None else pa.concat_arrays([self.pool, refs])
            slot = np.arange(len(row)) - np.repeat(start, n)
            at = np.repeat(np.arange(len(rows)), n)
            new, where = np.full((len(rows), int(n.max())), np.inf), np.full((len(rows), int(n.max())), base)
            new[at, slot], where[at, slot] = d, base + col
            both = np.hstack([self.d[rows], new])
            place = np.hstack([self.i[rows], where])
            rid = pool.field("_rid").to_numpy(zero_copy_only=False)
            rank = rid if rid.dtype.kind in "iu" else np.unique(rid.astype(str) if rid.dtype.kind == "O" else rid, return_inverse=True)[1]
            order = np.lexsort((rank[place], both), axis=1)[:, :k]
            both, place = np.take_along_axis(both, order, 1), np.take_along_axis(place, order, 1)
            if both.shape[1] > self.d.shape[1]:
                more = both.shape[1] - self.d.shape[1]
                self.d = np.hstack([self.d, np.full((len(self.d), more), np.inf)])
                self.i = np.hstack([self.i, np.zeros((len(self.i), more), np.int64)])
            self.d[rows, :both.shape[1]], self.i[rows, :both.shape[1]] = both, place
            self.pool = pool
            if len(pool) > 2 * self.i.size + 4 * LEAF_ROWS:
                # only what some query holds is kept
                kept, back = np.unique(self.i, return_inverse=True)
                self.i, self.pool = back.reshape(self.i.shape), pool.take(pa.array(kept))

        def rows(self) -> pa.RecordBatch:
            at, rank = np.nonzero(np.isfinite(self.d))
            ref = self.pool.take(pa.array(self.i[at, rank]))
            q = self.queries.take(pa.array(at))
            fields = {"_qid": q.field("_qid"), "rank_no": pa.array(rank + 1), "qx": q.field("x"), "qy": q.field("y"), **({"qt": q.field("t")} if timed else {})}
            fields |= {n: ref.field(n) for n in names if n not in fields}
            return pa.RecordBatch.from_arrays([fields[n] for n in names], names)

    def flush(block: list[Best], waiting: list[tuple]) -> None:
        for best in block:
            for lo, i in sorted((w[-1][best.leaf], i) for i, w in enumerate(waiting) if best.leaf in w[-1]):
                best.meet(*waiting[i][:-1], lo)
        waiting.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, waiting, held, known = None, [], [], 0, {}
        for batch in batches:
            at = [batch.column(c) for c in batch.schema.names if c.startswith("_b")]
            for r in range(batch.num_rows):
                now = tuple(c[r].as_py() for c in at)
                if now != key:
                    flush(block, waiting)
                    yield from (best.rows() for best in block if best.pool is not None)
                    key, block, held, known = now, [], 0, {}
                queries = batch.column("_queries")[r]
                if queries.is_valid:
                    block.append(Best(batch.column("_leaf")[r].as_py(), queries.values, known))
                    continue
                # a copy, so that the buffer does not keep whole batches alive
                refs = pa.concat_arrays([batch.column("_refs")[r].values])
                r_cols = columns(refs)
                waiting.append((refs, r_cols, metric.vectors(r_cols), numbers(refs.field("_g"), known) if grouped else None, {w["i"]: w["lo"] for w in batch.column("_wants")[r].as_py()}))
                held += len(refs)
                if held >= BUFFER_ROWS:
                    flush(block, waiting)
                    held = 0
        flush(block, waiting)
        yield from (best.rows() for best in block if best.pool is not None)
    return run


def nearest(queries: DataFrame, refs: DataFrame, *, qid: str, rid: str, k: int = 1, q_xy=("lon", "lat"),
            r_xy=("lon", "lat"), q_t: str | None = None, r_t: str | None = None, payload: tuple[str, ...] = (),
            metric: Metric = Metric(), exclude: tuple[str, str] | None = None, max_dist: float | None = None) -> DataFrame:
    """The ``k`` nearest reference rows of every query row: ``qid, rank_no, dist, rid, payload``.

    Reference and query points each lie in a pyramid of grid cells that is split where points are dense. The leaves of the
    queries, not the queries, walk down the reference pyramid: a cell is kept while its nearest point may still be
    among the first ``k`` of some query of the leaf, by the bounds between boxes. The leaves left meet as arrays, the nearest first.
    Query rows are shuffled into their leaf once, reference rows once per block of query leaves that may need them, answers not at all. Equal positions are first cut to the ``k`` rows that can
    win, so copies cannot blow up a cell. ``exclude=(query column, reference column)`` leaves out rows of the same
    group; no group is a group of its own. Ties go to the smallest ``rid``.
    """
    timed = metric.v is not None
    axes = ["x", "y"] + (["t"] if timed else [])
    r = refs.select(F.col(rid).alias("_rid"), F.col(r_xy[0]).cast("double").alias("x"),
                    F.col(r_xy[1]).cast("double").alias("y"),
                    *([F.col(r_t).cast("double").alias("t")] if timed else []),
                    *([_group(exclude[1]).alias("_g")] if exclude else []), *[F.col(p).alias(f"_p_{p}") for p in payload])
    r = r.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("t").isNotNull() if timed else F.lit(True)))
    # equal positions: only the k smallest ids can win; the table is read several times below, so it is written once
    same = axes + (["_g"] if exclude else [])
    if k == 1:
        rest = [c for c in r.columns if c not in same]
        r = r.groupBy(*same).agg(F.min_by(F.struct(*rest), "_rid").alias("_s")).select(*same, "_s.*")
    else:
        r = top_k(r, same, [F.col("_rid")], k, "_dup", salt_on="_rid").drop("_dup")
    r = materialise(r)
    q = queries.select(F.col(qid).alias("_qid"), F.col(q_xy[0]).cast("double").alias("x"), F.col(q_xy[1]).cast("double").alias("y"),
                       *([F.col(q_t).cast("double").alias("t")] if timed else []), *([_group(exclude[0]).alias("_qg")] if exclude else []))
    q = materialise(q.where(F.col("x").isNotNull() & F.col("y").isNotNull() & (F.col("t").isNotNull() if timed else F.lit(True))))

    def gridded(df: DataFrame) -> tuple[DataFrame, int]:
        """Finest cells ``g*``, scaled so that evenly spread points fill the leaves well, and the depth of such leaves."""
        box = df.agg(F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]).first()
        sides = _sides(max(1.0, 2 * box["n"] / LEAF_ROWS), {a: max((box[f"max_{a}"] or 0.0) - (box[f"min_{a}"] or 0.0), 1e-9) for a in axes})
        usual = min(MAX_DEPTH, max(1, math.ceil(math.log(max(sides.values()), 4) - 1e-9)))
        for a, side in sides.items():
            full = 4 ** MAX_DEPTH * min(side, 4 ** usual) / 4 ** usual
            low = box[f"min_{a}"] or 0.0
            span = max((box[f"max_{a}"] or 0.0) - low, 1e-9)
            df = df.withColumn(f"g{a}", F.greatest(F.lit(0), F.least(F.floor((F.col(a) - low) / span * full), F.lit(math.ceil(full) - 1))).cast("bigint"))
        return df, usual

    (r, r_usual), (q, q_usual) = gridded(r), gridded(q)
    corners = {f"{a}{i}": (f(a), f) for a in axes for i, f in ((0, F.min), (1, F.max))}
    groups = lambda g: {"g0": (F.min(g), F.min), "g1": (F.max(g), F.max)} if exclude else {}
    rt = _tree(r, axes, corners | groups("_g"), r_usual)
    if exclude:
        # the largest group of a node: a query's own group hides no more than that; summed up, it is never too small
        most = r.groupBy(*[f"g{a}" for a in axes], "_g").agg(F.count(F.lit(1)).alias("c")).groupBy(*[f"g{a}" for a in axes]).agg(F.max("c").alias("top"))
        up = [F.floor(F.col(f"g{a}") / F.pow(F.lit(4.0), MAX_DEPTH - F.col("lvl"))).cast("bigint").alias(f"c{a}") for a in axes]
        most = most.withColumn("lvl", F.explode(F.sequence(F.lit(1), F.lit(MAX_DEPTH)))).groupBy("lvl", *up).agg(F.sum("top").alias("gtop"))
        rt = materialise(rt.join(most, ["lvl", *[f"c{a}" for a in axes]]))
    qt = _tree(q, axes, corners | groups("_qg"), q_usual)
    ql = qt.where("leaf").select("lvl", *[f"c{a}" for a in axes], F.col("n").alias("qn"), *[F.col(c).alias(f"q{c}") for c in (*corners, *groups("_qg"))])
    cells = [f"c{a}" for a in axes]
    keys = ["_klvl", *[f"_k{a}" for a in axes]]
    ql = ql.withColumnsRenamed(dict(zip(["lvl", *cells], keys)))

    own = [c for c in ql.columns]
    node = ["lvl", *cells, "leaf", "n", *corners, *(["g0", "g1", "gtop"] if exclude else [])]
    child = rt.select(*node, (F.col("lvl") - 1).alias("ulvl"), *[F.floor(F.col(c) / 4).cast("bigint").alias(f"u{c}") for c in cells])
    above = ["ulvl", *[f"u{c}" for c in cells]]
    cand = ql.withColumn("cap", F.lit(float("inf") if max_dist is None else float(max_dist)))
    cand = cand.withColumns({c: F.lit(0).cast("int" if c == "ulvl" else "bigint") for c in above}).join(child, above).drop(*above)
    lo, hi = metric.bounds()
    by_leaf = Window.partitionBy(*keys)
    while True:
        n_eff = F.col("n")
        if exclude:
            cand = cand.where(~((F.col("g0") == F.col("g1")) & (F.col("qg0") == F.col("qg1")) & (F.col("g0") == F.col("qg0"))))
            n_eff = F.when((F.col("qg1") >= F.col("g0")) & (F.col("qg0") <= F.col("g1")), F.greatest(F.col("n") - F.col("gtop"), F.lit(0))).otherwise(F.col("n"))
        cand = cand.withColumns({"lo": lo, "hi": hi, "ne": n_eff})
        cand = cand.withColumn("cum", F.sum("ne").over(by_leaf.orderBy("hi", "lvl", *cells).rowsBetween(Window.unboundedPreceding, 0)))
        cut = F.min(F.when(F.col("cum") >= k, F.col("hi"))).over(by_leaf)
        cand = cand.withColumn("cap", F.least(F.col("cap"), F.coalesce(cut, F.lit(float("inf")))))
        cand = materialise(cand.where(F.col("lo") <= F.col("cap") * (1 + 1e-9) + 1e-9).select(*own, *node, "cap", "lo"))
        if not cand.where("not leaf").limit(1).count():
            break
        down = cand.where("not leaf").select(*own, "cap", F.col("lvl").alias("ulvl"), *[F.col(c).alias(f"u{c}") for c in cells])
        down = down.join(child, above).select(*own, *node, "cap")
        cand = cand.where("leaf").select(*own, *node, "cap").unionByName(down)

    ref = F.struct("_rid", *axes, *(["_g"] if exclude else []), *[f"_p_{p}" for p in payload])
    ask = F.struct("_qid", *axes, *(["_qg"] if exclude else []))
    ra = _in_leaves(r, rt, axes, ref, "_refs", "_rid").drop("chunk")
    qa = _in_leaves(q, qt, axes, ask, "_queries", "_qid").withColumnsRenamed(dict(zip(["lvl", *cells, "chunk"], [*keys, "_kchunk"])))
    # query leaves under one node (and chunks of a dense one) are a block: a reference leaf is sent once to a block, however many ask for it
    block = [F.col(keys[0]).alias("_bl"), *[F.floor(F.col(f"_k{a}") / 4).cast("bigint").alias(f"_b{a}") for a in axes]]
    leaf = sum(F.pmod(F.col(f"_k{a}"), F.lit(4)) * 4 ** i for i, a in enumerate(axes)).cast("int")
    by = ["_bl", *[f"_b{a}" for a in axes], "_bg"]
    groups_of = F.explode(F.sequence(F.lit(0), F.floor((F.ceil(F.col("qn") / LEAF_ROWS) - 1) / BLOCK_CHUNKS).cast("int"))).alias("_bg")
    need = cand.select(*block, groups_of, leaf.alias("i"), "lvl", *cells, "lo").groupBy(*by, "lvl", *cells).agg(
        F.collect_list(F.struct("i", "lo")).alias("_wants"), F.min("lo").alias("lo"))
    # neither side may be broadcast: leaves are held as arrays, whose size the planner does not know
    sent = need.join(ra.hint("merge"), ["lvl", *cells]).select(*by, F.lit(1).alias("kind"), "lo", F.lit(None).cast("int").alias("_leaf"), "_wants", "_refs")
    asked = qa.select(*block, F.floor(F.col("_kchunk") / BLOCK_CHUNKS).cast("int").alias("_bg"), F.lit(0).alias("kind"), F.lit(0.0).alias("lo"), leaf.alias("_leaf"), "_queries")
    met = asked.unionByName(sent, allowMissingColumns=True)
    met = met.repartition(int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by, "kind", "lo")
    schema = StructType([StructField("_qid", q.schema["_qid"].dataType), StructField("rank_no", LongType()), StructField("qx", DoubleType()), StructField("qy", DoubleType()),
                         *([StructField("qt", DoubleType())] if timed else []), *[StructField(a, DoubleType()) for a in axes], StructField("_rid", r.schema["_rid"].dataType),
                         *[StructField(f"_p_{p}", r.schema[f"_p_{p}"].dataType) for p in payload]])
    hit = met.mapInArrow(_merge(metric, k, float("inf") if max_dist is None else float(max_dist), timed, exclude is not None, schema.names), schema)
    dist = metric.distance(F.col("qx"), F.col("qy"), F.col("qt") if timed else None, F.col("x"), F.col("y"), F.col("t") if timed else None)
    return hit.select(F.col("_qid").alias(qid), F.col("rank_no").cast("int").alias("rank_no"), dist.alias("dist"), F.col("_rid").alias(rid if rid != qid else f"ref_{rid}"),
                      *[F.col(f"_p_{p}").alias(p) for p in payload])


# ---- radius joins --------------------------------------------------------------------------------------------------

def _rows(step: float, gy: Column) -> Column:
    """Number of longitude cells in a latitude row, wide enough for ``step`` degrees of arc."""
    cos = F.least(F.cos(F.radians(gy * step)), F.cos(F.radians((gy + 1) * step)))
    return F.greatest(F.lit(1), F.floor(360 * F.greatest(cos, F.lit(0.0)) / step)).cast("bigint")


def sphere_cell(lon: Column, lat: Column, step: float) -> tuple[Column, Column]:
    gy = F.floor(lat / step).cast("bigint")
    return gy, F.pmod(F.floor((lon + 180) / 360 * _rows(step, gy)).cast("bigint"), _rows(step, gy))


def explode_cells(df: DataFrame, lon0: Column, lon1: Column, lat0: Column, lat1: Column, step: float, pad_km: float) -> DataFrame:
    """One row per grid cell touched by the box grown by ``pad_km``; columns ``gy, gx``."""
    pad = pad_km / (EARTH_KM * 3.141592653589793 / 180)
    d = df.withColumn("gy", F.explode(F.sequence(F.floor((lat0 - pad) / step).cast("bigint"),
                                                 F.floor((lat1 + pad) / step).cast("bigint"))))
    worst = F.greatest(F.abs(lat0), F.abs(lat1))
    ratio = F.sin(F.lit(pad_km / EARTH_KM)) / F.greatest(F.cos(F.radians(worst)), F.lit(1e-9))
    half = F.when(ratio < 1, F.degrees(F.asin(F.least(ratio, F.lit(1.0))))).otherwise(F.lit(180.0))
    n = _rows(step, F.col("gy"))
    a = F.floor((lon0 + 180 - half) / 360 * n).cast("bigint")
    b = F.floor((lon1 + 180 + half) / 360 * n).cast("bigint")
    d = d.withColumn("gx", F.explode(F.sequence(a, F.least(b, a + n - 1))))
    return d.withColumn("gx", F.pmod(F.col("gx"), n))


def within_radius(left: DataFrame, right: DataFrame, radius_km: float, *, l_xy, r_xy, strict: bool = False,
                  days: tuple[str, str, int] | None = None, out: str = "d_km") -> DataFrame:
    """All left × right pairs closer than ``radius_km`` (and at most ``days`` apart); column names must differ.

    Rows meet only through shared grid cells, and through shared day blocks when a time limit is given.
    """
    step = radius_km / 111.19
    gy, gx = sphere_cell(F.col(r_xy[0]), F.col(r_xy[1]), step)
    r = right.withColumn("gy", gy).withColumn("gx", gx)
    lo, la = F.col(l_xy[0]), F.col(l_xy[1])
    left = explode_cells(left, lo, lo, la, la, step, radius_km)
    on = ["gy", "gx"]
    if days:
        lc, rc, m = days
        block = max(8, 2 * m + 1)
        left = left.withColumn("_db", F.explode(F.array_distinct(F.array(
            F.floor((F.col(lc) - m) / block), F.floor((F.col(lc) + m) / block)))))
        r = r.withColumn("_db", F.floor(F.col(rc) / block))
        on.append("_db")
    j = left.join(r, on).drop(*on)
    if days:
        j = j.where(F.abs(F.col(days[0]) - F.col(days[1])) <= days[2])
    d = haversine_km(F.col(l_xy[0]), F.col(l_xy[1]), F.col(r_xy[0]), F.col(r_xy[1]))
    j = j.withColumn(out, d)
    return j.where(F.col(out) < radius_km if strict else F.col(out) <= radius_km)
