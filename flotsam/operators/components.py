"""Connected components and the link graph of dependent events."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from flotsam.functions.geo import EARTH_KM, haversine_km
from flotsam.operators.neighbours import _rows, explode_cells, sphere_cell
from flotsam.session import materialise, release


CHUNK = 1 << 20         # edges that a task contracts at a time
WIDE = 1 << 17          # rows of one key that are not sent to one task
FEW = 1 << 17           # rows of a table that is sent to every task


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, smallest node`` of the components of some edges, without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[:len(u)], at[len(u):]
    up = np.arange(len(nodes))
    while True:
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    leaf = up != np.arange(len(nodes))
    return nodes[leaf], nodes[up[leaf]]


def contract(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Edges ``u, v`` of whole numbers as stars, ``CHUNK`` of a partition at a time; with ``whole`` no chunk parts the
    rows of one ``u`` (partitions are in the order of ``u``)."""
    schema, size = "u bigint, v bigint", CHUNK

    def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in local_stars(u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0
        for t in batches:
            us.append(t.column(0).to_numpy())
            vs.append(t.column(1).to_numpy())
            n += t.num_rows
            if n >= size:
                u, v = np.concatenate(us), np.concatenate(vs)
                end = int(np.searchsorted(u, u[-1])) if whole else len(u)
                us, vs, n = [u[end:]], [v[end:]], len(u) - end
                if end:
                    yield out(u[:end], v[:end])
        if n:
            yield out(np.concatenate(us), np.concatenate(vs))

    return edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).mapInArrow(run, schema)


def small_star(edges: DataFrame) -> DataFrame:
    """Every ``u`` and its smaller neighbours ``v`` become a star around the smallest."""
    s = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(s, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()


def large_star(e: DataFrame) -> DataFrame:
    """Every ``u`` moves from ``v`` to the smallest neighbour of ``v``.

    Only a ``v`` that is a ``u`` too moves anything. When few are a ``v`` they are sent to every task; else those with
    over ``WIDE`` rows are, so that no task gets a whole star.
    """
    centres = materialise(e.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    few = centres.count() <= FEW
    at = centres.select(F.col("v").alias("u"), "n")
    low = materialise(e.join(F.broadcast(at) if few else at, "u").groupBy("u", "n").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "n", "m"))
    near = low if few else low.where(F.col("n") > WIDE)
    moved = e.join(F.broadcast(near.select("v", "m")), "v", "left")
    if not few:
        wide = F.broadcast(centres.where(F.col("n") > WIDE).select("v"))
        rest = e.join(wide, "v", "left_anti").join(low.where(F.col("n") <= WIDE).select("v", "m"), "v", "left")
        moved = moved.join(wide, "v", "left_semi").unionByName(rest)
    return moved.select("u", F.coalesce("m", "v").alias("v"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an undirected edge table; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): edges shrink towards one star per
    component in O(log² n) rounds. Where nodes are whole numbers, tasks contract their edges to stars before the
    first round, and the small-star is such a contraction of the edges in the order of ``u``: one shuffle a round. After
    it a node has one ``v`` per task, so only a ``v`` can have many rows. Every round is written to the shared folder,
    which cuts the lineage.
    """
    def canonical(df: DataFrame) -> DataFrame:
        u, v = F.col("u"), F.col("v")
        return df.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))

    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    whole = all(isinstance(f.dataType, IntegralType) for f in e.schema)
    kind = e.schema["u"].dataType

    def stars(df: DataFrame) -> DataFrame:
        return contract(df.repartition("u").sortWithinPartitions("u"), True) if whole else small_star(df)

    e = materialise(contract(canonical(e)) if whole else canonical(e).distinct())
    mark = None
    for _ in range(max_rounds):
        seen = Observation()
        before, e = e, materialise(stars(large_star(e)).observe(seen, F.count(F.lit(1)).alias("n"),
                                                                F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        release(before)
        now = (seen.get["n"], seen.get["h"])
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    if whole:
        e = e.select(F.col("u").cast(kind), F.col("v").cast(kind))
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))))


PRODUCT = 16    # pairs of events of two cells that are looked at one by one
FINEST = 8      # times a cell's side is quartered at most while it is asked whether two cells hold a close pair


def link_cells(events: DataFrame, link_km: float) -> DataFrame:
    """Adds ``gy, gx`` and ``cell``: events of one day in one cell are closer than ``link_km`` and therefore linked anyway.

    ``cell`` is in the order of (gy, gx, day): one whole number where these fit into 63 bits.
    """
    side = link_km / 1.45 / 111.2
    gy, gx = sphere_cell(F.col("lon"), F.col("lat"), side)
    rows, days = int(90 / side) + 2, 1 << 23
    cols = int(360 / side) + 2
    ev = events.withColumns({"gy": gy, "gx": gx, "day": F.col("day").cast("bigint")})
    if 2 * rows * cols * days < 1 << 63:
        return ev.withColumn("cell", ((F.col("gy") + rows) * cols + F.col("gx")) * days + F.col("day") + days // 2)
    return ev.withColumn("cell", F.struct("gy", "gx", "day"))


def box_bounds(p: str, q: str) -> tuple[Column, Column]:
    """Smallest and largest possible distance between a point of box ``p`` and a point of box ``q``."""
    def c(box: str, name: str) -> Column:
        return F.col(box + name)

    zero = F.lit(0.0)
    lat_gap = F.greatest(zero, c(q, "y0") - c(p, "y1"), c(p, "y0") - c(q, "y1"))
    lon_gap = F.greatest(zero, c(q, "x0") - c(p, "x1"), c(p, "x0") - c(q, "x1"))
    lat_far = F.greatest(c(p, "y1") - c(q, "y0"), c(q, "y1") - c(p, "y0"))
    lon_far = F.greatest(c(p, "x1") - c(q, "x0"), c(q, "x1") - c(p, "x0"))

    def cosines(box: str) -> tuple[Column, Column]:
        c0, c1 = F.cos(F.radians(c(box, "y0"))), F.cos(F.radians(c(box, "y1")))
        spans = (c(box, "y0") <= 0) & (c(box, "y1") >= 0)
        return F.least(c0, c1), F.when(spans, F.lit(1.0)).otherwise(F.greatest(c0, c1))

    (pmin, pmax), (qmin, qmax) = cosines(p), cosines(q)

    def arc(dlat: Column, dlon: Column, cc: Column) -> Column:
        h = F.pow(F.sin(F.radians(dlat) / 2), 2) + cc * F.pow(F.sin(F.radians(dlon) / 2), 2)
        return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))

    near_lon = F.least(lon_gap, F.greatest(zero, 360 - lon_far))
    return arc(lat_gap, near_lon, pmin * qmin), arc(lat_far, F.least(lon_far, F.lit(180.0)), pmax * qmax)


def close_cells(points: DataFrame, pairs: DataFrame, link_km: float, finest: int = FINEST) -> DataFrame:
    """Those of the ``pairs`` (cell, cell2) that hold two points, one of each cell, closer than ``link_km``.

    ``points``: cell, gy, lon, lat. The points of two cells go down together through quartered sub-cells: a pair of
    sub-cells is dropped when its boxes are too far apart, and as soon as one pair of boxes is close as a whole the
    cells are settled and all their other pairs are dropped. Only pairs within a sub-cell's width of the limit go
    deeper, so work follows the border of the limit and not the product of the points; at the last level, where a
    sub-cell is a few decimetres wide, different places decide. The boxes of whole cells are known to be undecided.
    """
    side = link_km / 1.45 / 111.2
    n = _rows(side, F.col("gy"))
    full = 4 ** finest

    def fraction(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(full - 1), F.floor((x - F.floor(x)) * full))).cast("bigint")

    box = {"x0": F.min("lon"), "x1": F.max("lon"), "y0": F.min("lat"), "y1": F.max("lat")}
    placed = points.select("cell", "lon", "lat", fraction(F.col("lat") / side).alias("sy"), fraction((F.col("lon") + 180) / 360 * n).alias("sx"))
    fine = materialise(placed.groupBy("cell", "sy", "sx").agg(*[v.alias(k) for k, v in box.items()]))

    def boxes(level: int, prefix: str, cell: str) -> DataFrame:
        """Boxes of a level's sub-cells with the sub-cell they lie in, rolled up from the finest."""
        up = 4 ** (finest - level)
        rolled = {k: (F.min if k[1] == "0" else F.max)(k) for k in box}
        b = fine.groupBy("cell", F.floor(F.col("sy") / up).alias("sy"), F.floor(F.col("sx") / up).alias("sx")).agg(*[v.alias(prefix + k) for k, v in rolled.items()])
        return b.select(F.col("cell").alias(cell), F.floor(F.col("sy") / 4).alias(prefix + "uy"), F.floor(F.col("sx") / 4).alias(prefix + "ux"),
                        F.col("sy").alias(prefix + "sy"), F.col("sx").alias(prefix + "sx"), *[prefix + k for k in box])

    waiting = pairs.select("cell", "cell2", *[F.lit(0).cast("bigint").alias(c) for c in ("psy", "psx", "qsy", "qsx")])
    settled = pairs.limit(0).select("cell", "cell2")
    lo, hi = box_bounds("p", "q")
    sub = ("psy", "psx", "qsy", "qsx")
    rounds = []
    for level in range(1, finest + 1):
        open_ = waiting.withColumnsRenamed({"psy": "puy", "psx": "pux", "qsy": "quy", "qsx": "qux"})
        met = open_.join(boxes(level, "p", "cell"), ["cell", "puy", "pux"]).join(boxes(level, "q", "cell2"), ["cell2", "quy", "qux"])
        state = materialise(met.select("cell", "cell2", *sub, lo.alias("lo"), (hi < link_km).alias("sure")).where(F.col("sure") | (F.col("lo") < link_km * (1 + 1e-9))).drop("lo"))
        rounds.append(state)
        sure = materialise(state.where("sure").select("cell", "cell2").distinct())
        settled = settled.unionByName(sure)
        waiting = state.where("not sure").drop("sure").join(sure, ["cell", "cell2"], "left_anti")
        if not waiting.limit(1).count():
            break
    else:
        spots = placed.distinct()
        a = spots.select("cell", F.col("sy").alias("psy"), F.col("sx").alias("psx"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
        b = spots.select(F.col("cell").alias("cell2"), F.col("sy").alias("qsy"), F.col("sx").alias("qsx"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
        near = haversine_km(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) < link_km
        settled = settled.unionByName(materialise(waiting.join(a, ["cell", "psy", "psx"]).join(b, ["cell2", "qsy", "qsx"]).where(near).select("cell", "cell2").distinct()))
    for state in (*rounds, fine):
        release(state)
    return settled


def cell_pairs(ev: DataFrame, link_km: float, link_days: int) -> tuple[DataFrame, DataFrame]:
    """``(cells, pairs)``: cells with their smallest event ``e``, and the pairs of cells at most ``link_days`` apart whose
    boxes may hold two close events: cell, cell2, their events e, e2, ``sure`` where the boxes are close as a whole, ``few`` where they hold few pairs.

    The boxes travel with the cells, so that a pair is decided where it is made and only near pairs are written.
    """
    top = ev.groupBy("cell", "gy", "gx", "day").agg(F.min("event_id").alias("e"), F.count(F.lit(1)).alias("n"), F.min("lon").alias("px0"), F.max("lon").alias("px1"),
                                                    F.min("lat").alias("py0"), F.max("lat").alias("py1"))
    top = materialise(top)
    side = link_km / 1.45 / 111.2
    block = max(8, 2 * link_days + 1)
    left = top.withColumnsRenamed({"gy": "cy", "gx": "cx"})
    left = explode_cells(left, F.col("px0"), F.col("px1"), F.col("py0"), F.col("py1"), side, link_km)
    # a pair is made from its smaller cell
    left = left.where((F.col("gy") > F.col("cy")) | ((F.col("gy") == F.col("cy")) & (F.col("gx") >= F.col("cx")))).drop("cy", "cx")
    left = left.withColumn("db", F.explode(F.array_distinct(F.array(
        F.floor((F.col("day") - link_days) / block), F.floor((F.col("day") + link_days) / block)))))
    right = top.select(F.col("cell").alias("cell2"), F.col("e").alias("e2"), F.col("n").alias("n2"), F.col("day").alias("day2"), "gy", "gx", F.floor(F.col("day") / block).alias("db"),
                       *[F.col(f"p{k}").alias(f"q{k}") for k in ("x0", "x1", "y0", "y1")])
    lo, hi = box_bounds("p", "q")
    met = (left.join(right, ["gy", "gx", "db"]).where((F.col("cell") < F.col("cell2")) & (F.abs(F.col("day") - F.col("day2")) <= link_days))
           .withColumns({"lo": lo, "sure": hi < link_km}).where(F.col("sure") | (F.col("lo") < link_km * (1 + 1e-9))))
    return top, materialise(met.select("cell", "cell2", "e", "e2", "sure", (F.col("n") * F.col("n2") <= PRODUCT).alias("few")))


def same_day_links(ev: DataFrame, top: DataFrame) -> DataFrame:
    """``a, b``: the smallest cell of a day of a source with each of its other cells, as their smallest events."""
    star = ev.select("source_id", "day", "cell").distinct().join(top.select("cell", "e"), "cell")
    hub = star.groupBy("source_id", "day").agg(F.min(F.struct("cell", "e")).alias("hub"))
    return star.join(hub, ["source_id", "day"]).where(F.col("cell") != F.col("hub.cell")).select(F.col("hub.e").alias("a"), F.col("e").alias("b")).distinct()


def settle(ev: DataFrame, open_: DataFrame, link_km: float) -> DataFrame:
    """Those of the undecided pairs that are linked, as ``a, b``: the few places of thin cells meet as they are, others by ``close_cells``."""
    p = ev.select("cell", "lon", "lat").distinct()
    few = open_.where("few").join(p.withColumnsRenamed({"lon": "ax", "lat": "ay"}), "cell").join(
        p.withColumnsRenamed({"cell": "cell2", "lon": "bx", "lat": "by"}), "cell2")
    near = few.where(haversine_km(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) < link_km).select(F.col("e").alias("a"), F.col("e2").alias("b")).distinct()
    more = open_.where("not few")
    if more.isEmpty():
        return near
    deep = close_cells(ev.select("cell", "gy", "lon", "lat"), more.select("cell", "cell2"), link_km)
    return near.unionByName(more.join(deep, ["cell", "cell2"]).select(F.col("e").alias("a"), F.col("e2").alias("b")))


def link_graph(events: DataFrame, link_km: float, link_days: int) -> tuple[DataFrame, DataFrame]:
    """Cells of dependent events and the links between them: ``(events with cell and its smallest event e, links a, b, link)``.

    ``events``: event_id, source_id, day (days since epoch), lon, lat. Events are linked when they share source and
    day, or when they are closer than ``link_km`` and at most ``link_days`` apart. Cells are small enough to be one
    node, named by their smallest event; whether two cells are linked is asked once per pair of cells, see ``close_cells``.
    """
    ev = link_cells(events, link_km)
    top, pairs = cell_pairs(ev, link_km, link_days)
    near = pairs.where("sure").select(F.col("e").alias("a"), F.col("e2").alias("b"))
    open_ = pairs.where("not sure")
    if not open_.isEmpty():
        near = near.unionByName(settle(ev, open_, link_km))
    links = same_day_links(ev, top).withColumn("link", F.lit("same_day")).unionByName(near.withColumn("link", F.lit("near")))
    return ev.join(top.select("cell", "e"), "cell"), links


def label_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``component``, its smallest event, to events with the smallest event ``e`` of their cell."""
    comp = connected_components(links, "a", "b")
    return (events.join(comp.withColumnRenamed("node", "e"), "e", "left")
            .withColumn("component", F.coalesce("component", "e")))


def group_events(events: DataFrame, link_km: float, link_days: int, extra: DataFrame | None = None) -> DataFrame:
    """``event_id, component`` (smallest event) for the groups of dependent events, without finding every link.

    Days of a source and boxes that are close as a whole group most cells; only undecided pairs of cells of different
    groups are looked into. ``extra``: further links event_a, event_b.
    """
    ev = link_cells(events, link_km)
    top, pairs = cell_pairs(ev, link_km, link_days)
    cells = top.select("cell", "e")
    links = same_day_links(ev, top).unionByName(pairs.where("sure").select(F.col("e").alias("a"), F.col("e2").alias("b")))
    if extra is not None:
        c = ev.join(cells, "cell").select("event_id", "e")
        links = links.unionByName(extra.join(c.withColumnsRenamed({"event_id": "event_a", "e": "a"}), "event_a")
                                  .join(c.withColumnsRenamed({"event_id": "event_b", "e": "b"}), "event_b").select("a", "b"))
    comp = connected_components(links, "a", "b")
    cells = materialise(cells.join(comp.withColumnRenamed("node", "e"), "e", "left").select("cell", F.coalesce("component", "e").alias("component")))
    open_ = pairs.where("not sure")
    if not open_.isEmpty():
        of = [cells.withColumnsRenamed({"cell": c, "component": k}) for c, k in (("cell", "a"), ("cell2", "b"))]
        apart = materialise(open_.join(of[0], "cell").join(of[1], "cell2").where("a <> b").select("cell", "cell2", "few", F.col("a").alias("e"), F.col("b").alias("e2")))
        if not apart.isEmpty():
            more = connected_components(settle(ev, apart, link_km), "a", "b")
            cells = cells.join(more.select(F.col("node").alias("component"), F.col("component").alias("_top")), "component", "left").select(
                "cell", F.coalesce("_top", "component").alias("component"))
    return ev.select("event_id", "cell").join(cells, "cell").select("event_id", "component")
