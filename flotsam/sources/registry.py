"""Field registry scans and contracts, transect segments, catalogue searches and scene choice."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flotsam.config import LABEL_TO_GROUP, NUMERIC_COLUMNS
from flotsam.operators.ranking import top_k
from flotsam.session import materialise


def read_registry(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Registry CSV with every column as text (no inference); pass through ``typed_registry`` for numbers.

    A file is read in splits. ``multi_line`` is for files with line ends inside quotes, which one task must read whole.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", enforceSchema=False, multiLine=multi_line,
                          escape='"')


def typed_registry(df: DataFrame, numeric=NUMERIC_COLUMNS) -> DataFrame:
    """Blank numbers become null; anything else that is no number is an error (ANSI cast)."""
    return df.withColumns({c: F.nullif(F.trim(F.col(c)), F.lit("")).cast("double") for c in numeric if c in df.columns})


def contract_problems(df: DataFrame, *, rows: int, columns: int, events: int, key: str, event: str) -> DataFrame:
    """Broken promises of the registry: one row per problem, no row when all hold."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count_distinct(event).alias("ev"))
    def check(name: str, found: Column, expected: int) -> Column:
        return F.struct(F.lit(name).alias("check"), found.cast("bigint").alias("found"),
                        F.lit(expected).cast("bigint").alias("expected"))

    checks = F.array(check("rows", F.col("n"), rows), check("columns", F.lit(len(df.columns)), columns),
                     check("duplicate_keys", F.col("n") - F.col("keys"), 0), check("events", F.col("ev"), events))
    return stats.select(F.explode(checks).alias("c")).select("c.*").where("found <> expected")


def transect_segments(seg: DataFrame) -> DataFrame:
    """Segments of interrupted transects (at least two rows); the date is that of the last dated row.

    ``seg``: no, row_no, date and payload columns.
    """
    per = seg.groupBy("no").agg(F.count(F.lit(1)).alias("n_segments"),
                                F.max_by("date", F.when(F.col("date").isNotNull(), F.col("row_no"))).alias("transect_date"))
    return seg.drop("date").join(per.where("n_segments >= 2"), "no")


def single_segment_context(seg: DataFrame, value: str) -> DataFrame:
    """A context value is only usable for transects with exactly one row."""
    return (seg.groupBy("no").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias(value))
            .where((F.col("_n") == 1) & F.col(value).isNotNull()).drop("_n"))


def load_events(events: DataFrame, profile: str | None = None, role: str | None = None) -> DataFrame:
    if profile:
        events = events.where(F.col("profile") == profile)
    if role:
        events = events.where(F.col("role") == role)
    return events


# ---- catalogue -----------------------------------------------------------------------------------------------------

EVENT_BLOCK, MET_AT_ONCE = 2048, 1 << 18      # events of a block; pairs of an event and a scene that are asked at once


def _hits(events: list[str], scenes: list[str], names: list[str], prefer: tuple[str, str] | None = None):
    """Pairs of boxes that meet in a block of events and its scenes, event by event, numbered in the order of the scenes.

    ``prefer`` as in ``catalogue_search``; a block may then come without scenes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                e, s = batch.column("e_block")[r].values, batch.column("s_block")[r]
                s = s.values if s.is_valid else pa.array([], batch.schema.field("s_block").type.value_type)
                ex0, ex1, ey0, ey1 = (e.field(c).to_numpy(zero_copy_only=False)[:, None] for c in ("ex0", "ex1", "ey0", "ey1"))
                sx0, sx1, sy0, sy1 = (s.field(c).to_numpy(zero_copy_only=False) for c in ("sx0", "sx1", "sy0", "sy1"))
                if prefer:
                    wanted = pc.fill_null(pc.equal(s.field(prefer[0]), prefer[1]), False).to_numpy(zero_copy_only=False)
                step = max(1, MET_AT_ONCE // max(1, len(s)))
                for k in range(0, len(e), step):
                    c = slice(k, k + step)
                    i, j = np.nonzero((ex0[c] <= sx1) & (sx0 <= ex1[c]) & (ey0[c] <= sy1) & (sy0 <= ey1[c]))
                    start = np.flatnonzero(np.diff(i, prepend=-1))
                    seq = np.arange(1, len(i) + 1) - np.repeat(start, np.diff(np.append(start, len(i))))
                    if prefer:
                        n = len(ex0[c])
                        good = wanted[j].astype(bool)
                        keep = good | ((seq == 1) & (np.bincount(i[good], minlength=n) == 0)[i])
                        i, j, seq = i[keep], j[keep], seq[keep]
                        bare = np.flatnonzero(np.bincount(i, minlength=n) == 0)
                        at = np.argsort(np.concatenate([i, bare]), kind="stable")
                        i, j, seq = np.concatenate([i, bare])[at], np.concatenate([j, np.full(len(bare), -1)])[at], np.concatenate([seq, np.zeros(len(bare), np.int64)])[at]
                    if not len(i):
                        continue
                    i, j = pa.array(i + k), pa.array(j, mask=j < 0)
                    cols = [e.field(x).take(i) for x in events] + [s.field(x).take(j) for x in scenes] + [pa.array(seq)]
                    yield pa.RecordBatch.from_arrays(cols, names)
    return run


def catalogue_search(events: DataFrame, scenes: DataFrame, days: int, deg: float = 1.0, order: tuple[str, ...] = ("scene_t_s", "scene_no"),
                     keep: tuple[str, ...] | None = None, prefer: tuple[str, str] | None = None) -> DataFrame:
    """Scenes within ``days`` of the event date whose box meets the event box, numbered per event by ``order`` as ``seq``.

    ``events``: ex0..ey1, e_day; ``scenes``: sx0..sy1, s_day (days since epoch). An event lies in one cell only, that of the
    lower-left corner of its box, on a grid wider than the box; scenes go to every cell and day from which an event may
    reach them. There they meet as arrays, so only events and scenes are shuffled, never their pairs, and the hits of an
    event come out in one run of rows of one partition. ``keep``: the columns to return besides ``seq`` (all).
    ``prefer`` (scene column, value): every event is returned, with all its scenes of that value, else with its first scene,
    else with nulls and ``seq`` 0; so what has no partner needs no second search.
    """
    session = events.sparkSession
    ev = events.dropna(subset=["ex0", "ex1", "ey0", "ey1", "e_day"])
    wide = F.greatest(F.col("ex1") - F.col("ex0"), F.col("ey1") - F.col("ey0"), F.lit(deg)) / deg
    ev = ev.withColumn("_k", F.ceil(F.log2(wide)).cast("int"))
    # scenes of other days meet nothing: the days of a calendar are few
    day = ev.select("e_day").distinct().select(F.explode(F.sequence(F.col("e_day") - days, F.col("e_day") + days)).alias("s_day")).distinct()
    sc = scenes.join(F.broadcast(day), "s_day", "left_semi")

    def cell(c: str, size: float, less: int = 0) -> Column:
        return (F.floor(F.col(c) / size) - less).cast("bigint")

    left, right = None, None
    for k in sorted(r["_k"] for r in ev.select("_k").distinct().collect()):      # at most one row per doubling of the width
        size = deg * 2.0 ** k
        x = ev.where(F.col("_k") == k).withColumns({"_gx": cell("ex0", size), "_gy": cell("ey0", size)})
        y = (sc.withColumn("_k", F.lit(k)).withColumn("_gx", F.explode(F.sequence(cell("sx0", size, 1), cell("sx1", size))))
             .withColumn("_gy", F.explode(F.sequence(cell("sy0", size, 1), cell("sy1", size)))))
        left, right = (x, y) if left is None else (left.unionByName(x), right.unionByName(y))
    e_cols, s_cols = events.columns, [*order, *[c for c in scenes.columns if c not in order]]
    e_out, s_out = ([c for c in cols if keep is None or c in keep] for cols in (e_cols, s_cols))
    names = [*e_out, *s_out, "seq"]
    schema = T.StructType([*[events.schema[c] for c in e_out], *[scenes.schema[c] for c in s_out], T.StructField("seq", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    lost = None
    if prefer:
        # boxes that are not known meet nothing
        box = [F.col(c) for c in ("ex0", "ex1", "ey0", "ey1", "e_day")]
        known = F.lit(True)
        for c in box:
            known = known & c.isNotNull() & ~F.isnan(c.cast("double"))
        lost = events.where(~known).select(*[F.col(f.name) if f.name in e_out else F.lit(0 if f.name == "seq" else None).cast(f.dataType).alias(f.name) for f in schema])
    if left is None:
        return session.createDataFrame([], schema) if lost is None else lost
    left = left.withColumn("_day", F.col("e_day"))
    right = right.withColumn("_day", F.explode(F.sequence(F.col("s_day") - days, F.col("s_day") + days)))
    keys = ["_k", "_gx", "_gy", "_day"]
    many = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / EVENT_BLOCK).alias("_n"))
    e_block = (left.join(many, keys).groupBy(*keys, F.pmod(F.xxhash64(*e_cols), F.col("_n")).alias("_b"))
               .agg(F.collect_list(F.struct(*e_cols)).alias("e_block")))
    # the columns of the order come first in the struct
    s_block = right.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*s_cols))).alias("s_block"))
    # costly for their size: blocks are dealt over all partitions
    met = e_block.join(s_block.hint("merge"), keys, "left" if prefer else "inner").select("e_block", "s_block").repartition(int(session.conf.get("spark.sql.shuffle.partitions")))
    hits = met.mapInArrow(_hits(e_out, s_out, names, prefer), schema)
    return hits if lost is None else hits.unionByName(lost)


def select_scenes(items: DataFrame, covered: DataFrame, *, min_cover: float = 0.97, alone: float = 0.97,
                  max_cloud: float = 100.0) -> DataFrame:
    """One scene per area and date out of catalogue items: a lone tile when it covers enough, otherwise a mosaic.

    ``items``: item_id, aoi, date, platform, orbit, tile, cloud, aoi_cells; ``covered``: item_id, cell (grid cells of
    the area the item covers, which stand for its overlap area), or one row per item with the array ``cells``.
    """
    if max_cloud < 100:
        items = items.where(F.col("cloud") < max_cloud)
    if "cells" in covered.columns:
        # a row holds an item's cells: nothing is shuffled but their number, and only the cells of chosen items grow to rows
        area = covered.select("item_id", F.size(F.array_distinct("cells")).cast("bigint").alias("area")).where("area > 0")
    else:
        area = covered.groupBy("item_id").agg(F.count_distinct("cell").alias("area"))
    key = ["aoi", "date", "platform", "orbit"]
    # no side derived from ``covered`` may be broadcast: its size is estimated without the rows that a generator adds
    it = items.join(area.hint("merge"), "item_id")
    # a tile may come in two processings: keep the one that covers more
    per_tile = it.groupBy(*key, "tile").agg(F.min_by(F.struct("item_id", "area", "cloud", "aoi_cells"),
                                                     F.struct(-F.col("area"), "item_id")).alias("i")).select(*key, "tile", "i.*")
    top = per_tile.groupBy(*key).agg(F.min_by(F.struct("item_id", "area"), F.struct(-F.col("area"), "item_id")).alias("top"))
    # written once, so its true size is known: at most one item per tile, area and date meets the cells
    parts = materialise(per_tile.join(top, key).where(
        (F.col("top.area") / F.col("aoi_cells") < alone) | (F.col("item_id") == F.col("top.item_id"))))
    chosen = covered.join(parts.select(*key, "item_id"), "item_id")
    if "cells" in covered.columns:
        chosen = chosen.withColumn("cell", F.explode("cells"))
    union = (chosen
             .groupBy(*key).agg(F.count_distinct("cell").alias("cells")))
    scene = (parts.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.max("aoi_cells").alias("aoi_cells"),
        (F.sum(F.col("area") * F.coalesce("cloud", F.lit(0.0))) / F.sum("area")).alias("cloud"),
        F.max("top.item_id").alias("main_item")).join(union, key)
        .withColumn("cover", F.col("cells") / F.col("aoi_cells")).where(F.col("cover") >= min_cover))
    return scene.groupBy("aoi", "date").agg(F.min_by(
        F.struct("main_item", "n_tiles", "cover", "cloud"),
        F.struct("n_tiles", -F.col("cover"), "cloud", "main_item")).alias("s")).select("aoi", "date", "s.*")


def cap_scenes(scenes: DataFrame, limit: int = 30) -> DataFrame:
    """The least cloudy scenes of every area, numbered in time order."""
    kept = top_k(scenes, ["aoi"], [F.col("cloud"), F.col("t_s"), F.col("item_id")], limit, "_r", salt_on="item_id").drop("_r")
    return kept.withColumn("scene_seq", F.row_number().over(Window.partitionBy("aoi").orderBy("t_s", "item_id")))


def acquisition_windows(dates: DataFrame, days: int = 1) -> DataFrame:
    """Runs of consecutive days around the event dates of each area: aoi, first_day, last_day, n_days."""
    d = (dates.select("aoi", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))).alias("day"))
         .distinct())
    w = Window.partitionBy("aoi").orderBy("day")
    d = d.withColumn("_new", (F.datediff("day", F.lag("day").over(w)) != 1).cast("int"))
    d = d.withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(w))
    return d.groupBy("aoi", "_run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                        F.count(F.lit(1)).alias("n_days")).drop("_run")


def mosaic_fill(pixels: DataFrame, keys: list[str], priority: str, probe: str, payload: list[str]) -> DataFrame:
    """Every pixel from the first tile (by priority) that has data there, all bands together."""
    src = F.when(F.col(probe).isNotNull(), F.col(priority))
    return (pixels.groupBy(*keys).agg(F.min_by(F.struct(priority, *payload), src).alias("s")).select(*keys, "s.*"))


def wind_key(v: Column) -> Column:
    """Quarter-degree key of the wind grid."""
    return F.bround(v * 4, 0) / 4


def label_scan(pixels: DataFrame, mapping: dict[int, int] = LABEL_TO_GROUP) -> DataFrame:
    """Labelled pixels with their group and scene id (patch id without its last part); class 0 is unlabelled."""
    m = F.create_map(*[F.lit(int(x)) for kv in mapping.items() for x in kv])
    return pixels.where(F.col("cl") > 0).withColumn("grp", m[F.col("cl").cast("int")]).withColumn(
        "scene", F.regexp_extract("pid", r"^(.*)_[^_]*$", 1))
