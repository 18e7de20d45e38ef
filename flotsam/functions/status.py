"""Status dictionaries, scene regions and field-product choice."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.config import CURRENT_PRODUCTS, SHELF_BOX, WIND_PRODUCTS


def label_of(code: Column, table) -> Column:
    """Label of a coded status (dictionaries of at most ten entries)."""
    return F.create_map(*[x for c, _, text in table for x in (F.lit(int(c)), F.lit(text))])[code.cast("int")]


def key_of(code: Column, table) -> Column:
    return F.create_map(*[x for c, key, _ in table for x in (F.lit(int(c)), F.lit(key))])[code.cast("int")]


def label_of_key(key: Column, table) -> Column:
    return F.create_map(*[x for _, k, text in table for x in (F.lit(k), F.lit(text))])[key]


def tile_region(tile: Column, regions) -> Column:
    out = None
    for name, prefixes in regions.items():
        cond = F.lit(False)
        for p in prefixes:
            cond = cond | tile.startswith(p)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("other"))


def current_product(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Shelf product when the whole box lies on the shelf, else the global one."""
    a, b, c, d = SHELF_BOX
    inside = (x0 >= a) & (x1 <= c) & (y0 >= b) & (y1 <= d)
    return F.when(inside, F.lit(CURRENT_PRODUCTS["shelf"])).otherwise(F.lit(CURRENT_PRODUCTS["global"]))


def wind_product(day: Column) -> Column:
    """The newest product that already existed on the day; null before the first."""
    out = None
    for name, since in WIND_PRODUCTS:
        cond = day >= F.lit(since).cast("date")
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def time_coverage_violations(field: DataFrame, keys: list[str], hour: str, value: str, *, t0: int, horizon: int) -> DataFrame:
    """Fields that start more than 12 h late, end before the horizon or hold no value."""
    g = field.groupBy(*keys).agg(F.min(hour).alias("_h0"), F.max(hour).alias("_h1"), F.count(value).alias("_n"))
    g = g.select(*keys, (F.col("_h0") - t0 > 12).alias("starts_late"), (F.col("_h1") < t0 + horizon).alias("ends_early"),
                 (F.col("_n") == 0).alias("no_values"))
    return g.where("starts_late or ends_early or no_values")
