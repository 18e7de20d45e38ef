"""Helpers that several training-data operators share."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"          # the characters of [\x20\x09-\x0D]
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def fold(modulus: int, c: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % modulus


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """md5 of id and text: an order of the rows that looks random and is the same in every run and engine."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit("|"), F.md5(text_of(text_col))))


def key_number(key: Column) -> Column:
    """First 32 bits of a hexadecimal key."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def running_before(df: DataFrame, group: list[str], key32: str, order: list[str], values: dict[str, str],
                   rows_per_bucket: int = 4096) -> DataFrame:
    """Sums of the rows before each row of its group, in the order ``(key32, *order)``; output → value column.

    ``key32`` is spread evenly over 0 .. 2**32-1, so equal ranges of it hold about equal numbers of rows: every range
    of a group is a window of its own, and only the totals of the ranges are summed over a whole group. Neither a
    group nor the table passes through one task. ``group`` must not hold nulls.
    """
    buckets = max(1, -(-df.count() // rows_per_bucket))
    d = df.withColumn("_range", F.shiftright(F.col(key32) * buckets, 32).cast("int"))
    per = d.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(*group, "_range", *[F.coalesce(F.sum(f"_t_{o}").over(ahead), F.lit(0)).alias(f"_s_{o}") for o in values])
    inside = Window.partitionBy(*group, "_range").orderBy(key32, *order).rowsBetween(Window.unboundedPreceding, -1)
    return (d.join(start, [*group, "_range"])
            .withColumns({o: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_s_{o}") for o, v in values.items()})
            .drop("_range", *[f"_s_{o}" for o in values]))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by key over as many partitions as the session plans for a shuffle, however few bytes they have.

    For rows that cost much more work than their bytes suggest, which an adaptive plan would put together.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def slices(batch: pa.RecordBatch, text_col: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``max_bytes`` of text each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
