"""Reproducible fingerprints of results and the registry of saved queries."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flotsam.operators.ranking import global_rank
from flotsam.session import materialise

FAN = 1000


def canonical(df: DataFrame, columns: list[str]) -> Column:
    """One text per row that no other row shares: every value in column order as its length, a colon and its text.

    A null is a dash without a length. Floating numbers are written with six decimals, which is part of the format.
    """
    types = dict(df.dtypes)
    parts = []
    for c in columns:
        v = F.col(c).cast("decimal(38,6)").cast("string") if types[c] in ("double", "float") else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.concat_ws("|", *parts)


def fingerprint(df: DataFrame, columns: list[str], order: list[str], levels: int | None = None) -> DataFrame:
    """sha256 over all rows in order, as a tree: hashes of 1000 rows are hashed again until one is left.

    No task ever holds more than 1000 hashes of a level, whatever the size of the result. ``levels`` fixes the number of
    levels above the rows; the root then takes all hashes of the level below it, with two levels one per 1000 rows.
    """
    n_cols = df.select(*dict.fromkeys([*order, *columns]))
    level = materialise(global_rank(n_cols, order, "_r").select((F.col("_r") - 1).alias("i"), F.sha2(canonical(df, columns), 256).alias("h")))
    rows = n = level.agg(F.count(F.lit(1))).first()[0]
    if rows == 0:
        return df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("sha256"), F.lit(0).cast("bigint").alias("n_rows"))
    depth = 0
    # always a level of blocks below the root, so that small and large results are hashed alike
    while depth < levels if levels else n > 1 or depth < 2:
        block = F.lit(0).cast("bigint") if depth + 1 == levels else F.floor(F.col("i") / FAN)
        level = level.groupBy(block.alias("i")).agg(F.sha2(F.concat_ws("", F.transform(
            F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])), 256).alias("h"))
        n, depth = -(-n // FAN), depth + 1
    return level.select(F.col("h").alias("sha256"), F.lit(rows).cast("bigint").alias("n_rows"))


def query_id(params: dict) -> str:
    """First 12 hex digits of the hash of the sorted parameters."""
    return hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:12]


def saved_query(result: DataFrame, params: dict, versions: dict) -> DataFrame:
    """Registry row of a query: id, parameters, versions and the fingerprint of its result."""
    return result.select(F.lit(query_id(params)).alias("id"), F.lit(json.dumps(params, sort_keys=True)).alias("params"),
                         F.lit(json.dumps(versions, sort_keys=True)).alias("versions"), "sha256", "n_rows")


def compare_runs(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Saved fingerprints against new ones: match, or which versions changed; missing sides count as a mismatch."""
    s = saved.select("id", F.col("sha256").alias("saved_sha256"), F.col("versions").alias("saved_versions"))
    n = now.select("id", F.col("sha256").alias("rerun_sha256"), F.col("versions").alias("current_versions"))
    return s.join(n, "id", "full_outer").withColumn("match", F.coalesce(F.col("saved_sha256") == F.col("rerun_sha256"), F.lit(False))).withColumn(
        "versions_changed", ~F.col("saved_versions").eqNullSafe(F.col("current_versions")))


def group_hashes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Order-free content hash per group: row count and two modular sums of row hashes, combined before the shuffle."""
    h = F.sha2(canonical(df, columns), 256)
    part = [F.conv(F.substring(h, a, 8), 16, 10).cast("bigint") for a in (1, 9)]
    g = df.withColumns({"_a": part[0], "_b": part[1]}).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    return g.select(*keys, "n_rows", F.sha2(F.concat_ws(":", "n_rows", "a", "b"), 256).alias("content_hash"))


def manifest_problems(saved: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose content changed or that are missing on one side."""
    s = saved.select(*keys, F.col("content_hash").alias("_s"))
    n = now.select(*keys, F.col("content_hash").alias("_n"))
    j = s.join(n, keys, "full_outer")
    return j.where(~F.col("_s").eqNullSafe(F.col("_n"))).select(
        *keys, F.when(F.col("_s").isNull(), "not_in_manifest").when(F.col("_n").isNull(), "missing").otherwise("changed").alias("problem"))
