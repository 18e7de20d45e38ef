"""Fixed-column CSV, GeoJSON features and partitioned Parquet."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_feature(lon: Column, lat: Column, props: list[str]) -> Column:
    """GeoJSON point feature as text; one feature per row keeps the writer distributed."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties")), {"ignoreNullFields": "false"})


def line_feature(line: Column, props: list[str]) -> Column:
    """Feature of a line given as an array of ``struct(lon, lat)``."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"),
                 F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties")), {"ignoreNullFields": "false"})


def write_features(features: DataFrame, path: str, column: str = "feature") -> None:
    """Newline-delimited features, one file per partition."""
    features.select(F.col(column).alias("value")).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a fixed column order; columns the table lacks stay empty."""
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*cols).write.mode("errorifexists").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("aoi", "date")) -> None:
    """Parquet by area and date. The extra split of the partition key keeps a hot area out of a single task."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    (df.withColumn("_s", salt).repartition(*by, "_s").drop("_s")
     .write.mode("errorifexists").partitionBy(*by).parquet(path))
