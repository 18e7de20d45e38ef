"""Exact deduplication by skew-safe combining."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flotsam.llm.common import WHITE, text_of
from flotsam.session import materialise

SALTS = 16
# a winner is one decimal number, so the combining stays a hash aggregation: code points times 2**65, plus 2**63 - id
# (0 for a null id)
_PER_POINT, _TOP_ID = 2 ** 65, 2 ** 63


def _winner(points: Column, doc_id: Column) -> Column:
    rest = F.coalesce(F.lit(str(_TOP_ID)).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    return (points.cast("decimal(10,0)") * F.lit(str(_PER_POINT)).cast("decimal(20,0)") + rest).cast("decimal(38,0)")


def _winner_id(w: Column) -> Column:
    rest = (w % F.lit(str(_PER_POINT)).cast("decimal(20,0)")).cast("decimal(21,0)")
    return F.when(rest > 0, F.lit(str(_TOP_ID)).cast("decimal(20,0)") - rest).cast("bigint")


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after deleting all white space; the row with the most code points in its original
    text stays, then the smallest id. Combining has three stages, each of which compares the full normalised text and
    not only its digest: within the tasks that read the rows, over salted digest groups, and over the winners of the
    salts. A group of any size is therefore cut down in parallel; what remains of it is one row per salt.

    Null text counts as empty, all empty texts are one group. A null id loses against every other id of the same
    length. Of repeated rows (same id, same text) exactly one is kept. No rows give no rows; other columns are ignored.
    """
    t = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("_text"))
    t = t.select("doc_id", F.char_length("_text").alias("_points"), F.translate("_text", WHITE, "").alias("_norm"))
    t = t.withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_second", F.xxhash64("_norm"))

    salted = (t.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_points"), F.lit(salts)))
              .groupBy("text_sha256", "_second", "_salt", "_norm")
              .agg(F.max(_winner(F.col("_points"), F.col("doc_id"))).alias("_w"), F.count(F.lit(1)).alias("_n")))
    best = (salted.groupBy("text_sha256", "_second", "_norm").agg(F.max("_w").alias("_w"), F.sum("_n").alias("group_size"))
            .select("text_sha256", "_second", "group_size", _winner_id(F.col("_w")).alias("keep_id"),
                    F.floor(F.col("_w") / F.lit(str(_PER_POINT)).cast("decimal(20,0)")).cast("int").alias("_best")))
    best = materialise(best)            # written, so that the join below can split a hot digest

    rows = t.select("doc_id", "_points", "text_sha256", "_second").join(best, ["text_sha256", "_second"])
    wins = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_points") == F.col("_best"))
    once = Window.partitionBy("doc_id", "text_sha256", "_points").orderBy(F.lit(1))
    return rows.withColumn("_row", F.row_number().over(once)).select(
        "doc_id", "keep_id", "group_size", (wins & (F.col("_row") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (see ``mark_copies``)."""
    keep = mark_copies(docs, id_col, text_col, salts).where("kept").select(
        F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("bigint").alias("_id"), F.char_length(F.col(text_col)).alias("_points"),
                    F.sha2(F.translate(text_of(text_col), WHITE, ""), 256).alias("_digest"))
    d = d.join(materialise(keep), F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_digest") == F.col("_sha")))
    # only repeated rows meet here: the pair of id and digest has one winner
    order = Window.partitionBy("_keep", "_sha").orderBy(F.col("_points").desc())
    return d.withColumn("_row", F.row_number().over(order)).where(F.col("_row") == 1).select("doc.*")
