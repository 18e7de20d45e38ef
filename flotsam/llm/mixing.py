"""Mixing sources to target weights by weighted fair queueing."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flotsam.llm.common import WORD, key_number, row_key, running_before, text_of
from flotsam.session import materialise

STEPS = 65536       # virtual time is cut into steps of 1 / STEPS; only the step that meets the budget is put in order


def targets(per_source: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``source, source_size, docs, target`` from ``source, source_size, docs``.

    Sources in code point order (null last) take the weights in turn. The budget is ``share`` of all sizes; no target
    is above ``repeats`` times its source, and what is cut there is shared out again by weight. One row per source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    t = per_source.withColumn("_rank", rank).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("_cap", (F.col("source_size") * repeats).cast("double"))
    t = t.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.orderBy("_ratio", "_rank")
    ahead = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level at which this source and all with a larger ratio would be served, were those before it at their caps
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(ahead), F.lit(0.0)))
             / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))))
    t = t.withColumn("_level", level)
    t = t.withColumn("_level", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(whole))
    return t.select("source", "source_size", "docs", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, repeats: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc`` (the row of ``docs``), ``size, source_size, target, copies``: how often the mix takes each document.

    Each source's documents are shuffled by a key of their content. A document's virtual finish time is the number of
    words of its source up to its own end divided by the source's target; later rounds through the same source follow
    on. All copies are ordered by that time and taken while their words fit into the budget. The budget falls into one
    step of virtual time, found from sums per step, and only that step is put in order. As a source's copies are taken
    from its front, the decision is one cut per source, which goes back to the documents by the source alone: no text
    is shuffled for the decision. Reruns agree.

    Null text has no words; null is a source of its own, after all others. A source without words has target 0 and is
    not taken; a document without words inside a source with words is taken like its neighbours. Repeated rows share
    one key and one decision. No rows give no rows; extra columns of any name travel inside ``doc``.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source_col).alias("source"),
                        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint").alias("_size"), row_key(id_col, text_col).alias("_key"))
    thin = materialise(keyed.select("source", "_size", "_key", key_number(F.col("_key")).alias("_k32")))
    per = targets(thin.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, share, repeats)
    per = materialise(per.withColumn("_s", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))))
    budget = per.agg(F.sum("source_size").cast("double") * float(share)).first()[0] or 0.0

    s = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    queue = running_before(thin.withColumn("_s", s).select("_s", "_size", "_key", "_k32"), ["_s"], "_k32", ["_key"], {"_before": "_size"})
    lane = queue.join(per.select("_s", "source_size", "target"), "_s").where(F.col("target") > 0)
    copies = lane.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).select(
        "_s", "_size", "_key", "_round",
        ((F.col("_round") * F.col("source_size") + F.col("_before") + F.col("_size")) / F.col("target")).alias("_finish"))
    copies = materialise(copies.withColumn("_step", F.floor(F.least("_finish", F.lit(2.0)) * STEPS)))

    # at most 2 * STEPS + 1 rows, whatever the input
    upto = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = copies.groupBy("_step").agg(F.sum("_size").alias("_words")).withColumn("_upto", F.sum("_words").over(upto))
    full = steps.where(F.col("_upto") > budget).orderBy("_step").select("_step", (F.col("_upto") - F.col("_words")).alias("_from")).first()
    if full is None:
        taken = copies
    else:
        order = Window.orderBy("_finish", "_s", "_round", "_key").rowsBetween(Window.unboundedPreceding, 0)
        last = (copies.where(F.col("_step") == full["_step"]).withColumn("_upto", F.sum("_size").over(order) + full["_from"])
                .where(F.col("_upto") <= budget).drop("_upto"))
        taken = copies.where(F.col("_step") < full["_step"]).unionByName(last)
    # a source's taken copies are its first rounds whole and the front of one more, up to a key
    cut = taken.groupBy("_s").agg(F.max("_round").alias("_round"), F.max(F.struct("_round", "_key")).alias("_last"))
    cut = per.join(cut, "_s", "left").select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
                                             F.col("target").alias("_target"), "_round", F.col("_last._key").alias("_cut"))
    out = keyed.join(materialise(cut), F.col("source").eqNullSafe(F.col("_source")))
    n = F.when(F.col("_round").isNull(), 0).otherwise(F.col("_round") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0))
    return out.select("doc", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
                      n.cast("int").alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    m = mix(docs, **options).where(F.col("copies") > 0)
    return m.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
