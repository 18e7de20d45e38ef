"""Corpus pipeline: toxicity, exact copies, near copies, mixing, tokens."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flotsam.llm import bpe, exact_dedup, mixing, near_dup, toxicity
from flotsam.llm.common import fold, table
from flotsam.llm.queries import public_tokenizer
from flotsam.session import materialise


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.3 or more) go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold(4) != 2)
    return toxicity.keep_clean(docs, model, threshold=0.3)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near copies stays: the one with the smallest id."""
    return near_dup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: documents beyond it go, others repeat (at most three times)."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text they decode to."""
    return bpe.round_trip(docs, public_tokenizer())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", exact_copies),
    ("near_dup", near_copies),
    ("mixing", mixed),
    ("tokens", tokens),
]

# trained models, random signatures and a tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
