"""From raw documents to packed training batches, one operator of orderlens.llm a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orderlens.llm import mixing, packing, quality, repeats, simhash
from orderlens.llm.common import small_batches, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good; the others go."""
    small_batches(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    small_batches(spark)
    return simhash.first_of_each(docs, size=3, radius=3)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that stand earlier in the corpus."""
    small_batches(spark)
    return repeats.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per copy taken."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences dealt into batches of a token budget."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near_duplicates", different),
    ("repeats", unrepeated),
    ("mixing", mixed),
    ("packing", packed),
]

# Training a classifier and finding repeats are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and reread before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
