"""From raw documents to training shards: a pipeline of five operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewarden.llm import decontaminate, jaccard_join, mixing, quality, sharding
from tablewarden.llm.common import WORD, Placed, pick, table
from tablewarden.runtime import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the outlier test reject go."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, linked by a similarity of 0.8 or more on five-word shingles.

    SimHash's byte-position index comes first, its candidates verified by their shingles. At 3 bits it misses most
    pairs near 0.8, so the exact join links what it has left apart.
    """
    return jaccard_join.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.decontaminate(docs, pick(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; a copy taken by less than half is left out."""
    placed = Placed(docs)
    words = F.coalesce(F.regexp_count(placed.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    ordered = mixing.training_order(placed.df.withColumn("words_in", words), "words_in", source=placed.place("source"))
    return placed.restore(ordered)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the slot of every copy, with the columns of the document but its text."""
    placed = Placed(docs)
    rows = sharding.assign(placed.df, 8, placed.place("doc_id"))
    return placed.restore(rows, F.col("shard"), F.col("slot")).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("curriculum_mix", mixed),
    ("jump_shards", shards),
]

#: Estimates, fingerprints and jump hashing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage is written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
