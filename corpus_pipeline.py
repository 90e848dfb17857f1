"""A corpus from raw documents to shards: toxicity, near-duplicates, contamination, mixture, shuffle.

Each stage takes the documents that its predecessor kept, from Parquet, and returns documents; the last one
adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.llm import decontaminate, mixing, near_dedup, sharding, toxicity
from logspark.session import scratch_path

SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. Documents that share an id share the worst of their scores."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = scored.where("predicted = 1").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(toxic, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least id."""
    return near_dedup.drop_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mixture takes: a row per copy and run; whole documents but for one or two cuts a source."""
    mixed = mixing.mixed_documents(docs, mixing.mix(docs))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else mixed


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard and slot of a uniform shuffle."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", shuffle_into_shards),
]

ORACLE_SQL = None  # a trained classifier and seeded draws are not SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
