"""Session helpers: a local session for tests and benches, shared scratch space, cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def local_session(cores: str | int = "*", app: str = "logspark") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` as the cluster names it.

    Only where the setting is absent and the session is local (tests, a laptop) is a temporary folder
    used instead; on a cluster its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
    folder = tempfile.mkdtemp(prefix="logspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables a job writes and reads back."""
    return os.path.join(shared_dir(spark), "logspark-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that iterations neither re-run nor grow the plan.

    A reliable checkpoint survives the loss of an executor.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: compressed and by column, for rows with texts or sets."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` stored, with ``name``: the rank from 1 by ``order`` within ``keys`` (which must not be null).

    Rows are dealt by ranges of keys and order, so no task sorts them all; what is counted together is a row per task and key.
    """
    at = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", at)
    kept = stored(sorted_rows, "numbered").withColumn("_task", F.shiftright("_at", 33))
    counts = kept.groupBy(*keys, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*keys).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*keys, "_task", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    ranked = kept.join(F.broadcast(counts), [*keys, "_task"])
    return ranked.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """For work that is heavy per row: deal the rows out when the scan has fewer splits than cores.

    Tables of many files pass through untouched, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
