"""The generated test tables seen as the canonical inputs (logs, spans, telemetry, incidents ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logspark.functions.timing import at_ms, ntz_ms
from logspark.session import spread

EVENTS_NOW_MS = 1_706_659_200_000  # 2024-01-31 00:00:00 UTC
ORDERS_NOW_MS = 996_710_400_000  # 2001-08-02 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _div(number: Column, by: int) -> Column:
    return F.floor(number / by)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events + ts_ms, cents, k, service, level."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value",
        ntz_ms(F.col("ts")).alias("ts_ms"),
        F.floor(F.col("value") * 100 + 0.5).alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        _id("svc-", F.col("user_id") % 10).alias("service"),
        F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").when(kind == "signup", "DEBUG")
        .otherwise("INFO").alias("level"),
    )


def message() -> Column:
    return F.concat(
        F.col("event_type"), F.lit(" user "), F.col("user_id").cast("string"), F.lit(" item "),
        F.col("k").cast("string"), F.lit(" cents "), F.col("cents").cast("string"),
    )


def raw_json() -> Column:
    return F.concat(
        F.lit('{"k": '), F.col("k").cast("string"), F.lit(', "duration_ms": '), F.col("cents").cast("string"),
        F.lit(', "action": "'), F.col("event_type"), F.lit('"}'),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        (F.col("user_id") % 3).cast("string").alias("tenant_id"),
        at_ms(F.col("ts_ms")).alias("timestamp"),
        F.col("service").alias("source"), "level", message().alias("message"), raw_json().alias("raw_json"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    first = _div(F.col("event_id"), 8) * 8
    parent = F.greatest(F.col("event_id") - 1 - F.col("event_id") % 2, first)
    return e.select(
        (_div(F.col("event_id"), 8) % 3).cast("string").alias("tenant_id"),
        _id("t", _div(F.col("event_id"), 8)).alias("trace_id"),
        _id("s", F.col("event_id")).alias("span_id"),
        F.when(F.col("event_id") % 8 != 0, _id("s", parent)).alias("parent_span_id"),
        F.col("service").alias("service_name"), F.col("event_type").alias("operation_name"),
        at_ms(F.col("ts_ms")).alias("start_time"),
        at_ms(F.col("ts_ms") + F.floor("value")).alias("end_time"),
        F.col("value").alias("duration_ms"),
        F.when(F.col("level") == "ERROR", "ERROR").otherwise("OK").alias("status_code"),
    )


# Cluster ids of the event kinds.
CLUSTER_OF = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cluster = F.lit(-1)
    for name, number in CLUSTER_OF.items():
        cluster = F.when(kind == name, number).otherwise(cluster)
    return events(spark, sf_dir).select("ts_ms", cluster.alias("cluster_id"), "service", kind.alias("template"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view events as host samples; integers as doubles, so sums and peaks are exact."""
    e = events(spark, sf_dir).where(F.col("event_type") == "view")
    return e.select(
        F.col("ts_ms").alias("timestamp"),
        (F.col("cents") % 101).cast("double").alias("cpu_percent"),
        F.col("k").cast("double").alias("memory_percent"),
        F.col("cents").cast("double").alias("disk_iops"),
        (F.col("k") % 3).cast("double").alias("network_drops"),
        (F.col("k") % 5).cast("double").alias("network_errors"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    created = ntz_ms(F.col("o_orderdate")) + (key % 24) * 3_600_000
    return o.select(
        key.alias("id"), (F.col("o_custkey") % 3).cast("string").alias("tenant_id"),
        F.when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("OPEN").alias("status"),
        F.concat(F.lit("Failure in "), F.col("o_orderpriority"), F.lit(" for customer "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(key % 97 != 0, F.col("o_orderpriority")).alias("domain"),
        F.concat(F.lit("status "), F.col("o_orderstatus"), F.lit(" key "), key.cast("string")).alias("summary"),
        ((key % 101) / F.lit(100.0)).alias("impact_score"),
        F.when(key % 7 == 0, "P0").when(key % 7 == 1, "P1").otherwise("P2").alias("severity"),
        at_ms(created).alias("created_at"), (key % 50).cast("string").alias("run_id"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders grouped into runs of 50 customers."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(_div(F.col("o_custkey"), 10).alias("n")).agg(
        F.count("*").alias("raw_lines"), F.countDistinct("o_orderpriority").alias("cluster_count"),
        F.max(ntz_ms(F.col("o_orderdate"))).alias("created_ms"),
    ).select(
        F.col("n").cast("string").alias("id"), (F.col("n") % 3).cast("string").alias("tenant_id"),
        _id("batch-", F.col("n") % 5).alias("source"), "raw_lines", "cluster_count",
        (1.0 - F.col("cluster_count") / F.col("raw_lines")).alias("reduction_ratio"),
        (F.col("raw_lines") * 0.5).alias("duration_sec"), at_ms(F.col("created_ms")).alias("created_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts; spread, because every use of them runs regular expressions over whole texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("int").alias("label"),
        _id("template ", F.col("vec_id")).alias("template"), _id("svc-", F.col("vec_id") % 10).alias("source"),
        (F.col("vec_id") * 1000).alias("timestamp"),
    )
