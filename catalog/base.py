"""Registry, and the canonical inputs as SQL views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark import views as V
from logspark.functions.timing import ms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# name -> (views it needs, body)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), """
        SELECT event_id, ts, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms,
               CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
               'svc-' || CAST(user_id % 10 AS VARCHAR) AS service,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'DEBUG' ELSE 'INFO' END AS level
        FROM events"""),
    "logs": (("ev",), """
        SELECT CAST(user_id % 3 AS VARCHAR) AS tenant_id, ts_ms, service AS source, level,
               event_type || ' user ' || user_id || ' item ' || k || ' cents ' || cents AS message,
               '{"k": ' || k || ', "duration_ms": ' || cents || ', "action": "' || event_type || '"}' AS raw_json
        FROM ev"""),
    "spans": (("ev",), """
        SELECT CAST((event_id // 8) % 3 AS VARCHAR) AS tenant_id, 't' || (event_id // 8) AS trace_id, 's' || event_id AS span_id,
               CASE WHEN event_id % 8 <> 0 THEN 's' || greatest(event_id - 1 - event_id % 2, (event_id // 8) * 8) END AS parent_span_id,
               service AS service_name, event_type AS operation_name, ts_ms AS start_ms,
               ts_ms + CAST(floor(value) AS BIGINT) AS end_ms, value AS duration_ms,
               CASE WHEN level = 'ERROR' THEN 'ERROR' ELSE 'OK' END AS status_code
        FROM ev"""),
    "traces": (("spans",), """
        SELECT trace_id, arg_min(service_name, (CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END, start_ms, span_id)) AS root_service,
               arg_min(operation_name, (CASE WHEN parent_span_id IS NULL THEN 0 ELSE 1 END, start_ms, span_id)) AS root_operation,
               min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS span_count,
               count(*) FILTER (WHERE status_code = 'ERROR') AS error_count,
               CAST(greatest(0, max(end_ms) - min(start_ms)) AS DOUBLE) AS duration_ms
        FROM spans GROUP BY trace_id"""),
    "cluster_events": (("ev",), """
        SELECT ts_ms, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS cluster_id,
               service, event_type AS template FROM ev"""),
    "telemetry": (("ev",), """
        SELECT ts_ms AS timestamp, CAST(cents % 101 AS DOUBLE) AS cpu_percent, CAST(k AS DOUBLE) AS memory_percent, CAST(cents AS DOUBLE) AS disk_iops,
               CAST(k % 3 AS DOUBLE) AS network_drops, CAST(k % 5 AS DOUBLE) AS network_errors
        FROM ev WHERE event_type = 'view'"""),
    "incidents": ((), """
        SELECT o_orderkey AS id, CAST(o_custkey % 3 AS VARCHAR) AS tenant_id, CASE WHEN o_orderstatus = 'F' THEN 'RESOLVED' ELSE 'OPEN' END AS status,
               'Failure in ' || o_orderpriority || ' for customer ' || o_custkey AS title,
               CASE WHEN o_orderkey % 97 <> 0 THEN o_orderpriority END AS domain,
               'status ' || o_orderstatus || ' key ' || o_orderkey AS summary, (o_orderkey % 101) / 100.0::DOUBLE AS impact_score,
               CASE WHEN o_orderkey % 7 = 0 THEN 'P0' WHEN o_orderkey % 7 = 1 THEN 'P1' ELSE 'P2' END AS severity,
               epoch_us(o_orderdate) // 1000 + (o_orderkey % 24) * 3600000 AS created_ms, CAST(o_orderkey % 50 AS VARCHAR) AS run_id
        FROM orders"""),
    "runs": ((), """
        SELECT CAST(n AS VARCHAR) AS id, CAST(n % 3 AS VARCHAR) AS tenant_id, 'batch-' || (n % 5) AS source, raw_lines, cluster_count,
               1.0::DOUBLE - cluster_count / raw_lines AS reduction_ratio, raw_lines * 0.5::DOUBLE AS duration_sec, created_ms
        FROM (SELECT o_custkey // 10 AS n, count(*) AS raw_lines, count(DISTINCT o_orderpriority) AS cluster_count,
                     max(epoch_us(o_orderdate) // 1000) AS created_ms FROM orders GROUP BY 1)"""),
    "tenants": ((), """
        SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'pro' WHEN 1 THEN 'free' WHEN 2 THEN 'enterprise' ELSE 'trial' END AS tier
        FROM nation"""),
    "slos": ((), """
        SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey % 3 AS VARCHAR) AS tenant_id, n_name AS name, 'svc-' || (n_nationkey % 12) AS service,
               CASE n_nationkey % 3 WHEN 0 THEN 'availability' WHEN 1 THEN 'latency' ELSE 'throughput' END AS sli_type,
               60.0::DOUBLE + n_nationkey AS target_percentage, 1 + n_nationkey AS window_days
        FROM nation"""),
    "alerts": (("ev",), """
        SELECT event_id AS id, service AS source, CAST(event_id % 50 AS VARCHAR) AS run_id,
               CASE k % 5 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' ELSE 'P7' END AS priority, k % 4 AS cluster_id,
               'errors in ' || service AS cluster_summary, 'user ' || user_id || ' failed' AS representative_log, k / 100.0::DOUBLE AS anomaly_score, ts_ms
        FROM ev WHERE event_type = 'error'"""),
    "vecs": ((), """
        SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label, 'template ' || vec_id AS template FROM embeddings"""),
    "base": (("vecs",), """
        SELECT label AS cluster_id, list(x ORDER BY i) AS vector FROM (
            SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs)
            GROUP BY label, i) GROUP BY label"""),
    "norm": ((), None),  # filled in catalog.text: documents with their template
    "snap": (("norm",), """
        SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY n DESC, template) AS INTEGER) AS ord, template, n AS size,
               (length(template) % 100) / 100.0::DOUBLE AS anomaly_score, 'P' || (length(template) % 4) AS priority
        FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS run, template, count(*) AS n FROM norm GROUP BY 1, 2)"""),
}


def with_views(body: str) -> str:
    """``body`` with the WITH clause of the views it names (``body`` may start with extra CTEs)."""
    import re

    needed: list[str] = []

    def visit(name: str) -> None:
        for dep in SQL_VIEWS[name][0]:
            visit(dep)
        if name not in needed:
            needed.append(name)

    for name in SQL_VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", body):
            visit(name)
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in needed)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", body, re.S)
    if not ctes:
        return body
    if own:
        return f"WITH {own.group(1) or ''}{ctes}, {own.group(2)}"
    return f"WITH {ctes} {body}"


def entry(name: str, sql: str | None = None):
    """Register a query under its inventory id, with the SQL that must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def as_ms(df: DataFrame, **columns: str) -> DataFrame:
    """Replace TIMESTAMP columns by epoch-ms ones: ``as_ms(df, ts_ms="timestamp")``."""
    for new, old in columns.items():
        df = df.withColumn(new, ms(F.col(old)))
    return df.drop(*[old for new, old in columns.items() if new != old])


def tenants(spark: SparkSession, sf: str) -> DataFrame:
    region = F.col("n_regionkey")
    return V.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"),
        F.when(region == 0, "pro").when(region == 1, "free").when(region == 2, "enterprise").otherwise("trial").alias("tier"),
    )


def slos(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return V.table(spark, sf, "nation").select(
        n.cast("long").alias("id"), (n % 3).cast("string").alias("tenant_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("svc-"), (n % 12).cast("string")).alias("service"),
        F.when(n % 3 == 0, "availability").when(n % 3 == 1, "latency").otherwise("throughput").alias("sli_type"),
        (F.lit(60.0) + n).alias("target_percentage"), (n + 1).alias("window_days"),
    )


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return V.events(spark, sf).where(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), F.col("service").alias("source"), (F.col("event_id") % 50).cast("string").alias("run_id"),
        F.when(k % 5 == 0, "P0").when(k % 5 == 1, "P1").when(k % 5 == 2, "P2").when(k % 5 == 3, "P3").otherwise("P7").alias("priority"),
        (k % 4).alias("cluster_id"), F.concat(F.lit("errors in "), F.col("service")).alias("cluster_summary"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" failed")).alias("representative_log"),
        (k / F.lit(100.0)).alias("anomaly_score"), "ts_ms",
    )
