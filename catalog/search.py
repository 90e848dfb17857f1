"""C: filters, searches, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import alerts, as_ms, entry
from logspark import views as V
from logspark.functions import search as S
from logspark.functions.timing import at_ms
from logspark.operators import filters as C
from logspark.operators.aggregate import trace_summary

NOW = V.EVENTS_NOW_MS
LOG = "tenant_id, ts_ms, source, level, message, raw_json"


def _rows(df):
    return as_ms(df, ts_ms="timestamp").select(*LOG.split(", "))


@entry("C01_text_match", f"SELECT {LOG} FROM logs WHERE contains(lower(message), 'item 5') OR contains(lower(raw_json), 'item 5')")
def _(spark, sf):
    return _rows(V.logs(spark, sf).where(S.text_match("ITEM 5")))


@entry("C02_field_match_column", f"SELECT {LOG} FROM logs WHERE source = 'svc-3' AND level = 'ERROR'")
def _(spark, sf):
    return _rows(V.logs(spark, sf).where(S.all_of(S.field_match("source", "svc-3"), S.field_match("level", "ERROR"))))


@entry("C03_field_match_json", f"SELECT {LOG} FROM logs WHERE coalesce(json_extract_string(raw_json, '$.k'), '') = '42' OR coalesce(json_extract_string(raw_json, '$.absent'), '') = 'x'")
def _(spark, sf):
    return _rows(V.logs(spark, sf).where(S.any_of(S.field_match("k", "42"), S.field_match("absent", "x"))))


_TEXT = "(contains(lower(message), '{0}') OR contains(lower(raw_json), '{0}'))"


@entry("C04_log_search", f"""SELECT {LOG} FROM logs
    WHERE (((level = 'ERROR' OR source = 'svc-1') AND {_TEXT.format('user 1')}) OR json_extract_string(raw_json, '$.action') = 'view') AND {_TEXT.format('item 7')}""")
def _(spark, sf):
    # left-associative: (((ERROR or svc-1) and "user 1") or action:view) and "item 7"; the last OR dangles
    return _rows(C.log_search(V.logs(spark, sf), 'level:ERROR OR source:svc-1 "user 1" OR action:view AND AND "item 7" OR'))


@entry("C05_log_search_loose", f"SELECT {LOG} FROM logs WHERE lower(level) = 'error' AND (contains(lower(message || ' ' || raw_json || ' ' || source || ' ' || level), 'svc-2'))")
def _(spark, sf):
    return _rows(C.log_search(V.logs(spark, sf), "level:Error SVC-2", mode="loose"))


_FROM, _TO = NOW - 20 * 86_400_000, NOW - 10 * 86_400_000


@entry("C06_time_between", f"SELECT {LOG} FROM logs WHERE ts_ms BETWEEN {_FROM} AND {_TO}")
def _(spark, sf):
    return _rows(C.time_between(V.logs(spark, sf), _FROM, _TO))


@entry("C07_tenant_scope", f"SELECT coalesce(t, '-') AS tenant_id, ts_ms, source, level, message, raw_json FROM (SELECT *, CASE WHEN level = 'DEBUG' THEN NULL ELSE tenant_id END AS t FROM logs) WHERE t = '1' OR t IS NULL")
def _(spark, sf):
    legacy = V.logs(spark, sf).withColumn("tenant_id", F.when(F.col("level") != "DEBUG", F.col("tenant_id")))
    return _rows(C.tenant_scope(legacy, "1", allow_null=True).withColumn("tenant_id", F.coalesce("tenant_id", F.lit("-"))))


@entry("C08_log_query", f"""
    SELECT ts_ms, source, level, message, raw_json, json_extract_string(raw_json, '$.k') AS k FROM logs
    WHERE tenant_id = '1' AND level = 'ERROR' AND ts_ms BETWEEN {_FROM} AND {_TO} ORDER BY ts_ms DESC, source, message, raw_json LIMIT 50""")
def _(spark, sf):
    return as_ms(C.log_query(V.logs(spark, sf), "level:ERROR", "1", _FROM, _TO, 50, ("k",)), ts_ms="timestamp")


def users(spark, sf):
    n, region = F.col("n_nationkey"), F.col("n_regionkey")
    return V.table(spark, sf, "nation").select(
        n.alias("id"), (n % 3).cast("string").alias("tenant_id"), F.when(region == 0, "ADMIN").when(region == 1, "VIEWER").otherwise("ANALYST").alias("role"),
        F.when(region == 2, "Operations").when(region == 3, "Security").otherwise("Engineering").alias("department"),
        F.when(n % 4 == 0, F.array(F.lit("*"))).when(n % 4 == 1, F.array(F.lit("prod"))).when(n % 4 == 2, F.array(F.lit("dev"), F.lit("qa"))).alias("environment_access"))


def placed_incidents(spark, sf):
    i = V.incidents(spark, sf)
    return i.withColumn("domain", F.when(F.col("id") % 2 == 0, F.concat(F.lit("db.PROD."), F.col("domain"))).otherwise(F.col("domain"))).withColumn(
        "tenant_id", F.when(F.col("id") % 13 != 0, F.col("tenant_id")))


_ABAC = """
    WITH u AS (SELECT n_nationkey AS id, CAST(n_nationkey % 3 AS VARCHAR) AS tenant_id, CASE n_regionkey WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'VIEWER' ELSE 'ANALYST' END AS role,
        CASE n_regionkey WHEN 2 THEN 'Operations' WHEN 3 THEN 'Security' ELSE 'Engineering' END AS department,
        CASE n_nationkey % 4 WHEN 0 THEN ['*'] WHEN 1 THEN ['prod'] WHEN 2 THEN ['dev', 'qa'] END AS envs FROM nation),
    r AS (SELECT id, CASE WHEN id % 13 <> 0 THEN tenant_id END AS tenant_id, CASE WHEN id % 2 = 0 AND domain IS NOT NULL THEN 'prod' ELSE 'dev' END AS env, impact_score > 0.8 AS pii FROM incidents)
    SELECT u.id AS user_id, count(*) AS visible, CAST(sum(r.id) AS BIGINT) AS id_sum FROM r JOIN u ON r.tenant_id IS NULL OR r.tenant_id = u.tenant_id
    WHERE u.role = 'ADMIN' OR (coalesce(list_contains(u.envs, '*') OR list_contains(u.envs, r.env), false) AND {rule}) GROUP BY 1"""


@entry("C09_abac_filter_read", _ABAC.format(rule="NOT (r.pii AND u.role = 'VIEWER')"))
def _(spark, sf):
    seen = C.abac_filter(placed_incidents(spark, sf), users(spark, sf), "read", "incident", pii_above=0.8)
    return seen.groupBy("user_id").agg(F.count("*").alias("visible"), F.sum("id").alias("id_sum"))


@entry("C09_abac_filter_write", _ABAC.format(rule="u.department IN ('Operations', 'Security')"))
def _(spark, sf):
    seen = C.abac_filter(placed_incidents(spark, sf), users(spark, sf), "write", "incident", pii_above=0.8)
    return seen.groupBy("user_id").agg(F.count("*").alias("visible"), F.sum("id").alias("id_sum"))


@entry("C10_trace_search", "SELECT trace_id, error_count, span_count FROM traces WHERE contains(lower(root_service), 'svc-4') AND error_count > 0 AND (contains(trace_id, '1') OR contains(root_service, '1') OR contains(lower(root_operation), '1'))")
def _(spark, sf):
    return C.trace_search(trace_summary(V.spans(spark, sf)), "Service:SVC-4 status:error 1").select("trace_id", "error_count", "span_count")


@entry("C11_incident_search", "SELECT id, title FROM incidents WHERE domain = '2-HIGH' AND status = 'OPEN' AND (contains(lower(title), '_12') OR contains(lower(domain), '_12') OR contains(lower(summary), '_12') OR contains('inc_' || id, '_12'))")
def _(spark, sf):
    return C.incident_search(V.incidents(spark, sf), "2-HIGH", "OPEN", "_12").select("id", "title")


@entry("C12_resolve_window", f"SELECT id, created_ms FROM incidents WHERE created_ms >= {V.ORDERS_NOW_MS} - 99 * 7 * CAST(86400000 AS BIGINT)")
def _(spark, sf):
    return as_ms(C.resolve_window(V.incidents(spark, sf), "-99w", V.ORDERS_NOW_MS), created_ms="created_at").select("id", "created_ms")


@entry("C13_alert_history", """
    SELECT id, priority, source, ts_ms, (SELECT count(*) FROM alerts WHERE priority = 'P1') AS total FROM alerts WHERE priority = 'P1' ORDER BY ts_ms DESC, id LIMIT 20 OFFSET 40""")
def _(spark, sf):
    a = alerts(spark, sf).withColumn("timestamp", at_ms(F.col("ts_ms"))).withColumn("status", F.lit("fired"))
    return C.alert_history(a, priority="P1", skip=40, limit=20).select("id", "priority", "source", "ts_ms", "total")


@entry("C14_audit_history", """
    SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus AS action, epoch_ms(o_orderdate) AS ts_ms, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total
    FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 10""")
def _(spark, sf):
    audit = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("action"), at_ms(V.ntz_ms(F.col("o_orderdate"))).alias("timestamp"))
    return as_ms(C.audit_history(audit, action="O", skip=10, limit=25), ts_ms="timestamp")


@entry("C15_recent_deployments", "SELECT event_id AS id, service, ts_ms FROM ev WHERE event_type = 'signup' AND user_id % 3 = 2 ORDER BY ts_ms DESC, event_id LIMIT 100")
def _(spark, sf):
    marks = V.events(spark, sf).where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 3).cast("string").alias("tenant_id"), "service", at_ms(F.col("ts_ms")).alias("timestamp"))
    return as_ms(C.recent_deployments(marks, "2"), ts_ms="timestamp").select("id", "service", "ts_ms")


@entry("C16_active_monitors", f"""
    SELECT o_orderkey AS id, coalesce(CASE WHEN epoch_ms(o_orderdate) > {V.ORDERS_NOW_MS} - 300 * CAST(86400000 AS BIGINT) THEN epoch_ms(o_orderdate) END, -1) AS muted_ms,
           o_orderkey % 3 <> 0 AND epoch_ms(o_orderdate) <= {V.ORDERS_NOW_MS} - 300 * CAST(86400000 AS BIGINT) AS active FROM orders""")
def _(spark, sf):
    monitors = V.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 != 0).alias("enabled"), at_ms(V.ntz_ms(F.col("o_orderdate"))).alias("muted_until"))
    shown = C.active_monitors(monitors, V.ORDERS_NOW_MS - 300 * 86_400_000)
    return as_ms(shown, muted_ms="muted_until").select("id", F.coalesce("muted_ms", F.lit(-1)).alias("muted_ms"), "active")
