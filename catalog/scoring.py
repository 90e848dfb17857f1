"""J: severity, drift, incidents, objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import _WINDOWED, SQL_ANOMALIES, SQL_CLUSTERS, anomalies_of, clustered_documents, clusters_of, normalised
from catalog.base import alerts, as_ms, entry, slos
from catalog.relations import SQL_LINKS, SQL_MATCHED, cluster_names, snapshots
from catalog.text import quoted
from logspark import views as V
from logspark.functions import text as T
from logspark.functions.timing import at_ms
from logspark.session import cut_lineage
from logspark.operators import aggregate as E, drift as R, intervals as I, scoring as S, slo as J

NOW = V.EVENTS_NOW_MS


def document_links(spark, sf):
    """Clusters of documents linked to the sources their templates come from."""
    n = clustered_documents(spark, sf)
    return n.select(F.col("cluster_id").alias("source_cluster_id"), F.col("source").alias("target_service")).distinct()


@entry("J01_severity", f"""
    WITH {SQL_CLUSTERS}, {SQL_ANOMALIES},
    lk AS (SELECT cluster_id, count(DISTINCT source) AS services FROM (SELECT source, CASE WHEN length(template) % 40 = 0 THEN -1 ELSE length(template) % 40 END AS cluster_id FROM norm) GROUP BY 1),
    s AS (SELECT cl.cluster_id, regexp_matches(representative_template || ' ' || representative_raw, {quoted('(?i)' + T.P0_WORDS)}) AS p0, regexp_matches(representative_template || ' ' || representative_raw, {quoted('(?i)' + T.P1_WORDS)}) AS p1,
        0.35::DOUBLE * CASE WHEN distance IS NULL THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, distance + CASE label WHEN 'high_risk_anomaly' THEN 0.15::DOUBLE WHEN 'new_pattern' THEN 0.05::DOUBLE WHEN 'known' THEN -0.10::DOUBLE ELSE 0.0::DOUBLE END)) END AS anomaly,
        0.20::DOUBLE * least(1.0::DOUBLE, ln(1 + 100.0::DOUBLE * size / (SELECT sum(size) FROM cl)) / ln(101.0::DOUBLE)) AS volume,
        0.25::DOUBLE * least(1.0::DOUBLE, coalesce(services, 0) / greatest((SELECT count(*) FROM cl), 10)) AS causal, CASE WHEN cl.cluster_id = -1 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END AS noise
        FROM cl LEFT JOIN an ON template = representative_template LEFT JOIN lk ON lk.cluster_id = cl.cluster_id),
    c AS (SELECT *, CASE WHEN p0 THEN 0.10::DOUBLE WHEN p1 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS keyword FROM s),
    t AS (SELECT *, CASE WHEN p0 THEN greatest(0.8::DOUBLE, anomaly + volume + causal + noise + keyword) ELSE anomaly + volume + causal + noise + keyword END AS total FROM c)
    SELECT cluster_id, CASE WHEN total >= 0.8 THEN 'P0' WHEN total >= 0.55 THEN 'P1' WHEN total >= 0.3 THEN 'P2' ELSE 'P3' END AS priority, round(total, 4) AS composite_score, p0 AS keyword_flag, p1 AS p1_keyword_flag,
        cluster_id = -1 AS is_noise_cluster, round(anomaly, 4) AS anomaly, round(volume, 4) AS volume, round(causal, 4) AS causal FROM t""")
def _(spark, sf):
    clusters, members = clusters_of(spark, sf)
    out = S.severity(clusters, anomalies_of(members), document_links(spark, sf))
    return out.select("cluster_id", "priority", "composite_score", "keyword_flag", "p1_keyword_flag", "is_noise_cluster", "breakdown.anomaly", "breakdown.volume", "breakdown.causal")


_EVENTS_SQL = SQL_MATCHED + """,
    sa AS (SELECT * FROM snap WHERE run = 'a'), sb AS (SELECT * FROM snap WHERE run = 'b'),
    j AS (SELECT sa.ord AS ord_a, sb.ord AS ord_b, sa.priority AS pa, sb.priority AS pb, (sb.size - sa.size) / greatest(sa.size, 1) AS dv, sb.anomaly_score - sa.anomaly_score AS da
        FROM (SELECT sa.*, m.ord_b AS m FROM sa LEFT JOIN matched m ON m.ord_a = sa.ord) sa FULL JOIN sb ON sb.ord = sa.m),
    k AS (SELECT *, CASE WHEN ord_b IS NULL THEN 'resolved' WHEN ord_a IS NULL THEN 'emerged' WHEN pb < pa THEN 'escalated' WHEN pb > pa THEN 'de_escalated' WHEN dv >= 0.5 THEN 'volume_surge' WHEN dv <= -0.5 THEN 'volume_drop'
        WHEN da >= 0.15 THEN 'anomaly_spike' ELSE 'stable' END AS kind FROM j),
    drift AS (SELECT kind, ord_a, ord_b, coalesce(dv, 0) AS delta_volume, coalesce(da, 0) AS delta_anomaly, coalesce(pa, 'none') AS priority_before, CASE WHEN kind = 'resolved' THEN 'resolved' ELSE pb END AS priority_after,
        CASE WHEN kind = 'escalated' AND pb = 'P0' THEN 'CRITICAL' WHEN kind IN ('escalated', 'emerged') AND pb IN ('P0', 'P1') THEN 'HIGH' WHEN kind = 'anomaly_spike' THEN 'HIGH' WHEN kind IN ('volume_surge', 'escalated') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM k)"""


@entry("J02_drift_events", f"WITH RECURSIVE {_EVENTS_SQL} SELECT kind, ord_a, ord_b, round(delta_volume, 6) AS delta_volume, round(delta_anomaly, 6) AS delta_anomaly, priority_before, priority_after, severity FROM drift")
def _(spark, sf):
    a, b = snapshots(spark, sf)
    return R.drift_events(R.drift_pairs(a, b), a, b).select(
        "kind", "ord_a", "ord_b", F.round("delta_volume", 6).alias("delta_volume"), F.round("delta_anomaly", 6).alias("delta_anomaly"), "priority_before", "priority_after", "severity")


_HEALTH = "(SELECT avg((CAST(substr(priority, 2) AS INTEGER) / 3 + 1 - anomaly_score) / 2) FROM snap WHERE run = '{}')"


@entry("J03_health_score", f"SELECT 'a' AS run, round({_HEALTH.format('a')}, 6) AS health UNION ALL SELECT 'b', round({_HEALTH.format('b')}, 6)")
def _(spark, sf):
    a, b = (R.health_score(s).select(F.lit(run).alias("run"), F.round("health", 6).alias("health")) for run, s in zip("ab", snapshots(spark, sf)))
    return a.unionByName(b)


@entry("J04_drift_report", f"""
    WITH RECURSIVE {_EVENTS_SQL} SELECT {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in R.KIND_ORDER)}, count(*) FILTER (WHERE ord_a IS NOT NULL AND ord_b IS NOT NULL) AS matched_pairs,
        (SELECT count(*) FROM sa) AS total_clusters_a, (SELECT count(*) FROM sb) AS total_clusters_b, round({_HEALTH.format('b')} - {_HEALTH.format('a')}, 6) AS health_delta FROM drift""")
def _(spark, sf):
    a, b = snapshots(spark, sf)
    report = R.drift_report(R.drift_events(R.drift_pairs(a, b), a, b), a, b)
    return report.drop("run_a", "run_b", "summary").withColumn("health_delta", F.round("health_delta", 6))


@entry("J05_causal_narrative", f"""
    WITH {SQL_LINKS} SELECT source_cluster_id, target_cluster_id, printf('%s, then %s: %.1f ms later on average, confidence %.0f%%', a.service, b.service, avg_delay_ms, confidence * 100) AS narrative
    FROM links JOIN names a ON a.cluster_id = source_cluster_id JOIN names b ON b.cluster_id = target_cluster_id""")
def _(spark, sf):
    links = I.causal_links(V.cluster_events(spark, sf), cluster_names(spark, sf), 60_000)
    return S.causal_narrative(links).select("source_cluster_id", "target_cluster_id", "narrative")


@entry("J06_run_incident", """
    SELECT 'r1' AS run_id, CASE WHEN c > 1 THEN least(1.0::DOUBLE, c / 10) ELSE 0.3::DOUBLE END AS impact_score, n AS total_logs, c AS cluster_count,
        c || ' clusters in ' || n || ' lines' AS summary
    FROM (SELECT count(*) AS n, count(DISTINCT length(template) % 7) AS c FROM norm)""")
def _(spark, sf):
    t = cut_lineage(E.dedupe_templates(normalised(spark, sf)))
    summary = E.run_summary(t, t.select((F.length("template") % 7).alias("c")).distinct())
    return S.run_incident(summary, "r1").select("run_id", F.col("impact_score").cast("double").alias("impact_score"), "total_logs", "cluster_count", "summary")


def daily_points(spark, sf):
    """Daily good shares of every SLO as its data points."""
    d = J.slo_daily(V.logs(spark, sf), slos(spark, sf), NOW)
    return d.select("slo_id", at_ms(F.col("day_ms")).alias("timestamp"), "value")


SQL_POINTS = f"w AS ({_WINDOWED}), pt AS (SELECT id AS slo_id, ts_ms // 86400000 * 86400000 AS day_ms, count(*) FILTER (WHERE good) / count(*) * 100 AS value FROM w GROUP BY 1, 2)"


@entry("J07_slo_breach_incidents", f"""
    WITH {SQL_POINTS}, m AS (SELECT tenant_id, service, 'SLO Breach: ' || name AS title, day_ms, value < target_percentage AS bad FROM pt JOIN slos ON slos.id = pt.slo_id),
    p AS (SELECT *, coalesce(CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY tenant_id, service, title ORDER BY day_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS period FROM m)
    SELECT tenant_id, service, title, min(day_ms) FILTER (WHERE bad) AS created_ms, count(*) FILTER (WHERE bad) AS breaches, CASE WHEN count(*) FILTER (WHERE NOT bad) > 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, 1.0::DOUBLE AS impact_score
    FROM p GROUP BY tenant_id, service, title, period HAVING count(*) FILTER (WHERE bad) > 0""")
def _(spark, sf):
    points, objectives = daily_points(spark, sf), slos(spark, sf)
    fine = points.join(objectives.withColumnRenamed("id", "slo_id"), "slo_id").where(F.col("value") >= F.col("target_percentage")).select(
        "tenant_id", "service", F.concat(F.lit("SLO Breach: "), F.col("name")).alias("title"), F.unix_millis("timestamp").alias("ts_ms"))
    found = J.slo_breach_incidents(points, objectives, fine)
    return found.select("tenant_id", "service", "title", "created_ms", "breaches", "status", F.col("impact_score").cast("double").alias("impact_score"))


def series(spark, sf):
    """A data point per service and day: share of events that are no errors."""
    logs = V.logs(spark, sf)
    points = logs.groupBy(F.substring("source", 5, 2).cast("long").alias("slo_id"), F.floor(F.unix_millis("timestamp") / 86_400_000).alias("day")).agg(
        (F.count_if(F.col("level") != "ERROR") / F.count("*") * 100).alias("value"))
    return points.select("slo_id", at_ms(F.col("day") * 86_400_000).alias("timestamp"), "value")


SQL_FORECAST = """
    sp AS (SELECT CAST(substr(source, 5) AS BIGINT) AS slo_id, ts_ms // 86400000 AS day, count(*) FILTER (WHERE level <> 'ERROR') / count(*) * 100 AS value FROM logs GROUP BY 1, 2),
    rk AS (SELECT slo_id, value, row_number() OVER (PARTITION BY slo_id ORDER BY day) AS i, count(*) OVER (PARTITION BY slo_id) AS n FROM sp),
    fold AS (SELECT a.slo_id, CAST(1 AS BIGINT) AS i, a.value AS level, b.value - a.value AS trend FROM rk a JOIN rk b ON a.slo_id = b.slo_id AND a.i = 1 AND b.i = 2 AND a.n >= 10
        UNION ALL SELECT slo_id, i, level, 0.1::DOUBLE * (level - prev) + 0.9::DOUBLE * trend FROM (
            SELECT f.slo_id, r.i, f.level AS prev, f.trend, 0.5::DOUBLE * r.value + 0.5::DOUBLE * (f.level + f.trend) AS level FROM fold f JOIN rk r ON r.slo_id = f.slo_id AND r.i = f.i + 1)),
    fc AS (SELECT f.slo_id, s.tenant_id, s.name, s.service, f.level, f.trend, s.target_percentage AS target,
        (SELECT min(h) FROM generate_series(1, 240) g(h) WHERE f.level + h * f.trend < s.target_percentage) AS steps_to_breach
        FROM fold f JOIN rk r ON r.slo_id = f.slo_id AND r.i = f.i AND r.i = r.n JOIN slos s ON s.id = f.slo_id)"""


@entry("J08_slo_forecast", f"WITH RECURSIVE {SQL_FORECAST} SELECT s.id AS slo_id, round(level, 6) AS level, round(trend, 6) AS trend, steps_to_breach FROM slos s LEFT JOIN fc ON fc.slo_id = s.id WHERE s.id IN (SELECT slo_id FROM sp)")
def _(spark, sf):
    f = J.slo_forecast(series(spark, sf), slos(spark, sf), alphas=(0.5,), betas=(0.1,))
    return f.select("slo_id", F.round("level", 6).alias("level"), F.round("trend", 6).alias("trend"), "steps_to_breach")


@entry("J08_slo_forecast_fitted")
def _(spark, sf):
    return J.slo_forecast(series(spark, sf), slos(spark, sf))


@entry("J09_predictive_incidents", f"""
    WITH RECURSIVE {SQL_FORECAST} SELECT tenant_id, 'Predictive Warning: ' || name || ' will breach soon' AS title, service AS domain, steps_to_breach, {NOW} + steps_to_breach * 60000 AS due_ms
    FROM fc WHERE steps_to_breach IS NOT NULL AND slo_id % 3 <> 1""")
def _(spark, sf):
    objectives = slos(spark, sf)
    forecast = J.slo_forecast(series(spark, sf), objectives, alphas=(0.5,), betas=(0.1,))
    warned = objectives.select("tenant_id", J.predictive_title(F.col("name")).alias("title"), F.when(F.col("id") % 3 == 1, "OPEN").otherwise("RESOLVED").alias("status"))
    fresh = J.predictive_incidents(forecast, warned, NOW)
    return as_ms(fresh, due_ms="forecasted_depletion_time").select("tenant_id", "title", "domain", "steps_to_breach", "due_ms")


MONITORS = [
    {"id": 1, "name": "errors", "query": "level:ERROR", "threshold_critical": 1000, "threshold_warning": 100, "window_seconds": 20 * 86_400},
    {"id": 2, "name": "svc-3 views", "query": "source:svc-3 action:view", "threshold_critical": 100000, "threshold_warning": 5, "tenant_id": "1", "window_seconds": 7 * 86_400},
    {"id": 3, "name": "nothing", "query": '"no such text"', "threshold_critical": 1},
    {"id": 4, "name": "off", "query": "level:INFO", "enabled": False},
    {"id": 5, "name": "muted", "query": "level:INFO", "muted_until_ms": NOW + 1},
]


@entry("J10_evaluate_monitors", f"""
    SELECT 1 AS monitor_id, 'errors' AS name, n AS matches, CASE WHEN n >= 1000 THEN 'CRITICAL' WHEN n >= 100 THEN 'WARNING' ELSE 'OK' END AS state FROM (SELECT count(*) AS n FROM logs WHERE level = 'ERROR' AND ts_ms BETWEEN {NOW - 20 * 86_400_000} AND {NOW})
    UNION ALL SELECT 2, 'svc-3 views', n, CASE WHEN n >= 100000 THEN 'CRITICAL' WHEN n >= 5 THEN 'WARNING' ELSE 'OK' END FROM (SELECT count(*) AS n FROM logs WHERE source = 'svc-3' AND tenant_id = '1' AND json_extract_string(raw_json, '$.action') = 'view' AND ts_ms BETWEEN {NOW - 7 * 86_400_000} AND {NOW})
    UNION ALL SELECT 3, 'nothing', 0, 'OK'""")
def _(spark, sf):
    return J.evaluate_monitors(V.logs(spark, sf), MONITORS, NOW)


@entry("J11_p0_incidents", """
    SELECT run_id, '[P0] ' || min(cluster_summary) AS title, 'P0' AS severity, 'OPEN' AS status, min(cluster_summary) AS summary FROM (SELECT *, CAST(id % 70 AS VARCHAR) AS r FROM alerts) a(id, source, old, priority, cluster_id, cluster_summary, representative_log, anomaly_score, ts_ms, run_id)
    WHERE priority = 'P0' AND run_id NOT IN (SELECT run_id FROM incidents) GROUP BY run_id""")
def _(spark, sf):
    return S.p0_incidents(alerts(spark, sf).withColumn("run_id", (F.col("id") % 70).cast("string")), V.incidents(spark, sf))
