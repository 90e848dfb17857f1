"""E: group-bys. F: dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import as_ms, entry, slos
from catalog.ingest import SQL_ANNOTATED, annotated
from catalog.text import sql_mask
from logspark import views as V
from logspark.functions.text import normalise
from logspark.functions.timing import at_ms
from logspark.operators import aggregate as E, dashboard as D, slo as J
from logspark.session import cut_lineage

NOW, ONOW = V.EVENTS_NOW_MS, V.ORDERS_NOW_MS


@entry("E01_pattern_counts", f"SELECT {sql_mask('message')} AS pattern, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def _(spark, sf):
    return E.pattern_counts(V.logs(spark, sf), 4)


@entry("E02_facets", """
    WITH f AS (SELECT 'source' AS facet, source AS value, count(*) AS count FROM logs GROUP BY 2 UNION ALL SELECT 'level', level, count(*) FROM logs GROUP BY 2)
    SELECT facet, value, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS rank FROM f) WHERE rank <= 5""")
def _(spark, sf):
    return E.facets(V.logs(spark, sf), 5).withColumn("rank", F.col("rank").cast("long"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE level = '{name}') AS \"{name}\"" for name in E.LEVELS)


@entry("E03_histogram", f"SELECT ts_ms - ts_ms % 3600000 AS bucket_ms, count(*) AS count, {_COUNTS} FROM logs WHERE level = 'ERROR' OR level = 'WARN' GROUP BY 1")
def _(spark, sf):
    return E.histogram(V.logs(spark, sf), "level:ERROR OR level:WARN")


@entry("E03_histogram_ranged", f"SELECT ts_ms - ts_ms % 900000 AS bucket_ms, count(*) AS count, {_COUNTS} FROM logs WHERE ts_ms BETWEEN {NOW - 4 * 86_400_000} AND {NOW - 3 * 86_400_000} GROUP BY 1")
def _(spark, sf):
    return E.histogram(V.logs(spark, sf), "", NOW - 4 * 86_400_000, NOW - 3 * 86_400_000)


def normalised(spark, sf):
    d = V.documents(spark, sf)
    return d.select(F.col("text").alias("raw_text"), normalise(F.col("text")).alias("normalized_text"), "source", F.col("doc_id").alias("line_number"),
                    at_ms(F.col("doc_id") * 1000).alias("timestamp"))


@entry("E04_dedupe_templates", "SELECT coalesce(nullif(template, ''), text) AS template, count(*) AS n FROM norm GROUP BY 1")
def _(spark, sf):
    return E.dedupe_templates(normalised(spark, sf))


@entry("E05_template_samples", """
    SELECT template, doc_id AS line_number, sample FROM (SELECT template, doc_id, row_number() OVER (PARTITION BY template ORDER BY doc_id) AS sample FROM norm) WHERE sample <= 3""")
def _(spark, sf):
    s = E.template_samples(normalised(spark, sf), 3, order=("line_number",))
    return s.select("template", "line_number", F.col("sample").cast("long").alias("sample"))


@entry("E06_first_seen", "SELECT template, arg_min(text, doc_id) AS raw_text, arg_min(source, doc_id) AS source, min(doc_id) AS line_number, min(doc_id) * 1000 AS ts_ms FROM norm GROUP BY template")
def _(spark, sf):
    return as_ms(E.first_seen(normalised(spark, sf), order=("line_number",)), ts_ms="timestamp")


@entry("E07_run_summary", """
    SELECT count(*) AS raw_lines, count(DISTINCT template) AS templates, count(DISTINCT length(template) % 50) AS clusters,
           1.0::DOUBLE - count(DISTINCT length(template) % 50) / count(*) AS reduction_ratio FROM norm""")
def _(spark, sf):
    t = cut_lineage(E.dedupe_templates(normalised(spark, sf)))
    return E.run_summary(t, t.select((F.length("template") % 50).alias("cluster_id")).distinct()).withColumn("reduction_ratio", F.col("reduction_ratio").cast("double"))


@entry("E08_trace_summary", f"SELECT trace_id, root_service, root_operation, start_ms, end_ms, span_count, error_count, duration_ms FROM traces ORDER BY start_ms DESC, trace_id LIMIT 500")
def _(spark, sf):
    return as_ms(E.trace_summary(V.spans(spark, sf), limit=500), start_ms="start_time", end_ms="end_time")


@entry("E09_trace_detail", """
    SELECT s.trace_id, s.span_id, s.start_ms, s.duration_ms, t.root_service, t.root_operation, t.duration_ms AS trace_duration_ms, t.span_count, t.error_count
    FROM spans s JOIN traces t ON t.trace_id = s.trace_id WHERE s.trace_id = 't17'""")
def _(spark, sf):
    return as_ms(E.trace_detail(V.spans(spark, sf), "t17"), start_ms="start_time").select(
        "trace_id", "span_id", "start_ms", "duration_ms", "root_service", "root_operation", "trace_duration_ms", "span_count", "error_count")


@entry("E10_trace_latency_distribution", """
    WITH b AS (SELECT * FROM (VALUES (0, '0-50ms', 0, 50), (1, '50-200ms', 50, 200), (2, '200-500ms', 200, 500), (3, '500-1s', 500, 1000), (4, '>1s', 1000, 1e18)) AS b(ord, bucket, lo, hi))
    SELECT ord, bucket, count(d) AS count FROM b LEFT JOIN (SELECT duration_ms / 4000 AS d FROM traces) ON d >= lo AND d < hi GROUP BY 1, 2""")
def _(spark, sf):
    t = E.trace_summary(V.spans(spark, sf)).withColumn("duration_ms", F.col("duration_ms") / 4000)
    return E.trace_latency_distribution(t)


_WINDOWED = f"""
    SELECT s.id, s.target_percentage, l.ts_ms, CASE s.sli_type WHEN 'availability' THEN lower(level) NOT IN ('error', 'fatal', 'critical')
        WHEN 'latency' THEN CAST(json_extract_string(raw_json, '$.duration_ms') AS DOUBLE) < 500 ELSE true END AS good
    FROM slos s JOIN logs l ON l.source = s.service AND l.ts_ms >= {NOW} - s.window_days * CAST(86400000 AS BIGINT)"""
_STATUS = f"""
    WITH w AS ({_WINDOWED}), c AS (SELECT s.id, s.target_percentage, count(w.id) AS total_events, count(*) FILTER (WHERE w.good) AS good_events FROM slos s LEFT JOIN w ON w.id = s.id GROUP BY 1, 2),
    b AS (SELECT *, CAST(trunc(total_events * ((100.0::DOUBLE - target_percentage) / 100.0::DOUBLE)) AS BIGINT) AS error_budget_total, total_events - good_events AS failures FROM c),
    status AS (SELECT id, total_events, good_events, error_budget_total, error_budget_total - failures AS error_budget_remaining,
        CASE WHEN error_budget_total = 0 THEN 0.0::DOUBLE ELSE failures / error_budget_total END AS burn_rate,
        CASE WHEN total_events = 0 THEN 100.0::DOUBLE ELSE good_events / total_events * 100 END AS current_value,
        CASE WHEN total_events = 0 THEN 'HEALTHY' WHEN error_budget_total - failures < 0 THEN 'BREACHED'
             WHEN error_budget_total > 0 AND failures / error_budget_total > 0.8 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM b)"""
_STATUS_COLS = "id, total_events, good_events, error_budget_total, error_budget_remaining, burn_rate, current_value, status"


@entry("E11_slo_status", f"{_STATUS} SELECT {_STATUS_COLS} FROM status")
def _(spark, sf):
    return J.slo_status(V.logs(spark, sf), slos(spark, sf), NOW).select(*_STATUS_COLS.split(", "))


@entry("E12_slo_daily", f"WITH w AS ({_WINDOWED}) SELECT id AS slo_id, ts_ms // 86400000 * 86400000 AS day_ms, count(*) FILTER (WHERE good) / count(*) * 100 AS value FROM w GROUP BY 1, 2")
def _(spark, sf):
    return J.slo_daily(V.logs(spark, sf), slos(spark, sf), NOW)


@entry("E13_slo_data_point", f"{_STATUS} SELECT id AS slo_id, CAST({NOW} AS BIGINT) AS ts_ms, good_events, total_events, current_value AS value FROM status")
def _(spark, sf):
    return as_ms(J.slo_data_point(V.logs(spark, sf), slos(spark, sf), NOW), ts_ms="timestamp")


RULES = [
    {"id": 1, "query": "level:ERROR", "aggregation": "count", "window_seconds": 3600},
    {"id": 2, "query": "action:view OR action:click", "aggregation": "sum", "field": "duration_ms", "window_seconds": 86400},
    {"id": 3, "query": "source:svc-3", "aggregation": "max", "field": "k", "window_seconds": 7200, "tenant_id": "1"},
    {"id": 4, "query": '"item 9"', "aggregation": "avg", "field": "duration_ms", "window_seconds": 86400},
    {"id": 5, "query": "level:DEBUG", "aggregation": "min", "field": "k", "window_seconds": 86400, "enabled": True},
    {"id": 6, "query": "level:WARN", "enabled": False},
]
SQL_METRICS = """
    SELECT 1 AS rule_id, ts_ms - ts_ms % 3600000 AS bucket_ms, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE level = 'ERROR' GROUP BY 2
    UNION ALL SELECT 2, ts_ms - ts_ms % 86400000, CAST(sum(CAST(json_extract_string(raw_json, '$.duration_ms') AS BIGINT)) AS DOUBLE) FROM logs WHERE json_extract_string(raw_json, '$.action') IN ('view', 'click') GROUP BY 2
    UNION ALL SELECT 3, ts_ms - ts_ms % 7200000, CAST(max(CAST(json_extract_string(raw_json, '$.k') AS BIGINT)) AS DOUBLE) FROM logs WHERE source = 'svc-3' AND tenant_id = '1' GROUP BY 2
    UNION ALL SELECT 4, ts_ms - ts_ms % 86400000, CAST(sum(CAST(json_extract_string(raw_json, '$.duration_ms') AS BIGINT)) AS DOUBLE) / count(*) FROM logs WHERE contains(message, 'item 9') GROUP BY 2
    UNION ALL SELECT 5, ts_ms - ts_ms % 86400000, CAST(min(CAST(json_extract_string(raw_json, '$.k') AS BIGINT)) AS DOUBLE) FROM logs WHERE level = 'DEBUG' GROUP BY 2"""


@entry("E14_extract_metrics", SQL_METRICS)
def _(spark, sf):
    return E.extract_metrics(V.logs(spark, sf), RULES)


@entry("E15_metric_series", f"SELECT bucket_ms, value FROM ({SQL_METRICS}) WHERE rule_id = 2")
def _(spark, sf):
    return E.metric_series(E.extract_metrics(V.logs(spark, sf), RULES), 2).select("bucket_ms", "value")


@entry("E16_run_history", """
    SELECT r.id, r.created_ms, i.incident_id, i.incident_title, i.incident_status FROM (SELECT * FROM runs ORDER BY created_ms DESC, id LIMIT 200) r
    LEFT JOIN (SELECT run_id, min(id) AS incident_id, arg_min(title, id) AS incident_title, arg_min(status, id) AS incident_status FROM incidents GROUP BY run_id) i ON i.run_id = r.id""")
def _(spark, sf):
    return as_ms(E.run_history(V.runs(spark, sf), V.incidents(spark, sf), 200), created_ms="created_at").select(
        "id", "created_ms", "incident_id", "incident_title", "incident_status")


@entry("E17_run_stats", "SELECT count(*) AS run_count, CAST(sum(raw_lines) AS BIGINT) AS total_lines, round(avg(reduction_ratio), 6) AS avg_reduction, round(avg(duration_sec), 6) AS avg_duration FROM runs")
def _(spark, sf):
    r = E.run_stats(V.runs(spark, sf))
    return r.select("run_count", "total_lines", F.round("avg_reduction", 6).alias("avg_reduction"), F.round("avg_duration", 6).alias("avg_duration"))


def clustered_documents(spark, sf):
    """Documents with a cluster id from the template length (-1 = lengths divisible by 40)."""
    cluster = F.when(F.length("normalized_text") % 40 == 0, -1).otherwise(F.length("normalized_text") % 40)
    # the templates are read several times by what follows: normalise once
    return cut_lineage(normalised(spark, sf).withColumn("cluster_id", cluster.cast("int")))


def clusters_of(spark, sf):
    """Clusters and members of the documents."""
    n = clustered_documents(spark, sf)
    members = n.groupBy("cluster_id", F.col("normalized_text").alias("template")).agg(F.count("*").alias("n"))
    first = F.min_by(F.struct("normalized_text", "raw_text", "source", "line_number"), "line_number")
    clusters = n.groupBy("cluster_id").agg(F.count("*").alias("size"), first.alias("f"), F.countDistinct("normalized_text").alias("templates")).select(
        "cluster_id", "size", F.col("f.normalized_text").alias("representative_template"), F.col("f.raw_text").alias("representative_raw"),
        F.col("f.source").alias("representative_source"), F.col("f.line_number").alias("representative_line"))
    return clusters, members


SQL_CLUSTERS = """cl AS (SELECT cluster_id, count(*) AS size, arg_min(template, doc_id) AS representative_template, arg_min(text, doc_id) AS representative_raw,
        arg_min(source, doc_id) AS representative_source, min(doc_id) AS representative_line
    FROM (SELECT *, CAST(CASE WHEN length(template) % 40 = 0 THEN -1 ELSE length(template) % 40 END AS INTEGER) AS cluster_id FROM norm) GROUP BY cluster_id)"""


def anomalies_of(members):
    """Distances from the template length, labels from the general thresholds."""
    from logspark.operators.vectors import classify_distance

    d = (F.length("template") % 97) / F.lit(96.0)
    return members.where(F.length("template") % 3 != 0).select("template").distinct().select("template", d.alias("distance"), classify_distance(d).alias("label"))


SQL_ANOMALIES = """an AS (SELECT template, distance, CASE WHEN distance >= 0.85 THEN 'high_risk_anomaly' WHEN distance >= 0.70 THEN 'new_pattern' WHEN distance >= 0.55 THEN 'rare_known' ELSE 'known' END AS label
    FROM (SELECT DISTINCT template, (length(template) % 97) / 96.0::DOUBLE AS distance FROM norm WHERE length(template) % 3 <> 0))"""


@entry("E18_noise_volume", f"WITH {SQL_CLUSTERS} SELECT CAST(coalesce(sum(size) FILTER (WHERE cluster_id = -1), 0) AS BIGINT) AS noise_lines FROM cl")
def _(spark, sf):
    return E.noise_volume(clusters_of(spark, sf)[0])


@entry("E19_severity_counts", """
    SELECT p AS priority, count(i.id) AS clusters FROM (VALUES ('P0'), ('P1'), ('P2'), ('P3')) AS v(p) LEFT JOIN incidents i ON i.severity = p GROUP BY 1""")
def _(spark, sf):
    return E.severity_counts(V.incidents(spark, sf).withColumnRenamed("severity", "priority"))


@entry("E20_baseline_inspect", f"SELECT count(*) AS clusters, count(label) AS labelled, count(*) FILTER (WHERE is_acknowledged) AS acknowledged, CAST(sum(size) AS BIGINT) AS logs_processed FROM ({SQL_ANNOTATED})")
def _(spark, sf):
    return E.baseline_inspect(annotated(spark, sf))


@entry("E21_baseline_explain", f"SELECT cluster_id, size, representative_template, label, is_acknowledged FROM ({SQL_ANNOTATED}) WHERE cluster_id = 3")
def _(spark, sf):
    return E.baseline_explain(annotated(spark, sf), 3).select("cluster_id", "size", "representative_template", "label", "is_acknowledged")


@entry("E22_cluster_report", f"""
    WITH {SQL_CLUSTERS}, {SQL_ANOMALIES}, top AS (SELECT * FROM cl ORDER BY size DESC, cluster_id LIMIT 10),
    m AS (SELECT DISTINCT CAST(CASE WHEN length(template) % 40 = 0 THEN -1 ELSE length(template) % 40 END AS INTEGER) AS cluster_id, template FROM norm),
    w AS (SELECT cluster_id, max(distance) AS worst_distance, arg_max(label, distance) AS label FROM m JOIN an USING (template) GROUP BY 1)
    SELECT CASE WHEN cluster_id = -1 THEN 'NOISE' ELSE CAST(cluster_id AS VARCHAR) END AS cluster, size,
           coalesce(label, CASE WHEN cluster_id = -1 THEN 'OUTLIER' ELSE '-' END) AS label, worst_distance, representative_source || ':' || representative_line AS location,
           t AS text
    FROM (SELECT *, replace(representative_raw, chr(10), ' ') AS t FROM top LEFT JOIN w USING (cluster_id))""")
def _(spark, sf):
    clusters, members = clusters_of(spark, sf)
    return E.cluster_report(clusters, members, anomalies_of(members), 10)


@entry("E23_anomaly_gate", f"WITH {SQL_ANOMALIES} SELECT max(CASE label WHEN 'known' THEN 0 WHEN 'rare_known' THEN 1 WHEN 'new_pattern' THEN 2 ELSE 3 END) AS worst_rank, arg_max(label, distance) AS worst_label, count(*) FILTER (WHERE label = 'high_risk_anomaly' OR label = 'new_pattern') > 0 AS failed FROM an")
def _(spark, sf):
    return E.anomaly_gate(anomalies_of(clusters_of(spark, sf)[1]), "new_pattern")


# --- F ----------------------------------------------------------------------------------------------


@entry("F01_metric_cards", """
    SELECT count(*) FILTER (WHERE status = 'OPEN') AS open_incidents, count(*) AS total_incidents, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved_incidents,
           round(avg(impact_score), 6) AS avg_impact, (SELECT count(*) FROM slos) AS slos_tracked, (SELECT count(*) FROM runs) AS runs_total,
           (SELECT cluster_count FROM runs ORDER BY created_ms DESC, id DESC LIMIT 1) AS clusters_last_run FROM incidents""")
def _(spark, sf):
    cards = D.metric_cards(V.incidents(spark, sf), slos(spark, sf), V.runs(spark, sf))
    return cards.withColumn("avg_impact", F.round("avg_impact", 6))


@entry("F02_incidents_per_day", f"""
    WITH d AS (SELECT unnest(generate_series({ONOW // 86_400_000 - 200}, {ONOW // 86_400_000})) AS day)
    SELECT day * 86400000 AS day_ms, count(i.id) AS incidents FROM d LEFT JOIN incidents i ON i.created_ms // 86400000 = day AND i.created_ms >= {ONOW - 200 * 86_400_000} GROUP BY 1""")
def _(spark, sf):
    return D.incidents_per_day(V.incidents(spark, sf), ONOW, ONOW - 200 * 86_400_000)


@entry("F03_incidents_by_domain", "SELECT coalesce(domain, 'unknown') AS label, count(*) AS incidents FROM incidents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(spark, sf):
    return D.incidents_by_domain(V.incidents(spark, sf))


@entry("F04_resolved_gauge", "SELECT count(*) FILTER (WHERE status = 'RESOLVED') AS resolved, count(*) AS total, count(*) FILTER (WHERE status = 'RESOLVED') / count(*) AS ratio FROM incidents")
def _(spark, sf):
    return D.resolved_gauge(V.incidents(spark, sf))


@entry("F05_incident_heatmap", f"""
    WITH c AS (SELECT isodow(to_timestamp(created_ms / 1000) AT TIME ZONE 'UTC') - 1 AS day, created_ms % 86400000 // 3600000 AS hour, count(*) AS incidents
        FROM incidents WHERE created_ms >= {ONOW - 365 * 86_400_000} GROUP BY 1, 2)
    SELECT CAST(day AS BIGINT) AS day, CAST(hour AS BIGINT) AS hour, incidents, (SELECT max(incidents) FROM c) AS max_cell FROM c""")
def _(spark, sf):
    return D.incident_heatmap(V.incidents(spark, sf), ONOW, 365)


@entry("F06_incident_pie_severity", """
    SELECT CASE WHEN impact_score >= 0.8 THEN 'Critical' WHEN impact_score >= 0.6 THEN 'High' WHEN impact_score >= 0.3 THEN 'Medium' ELSE 'Low' END AS label, count(*) AS incidents FROM incidents GROUP BY 1""")
def _(spark, sf):
    return D.incident_pie(V.incidents(spark, sf))


@entry("F06_incident_pie_status", "SELECT CASE status WHEN 'OPEN' THEN 'Open' ELSE 'Resolved' END AS label, count(*) AS incidents FROM incidents GROUP BY 1")
def _(spark, sf):
    return D.incident_pie(V.incidents(spark, sf), "status")


@entry("F06_incident_pie_domain", "SELECT coalesce(domain, 'unknown') AS label, count(*) AS incidents FROM incidents GROUP BY 1")
def _(spark, sf):
    return D.incident_pie(V.incidents(spark, sf), "domain")


@entry("F07_incident_feed", "SELECT id, title, status, domain, impact_score, created_ms FROM incidents ORDER BY created_ms DESC, id LIMIT 12")
def _(spark, sf):
    return as_ms(D.incident_feed(V.incidents(spark, sf)), created_ms="created_at")


_TAIL = "SELECT timestamp, cpu_percent AS cpu, memory_percent AS mem, disk_iops AS disk, network_drops AS net FROM telemetry ORDER BY timestamp DESC, network_errors DESC LIMIT {}"


@entry("F08_vitals_tail", _TAIL.format(500))
def _(spark, sf):
    return D.vitals_tail(V.telemetry(spark, sf), 500)


@entry("F09_vitals_drift", f"""
    WITH t AS ({_TAIL.format(60)}), m AS (UNPIVOT t ON cpu, mem, disk, net INTO NAME metric VALUE v),
    a AS (SELECT metric, arg_max(v, timestamp) AS current, avg(v) AS average FROM m GROUP BY metric)
    SELECT metric, current, average, coalesce((current - average) / nullif(average, 0) * 100, 0) AS pct, abs(coalesce((current - average) / nullif(average, 0) * 100, 0)) < 1 AS flat FROM a""")
def _(spark, sf):
    return D.vitals_drift(V.telemetry(spark, sf), 60)


@entry("F10_vitals_breaches", "SELECT timestamp, greatest(cpu_percent, memory_percent) / 100 AS anomaly FROM telemetry WHERE cpu_percent > 85 OR memory_percent > 90")
def _(spark, sf):
    return D.vitals_breaches(V.telemetry(spark, sf))


def service_links(spark, sf):
    """Customer nation -> order priority links as a service graph."""
    o = V.table(spark, sf, "orders")
    return o.groupBy((F.col("o_custkey") % 20).alias("a"), F.col("o_orderpriority").alias("target_service")).agg(
        F.count("*").alias("occurrences"), F.sum(F.col("o_orderkey") % 100).alias("s")).select(
        F.concat(F.lit("svc-"), F.col("a").cast("string")).alias("source_service"), "target_service", "occurrences",
        (F.col("s") / F.col("occurrences") / 100).alias("confidence"), (F.col("s") / F.col("occurrences")).alias("avg_delay_ms"))


SQL_LINKS = """lk AS (SELECT 'svc-' || (o_custkey % 20) AS source_service, o_orderpriority AS target_service, count(*) AS occurrences,
    CAST(sum(o_orderkey % 100) AS BIGINT) / count(*) / 100 AS confidence, CAST(sum(o_orderkey % 100) AS BIGINT) / count(*) AS avg_delay_ms FROM orders GROUP BY 1, 2)"""


@entry("F11_service_graph_edges", f"WITH {SQL_LINKS} SELECT source_service AS source, target_service AS target, confidence, avg_delay_ms, occurrences FROM lk WHERE confidence >= 0.495")
def _(spark, sf):
    return D.service_graph_edges(service_links(spark, sf), 0.495)


@entry("F11_service_graph_nodes", f"""
    WITH {SQL_LINKS} SELECT service, count(*) + 1 AS clusters, CAST(least(40, greatest(20, 20 + (count(*) + 1) * 1.5)) AS DOUBLE) AS size
    FROM (SELECT source_service AS service FROM lk UNION ALL SELECT target_service FROM lk) GROUP BY 1""")
def _(spark, sf):
    return D.service_graph_nodes(service_links(spark, sf)).withColumn("size", F.col("size").cast("double"))


@entry("F12_slo_budget_percent", f"""{_STATUS} SELECT id, CASE WHEN error_budget_total = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, error_budget_remaining / error_budget_total * 100) END AS budget_percent FROM status""")
def _(spark, sf):
    return D.slo_budget_percent(J.slo_status(V.logs(spark, sf), slos(spark, sf), NOW)).select("id", "budget_percent")
