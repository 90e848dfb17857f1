"""G: joins. H: ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.aggregates import SQL_ANOMALIES, SQL_CLUSTERS, anomalies_of, clusters_of, normalised
from catalog.base import SQL_VIEWS, alerts, as_ms, entry
from logspark import views as V
from logspark.functions.text import text_key
from logspark.functions.timing import at_ms
from logspark.operators import aggregate as E, drift as R, intervals as I, relations as G, windows as H
from logspark.session import cut_lineage, numbered, stored

NOW = V.EVENTS_NOW_MS
WINDOW = 60_000

SQL_PAIRS = f"""pairs AS (
    SELECT a.cluster_id AS c1, b.cluster_id AS c2, a.service AS s1, b.service AS s2, a.ts_ms AS t1, b.ts_ms AS t2, b.ts_ms - a.ts_ms AS delay_ms
    FROM (SELECT *, ts_ms // {WINDOW} AS g FROM cluster_events) a
    JOIN (SELECT *, unnest([ts_ms // {WINDOW} - 1, ts_ms // {WINDOW}, ts_ms // {WINDOW} + 1]) AS g FROM cluster_events) b ON a.g = b.g
    WHERE a.cluster_id < b.cluster_id AND a.service <> b.service AND abs(b.ts_ms - a.ts_ms) <= {WINDOW})"""
SQL_LINKS = SQL_PAIRS + """, st AS (SELECT c1, c2, count(*) AS n, count(*) FILTER (WHERE delay_ms > 0) AS p, count(*) FILTER (WHERE delay_ms < 0) AS g, count(*) FILTER (WHERE delay_ms = 0) AS z,
        coalesce(CAST(sum(delay_ms) FILTER (WHERE delay_ms > 0) AS BIGINT), 0) AS pm, coalesce(CAST(-sum(delay_ms) FILTER (WHERE delay_ms < 0) AS BIGINT), 0) AS gm FROM pairs GROUP BY 1, 2),
    sc AS (SELECT CASE WHEN p >= g THEN c1 ELSE c2 END AS source_cluster_id, CASE WHEN p >= g THEN c2 ELSE c1 END AS target_cluster_id, n AS occurrences,
        (CASE WHEN p >= g THEN p ELSE g END + z) / n AS share, (CASE WHEN p >= g THEN pm ELSE gm END) / (CASE WHEN p >= g THEN p ELSE g END + z) AS delay FROM st WHERE n >= 2),
    links AS (SELECT source_cluster_id, target_cluster_id, occurrences, round(delay, 2) AS avg_delay_ms,
        round(exp(-0.008::DOUBLE * delay) * 0.4 + least(1.0, ln(occurrences + 1.0::DOUBLE) / ln(10.0::DOUBLE)) * 0.4 + share * 0.2, 3) AS confidence FROM sc)"""


def cluster_names(spark, sf):
    """First service (by time, then name) and template of every event cluster."""
    e = V.cluster_events(spark, sf)
    return e.groupBy("cluster_id").agg(F.min_by("service", F.struct("ts_ms", "service")).alias("service"), F.min("template").alias("template"))


SQL_VIEWS["names"] = (("cluster_events",), "SELECT cluster_id, arg_min(service, (ts_ms, service)) AS service, min(template) AS template FROM cluster_events GROUP BY cluster_id")


@entry("G01_cooccurrences", f"WITH {SQL_PAIRS} SELECT c1, c2, s1, s2, t1, t2, delay_ms, count(*) AS pairs FROM pairs GROUP BY ALL")
def _(spark, sf):
    return I.cooccurrences(V.cluster_events(spark, sf), WINDOW)


@entry("G02_causal_links", f"""
    WITH {SQL_LINKS} SELECT source_cluster_id, target_cluster_id, occurrences, avg_delay_ms, confidence, 'Cluster ' || source_cluster_id || ' -> Cluster ' || target_cluster_id AS direction,
        a.service AS source_service, b.service AS target_service, a.template AS source_template, b.template AS target_template
    FROM links JOIN names a ON a.cluster_id = source_cluster_id JOIN names b ON b.cluster_id = target_cluster_id""")
def _(spark, sf):
    return I.causal_links(V.cluster_events(spark, sf), cluster_names(spark, sf), WINDOW)


@entry("G03_blast_radius", f"WITH {SQL_LINKS} SELECT source_cluster_id AS cluster_id, count(DISTINCT b.service) AS services FROM links JOIN names b ON b.cluster_id = target_cluster_id GROUP BY 1")
def _(spark, sf):
    return I.blast_radius(I.causal_links(V.cluster_events(spark, sf), cluster_names(spark, sf), WINDOW))


def incident_clusters(spark, sf):
    """Error events as clusters with a time; a few are noise, harmless or without a time."""
    a = alerts(spark, sf)
    return a.select(
        F.when(F.col("id") % 31 == 0, -1).otherwise(F.col("id")).alias("cluster_id"), F.when(F.col("priority") == "P7", "P3").otherwise(F.col("priority")).alias("priority"),
        F.when(F.col("id") % 29 != 0, F.col("ts_ms")).otherwise(0).alias("representative_timestamp_ms")).where("cluster_id <> -1 or representative_timestamp_ms > 0").dropDuplicates(["cluster_id"]).withColumn(
        "representative_timestamp_ms", F.when(F.col("cluster_id") == -1, 1).otherwise(F.col("representative_timestamp_ms"))).withColumn(
        "priority", F.when(F.col("cluster_id") == -1, "P0").otherwise(F.col("priority")))


SQL_VIEWS["inc_clusters"] = (("alerts",), """
    SELECT id AS cluster_id, CASE WHEN priority = 'P7' THEN 'P3' ELSE priority END AS priority, CASE WHEN id % 29 <> 0 THEN ts_ms ELSE 0 END AS t FROM alerts WHERE id % 31 <> 0
    UNION ALL SELECT -1, 'P0', 1""")


@entry("G04_telemetry_context", """
    WITH m AS (SELECT *, CASE WHEN cluster_id = -1 THEN 'skipped_noise' WHEN priority = 'P3' THEN 'skipped_non_incident' WHEN t <= 0 THEN 'no_timestamp' END AS reason FROM inc_clusters),
    f AS (SELECT m.cluster_id, greatest(0, max(cpu_percent)) AS peak_cpu, max(memory_percent) AS peak_memory_percent, max(disk_iops) AS peak_disk_iops, sum(network_drops) AS network_drops,
            sum(network_errors) AS network_errors, count(*) AS points
        FROM (SELECT *, unnest([t // 600000 - 1, t // 600000, t // 600000 + 1]) AS g FROM m WHERE reason IS NULL) m JOIN (SELECT *, timestamp // 600000 AS g FROM telemetry) p ON p.g = m.g AND abs(p.timestamp - m.t) <= 600000 GROUP BY 1)
    SELECT m.cluster_id, coalesce(reason, CASE WHEN points > 0 THEN 'correlated' ELSE 'no_data_in_window' END) AS status,
        CASE WHEN reason IS NULL THEN coalesce(peak_cpu, 0.0::DOUBLE) END AS peak_cpu, CASE WHEN reason IS NULL THEN coalesce(peak_memory_percent, 0.0::DOUBLE) END AS peak_memory_percent,
        CASE WHEN reason IS NULL THEN coalesce(peak_disk_iops, 0.0::DOUBLE) END AS peak_disk_iops, CASE WHEN reason IS NULL THEN coalesce(network_drops, 0.0::DOUBLE) END AS network_drops,
        CASE WHEN reason IS NULL THEN coalesce(network_errors, 0.0::DOUBLE) END AS network_errors, coalesce(points, 0) AS points
    FROM m LEFT JOIN f ON f.cluster_id = m.cluster_id""")
def _(spark, sf):
    return I.telemetry_context(incident_clusters(spark, sf), V.telemetry(spark, sf), 600_000)


@entry("G05_cpu_before", """
    SELECT cluster_id, p.cpu AS pre_anomaly_cpu FROM (SELECT cluster_id, t - 30000 AS b FROM inc_clusters) c
    ASOF LEFT JOIN (SELECT timestamp, max(cpu_percent) AS cpu FROM telemetry GROUP BY timestamp) p ON c.b > p.timestamp""")
def _(spark, sf):
    return I.cpu_before(incident_clusters(spark, sf), V.telemetry(spark, sf))


@entry("G06_attach_anomalies", f"""
    WITH {SQL_CLUSTERS}, {SQL_ANOMALIES} SELECT cluster_id, size, coalesce(label, 'known') AS anomaly_label, coalesce(distance, 0.0::DOUBLE) AS anomaly_score FROM cl LEFT JOIN an ON template = representative_template""")
def _(spark, sf):
    clusters, members = clusters_of(spark, sf)
    return G.attach_anomalies(clusters, anomalies_of(members)).select("cluster_id", "size", "anomaly_label", "anomaly_score")


def destinations(spark, sf):
    n = F.col("n_nationkey")
    kinds = F.array(*[F.lit(k) for k in ("slack", "pagerduty", "teams", "generic")])
    return V.table(spark, sf, "nation").select(
        F.concat(F.lit("d"), n.cast("string")).alias("id"), "n_name", F.get(kinds, (n % 4).cast("int")).alias("channel_type"), F.lit("https://hooks.example.com").alias("url"),
        F.concat(F.lit("P"), (n % 5).cast("string")).alias("min_priority"), (n % 7 != 0).alias("enabled"))


@entry("G07_route_alerts", """
    SELECT a.id, 'd' || n_nationkey AS webhook_id, substr(sha256(a.cluster_id || ':' || a.priority || ':' || a.source), 1, 8) AS fingerprint,
        CASE WHEN CASE WHEN a.priority = 'P7' THEN 9 ELSE CAST(substr(a.priority, 2) AS INTEGER) END <= CASE WHEN n_nationkey % 5 = 4 THEN 9 ELSE n_nationkey % 5 END THEN 'deliver' ELSE 'skipped' END AS status
    FROM alerts a, nation WHERE n_nationkey % 7 <> 0""")
def _(spark, sf):
    return G.route_alerts(alerts(spark, sf), destinations(spark, sf)).select("id", "webhook_id", "fingerprint", "status")


@entry("G08_alert_payloads", """
    WITH r AS (SELECT a.*, n_nationkey AS n, substr(sha256(a.cluster_id || ':' || a.priority || ':' || a.source), 1, 8) AS fingerprint FROM alerts a, nation
        WHERE n_nationkey % 7 <> 0 AND CASE WHEN a.priority = 'P7' THEN 9 ELSE CAST(substr(a.priority, 2) AS INTEGER) END <= CASE WHEN n_nationkey % 5 = 4 THEN 9 ELSE n_nationkey % 5 END)
    SELECT 'd' || n AS webhook_id, fingerprint, priority, ['slack', 'pagerduty', 'teams', 'generic'][1 + n % 4] AS channel_type, count(*) AS deliveries,
        CASE n % 4 WHEN 1 THEN fingerprint WHEN 3 THEN fingerprint END AS body_key,
        CASE n % 4 WHEN 1 THEN CASE priority WHEN 'P0' THEN 'critical' WHEN 'P2' THEN 'warning' WHEN 'P3' THEN 'info' ELSE 'error' END
                   WHEN 2 THEN CASE priority WHEN 'P0' THEN 'e53e3e' WHEN 'P1' THEN 'dd6b20' WHEN 'P2' THEN 'd69e2e' ELSE '718096' END END AS tone
    FROM r GROUP BY ALL""")
def _(spark, sf):
    p = G.alert_payloads(G.route_alerts(alerts(spark, sf), destinations(spark, sf)))
    get = lambda path: F.get_json_object("body", path)
    return p.groupBy(
        "webhook_id", "fingerprint", "priority", "channel_type", F.coalesce(get("$.dedup_key"), get("$.fingerprint")).alias("body_key"),
        F.coalesce(get("$.payload.severity"), get("$.themeColor")).alias("tone")).agg(F.count("*").alias("deliveries"))


def runbooks(spark, sf):
    o = V.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 3).alias("t"), F.col("o_orderpriority").alias("p")).agg(F.count("*").alias("n"))
    number = F.substring("p", 1, 1).cast("int")
    return o.select(
        (F.col("t") * 10 + number).cast("int").alias("id"), F.col("t").cast("string").alias("tenant_id"), F.concat(F.lit("book "), F.col("p")).alias("name"),
        F.when(number != 5, F.lower("p")).alias("keyword"), F.when(number == 1, "P0").when(number == 2, "P1").alias("severity"), (number != 3).alias("enabled"))


SQL_VIEWS["books"] = ((), """
    SELECT CAST(t * 10 + n AS INTEGER) AS id, CAST(t AS VARCHAR) AS tenant_id, CASE WHEN n <> 5 THEN lower(p) END AS keyword, CASE n WHEN 1 THEN 'P0' WHEN 2 THEN 'P1' END AS severity, n <> 3 AS enabled, 'book ' || p AS name
    FROM (SELECT DISTINCT o_custkey % 3 AS t, o_orderpriority AS p, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS n FROM orders)""")


@entry("G09_match_runbooks", """
    SELECT i.id AS incident_id, b.id AS runbook_id FROM incidents i JOIN books b ON b.tenant_id = i.tenant_id
    WHERE b.enabled AND (b.keyword IS NULL OR contains(lower(i.title), b.keyword)) AND (b.severity IS NULL OR b.severity = i.severity)""")
def _(spark, sf):
    return G.match_runbooks(V.incidents(spark, sf), runbooks(spark, sf))


@entry("G10_runbook_executions", """
    SELECT l_orderkey * 10 + l_linenumber AS id, b.name AS runbook, epoch_ms(l_shipdate) AS created_ms FROM lineitem JOIN books b ON b.id = (l_partkey % 3) * 10 + 1 + l_suppkey % 5
    WHERE b.tenant_id = '1' ORDER BY l_shipdate DESC, l_orderkey * 10 + l_linenumber LIMIT 100""")
def _(spark, sf):
    runs = V.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), ((F.col("l_partkey") % 3) * 10 + 1 + F.col("l_suppkey") % 5).cast("int").alias("runbook_id"),
        at_ms(V.ntz_ms(F.col("l_shipdate"))).alias("created_at"))
    return as_ms(G.runbook_executions(runs, runbooks(spark, sf), "1"), created_ms="created_at").select("id", "runbook", "created_ms")


@entry("G11_unseen_templates", "SELECT DISTINCT template FROM norm WHERE md5(template) NOT IN (SELECT md5(template) FROM norm WHERE doc_id % 3 = 0)")
def _(spark, sf):
    n = cut_lineage(normalised(spark, sf))
    seen = n.where(F.col("line_number") % 3 == 0).select(text_key(F.col("normalized_text")).alias("text_key")).distinct()
    return G.unseen_templates(E.dedupe_templates(n), seen).select("template")


@entry("G12_attach_severity", f"""
    WITH {SQL_CLUSTERS}, sv AS (SELECT cluster_id, 'P' || (cluster_id % 3) AS p, size / 1000.0::DOUBLE AS s FROM cl WHERE cluster_id % 2 = 0)
    SELECT cl.cluster_id, coalesce(p, 'P3') AS priority, coalesce(s, 0.0::DOUBLE) AS composite_severity_score FROM cl LEFT JOIN sv ON sv.cluster_id = cl.cluster_id""")
def _(spark, sf):
    clusters, _ = clusters_of(spark, sf)
    c = F.col("cluster_id")
    scored = clusters.where(c % 2 == 0).select("cluster_id", F.concat(F.lit("P"), (c % 3).cast("string")).alias("priority"), (F.col("size") / F.lit(1000.0)).alias("composite_score"))
    return G.attach_severity(clusters, scored).select("cluster_id", "priority", "composite_severity_score")


def snapshots(spark, sf):
    """Templates of even and of odd documents as two runs."""
    from logspark.functions.text import normalise

    documents = V.documents(spark, sf).select("doc_id", "text")

    def templates(d):
        run, text = F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), F.col("template")
        key = F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))
        return d.select("doc_id", run.alias("run"), normalise(F.col("text")).alias("template")).withColumn("key", key)

    def with_template(d, rows):
        """``rows`` (``run, key, doc_id`` and more) with their templates; an id may have several documents of a template."""
        mark, texts = F.xxhash64("doc_id").alias("mark"), templates(d).select("run", "key", F.xxhash64("doc_id").alias("mark"), "template")
        others = [c for c in rows.columns if c not in ("run", "key", "doc_id")]
        met = texts.join(rows.select("run", "key", mark, *others), ["run", "key", "mark"]).groupBy("run", "key", "mark")
        return met.agg(F.first("template").alias("template"), *[F.first(c).alias(c) for c in others]).drop("mark")

    text = F.col("template")
    n = templates(documents).groupBy("run", "key", F.substring(text, 1, 32).alias("head"), F.length(text).alias("length"))
    n = cut_lineage(n.agg(F.count("*").alias("size"), F.min("doc_id").alias("doc_id")))
    # ords by size and text; whole texts are compared only where size and beginning are equal
    begun = n.select("run", "key", "doc_id", F.xxhash64("run", "size", "head").alias("same"))
    ties = begun.groupBy("same").agg(F.count("*").alias("_n")).where("_n > 1").select("same")
    tied = cut_lineage(begun.join(ties, "same", "left_semi").drop("same"))
    tied = F.broadcast(tied) if tied.count() <= R.FEW else tied
    few = documents.join(tied.select("doc_id"), "doc_id", "left_semi")
    whole = with_template(few, tied).withColumnRenamed("template", "whole")
    ranked = numbered(n.join(whole, ["run", "key"], "left"), "ord", ["run"], [F.col("size").desc(), F.col("head"), F.col("whole")])
    rows = with_template(documents, ranked.select("run", "key", "doc_id", "ord", "size", "length")).select(
        "run", F.col("ord").cast("int").alias("ord"), "template", "size",
        ((F.col("length") % 100) / F.lit(100.0)).alias("anomaly_score"), F.concat(F.lit("P"), (F.col("length") % 4).cast("string")).alias("priority"),
    ).withColumn("cluster_id", F.col("ord"))
    rows = stored(rows, "snapshots")
    return rows.where("run = 'a'").drop("run"), rows.where("run = 'b'").drop("run")


SQL_CANDIDATES = """
    tk AS (SELECT run, ord, unnest(CASE WHEN len(l) = 0 THEN [' '] ELSE l END) AS token, greatest(len(l), 1) AS n FROM
        (SELECT run, ord, list_distinct(regexp_extract_all(lower(template), '[a-z0-9]+')) AS l FROM snap)),
    cand AS (SELECT a.ord AS ord_a, b.ord AS ord_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS sim FROM tk a JOIN tk b ON a.token = b.token AND a.run = 'a' AND b.run = 'b'
        GROUP BY 1, 2 HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.40)"""


@entry("G13_drift_candidates", f"WITH {SQL_CANDIDATES} SELECT ord_a, ord_b, sim FROM cand")
def _(spark, sf):
    return R.drift_candidates(*snapshots(spark, sf))


SQL_MATCHED = SQL_CANDIDATES + """,
    seq AS (SELECT ord_a, row_number() OVER (ORDER BY ord_a) AS i FROM (SELECT DISTINCT ord_a FROM cand)),
    opts AS (SELECT i, cand.ord_a, list({'b': ord_b, 's': sim} ORDER BY sim DESC, ord_b) AS o FROM cand JOIN seq USING (ord_a) GROUP BY ALL),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS ord_a, CAST(NULL AS INTEGER) AS ord_b, CAST([] AS INTEGER[]) AS used
        UNION ALL SELECT i, ord_a, b, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END FROM (
            SELECT opts.i, opts.ord_a, list_filter(o, lambda x: NOT list_contains(used, x.b))[1].b AS b, used FROM walk JOIN opts ON opts.i = walk.i + 1)),
    matched AS (SELECT walk.ord_a, walk.ord_b, sim FROM walk JOIN cand ON cand.ord_a = walk.ord_a AND cand.ord_b = walk.ord_b)"""


@entry("G13_drift_pairs", f"WITH RECURSIVE {SQL_MATCHED} SELECT ord_a, ord_b, sim FROM matched")
def _(spark, sf):
    return R.drift_pairs(*snapshots(spark, sf))


@entry("G14_span_depth", """
    WITH RECURSIVE d AS (SELECT trace_id, span_id, 0 AS depth FROM spans WHERE parent_span_id IS NULL
        UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM spans s JOIN d ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id)
    SELECT trace_id, span_id, CAST(depth AS BIGINT) AS depth FROM d""")
def _(spark, sf):
    return G.span_depth(V.spans(spark, sf))


# --- H ----------------------------------------------------------------------------------------------


@entry("H01_rate_limit_violations", """
    SELECT client, t, count(*) AS requests, max(w) AS in_window FROM (SELECT user_id AS client, epoch_us(ts) AS t,
        count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS w FROM events) WHERE w > 3 GROUP BY 1, 2""")
def _(spark, sf):
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    requests = V.table(spark, sf, "events").select(F.col("user_id").alias("client"), us.alias("t"))
    return H.rate_limit_violations(requests, 3, 86_400_000_000)


@entry("H02_suppress_repeats", """
    WITH RECURSIVE a AS (SELECT source AS fp, ts_ms AS t, count(*) AS n FROM alerts GROUP BY 1, 2),
    nx AS (SELECT a.fp, a.t, min(b.t) AS nt FROM a JOIN a b ON a.fp = b.fp AND b.t >= a.t + 21600000 GROUP BY 1, 2),
    f AS (SELECT fp, min(t) AS t FROM a GROUP BY fp UNION ALL SELECT f.fp, nx.nt FROM f JOIN nx ON nx.fp = f.fp AND nx.t = f.t)
    SELECT a.fp AS fingerprint, a.t AS ts_ms, a.n, f.t IS NOT NULL AS fired FROM a LEFT JOIN f ON f.fp = a.fp AND f.t = a.t""")
def _(spark, sf):
    return H.suppress_repeats(alerts(spark, sf).select(F.col("source").alias("fingerprint"), "ts_ms"), 6 * 3_600_000)


@entry("H03_open_incident_dedup", """
    WITH m AS (SELECT CAST(user_id % 3 AS VARCHAR) AS tenant_id, service, 'Failing ' || event_type AS title, ts_ms, k % 6 = 0 AS resolved, 'item ' || k || ' #' || event_id AS summary FROM ev WHERE event_type IN ('error', 'purchase')),
    p AS (SELECT *, coalesce(CAST(sum(CASE WHEN resolved THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, service, title ORDER BY ts_ms, resolved, summary ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS period FROM m)
    SELECT tenant_id, service, title, period, min(ts_ms) FILTER (WHERE NOT resolved) AS created_ms, arg_max(summary, (ts_ms, summary)) FILTER (WHERE NOT resolved) AS summary,
        count(*) FILTER (WHERE NOT resolved) AS breaches, CASE WHEN count(*) FILTER (WHERE resolved) > 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status
    FROM p GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE NOT resolved) > 0""")
def _(spark, sf):
    s = lambda c: F.col(c).cast("string")
    marks = V.events(spark, sf).where(F.col("event_type").isin("error", "purchase")).select(
        (F.col("user_id") % 3).cast("string").alias("tenant_id"), "service", F.concat(F.lit("Failing "), F.col("event_type")).alias("title"), "ts_ms",
        (F.col("k") % 6 == 0).alias("resolved"), F.concat(F.lit("item "), s("k"), F.lit(" #"), s("event_id")).alias("summary"))
    return H.open_incident_dedup(marks).drop("resolved_ms")


@entry("H04_span_waterfall", """
    WITH RECURSIVE d AS (SELECT trace_id, span_id, 0 AS depth FROM spans WHERE parent_span_id IS NULL
        UNION ALL SELECT s.trace_id, s.span_id, d.depth + 1 FROM spans s JOIN d ON s.trace_id = d.trace_id AND s.parent_span_id = d.span_id)
    SELECT s.trace_id, s.span_id, s.start_ms - min(s.start_ms) OVER (PARTITION BY s.trace_id) AS offset_ms, CAST(d.depth AS BIGINT) AS depth FROM spans s JOIN d ON d.trace_id = s.trace_id AND d.span_id = s.span_id""")
def _(spark, sf):
    return H.span_waterfall(V.spans(spark, sf)).select("trace_id", "span_id", "offset_ms", "depth")


@entry("H05_top_clusters", f"WITH {SQL_CLUSTERS} SELECT cluster_id, size FROM cl ORDER BY size DESC, cluster_id LIMIT 7")
def _(spark, sf):
    return E.top_clusters(clusters_of(spark, sf)[0], 7).select("cluster_id", "size")


@entry("H06_max_priority", "SELECT min(severity) AS max_priority, min(severity) <= 'P2' AS alerts, min(severity) <= 'P1' AS mails FROM incidents")
def _(spark, sf):
    return H.max_priority(V.incidents(spark, sf).withColumnRenamed("severity", "priority"))
