"""K: streams, run to the end over files. L: compositions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from catalog.base import alerts, as_ms, entry
from catalog.ingest import _MESSAGE, SQL_RECORDS, otlp_traces, records
from catalog.relations import SQL_MATCHED, snapshots
from logspark import views as V
from logspark.functions.text import mask_pattern
from logspark.functions.timing import at_ms
from logspark.operators.aggregate import dedupe_templates
from logspark.operators.vectors import centroids
from logspark.plans.analysis import analyze, build_baseline, compare_runs, merge_baseline
from logspark.plans.explorer import log_explorer
from logspark.session import scratch_path, spread
from logspark.operators.storage import read_stored
from logspark.streaming import ingest as K, state as KS

NOW = V.EVENTS_NOW_MS
ALL_AT_ONCE = {"availableNow": True}


def messages(spark, df, name="messages"):
    """Write message lines to a folder and open it as a stream, two files per micro-batch."""
    path = scratch_path(spark, name)
    df.repartition(4).write.text(path)
    return K.open_folder(spark, path, 2)


def as_stream(spark, df, name, max_files=2, files=4, order=None):
    path = scratch_path(spark, name)
    spread = df.repartition(files) if order is None else df.repartitionByRange(files, order)
    spread.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max_files).parquet(path)


def finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query


def latest(spark, stream, keys, name):
    """Run an update-mode query to the end and return the last value written per key."""
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, name + "-cp")
    finish(stream.writeStream.outputMode("update").foreachBatch(K.idempotent_sink(path)).option("checkpointLocation", checkpoint).trigger(**ALL_AT_ONCE).start())
    written = spark.read.schema(StructType([*stream.schema.fields, StructField("batch_id", LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


@entry("K01_stream_logs", f"SELECT tenant_id, CASE WHEN contains(raw_json, '\"timestamp\"') THEN ts_ms ELSE -1 END AS ts_ms, source, level, message FROM ({SQL_RECORDS})")
def _(spark, sf):
    path, bad, cp = (scratch_path(spark, n) for n in ("k01", "k01-bad", "k01-cp"))
    finish(K.start_log_ingest(messages(spark, records(spark, sf).select("value")), path, bad, cp, ALL_AT_ONCE))
    rows = as_ms(spark.read.parquet(path), ts_ms="timestamp")
    return rows.select("tenant_id", F.when(F.contains("raw_json", F.lit('"timestamp"')), F.col("ts_ms")).otherwise(-1).alias("ts_ms"), "source", "level", "message")


@entry("K01_compacted_logs", f"SELECT tenant_id, CASE WHEN contains(raw_json, '\"timestamp\"') THEN ts_ms ELSE -1 END AS ts_ms, source, level, message FROM ({SQL_RECORDS})")
def _(spark, sf):
    """Streamed logs, compacted in two steps and read back as a stored table."""
    path, bad, cp, table = (scratch_path(spark, n) for n in ("k01-in", "k01-refused", "k01-mark", "k01-table"))
    finish(K.start_log_ingest(messages(spark, records(spark, sf).select("value")), path, bad, cp, ALL_AT_ONCE))
    for through in (None, 2**31, 2**31):
        K.compact_batches(spark, path, table, through)
    rows = as_ms(read_stored(spark, table), ts_ms="timestamp")
    return rows.select("tenant_id", F.when(F.contains("raw_json", F.lit('"timestamp"')), F.col("ts_ms")).otherwise(-1).alias("ts_ms"), "source", "level", "message")


@entry("K02_stream_traces", "SELECT 'default_tenant' AS tenant_id, trace_id, span_id, service_name, status_code, start_ms AS end_ms FROM spans")
def _(spark, sf):
    path, cp = scratch_path(spark, "k02"), scratch_path(spark, "k02-cp")
    finish(K.start_trace_ingest(messages(spark, otlp_traces(spark, sf)), path, cp, ALL_AT_ONCE))
    return as_ms(spark.read.parquet(path), end_ms="end_time").select("tenant_id", "trace_id", "span_id", "service_name", "status_code", "end_ms")


def dirty(spark, sf):
    """Records, every sixth of them cut off in the middle."""
    r = records(spark, sf)
    return r.select(F.when(F.col("event_id") % 6 == 0, F.substring("value", 1, 20)).otherwise(F.col("value")).alias("value"))


@entry("K03_quarantine", "SELECT CASE WHEN event_id % 6 = 0 THEN 'rejected' ELSE 'stored' END AS fate, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path, bad, cp = (scratch_path(spark, n) for n in ("k03", "k03-bad", "k03-cp"))
    finish(K.start_log_ingest(messages(spark, dirty(spark, sf)), path, bad, cp, ALL_AT_ONCE))
    stored = spark.read.parquet(path).select(F.lit("stored").alias("fate"))
    return stored.unionByName(spark.read.parquet(bad).select(F.lit("rejected").alias("fate"))).groupBy("fate").agg(F.count("*").alias("n"))


@entry("K04_idempotent_sink", "SELECT event_id % 4 AS batch, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "k04")
    write, e = K.idempotent_sink(path), V.events(spark, sf).select("event_id")
    for batch in (0, 1, 2, 1, 3, 0):  # 0 and 1 are delivered twice
        write(e.where(F.col("event_id") % 4 == batch), batch)
    return spark.read.parquet(path).groupBy((F.col("event_id") % 4).alias("batch")).agg(F.count("*").alias("n"))


@entry("K05_live_tail", f"SELECT CAST(user_id % 3 AS VARCHAR) AS tenant_id, CASE WHEN event_id % 4 <> 0 THEN level WHEN event_id % 4 <> 1 AND contains(upper({_MESSAGE}), 'ERROR') THEN 'ERROR' ELSE 'INFO' END AS level, service, message FROM (SELECT ev.*, r.message FROM ev JOIN ({SQL_RECORDS}) r ON r.event_id = ev.event_id) WHERE contains(service, 'svc-4')")
def _(spark, sf):
    path, cp = scratch_path(spark, "k05"), scratch_path(spark, "k05-cp")
    tail = K.live_tail(messages(spark, records(spark, sf).select("value")), service="SVC-4")
    finish(tail.writeStream.format("parquet").option("path", path).option("checkpointLocation", cp).trigger(**ALL_AT_ONCE).start())
    return spark.read.parquet(path).select("tenant_id", "level", "service", "message")


STREAM_RULES = [
    {"id": 1, "query": "level:ERROR", "aggregation": "count", "window_seconds": 3600},
    {"id": 2, "query": "source:svc-3", "aggregation": "max", "field": "k", "window_seconds": 3600},
]


@entry("K06_stream_metrics", """
    SELECT 1 AS rule_id, ts_ms - ts_ms % 3600000 AS bucket_ms, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE level = 'ERROR' GROUP BY 2
    UNION ALL SELECT 2, ts_ms - ts_ms % 3600000, CAST(max(CAST(json_extract_string(raw_json, '$.k') AS BIGINT)) AS DOUBLE) FROM logs WHERE source = 'svc-3' GROUP BY 2""")
def _(spark, sf):
    stream = as_stream(spark, V.logs(spark, sf), "k06")
    return latest(spark, KS.stream_metrics(stream, STREAM_RULES, "60 days"), ["rule_id", "bucket_ms"], "k06-out")


@entry("K07_stream_template_counts", "SELECT regexp_replace(message, '[0-9]+', '*', 'g') AS template, count(*) AS n FROM logs GROUP BY 1")
def _(spark, sf):
    stream = as_stream(spark, V.logs(spark, sf), "k07")
    return latest(spark, KS.stream_template_counts(stream, mask_pattern(F.col("message"))), ["template"], "k07-out")


@entry("K08_stream_rate_limit", """
    SELECT user_id AS client, w AS from_ms, w + 86400000 AS to_ms, count(*) AS requests FROM (SELECT user_id, unnest([ts_ms - ts_ms % 43200000, ts_ms - ts_ms % 43200000 - 43200000]) AS w FROM ev) GROUP BY 1, 2 HAVING count(*) > 3""")
def _(spark, sf):
    requests = V.events(spark, sf).select(F.col("user_id").alias("client"), at_ms(F.col("ts_ms")).alias("timestamp"))
    limited = KS.stream_rate_limit(as_stream(spark, requests, "k08"), 3, "24 hours", "12 hours", "60 days")
    return latest(spark, limited, ["client", "from_ms", "to_ms"], "k08-out")


@entry("K09_watch_directory", "SELECT count(*) AS lines, count(DISTINCT template) AS templates FROM (SELECT regexp_replace(event_type || ' user ' || user_id, '[0-9]+', '*', 'g') AS template FROM events)")
def _(spark, sf):
    path, out, cp = (scratch_path(spark, n) for n in ("k09", "k09-out", "k09-cp"))
    V.events(spark, sf).select(F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"))).repartition(3).write.text(path)
    sink = K.idempotent_sink(out)
    finish(K.watch_directory(spark, path, cp, lambda batch, i: sink(dedupe_templates(batch, mask_pattern(F.col("raw_text"))), i)))
    return spark.read.parquet(out).agg(F.sum("n").alias("lines"), F.countDistinct("template").alias("templates"))


@entry("K10_stream_alert_suppression", """
    WITH RECURSIVE a AS (SELECT source AS fp, ts_ms AS t FROM alerts GROUP BY 1, 2),
    nx AS (SELECT a.fp, a.t, min(b.t) AS nt FROM a JOIN a b ON a.fp = b.fp AND b.t >= a.t + 21600000 GROUP BY 1, 2),
    f AS (SELECT fp, min(t) AS t FROM a GROUP BY fp UNION ALL SELECT f.fp, nx.nt FROM f JOIN nx ON nx.fp = f.fp AND nx.t = f.t)
    SELECT fp AS fingerprint, t AS ts_ms FROM f""")
def _(spark, sf):
    path, cp = scratch_path(spark, "k10"), scratch_path(spark, "k10-cp")
    source, rows = scratch_path(spark, "k10-in"), alerts(spark, sf).select(F.col("source").alias("fingerprint"), "ts_ms")
    for part in (0, 2, 1, 4, 3):  # six days each, out of order within the lateness; four files are a micro-batch
        age = F.floor((F.lit(NOW) - F.col("ts_ms")) / (6 * 86_400_000))
        rows.where(F.greatest(F.lit(0), F.least(F.lit(4), 4 - age)) == part).repartition(4).write.mode("append").parquet(source)
    # the input ends here: an alert of nobody, far ahead, lets the watermark pass all others
    rows.agg((F.max("ts_ms") + 20 * 86_400_000).alias("ts_ms")).select(F.lit("end of input").alias("fingerprint"), "ts_ms").write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(source)
    fired = KS.stream_alert_suppression(stream, 6 * 3_600_000, "12 days").where("fingerprint <> 'end of input'")
    finish(fired.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", cp).trigger(**ALL_AT_ONCE).start())
    return spark.read.parquet(path)


# --- L ----------------------------------------------------------------------------------------------


def event_lines(spark, sf):
    """Events as raw log lines of ten services, with words that differ per action."""
    e = spread(V.events(spark, sf), "event_id")
    iso = F.concat(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("T"), F.substring(F.col("ts").cast("string"), 12, 8), F.lit("Z "))
    words = F.when(F.col("event_type") == "error", "connection refused by upstream, request failed").when(
        F.col("event_type") == "view", "page rendered fine").when(F.col("event_type") == "signup", "new account created ok").otherwise("request processed")
    return e.select(
        F.concat(iso, F.col("level"), F.lit(" "), F.col("event_type"), F.lit(" "), words, F.lit(" for user "), F.col("user_id").cast("string")).alias("raw_text"),
        F.lit("events").alias("source"), F.col("event_id").alias("line_number"), F.col("service").alias("source_label"))


@entry("L01_analyze", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS templates FROM (SELECT event_type, level, count(*) AS n FROM ev GROUP BY 1, 2)")
def _(spark, sf):
    lines = event_lines(spark, sf)
    rows, _ = build_baseline(lines, NOW)
    done = analyze(lines, NOW, baseline=rows, telemetry=V.telemetry(spark, sf), window_ms=5000)
    return done.clusters.agg(F.sum("size").alias("total")).withColumn("templates", done.members.agg(F.count("*")).scalar())


@entry("L01_analyze_clusters")
def _(spark, sf):
    """The cluster table of a run over redacted documents and event lines."""
    docs = V.documents(spark, sf).select(F.col("text").alias("raw_text"), F.lit("documents").alias("source"), F.col("doc_id").alias("line_number"), F.col("source").alias("source_label"))
    done = analyze(event_lines(spark, sf).unionByName(docs), NOW, window_ms=5000)
    return done.clusters.select("cluster_id", "size", "templates", "priority", "representative_line")


@entry("L02_build_baseline", "SELECT count(*) AS lines FROM events")
def _(spark, sf):
    rows, meta = build_baseline(event_lines(spark, sf), NOW)
    return meta.select(F.col("logs_processed").alias("lines"))


def label_baseline(spark, sf):
    c = F.col("cluster_id")
    return centroids(V.vectors(spark, sf)).select(
        "cluster_id", F.col("centroid").alias("vector"), F.col("members").alias("size"), F.concat(F.lit("t"), c.cast("string")).alias("representative_template"),
        F.concat(F.lit("r"), c.cast("string")).alias("representative_raw"), F.concat(F.lit("l"), c.cast("string")).alias("label"), (c % 2 == 0).alias("is_acknowledged"))


@entry("L03_merge_baseline", """
    WITH inc AS (SELECT id % 10 AS g, list(x ORDER BY i) AS vector, any_value(n) AS size FROM (SELECT id % 10 AS id, i, avg(x) AS x, count(*) AS n FROM (SELECT id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs) GROUP BY 1, 2) GROUP BY 1),
    bs AS (SELECT base.cluster_id, base.vector, s.size FROM base JOIN (SELECT label, count(*) AS size FROM vecs GROUP BY 1) s ON s.label = base.cluster_id),
    nr AS (SELECT g, inc.vector, inc.size, arg_min(bs.cluster_id, (round(1 - list_cosine_similarity(inc.vector, bs.vector), 12), bs.cluster_id)) AS c, min(1 - list_cosine_similarity(inc.vector, bs.vector)) AS d FROM inc, bs GROUP BY ALL),
    pt AS (SELECT cluster_id, size, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM bs UNION ALL SELECT c, size, unnest(vector), generate_subscripts(vector, 1) FROM nr WHERE d <= 0.7
        UNION ALL SELECT (SELECT max(cluster_id) FROM bs) + row_number() OVER (ORDER BY g), size, unnest(vector), generate_subscripts(vector, 1) FROM nr WHERE d > 0.7)
    SELECT cluster_id, i - 1 AS i, round(sum(x * size) / sum(size), 6) AS x, CAST(sum(size) AS BIGINT) AS size FROM pt GROUP BY 1, 2""")
def _(spark, sf):
    groups = V.vectors(spark, sf).withColumn("g", F.col("id") % 10)
    incoming = centroids(groups, "g").select(
        "cluster_id", F.col("centroid").alias("vector"), F.col("members").alias("size"), F.lit("new").alias("representative_template"), F.lit("new").alias("representative_raw"))
    merged = merge_baseline(label_baseline(spark, sf), incoming, low=0.7)
    return merged.select("cluster_id", "size", F.posexplode("vector").alias("i", "x")).select(
        F.col("cluster_id").cast("long").alias("cluster_id"), F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"), "size")


@entry("L04_compare_runs", f"WITH RECURSIVE {SQL_MATCHED} SELECT (SELECT count(*) FROM matched) AS matched_pairs, (SELECT count(*) FROM snap WHERE run = 'a') AS total_clusters_a, (SELECT count(*) FROM snap WHERE run = 'b') AS total_clusters_b")
def _(spark, sf):
    a, b = snapshots(spark, sf)
    keep = lambda s: s.select("cluster_id", F.col("template").alias("representative_template"), "size", "anomaly_score", "priority")
    _, report = compare_runs(keep(a), keep(b), "a", "b")
    return report.select("matched_pairs", "total_clusters_a", "total_clusters_b")


@entry("L05_log_explorer", """
    WITH f AS (SELECT * FROM logs WHERE tenant_id = '1' AND level = 'ERROR')
    SELECT 'rows' AS part, least(count(*), 50) AS n FROM f UNION ALL SELECT 'facets', count(DISTINCT source) + count(DISTINCT level) FROM f
    UNION ALL SELECT 'histogram', count(*) FROM f UNION ALL SELECT 'patterns', count(*) FROM f""")
def _(spark, sf):
    e = log_explorer(V.logs(spark, sf), "level:ERROR", "1", limit=50)
    part = lambda name, df: df.select(F.lit(name).alias("part"), "n")
    return part("rows", e.rows.agg(F.count("*").alias("n"))).unionByName(part("facets", e.facets.agg(F.count("*").alias("n")))).unionByName(
        part("histogram", e.histogram.agg(F.sum("count").alias("n")))).unionByName(part("patterns", e.patterns.agg(F.sum("count").alias("n"))))
