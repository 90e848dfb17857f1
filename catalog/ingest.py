"""A: scans and sources. B: sinks, tiers, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import as_ms, entry, tenants
from logspark import views as V
from logspark.functions.timing import at_ms, coerce_event_ms, extract_timestamp_ms
from logspark.operators import storage as B
from logspark.session import scratch_path, spread
from logspark.sources import files as A
from logspark.sources.kernel import kernel_events_to_ecs
from logspark.sources.otlp import flatten_otlp_logs, flatten_otlp_spans
from logspark.sources.records import resolve_source, to_log_table

NOW = V.EVENTS_NOW_MS
s = lambda c: F.col(c).cast("string")


def _iso_text():
    """``2024-01-01T00:00:07`` out of an NTZ timestamp."""
    text = F.col("ts").cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8))


def plain_lines(spark, sf):
    """Events as ``ts LEVEL [source] msg`` lines; every seventh is free text, every ninth has a bad time."""
    e = spread(V.events(spark, sf), "event_id")
    stamp = F.when(F.col("event_id") % 9 == 0, F.lit("2024-13-41T00:00:00Z")).otherwise(F.concat(_iso_text(), F.lit("Z")))
    line = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("free text "), s("k"))).otherwise(
        F.concat(stamp, F.lit(" "), F.lower("level"), F.lit(" ["), F.col("service"), F.lit("] "), V.message())
    )
    return e.select("event_id", line.alias("line"))


_PLAIN = """(CASE WHEN event_id % 7 = 0 THEN 'free text ' || k ELSE
    (CASE WHEN event_id % 9 = 0 THEN '2024-13-41T00:00:00Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END) || ' ' || lower(level) || ' [' || service || '] '
    || event_type || ' user ' || user_id || ' item ' || k || ' cents ' || cents END)"""


def json_lines(spark, sf):
    """Events as JSON lines: message, msg or neither; every fifth line is no JSON."""
    e = spread(V.events(spark, sf), "event_id")
    k = F.col("event_id") % 5
    body = F.concat(F.lit('{"level":"'), F.col("level"), F.lit('","'), F.when(k == 0, "message").when(k == 1, "msg").otherwise("note"), F.lit('":"'), V.message(), F.lit('"}'))
    line = F.when(k == 4, F.concat(F.lit("not json "), s("k"))).when(k == 3, F.concat(F.lit("{broken "), s("k"), F.lit("}"))).otherwise(body)
    return e.select("event_id", line.alias("line"))


_JSON_TEXT = """(CASE event_id % 5 WHEN 4 THEN 'not json ' || k WHEN 3 THEN '{broken ' || k || '}'
    ELSE '{"level":"' || level || '","' || CASE event_id % 5 WHEN 0 THEN 'message' WHEN 1 THEN 'msg' ELSE 'note' END || '":"' || event_type || ' user ' || user_id || ' item ' || k || ' cents ' || cents || '"}' END)"""
_MESSAGE = "event_type || ' user ' || user_id || ' item ' || k || ' cents ' || cents"


def _written(spark, df, name):
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


@entry("A01_read_text_logs", f"SELECT trim({_PLAIN}) AS raw_text, count(*) AS n FROM ev GROUP BY 1")
def _(spark, sf):
    lines = plain_lines(spark, sf).select(F.explode(F.array("line", F.lit("   "))).alias("value"))
    read = A.read_text_logs(spark, _written(spark, lines, "text"), line_numbers=True)
    return read.groupBy("raw_text").agg(F.count("*").alias("n"))


@entry("A02_read_json_logs", f"""
    SELECT coalesce(json_extract_string(ok, '$.message'), json_extract_string(ok, '$.msg'), line) AS raw_text, ok AS metadata, count(*) AS n
    FROM (SELECT line, CASE WHEN json_valid(line) THEN line END AS ok FROM (SELECT {_JSON_TEXT} AS line FROM ev)) GROUP BY 1, 2""")
def _(spark, sf):
    path = _written(spark, json_lines(spark, sf).select("line"), "json")
    return A.read_json_logs(spark, path, extensions=(".txt",)).groupBy("raw_text", "metadata").agg(F.count("*").alias("n"))


@entry("A03_sniff_json_lines", f"""
    SELECT event_id, coalesce(json_extract_string(ok, '$.message'), json_extract_string(ok, '$.msg'), line) AS raw_text, ok AS metadata
    FROM (SELECT event_id, line, CASE WHEN json_valid(line) THEN line END AS ok FROM (SELECT event_id, {_JSON_TEXT} AS line FROM ev))""")
def _(spark, sf):
    return A.sniff_json_lines(json_lines(spark, sf), "line").drop("line")


@entry("A04_parse_plain_logs", f"""
    SELECT event_id, CASE WHEN event_id % 7 <> 0 AND event_id % 9 <> 0 THEN epoch_ms(date_trunc('second', ts)) ELSE -1 END AS ts_ms,
           CASE WHEN event_id % 7 <> 0 THEN level END AS level, CASE WHEN event_id % 7 <> 0 THEN service END AS source,
           CASE WHEN event_id % 7 <> 0 THEN {_MESSAGE} ELSE 'free text ' || k END AS message FROM ev""")
def _(spark, sf):
    parsed = A.parse_plain_logs(plain_lines(spark, sf), "line").drop("line")
    return as_ms(parsed, ts_ms="timestamp").withColumn("ts_ms", F.coalesce("ts_ms", F.lit(-1)))


@entry("A05_read_mixed_logs", f"""
    SELECT CASE WHEN event_id % 2 = 0 THEN 'ERR' WHEN event_id % 7 <> 0 THEN level END AS level,
           CASE WHEN event_id % 2 = 0 THEN {_MESSAGE} WHEN event_id % 7 <> 0 THEN {_MESSAGE} ELSE 'free text ' || k END AS message, count(*) AS n
    FROM ev GROUP BY 1, 2""")
def _(spark, sf):
    as_json = V.events(spark, sf).where(F.col("event_id") % 2 == 0).select(
        F.concat(F.lit('{"level":"ERR","timestamp":'), (F.col("ts_ms") / 1000).cast("decimal(20,3)").cast("string"), F.lit(',"message":"'), V.message(), F.lit('"}')).alias("line"))
    plain = plain_lines(spark, sf).where(F.col("event_id") % 2 == 1).select("line")
    path = _written(spark, as_json.unionByName(plain), "mixed")
    return A.read_mixed_logs(spark, path, extensions=(".txt",)).groupBy("level", "message").agg(F.count("*").alias("n"))


@entry("A06_union_sources", f"""
    SELECT source_label, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (
        SELECT 'plain' AS source_label, {_PLAIN} AS line FROM ev UNION ALL SELECT 'json', {_JSON_TEXT} FROM ev UNION ALL SELECT 'docs', text FROM documents) GROUP BY 1""")
def _(spark, sf):
    docs = V.documents(spark, sf).select(F.col("doc_id").alias("event_id"), F.col("text").alias("line"))
    both = A.union_sources([plain_lines(spark, sf), json_lines(spark, sf), docs], ["plain", "json", "docs"])
    return both.groupBy("source_label").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


def stamped_lines(spark, sf):
    e = spread(V.events(spark, sf), "event_id")
    text = F.col("ts").cast("string")
    k = F.col("event_id") % 9
    months = F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")])
    sysmon = F.get(months, (F.col("event_id") % 12).cast("int"))
    hms = F.substring(text, 12, 8)
    line = (
        F.when(k == 0, F.concat(F.lit("auth-1  | "), s("ts_ms"), F.lit(" boot")))
        .when(k == 1, F.concat(F.floor(F.col("ts_ms") / 1000).cast("string"), F.lit(".25 tick")))
        .when(k == 2, F.concat(F.lit("at "), _iso_text(), F.lit(".5Z up")))
        .when(k == 3, F.concat(F.replace(F.substring(text, 1, 10), F.lit("-"), F.lit("/")), F.lit(" "), hms, F.lit(",123 x")))
        .when(k == 4, F.concat(_iso_text(), F.lit("+05:30 y")))
        .when(k == 5, F.concat(sysmon, F.lit("  2 "), hms, F.lit(" host")))
        .when(k == 6, F.concat(F.lit("2024-02-31T"), hms, F.lit("Z bad date")))
        .when(k == 7, F.concat(F.lit("order 99999999999999 "), _iso_text(), F.lit("-0130")))
        .otherwise(F.concat(F.lit("nothing "), s("k")))
    )
    return e.select("event_id", line.alias("line"))


@entry("A07_extract_timestamp", f"""
    WITH t AS (SELECT event_id, ts_ms, ts, date_trunc('second', ts) AS sec, CAST(event_id % 12 + 1 AS BIGINT) AS mon FROM ev),
    u AS (SELECT *, epoch_ms(sec) AS sec_ms, epoch_ms(make_timestamp(2024, mon, 2, CAST(hour(ts) AS BIGINT), CAST(minute(ts) AS BIGINT), CAST(second(ts) AS DOUBLE))) AS y24,
                    epoch_ms(make_timestamp(2023, mon, 2, CAST(hour(ts) AS BIGINT), CAST(minute(ts) AS BIGINT), CAST(second(ts) AS DOUBLE))) AS y23 FROM t)
    SELECT event_id, CASE event_id % 9 WHEN 0 THEN ts_ms WHEN 1 THEN sec_ms + 250 WHEN 2 THEN sec_ms + 500 WHEN 3 THEN sec_ms + 123 WHEN 4 THEN sec_ms - 19800000
        WHEN 5 THEN CASE WHEN y24 > {NOW} + 604800000 THEN y23 ELSE y24 END WHEN 7 THEN sec_ms + 5400000 ELSE -1 END AS ts_ms FROM u""")
def _(spark, sf):
    found = F.coalesce(extract_timestamp_ms(F.col("line"), NOW), F.lit(-1))
    return stamped_lines(spark, sf).select("event_id", found.alias("ts_ms"))


def shipped(spark, sf):
    """JSON records that name their service the way different shippers do."""
    k = F.col("event_id") % 12
    name = F.concat(F.lit(" "), F.col("service"), F.lit(" "))
    q = lambda key: F.concat(F.lit(f'{{"{key}":"'), name, F.lit('","n":1}'))
    body = F.lit('{"n":1}')
    for i, key in enumerate(("source", "service", "service_name", "service.name", "container_name", "app", "logger_name")):
        body = F.when(k == i, q(key)).otherwise(body)
    body = F.when(k == 7, F.concat(F.lit('{"service":{"name":"'), name, F.lit('"}}'))).when(
        k == 8, F.concat(F.lit('{"kubernetes":{"labels":{"app":"'), name, F.lit('"}}}'))).when(
        k == 9, F.concat(F.lit('{"service":"   ","app":"'), name, F.lit('"}'))).when(
        k == 10, F.concat(F.lit('{"source":["x"],"service":'), s("k"), F.lit("}"))).otherwise(body)
    return spread(V.events(spark, sf), "event_id").select("event_id", body.alias("body"))


@entry("A08_resolve_source", "SELECT event_id, CASE WHEN event_id % 12 = 11 THEN 'unknown' WHEN event_id % 12 = 10 THEN CAST(k AS VARCHAR) ELSE service END AS source FROM ev")
def _(spark, sf):
    parsed = shipped(spark, sf).withColumn("doc", F.parse_json("body"))
    return parsed.select("event_id", resolve_source(F.col("doc")).alias("source"))


@entry("A09_coerce_event_time", f"""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts_ms WHEN 1 THEN epoch_ms(date_trunc('second', ts)) WHEN 2 THEN epoch_ms(date_trunc('second', ts)) - 3600000 ELSE {NOW} END AS ts_ms FROM ev""")
def _(spark, sf):
    k = F.col("event_id") % 4
    value = F.when(k == 0, (F.col("ts_ms") / 1000).cast("decimal(20,3)").cast("string")).when(k == 1, _iso_text()).when(
        k == 2, F.concat(_iso_text(), F.lit("+01:00"))).otherwise(F.lit("soon"))
    return V.events(spark, sf).select("event_id", coerce_event_ms(value, NOW).alias("ts_ms"))


def records(spark, sf):
    """Full JSON records; some lack level, message or time."""
    e = spread(V.events(spark, sf), "event_id")
    k = F.col("event_id") % 4
    field = lambda on, text: F.when(on, text).otherwise(F.lit(""))
    body = F.concat(
        F.lit('{"service":"'), F.col("service"), F.lit('"'),
        field(k != 0, F.concat(F.lit(',"level":"'), F.col("level"), F.lit('"'))),
        field(k != 1, F.concat(F.lit(',"message":"'), V.message(), F.lit('"'))),
        field(k != 2, F.concat(F.lit(',"timestamp":"'), _iso_text(), F.lit('Z"'))),
        F.lit(',"_tenant_id":"'), (F.col("user_id") % 3).cast("string"), F.lit('"}'),
    )
    return e.select("event_id", body.alias("value"))


SQL_RECORDS = f"""
    SELECT event_id, CAST(user_id % 3 AS VARCHAR) AS tenant_id, CASE WHEN event_id % 4 = 2 THEN {NOW} ELSE epoch_ms(date_trunc('second', ts)) END AS ts_ms, service AS source,
           CASE WHEN event_id % 4 = 0 THEN 'INFO' ELSE level END AS level, CASE WHEN event_id % 4 = 1 THEN raw_json ELSE {_MESSAGE} END AS message, raw_json
    FROM (SELECT *, '{{"service":"' || service || '"' || CASE WHEN event_id % 4 <> 0 THEN ',"level":"' || level || '"' ELSE '' END
        || CASE WHEN event_id % 4 <> 1 THEN ',"message":"' || {_MESSAGE} || '"' ELSE '' END
        || CASE WHEN event_id % 4 <> 2 THEN ',"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '"' ELSE '' END
        || ',"_tenant_id":"' || (user_id % 3) || '"}}' AS raw_json FROM ev)"""


@entry("A10_to_log_table", f"SELECT 'acme' AS tenant_id, ts_ms, source, level, message, raw_json FROM ({SQL_RECORDS})")
def _(spark, sf):
    return as_ms(to_log_table(records(spark, sf), "value", "acme", NOW), ts_ms="timestamp")


def _attr(key, value, kind="stringValue"):
    return F.struct(F.lit(key).alias("key"), F.struct(value.alias(kind)).alias("value"))


def otlp_logs(spark, sf):
    """One resourceLogs document per service and day."""
    e = spread(V.events(spark, sf), "event_id")
    record = F.struct(
        (F.col("ts_ms") * 1_000_000).cast("string").alias("timeUnixNano"),
        F.when(F.col("k") % 3 != 0, F.lower("level")).alias("severityText"),
        F.when(F.col("k") % 2 == 0, F.struct(V.message().alias("stringValue"), F.lit(None).cast("string").alias("intValue"))).otherwise(
            F.struct(F.lit(None).cast("string").alias("stringValue"), s("cents").alias("intValue"))).alias("body"),
        F.array(_attr("event", s("event_id")), _attr("user", s("user_id"))).alias("attributes"),
    )
    docs = e.groupBy("service", F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.sort_array(F.collect_list(record)).alias("r"))
    resource = F.when(F.col("service") != "svc-9", F.struct(F.array(_attr("service.name", F.col("service"))).alias("attributes")))
    return docs.select(F.to_json(F.struct(F.array(F.struct(
        resource.alias("resource"), F.array(F.struct(F.col("r").alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))).alias("body"))


@entry("A11_flatten_otlp_logs", f"""
    SELECT CAST(event_id AS VARCHAR) AS event, CAST(user_id AS VARCHAR) AS user_id, ts_ms, CASE WHEN service = 'svc-9' THEN 'unknown_service' ELSE service END AS source,
           CASE WHEN k % 3 <> 0 THEN level ELSE 'INFO' END AS level, CASE WHEN k % 2 = 0 THEN {_MESSAGE} ELSE CAST(cents AS VARCHAR) END AS message FROM ev""")
def _(spark, sf):
    rows = as_ms(flatten_otlp_logs(otlp_logs(spark, sf), "body", NOW), ts_ms="timestamp")
    return rows.withColumn("event", F.col("attributes")["event"]).withColumn("user_id", F.col("attributes")["user"]).drop("attributes")


def otlp_traces(spark, sf):
    """One resourceSpans document per trace, a resource per span (services differ inside a trace)."""
    p = V.spans(spark, sf).withColumn("_n", F.substring("span_id", 2, 20).cast("long"))
    ns = lambda c: (F.unix_millis(c) * 1_000_000).cast("string")
    span = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("operation_name").alias("name"),
        F.when(F.col("_n") % 11 != 0, ns("end_time")).alias("startTimeUnixNano"), ns("start_time").alias("endTimeUnixNano"),
        F.when(F.col("status_code") == "ERROR", F.struct(F.lit(2).alias("code"))).alias("status"),
        F.array(_attr("n", s("_n"), "intValue")).alias("attributes"),
        F.array(F.struct(F.lit("started").alias("name"), ns("start_time").alias("timeUnixNano"))).alias("events"),
    )
    one = F.struct(F.struct(F.array(_attr("service.name", F.col("service_name"))).alias("attributes")).alias("resource"),
                   F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))
    return p.groupBy("trace_id").agg(F.collect_list(one).alias("resourceSpans")).select(F.to_json(F.struct("resourceSpans")).alias("body"))


def _flat_spans(spark, sf, mode):
    rows = flatten_otlp_spans(otlp_traces(spark, sf), "body", NOW, mode)
    ev_ms = F.unix_millis(F.col("events")[0]["timestamp"]).alias("event_ms")
    return as_ms(rows.select(
        "trace_id", "span_id", "parent_span_id", "service_name", "operation_name", "start_time", "end_time", "duration_ms", "status_code",
        F.col("attributes")["n"].alias("n"), ev_ms, F.col("events")[0]["name"].alias("event")), start_ms="start_time", end_ms="end_time")


# the documents swap start and end, so that clamped and unclamped durations differ
_SPAN_SQL = """
    SELECT trace_id, span_id, parent_span_id, service_name, operation_name, CASE WHEN n % 11 <> 0 THEN end_ms ELSE {now} END AS start_ms, start_ms AS end_ms,
           {duration} AS duration_ms, {status} AS status_code, {n} AS n, start_ms AS event_ms, 'started' AS event
    FROM (SELECT *, CAST(substr(span_id, 2) AS BIGINT) AS n FROM spans)"""


@entry("A12_flatten_otlp_spans_collector", _SPAN_SQL.format(
    now=NOW, duration=f"CAST(greatest(0, start_ms - CASE WHEN n % 11 <> 0 THEN end_ms ELSE {NOW} END) AS DOUBLE)", status="status_code", n="CAST(n AS VARCHAR)"))
def _(spark, sf):
    return _flat_spans(spark, sf, "collector")


@entry("A13_flatten_otlp_spans_raw", _SPAN_SQL.format(
    now=NOW, duration="CAST(CASE WHEN n % 11 <> 0 THEN start_ms - end_ms ELSE 0 END AS DOUBLE)",
    status="CASE WHEN status_code = 'ERROR' THEN '2' ELSE 'STATUS_CODE_UNSET' END", n="'{\"intValue\":\"' || n || '\"}'"))
def _(spark, sf):
    return _flat_spans(spark, sf, "raw")


@entry("A14_read_telemetry", "SELECT timestamp, cpu_percent, memory_percent, disk_iops FROM telemetry")
def _(spark, sf):
    t = V.telemetry(spark, sf)
    points = t.select(F.to_json(F.struct(*t.columns)).alias("value"))
    bad = t.select(F.explode(F.array(F.lit('{"timestamp":"soon","cpu_percent":1}'), F.lit('{"cpu_percent":2}'), F.lit('{"timestamp":-5}'))).alias("value"))
    path = _written(spark, points.unionByName(bad), "telemetry")
    return A.read_telemetry(spark, path).select("timestamp", "cpu_percent", "memory_percent", "disk_iops")


@entry("A15_kernel_events_to_ecs", """
    SELECT event_id, ts_ms, CASE WHEN k % 3 = 1 THEN 'network' ELSE 'process' END AS category, CASE WHEN k % 3 = 1 THEN 'denied' ELSE 'start' END AS type,
           CASE WHEN k % 3 = 1 THEN 'drop' ELSE 'execve' END AS action, CASE WHEN k % 3 = 1 THEN 'tcp' END AS transport,
           CASE WHEN k % 3 = 2 THEN event_type END AS process_name, CASE WHEN k % 3 = 2 THEN '/bin/' || event_type END AS executable FROM ev WHERE k % 3 <> 0""")
def _(spark, sf):
    nul = F.lit("\x00")
    rows = V.events(spark, sf).select(
        "event_id", F.col("ts_ms").alias("timestamp"), (F.col("k") % 3).cast("int").alias("kind"), F.col("user_id").cast("int").alias("pid"),
        F.concat(F.col("event_type"), nul, F.lit("junk")).alias("comm"), F.concat(F.lit("/bin/"), F.col("event_type"), nul, nul).alias("filename"),
        F.lit("tcp").alias("protocol")).withColumnRenamed("kind", "event_type")
    ecs = kernel_events_to_ecs(rows, keep=("event_id",))
    return ecs.select(
        "event_id", F.unix_millis(F.col("`@timestamp`")).alias("ts_ms"), "event.category", "event.type", "event.action", "network.transport",
        F.col("process.name").alias("process_name"), "process.executable")


@entry("A16_source_inventory")
def _(spark, sf):
    path = _written(spark, plain_lines(spark, sf).select("line"), "inventory")
    return A.source_inventory(spark, path).select("name", "size_bytes", "size", "lines")


# --- B ----------------------------------------------------------------------------------------------


@entry("B01_write_logs", "SELECT tenant_id, ts_ms // 86400000 AS day, source, count(*) AS n, CAST(sum(length(message)) AS BIGINT) AS chars FROM logs GROUP BY 1, 2, 3")
def _(spark, sf):
    path = scratch_path(spark, "logs")
    B.write_logs(V.logs(spark, sf), path)
    stored = B.read_stored(spark, path)
    return stored.groupBy("tenant_id", F.floor(F.unix_millis("timestamp") / 86_400_000).alias("day"), "source").agg(
        F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"))


@entry("B02_write_spans", "SELECT 'acme' AS tenant_id, service_name, count(*) AS n, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM spans GROUP BY service_name")
def _(spark, sf):
    path = scratch_path(spark, "spans")
    B.write_spans(V.spans(spark, sf), path, tenant="acme")
    return B.read_stored(spark, path).groupBy("tenant_id", "service_name").agg(
        F.count("*").alias("n"), F.min(F.unix_millis("start_time")).alias("first_ms"), F.max(F.unix_millis("end_time")).alias("last_ms"))


@entry("B03_apply_retention", f"""
    SELECT l.tenant_id, l.ts_ms, l.source, l.message FROM logs l LEFT JOIN tenants t ON t.id = l.tenant_id
    WHERE t.id IS NULL OR l.ts_ms >= {NOW} - CAST(86400000 AS BIGINT) * CASE t.tier WHEN 'pro' THEN 30 WHEN 'enterprise' THEN 90 ELSE 7 END""")
def _(spark, sf):
    kept = B.apply_retention(V.logs(spark, sf), tenants(spark, sf), NOW)
    return as_ms(kept, ts_ms="timestamp").select("tenant_id", "ts_ms", "source", "message")


@entry("B03_retained_table", f"""
    SELECT l.tenant_id, l.ts_ms, l.source, l.message FROM logs l LEFT JOIN tenants t ON t.id = l.tenant_id
    WHERE t.id IS NULL OR l.ts_ms >= {NOW} - CAST(86400000 AS BIGINT) * CASE t.tier WHEN 'pro' THEN 30 WHEN 'enterprise' THEN 90 ELSE 7 END""")
def _(spark, sf):
    """The tiers applied to a stored table, read back from disk."""
    path = scratch_path(spark, "retained")
    B.write_logs(V.logs(spark, sf), path)
    B.retain(spark, path, tenants(spark, sf), NOW)
    return as_ms(B.read_stored(spark, path), ts_ms="timestamp").select("tenant_id", "ts_ms", "source", "message")


_CUT = NOW - 10 * 86_400_000


@entry("B04_archived_table", f"SELECT CASE WHEN ts_ms < {_CUT} + 43200000 THEN 'archive' ELSE 'hot' END AS tier, tenant_id, ts_ms, source, level, message, raw_json FROM logs")
def _(spark, sf):
    """A stored table archived in two steps and once again: every row is in one tier, once."""
    path, archive = scratch_path(spark, "hot"), scratch_path(spark, "cold")
    logs = V.logs(spark, sf)
    B.write_logs(logs, path)
    for cut in (_CUT, _CUT + 43_200_000, _CUT + 43_200_000):
        B.archive_table(spark, path, archive, cut)
    tiers = {"archive": B.read_archive(spark, archive, logs.schema), "hot": B.read_stored(spark, path)}
    old, hot = (as_ms(df, ts_ms="timestamp").select(F.lit(t).alias("tier"), "tenant_id", "ts_ms", "source", "level", "message", "raw_json") for t, df in tiers.items())
    return old.unionByName(hot)


@entry("B04_archive_split", f"SELECT CASE WHEN ts_ms < {_CUT} THEN 'archive' ELSE 'hot' END AS tier, source, count(*) AS n FROM logs GROUP BY 1, 2")
def _(spark, sf):
    old, hot = B.archive_split(V.logs(spark, sf), _CUT)
    path = scratch_path(spark, "archive")
    B.write_archive(old, path)
    back = B.read_archive(spark, path, old.schema)
    return back.select(F.lit("archive").alias("tier"), "source").unionByName(hot.select(F.lit("hot").alias("tier"), "source")).groupBy("tier", "source").agg(F.count("*").alias("n"))


@entry("B05_hydrate_spans", "SELECT span_id, trace_id, start_ms, duration_ms FROM spans")
def _(spark, sf):
    spans = V.spans(spark, sf)
    old, hot = B.archive_split(spans, _CUT, "start_time")
    overlap = spans.where(F.col("start_time") < at_ms(_CUT + 86_400_000))
    path = scratch_path(spark, "span-archive")
    B.write_archive(old, path)
    B.write_archive(overlap, path)
    return as_ms(B.hydrate_spans(hot, B.read_archive(spark, path, spans.schema)), start_ms="start_time").select("span_id", "trace_id", "start_ms", "duration_ms")


@entry("B06_hydrate_logs", f"""
    SELECT tenant_id, ts_ms, source, level, message, raw_json FROM logs WHERE ts_ms >= {_CUT}
    UNION ALL SELECT tenant_id, ts_ms, source, 'INFO', message, '{{}}' FROM logs WHERE ts_ms < {_CUT}""")
def _(spark, sf):
    old, hot = B.archive_split(V.logs(spark, sf), _CUT)
    return as_ms(B.hydrate_logs(hot, old.drop("level", "raw_json"), NOW), ts_ms="timestamp")


@entry("B07_purge_old_rows", f"SELECT id, created_ms FROM incidents WHERE created_ms >= {V.ORDERS_NOW_MS} - 400 * CAST(86400000 AS BIGINT)")
def _(spark, sf):
    kept = B.purge_old_rows(V.incidents(spark, sf), "created_at", V.ORDERS_NOW_MS, 400)
    return as_ms(kept, created_ms="created_at").select("id", "created_ms")


_DAY = NOW - 5 * 86_400_000


@entry("B08_billing_meter", f"""
    SELECT t.id AS tenant_id, CAST({_DAY} AS BIGINT) AS day_ms, count(l.ts_ms) AS total_logs, CAST(coalesce(sum(strlen(l.message)), 0) AS BIGINT) AS total_bytes
    FROM tenants t LEFT JOIN logs l ON l.tenant_id = t.id AND l.ts_ms >= {_DAY} AND l.ts_ms < {_DAY} + 86400000 GROUP BY 1""")
def _(spark, sf):
    return B.billing_meter(V.logs(spark, sf), tenants(spark, sf), _DAY + 1234)


def baseline_rows(spark, sf):
    """Label means as clusters; label 0 plays the noise cluster."""
    from logspark.operators.vectors import centroids

    v = V.vectors(spark, sf)
    centers = centroids(v).withColumn("cluster_id", F.when(F.col("cluster_id") == 0, -1).otherwise(F.col("cluster_id")))
    clusters = centers.select("cluster_id", F.col("members").alias("size"), F.concat(F.lit("template "), s("cluster_id")).alias("representative_template"),
                              F.concat(F.lit("raw "), s("cluster_id")).alias("representative_raw"))
    return B.baseline_build(clusters, centers)


SQL_BASELINE = """SELECT label AS cluster_id, count(*) AS size, 'template ' || label AS representative_template, CAST(NULL AS VARCHAR) AS label, false AS is_acknowledged
    FROM (SELECT label FROM vecs WHERE label <> 0) GROUP BY label"""


@entry("B09_baseline_build", "SELECT count(DISTINCT label) AS cluster_count, count(*) AS logs_processed, 64 AS dim FROM vecs WHERE label <> 0")
def _(spark, sf):
    rows, meta = baseline_rows(spark, sf)
    path = scratch_path(spark, "baseline")
    B.write_baseline(rows, meta, path)
    back = B.read_baseline(spark, path)
    return back.agg(F.count("*").alias("cluster_count"), F.sum("size").alias("logs_processed"), F.max(F.size("vector")).alias("dim"))


def annotated(spark, sf):
    rows, _ = baseline_rows(spark, sf)
    updates = V.vectors(spark, sf).groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("n")).select(
        "cluster_id", F.when(F.col("cluster_id") % 2 == 1, F.concat(F.lit("label "), s("cluster_id"))).alias("label"),
        F.when(F.col("cluster_id") % 3 == 1, F.lit(True)).alias("is_acknowledged"))
    return B.baseline_annotate(rows, updates)


SQL_ANNOTATED = f"""SELECT cluster_id, size, representative_template, CASE WHEN cluster_id % 2 = 1 THEN 'label ' || cluster_id END AS label, cluster_id % 3 = 1 AS is_acknowledged
    FROM ({SQL_BASELINE})"""


@entry("B10_baseline_annotate", SQL_ANNOTATED)
def _(spark, sf):
    return annotated(spark, sf).select("cluster_id", "size", "representative_template", "label", "is_acknowledged")


@entry("B11_vector_append", "SELECT template, source, ts_ms FROM (SELECT template, arg_min(source, doc_id) AS source, min(doc_id) * 1000 AS ts_ms FROM norm GROUP BY template)")
def _(spark, sf):
    from logspark.functions.text import normalise
    from logspark.operators.aggregate import first_seen
    from logspark.operators.vectors import embed_templates

    docs = V.documents(spark, sf).select("doc_id", "source", normalise(F.col("text")).alias("template"), at_ms(F.col("doc_id") * 1000).alias("timestamp"))
    first = first_seen(docs, ("doc_id",), ("source", "timestamp"), F.col("template"))
    path = scratch_path(spark, "vectors")
    B.vector_append(embed_templates(docs, 64), first, path, NOW)
    return spark.read.parquet(path).select("template", "source", F.col("timestamp").alias("ts_ms"))
