import json

import pytest
from pyspark.sql import functions as F

from logspark.functions.timing import extract_timestamp_ms
from logspark.sources import files as A
from logspark.sources.kernel import kernel_events_to_ecs
from logspark.sources.otlp import flatten_otlp_logs, flatten_otlp_spans
from logspark.sources.records import resolve_source, to_log_table

NOW = 1_779_000_000_000  # 2026-05-17


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_text_logs(spark, tmp_path):
    write(tmp_path / "a.log", "one\n\n  two  \n" + "x" * 30)
    write(tmp_path / "sub" / "b.txt", b"bad \xff byte\n")
    write(tmp_path / "c.bin", "ignored\n")
    rows = A.read_text_logs(spark, str(tmp_path), max_len=10, line_numbers=True).collect()
    got = {(r.source.rsplit("/", 1)[1], r.line_number, r.raw_text) for r in rows}
    assert got == {("a.log", 1, "one"), ("a.log", 3, "two"), ("a.log", 4, "x" * 10), ("b.txt", 1, "bad � byte")}


def test_line_numbers_over_splits(spark, tmp_path):
    """A file cut into many splits still counts lines through."""
    write(tmp_path / "big.log", "".join(f"line {i}\n" + ("\n" if i % 3 == 0 else "") for i in range(1, 3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = A.read_text_logs(spark, str(tmp_path), line_numbers=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected, at = {}, 0
    for i in range(1, 3000):
        at += 1
        expected[f"line {i}"] = at
        at += i % 3 == 0
    assert {r.raw_text: r.line_number for r in rows} == expected


def test_json_logs(spark, tmp_path):
    long = json.dumps({"message": "m" * 50, "pad": "p" * 100})
    write(tmp_path / "a.jsonl", '{"message":"structured failure","level":"ERROR"}\nnot-json\n{"msg":"hello"}\n\n{"x":1}\n[1]\n' + long + "\n")
    rows = {r.raw_text: r.metadata for r in A.read_json_logs(spark, str(tmp_path), max_len=20).collect()}
    assert rows["structured failure"].startswith("{") and rows["not-json"] is None and rows["[1]"] is None
    assert set(rows) == {"structured failure", "not-json", "hello", '{"x":1}', "[1]", "m" * 20}


def test_sniff(frame):
    rows = A.sniff_json_lines(frame([('{"message":"a"}',), ("{broken}",), ('{"message":"a"} tail',)], "line string"), "line").collect()
    assert [r.raw_text for r in rows] == ["a", "{broken}", '{"message":"a"} tail']


def test_plain_logs(frame):
    df = frame([("2026-05-29T10:15:00Z INFO [acme-payment-gateway] Payment request received.",), ("2026-13-29T10:15:00Z info [a] b",), ("free text",)], "line string")
    a, b, c = A.parse_plain_logs(df, "line").withColumn("ms", F.unix_millis("timestamp")).collect()
    assert (a.ms, a.level, a.source, a.message) == (1_780_049_700_000, "INFO", "acme-payment-gateway", "Payment request received.")
    assert (b.ms, b.level, b.source) == (None, "INFO", "a") and (c.level, c.source, c.message) == (None, None, "free text")


def test_mixed_logs(spark, tmp_path):
    write(tmp_path / "app.log", '{"timestamp":1716000000,"level":"ERROR","message":"j","tenant_id":"t1"}\n2024-05-18T02:40:01Z INFO [svc] p\nplain\n')
    rows = A.read_mixed_logs(spark, str(tmp_path)).collect()
    assert [(r.message, r.source, r.level, r._file) for r in rows] == [("p", "svc", "INFO", "app.log"), ("j", "app", "ERROR", "app.log"), ("plain", "app", None, "app.log")]
    assert [r.message for r in A.read_mixed_logs(spark, str(tmp_path), tenant="t1").collect()] == ["j"]
    assert {r.message for r in A.read_mixed_logs(spark, str(tmp_path), "app.log", to_ms=1_716_000_000_000).collect()} == {"j", "plain"}


def test_union_sources(spark, frame, tmp_path):
    write(tmp_path / "web.log", "x\n")
    assert [r.source_label for r in A.read_sources(spark, [str(tmp_path / "web.log"), str(tmp_path / "gone")]).collect()] == ["web"]
    with pytest.raises(ValueError):
        A.union_sources([], [])


STAMPS = {
    "2026-05-22T23:25:51.123Z ready": 1_779_492_351_123,
    "2026-05-22 23:25:51 naive": 1_779_492_351_000,
    "2026/05/22 23:25:51,456 slashes": 1_779_492_351_456,
    "2026-05-22T23:25:51+05:30 offset": 1_779_492_351_000 - 19_800_000,
    "1715934500.123 tick": 1_715_934_500_123,
    "1715934500123 tick": 1_715_934_500_123,
    "May  2 23:25:51 host": 1_777_764_351_000,
    "Dec 24 10:00:00 host": 1_766_570_400_000,  # would be ahead: last year
    "auth-service-1  | 2026-05-22T23:25:51Z up": 1_779_492_351_000,
    "2026-02-30T00:00:00Z impossible": None,
    "no time": None,
    "": None,
    "x" * 60 + " 1715934500123 too far right": None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps(spark, frame, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = frame([(k,) for k in STAMPS], "line string").select("line", extract_timestamp_ms(F.col("line"), NOW).alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r.line: r.t for r in rows} == STAMPS


SOURCES = {
    '{"source":"a"}': "a", '{"service":"b"}': "b", '{"service_name":"c"}': "c", '{"service.name":"d"}': "d", '{"container_name":"e"}': "e", '{"app":"f"}': "f", '{"logger_name":"g"}': "g",
    '{"kubernetes":{"container_name":"h"}}': "h", '{"kubernetes":{"labels":{"app":"i"}}}': "i", '{"service":{"name":"j"}}': "j", '{"service":"   ","app":"k"}': "k", '{"source":" l "}': "l",
    '{"service":42}': "42", '{"service":{"x":1}}': "unknown", '{"source":["z"]}': "unknown", "{}": "unknown", '{"source":null,"app":"m"}': "m", '{"source":"first","service":"second"}': "first",
}


def test_resolve_source(frame):
    rows = frame([(k,) for k in SOURCES], "j string").select("j", resolve_source(F.parse_json("j")).alias("s")).collect()
    assert {r.j: r.s for r in rows} == SOURCES


def test_log_table(frame):
    df = frame([('{"timestamp":1716000000.5,"service":"a","level":"WARN","message":"m"}',), ('{"timestamp":"2024-05-18T02:40:00Z"}',), ("junk",)], "v string")
    a, b, c = to_log_table(df, "v", 7, NOW).withColumn("ms", F.unix_millis("timestamp")).collect()
    assert (a.tenant_id, a.ms, a.source, a.level, a.message) == ("7", 1_716_000_000_500, "a", "WARN", "m")
    assert (b.ms, b.level, b.message) == (1_716_000_000_000, "INFO", b.raw_json) and (c.ms, c.source, c.message) == (NOW, "unknown", "junk")


def _otlp_span(**extra):
    span = {"traceId": "t", "spanId": "s", "name": "op", "startTimeUnixNano": "1716000000000000000", "endTimeUnixNano": "1716000000250000000",
            "attributes": [{"key": "n", "value": {"intValue": "5"}}, {"key": "b", "value": {"boolValue": True}}],
            "events": [{"name": "e", "timeUnixNano": "1716000000100000000", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}], **extra}
    return json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [span]}]}]})


def test_otlp_spans(frame):
    docs = frame([(_otlp_span(status={"code": 2}),), (_otlp_span(status={"code": "STATUS_CODE_ERROR"}, parentSpanId="p"),), (_otlp_span(),), ("{}",)], "b string")
    a, b, c = flatten_otlp_spans(docs, "b", NOW).collect()
    assert (a.status_code, b.status_code, c.status_code) == ("ERROR", "ERROR", "OK") and b.parent_span_id == "p" and a.parent_span_id is None
    assert a.duration_ms == 250.0 and a.service_name == "svc" and a.attributes == {"n": "5", "b": "true"} and a.events[0].attributes == {"k": "v"}
    raw = flatten_otlp_spans(docs, "b", NOW, "raw").collect()
    assert [r.status_code for r in raw] == ["2", "STATUS_CODE_ERROR", "STATUS_CODE_UNSET"]
    no_end = flatten_otlp_spans(frame([(_otlp_span(endTimeUnixNano=None),)], "b string"), "b", NOW, "raw").first()
    assert no_end.duration_ms == 0.0


def test_otlp_logs(frame):
    record = {"timeUnixNano": "1716000000123000000", "severityText": "warn", "body": {"stringValue": "hi"}, "attributes": [{"key": "a", "value": {"stringValue": "1"}}]}
    doc = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [record, {"body": {"boolValue": True}}, {"body": {"intValue": "9"}}]}]}]})
    a, b, c = flatten_otlp_logs(frame([(doc,)], "b string"), "b", NOW).withColumn("ms", F.unix_millis("timestamp")).collect()
    assert (a.ms, a.source, a.level, a.message, a.attributes) == (1_716_000_000_123, "unknown_service", "WARN", "hi", {"a": "1"})
    assert (b.ms, b.level, b.message, c.message) == (NOW, "INFO", '{"boolValue":true}', "9")


def test_telemetry_and_kernel(spark, frame, tmp_path):
    write(tmp_path / "t.json", '{"timestamp":5,"cpu_percent":1}\n{"timestamp":"x"}\n{"timestamp":-1}\n{"cpu_percent":2}\n')
    assert [r.timestamp for r in A.read_telemetry(spark, str(tmp_path)).collect()] == [5]
    df = frame([(1000, 1, 7, "x", None, "tcp"), (2000, 2, 8, "bash\x00junk", "/bin/bash\x00", None), (1, 3, 1, "", None, None)],
               "timestamp long, event_type int, pid int, comm string, filename string, protocol string")
    drop, start = kernel_events_to_ecs(df).collect()
    assert drop.event.action == "drop" and drop.network.transport == "tcp" and drop.process is None
    assert start.event.category == "process" and start.process.name == "bash" and start.process.executable == "/bin/bash" and start.network is None


def test_inventory(spark, tmp_path):
    write(tmp_path / "a.log", "1\n2\n\n3")
    write(tmp_path / "settings.json", "{}")
    (row,) = A.source_inventory(spark, str(tmp_path)).collect()
    assert (row["name"], row.size_bytes, row["size"], row.lines) == ("a.log", 6, "6 B", 4)
