import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logspark.functions.timing import DAY_MS, at_ms
from logspark.operators import aggregate as E, dashboard as D, intervals as I, relations as G, slo as J, storage as B, windows as H
from conftest import plan_of


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# --- templates, traces, metrics ---------------------------------------------------------------------


def test_dedupe(frame):
    df = frame([("a", "x", "f", i) for i in range(5)] + [("", "raw1", "f", 9), (None, "raw2", "f", 10)], "normalized_text string, raw_text string, source string, line_number int")
    assert rows(E.dedupe_templates(df), "template", "n") == [("a", 5), ("raw1", 1), ("raw2", 1)]
    assert rows(E.template_samples(df, 2), "template", "line_number") == [("a", 0), ("a", 1), ("raw1", 9), ("raw2", 10)]
    assert rows(E.first_seen(df, keep=("raw_text", "line_number")), "template", "line_number") == [("a", 0), ("raw1", 9), ("raw2", 10)]
    assert "WindowGroupLimit" in plan_of(E.template_samples(df, 2))


def test_histogram_widths():
    hour = 3_600_000
    assert [E.histogram_width_ms(1, 1 + h * hour) for h in (1, 24, 168, 169)] == [60_000, 900_000, hour, DAY_MS] and E.histogram_width_ms(None, 5) == hour


def test_histogram_counts_unlisted_levels(frame):
    df = frame([(1000, "ERROR"), (2000, None), (3000, "ODD")], "t long, level string").select(at_ms(F.col("t")).alias("timestamp"), "level", F.lit("s").alias("source"), F.lit("m").alias("message"), F.lit("{}").alias("raw_json"))
    (r,) = E.histogram(df).collect()
    assert (r["count"], r.ERROR, r.INFO) == (3, 1, 1)


def test_trace_root(frame):
    df = frame([("t", "b", "a", "s2", 5), ("t", "a", "", "s1", 9), ("u", "d", "gone", "s4", 2), ("u", "c", "gone", "s3", 1)], "trace_id string, span_id string, parent_span_id string, service_name string, t long").select(
        "*", F.lit("op").alias("operation_name"), at_ms(F.col("t")).alias("start_time"), at_ms(F.col("t") + 10).alias("end_time"), F.when(F.col("span_id") == "a", "STATUS_CODE_ERROR").otherwise("OK").alias("status_code"))
    assert rows(E.trace_summary(df), "trace_id", "root_service", "duration_ms", "error_count") == [("t", "s1", 14.0, 1), ("u", "s3", 11.0, 0)]


def test_many_rules_in_one_scan(frame):
    df = frame([(i * 1000, f'{{"v":{i}}}') for i in range(200)], "t long, raw_json string").select(
        at_ms(F.col("t")).alias("timestamp"), "raw_json", F.lit("1").alias("tenant_id"), F.lit("s").alias("source"), F.lit("E").alias("level"), F.concat(F.lit("n "), (F.col("t") / 1000).cast("long").cast("string"), F.lit(" end")).alias("message"))
    rules = [{"id": i, "query": f'"n {i} end"', "aggregation": "sum", "field": "v", "window_seconds": 60} for i in range(150)]
    assert rows(E.extract_metrics(df, rules), "rule_id", "value") == [(i, float(i)) for i in range(150)]


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "cluster_id int, size long, status string, label string, distance double, template string")
    assert E.noise_volume(none).first().noise_lines == 0 and D.resolved_gauge(none).first().ratio == 0.0
    assert E.anomaly_gate(none, "known").first().asDict() == {"worst_rank": -1, "worst_label": None, "failed": False}


# --- SLO --------------------------------------------------------------------------------------------


def slo_logs(spark, bad, total):
    return spark.range(total).select(
        at_ms(F.col("id") * 1000 + 10 * DAY_MS).alias("timestamp"), F.lit("api").alias("source"), F.when(F.col("id") < bad, "Error").otherwise("INFO").alias("level"), F.lit("{}").alias("raw_json"))


SLO = "id long, tenant_id string, name string, service string, sli_type string, target_percentage double, window_days int"


@pytest.mark.parametrize("bad, target, value, budget, remaining, status", [
    (5, 99.0, 99.5, 10, 5, "HEALTHY"), (10, 99.5, 99.0, 5, -5, "BREACHED"), (9, 99.0, 99.1, 10, 1, "WARNING"), (0, 99.0, 100.0, 10, 10, "HEALTHY"),
])
def test_slo_status(spark, frame, bad, target, value, budget, remaining, status):
    slos = frame([(1, "t", "n", "api", "availability", target, 7)], SLO)
    r = J.slo_status(slo_logs(spark, bad, 1000), slos, 11 * DAY_MS).first()
    assert (round(r.current_value, 6), r.error_budget_total, r.error_budget_remaining, r.status) == (value, budget, remaining, status)


def test_slo_without_events_and_decimals(spark, frame):
    slos = frame([(1, "t", "n", "none", "availability", 99.0, 7), (2, "t", "m", "api", "availability", 99.9, 7), (3, "t", "o", "api", "availability", 99.0, 1)], SLO)
    got = {r.id: r for r in J.slo_status(slo_logs(spark, 0, 1000), slos, 14 * DAY_MS).collect()}
    assert (got[1].current_value, got[1].status, got[1].burn_rate) == (100.0, "HEALTHY", 0.0)
    assert got[2].total_events == 1000 and got[3].total_events == 0  # windows of 7 days and of 1 day
    exact = {r.id: r.error_budget_total for r in J.slo_status(slo_logs(spark, 0, 1000), slos, 14 * DAY_MS, exact=True).collect()}
    assert got[2].error_budget_total == 0 and exact[2] == 1


def test_latency_rule(spark, frame):
    slos = frame([(1, "t", "n", "api", "latency", 50.0, 7)], SLO)
    logs = frame([('{"duration_ms":100}',), ('{"duration_ms":900}',), ('{"latency":900}',), ('{}',), ('{"duration_ms":900,"latency":1}',), ('{"duration_ms":900,"latency":900}',)], "raw_json string").select(
        at_ms(F.lit(10 * DAY_MS)).alias("timestamp"), F.lit("api").alias("source"), F.lit("INFO").alias("level"), "raw_json")
    assert J.slo_status(logs, slos, 11 * DAY_MS).first().good_events == 2
    assert J.slo_status(logs, slos, 11 * DAY_MS, compat=True).first().good_events == 5


def test_forecast(spark, frame):
    falling = [(1, i, 100.0 - 0.1 * i) for i in range(40)]
    short = [(2, i, 90.0) for i in range(9)]
    flat = [(3, i, 99.9) for i in range(20)]
    points = frame(falling + short + flat, "slo_id long, t long, value double").select("slo_id", at_ms(F.col("t") * 60_000).alias("timestamp"), "value")
    slos = frame([(i, "t", f"n{i}", "api", "availability", 95.0, 7) for i in (1, 2, 3)], SLO)
    got = {r.slo_id: r.steps_to_breach for r in J.slo_forecast(points, slos).collect()}
    assert got == {1: 12, 2: None, 3: None}  # the line is 100 - 0.1 h: 96.1 now, below 95.0 after 12 steps
    found = J.predictive_incidents(J.slo_forecast(points, slos), frame([("t", "other", "OPEN")], "tenant_id string, title string, status string"), 0).collect()
    assert [(r.title, r.steps_to_breach) for r in found] == [("Predictive Warning: n1 will breach soon", 12)]
    known = frame([("t", "Predictive Warning: n1 will breach soon", "OPEN")], "tenant_id string, title string, status string")
    assert J.predictive_incidents(J.slo_forecast(points, slos), known, 0).isEmpty()


# --- intervals --------------------------------------------------------------------------------------

EVENTS = "ts_ms long, cluster_id int, service string"


def brute_links(events, window):
    stats = {}
    for i, (t1, c1, s1) in enumerate(events):
        for t2, c2, s2 in events[i + 1 :]:
            if c1 < 0 or c2 < 0 or c1 == c2 or s1 == s2 or abs(t2 - t1) > window:
                continue
            delay = (t2 - t1) if c1 < c2 else (t1 - t2)
            stats.setdefault((min(c1, c2), max(c1, c2)), []).append(delay)
    return {k: (sum(d > 0 for d in v), sum(d < 0 for d in v), sum(d == 0 for d in v), sum(d for d in v if d > 0), -sum(d for d in v if d < 0)) for k, v in stats.items()}


def test_causal_cases(frame):
    names = frame([(0, "a", "t0"), (1, "b", "t1")], "cluster_id int, service string, template string")
    link = lambda ev: I.causal_links(frame(ev, EVENTS), names).collect()
    lag = [(t, 0, "a") for t in (1000, 5000, 9000)] + [(t + 50, 1, "b") for t in (1000, 5000, 9000)]
    (r,) = link(lag)
    confidence = round(math.exp(-0.008 * 50) * 0.4 + math.log(4) / math.log(10) * 0.4 + 0.2, 3)
    assert (r.source_cluster_id, r.target_cluster_id, r.avg_delay_ms, r.occurrences, r.confidence, r.source_service, r.direction) == (0, 1, 50.0, 3, confidence, "a", "Cluster 0 -> Cluster 1")
    assert link([(t + 600 * (c == 1), c, s) for t, c, s in [(1000, 0, "a"), (5000, 0, "a"), (400, 1, "b")]]) == []
    assert link([(t, c, "same") for t, c, _ in lag]) == [] and link([(t, 0, s) for t, _, s in lag]) == []
    (r,) = link([(t, 1 - c, s) for t, c, s in lag])
    assert (r.source_cluster_id, r.target_cluster_id, r.occurrences) == (1, 0, 3)


@pytest.mark.parametrize("seed", range(3))
def test_lag_statistics_equal_the_pairs(frame, seed):
    rnd = random.Random(seed)
    # a third of all events in one burst
    events = [(rnd.randint(0, 20_000) if i % 3 else 7000 + rnd.randint(0, 40), rnd.randint(-1, 4), f"s{rnd.randint(0, 2)}") for i in range(300)]
    expected = brute_links(events, 500)
    names = ("positive", "negative", "zero", "positive_ms", "negative_ms")
    df = frame(events, EVENTS)
    for stats in (I.lag_statistics(df, 500), I.lag_statistics(df, 500, slice_ms=700), I.pair_statistics(I.cooccurrences(df, 500))):
        assert {(r.c1, r.c2): tuple(r[n] for n in names) for r in stats.collect()} == expected


def test_cooccurrences_travel_once(spark, frame, monkeypatch):
    """Short batches, turns and slices, a burst, a missing service: the same pairs, without a join."""
    rnd = random.Random(5)
    events = [(rnd.randint(-900, 9000) if i % 3 else 700 + rnd.randint(0, 40), rnd.randint(-1, 4), rnd.choice(["a", "b", None])) for i in range(200)]
    want = Counter(
        (x[1], y[1], x[2], y[2], x[0], y[0], y[0] - x[0]) for x in events for y in events
        if 0 <= x[1] < y[1] and None not in (x[2], y[2]) and x[2] != y[2] and abs(x[0] - y[0]) <= 300)
    monkeypatch.setattr(I, "LISTED", 7)
    monkeypatch.setattr(I, "SLICE_WINDOWS", 2)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = I.cooccurrences(frame(events, EVENTS), 300)
        assert {tuple(r)[:7]: r.pairs for r in found.collect()} == want and "Join" not in plan_of(found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_no_nested_loops(frame):
    df = frame([(1, 0, "a")], EVENTS)
    for plan in (plan_of(I.cooccurrences(df)), plan_of(I.telemetry_context(
            frame([(1, "P0", 5)], "cluster_id int, priority string, representative_timestamp_ms long"), frame([(1, 1.0, 1.0, 1.0, 1.0, 1.0)], "timestamp long, cpu_percent double, memory_percent double, disk_iops double, network_drops double, network_errors double")))):
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_telemetry_window(frame):
    clusters = frame([(1, "P0", 2000), (-1, "P0", 2000), (2, "P3", 2000), (3, "P1", 0), (4, "P1", 900_000)], "cluster_id int, priority string, representative_timestamp_ms long")
    points = frame([(1000, 10.0), (2000, 99.0), (3000, 20.0), (None, 1.0)], "timestamp long, cpu_percent double").select(
        "*", *[F.lit(1.0).alias(c) for c in ("memory_percent", "disk_iops", "network_drops", "network_errors")])
    got = {r.cluster_id: (r.status, r.peak_cpu, r.points) for r in I.telemetry_context(clusters, points, 500).collect()}
    assert got == {1: ("correlated", 99.0, 1), -1: ("skipped_noise", None, 0), 2: ("skipped_non_incident", None, 0), 3: ("no_timestamp", None, 0), 4: ("no_data_in_window", 0.0, 0)}
    assert I.telemetry_context(clusters, points.limit(0), 500).where("cluster_id = 1").first().status == "no_telemetry_available"


def test_as_of(frame):
    rnd = random.Random(5)
    points = [(rnd.randint(0, 10_000_000), float(rnd.randint(0, 99))) for _ in range(200)] + [(3, None)]
    probes = [(i, rnd.randint(-10, 12_000_000)) for i in range(200)]
    got = {r.i: r.v for r in I.as_of_before(frame(probes, "i int, p long"), frame(points, "t long, v double"), "p", "t", "v", 600_000).collect()}
    for i, p in probes:
        before = sorted((t, v) for t, v in points if v is not None and t < p)
        assert got[i] == (before[-1][1] if before else None)


# --- ordered ----------------------------------------------------------------------------------------


def test_rate_limit(frame):
    rnd = random.Random(1)
    req = [("hot" if i % 3 else f"c{i % 7}", rnd.randint(0, 400_000)) for i in range(600)]
    got = {(r.client, r.t): r.in_window for r in H.request_rates(frame(req, "client string, t long"), 60_000).collect()}
    assert got == {(c, t): sum(1 for d, u in req if d == c and t - 60_000 < u <= t) for c, t in req}
    over = frame([("a", i) for i in range(101)] + [("b", i) for i in range(100)], "client string, t long")
    assert [(r.client, r.t) for r in H.rate_limit_violations(over).collect()] == [("a", 100)]


@pytest.mark.parametrize("seed", range(3))
def test_suppression(frame, seed):
    rnd = random.Random(seed)
    alerts = [("hot" if i % 3 else f"f{i % 5}", rnd.choice([rnd.randint(0, 40_000), rnd.randint(0, 400) * 100])) for i in range(400)]
    expected, last = set(), {}
    for fp, t in sorted(set(alerts)):
        if fp not in last or t - last[fp] >= 1000:
            expected.add((fp, t))
            last[fp] = t
    got = H.suppress_repeats(frame(alerts, "fingerprint string, ts_ms long"), 1000).collect()
    assert {(r.fingerprint, r.ts_ms) for r in got if r.fired} == expected and sum(r.n for r in got) == len(alerts)


def test_open_incidents(frame):
    marks = [("t", "s", "x", 10, False, "one"), ("t", "s", "x", 20, False, "two"), ("t", "s", "x", 30, True, None), ("t", "s", "x", 40, False, "three"), ("t", "s", "y", 5, True, None), ("t", "s", "y", 6, False, "only")]
    df = frame(marks, "tenant_id string, service string, title string, ts_ms long, resolved boolean, summary string")
    got = rows(H.open_incident_dedup(df, block_ms=15), "title", "created_ms", "summary", "breaches", "status")
    assert got == [("x", 10, "two", 2, "RESOLVED"), ("x", 40, "three", 1, "OPEN"), ("y", 6, "only", 1, "OPEN")]


def test_span_depth(frame):
    chain = [("t", f"s{i}", f"s{i - 1}" if i else None) for i in range(40)]
    odd = [("t", "lost", "gone"), ("t", "kid", "lost"), ("u", "s1", None), ("c", "x", "y"), ("c", "y", "x"), ("t", "e", "")]
    got = {(r.trace_id, r.span_id): r.depth for r in G.span_depth(frame(chain + odd, "trace_id string, span_id string, parent_span_id string")).collect()}
    assert all(got["t", f"s{i}"] == i for i in range(40))
    assert (got["t", "lost"], got["t", "kid"], got["u", "s1"], got["c", "x"], got["c", "y"], got["t", "e"]) == (1, 2, 0, None, None, 0)


# --- routing, storage -------------------------------------------------------------------------------


@pytest.mark.parametrize("alert, least, status", [("P0", "P0", "deliver"), ("P1", "P0", "skipped"), ("P1", "P2", "deliver"), ("P3", "P3", "deliver"), ("P3", "P2", "skipped"), ("P9", "P3", "skipped"), ("P0", "??", "deliver")])
def test_routing(frame, alert, least, status):
    alerts = frame([("src", "r", alert, 1)], "source string, run_id string, priority string, cluster_id int")
    targets = frame([("d", "slack", "u", least, True), ("off", "slack", "u", "P3", False)], "id string, channel_type string, url string, min_priority string, enabled boolean")
    assert rows(G.route_alerts(alerts, targets), "webhook_id", "status") == [("d", status)]


def test_payloads(frame):
    alerts = frame([("api", "r1", "P0", 3, "s" * 200, "log " * 200, 0.98765)], "source string, run_id string, priority string, cluster_id int, cluster_summary string, representative_log string, anomaly_score double").withColumn(
        "causal_links", F.array(F.struct(F.lit("a").alias("source_service"), F.lit("b").alias("target_service"), F.lit(0.9).alias("confidence"), F.lit(12.0).alias("avg_delay_ms")))).withColumn("hints", F.array(*[F.lit(h) for h in "abcd"]))
    targets = frame([(c, c, "u", "P3", True) for c in ("slack", "pagerduty", "teams", "generic")], "id string, channel_type string, url string, min_priority string, enabled boolean")
    body = {r.channel_type: json.loads(r.body) for r in G.alert_payloads(G.route_alerts(alerts, targets)).collect()}
    blocks = [b["type"] for b in body["slack"]["blocks"]]
    assert blocks == ["header", "section", "divider", "section", "section", "section", "section", "context"]
    assert "- a > b: 90%, 12 ms" in body["slack"]["blocks"][6]["text"]["text"] and body["slack"]["blocks"][5]["text"]["text"].endswith("- a\n- b\n- c\n- d")
    page = body["pagerduty"]
    assert page["payload"]["severity"] == "critical" and page["payload"]["summary"].endswith(" " + "s" * 200) and page["payload"]["custom_details"]["representative_log"] == "log " * 200
    short = {r.channel_type: json.loads(r.body) for r in G.alert_payloads(G.route_alerts(alerts, targets), log_chars=10, hints=1).collect()}
    assert short["pagerduty"]["payload"]["custom_details"]["representative_log"] == "log log lo" and short["slack"]["blocks"][5]["text"]["text"].endswith("- a")
    assert body["teams"]["sections"][0]["facts"][1]["value"] == "0.988" and body["generic"]["fingerprint"] == page["dedup_key"] and body["generic"]["cluster_id"] == 3


def test_runbooks(frame):
    incidents = frame([(1, "a", "Disk FULL", "P0"), (2, "a", "net", "P1"), (3, "b", "disk", "P0")], "id long, tenant_id string, title string, severity string")
    books = frame([(10, "a", "disk", None, True), (11, "a", None, "P1", True), (12, "a", None, None, False), (13, "b", "disk", "P1", True)], "id int, tenant_id string, keyword string, severity string, enabled boolean")
    assert rows(G.match_runbooks(incidents, books), "incident_id", "runbook_id") == [(1, 10), (2, 11)]


def test_archive_round_trip(spark, frame, tmp_path):
    now = 20 * DAY_MS
    spans = frame([("old", 9), ("new", 19)], "span_id string, d long").select("span_id", at_ms(F.col("d") * DAY_MS).alias("start_time"), F.lit(1.5).alias("duration_ms"))
    old, hot = B.archive_split(spans, now - 7 * DAY_MS, "start_time")
    B.write_archive(old, str(tmp_path / "a"))
    back = B.read_archive(spark, str(tmp_path / "a"), spans.schema)
    once = B.hydrate_spans(hot, back)
    assert rows(once, "span_id") == rows(B.hydrate_spans(once, back), "span_id") == [("new",), ("old",)]
    assert {r.span_id: r.start_time for r in once.collect()} == {r.span_id: r.start_time for r in spans.collect()}


def test_retention_and_billing(spark, frame, tmp_path):
    now = 100 * DAY_MS
    logs = frame([(t, d, "é") for t in ("f", "p", "e", "?") for d in (1, 20, 60, 95)], "tenant_id string, age int, message string").select("tenant_id", "age", at_ms(F.lit(now) - F.col("age").cast("long") * DAY_MS).alias("timestamp"), "message")
    tenants = frame([("f", "free"), ("p", "pro"), ("e", "enterprise"), ("idle", "free")], "id string, tier string")
    assert rows(B.apply_retention(logs, tenants, now), "tenant_id", "age") == sorted([("f", 1), ("p", 1), ("p", 20), ("e", 1), ("e", 20), ("e", 60), ("?", 1), ("?", 20), ("?", 60), ("?", 95)])
    path = str(tmp_path / "bill")
    for _ in range(2):  # a second run replaces the day
        B.write_billing(B.billing_meter(logs, tenants, now - DAY_MS), path)
    assert rows(spark.read.parquet(path), "tenant_id", "total_logs", "total_bytes") == [("e", 1, 2), ("f", 1, 2), ("idle", 0, 0), ("p", 1, 2)]


def test_skewed_tenant_is_spread(spark, tmp_path):
    """A tenant with most rows of one day is written by many tasks."""
    df = spark.range(40_000).select(F.lit("big").alias("tenant_id"), at_ms(F.col("id")).alias("timestamp"), F.concat(F.lit("s"), (F.col("id") % 50).cast("string")).alias("source"), F.lit("INFO").alias("level"), F.lit("m").alias("message"), F.lit("{}").alias("raw_json"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        B.write_logs(df, str(tmp_path / "w"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = B.read_stored(spark, str(tmp_path / "w"))
    assert back.select(F.input_file_name()).distinct().count() > 1 and back.count() == 40_000


DAY = 86_400_000


def stored_days(spark, frame, path):
    rows = [(t, d * DAY + h * 3_600_000, "svc", "INFO", f"m{d}") for t in ("1", "2") for d in range(10, 15) for h in (1, 13)]
    logs = frame(rows, "tenant_id string, ms long, source string, level string, message string").withColumn("timestamp", F.timestamp_millis("ms")).withColumn("raw_json", F.lit("{}"))
    B.write_logs(logs.drop("ms"), path)
    return B.read_stored(spark, path)


def test_prune_drops_days_and_rewrites_the_boundary(spark, frame, tmp_path):
    path = str(tmp_path / "logs")
    stored_days(spark, frame, path)
    assert B.prune_table(spark, path, 12 * DAY + 6 * 3_600_000, tenant="1") == 3
    left = sorted((r.tenant_id, r.message) for r in B.read_stored(spark, path).collect())
    assert left == sorted([("1", "m12")] + [("1", m) for m in ("m13", "m14") for _ in (0, 1)] + [("2", f"m{d}") for d in range(10, 15) for _ in (0, 1)])
    tiers = frame([("1", "pro"), ("2", "free")], "id string, tier string")
    B.retain(spark, path, tiers, 20 * DAY)  # 7 days for the free tier
    assert sorted({(r.tenant_id, r.message) for r in B.read_stored(spark, path).collect()}) == [("1", "m12"), ("1", "m13"), ("1", "m14"), ("2", "m13"), ("2", "m14")]
    assert B.archive_table(spark, path, str(tmp_path / "old"), 14 * DAY) == 3
    assert B.read_stored(spark, path).count() == 4 and spark.read.json(str(tmp_path / "old")).count() == 5


def test_prune_with_rows_without_time_and_escaped_tenants(spark, frame, tmp_path):
    path = str(tmp_path / "logs")
    rows = [("a:b/c", 10 * DAY), ("a:b/c", 12 * DAY), ("a:b/c", None), ("d", 10 * DAY)]
    logs = frame(rows, "tenant_id string, ms long").select("tenant_id", F.lit("s").alias("source"), F.lit("m").alias("message"), F.timestamp_millis("ms").alias("timestamp"))
    B.write_logs(logs, path)
    assert B.prune_table(spark, path, 11 * DAY, tenant="a:b/c") == 1
    left = [(r.tenant_id, r.ms) for r in B.read_stored(spark, path).select("tenant_id", F.unix_millis("timestamp").alias("ms")).collect()]
    assert Counter(left) == Counter([("a:b/c", 12 * DAY), ("a:b/c", None), ("d", 10 * DAY)])


def test_archive_survives_lost_jobs(spark, frame, tmp_path, monkeypatch):
    """Lost before every second of its moves and deletions in turn, the job is completed by the next call: every row stays, once."""
    cut = 12 * DAY + 6 * 3_600_000
    whole = {n: getattr(B.Files, n) for n in ("move", "delete")}
    done = False
    lost = 1  # 3 and 7: a boundary day is taken out, what stays of it is not back yet
    while not done:
        path, old = str(tmp_path / f"hot{lost}"), str(tmp_path / f"old{lost}")
        before = stored_days(spark, frame, path)
        expected = Counter((r.tenant_id, r.ms) for r in before.select("tenant_id", F.unix_millis("timestamp").alias("ms")).collect())
        left = [lost]

        def failing(name):
            def run(self, *args):
                left[0] -= 1
                if left[0] < 0:
                    raise OSError("lost")
                return whole[name](self, *args)

            return run

        for name in whole:
            monkeypatch.setattr(B.Files, name, failing(name))
        try:
            B.archive_table(spark, path, old, cut)
            done = True
        except OSError:
            pass
        for name in whole:
            monkeypatch.setattr(B.Files, name, whole[name])
        for _ in range(2):
            B.archive_table(spark, path, old, cut)
        hot = Counter((r.tenant_id, r.ms) for r in B.read_stored(spark, path).select("tenant_id", F.unix_millis("timestamp").alias("ms")).collect())
        cold = Counter((r.tenant_id, r.ms) for r in B.read_archive(spark, old, before.drop("date").schema).select("tenant_id", F.unix_millis("timestamp").alias("ms")).collect())
        assert hot == Counter({k: n for k, n in expected.items() if k[1] >= cut}) and cold == expected - hot
        lost += 2
    assert lost > 9


def test_no_metric_rules_no_metrics(frame):
    logs = frame([("t", "s", "INFO", "m", "{}", 1)], "tenant_id string, source string, level string, message string, raw_json string, ms long").withColumn("timestamp", F.timestamp_millis("ms"))
    for rules in ([], [{"id": 1, "query": "m", "enabled": False}]):
        assert E.extract_metrics(logs, rules).collect() == []


def test_windows_reach_the_partitions(spark, frame, tmp_path):
    logs = stored_days(spark, frame, str(tmp_path / "logs"))
    slos = frame([(1, "1", "n", "svc", "availability", 99.0, 2)], "id long, tenant_id string, name string, service string, sli_type string, target_percentage double, window_days int")
    monitors = [{"id": 1, "name": "m", "query": "level:INFO", "threshold_critical": 5, "window_seconds": 86_400}]
    for df in (J.slo_status(logs, slos, 15 * DAY), J.evaluate_monitors(logs, monitors, 15 * DAY), B.archive_split(logs, 12 * DAY)[0], B.billing_meter(logs, frame([("1", "pro")], "id string, tier string"), 12 * DAY)):
        assert re.search(r"PartitionFilters: \[[^\]]*date", plan_of(df))
    assert [(r.matches, r.state) for r in J.evaluate_monitors(logs, monitors, 15 * DAY).collect()] == [(4, "OK")]
    assert J.evaluate_monitors(logs, [], 0).count() == 0
