"""Group-bys over logs, templates, traces, runs and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.search import search_condition
from logspark.functions.text import mask_pattern
from logspark.functions.timing import DAY_MS, HOUR_MS, MINUTE_MS, bucket, ms
from logspark.operators.filters import log_search, tenant_scope, time_between
from logspark.sources.otlp import is_error

LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL")
# Anomaly labels, harmless first.
ANOMALY_LABELS = ("known", "rare_known", "new_pattern", "high_risk_anomaly")
# Trace latency buckets (name, from ms, below ms).
LATENCY_BUCKETS = (
    ("0-50ms", 0, 50), ("50-200ms", 50, 200), ("200-500ms", 200, 500), ("500-1s", 500, 1000), (">1s", 1000, None),
)


def pattern_counts(df: DataFrame, limit: int = 100, column: str = "message") -> DataFrame:
    """Most frequent masked messages."""
    counted = df.groupBy(mask_pattern(F.col(column)).alias("pattern")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "pattern").limit(limit)


def facets(df: DataFrame, k: int = 20) -> DataFrame:
    """Top values of source and level -> ``facet, value, count, rank``.

    One scan counts (source, level); both facets are folded out of that small table.
    """
    pairs = df.groupBy(
        F.coalesce("source", F.lit("unknown")).alias("source"), F.coalesce("level", F.lit("INFO")).alias("level")
    ).agg(F.count("*").alias("n"))
    entries = pairs.select(
        F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("level"), F.col("level"))).alias("facet", "value"), "n"
    )
    totals = entries.groupBy("facet", "value").agg(F.sum("n").alias("count"))
    best = W.partitionBy("facet").orderBy(F.col("count").desc(), "value")
    return totals.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def histogram_width_ms(from_ms: int | None, to_ms: int | None) -> int:
    """Bucket width that fits the asked range; one hour when the range is open."""
    if not (from_ms and to_ms):
        return HOUR_MS
    hours = (to_ms - from_ms) / HOUR_MS
    if hours <= 1:
        return MINUTE_MS
    if hours <= 24:
        return 15 * MINUTE_MS
    return HOUR_MS if hours <= 24 * 7 else DAY_MS


def histogram(
    df: DataFrame, query: str = "", from_ms: int | None = None, to_ms: int | None = None,
    levels: Sequence[str] = LEVELS, mode: str = "strict",
) -> DataFrame:
    """Counts per time bucket, total and per level, in one aggregation with fixed columns."""
    rows = time_between(log_search(df, query, mode), from_ms, to_ms)
    start = bucket(ms(F.col("timestamp")), histogram_width_ms(from_ms, to_ms)).alias("bucket_ms")
    level = F.coalesce(F.nullif(F.col("level"), F.lit("")), F.lit("INFO"))
    return (
        rows.where(F.col("timestamp").isNotNull())
        .groupBy(start)
        .agg(F.count("*").alias("count"), *[F.count_if(level == name).alias(name) for name in levels])
        .orderBy("bucket_ms")
    )


def template_key(normalised: str = "normalized_text", raw: str = "raw_text") -> Column:
    """The template of a record; empty templates fall back to the raw text."""
    return F.coalesce(F.nullif(F.col(normalised), F.lit("")), F.col(raw))


def dedupe_templates(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Occurrences per template."""
    return df.groupBy((template_key() if key is None else key).alias("template")).agg(F.count("*").alias("n"))


def template_samples(df: DataFrame, n: int = 100, order: Sequence[str] = ("source", "line_number"), key: Column | None = None) -> DataFrame:
    """First n records per template in read order.

    The rank limit is applied before the shuffle too, so a hot template sends at most n rows per task.
    """
    keyed = df.withColumn("template", template_key() if key is None else key)
    ranked = keyed.withColumn("sample", F.row_number().over(W.partitionBy("template").orderBy(*order)))
    return ranked.where(F.col("sample") <= n)


def first_seen(df: DataFrame, order: Sequence[str] = ("source", "line_number"), keep: Sequence[str] = ("raw_text", "source", "line_number", "timestamp"), key: Column | None = None) -> DataFrame:
    """First record per template, by aggregation (no sort, no window)."""
    first = F.min_by(F.struct(*keep), F.struct(*order))
    grouped = df.groupBy((template_key() if key is None else key).alias("template")).agg(first.alias("_first"))
    return grouped.select("template", *[F.col(f"_first.{c}").alias(c) for c in keep])


def run_summary(templates: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: raw_lines, templates, clusters, reduction_ratio = 1 - clusters / lines."""
    one = templates.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw_lines"), F.count("*").alias("templates"))
    out = one.withColumn("clusters", clusters.agg(F.count("*")).scalar())
    ratio = F.coalesce(1 - F.try_divide(F.col("clusters"), F.col("raw_lines")), F.lit(0.0))
    return out.withColumn("reduction_ratio", ratio)


def _root(spans_field: str = "service_name") -> Column:
    order = F.struct(F.nullif(F.col("parent_span_id"), F.lit("")).isNotNull(), F.col("start_time"), F.col("span_id"))
    return F.min_by(F.col(spans_field), order)


def trace_summary(spans: DataFrame, from_ms: int | None = None, to_ms: int | None = None, limit: int | None = None) -> DataFrame:
    """Per trace: root service and operation, start, duration, span and error counts, newest first.

    The root is the span without a parent, else the earliest one.
    """
    grouped = time_between(spans, from_ms, to_ms, "start_time").groupBy("trace_id").agg(
        _root("service_name").alias("root_service"), _root("operation_name").alias("root_operation"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.count("*").alias("span_count"), F.count_if(is_error(F.col("status_code"))).alias("error_count"),
    )
    length = F.greatest(F.lit(0), ms(F.col("end_time")) - ms(F.col("start_time"))).cast("double")
    out = grouped.withColumn("duration_ms", length)
    return out if limit is None else out.orderBy(F.col("start_time").desc(), "trace_id").limit(limit)


def trace_detail(spans: DataFrame, trace_id: str) -> DataFrame:
    """All spans of one trace by start, with the trace's root, duration and error count."""
    own = spans.where(F.col("trace_id") == trace_id)
    head = trace_summary(own).select(
        "trace_id", "root_service", "root_operation", F.col("duration_ms").alias("trace_duration_ms"), "span_count", "error_count"
    )
    return own.join(head, "trace_id").orderBy("start_time", "span_id")


def trace_latency_distribution(traces: DataFrame) -> DataFrame:
    """Traces per fixed latency bucket; empty buckets stay."""
    d = F.col("duration_ms")
    counts = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("bucket"),
            F.count_if((d >= low) & (F.lit(True) if high is None else d < high)).alias("count"),
        )
        for i, (name, low, high) in enumerate(LATENCY_BUCKETS)
    ]
    return traces.agg(F.array(*counts).alias("b")).select(F.inline("b"))


def metric_matches(logs: DataFrame, rules: Sequence[dict], mode: str = "strict") -> DataFrame:
    """Every (rule, matching row) once -> ``rule_id, bucket_ms, value``; all rules in one scan.

    A rule is ``id, query, window_seconds`` and optionally ``tenant_id, field, enabled``.
    """
    stamp = ms(F.col("timestamp"))
    hits = []
    for rule in rules:
        if not rule.get("enabled", True):
            continue
        condition = search_condition(rule["query"], mode)
        if rule.get("tenant_id") is not None:
            condition = condition & (F.col("tenant_id") == str(rule["tenant_id"]))
        field = rule.get("field")
        value = F.get_json_object("raw_json", f"$.{field}").try_cast("double") if field else F.lit(None).cast("double")
        hit = F.struct(
            F.lit(rule["id"]).alias("rule_id"),
            bucket(stamp, int(rule.get("window_seconds", 60)) * 1000).alias("bucket_ms"),
            value.alias("value"),
        )
        hits.append(F.when(condition, hit))
    if not hits:
        return logs.sparkSession.createDataFrame([], "rule_id long, bucket_ms long, value double")
    # expressions are compiled per chunk, so that many rules do not overflow one generated method
    chunks = [F.array(*hits[i : i + 100]) for i in range(0, len(hits), 100)]
    every = chunks[0] if len(chunks) == 1 else F.concat(*chunks)
    return logs.select(F.explode(F.filter(every, lambda h: h.isNotNull())).alias("h")).select("h.*")


def metric_value(aggregation: str) -> Column:
    """Aggregate of a rule; everything but count works on the named field."""
    if aggregation == "count":
        return F.count("*").cast("double")
    return {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min}[aggregation]("value")


def extract_metrics(logs: DataFrame, rules: Sequence[dict], mode: str = "strict", since_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Per rule and window: the rule's aggregate over all matching rows between the bounds (pushed to the scan)."""
    logs = time_between(logs, since_ms, to_ms)
    kinds = sorted({r.get("aggregation", "count") for r in rules if r.get("enabled", True)})
    if not kinds:
        return metric_matches(logs, rules, mode)  # an empty table
    grouped = metric_matches(logs, rules, mode).groupBy("rule_id", "bucket_ms").agg(
        *[metric_value(k).alias(k) for k in kinds]
    )
    chosen = F.lit(None).cast("double")
    for kind in kinds:
        ids = [r["id"] for r in rules if r.get("aggregation", "count") == kind]
        chosen = F.when(F.col("rule_id").isin(ids), F.col(kind)).otherwise(chosen)
    return grouped.select("rule_id", "bucket_ms", chosen.alias("value"))


def metric_series(points: DataFrame, rule_id: int, tenant: str | None = None) -> DataFrame:
    """Samples of one rule in time order."""
    rows = points.where(F.col("rule_id") == rule_id)
    if tenant is not None:
        rows = tenant_scope(rows, tenant, allow_null=True)
    return rows.orderBy("bucket_ms")


def run_history(runs: DataFrame, incidents: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs newest first with one linked incident each (the earliest id)."""
    linked = incidents.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(
        F.min("id").alias("incident_id"), F.min_by("title", "id").alias("incident_title"), F.min_by("status", "id").alias("incident_status")
    )
    rows = runs.orderBy(F.col("created_at").desc(), "id").limit(limit) if limit else runs
    return rows.join(linked, rows["id"] == linked["run_id"], "left").drop("run_id").orderBy(F.col("created_at").desc(), "id")


def run_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("run_count"), F.coalesce(F.sum("raw_lines"), F.lit(0)).alias("total_lines"),
        F.coalesce(F.avg("reduction_ratio"), F.lit(0.0)).alias("avg_reduction"),
        F.coalesce(F.avg("duration_sec"), F.lit(0.0)).alias("avg_duration"),
    )


def noise_volume(clusters: DataFrame) -> DataFrame:
    size = F.sum(F.when(F.col("cluster_id") == -1, F.col("size")).otherwise(0))
    return clusters.agg(F.coalesce(size, F.lit(0)).alias("noise_lines"))


def severity_counts(severity: DataFrame) -> DataFrame:
    """Clusters per priority; priorities without clusters stay."""
    rows = [F.struct(F.lit(p).alias("priority"), F.count_if(F.col("priority") == p).alias("clusters")) for p in ("P0", "P1", "P2", "P3")]
    return severity.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def baseline_inspect(baseline: DataFrame) -> DataFrame:
    return baseline.agg(
        F.count("*").alias("clusters"), F.count_if(F.col("label").isNotNull()).alias("labelled"),
        F.count_if("is_acknowledged").alias("acknowledged"), F.coalesce(F.sum("size"), F.lit(0)).alias("logs_processed"),
    )


def baseline_explain(baseline: DataFrame, cluster_id: int) -> DataFrame:
    return baseline.where(F.col("cluster_id") == cluster_id)


def top_clusters(clusters: DataFrame, n: int = 10) -> DataFrame:
    return clusters.orderBy(F.col("size").desc(), "cluster_id").limit(n)


def cluster_report(clusters: DataFrame, members: DataFrame, anomalies: DataFrame, n: int = 20, width: int | None = None) -> DataFrame:
    """Largest clusters with the worst anomaly of their templates.

    Only the chosen clusters' members are joined; the worst label is an aggregate, not a sort.
    """
    top = top_clusters(clusters, n)
    scored = members.join(top.select("cluster_id"), "cluster_id").join(anomalies, "template")
    worst = scored.groupBy("cluster_id").agg(F.max("distance").alias("worst_distance"), F.max_by("label", "distance").alias("_label"))
    noise = F.col("cluster_id") == -1
    text = F.replace(F.col("representative_raw"), F.lit("\n"), F.lit(" "))
    if width is not None:
        text = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
    return (
        top.join(worst, "cluster_id", "left")
        .select(
            F.when(noise, "NOISE").otherwise(F.col("cluster_id").cast("string")).alias("cluster"),
            "size",
            F.coalesce("_label", F.when(noise, "OUTLIER").otherwise("-")).alias("label"),
            "worst_distance",
            F.concat_ws(":", "representative_source", F.col("representative_line").cast("string")).alias("location"),
            text.alias("text"),
        )
        .orderBy(F.col("size").desc(), "cluster")
    )


def label_rank(label: Column) -> Column:
    """Position of an anomaly label, -1 when unknown."""
    return F.array_position(F.array(*[F.lit(x) for x in ANOMALY_LABELS]), label) - 1


def anomaly_gate(anomalies: DataFrame, level: str) -> DataFrame:
    """One row: worst rank and label of the run, and whether it reaches ``level``."""
    worst = anomalies.agg(F.coalesce(F.max(label_rank(F.col("label"))), F.lit(-1)).alias("worst_rank"))
    names = F.array(*[F.lit(x) for x in ANOMALY_LABELS])
    return worst.select(
        "worst_rank", F.when(F.col("worst_rank") >= 0, F.get(names, F.col("worst_rank").cast("int"))).alias("worst_label"),
        (F.col("worst_rank") >= ANOMALY_LABELS.index(level)).alias("failed"),
    )
