"""Dashboard aggregates over incidents, runs, telemetry and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logspark.functions.timing import DAY_MS, at_ms, ms

# Impact bands (name, from, below).
IMPACT_BANDS = (("Critical", 0.8, 1.01), ("High", 0.6, 0.8), ("Medium", 0.3, 0.6), ("Low", 0.0, 0.3))
CPU_LIMIT, MEMORY_LIMIT = 85, 90


def metric_cards(incidents: DataFrame, slos: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of headline numbers."""
    i = incidents.agg(
        F.count_if(F.col("status") == "OPEN").alias("open_incidents"), F.count("*").alias("total_incidents"),
        F.count_if(F.col("status") == "RESOLVED").alias("resolved_incidents"),
        F.coalesce(F.avg("impact_score"), F.lit(0.0)).alias("avg_impact"),
    )
    last = runs.agg(F.max_by("cluster_count", F.struct("created_at", "id")))
    return (
        i.withColumn("slos_tracked", slos.agg(F.count("*")).scalar())
        .withColumn("runs_total", runs.agg(F.count("*")).scalar())
        .withColumn("clusters_last_run", F.coalesce(last.scalar(), F.lit(0)))
    )


def incidents_per_day(incidents: DataFrame, now_ms: int, since_ms: int | None = None, default_days: int = 14) -> DataFrame:
    """Incidents opened per UTC day, days without any as 0; at least one day, ending today."""
    start = since_ms if since_ms is not None else now_ms - default_days * DAY_MS
    today = now_ms // DAY_MS
    days = max(1, today - start // DAY_MS + 1)
    counted = incidents.where(F.col("created_at") >= at_ms(start)).groupBy(
        F.floor(ms(F.col("created_at")) / DAY_MS).alias("day")
    ).agg(F.count("*").alias("n"))
    calendar = incidents.sparkSession.range(today - days + 1, today + 1).withColumnRenamed("id", "day")
    return calendar.join(counted, "day", "left").select(
        (F.col("day") * DAY_MS).alias("day_ms"), F.coalesce("n", F.lit(0)).alias("incidents")
    ).orderBy("day_ms")


def _top(df: DataFrame, name: str, k: int | None) -> DataFrame:
    counted = df.groupBy(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown")).alias("label")).agg(F.count("*").alias("incidents"))
    return counted if k is None else counted.orderBy(F.col("incidents").desc(), "label").limit(k)


def incidents_by_domain(incidents: DataFrame, k: int = 8) -> DataFrame:
    return _top(incidents, "domain", k)


def resolved_gauge(incidents: DataFrame) -> DataFrame:
    counted = incidents.agg(F.count_if(F.col("status") == "RESOLVED").alias("resolved"), F.count("*").alias("total"))
    return counted.withColumn("ratio", F.coalesce(F.try_divide("resolved", "total"), F.lit(0.0)))


def incident_heatmap(incidents: DataFrame, now_ms: int, days: int = 30, since_ms: int | None = None) -> DataFrame:
    """Weekday (Monday 0) x hour counts with the largest cell."""
    cutoff = since_ms if since_ms is not None else now_ms - max(1, days) * DAY_MS
    stamp = ms(F.col("created_at"))
    cells = incidents.where(F.col("created_at") >= at_ms(cutoff)).groupBy(
        F.pmod(F.floor(stamp / DAY_MS) + 3, F.lit(7)).alias("day"),  # 1970-01-01 was a Thursday
        F.floor(F.pmod(stamp, F.lit(DAY_MS)) / 3_600_000).alias("hour"),
    ).agg(F.count("*").alias("incidents"))
    return cells.withColumn("max_cell", cells.agg(F.max("incidents")).scalar())


def incident_pie(incidents: DataFrame, by: str = "severity", k: int | None = None) -> DataFrame:
    """Slices by status, by domain (all, or the k largest) or by impact band; empty bands are left out."""
    if by == "status":
        name = F.initcap(F.coalesce("status", F.lit("UNKNOWN")))
        return incidents.groupBy(name.alias("label")).agg(F.count("*").alias("incidents"))
    if by == "domain":
        return _top(incidents, "domain", k)
    band = F.lit(None).cast("string")
    for name, low, high in reversed(IMPACT_BANDS):
        band = F.when((F.col("impact_score") >= low) & (F.col("impact_score") < high), name).otherwise(band)
    banded = incidents.select(band.alias("label")).where(F.col("label").isNotNull())
    return banded.groupBy("label").agg(F.count("*").alias("incidents"))


def incident_feed(incidents: DataFrame, n: int = 12) -> DataFrame:
    return incidents.orderBy(F.col("created_at").desc(), "id").limit(n).select("id", "title", "status", "domain", "impact_score", "created_at")


def vitals_tail(telemetry: DataFrame, n: int = 20, raw: bool = False) -> DataFrame:
    """Newest n samples in time order."""
    tail = telemetry.orderBy(F.col("timestamp").desc(), *[F.col(c).desc() for c in sorted(telemetry.columns) if c != "timestamp"]).limit(n)
    if raw:
        return tail.orderBy("timestamp")
    drops = [F.col(c) for c in ("network_drops_per_s", "network_drops") if c in telemetry.columns]
    zero = F.lit(0.0)
    return tail.select(
        "timestamp", F.coalesce("cpu_percent", zero).alias("cpu"), F.coalesce("memory_percent", zero).alias("mem"),
        F.coalesce("disk_iops", zero).alias("disk"), F.coalesce(*drops, zero).alias("net"),
    ).orderBy("timestamp")


def vitals_drift(telemetry: DataFrame, n: int = 20) -> DataFrame:
    """Per metric: newest value against the average of the tail, in percent; flat below 1 %."""
    tail = vitals_tail(telemetry, n)
    names = ("cpu", "mem", "disk", "net")
    order = F.struct("timestamp", *names)
    one = tail.agg(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.max_by(m, order).alias("current"), F.avg(m).alias("average")) for m in names
    ]).alias("m"))
    drift = one.select(F.inline("m")).withColumn(
        "pct", F.coalesce(F.try_divide(F.col("current") - F.col("average"), F.col("average")) * 100, F.lit(0.0))
    )
    return drift.withColumn("flat", F.abs("pct") < 1)


def vitals_breaches(telemetry: DataFrame) -> DataFrame:
    """Samples over the cpu or memory limit, marked with the larger share."""
    cpu, mem = F.coalesce("cpu_percent", F.lit(0.0)), F.coalesce("memory_percent", F.lit(0.0))
    over = (cpu > CPU_LIMIT) | (mem > MEMORY_LIMIT)
    return telemetry.where(over).select("timestamp", (F.greatest(cpu, mem) / 100).alias("anomaly"))


def service_graph_edges(links: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return links.where(F.col("confidence") >= min_confidence).select(
        F.col("source_service").alias("source"), F.col("target_service").alias("target"), "confidence", "avg_delay_ms", "occurrences"
    )


def service_graph_nodes(links: DataFrame) -> DataFrame:
    """Services with 1 + incident edges (over all links) and a drawing size held to 20..40."""
    ends = links.select(F.explode(F.array("source_service", "target_service")).alias("service"))
    nodes = ends.groupBy("service").agg((F.count("*") + 1).alias("clusters"))
    return nodes.withColumn("size", F.least(F.lit(40.0), F.greatest(F.lit(20.0), 20 + F.col("clusters") * 1.5)))


def slo_budget_percent(status: DataFrame) -> DataFrame:
    """Share of the error budget left, never negative; 100 when there is no budget to measure."""
    share = F.try_divide(F.col("error_budget_remaining"), F.col("error_budget_total")) * 100
    return status.withColumn("budget_percent", F.when(share.isNull(), 100.0).otherwise(F.greatest(F.lit(0.0), share)))
