"""Service-level objectives: status, daily values, breaches, forecast, monitors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.functions.timing import DAY_MS, MINUTE_MS, at_ms, ms
from logspark.functions.search import search_condition
from logspark.operators.filters import time_between

# Levels that count as failures, latency limit, warning burn rate.
BAD_LEVELS = ("error", "fatal", "critical")
FAST_MS = 500
WARNING_BURN = 0.8
MONITOR_WINDOW_S = 3600
# Titles, by which open incidents are matched.
BREACH_TITLE, WARNING_TITLE = "SLO Breach: ", "Predictive Warning: %s will breach soon"
# Fewest points of a forecast and its horizon in points.
FORECAST_MIN, FORECAST_HORIZON = 10, 240


def _good_latency(compat: bool) -> Column:
    number = lambda f: F.get_json_object("raw_json", f"$.{f}").try_cast("double")
    duration, latency = number("duration_ms"), number("latency")
    if compat:
        return (F.coalesce(duration, F.lit(0.0)) < FAST_MS) | (F.coalesce(latency, F.lit(0.0)) < FAST_MS)
    return F.coalesce(F.coalesce(duration, latency) < FAST_MS, F.lit(True))


def _daily_counts(logs: DataFrame, slos: DataFrame, now_ms: int, compat: bool) -> DataFrame:
    """Events per (source, age in days, UTC day) with the good ones of either kind.

    SLO windows are whole days back from ``now_ms``, so counts per day of age answer every window
    exactly; logs are aggregated once, before any join with the objectives, and only those of the
    longest window are read (the objectives are a small table; their maximum is looked up first).
    """
    stamp = ms(F.col("timestamp"))
    longest = slos.agg(F.max("window_days")).first()[0] or 0
    used = time_between(logs, now_ms - longest * DAY_MS).join(slos.select(F.col("service").alias("source")).distinct(), "source", "left_semi")
    failed = F.lower(F.coalesce("level", F.lit(""))).isin(*BAD_LEVELS)
    return used.groupBy(
        "source", F.ceil((F.lit(now_ms) - stamp) / DAY_MS).alias("age"), F.floor(stamp / DAY_MS).alias("day")
    ).agg(F.count("*").alias("total"), F.count_if(~failed).alias("ok"), F.count_if(_good_latency(compat)).alias("fast"))


def _windowed(logs: DataFrame, slos: DataFrame, now_ms: int, compat: bool) -> DataFrame:
    """One row per SLO, age and day, empty SLOs kept, with ``total`` and ``good``."""
    counts = _daily_counts(logs, slos, now_ms, compat)
    joined = slos.join(counts, (slos["service"] == counts["source"]) & (counts["age"] <= slos["window_days"]), "left")
    kind = F.col("sli_type")
    good = F.when(kind == "availability", F.col("ok")).when(kind == "latency", F.col("fast")).otherwise(F.col("total"))
    return joined.withColumn("good", good)


def slo_status(logs: DataFrame, slos: DataFrame, now_ms: int, exact: bool = False, compat: bool = False) -> DataFrame:
    """Value, budget, burn rate and status per SLO; no events = 100 % and healthy.

    ``exact`` computes the budget in decimals (1000 events at 99.9 % allow 1 failure, not 0).
    """
    names = [c for c in slos.columns]
    summed = _windowed(logs, slos, now_ms, compat).groupBy(*names).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_events"), F.coalesce(F.sum("good"), F.lit(0)).alias("good_events")
    )
    total, good = F.col("total_events"), F.col("good_events")
    if exact:
        allowed = F.lit(100).cast("decimal(20,6)") - F.col("target_percentage").cast("decimal(20,6)")
        budget = (total.cast("decimal(20,0)") * allowed / 100).cast("long")
    else:
        budget = (total * ((100.0 - F.col("target_percentage")) / 100.0)).cast("long")
    df = summed.withColumn("error_budget_total", budget)
    df = df.withColumn("failures", total - good).withColumn("error_budget_remaining", F.col("error_budget_total") - F.col("failures"))
    df = df.withColumn("burn_rate", F.coalesce(F.try_divide("failures", "error_budget_total"), F.lit(0.0)))
    status = F.when(total == 0, "HEALTHY").when(F.col("error_budget_remaining") < 0, "BREACHED").when(F.col("burn_rate") > WARNING_BURN, "WARNING").otherwise("HEALTHY")
    value = F.coalesce(F.try_divide(good, total) * 100, F.lit(100.0))
    return df.withColumn("current_value", value).withColumn("status", status)


def slo_daily(logs: DataFrame, slos: DataFrame, now_ms: int, compat: bool = False) -> DataFrame:
    """Good share in percent per SLO and UTC day."""
    days = _windowed(logs, slos, now_ms, compat).where(F.col("day").isNotNull()).groupBy(F.col("id").alias("slo_id"), "day").agg(
        F.sum("total").alias("total"), F.sum("good").alias("good")
    )
    return days.select("slo_id", (F.col("day") * DAY_MS).alias("day_ms"), (F.col("good") / F.col("total") * 100).alias("value")).orderBy("slo_id", "day_ms")


def slo_data_point(logs: DataFrame, slos: DataFrame, at: int) -> DataFrame:
    """The measured point of one evaluation: ``slo_id, timestamp, good_events, total_events, value``."""
    return slo_status(logs, slos, at).select(
        F.col("id").alias("slo_id"), at_ms(at).alias("timestamp"), "good_events", "total_events", F.col("current_value").alias("value")
    )


def slo_breach_marks(points: DataFrame, slos: DataFrame) -> DataFrame:
    """Breaching points as marks for ``open_incident_dedup``: title, service, summary, impact 1."""
    joined = points.join(slos.withColumnRenamed("id", "slo_id"), "slo_id").where(F.col("value") < F.col("target_percentage"))
    return joined.select(
        "tenant_id", "service", F.concat(F.lit(BREACH_TITLE), F.col("name")).alias("title"), ms(F.col("timestamp")).alias("ts_ms"), F.lit(False).alias("resolved"),
        F.format_string("%s: %s is below its objective of %s%% (measured %.2f%%)", "name", "service", F.col("target_percentage").cast("string"), "value").alias("summary"),
    )


def slo_breach_incidents(points: DataFrame, slos: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Breaches folded into open incidents; ``resolutions`` = tenant_id, service, title, ts_ms."""
    from logspark.operators.windows import open_incident_dedup

    marks = slo_breach_marks(points, slos)
    if resolutions is not None:
        marks = marks.unionByName(resolutions.select(
            "tenant_id", "service", "title", "ts_ms", F.lit(True).alias("resolved"), F.lit(None).cast("string").alias("summary")
        ))
    return open_incident_dedup(marks).withColumn("impact_score", F.lit(1.0))


def slo_forecast(
    points: DataFrame, slos: DataFrame, horizon: int = FORECAST_HORIZON, history: int | None = None,
    alphas: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9), betas: Sequence[float] = (0.05, 0.1, 0.3, 0.5),
) -> DataFrame:
    """First step at which the trend falls below target (null: not within reach, or fewer than 10 points).

    Additive-trend exponential smoothing, the parameters with the smallest squared one-step error
    out of the grid, over all points of an SLO or the ``history`` newest (by a rank that is cut before
    the shuffle). An SLO's points are one series, folded inside Spark; a day has 1 440 of them at most.
    """
    recent = points
    if history is not None:
        newest = W.partitionBy("slo_id").orderBy(F.col("timestamp").desc(), F.col("value").desc())
        recent = points.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= history)
    every = recent.groupBy("slo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("timestamp", "value"))), lambda p: p["value"]).alias("y")
    )
    series = every.where(F.size("y") >= FORECAST_MIN)
    grid = series.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas]))).withColumn(
        "beta", F.explode(F.array(*[F.lit(b) for b in betas]))
    )
    y, alpha, beta = F.col("y"), F.col("alpha"), F.col("beta")

    def step(s: Column, v: Column) -> Column:
        expected = s["level"] + s["trend"]
        level = alpha * v + (1 - alpha) * expected
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        return F.struct(level.alias("level"), trend.alias("trend"), (s["sse"] + (v - expected) * (v - expected)).alias("sse"))

    start = F.struct(y[0].alias("level"), (y[1] - y[0]).alias("trend"), F.lit(0.0).alias("sse"))
    fitted = grid.withColumn("fit", F.aggregate(F.slice("y", F.lit(2), F.size("y")), start, step))
    best = fitted.groupBy("slo_id").agg(F.min_by("fit", F.struct("fit.sse", "alpha", "beta")).alias("fit"))
    level, trend = F.col("fit.level"), F.col("fit.trend")
    target = F.col("target_percentage")
    # smallest h >= 1 with level + h * trend < target
    steps = F.when(level + trend < target, F.lit(1)).when(
        trend < 0, F.greatest(F.lit(1), (F.floor((level - target) / -trend) + 1))
    )
    meta = slos.select(F.col("id").alias("slo_id"), "tenant_id", "name", "service", "target_percentage")
    return every.select("slo_id").join(best, "slo_id", "left").join(meta, "slo_id").select(
        "slo_id", "tenant_id", "name", "service", "target_percentage", level.alias("level"), trend.alias("trend"),
        F.when(steps <= horizon, steps).cast("long").alias("steps_to_breach"),
    )


def predictive_title(name: Column) -> Column:
    return F.format_string(WARNING_TITLE, name)


def predictive_incidents(forecast: DataFrame, open_incidents: DataFrame, now_ms: int) -> DataFrame:
    """Incidents for forecast breaches that have no open warning yet; one step is one minute."""
    due = forecast.where(F.col("steps_to_breach").isNotNull()).withColumn("title", predictive_title(F.col("name")))
    known = open_incidents.where(F.col("status") == "OPEN").select("tenant_id", "title").distinct()
    fresh = due.join(known, ["tenant_id", "title"], "left_anti")
    return fresh.select(
        "tenant_id", "title", F.col("service").alias("domain"), F.lit(0.8).alias("impact_score"), F.lit(True).alias("is_predictive"), "steps_to_breach",
        at_ms(F.lit(now_ms) + F.col("steps_to_breach") * MINUTE_MS).alias("forecasted_depletion_time"),
        F.format_string("%s: at the present trend %s falls below %s%% within %d min", "name", "service", F.col("target_percentage").cast("string"), "steps_to_breach").alias("summary"),
    )


def evaluate_monitors(logs: DataFrame, monitors: Sequence[dict], now_ms: int) -> DataFrame:
    """Matches of every active monitor's search against its thresholds, all monitors in one scan.

    A monitor is ``id, name, tenant_id, query, threshold_critical, threshold_warning, enabled,
    muted_until_ms, window_seconds``; it counts the events of its last ``window_seconds`` (an hour unless
    given), and only the longest window is read. Monitors without a match count 0; none: no rows.
    """
    active = [m for m in monitors if m.get("enabled", True) and not (m.get("muted_until_ms") or 0) > now_ms]
    if not active:
        return logs.sparkSession.createDataFrame([], "monitor_id long, name string, matches long, state string")
    since = lambda m: now_ms - int(m.get("window_seconds", MONITOR_WINDOW_S)) * 1000
    logs = time_between(logs, min(map(since, active)), now_ms)
    counts = []
    for m in active:
        condition = search_condition(m["query"]) & (F.col("timestamp") >= at_ms(since(m)))
        if m.get("tenant_id") is not None:
            condition = condition & (F.col("tenant_id") == str(m["tenant_id"]))
        number = lambda v: F.lit(v).cast("double")
        counts.append(F.struct(
            F.lit(m["id"]).alias("monitor_id"), F.lit(m["name"]).alias("name"), F.count_if(condition).alias("matches"),
            number(m.get("threshold_critical")).alias("critical"), number(m.get("threshold_warning")).alias("warning"),
        ))
    rows = logs.agg(F.array(*counts).alias("m")).select(F.inline("m"))
    state = F.when(F.col("matches") >= F.col("critical"), "CRITICAL").when(F.col("matches") >= F.col("warning"), "WARNING").otherwise("OK")
    return rows.select("monitor_id", "name", "matches", state.alias("state"))
