"""Row filters, searches and newest-first listings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.search import search_condition
from logspark.functions.timing import DAY_MS, at_ms

# Relative window units in seconds.
WINDOW_UNITS = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def time_between(df: DataFrame, from_ms: int | None = None, to_ms: int | None = None, column: str = "timestamp") -> DataFrame:
    """Both ends inclusive, either may be open; literals fold, so the bounds reach the scan.

    Tables with the UTC ``date`` partition column are cut to the days of the range as well.
    """
    day = lambda value: F.date_from_unix_date(F.lit(value // DAY_MS).cast("int"))
    by_day = ("date", "date") in df.dtypes and column in ("timestamp", "start_time")
    if from_ms is not None:
        df = df.where(F.col(column) >= at_ms(from_ms))
        df = df.where(F.col("date") >= day(from_ms)) if by_day else df
    if to_ms is not None:
        df = df.where(F.col(column) <= at_ms(to_ms))
        df = df.where(F.col("date") <= day(to_ms)) if by_day else df
    return df


def tenant_scope(df: DataFrame, tenant: str, allow_null: bool = False) -> DataFrame:
    """Rows of one tenant; optionally rows written before tenants existed."""
    own = F.col("tenant_id") == str(tenant)
    return df.where(own | F.col("tenant_id").isNull() if allow_null else own)


def log_search(df: DataFrame, query: str, mode: str = "strict") -> DataFrame:
    return df.where(search_condition(query, mode))


def log_query(
    df: DataFrame,
    query: str = "",
    tenant: str | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    limit: int = 100,
    fields: tuple[str, ...] = (),
    mode: str = "strict",
) -> DataFrame:
    """Newest matching rows; ``fields`` are read out of raw_json next to the stored columns."""
    if tenant is not None:
        df = tenant_scope(df, tenant)
    rows = time_between(log_search(df, query, mode), from_ms, to_ms)
    top = rows.orderBy(F.col("timestamp").desc(), "source", "message", "raw_json").limit(limit)
    return top.select(
        "timestamp", "source", "level", "message", "raw_json",
        *[F.get_json_object("raw_json", f"$.{f}").alias(f) for f in fields],
    )


def abac_condition(
    action: str, resource_type: str, role: Column, tenant: Column, department: Column, environments: Column,
    resource_tenant: Column, environment: Column, contains_pii: Column,
) -> Column:
    """The row policy as one predicate."""
    same_tenant = resource_tenant.isNull() | (resource_tenant == tenant)
    env_ok = F.array_contains(environments, "*") | F.array_contains(environments, environment)
    mutates_incident = action in ("write", "delete") and resource_type == "incident"
    dept_ok = F.coalesce(department, F.lit("Engineering")).isin("Operations", "Security") if mutates_incident else F.lit(True)
    pii_ok = ~(contains_pii & (role == "VIEWER")) if action == "read" else F.lit(True)
    return same_tenant & ((role == "ADMIN") | (F.coalesce(env_ok, F.lit(False)) & dept_ok & pii_ok))


def _resource_attributes(place: str, impact: str | None, pii_above: float) -> tuple[Column, Column]:
    env = F.when(F.lower(F.coalesce(F.col(place), F.lit(""))).contains("prod"), "prod").otherwise("dev")
    pii = F.coalesce(F.col(impact), F.lit(0.0)) > pii_above if impact else F.lit(False)
    return env, pii


def abac_visible(
    resources: DataFrame, user: Mapping, action: str, resource_type: str,
    place: str = "domain", impact: str | None = "impact_score", pii_above: float = 80.0,
) -> DataFrame:
    """Rows one user may touch: a plain filter, no join."""
    env, pii = _resource_attributes(place, impact, pii_above)
    allowed = abac_condition(
        action, resource_type, F.lit(user["role"]), F.lit(user["tenant_id"]), F.lit(user.get("department")).cast("string"),
        F.array(*[F.lit(e) for e in user.get("environment_access") or []]).cast("array<string>"),
        F.col("tenant_id"), env, pii,
    )
    return resources.where(allowed)


def abac_filter(
    resources: DataFrame, users: DataFrame, action: str, resource_type: str,
    place: str = "domain", impact: str | None = "impact_score", pii_above: float = 80.0,
) -> DataFrame:
    """Every (user, resource) pair the policy allows, for audits over all users.

    An equi-join on the tenant; rows without a tenant meet users through the '' key.
    """
    env, pii = _resource_attributes(place, impact, pii_above)
    subjects = users.select(
        F.col("id").alias("user_id"), "role", F.col("tenant_id").alias("_tenant"), "department", "environment_access",
        F.explode(F.array("tenant_id", F.lit(""))).alias("_key"),
    )
    objects = resources.withColumn("_key", F.coalesce("tenant_id", F.lit(""))).withColumn("_env", env).withColumn("_pii", pii)
    allowed = abac_condition(
        action, resource_type, F.col("role"), F.col("_tenant"), F.col("department"), F.col("environment_access"),
        F.col("tenant_id"), F.col("_env"), F.col("_pii"),
    )
    return objects.join(subjects, "_key").where(allowed).select("user_id", *resources.columns)


def trace_search(traces: DataFrame, query: str) -> DataFrame:
    """All terms must match: ``service:``, ``status:error|ok``, else id, service or operation text."""
    condition = F.lit(True)
    for term in query.lower().split():
        name, _, value = term.partition(":")
        value = value.split(":")[0]
        has = lambda c, t: F.contains(F.lower(F.col(c)), F.lit(t))
        if name == "service" and ":" in term:
            part = has("root_service", value)
        elif name == "status" and value == "error":
            part = F.col("error_count") > 0
        elif name == "status" and value == "ok":
            part = F.col("error_count") == 0
        else:
            part = has("trace_id", term) | has("root_service", term) | has("root_operation", term)
        condition = condition & part
    return traces.where(condition)


def incident_search(df: DataFrame, domain: str | None = None, status: str | None = None, text: str = "") -> DataFrame:
    """Exact domain and status, substring over title, domain, summary and ``inc_<id>``."""
    if domain:
        df = df.where(F.col("domain") == domain)
    if status:
        df = df.where(F.col("status") == status)
    if text:
        haystack = F.concat_ws("\n", "title", "domain", "summary", F.concat(F.lit("inc_"), F.col("id").cast("string")))
        df = df.where(F.contains(F.lower(haystack), F.lit(text.lower())))
    return df


FIRST_MS = -62_135_596_800_000  # the first instant a timestamp can hold: no row is older


def resolve_window_ms(start: str | None, now_ms: int) -> int | None:
    """``15m`` / ``4h`` / ``7d`` / ``2w`` or ISO text -> lower bound in epoch ms; anything else -> None."""
    raw = (start or "").strip().lstrip("-")
    if re.fullmatch(r"\d+[mhdwMHDW]", raw):
        return max(now_ms - int(raw[:-1]) * WINDOW_UNITS[raw[-1].lower()] * 1000, FIRST_MS)
    try:
        stamp = datetime.fromisoformat(raw.replace("Z", "+00:00"))
    except ValueError:
        return None
    return int(stamp.replace(tzinfo=stamp.tzinfo or timezone.utc).timestamp() * 1000)


def resolve_window(df: DataFrame, start: str | None, now_ms: int, column: str = "created_at") -> DataFrame:
    return time_between(df, resolve_window_ms(start, now_ms), None, column)


def newest_page(df: DataFrame, equals: Mapping[str, object], time_column: str, skip: int = 0, limit: int = 50) -> DataFrame:
    """Optional equality filters, newest first (id breaks ties), one page, with the total count."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    total = df.agg(F.count("*")).scalar()
    page = df.orderBy(F.col(time_column).desc(), "id").offset(skip).limit(limit)
    return page.withColumn("total", total)


def alert_history(alerts: DataFrame, priority: str | None = None, status: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    return newest_page(alerts, {"priority": priority, "status": status}, "timestamp", skip, limit)


def audit_history(audit: DataFrame, action: str | None = None, user_id: object | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    return newest_page(audit, {"action": action, "user_id": user_id}, "timestamp", skip, limit)


def recent_deployments(markers: DataFrame, tenant: str, limit: int = 100) -> DataFrame:
    return tenant_scope(markers, tenant).orderBy(F.col("timestamp").desc(), "id").limit(limit)


def active_monitors(monitors: DataFrame, now_ms: int) -> DataFrame:
    """``muted_until`` only while it lies ahead; ``active`` = enabled and not muted."""
    muted = F.when(F.col("muted_until") > at_ms(now_ms), F.col("muted_until"))
    return monitors.withColumn("muted_until", muted).withColumn("active", F.col("enabled") & F.col("muted_until").isNull())
