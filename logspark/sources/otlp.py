"""OTLP JSON documents (one per row) -> log rows and span rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.timing import at_ms

UNKNOWN_SERVICE = "unknown_service"

# JSON sub-documents whose shape varies (any-values, bodies, status codes) are kept as text.
_ATTRS = "array<struct<key:string,value:string>>"
_LOGS = (
    f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<logRecords:"
    f"array<struct<timeUnixNano:string,severityText:string,body:string,attributes:{_ATTRS}>>>>>>"
)
_SPANS = (
    f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:array<struct<spans:array<struct<"
    "traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    f"status:struct<code:string>,attributes:{_ATTRS},"
    f"events:array<struct<name:string,timeUnixNano:string,attributes:{_ATTRS}>>>>>>>>"
)


def _any_value(value: Column, kinds: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in kinds])


def _attr_map(attrs: Column, value) -> Column:
    """Key-value list -> MAP; entries without a value are left out, the last of equal keys wins."""
    attrs = F.coalesce(attrs, F.array().cast(_ATTRS))
    entries = F.filter(
        F.transform(attrs, lambda a: F.struct(a["key"].alias("key"), value(a["value"]).alias("value"))),
        lambda e: e["key"].isNotNull() & e["value"].isNotNull(),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(last)


def _loose(value: Column) -> Column:
    """stringValue, else the JSON text of the value."""
    return F.coalesce(F.get_json_object(value, "$.stringValue"), value)


def _typed(value: Column) -> Column:
    return _any_value(value, ("stringValue", "intValue", "boolValue", "doubleValue"))


def _service(resource: Column, value) -> Column:
    named = F.filter(
        F.coalesce(resource["attributes"], F.array().cast(_ATTRS)), lambda a: a["key"] == "service.name"
    )
    return F.coalesce(value(F.get(F.reverse(named), F.lit(0))["value"]), F.lit(UNKNOWN_SERVICE))


def _nano_ms(nano: Column, now_ms: int | Column) -> Column:
    """Nanosecond text -> epoch ms; missing or zero means now."""
    value = nano.try_cast("decimal(38,0)").try_cast("long")
    return F.when(value.isNull() | (value == 0), F.lit(now_ms)).otherwise(F.call_function("div", value, F.lit(1_000_000)))


def flatten_otlp_logs(df: DataFrame, column: str, now_ms: int | Column) -> DataFrame:
    """resourceLogs -> ``timestamp, source, level, message, attributes``; source is the service name."""
    records = (
        df.select(F.from_json(F.col(column), _LOGS).alias("_d"))
        .select(F.explode("_d.resourceLogs").alias("_r"))
        .select(_service(F.col("_r.resource"), _loose).alias("source"), F.explode("_r.scopeLogs").alias("_s"))
        .select("source", F.explode("_s.logRecords").alias("_l"))
    )
    body = F.col("_l.body")
    return records.select(
        at_ms(_nano_ms(F.col("_l.timeUnixNano"), now_ms)).alias("timestamp"),
        "source",
        F.upper(F.coalesce(F.col("_l.severityText"), F.lit("INFO"))).alias("level"),
        F.coalesce(
            F.nullif(F.get_json_object(body, "$.stringValue"), F.lit("")),
            F.get_json_object(body, "$.intValue"),
            body,
            F.lit("{}"),
        ).alias("message"),
        _attr_map(F.col("_l.attributes"), _loose).alias("attributes"),
    )


def flatten_otlp_spans(
    df: DataFrame, column: str, now_ms: int | Column, mode: str = "collector", keep: tuple[str, ...] = ()
) -> DataFrame:
    """resourceSpans -> span rows.

    ``collector``: status OK / ERROR, duration never negative, typed attribute values.
    ``raw``: the status code as sent (default STATUS_CODE_UNSET), duration as is and 0 when an end
    is missing. Consumers that count errors accept both spellings (``is_error``). Columns named in
    ``keep`` are carried along.
    """
    if mode not in ("collector", "raw"):
        raise ValueError(f"unknown mode {mode!r}")
    collector = mode == "collector"
    value = _typed if collector else _loose
    service_value = (lambda v: F.get_json_object(v, "$.stringValue")) if collector else _loose
    spans = (
        df.select(*keep, F.from_json(F.col(column), _SPANS).alias("_d"))
        .select(*keep, F.explode("_d.resourceSpans").alias("_r"))
        .select(*keep, _service(F.col("_r.resource"), service_value).alias("service_name"), F.explode("_r.scopeSpans").alias("_s"))
        .select(*keep, "service_name", F.explode("_s.spans").alias("_p"))
    )
    start_ms = _nano_ms(F.col("_p.startTimeUnixNano"), now_ms)
    end_ms = _nano_ms(F.col("_p.endTimeUnixNano"), now_ms)
    start_ns = F.col("_p.startTimeUnixNano").try_cast("decimal(38,0)")
    end_ns = F.col("_p.endTimeUnixNano").try_cast("decimal(38,0)")
    code = F.col("_p.status.code")
    has_both = (F.coalesce(start_ns, F.lit(0)) != 0) & (F.coalesce(end_ns, F.lit(0)) != 0)
    span_ms = (end_ns - start_ns).cast("double") / 1e6
    if collector:
        duration = F.greatest(F.lit(0.0), F.when(has_both, span_ms).otherwise((end_ms - start_ms).cast("double")))
        status = F.when(code.isin("2", "STATUS_CODE_ERROR"), "ERROR").otherwise("OK")
    else:
        duration = F.when(has_both, span_ms).otherwise(F.lit(0.0))
        status = F.coalesce(code, F.lit("STATUS_CODE_UNSET"))
    events = F.transform(
        F.coalesce(F.col("_p.events"), F.array().cast(f"array<struct<name:string,timeUnixNano:string,attributes:{_ATTRS}>>")),
        lambda e: F.struct(
            e["name"].alias("name"),
            at_ms(_nano_ms(e["timeUnixNano"], now_ms)).alias("timestamp"),
            _attr_map(e["attributes"], lambda v: F.get_json_object(v, "$.stringValue")).alias("attributes"),
        ),
    )
    text = lambda name: F.coalesce(F.col(f"_p.{name}"), F.lit(""))
    return spans.select(
        *keep,
        text("traceId").alias("trace_id"),
        text("spanId").alias("span_id"),
        F.nullif(F.col("_p.parentSpanId"), F.lit("")).alias("parent_span_id"),
        "service_name",
        text("name").alias("operation_name"),
        at_ms(start_ms).alias("start_time"),
        at_ms(end_ms).alias("end_time"),
        duration.alias("duration_ms"),
        status.alias("status_code"),
        _attr_map(F.col("_p.attributes"), value).alias("attributes"),
        events.alias("events"),
    )


def is_error(status: Column) -> Column:
    """Error test that accepts both spellings of the status."""
    return status.isin("ERROR", "STATUS_CODE_ERROR", "2")
