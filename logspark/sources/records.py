"""JSON records -> canonical log rows: source, event time, the six log columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.functions.timing import at_ms, coerce_event_ms

# Where shippers put the service name, best first.
SOURCE_KEYS = (
    "source", "service", "service_name", "service.name", "kubernetes.container_name",
    "kubernetes.labels.app", "container_name", "app", "logger_name",
)
UNKNOWN_SOURCE = "unknown"
LOG_COLUMNS = ("tenant_id", "timestamp", "source", "level", "message", "raw_json")


def _scalar(node: Column) -> Column:
    """Trimmed text of a scalar VARIANT; null for missing, null, objects, arrays and blanks."""
    kind = F.schema_of_variant(node)
    text = F.trim(F.try_variant_get(node, "$", "string"))
    text = F.when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)
    container = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return F.when(node.isNotNull() & ~container & (kind != "VOID"), F.nullif(text, F.lit("")))


def resolve_source(document: Column) -> Column:
    """Service of a VARIANT record: first usable key; dotted keys are tried flat, then nested."""
    found = []
    for key in SOURCE_KEYS:
        flat = F.try_variant_get(document, f"$['{key}']", "variant")
        if "." in key:
            nested = F.try_variant_get(document, "$." + key, "variant")
            found.append(F.when(flat.isNull(), _scalar(nested)).otherwise(_scalar(flat)))
        else:
            found.append(_scalar(flat))
    return F.coalesce(*found, F.lit(UNKNOWN_SOURCE))


def to_log_table(df: DataFrame, column: str, tenant: Column | str, now_ms: int | Column) -> DataFrame:
    """JSON text -> the canonical log columns; the record is parsed once.

    Level defaults to INFO, message to the whole record; text that is no JSON becomes the message.
    """
    tenant_col = F.lit(str(tenant)) if not isinstance(tenant, Column) else tenant
    parsed = df.withColumn("_doc", F.try_parse_json(F.col(column))).withColumn("_tenant", tenant_col)
    field = lambda name: F.try_variant_get("_doc", f"$.{name}", "string")
    return parsed.select(
        F.col("_tenant").cast("string").alias("tenant_id"),
        at_ms(coerce_event_ms(field("timestamp"), now_ms)).alias("timestamp"),
        resolve_source(F.col("_doc")).alias("source"),
        F.coalesce(field("level"), F.lit("INFO")).alias("level"),
        F.coalesce(field("message"), F.col(column)).alias("message"),
        F.col(column).alias("raw_json"),
    )
