"""Topics or folders of JSON messages -> log and span tables.

Every transform here works on batch and streaming DataFrames alike; only ``open_*`` and ``start_*``
touch the streaming API. Logs and spans run as separate queries with their own checkpoints, so a hot
topic cannot hold the other back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logspark.functions.text import infer_level
from logspark.operators.storage import Files, write_logs
from logspark.sources.otlp import flatten_otlp_spans
from logspark.sources.records import to_log_table

# Tenant of unmarked messages, micro-batch interval.
DEFAULT_TENANT = "default_tenant"
LINGER = "2 seconds"


def open_topic(spark: SparkSession, servers: str, topic: str, max_rows: int | None = None) -> DataFrame:
    """Kafka topic -> ``value`` text; ``max_rows`` bounds a micro-batch where memory asks for it."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_rows is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_rows)
    return reader.load().select(F.col("value").cast("string"))


def open_folder(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Folder of text files, one message per line -> ``value`` text."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def _now() -> Column:
    return F.unix_millis(F.current_timestamp())


def message_tenant(value: Column) -> Column:
    return F.coalesce(F.get_json_object(value, "$._tenant_id"), F.lit(DEFAULT_TENANT))


def is_message(value: Column) -> Column:
    """True for a JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(value)), F.lit("OBJECT")), F.lit(False))


def quarantine(messages: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(usable messages, rejected ones)."""
    ok = is_message(F.col(column))
    return messages.where(ok), messages.where(~ok)


def stream_logs(messages: DataFrame, column: str = "value", now_ms: int | Column | None = None) -> DataFrame:
    """JSON messages -> canonical log rows with the tenant they carry."""
    return to_log_table(messages, column, message_tenant(F.col(column)), _now() if now_ms is None else now_ms)


def stream_traces(messages: DataFrame, column: str = "value", now_ms: int | Column | None = None) -> DataFrame:
    """OTLP trace documents -> span rows with the tenant they carry."""
    marked = messages.select(F.col(column).alias("value"))
    tenants = marked.withColumn("tenant_id", message_tenant(F.col("value")))
    return flatten_otlp_spans(tenants, "value", _now() if now_ms is None else now_ms, keep=("tenant_id",))


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: a repeated batch replaces its own partition, so nothing doubles."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    return write


def compact_batches(
    spark: SparkSession, inbox: str, table: str, through: int | None = None, write: Callable[..., None] = write_logs
) -> int:
    """Move batches of ``idempotent_sink`` to a table that ``read_stored`` reads, every row once; returns how many were taken.

    Batches up to ``through`` are taken; by default all but the newest, which a restarted stream may write again. They leave
    the inbox by a rename, are written together by ``write`` (tenant and day, few sorted files), and their files then move
    into the table. A job lost on the way is completed by the next call: what was taken is written again only if it
    was not written whole, and files that have moved are not there to move again. Inbox and table are on one file system; one call at a time.
    """
    files = Files(spark, inbox)
    ids = sorted(int(n[9:]) for n in files.names(inbox, "batch_id="))
    last = through if through is not None else (ids[-1] - 1 if ids else -1)
    take, name = [i for i in ids if i <= last], uuid.uuid4().hex
    for i in take:
        files.move(f"{inbox}/batch_id={i}", f"{inbox}/.taken/{name}/batch_id={i}")
    for name in sorted({*files.names(f"{inbox}/.taken"), *files.names(f"{inbox}/.staged")}):
        taken, staged = f"{inbox}/.taken/{name}", f"{inbox}/.staged/{name}"
        if not files.exists(f"{staged}/_SUCCESS"):
            write(spark.read.parquet(taken).drop("batch_id"), staged, mode="overwrite")
        for home in files.names(staged, "tenant_id="):
            for day in files.names(f"{staged}/{home}", "date="):
                files.move(f"{staged}/{home}/{day}", f"{table}/{home}/{day}")
        files.delete(taken)  # before what tells that it was written
        files.delete(staged)
    return len(take)


def start_log_ingest(
    messages: DataFrame, path: str, rejects: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Good rows and rejects of each micro-batch to their tables; offsets move after both writes."""
    store, refuse = idempotent_sink(path), idempotent_sink(rejects)

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("_ok", is_message(F.col("value"))).persist()  # read and judged once for both tables
        try:
            store(stream_logs(marked.where("_ok")), batch_id)
            refuse(marked.where("NOT _ok").drop("_ok"), batch_id)
        finally:
            marked.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"processingTime": LINGER})
    ).start()


def start_trace_ingest(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    store = idempotent_sink(path)
    return messages.writeStream.foreachBatch(lambda b, i: store(stream_traces(quarantine(b)[0]), i)).option(
        "checkpointLocation", checkpoint
    ).trigger(**(trigger or {"processingTime": LINGER})).start()


def live_tail(messages: DataFrame, tenant: str | None = None, level: str | None = None, service: str | None = None, column: str = "value", width: int | None = None) -> DataFrame:
    """Display rows of the live view: level, service, message (cut to ``width`` if given); plain lines are kept too."""
    value = F.col(column)
    ok = is_message(value)
    field = lambda name: F.when(ok, F.get_json_object(value, f"$.{name}"))
    text = F.coalesce(field("message"), field("log"), value)
    rows = messages.select(
        F.when(ok, message_tenant(value)).otherwise(F.lit(DEFAULT_TENANT)).alias("tenant_id"),
        infer_level(text, field("level")).alias("level"),
        F.when(ok, F.coalesce(field("service"), F.lit("api"))).otherwise("unknown").alias("service"),
        (text if width is None else F.substring(text, 1, width)).alias("message"), field("timestamp").alias("timestamp"),
    )
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == str(tenant))
    if level is not None:
        rows = rows.where(F.col("level") == level.upper())
    if service is not None:
        rows = rows.where(F.contains(F.lower("service"), F.lit(service.lower())))
    return rows


def watch_directory(spark: SparkSession, folder: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Run ``on_batch`` over the lines of new files; default: all that is there, then stop."""
    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    rows = lines.select(F.col("value").alias("raw_text"), F.col("_metadata.file_path").alias("source"))
    return rows.where(F.trim("raw_text") != "").writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", checkpoint
    ).trigger(**(trigger or {"availableNow": True})).start()
