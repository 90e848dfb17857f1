"""Log files: text, JSON lines, mixed folders, multi-source batches, telemetry, inventory."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from logspark.functions.timing import at_ms, ms

# File kinds read as logs, and the longest message kept.
LOG_EXTENSIONS = (".log", ".txt", ".jsonl", ".ndjson", ".json")
JSON_EXTENSIONS = (".json", ".jsonl", ".ndjson")
WHITE_SPACE = " \t\r\n\x0b\x0c"

# Fixed values: `ts LEVEL [source] message`.
PLAIN_SHAPE = r"^([\d-]+\w[\d:.]+Z?)\s+(\w+)\s+\[(.*?)\]\s+(.*)"


def _glob(extensions: Sequence[str]) -> str:
    return "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"


def _lines(spark: SparkSession, path: str | list[str], extensions: Sequence[str]) -> DataFrame:
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(extensions))
        .text(path)
        .select(F.trim(F.make_valid_utf8("value"), F.lit(WHITE_SPACE)).alias("line"), F.col("_metadata").alias("_file"))
    )


def _cut(text: Column, max_len: int | None) -> Column:
    return text if max_len is None else F.substring(text, 1, max_len)


def read_text_logs(
    spark: SparkSession,
    path: str | list[str],
    extensions: Sequence[str] = LOG_EXTENSIONS,
    max_len: int | None = None,
    line_numbers: bool = False,
) -> DataFrame:
    """Recursive scan -> ``raw_text, source[, line_number]``; blank lines dropped, cut to ``max_len`` if given.

    Line numbers are 1-based and count blanks. They come from each row's place in its file split
    plus a table of split offsets (one row per split), so a huge file is never put into one task.
    """
    lines = _lines(spark, path, extensions).withColumn("source", F.col("_file.file_path"))
    kept = [_cut(F.col("line"), max_len).alias("raw_text"), "source"]
    if not line_numbers:
        return lines.where(F.col("line") != "").select(*kept)

    placed = lines.withColumn("_start", F.col("_file.file_block_start")).withColumn(
        "_at", F.monotonically_increasing_id()
    )
    splits = placed.groupBy("source", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy("source").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    earlier = splits.select(
        "source", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.join(earlier, ["source", "_start"])
        .where(F.col("line") != "")
        .select(*kept, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias("line_number"))
    )


def _json_object(line: Column) -> Column:
    """The line as VARIANT when it holds a JSON object, else null."""
    value = F.try_parse_json(line)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), value)


def _with_message(df: DataFrame, line: str, is_json: Column, max_len: int | None) -> DataFrame:
    """Add raw_text (message, else msg, else the line) and metadata (the whole object)."""
    parsed = df.withColumn("_object", F.when(is_json, _json_object(F.col(line))))
    text = F.coalesce(
        F.try_variant_get("_object", "$.message", "string"),
        F.try_variant_get("_object", "$.msg", "string"),
        F.col(line),
    )
    return parsed.withColumn("raw_text", _cut(text, max_len)).withColumn(
        "metadata", F.when(F.col("_object").isNotNull(), F.col(line))
    ).drop("_object")


def read_json_logs(
    spark: SparkSession, path: str | list[str], max_len: int | None = None, extensions: Sequence[str] = JSON_EXTENSIONS
) -> DataFrame:
    """JSON-lines files -> ``raw_text, source, metadata``; a line that is no object stays plain text.

    The line is parsed whole; only the message is cut, if ``max_len`` is given.
    """
    lines = _lines(spark, path, extensions).where(F.col("line") != "")
    out = _with_message(lines, "line", F.lit(True), max_len)
    return out.select("raw_text", F.col("_file.file_path").alias("source"), "metadata")


def sniff_json_lines(df: DataFrame, column: str, max_len: int | None = None) -> DataFrame:
    """Per line: parse only what starts with ``{`` and ends with ``}``; adds raw_text and metadata."""
    line = F.col(column)
    return _with_message(df, column, F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}")), max_len)


def parse_plain_logs(df: DataFrame, column: str) -> DataFrame:
    """``ts LEVEL [source] msg`` -> timestamp, level, source, message; anything else is message only."""
    line = F.trim(F.col(column), F.lit(WHITE_SPACE))
    part = lambda i: F.nullif(F.regexp_extract(line, PLAIN_SHAPE, i), F.lit(""))
    matched = line.rlike(PLAIN_SHAPE)
    stamp = F.try_to_timestamp(F.concat(F.rtrim(part(1), F.lit("Z")), F.lit("Z")))
    return (
        df.withColumn("timestamp", stamp)
        .withColumn("level", F.upper(part(2)))
        .withColumn("source", F.when(matched, F.regexp_extract(line, PLAIN_SHAPE, 3)))
        .withColumn("message", F.when(matched, F.regexp_extract(line, PLAIN_SHAPE, 4)).otherwise(line))
    )


def read_mixed_logs(
    spark: SparkSession,
    folder: str,
    file_name: str | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    tenant: str | None = None,
    extensions: Sequence[str] = (".log",),
) -> DataFrame:
    """A folder of ``*.log`` files with JSON and plain lines mixed, newest first.

    ``_file`` names the file, the default source is its stem. Rows without a time pass the bounds.
    """
    lines = _lines(spark, os.path.join(folder, file_name) if file_name else folder, extensions)
    lines = lines.where(F.col("line") != "").select("line", F.col("_file.file_name").alias("_file"))
    plain = parse_plain_logs(lines, "line").withColumn("_object", _json_object(F.col("line")))
    field = lambda name: F.try_variant_get("_object", f"$.{name}", "string")
    is_json = F.col("_object").isNotNull()
    stamp = at_ms((F.try_variant_get("_object", "$.timestamp", "decimal(28,6)") * 1000).try_cast("long"))
    stem = F.regexp_replace(F.col("_file"), r"\.[^.]*$", "")
    out = plain.select(
        F.when(is_json, stamp).otherwise(F.col("timestamp")).alias("timestamp"),
        F.coalesce(F.nullif(F.when(is_json, field("source")).otherwise(F.col("source")), F.lit("")), stem).alias("source"),
        F.when(is_json, field("level")).otherwise(F.col("level")).alias("level"),
        F.when(is_json, field("message")).otherwise(F.col("message")).alias("message"),
        F.when(is_json, F.col("line")).alias("raw_json"),
        F.coalesce(field("_tenant_id"), field("tenant_id")).alias("tenant_id"),
        "_file",
    )
    if from_ms is not None:
        out = out.where(F.col("timestamp").isNull() | (F.col("timestamp") >= at_ms(from_ms)))
    if to_ms is not None:
        out = out.where(F.col("timestamp").isNull() | (F.col("timestamp") <= at_ms(to_ms)))
    if tenant is not None:
        out = out.where(F.col("tenant_id") == str(tenant))
    return out.orderBy(F.coalesce(ms(F.col("timestamp")), F.lit(0)).desc())


def union_sources(frames: Sequence[DataFrame], labels: Sequence[str]) -> DataFrame:
    """One batch out of several sources; every row carries its ``source_label``."""
    if not frames:
        raise ValueError("no sources to read")
    out = None
    for frame, label in zip(frames, labels, strict=True):
        labelled = frame.withColumn("source_label", F.lit(label))
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    return out


def read_sources(spark: SparkSession, paths: Sequence[str], line_numbers: bool = False) -> DataFrame:
    """Text logs of several paths; a path that cannot be read is skipped, none left is an error."""
    frames, labels = [], []
    for path in paths:
        try:
            frames.append(read_text_logs(spark, path, line_numbers=line_numbers))
        except AnalysisException:
            continue
        labels.append(os.path.splitext(os.path.basename(path.rstrip("/")))[0])
    return union_sources(frames, labels)


TELEMETRY_FIELDS = (
    "cpu_percent", "memory_percent", "memory_used_mb", "disk_iops", "disk_read_iops", "disk_write_iops",
    "disk_read_bytes_per_s", "disk_write_bytes_per_s", "network_drops", "network_errors",
    "network_drops_per_s", "network_errors_per_s",
)
TELEMETRY_SCHEMA = "timestamp double, " + ", ".join(f"{f} double" for f in TELEMETRY_FIELDS)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Host telemetry JSON lines; only points with a numeric positive timestamp (epoch ms).

    Rows come unsorted: consumers that need order (as-of, tails) sort by ``timestamp`` themselves.
    """
    points = spark.read.schema(TELEMETRY_SCHEMA).json(path)
    return points.where(F.col("timestamp") > 0).withColumn("timestamp", F.col("timestamp").cast("long"))


def human_size(size: Column) -> Column:
    """Bytes as B / KB / MB / GB text."""
    scaled = lambda power, unit: F.format_string(f"%.1f {unit}", size / float(1024**power))
    return (
        F.when(size < 1024, F.format_string("%d B", size))
        .when(size < 1024**2, scaled(1, "KB"))
        .when(size < 1024**3, scaled(2, "MB"))
        .otherwise(scaled(3, "GB"))
    )


def source_inventory(
    spark: SparkSession, folder: str, exclude: Sequence[str] = ("settings.json",)
) -> DataFrame:
    """Per file: size, readable size, modification time and exact line count, newest first."""
    lines = _lines(spark, folder, LOG_EXTENSIONS).where(~F.col("_file.file_name").isin(*exclude))
    files = lines.groupBy(
        F.col("_file.file_name").alias("name"),
        F.col("_file.file_path").alias("path"),
        F.col("_file.file_size").alias("size_bytes"),
        F.col("_file.file_modification_time").alias("modified"),
    ).agg(F.count("*").alias("lines"))
    return files.withColumn("size", human_size(F.col("size_bytes"))).orderBy(F.col("modified").desc(), "path")
