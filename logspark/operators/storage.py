"""Sinks, retention, archive tiers, metering and the baseline store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from logspark.functions.timing import DAY_MS, at_ms, ms
from logspark.operators.filters import time_between

# Days kept per tier; any other tier keeps the smallest.
TIER_DAYS = {"pro": 30, "enterprise": 90}
DEFAULT_DAYS = 7


def _utc_date(timestamp: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms(timestamp) / DAY_MS).cast("int"))


def _write_by_day(df: DataFrame, path: str, time: str, order: tuple[str, ...], mode: str) -> None:
    """Partitioned by tenant and day, range-partitioned on the sort key first.

    Ranges are sampled, so a tenant that holds a third of the rows gets a third of the tasks, and
    every file is sorted: row-group statistics prune on source and time.
    """
    dated = df.withColumn("date", _utc_date(F.col(time)))
    keys = ["tenant_id", "date", *order]
    dated.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).partitionBy("tenant_id", "date").parquet(path)


def write_logs(df: DataFrame, path: str, mode: str = "append") -> None:
    _write_by_day(df, path, "timestamp", ("source", "timestamp"), mode)


def write_spans(df: DataFrame, path: str, tenant: str | None = None, mode: str = "append") -> None:
    if tenant is not None:
        df = df.withColumn("tenant_id", F.lit(str(tenant)))
    _write_by_day(df, path, "start_time", ("service_name", "start_time"), mode)


def read_stored(spark: SparkSession, path: str, *days: str) -> DataFrame:
    """A table written by ``write_logs`` / ``write_spans``; tenant ids stay text, whatever they look like.

    The ``date`` partition column stays: ``time_between`` uses it to skip whole days. With ``days``, only those
    folders of the table are listed and read.
    """
    reader = spark.read.option("basePath", path)
    found = reader.parquet(*(days or (path,))).schema
    typed = StructType([StructField(f.name, StringType()) if f.name == "tenant_id" else f for f in found.fields])
    return reader.schema(typed).parquet(*(days or (path,)))


def apply_retention(df: DataFrame, tenants: DataFrame, now_ms: int, time: str = "timestamp") -> DataFrame:
    """Drop rows older than the tenant's tier allows; rows of unlisted tenants stay."""
    days = F.lit(DEFAULT_DAYS)
    for tier, keep in TIER_DAYS.items():
        days = F.when(F.col("tier") == tier, keep).otherwise(days)
    limits = tenants.select(F.col("id").cast("string").alias("tenant_id"), (F.lit(now_ms) - days.cast("long") * DAY_MS).alias("_from"))
    kept = df.join(limits, "tenant_id", "left").where(F.col("_from").isNull() | (ms(F.col(time)) >= F.col("_from")))
    return kept.select(*df.columns)


# Folders of a table that readers do not see: days taken out of it, and what stays of a boundary day.
EXPIRED, REST = ".expired", ".rest"


class Files:
    """The file system of a path: folders, moves, deletions."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str, prefix: str = "", folders: bool = True) -> list[str]:
        """Names below ``folder``, in order; none if it does not exist."""
        if not self.exists(folder):
            return []
        found = self.fs.listStatus(self._path(folder))
        return sorted(x.getPath().getName() for x in found if x.isDirectory() == folders and x.getPath().getName().startswith(prefix))

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self._path(folder))

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def move(self, source: str, target: str) -> None:
        """Rename; a folder that is there already takes the files of ``source`` in."""
        if self.exists(target):
            for name in self.names(source, folders=False):
                self.move(f"{source}/{name}", f"{target}/{name}")
            return
        self.make(target.rsplit("/", 1)[0])
        if not self.fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target}")


def _finish(files: Files, path: str) -> None:
    """Complete what a lost job left: days it took out get back what stays of them, rows it dropped go."""
    for name in files.names(f"{path}/{REST}"):
        rest = f"{path}/{REST}/{name}"
        for home in files.names(rest, "tenant_id="):
            for day in files.names(f"{rest}/{home}", "date="):
                if files.exists(f"{path}/{EXPIRED}/{name}/{home}/{day}"):  # else the day is still whole
                    files.move(f"{rest}/{home}/{day}", f"{path}/{home}/{day}")
        files.delete(rest)
    for name in files.names(f"{path}/{EXPIRED}", "drop_"):
        files.delete(f"{path}/{EXPIRED}/{name}")


def _set_aside(spark: SparkSession, path: str, keep_from: Callable[[str], int | None], time: str, name: str) -> int:
    """Move the days that hold rows before ``keep_from(tenant)`` to ``EXPIRED/name``; returns how many.

    Whole days are renamed and never read. Of boundary days (one job for all with the same bound) what stays is written to
    ``REST/name`` first; a day is taken out only then, and what stays takes its place. A job lost in between is completed by the
    next call. The file system must rename; one call at a time may run, and nothing may be appended to an
    expired day meanwhile.
    """
    files = Files(spark, path)
    _finish(files, path)
    aside, rest = f"{path}/{EXPIRED}/{name}", f"{path}/{REST}/{name}"
    out: list[str] = []
    split: dict[int, list[str]] = {}
    for home in files.names(path, "tenant_id="):
        bound = keep_from(unquote(home[10:]))  # special characters of a name are escaped on disk
        if bound is None:
            continue
        edge = bound - bound % DAY_MS
        for day in files.names(f"{path}/{home}", "date="):
            if day == "date=__HIVE_DEFAULT_PARTITION__":  # rows without a time never expire
                continue
            start = int(datetime.fromisoformat(day[5:]).replace(tzinfo=timezone.utc).timestamp() * 1000)
            if start < edge or start == edge < bound:
                out.append(f"{home}/{day}")
            if start == edge < bound:
                split.setdefault(bound, []).append(f"{path}/{home}/{day}")
    for bound, days in split.items():
        read_stored(spark, path, *days).where(F.col(time) >= at_ms(bound)).write.mode("append").partitionBy("tenant_id", "date").parquet(rest)
    for day in out:
        files.move(f"{path}/{day}", f"{aside}/{day}")
        if files.exists(f"{rest}/{day}"):
            files.move(f"{rest}/{day}", f"{path}/{day}")
    files.delete(rest)
    return len(out)


def prune_table(spark: SparkSession, path: str, keep_from_ms: int, time: str = "timestamp", tenant: str | None = None) -> int:
    """Remove rows before ``keep_from_ms`` from a stored table, of one tenant or of all; returns the partitions changed.

    Whole expired (tenant, date) partitions go without reading a row, only boundary days are rewritten (``_set_aside``).
    A job lost on the way loses no row that stays. Rows without a time stay.
    """
    changed = _set_aside(spark, path, lambda t: keep_from_ms if tenant in (None, t) else None, time, f"drop_{uuid.uuid4().hex}")
    _finish(Files(spark, path), path)
    return changed


def retain(spark: SparkSession, path: str, tenants: DataFrame, now_ms: int, time: str = "timestamp") -> int:
    """Apply every listed tenant's tier to a stored table as ``prune_table`` does, in one walk over its folders; ``tenants`` is a small table."""
    bounds = {str(r["id"]): now_ms - TIER_DAYS.get(r["tier"], DEFAULT_DAYS) * DAY_MS for r in tenants.select("id", "tier").toLocalIterator()}
    changed = _set_aside(spark, path, bounds.get, time, f"drop_{uuid.uuid4().hex}")
    _finish(Files(spark, path), path)
    return changed


def archive_table(spark: SparkSession, path: str, archive: str, cutoff_ms: int, time: str = "timestamp") -> int:
    """Move what is older than ``cutoff_ms`` from a stored table to an archive, every row once; returns the partitions changed.

    Expired days leave the table by a rename, are written next to the archive, and are deleted only when their files are
    in it. The files carry the name of the move, so a job lost on the way is completed by the next call, which replaces them.
    """
    files = Files(spark, path)
    changed = _set_aside(spark, path, lambda _: cutoff_ms, time, f"keep_{cutoff_ms}_{uuid.uuid4().hex}")
    target = Files(spark, archive)
    target.make(archive)
    for name in files.names(f"{path}/{EXPIRED}", "keep_"):
        held, staged = f"{path}/{EXPIRED}/{name}", f"{archive}/.{name}"
        old = read_stored(spark, held).where(F.col(time) < at_ms(int(name.split("_")[1]))).drop("date")
        write_archive(old, staged, "overwrite")
        for file in target.names(archive, name, folders=False):
            target.delete(f"{archive}/{file}")
        for file in target.names(staged, "part-", folders=False):
            target.move(f"{staged}/{file}", f"{archive}/{name}-{file}")
        target.delete(staged)
        files.delete(held)
    return changed


def archive_split(df: DataFrame, cutoff_ms: int, time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(to archive, stays hot): one predicate and its complement."""
    old = F.col(time) < at_ms(cutoff_ms)
    expired, hot = df.where(old), df.where(~F.coalesce(old, F.lit(False)))
    if ("date", "date") in df.dtypes:  # whole days drop out of either scan
        day = F.date_from_unix_date(F.lit(cutoff_ms // DAY_MS).cast("int"))
        expired, hot = expired.where(F.col("date") <= day), hot.where(F.col("date").isNull() | (F.col("date") >= day))
    return expired, hot


def write_archive(old: DataFrame, path: str, mode: str = "append") -> None:
    """gzip JSON lines. Write this before the hot table is pruned."""
    old.write.mode(mode).option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def read_archive(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def hydrate_spans(hot: DataFrame, archive: DataFrame) -> DataFrame:
    """Hot spans plus archived ones whose span_id is not present."""
    missing = archive.join(hot.select("span_id"), "span_id", "left_anti").dropDuplicates(["span_id"])
    return hot.unionByName(missing.select(*hot.columns))


def hydrate_logs(hot: DataFrame, archive: DataFrame, now_ms: int) -> DataFrame:
    """Hot logs plus all archived ones, gaps filled with the defaults; nothing is deduplicated."""
    defaults = {
        "tenant_id": F.lit("default"), "timestamp": at_ms(now_ms), "source": F.lit("unknown"), "level": F.lit("INFO"),
        "message": F.lit(""), "raw_json": F.lit("{}"),
    }
    filled = archive.select(*[F.coalesce(F.col(c), d).alias(c) if c in archive.columns else d.alias(c) for c, d in defaults.items()])
    return hot.select(*defaults).unionByName(filled)


def purge_old_rows(df: DataFrame, time: str, now_ms: int, days: int) -> DataFrame:
    cutoff = at_ms(now_ms - days * DAY_MS)
    return df.where(F.col(time).isNull() | (F.col(time) >= cutoff))


def billing_meter(logs: DataFrame, tenants: DataFrame, day_ms: int) -> DataFrame:
    """Per tenant: rows and message bytes of one UTC day; silent tenants count 0."""
    start = day_ms - day_ms % DAY_MS
    day = time_between(logs, start, start + DAY_MS - 1).where(F.col("timestamp") < at_ms(start + DAY_MS))
    used = day.groupBy("tenant_id").agg(F.count("*").alias("_rows"), F.sum(F.octet_length("message")).alias("_bytes"))
    listed = tenants.select(F.col("id").cast("string").alias("tenant_id"))
    return listed.join(used, "tenant_id", "left").select(
        "tenant_id", F.lit(start).alias("day_ms"), F.coalesce("_rows", F.lit(0)).alias("total_logs"),
        F.coalesce("_bytes", F.lit(0)).alias("total_bytes"),
    )


def write_billing(meter: DataFrame, path: str) -> None:
    """Re-running a day replaces that day only."""
    meter.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day_ms").parquet(path)


def baseline_build(clusters: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(baseline rows without noise, one metadata row)."""
    kept = clusters.where(F.col("cluster_id") != -1).join(centers.select("cluster_id", F.col("centroid").alias("vector")), "cluster_id")
    rows = kept.select(
        F.col("cluster_id").cast("int").alias("cluster_id"), "vector", "size", "representative_template", "representative_raw",
        F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_acknowledged"),
    )
    meta = rows.agg(
        F.count("*").alias("cluster_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("logs_processed"), F.max(F.size("vector")).alias("dim")
    )
    return rows, meta


def write_baseline(rows: DataFrame, meta: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/centroids")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/centroids")


def baseline_annotate(baseline: DataFrame, updates: DataFrame) -> DataFrame:
    """Set label and / or acknowledgement by cluster id; a null leaves the old value, '' clears a label."""
    changes = updates.select("cluster_id", F.col("label").alias("_l"), F.col("is_acknowledged").alias("_a"))
    joined = baseline.join(changes, "cluster_id", "left")
    return joined.withColumn("label", F.nullif(F.coalesce("_l", "label"), F.lit(""))).withColumn(
        "is_acknowledged", F.coalesce("_a", "is_acknowledged")
    ).select(*baseline.columns)


def vector_rows(vectors: DataFrame, first: DataFrame, now_ms: int) -> DataFrame:
    """Rows for the vector table: id, vector, template, first source, first time (now when unknown)."""
    known = first.select("template", F.col("source").alias("_s"), F.unix_millis("timestamp").alias("_t"))
    return vectors.select("template", "vector").join(known, "template", "left").select(
        F.xxhash64("template").alias("id"), "vector", "template", F.coalesce("_s", F.lit("unknown")).alias("source"),
        F.coalesce("_t", F.lit(now_ms)).alias("timestamp"),
    )


def vector_append(vectors: DataFrame, first: DataFrame, path: str, now_ms: int) -> None:
    vector_rows(vectors, first, now_ms).write.mode("append").parquet(path)
