"""Kernel event rows -> nested ECS rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# event_type codes and their ECS words.
NETWORK_DROP, PROCESS_START = 1, 2


def until_nul(text: Column) -> Column:
    """A NUL-terminated buffer as text."""
    return F.substring_index(text, "\x00", 1)


def kernel_events_to_ecs(
    df: DataFrame, hostname: str = "node", family: str = "linux", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``timestamp(ms), event_type, pid, comm, filename, protocol`` -> ECS structs (+ ``keep`` columns)."""
    is_drop = F.col("event_type") == NETWORK_DROP
    word = lambda drop, start: F.when(is_drop, drop).otherwise(start)
    rows = df.where(F.col("event_type").isin(NETWORK_DROP, PROCESS_START))
    return rows.select(
        *keep,
        F.timestamp_millis("timestamp").alias("@timestamp"),
        F.struct(
            F.lit("event").alias("kind"),
            word("network", "process").alias("category"),
            word("denied", "start").alias("type"),
            word("ebpf.network", "ebpf.process").alias("dataset"),
            word("drop", "execve").alias("action"),
        ).alias("event"),
        F.when(is_drop, F.struct(F.col("protocol").alias("transport"))).alias("network"),
        F.struct(
            F.lit(hostname).alias("hostname"),
            F.struct(F.lit("linux").alias("platform"), F.lit(family).alias("family")).alias("os"),
        ).alias("host"),
        F.when(
            ~is_drop,
            F.struct(
                F.col("pid"),
                until_nul(F.col("comm")).alias("name"),
                until_nul(F.coalesce("filename", F.lit(""))).alias("executable"),
            ),
        ).alias("process"),
    )
