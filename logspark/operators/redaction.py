"""Redaction as a scan job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logspark.functions.text import redaction_hits


def redaction_report(df: DataFrame, column: str, by: str = "source") -> DataFrame:
    """``source, rule, hits``: matches of every rule per source.

    All rules are summed in one aggregation; only the small result is turned into rows.
    """
    hits = redaction_hits(F.col(column))
    wide = df.groupBy(by).agg(*[F.coalesce(F.sum(count), F.lit(0)).alias(name) for name, count in hits])
    return wide.unpivot([by], [name for name, _ in hits], "rule", "hits")
