"""Log explorer: rows, facets, histogram and patterns of one search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from logspark.operators.aggregate import facets, histogram, pattern_counts
from logspark.operators.filters import log_query, log_search, tenant_scope, time_between


@dataclass
class Explorer:
    rows: DataFrame
    facets: DataFrame
    histogram: DataFrame
    patterns: DataFrame


def log_explorer(
    logs: DataFrame, query: str = "", tenant: str | None = None, from_ms: int | None = None, to_ms: int | None = None,
    limit: int = 100, mode: str = "strict", facet_size: int = 20,
) -> Explorer:
    """Four views over one filter; each view reads only the columns it needs.

    The filter is not cached: on a large table the pruned scans are cheaper than keeping the rows.
    """
    scope = logs if tenant is None else tenant_scope(logs, tenant)
    found = time_between(log_search(scope, query, mode), from_ms, to_ms)
    return Explorer(
        log_query(scope, query, None, from_ms, to_ms, limit, mode=mode), facets(found, facet_size),
        histogram(scope, query, from_ms, to_ms, mode=mode), pattern_counts(found, limit),
    )
