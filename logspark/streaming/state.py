"""Stateful streams: metrics, template counts, rate limits, alert suppression."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from logspark.functions.timing import HOUR_MS, at_ms, ms
from logspark.operators.aggregate import dedupe_templates, metric_matches, metric_value


def stream_metrics(logs: DataFrame, rules: Sequence[dict], lateness: str = "10 minutes") -> DataFrame:
    """``extract_metrics`` on a stream for rules of one window width.

    Windows close ``lateness`` behind the newest event time; rows for a closed window are dropped
    and counted by ``LateRows``. Rules of other widths run as queries of their own
    (``rules_by_width``), because the watermark of a wide window must not close a narrow one.
    """
    widths = {int(r.get("window_seconds", 60)) for r in rules}
    if len(widths) != 1:
        raise ValueError("one query per window width, see rules_by_width")
    width = widths.pop()
    matched = metric_matches(logs, rules)
    # the start of the window is enough of an event time: all rows of a window share it
    timed = matched.withColumn("bucket", at_ms(F.col("bucket_ms"))).withWatermark("bucket", lateness)
    kinds = sorted({r.get("aggregation", "count") for r in rules})
    grouped = timed.groupBy(F.window("bucket", f"{width} seconds"), "rule_id").agg(*[metric_value(k).alias(k) for k in kinds])
    value = F.lit(None).cast("double")
    for kind in kinds:
        ids = [r["id"] for r in rules if r.get("aggregation", "count") == kind]
        value = F.when(F.col("rule_id").isin(ids), F.col(kind)).otherwise(value)
    return grouped.select("rule_id", ms(F.col("window.start")).alias("bucket_ms"), value.alias("value"))


def rules_by_width(rules: Sequence[dict]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for rule in rules:
        if rule.get("enabled", True):
            out.setdefault(int(rule.get("window_seconds", 60)), []).append(rule)
    return out


class LateRows(StreamingQueryListener):
    """Rows that queries dropped because their window was closed, counted from every progress report.

    Add it to ``spark.streams`` before the query starts. Reports come after their batch, so ``of`` waits for a
    stopped query's last one.
    """

    def __init__(self):
        self._lock, self._rows, self._ended = threading.Condition(), {}, set()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        with self._lock:
            key = str(event.progress.runId)
            self._rows[key] = self._rows.get(key, 0) + dropped

    def onQueryTerminated(self, event):
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def of(self, query: StreamingQuery, seconds: float = 30.0) -> int:
        """Late rows of a run so far; of all of it once it has stopped."""
        key = str(query.runId)
        with self._lock:
            if not query.isActive:
                self._lock.wait_for(lambda: key in self._ended, seconds)
            return self._rows.get(key, 0)


def count_late_rows(spark: SparkSession) -> LateRows:
    """A ``LateRows`` that listens to all queries of the session."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener


def _state_store(df: DataFrame) -> None:
    """Timers and lists need the RocksDB state store; queries started from an earlier checkpoint keep theirs."""
    df.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_template_counts(records: DataFrame, key=None, idle_ms: int | None = None, lateness: str = "10 minutes", time: str = "timestamp") -> DataFrame:
    """Running occurrences per template; write in update mode.

    Without ``idle_ms`` a template's count is kept for good. With it, a template leaves the state store once the
    watermark (``lateness`` behind the newest ``time``) is ``idle_ms`` past its last row, and counts from
    one when it comes again: state is bounded by the templates in use, and a replay gives the same counts.
    Every task adds up its rows first: one row per template, task and batch is shuffled, with its latest time.
    """
    if idle_ms is None:
        return dedupe_templates(records, key)
    _state_store(records)
    template = F.col("template") if key is None else key

    def combine(batches):
        for pdf in batches:
            yield pdf.groupby("template", dropna=False, as_index=False).agg(n=("n", "sum"), at=("at", "max"))

    rows = records.select(template.alias("template"), F.lit(1).cast("long").alias("n"), F.col(time).alias("at"))
    partial = rows.mapInPandas(combine, "template string, n long, at timestamp").withWatermark("at", lateness)
    return partial.groupBy("template").transformWithStateInPandas(
        _IdleCounts(idle_ms), "template string, n long", outputMode="Update", timeMode="EventTime")


class _IdleCounts(StatefulProcessor):
    """Count and latest time per template; one timer, moved on when it finds that rows came since."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        known = self.seen.exists()
        total, last = self.seen.get() if known else (0, -(2**62))
        for pdf in rows:
            total += int(pdf["n"].sum())
            last = max(last, int(pdf["at"].max().value // 1_000_000))
        self.seen.update((total, last))
        if not known:
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"template": [key[0]], "n": [total]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        if self.seen.exists():
            due = self.seen.get()[1] + self.idle_ms
            if due > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(due)
            else:
                self.seen.clear()
        yield pd.DataFrame({"template": pd.Series([], dtype=str), "n": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, limit: int = 100, window: str = "60 seconds", slide: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Clients over the limit in some hopping window: the sliding window read at every ``slide``."""
    counted = requests.withWatermark("timestamp", lateness).groupBy(F.window("timestamp", window, slide), "client").agg(F.count("*").alias("requests"))
    return counted.where(F.col("requests") > limit).select("client", ms(F.col("window.start")).alias("from_ms"), ms(F.col("window.end")).alias("to_ms"), "requests")


def stream_alert_suppression(alerts: DataFrame, gap_ms: int = HOUR_MS, lateness: str | None = None) -> DataFrame:
    """Alerts that fire: none with the same fingerprint *fired* in the last ``gap_ms``.

    ``alerts`` = ``fingerprint, ts_ms``. With ``lateness`` an alert is held until the watermark has passed it,
    so what fires does not depend on how alerts are spread over micro-batches. Held instants are a list in the
    state store, to which a batch appends; a timer per fingerprint wakes it when the watermark passes its earliest
    one, and once more when the gap is over and its state goes. Instants that repeat within a batch and task are
    sent once. Without ``lateness`` every micro-batch is folded at once, in time order, and an alert older than the
    last fired one never fires.
    """
    _state_store(alerts)
    if lateness is not None:
        alerts = alerts.withColumn("_at", F.timestamp_millis("ts_ms")).withWatermark("_at", lateness)
    return alerts.groupBy("fingerprint").transformWithStateInPandas(
        _Suppress(gap_ms, lateness is not None), "fingerprint string, ts_ms long", outputMode="Append", timeMode="EventTime" if lateness is not None else "None")


class _Suppress(StatefulProcessor):
    """Last fired instant, the instants still held, and when the next timer of a fingerprint is due."""

    def __init__(self, gap_ms: int, held: bool):
        self.gap_ms, self.held = gap_ms, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long")
        self.wake = handle.getValueState("wake", "ts long")
        self.waiting = handle.getListState("waiting", "ts long")

    def _fire(self, key, times):
        import numpy as np
        import pandas as pd

        fired, last = [], self.last.get()[0] if self.last.exists() else None
        at = 0 if last is None else int(np.searchsorted(times, last + self.gap_ms, "left"))
        while at < len(times):
            last = int(times[at])
            fired.append(last)
            at = int(np.searchsorted(times, last + self.gap_ms, "left"))
        if fired:
            self.last.update((last,))
        return pd.DataFrame({"fingerprint": [key[0]] * len(fired), "ts_ms": np.array(fired, dtype=np.int64)})

    def _wake_at(self, when: int) -> None:
        if self.wake.exists():
            if self.wake.get()[0] <= when:
                return
            self.handle.deleteTimer(self.wake.get()[0])
        self.handle.registerTimer(when)
        self.wake.update((when,))

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np

        times = np.unique(np.concatenate([pdf["ts_ms"].to_numpy(np.int64) for pdf in rows]))
        if not self.held:
            yield self._fire(key, times)
            return
        self.waiting.appendList([(int(t),) for t in times])
        self._wake_at(int(times[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np

        passed = timerValues.getCurrentWatermarkInMs()
        self.wake.clear()
        times = np.unique(np.array([r[0] for r in self.waiting.get()], dtype=np.int64))
        out = self._fire(key, times[times <= passed])
        rest = times[times > passed]
        if len(rest):
            self.waiting.put([(int(t),) for t in rest])
            self._wake_at(int(rest[0]))
        else:
            self.waiting.clear()
            over = (self.last.get()[0] if self.last.exists() else passed) + self.gap_ms
            if over > passed:
                self._wake_at(over)
            else:
                self.last.clear()
        yield out

    def close(self) -> None:
        pass
