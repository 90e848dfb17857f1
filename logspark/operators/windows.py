"""Ordered operators: rate limits, repeat suppression, open incidents, waterfalls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from logspark.functions.timing import DAY_MS, HOUR_MS, ms
from logspark.operators.relations import priority_rank, span_depth
from logspark.session import cut_lineage


def request_rates(requests: DataFrame, window: int, client: str = "client", time: str = "t") -> DataFrame:
    """Requests per client in (t - window, t], at every instant with a request.

    Requests of one instant are counted first. A client's time is cut into blocks of one window. Inside a
    block the number is a running sum: what the block before held, plus every count when it comes,
    minus those of the block before when they leave. That is linear in the instants, and no group holds
    more than two windows of distinct ones. ``window`` is in the unit of ``time``.
    """
    counted = requests.groupBy(F.col(client).alias("client"), F.col(time).alias("t")).agg(F.count("*").alias("requests"))
    block, n = F.floor(F.col("t") / window), F.col("requests")
    comes = counted.select("client", block.alias("block"), "t", "requests", n.alias("change"))
    leaves = counted.select("client", (block + 1).alias("block"), (F.col("t") + window).alias("t"), F.lit(None).cast("long").alias("requests"), (-n).alias("change"))
    held = counted.groupBy("client", (block + 1).alias("block")).agg(F.sum("requests").alias("change"))
    held = held.select("client", "block", (F.col("block") * window).alias("t"), F.lit(None).cast("long").alias("requests"), "change")
    running = W.partitionBy("client", "block").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    summed = comes.unionByName(leaves).unionByName(held).withColumn("in_window", F.sum("change").over(running))
    return summed.where(F.col("requests").isNotNull()).select("client", "t", "requests", "in_window")


def rate_limit_violations(requests: DataFrame, limit: int = 100, window: int = 60_000, client: str = "client", time: str = "t") -> DataFrame:
    return request_rates(requests, window, client, time).where(F.col("in_window") > limit)


def suppress_repeats(alerts: DataFrame, gap_ms: int = HOUR_MS) -> DataFrame:
    """``fingerprint, ts_ms, n, fired``: an alert fires when none with its fingerprint *fired* in the
    last ``gap_ms``.

    The first alert after a pause of ``gap_ms`` always fires. From a fired alert the next to fire is
    the first one at least ``gap_ms`` later: that successor is found for all alerts at once inside
    (fingerprint, gap-wide block) groups, and the chain is followed by doubling, so a stretch of k
    fired alerts takes log2(k) rounds and no fingerprint is ever folded in one task.
    """
    counted = alerts.groupBy("fingerprint", "ts_ms").agg(F.count("*").alias("n"))
    block = F.floor(F.col("ts_ms") / gap_ms)
    base = cut_lineage(counted.withColumn("block", block))
    heads = base.groupBy("fingerprint", "block").agg(F.min("ts_ms").alias("head"), F.max("ts_ms").alias("tail"))
    by_block = W.partitionBy("fingerprint").orderBy("block")  # one row per gap-wide block
    heads = heads.withColumn("prev_tail", F.lag("tail").over(by_block)).withColumn("next_block", F.lead("block").over(by_block)).withColumn(
        "next_head", F.lead("head").over(by_block)
    )
    # the block after next matters when the adjacent block ends before the target
    heads = heads.withColumn("after_head", F.lead("next_head").over(by_block))

    inside = W.partitionBy("fingerprint", "block").orderBy("ts_ms")
    with_prev = base.join(heads, ["fingerprint", "block"]).withColumn(
        "prev", F.coalesce(F.lag("ts_ms").over(inside), F.col("prev_tail"))
    )
    starts = F.col("prev").isNull() | (F.col("ts_ms") - F.col("prev") >= gap_ms)

    probes = with_prev.select(
        "fingerprint", (F.col("block") + 1).alias("block"), (F.col("ts_ms") + gap_ms).alias("at"), F.col("ts_ms").alias("source"),
        F.lit(None).cast("long").alias("event"),
        F.when(F.col("next_block") == F.col("block") + 1, F.col("after_head")).otherwise(F.col("next_head")).alias("fallback"),
        starts.alias("start"),
    )
    marks = base.select("fingerprint", "block", F.col("ts_ms").alias("at"), F.lit(None).cast("long").alias("source"),
                        F.col("ts_ms").alias("event"), F.lit(None).cast("long").alias("fallback"), F.lit(False).alias("start"))
    # a probe sorts before an event of the same instant, which it may take
    ahead = W.partitionBy("fingerprint", "block").orderBy("at", F.col("event").isNotNull()).rowsBetween(1, W.unboundedFollowing)
    linked = probes.unionByName(marks).withColumn("found", F.first("event", ignorenulls=True).over(ahead)).where(F.col("source").isNotNull())
    chain = linked.select("fingerprint", F.col("source").alias("ts_ms"), F.coalesce("found", "fallback").alias("next"), "start")
    chain = cut_lineage(chain)

    key = ["fingerprint", "ts_ms"]
    fired = chain.where("start").select(*key)
    # pointers into a start are not needed: it is fired already
    jump = chain.join(fired.withColumnRenamed("ts_ms", "next").withColumn("_s", F.lit(True)), ["fingerprint", "next"], "left").where(
        F.col("_s").isNull() & F.col("next").isNotNull()
    ).select("fingerprint", "ts_ms", "next")
    fired, jump = cut_lineage(fired), cut_lineage(jump)
    while not jump.isEmpty():
        reached = fired.join(jump, key).select("fingerprint", F.col("next").alias("ts_ms"))
        fired = cut_lineage(fired.unionByName(reached).distinct())
        second = jump.select("fingerprint", F.col("ts_ms").alias("next"), F.col("next").alias("_far"))
        jump = cut_lineage(jump.join(second, ["fingerprint", "next"]).select("fingerprint", "ts_ms", F.col("_far").alias("next")))
    return counted.join(fired.withColumn("_f", F.lit(True)), key, "left").select(
        "fingerprint", "ts_ms", "n", F.coalesce("_f", F.lit(False)).alias("fired")
    )


def open_incident_dedup(marks: DataFrame, keys: tuple[str, ...] = ("tenant_id", "service", "title"), block_ms: int = DAY_MS) -> DataFrame:
    """One incident per open period of a key.

    ``marks`` = keys, ``ts_ms``, ``resolved`` (true closes the open incident), ``summary``. The first
    breach of a period opens it, later ones refresh the summary. Closing marks are counted per block
    of time first, so a busy key is split over blocks; within an instant a closing mark counts last.
    """
    placed = marks.withColumn("_block", F.floor(F.col("ts_ms") / block_ms))
    closing = F.col("resolved").cast("int")
    blocks = placed.groupBy(*keys, "_block").agg(F.sum(closing).alias("_closed"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # one row per block
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_closed").over(before), F.lit(0))).drop("_closed")
    inside = W.partitionBy(*keys, "_block").orderBy("ts_ms", "resolved", "summary").rowsBetween(W.unboundedPreceding, -1)
    numbered = placed.withColumn("_inside", F.coalesce(F.sum(closing).over(inside), F.lit(0))).join(offsets, [*keys, "_block"])
    numbered = numbered.withColumn("period", F.col("_inside") + F.col("_offset"))
    breach = ~F.col("resolved")
    return (
        numbered.groupBy(*keys, "period")
        .agg(
            F.min(F.when(breach, F.col("ts_ms"))).alias("created_ms"),
            F.max_by(F.when(breach, F.col("summary")), F.when(breach, F.struct("ts_ms", "summary"))).alias("summary"),
            F.count_if(breach).alias("breaches"),
            F.max(F.when(F.col("resolved"), F.col("ts_ms"))).alias("resolved_ms"),
        )
        .where(F.col("breaches") > 0)
        .withColumn("status", F.when(F.col("resolved_ms").isNull(), "OPEN").otherwise("RESOLVED"))
    )


def span_waterfall(spans: DataFrame) -> DataFrame:
    """Spans with their offset from the trace start and their depth, in drawing order."""
    starts = spans.groupBy("trace_id").agg(F.min("start_time").alias("_first"))
    placed = spans.join(starts, "trace_id").withColumn("offset_ms", ms(F.col("start_time")) - ms(F.col("_first"))).drop("_first")
    return placed.join(span_depth(spans), ["trace_id", "span_id"]).orderBy("trace_id", "start_time", "span_id")


def max_priority(clusters: DataFrame) -> DataFrame:
    """Worst priority of a run and whether it alerts (P0-P2) and mails (P0, P1)."""
    rank = clusters.agg(F.coalesce(F.min(priority_rank(F.col("priority"), 3)), F.lit(3)).alias("rank"))
    return rank.select(
        F.concat(F.lit("P"), F.col("rank").cast("string")).alias("max_priority"), (F.col("rank") <= 2).alias("alerts"), (F.col("rank") <= 1).alias("mails")
    )
