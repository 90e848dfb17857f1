"""Chat formatting by perspective: every participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from logspark.session import cut_lineage

PART_CHARS = 65_536  # a dialogue longer than this is rendered in parts, cut between messages
NARRATORS = ("system",)


def _head(kind: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), kind, F.lit("\n"))


TAIL = "<|im_end|>\n"


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
    part_chars: int = PART_CHARS, narrators: tuple[str, ...] = NARRATORS,
) -> DataFrame:
    """One row per conversation, participant and part: ``perspective``, ``part``, ``n_messages``, ``n_rows``, ``text``, ``loss``.

    The speaker named by ``perspective`` is rendered as ``assistant``, every other one as ``user name=...``;
    narrators (and null speakers) stay ``system`` and take no perspective. ``loss`` lists the spans of ``text``
    to train on (start, end in code points): the contents and end marks of the assistant's messages.

    Messages stand by turn (null last), then speaker, then text. Where a message starts is a sum over
    range partitions of the order and then over partitions, so a conversation with a third of all turns is
    spread over many tasks; a part is at most ``part_chars`` plus one message long. Rows equal in
    conversation, turn, speaker and text are one message, counted in ``n_rows``. A null text is an empty
    message; a null conversation is one like any other; one without participants gives no rows, nor does
    an empty table. Other columns are ignored, whatever their names.
    """
    speaker = F.when(F.col(speaker_col).isin(*narrators), None).otherwise(F.col(speaker_col))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), speaker.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    messages = cut_lineage(rows.groupBy("conv", "turn", "speaker", "text").agg(F.count("*").alias("rows")))
    who = cut_lineage(messages.where("speaker IS NOT NULL").groupBy("conv", "speaker").agg(F.lit(1).alias("one")))
    who = who.select(F.col("conv").alias("of"), F.col("speaker").alias("perspective"))
    each = messages.join(who, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    kind = F.when(F.col("speaker").isNull(), "system").when(own, "assistant").otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    head, body = _head(kind), F.concat(F.col("text"), F.lit(TAIL))
    each = each.select(
        "conv", "perspective", "turn", "speaker", "rows", own.alias("own"), F.concat(head, body).alias("segment"),
        F.length(head).cast("long").alias("head"), (F.length(head) + F.length(body)).cast("long").alias("size"),
    )
    order = [F.col("turn").asc_nulls_last(), F.col("speaker").asc_nulls_first(), F.col("segment").asc()]
    dealt = each.repartitionByRange(F.col("conv").asc(), F.col("perspective").asc(), *order)
    dealt = cut_lineage(dealt.withColumn("block", F.spark_partition_id()))
    blocks = dealt.groupBy("conv", "perspective", "block").agg(F.sum("size").alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(blocks.select(
        F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"),
    ))
    inside = Window.partitionBy("conv", "perspective", "block").orderBy(*order)
    placed = dealt.withColumn("ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("nth", F.row_number().over(inside) - 1)
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b"))
    placed = placed.join(blocks, same).select(
        "conv", "perspective", "rows", "own", "segment", "head", "size", (F.col("chars") + F.col("ahead")).alias("start"), (F.col("n") + F.col("nth")).alias("nth"),
    )
    piece = F.struct("nth", "start", "segment", "own", "head", "size")
    parts = placed.groupBy("conv", "perspective", F.floor(F.col("start") / part_chars).alias("part")).agg(
        F.count("*").alias("n_messages"), F.sum("rows").alias("n_rows"), F.array_sort(F.collect_list(piece)).alias("m"),
    )
    base = F.col("m")[0]["start"]
    loss = F.transform(F.filter("m", lambda x: x["own"]), lambda x: F.struct((x["start"] - base + x["head"]).alias("start"), (x["start"] - base + x["size"]).alias("end")))
    return parts.select(
        F.col("conv").alias(conv_col), "perspective", "part", "n_messages", "n_rows", F.array_join(F.transform("m", lambda x: x["segment"]), "").alias("text"), loss.alias("loss"),
    )
