"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logspark.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character untouched."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = False) -> DataFrame:
    """One row per input row: id, ``size`` (bytes), ``digest`` (binary SHA-256), ``keep_id``, ``group_size``, ``kept``.

    Rows whose length is shared go on to a hash of their first ``prefix`` characters; rows that share
    both have their whole content hashed (all rows with ``digest_all``; others have a null digest).
    Every level is a count combined before its shuffle, joined back on exchanges that AQE may split,
    so a group that holds a third of all rows is neither gathered nor sorted in one place.

    Null text counts as empty. Of equal texts the largest id stays (null is the smallest); rows that
    repeat an id together with its text share the verdict. An empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, head = F.octet_length(text), F.xxhash64(lower_ascii(F.substring(text, 1, prefix)))
    keys = cut_lineage(docs.groupBy(size.alias("size"), head.alias("head")).agg(F.count("*").alias("n")))
    sizes = cut_lineage(keys.groupBy("size").agg(F.sum("n").alias("n")).where("n > 1").select("size"))
    heads = cut_lineage(keys.where("n > 1").join(sizes, "size", "left_semi").select("size", "head", F.lit(True).alias("shared")))
    full = F.unhex(F.sha2(lower_ascii(F.col("text")), 256))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), size.alias("size"), head.alias("head")).join(heads, ["size", "head"], "left")
    hashed = cut_lineage(rows.select(
        "id", "size", "head", "shared", (full if digest_all else F.when(F.col("shared"), full)).alias("digest"),
    ))
    groups = cut_lineage(
        hashed.where("shared").groupBy("size", "head", "digest").agg(F.max("id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    )
    found = hashed.join(groups, ["size", "head", "digest"], "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(
        F.col("id").alias(id_col), "size", "digest", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: one row per distinct text."""
    dropped = find_copies(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone"))
    return docs.join(dropped.distinct(), F.col(id_col).eqNullSafe(F.col("_gone")), "left_anti")
