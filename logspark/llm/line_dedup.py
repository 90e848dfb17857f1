"""Lines repeated across documents: Bloom filters single out suspects, which alone are grouped exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from logspark.llm import sketch
from logspark.llm.words import pieces
from logspark.session import cut_lineage, scratch_path

BLANK = b" \t\n\v\f\r"
MOST_BITS = 29  # 64 MB of seen-twice bits; more lines than they tell apart only make more suspects


def keys_of(text: str | None, least: int) -> list[bytes | None]:
    """Key of every line: stripped, A-Z lower-cased; None where it is shorter than ``least`` code points."""
    keys = [line.strip(BLANK) for line in (text or "").encode().lower().split(b"\n")]
    return [k if len(k) >= least and (len(k) >= 4 * least or len(k.decode()) >= least) else None for k in keys]


def _hashes(text: str, least: int):
    def run(batch: pa.RecordBatch) -> np.ndarray:
        rows = ({k for k in keys_of(t, least) if k is not None} for t in batch.column(text).to_pylist())
        return np.array([xxhash.xxh3_64_intdigest(k) for row in rows for k in row], dtype=np.uint64)

    return run


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _suspects(twice, id_col: str, text: str, least: int):
    """Number of lines and, of suspected documents, the text and the digests of suspected keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            count, keys, kept, whole = [], [], [], []
            for t in batch.column(text).to_pylist():
                own = keys_of(t, least)
                known = sorted({k for k in own if k is not None})
                likely = twice.value(np.array([xxhash.xxh3_64_intdigest(k) for k in known], dtype=np.uint64)) if known else ()
                found = [_digest(k) for k, yes in zip(known, likely) if yes]
                count.append(len(own))
                keys.append(found)
                kept.append(t if found else None)
                whole.append(None if found else hashlib.sha256((t or "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(count, pa.int64()), pa.array(keys, pa.list_(pa.binary())), pa.array(kept, pa.string()), pa.array(whole, pa.string())],
                ["id", "n_lines", "keys", "text", "sha256"],
            )

    return run


def _drop(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            dropped, kept = [], []
            for t, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                gone, lines = set(gone or ()), (t or "").split("\n")
                stays = [line for line, key in zip(lines, keys_of(t, least)) if key is None or _digest(key) not in gone] if gone else lines
                dropped.append(len(lines) - len(stays))
                kept.append("\n".join(stays))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"],
            )

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_dropped``, ``kept`` (text; null if nothing can be dropped), ``sha256`` of what stays.

    A key found in at least two documents keeps its lines only in the document of the smallest id.
    First pass: two Bloom filters of the distinct keys of every document, for hashes seen once and seen
    twice. Second pass: documents with keys that may have been seen twice are written to the shared
    folder with the 128-bit digests of those keys; all others are settled. Digests are then grouped
    exactly (minimum and maximum id, combined before the shuffle), so a key in a third of all documents
    is one row per task, and come back by a join of two tables that AQE may split.

    Null and empty texts are one empty line. Null ids are one document that comes first; rows repeating
    an id are one document too, so they do not make a line repeated. Empty table: no rows. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    width = sketch.width_for(sketch.text_bytes(rows, "text") / 64, MOST_BITS)
    twice = sketch.seen_twice(rows.select("text"), _hashes("text", least), lambda b: pieces(b, "text"), width)
    path = scratch_path(spark, "line-suspects")
    rows.mapInArrow(_suspects(twice, "id", "text", least), "id long, n_lines long, keys array<binary>, text string, sha256 string").write.parquet(path)
    found = spark.read.parquet(path)
    order = F.coalesce("id", F.lit(-(2**63)))
    held = cut_lineage(found.select(order.alias("doc"), F.explode("keys").alias("key")))
    first = cut_lineage(held.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("key", "first"))
    gone = held.join(first, "key").where("doc > first").groupBy("doc").agg(F.collect_set("key").alias("gone"))
    suspects = found.where(F.size("keys") > 0).select("id", "n_lines", "text", order.alias("doc")).join(gone, "doc", "left").select("id", "n_lines", "text", "gone")
    cut = suspects.mapInArrow(_drop(least), "id long, n_lines long, n_dropped long, kept string")
    settled = found.where(F.size("keys") == 0).select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.lit(None).cast("string").alias("kept"), "sha256")
    return settled.unionByName(cut.withColumn("sha256", F.sha2("kept", 256))).withColumnRenamed("id", id_col)
