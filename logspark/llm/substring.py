"""Repeated runs of words: a count-min prefilter, then an exact grouping of the windows it cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logspark.llm import sketch
from logspark.llm.words import BASES, NON_SPACE, Words, covered, distinct, mix, pieces, spans_hash

GRAM = 6  # words of the anchor that stands for a window in the sketch
MOST_BITS = 29  # 64 MB of seen-twice bits; more anchors than they tell apart only make more suspects
FIRST = -(2**63)  # what a null id counts as


def _sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every run of n values."""
    out = values[: len(values) - n + 1].copy()
    for k in range(1, n):
        np.minimum(out, values[k : len(values) - n + 1 + k], out=out)
    return out


class Spots:
    """Windows of a batch: first word, row, 64- and 32-bit hash, and the hash of the window's anchor.

    The anchor is the window's least ``GRAM``-word hash. Equal windows have equal anchors, so a window is
    never more frequent than its anchor, and neighbouring windows share anchors: a fifth of the entries
    do for the sketch.
    """

    def __init__(self, words: Words, n: int):
        gram = min(GRAM, n)
        hashes = words.hashes()
        self.at, self.key = words.windows(n, hashes)
        self.row = words.row_of()[self.at]
        self.other = words.windows(n, words.hashes(1), 1)[1].astype(np.uint32) if len(self.at) else np.zeros(0, np.uint32)
        self.anchor = np.zeros(0, np.uint64)
        if len(self.at):
            i = np.arange(len(hashes) - gram + 1)
            self.anchor = _sliding_min(mix(spans_hash(hashes, i, i + gram, BASES[1])), n - gram + 1)[self.at]

    def anchors(self) -> np.ndarray:
        """Anchors of every row, each once."""
        if not len(self.at):
            return self.anchor
        fresh = np.concatenate(([True], (self.anchor[1:] != self.anchor[:-1]) | (self.row[1:] != self.row[:-1])))
        return distinct(self.row[fresh], self.anchor[fresh])[1]


def _anchors(text: str, n: int):
    return lambda batch: Spots(Words(batch.column(text), NON_SPACE, lower=False), n).anchors()


def _docs(column: pa.Array) -> np.ndarray:
    return column.fill_null(FIRST).to_numpy(zero_copy_only=False).astype(np.int64)


def _suspects(twice, n: int):
    """Suspected windows of a batch: hash, the smallest id that has it here, and the other ids here, if any.

    So a window of very many documents is one row per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            spots = Spots(Words(batch.column("text"), NON_SPACE, lower=False), n)
            likely = np.flatnonzero(twice.value(spots.anchor)) if len(spots.at) else np.zeros(0, np.int64)
            if not len(likely):
                continue
            doc = _docs(batch.column("id"))[spots.row[likely]]
            key, other = spots.key[likely], spots.other[likely]
            order = np.lexsort((doc, other, key))
            key, other, doc = key[order], other[order], doc[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            key, other, doc, new = key[fresh], other[fresh], doc[fresh], new[fresh]
            heads = np.flatnonzero(new)
            extra = np.diff(np.append(heads, len(new))) - 1
            ends = np.concatenate(([0], np.cumsum(extra))).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[~new]), mask=pa.array(extra == 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[heads].view(np.int64)), pa.array(other[heads].view(np.int32)), pa.array(doc[heads]), more], ["key", "other", "doc", "more"],
            )

    return run


def _cut(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), NON_SPACE, lower=False)
            spots = Spots(words, n)
            gone = np.zeros(len(spots.at), dtype=bool)
            cuts = np.searchsorted(spots.row, np.arange(batch.num_rows + 1))
            keys = batch.column("gone")
            for i in range(batch.num_rows):
                if keys[i].is_valid:
                    own = slice(cuts[i], cuts[i + 1])
                    gone[own] = np.isin(spots.key[own].view(np.int64), keys[i].values.to_numpy(zero_copy_only=False))
            hit = covered(spots.at[gone], n, len(words.starts))
            kept, removed = [], []
            for i in range(batch.num_rows):
                a, b = int(words.first[i]), int(words.first[i + 1])
                stays = np.flatnonzero(~hit[a:b]) + a
                removed.append(b - a - len(stays))
                kept.append(b" ".join(words.data[words.starts[j] : words.ends[j]].tobytes() for j in stays).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def drop_repeated_windows(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space).

    Words are runs without white space. A word goes if a window of ``n`` words covers it whose words also
    start in a document with a smaller id; all windows are judged on the input.

    First pass: a count-min sketch (two rows of counters that stop at two), merged from partial sketches,
    over the anchors of every document's windows (``Spots``). It overestimates, so no repeated window is
    lost. Second pass: windows whose anchor may occur in two documents are grouped exactly by 96 bits
    of their hash; equal windows of one batch are one row, so a window in a third of all documents
    sends one row per batch. What is found joins the texts by id for the cut. The sketch has a fixed upper bound (``MOST_BITS``); beyond it more windows are suspected and
    shuffled, with the same result.

    Null and empty texts have no words. Null ids are one document that comes first; rows repeating an id
    are one document too and do not empty each other. Empty table: no rows. Other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    width = sketch.width_for(sketch.text_bytes(rows, "text") / 20, MOST_BITS)
    twice = sketch.seen_twice(rows.select("text"), _anchors("text", n), lambda b: pieces(b, "text"), width)
    each = rows.mapInArrow(_suspects(twice, n), "key long, other int, doc long, more array<long>")
    each = each.withColumn("first", F.min("doc").over(Window.partitionBy("key", "other")))
    beaten = F.when(F.col("doc") > F.col("first"), F.array("doc"))
    none = F.array().cast("array<long>")
    hits = each.select("key", F.explode(F.concat(F.coalesce(beaten, none), F.coalesce("more", none))).alias("doc"))
    gone = hits.groupBy("doc").agg(F.collect_set("key").alias("gone"))
    both = rows.join(gone, F.coalesce("id", F.lit(FIRST)) == F.col("doc"), "left").select("id", "text", "gone")
    return both.mapInArrow(_cut(n), "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
