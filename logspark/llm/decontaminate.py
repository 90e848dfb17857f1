"""Benchmark decontamination: windows of test words in a broadcast hash set, looked up by every document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.words import ALNUM, Words, by_row, covered, pieces, with_columns
from logspark.session import cut_lineage

LEAK = "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>>"
_FILTER_BITS = 22


class Windows:
    """Normalised windows of the items: by length, sorted 64-bit hashes and, for each hash, the windows themselves."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        hashes = words.hashes()
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.known: dict[tuple[int, int], dict[bytes, set[str]]] = {}
        for i, (item, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if a == b:
                continue
            size = min(n, b - a)
            row = Words(pa.array([words.text(a, b).decode()], pa.large_string()), ALNUM, lower=True)
            at, keys = row.windows(size, hashes[a:b])
            for k, key in zip(at.tolist(), keys.tolist()):
                found = self.known.setdefault((size, key), {}).setdefault(words.text(a + k, a + k + size), set())
                if item is not None:
                    found.add(str(item))
        for size in sorted({s for s, _ in self.known}):
            keys = np.sort(np.array([k for s, k in self.known if s == size], dtype=np.uint64))
            seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
            seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
            self.by_length[size] = (keys, seen)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        """(first word, length, items) of every verified hit."""
        hashes = words.hashes()
        starts, sizes, items = [], [], []
        for size, (keys, seen) in self.by_length.items():
            at, found = words.windows(size, hashes)
            likely = np.flatnonzero(seen[found >> np.uint64(64 - _FILTER_BITS)])
            spot = np.searchsorted(keys, found[likely]).clip(max=len(keys) - 1)
            likely = likely[keys[spot] == found[likely]]
            for i, key in zip(at[likely].tolist(), found[likely].tolist()):
                hit = self.known[size, key].get(words.text(i, i + size))
                if hit is not None:
                    starts.append(i)
                    sizes.append(size)
                    items.append(hit)
        return np.array(starts, dtype=np.int64), np.array(sizes, dtype=np.int64), items


def _marked(words: Words, windows: Windows) -> tuple[np.ndarray, list[set[str]]]:
    starts, sizes, items = windows.find(words)
    hit = covered(starts, sizes, len(words.starts))
    found: list[set[str]] = [set() for _ in range(len(words.first) - 1)]
    for row, item in zip((np.searchsorted(words.first, starts, side="right") - 1).tolist(), items):
        found[row] |= item
    return hit, found


def _scan(shared, text: str, leak: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in pieces(batches, text):
            words = Words(batch.column(text), ALNUM, lower=True)
            hit, found = _marked(words, windows)
            before = batch.column(leak).to_pylist() if leak in batch.schema.names else [None] * batch.num_rows
            count = by_row(hit, words.first)
            rows = []
            for i, old in enumerate(before):
                spans = []
                if count[i] or old and old["spans"]:
                    a, b = words.first[i], words.first[i + 1]
                    own = hit[a:b].copy()
                    for s in old["spans"] if old else ():
                        own[s["start"] : s["end"]] = True
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
                    spans = [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])]
                items = found[i] | set(old["items"] if old else ())
                rows.append({"n_words": int(words.counts[i]), "n_hit": sum(s["end"] - s["start"] for s in spans), "items": sorted(items), "spans": spans})
            yield with_columns(batch, **{leak: pa.array(rows, LEAK_ARROW)})

    return run


LEAK_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def find_leaks(
    docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    leak: str = "leak", max_chars: int = 32_000_000,
) -> DataFrame:
    """``docs`` with a struct column ``leak``: n_words, n_hit, items (sorted ids as strings), spans (word numbers, end exclusive).

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. A window is ``n``
    consecutive words of an item, or the whole of a shorter one. A hit by hash is verified by its words.

    The items' text is measured first. Up to ``max_chars`` it is one broadcast; a larger set of items
    is dealt by a hash of its texts into parts below that size, and the documents pass through part
    after part (cut in the shared folder between them, so that one part is in memory at a time).

    Null and empty texts have no words and no hits. An item with a null id still marks words but is
    not listed; rows repeating an item, or items sharing windows, are listed once each. No items: no
    hits. A column named like ``leak`` is replaced; all other columns pass through.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    chars = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-chars // max_chars) or 1
    if parts > 1:
        parts *= 2  # room for uneven hashing
        wanted = cut_lineage(wanted)
    out = docs.drop(leak)
    plain = list(out.schema.fields)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain) + f", `{leak}` {LEAK}"
    for part in range(parts):
        chosen = wanted if parts == 1 else wanted.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(Windows([tuple(r) for r in chosen.collect()], n))
        out = out.mapInArrow(_scan(shared, text_col, leak), schema)
        if part < parts - 1:
            out = cut_lineage(out)
    return out


def clean(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", drop: bool = True, **named) -> DataFrame:
    """``docs`` without what leaks: whole documents, or (``drop=False``) only the hit words and what stands between them.

    Columns and clean rows are as they were, null and empty texts included.
    """
    found = find_leaks(docs, items, n, text_col, leak="_leak", **named)
    if drop:
        return found.where("_leak.n_hit = 0").drop("_leak").select(*docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            words, raw = Words(batch.column(text_col), ALNUM, lower=True), batch.column(text_col).to_pylist()
            for i, leak in enumerate(batch.column("_leak").to_pylist()):
                if leak["spans"]:
                    data, keep, last = raw[i].encode(), [], 0
                    for s in leak["spans"]:
                        a, b = words.first[i] + s["start"], words.first[i] + s["end"] - 1
                        keep.append(data[last : words.starts[a] - words.rows[i]])
                        last = words.ends[b] - words.rows[i]
                    raw[i] = b"".join([*keep, data[last:]]).decode()
            rest = batch.drop_columns(["_leak"])
            yield rest.set_column(rest.schema.get_field_index(text_col), text_col, pa.array(raw, pa.string()))

    return found.mapInArrow(cut, docs.schema)


def digest(items: Column) -> Column:
    """SHA-256 of the comma-joined ids, lowercase hex."""
    return F.sha2(F.array_join(items, ","), 256)
