"""Two merged bit arrays, for hashes seen once and seen twice: counters that stop at two, with no misses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logspark.llm.words import mix

SEGMENT = 20  # log2 of the counters that are merged as one piece
PROBES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
FLUSH = 1_000_000  # hashes a task holds before it writes them out


def width_for(hashes: float, most: int) -> int:
    """log2 of the number of counters: eight a hash, between one segment and 2**most."""
    return int(np.clip(np.ceil(np.log2(max(hashes, 1) * 8)), SEGMENT, most))


def spots(hashes: np.ndarray, width: int) -> list[np.ndarray]:
    """The counters of every hash, one per probe."""
    shift = np.uint64(64 - width)
    return [mix(hashes * np.uint64(p)) >> shift for p in PROBES]


def _pack(places: np.ndarray) -> bytes:
    """Sorted places as gaps of two bytes each, or four where a gap is too wide."""
    gaps = np.diff(places, prepend=np.uint32(0))
    wide = len(gaps) and gaps.max() > 0xFFFF
    return (b"4" + gaps.astype(np.uint32).tobytes()) if wide else (b"2" + gaps.astype(np.uint16).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.uint32 if data[:1] == b"4" else np.uint16, offset=1), dtype=np.int64)


def _tally(make: Callable[[pa.RecordBatch], np.ndarray], cut, width: int):
    """Sparse partial sketches: per segment the counters hit once and those hit again."""

    def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        segment = (at >> np.uint64(SEGMENT)).astype(np.int32)
        low = (at & np.uint64((1 << SEGMENT) - 1)).astype(np.uint32)
        edges = [*np.flatnonzero(np.concatenate(([True], np.diff(segment) > 0))).tolist(), len(at)]
        rows = [(int(segment[a]), _pack(low[a:b]), _pack(low[a:b][n[a:b] > 1])) for a, b in zip(edges, edges[1:])]
        for i in range(0, len(rows), 64):
            s, once, twice = zip(*rows[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in cut(batches):
            found = make(batch)
            if len(found):
                parts += [np.concatenate(spots(found, width))]  # a hash may hit one counter twice: only overestimates
                held += len(found)
            if held > FLUSH:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice"))):
            if s not in once:
                once[s], twice[s] = np.zeros(1 << SEGMENT, dtype=bool), np.zeros(1 << SEGMENT, dtype=bool)
            at = _unpack(a)
            twice[s][at[once[s][at]]] = True
            once[s][at] = True
            twice[s][_unpack(b)] = True
    for s in once:
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(twice[s], bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])


class Twice:
    """Says of a hash whether it may have been seen twice; it never denies one that was."""

    def __init__(self, width: int, segments: list):
        self.width = width
        self.bits = np.zeros(1 << (width - 3), dtype=np.uint8)
        step = 1 << (SEGMENT - 3)
        for s, bits in segments:
            self.bits[s * step : (s + 1) * step] = np.frombuffer(bits, dtype=np.uint8)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), dtype=bool)
        for at in spots(hashes, self.width):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def seen_twice(docs: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], cut, width: int):
    """Broadcast ``Twice`` over ``make(batch)`` of every batch of ``cut(batches)``.

    Partial sketches are sparse and merged by segment, each segment in one task that streams over its
    parts. What is collected and broadcast is the array of seen-twice bits: 2**width bits, whatever the
    data; ``width_for`` sets its bound.
    """
    parts = docs.mapInArrow(_tally(make, cut, width), "segment int, once binary, twice binary")
    merged = parts.repartition(1 << max(0, width - SEGMENT), "segment").mapInArrow(_merge, "segment int, bits binary")
    return docs.sparkSession.sparkContext.broadcast(Twice(width, [tuple(r) for r in merged.toLocalIterator()]))


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
