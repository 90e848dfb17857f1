"""Words of Arrow string columns as NumPy arrays: positions and hashes of whole batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIX = np.uint64(0xFF51AFD7ED558CCD)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers have inverses modulo 2^64
_BYTE = np.arange(256)
#: a-z, 0-9 and every byte of a non-ASCII character
ALNUM = (_BYTE >= 0x80) | ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90))
#: whatever is not a space or one of \t \n \v \f \r
NON_SPACE = ~((_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13)))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(33))) * MIX
    return h ^ (h >> np.uint64(29))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span, from one prefix sum."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(inverse(base), len(values) + 1)[starts]


class Words:
    """Words of the rows of a string array; null has none.

    ``first[i]:first[i + 1]`` are the words of row i; ``starts`` and ``ends`` are byte positions in ``data``.
    """

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool):
        column = pc.fill_null(column, "")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(column) else np.zeros(0, np.uint8)
        self.rows = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        if lower:
            data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        self.data = data
        inside = table[data]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        edges = self.rows[:-1][self.rows[:-1] < self.rows[1:]]
        begin[edges] = inside[edges]
        lasts = self.rows[1:][self.rows[:-1] < self.rows[1:]] - 1
        finish[lasts] = inside[lasts]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.starts, self.rows)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        """Row number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        return mix(spans_hash(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, BASES[which]))

    def windows(self, n: int, words: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``n`` consecutive words inside a row."""
        at = np.arange(max(0, len(words) - n + 1))
        row = self.row_of()
        at = at[row[at] == row[at + n - 1]] if len(at) else at
        return at, mix(spans_hash(words, at, at + n, BASES[1 - which]))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j-1 joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j]))


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def word_bytes(words: Words) -> np.ndarray:
    """The bytes of all words of a batch, one after the other."""
    inside = np.zeros(len(words.data) + 1, dtype=np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    return words.data[np.cumsum(inside)[:-1] > 0]


def word_array(words: Words) -> pa.Array:
    """All words of a batch, in order, as strings."""
    offsets = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
    return pa.LargeStringArray.from_buffers(len(words.starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(word_bytes(words).tobytes()))


def distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (row, key), each once, sorted."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (one per word) for every row."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def covered(hits: np.ndarray, n: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in a window that starts at one of ``hits`` and is ``n`` words long."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, hits, 1)
    np.subtract.at(steps, hits + n, 1)
    return np.cumsum(steps)[:size] > 0


def with_columns(batch: pa.RecordBatch, **extra: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in extra]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(extra.values()), names + list(extra))
