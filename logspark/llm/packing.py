"""Packing token sequences: a configuration linear program over the histogram of lengths, multiplicative weights, rounding."""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from logspark.llm.tables import exact, settled
from logspark.llm.words import pieces

CAPACITY = 2048
ROUNDS = 150  # prices of the linear program
PER_ROUND = 24  # configurations taken from one knapsack table
STEP = 0.25  # share of a length's pieces that one round may place
RATE = 1.0  # how fast the price of a covered length falls
MEMORY = 1 << 19  # distinct words a worker remembers the ids of

Config = tuple[tuple[int, int], ...]  # (length, how many), lengths descending


_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122))
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_ASCII = _BYTE < 128
_PLAIN = (_BYTE > 32) & (_BYTE < 127)
_TWO = (_BYTE >= 0xC3) & (_BYTE <= 0xDF)  # leads U+00C0 to U+07FF, where no white space is


class Encoder:
    """Token ids of texts; a word that was met before is looked up.

    Byte-level pre-tokenizers match runs of letters, of digits and of other signs, each with one space before it.
    So a piece always ends after an ASCII letter before another ASCII sign, after an ASCII digit before
    another, and before a single space between signs that are not white space. Texts are cut there and
    nowhere else, so the ids of the cuts, joined, are those of the whole text. A text that holds one of the
    vocabulary's special strings is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        self.again = np.zeros(0, dtype=bool)

    def _trim(self) -> None:
        """Only words that were met again, in a later batch than the one they came with or since the last trim, are still known."""
        keep, size = self.again, np.diff(self.first)
        self.known, self.ids = self.known.filter(pa.array(keep)), self.ids[np.repeat(keep, size)]
        self.first = np.concatenate(([0], np.cumsum(size[keep])))
        self.again = np.zeros(len(self.known), dtype=bool)

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct ``words`` are in what is known; unknown ones are learned."""
        for make_room in (self._trim, self._forget, None):
            spot = pc.index_in(words, value_set=self.known)
            if make_room is None or max(len(self.known) + spot.null_count, len(self.ids) >> 4) <= MEMORY:
                break
            make_room()
        new = pc.is_null(spot).to_numpy(zero_copy_only=False)
        place = pc.fill_null(spot, 0).to_numpy().astype(np.int64)
        self.again[place[~new]] = True
        if spot.null_count:
            place[new] = len(self.known) + np.arange(spot.null_count)
            self._learn(words.filter(pa.array(new)))
        return place

    def _learn(self, words: pa.Array) -> None:
        made = [e.ids for e in self.model.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made))) + self.first[-1]
        self.first = np.concatenate((self.first, ends))
        self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(made), np.uint32)))
        self.known = pa.concat_arrays([self.known, words])
        self.again = np.concatenate((self.again, np.zeros(len(words), dtype=bool)))

    def _cuts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where words start, the starts of rows and the end of the data included."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 2:
            letter, digit, plain = _LETTER[data], _DIGIT[data], _PLAIN[data]
            plain_end = plain.copy()
            plain_end[1:] |= _TWO[data[:-1]]
            cut[1:-1] = (letter[:-1] & ~letter[1:] | digit[:-1] & ~digit[1:]) & _ASCII[data[1:]]
            cut[1:-2] |= (data[1:-1] == 32) & plain_end[:-2] & (plain | _TWO[data])[2:]
            body = data.tobytes()
            for sign in self.special:
                at = body.find(sign)
                while at >= 0:
                    row = np.searchsorted(rows, at, side="right") - 1
                    cut[rows[row] : rows[row + 1]] = False
                    at = body.find(sign, int(rows[row + 1]))
        cut[rows] = True
        return np.flatnonzero(cut)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``first, ids``: the ids of row i are ``ids[first[i]:first[i + 1]]``; null has none."""
        column = pc.fill_null(column, "").cast(pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        body = column.buffers()[2]
        data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
        rows = offsets - offsets[0]
        starts = self._cuts(data, rows)
        words = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data.tobytes()))
        coded = words.dictionary_encode()
        word = self._places(coded.dictionary)[coded.indices.to_numpy()]
        begin, size = self.first[word], self.first[word + 1] - self.first[word]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        return ends[np.searchsorted(starts, rows)], ids


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """The encoder of this worker process: later tasks know the words of earlier ones."""
    return Encoder(path)


def _pieces(path: str, capacity: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        placed = np.zeros(capacity + 1, dtype=np.int64)  # pieces of each length so far in this task
        for batch in pieces(batches, "text", 1 << 22):
            first, ids = encoder.encode(batch.column("text"))
            out: dict[str, list] = {n: [] for n in ("row", "piece", "start", "length", "ids_crc32", "rank", "ids")}
            for i in range(batch.num_rows):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id))
                head = len(own) % capacity or capacity
                for k, stop in enumerate(range(head, len(own) + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    data = own[start:stop].astype("<u4").tobytes()
                    size = stop - start
                    for name, value in zip(out, (i, k, start, size, zlib.crc32(data), int(placed[size]), data)):
                        out[name].append(value)
                    placed[size] += 1
            made = [batch.column("id").take(pa.array(out["row"])), pa.array(out["piece"], pa.int32())]
            made += [pa.array(out[n], pa.int64()) for n in ("start", "length", "ids_crc32")]
            made += [pa.array([part] * len(out["row"]), pa.int64()), pa.array(out["rank"], pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if keep_ids:
                made, names = [*made, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(made, names)

    return run


class Knapsack:
    """Dynamic program over the capacity: the most valuable choice of at most ``most`` pieces of every length."""

    def __init__(self, length: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int):
        best = np.zeros(capacity + 1)
        self.steps = []
        for i, (size, n) in enumerate(zip(length.tolist(), most.tolist())):
            n, k = min(n, capacity // size), 1
            while n > 0:  # k copies at once: 1, 2, 4, ... and the rest
                k = min(k, n)
                with_it = best[: capacity + 1 - k * size] + k * value[i]
                better = with_it > best[k * size :]
                np.maximum(best[k * size :], with_it, out=best[k * size :])
                self.steps.append((i, k, k * size, better))
                n, k = n - k, 2 * k
        self.best = best

    def choice(self, room: int) -> Counter:
        """Index of length -> how many, of the best choice that needs no more than ``room``."""
        out: Counter = Counter()
        for i, k, need, better in reversed(self.steps):
            if room >= need and better[room - need]:
                out[i] += k
                room -= need
        return out


def linear_program(length: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> dict[Config, float]:
    """How often to use which configuration, in fractions: no length is placed more often than ``demand``.

    Multiplicative weights for the covering program (configurations x, every length covered): the
    price of a length is its size times exp(-RATE * share covered); a knapsack at these prices finds the best
    configuration, and the same table the best company of each of the dearest lengths. Every round places
    at most ``STEP`` of a length. What is uncovered after ``rounds`` is left to the rounding.
    """
    covered = np.zeros(len(length))
    out: dict[Config, float] = {}
    for _ in range(rounds):
        if not (covered < 1 - 1e-9).any():
            break
        value = length * np.exp(-RATE * covered)
        left = demand * (1 - covered)
        table = Knapsack(length, value, np.ceil(left - 1e-9).astype(np.int64), capacity)
        room = np.minimum(left, STEP * demand)
        dearest = np.argsort(-(value * (left > 1e-9)), kind="stable")[:PER_ROUND]
        for first in [None, *dearest.tolist()]:
            if first is None:
                chosen = table.choice(capacity)
            else:
                chosen = table.choice(capacity - int(length[first]))
                chosen[first] += 1
            index = np.fromiter(chosen, dtype=np.int64)
            count = np.fromiter(chosen.values(), dtype=np.float64)
            if not len(index):
                continue
            amount = float((room[index] / count).min())
            if amount <= 1e-9:
                continue
            room[index] -= amount * count
            covered[index] += amount * count / demand[index]
            config = tuple(sorted(((int(length[i]), int(n)) for i, n in chosen.items()), reverse=True))
            out[config] = out.get(config, 0.0) + amount
    return out


def best_fit(demand: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, for a whole histogram at once: equal bins are filled together, so work does not grow with counts."""
    open_: dict[int, list[list]] = {}
    frees: list[int] = []
    done: Counter = Counter()

    def put(free: int, config: Config, count: int) -> None:
        if free == 0:
            done[config] += count
            return
        if free not in open_:
            open_[free] = []
            bisect.insort(frees, free)
        open_[free].append([config, count])

    for size in sorted(demand, reverse=True):
        n = demand[size]
        while n > 0:
            at = bisect.bisect_left(frees, size)
            if at < len(frees):
                free = frees[at]
                config, count = open_[free].pop()
                if not open_[free]:
                    del open_[free], frees[at]
            else:
                free, config, count = capacity, (), -(-n // (capacity // size))
            each = free // size
            full = min(count, n // each)
            if full:
                put(free - each * size, (*config, (size, each)), full)
            n -= full * each
            if n and full < count:
                put(free - n * size, (*config, (size, n)), 1)
                n, full = 0, full + 1
            if full < count and config:
                put(free, config, count - full)
    for entries in open_.values():
        for config, count in entries:
            done[config] += count
    return done


def configurations(demand: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Whole numbers of configurations that place every piece of the histogram exactly once.

    The program's fractions are rounded down, then up in the order of what was lost while pieces are left; the rest is packed by
    best fit. The number of different configurations is bounded by rounds and capacity, not by the pieces.
    """
    left = dict(demand)
    out: Counter = Counter()
    length = np.array(sorted((s for s in demand if s < capacity), reverse=True), dtype=np.int64)
    found = linear_program(length, np.array([demand[s] for s in length.tolist()], dtype=np.float64), capacity, rounds) if len(length) else {}
    for config, amount in found.items():
        whole = int(amount + 1e-6)
        whole = min([whole, *(left[s] // n for s, n in config)])
        out[config] += whole
        for s, n in config:
            left[s] -= n * whole
    for config, _ in sorted(found.items(), key=lambda f: -(f[1] % 1)):
        if all(left[s] >= n for s, n in config):
            out[config] += 1
            for s, n in config:
                left[s] -= n
    out.update(best_fit({s: n for s, n in left.items() if n}, capacity))
    return [(config, n) for config, n in out.items() if n]


@dataclass
class Places:
    """Where the k-th piece of a length goes: ranges of k per (configuration, length), in ascending order of (length, k)."""

    length: np.ndarray
    base: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(configs: list[tuple[Config, int]]) -> Places:
        rows, base, sequence = [], Counter(), 0
        for config, n in configs:
            offset = 0
            for size, each in config:
                rows.append((size, base[size], each, sequence, offset))
                base[size] += each * n
                offset += each * size
            sequence += n
        rows.sort()
        return Places(*(np.array(c, dtype=np.int64) for c in zip(*rows))) if rows else Places(*[np.zeros(0, np.int64)] * 5)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks."""
        at = np.zeros(len(length), dtype=np.int64)
        for size in np.unique(length):
            mine = length == size
            low, high = np.searchsorted(self.length, [size, size + 1])
            at[mine] = low + np.searchsorted(self.base[low:high], rank[mine], side="right") - 1
        inside = rank - self.base[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def _place(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = places.find(batch.column("length").to_numpy(), rank)
            kept = [n for n in batch.schema.names if n not in ("rank", "before", "part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids`` with ``keep_ids``).

    A document is its token ids by the vocabulary file ``tokenizer`` (special strings as the file says, none
    added) and ``end_id``. One of more than ``capacity`` ids is cut into pieces of that length, of which the first may be
    shorter; no other is cut. ``ids_crc32`` is over the piece's ids as little-endian unsigned 32-bit numbers.

    One pass encodes the texts and writes the pieces, numbered per task and length. Their histogram, at
    most ``capacity`` numbers, goes to the driver, where the configuration program is solved and rounded
    (``configurations``). Pieces of one length are interchangeable, so the k-th of them, by a sum over
    tasks, has its place by arithmetic: nothing is sorted and no sequence is gathered. The table of
    places that tasks get is bounded by rounds and capacity.

    Null and empty texts are the one id ``end_id``. Rows repeating an id are documents of their own. Empty table: no
    rows. Other columns are ignored, whatever their names. A text is encoded at once, in some 100 times its size.
    """
    rows = docs.select(exact(id_col).alias("id"), exact(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, rank long" + (", ids binary" if keep_ids else "")
    made = settled(rows.mapInArrow(_pieces(tokenizer, capacity, end_id, keep_ids), schema), "pieces")
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places.of(configurations(histogram, capacity, rounds))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = settled(counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "before")
    out = made.join(before, ["part", "length"])
    kept = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    types = {f.name: f.dataType.simpleString() for f in made.schema.fields}
    placed = out.select(*kept, "rank", "before").mapInArrow(_place(places), ", ".join(f"{n} {types[n]}" for n in kept) + ", sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from ``pack(..., keep_ids=True)``: ``sequence_id``, ``ids`` (array of int), ``lengths`` of the pieces.

    A sequence has at most ``capacity`` ids, so gathering one is bounded.
    """
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    found = packed.groupBy("sequence_id").agg(inside.alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("parts").to_pylist()
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32) for parts in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([[p["length"] for p in parts] for parts in rows], pa.list_(pa.int64()))],
                ["sequence_id", "ids", "lengths"])

    return found.mapInArrow(joined, "sequence_id long, ids array<int>, lengths array<long>")
