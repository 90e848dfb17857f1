"""Product quantisation in whole numbers: Lloyd rounds by dual trees over the parts of vectors and the codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from logspark.llm.tables import exact, settled

SCALE = 256
ROWS = 8_192  # vectors in one tree
LEAF = 16  # parts in one leaf, about


def z_order(points: np.ndarray) -> np.ndarray:
    """Order of the rows along a space-filling curve: neighbours in it are near each other."""
    n, width = points.shape
    used = min(width, 62)
    bits = max(1, 62 // used)
    low, high = points.min(axis=0), points.max(axis=0)
    span = np.maximum(high - low, 1).astype(np.float64)
    cell = ((points[:, :used] - low[:used]) * ((2**bits - 1) / span[:used])).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(used):
            key = (key << 1) | ((cell[:, d] >> b) & 1)
    return np.argsort(key, kind="stable")


@dataclass
class Tree:
    """A balanced binary tree over rows in z-order: node k of level d holds the rows cut[k * 2^(depth - d)] and on.

    Every node caches the box round its rows, their number and their sum.
    """

    order: np.ndarray
    rows: np.ndarray
    depth: int
    cut: np.ndarray
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]

    @staticmethod
    def over(points: np.ndarray, leaf: int) -> Tree:
        n = len(points)
        depth = max(0, (n // leaf).bit_length() - 1)
        order = z_order(points)
        rows = points[order]
        cut = np.arange(2**depth + 1) * n // 2**depth
        low, high, sums = [np.minimum.reduceat(rows, cut[:-1])], [np.maximum.reduceat(rows, cut[:-1])], [np.add.reduceat(rows, cut[:-1])]
        for _ in range(depth):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
        return Tree(order, rows, depth, cut, low, high, sums)

    def span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of nodes of a level."""
        wide = 2 ** (self.depth - level)
        return self.cut[node * wide], self.cut[(node + 1) * wide]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, position) for every position of the ranges."""
    size = end - start
    which = np.repeat(np.arange(len(size)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + start[which]


@dataclass
class Assigned:
    """Entry and squared distance of every point; count and sum of the points of every entry."""

    code: np.ndarray
    error: np.ndarray
    count: np.ndarray
    sums: np.ndarray
    looked: int  # point-entry distances that were computed


def dual_tree(points: Tree, entries: np.ndarray) -> Assigned:
    """Nearest entry of every point (ties to the lower index), by a walk down both trees at once.

    A pair of nodes is dropped when even their nearest corners are further apart than some other
    pair's farthest; equality is not enough, for ties. A node of points with one entry left is
    assigned whole and adds its cached sum. Pairs left at the leaves are compared in whole numbers.
    """
    _, unique = np.unique(entries, axis=0, return_index=True)  # of equal entries the lower index wins everywhere
    unique.sort()
    book = Tree.over(entries[unique], 1)
    label = unique[book.order]
    n, width = points.rows.shape
    code = np.zeros(n, dtype=np.int64)
    count, sums = np.zeros(len(entries), dtype=np.int64), np.zeros((len(entries), width), dtype=np.int64)
    node, entry, level, deep = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    singles = False  # whether ``entry`` counts single entries and no longer nodes
    while True:
        e_low, e_high = (book.rows, book.rows) if singles else (book.low[deep], book.high[deep])
        gap = np.maximum(0, np.maximum(points.low[level][node] - e_high[entry], e_low[entry] - points.high[level][node]))
        reach = np.maximum(points.high[level][node] - e_low[entry], e_high[entry] - points.low[level][node])
        near, far = (gap**2).sum(axis=1), (reach**2).sum(axis=1)
        head = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1)) if len(node) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(node)))
        if len(node):
            keep = near <= np.repeat(np.minimum.reduceat(far, head), size)
            node, entry = node[keep], entry[keep]
        if singles and len(node):
            head = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1))
            alone = np.diff(np.append(head, len(node))) == 1
            whole, of = node[head[alone]], label[entry[head[alone]]]
            start, end = points.span(level, whole)
            which, at = _ranges(start, end)
            code[at] = of[which]
            np.add.at(count, of, end - start)
            np.add.at(sums, of, points.sums[level][whole])
            rest = ~np.repeat(alone, np.diff(np.append(head, len(node))))
            node, entry = node[rest], entry[rest]
        if level == points.depth and singles or not len(node):
            break
        if not singles:
            if deep < book.depth:
                deep += 1
                node, entry = np.repeat(node, 2), (entry[:, None] * 2 + [0, 1]).ravel()
            else:
                singles = True
                which, entry = _ranges(*book.span(deep, entry))
                node = node[which]
        if level < points.depth:
            level += 1
            head = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1))
            size = np.diff(np.append(head, len(node)))
            which, at = _ranges(np.repeat(head, 2), np.repeat(head + size, 2))  # each node's pairs, once for each child
            entry = entry[at]
            node = (node[head][:, None] * 2 + [0, 1]).ravel()[which]
    looked = 0
    if len(node):
        which, at = _ranges(*points.span(level, node))
        of = label[entry[which]]
        gone = ((points.rows[at] - entries[of]) ** 2).sum(axis=1)
        looked = len(at)
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, at, gone * len(entries) + of)
        open_ = np.unique(at)
        code[open_] = best[open_] % len(entries)
        np.add.at(count, code[open_], 1)
        np.add.at(sums, code[open_], points.rows[open_])
    error = ((points.rows - entries[code]) ** 2).sum(axis=1)
    back = np.empty(n, dtype=np.int64)
    back[points.order] = np.arange(n)
    return Assigned(code[back], error[back], count, sums, looked)


def _whole(scale: int):
    """Rows whose vectors are complete and finite, their components as floor(scale * x) in little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            batch = batch.filter(column.is_valid())
            column = batch.column("vector")
            if not batch.num_rows:
                continue
            first = column.offsets.to_numpy()
            value = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            first = first - first[0]
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
            good = np.flatnonzero(bad[first[1:]] == bad[first[:-1]])
            scaled = np.floor(np.where(np.isfinite(value), value, 0.0) * scale)
            if len(scaled) and np.abs(scaled).max() >= 2.0**62:
                raise ValueError("vector components are too large for exact distances")
            data = scaled.astype("<i8")
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), kept.column("label"), pa.array([data[first[i] : first[i + 1]].tobytes() for i in good], pa.binary()), pa.array(np.diff(first)[good].astype(np.int64)),
                 pa.array([int(np.abs(data[first[i] : first[i + 1]]).max(initial=0)) for i in good], pa.int64())], ["id", "label", "vector", "size", "most"])

    return run


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            rows = batch.slice(a, ROWS)
            yield rows, np.frombuffer(b"".join(rows.column("vector").to_pylist()), dtype="<i8").reshape(rows.num_rows, size)


def _learn(books: list[np.ndarray], size: int):
    """Count and sum of the parts of every entry, added up over a task."""
    width = size // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), len(books[0])), dtype=np.int64)
        sums = np.zeros((*count.shape, width), dtype=np.int64)
        for _, rows in _matrices(batches, size):
            for p, book in enumerate(books):
                found = dual_tree(Tree.over(np.ascontiguousarray(rows[:, p * width : (p + 1) * width]), LEAF), book)
                count[p] += found.count
                sums[p] += found.sums
        part, entry = np.nonzero(count)
        for_sum = [(int(p), int(e), d, int(sums[p, e, d]), int(count[p, e])) for p, e in zip(part, entry) for d in range(width)]
        columns = list(zip(*for_sum)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["part", "entry", "place", "total", "n"])

    return run


def _encode(books: list[np.ndarray], size: int):
    width = size // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _matrices(batches, size):
            code, error = np.zeros((len(rows), len(books)), dtype=np.uint8), np.zeros(len(rows), dtype=np.int64)
            for p, book in enumerate(books):
                found = dual_tree(Tree.over(np.ascontiguousarray(rows[:, p * width : (p + 1) * width]), LEAF), book)
                code[:, p] = found.code
                error += found.error
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)], ["id", "label", "code", "error"])

    return run


@dataclass
class Codes:
    """``rows``: id, code, error, label_error; ``books``: one array of entries (entries x width) for every part."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """Lower-case SHA-256 of all components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(
    docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = SCALE,
) -> Codes:
    """Product codes of all vectors: a codebook of at most ``entries`` (256 at most) for each of ``parts`` equal parts.

    Components become floor(scale * x). A codebook starts as the parts of the ``entries`` least ids; in each of
    ``rounds`` all parts go to their nearest entry (squared distance, ties to the lower index) and entries
    become the floored means of theirs, unused ones stay; then all are assigned once more. ``code`` has two
    hex digits per part, ``error`` is the sum of the squared distances, ``label_error`` its sum over equal labels.

    Every task builds trees over blocks of ``ROWS`` vectors and walks them against a tree of the entries
    (``dual_tree``). Per task one count and sum per entry leaves it; the driver holds entries x vector length numbers.

    Vectors that are null or hold null or non-finite components are dropped. A null id is the greatest; rows
    repeating an id are rows of their own, in the order of their stored bytes where a codebook starts. Null labels
    are one label. With no vectors left the result is empty and so are the books. Vectors of unlike
    lengths, a length that ``parts`` does not divide, and components too large for 64-bit distances raise ValueError.
    Other columns are ignored, whatever their names.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = docs.select(exact(id_col).alias("id"), exact(label_col).alias("label"), exact(vector_col).alias("vector"))
    types = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    whole = settled(rows.mapInArrow(_whole(scale), f"id {types[0]}, label {types[1]}, vector binary, size long, most long"), "vectors")
    least, size, most = whole.agg(F.min("size"), F.max("size"), F.max("most")).first()
    if size is None:
        return Codes(whole.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), [])
    if least != size or size % parts or not size:
        raise ValueError(f"vectors of {least} to {size} components cannot be cut into {parts} equal parts")
    width = size // parts
    if width * (2 * most + 1) ** 2 * entries >= 2**63 or size * (2 * most + 1) ** 2 >= 2**63:
        raise ValueError("vector components are too large for exact distances")
    first = whole.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    start = np.stack([np.frombuffer(r["vector"], dtype="<i8") for r in first])
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    for _ in range(rounds):
        found = whole.select("vector").mapInArrow(_learn(books, size), "part int, entry int, place int, total long, n long")
        for r in found.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    coded = settled(whole.select("id", "label", "vector").mapInArrow(_encode(books, size), f"id {types[0]}, label {types[1]}, code string, error long"), "codes")
    per = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    both = coded.join(per.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return Codes(both.select(F.col("id").alias(id_col), "code", "error", "label_error"), books)
