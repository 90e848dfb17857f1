"""A uniform shuffle into shards of exact size, planned by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from logspark.session import scratch_path

CHUNK = 1 << 20  # rows of one file that count as one source partition
CELL_ROWS = 8_192  # rows of a shard that one task permutes
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Exact draw; above NumPy's limit by inversion, walking outwards from the mode."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    least, most = max(0, sample - bad), min(good, sample)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), least), most)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    here = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    left = rng.random() - here
    up, down, p_up, p_down = mode, mode, here, here
    while left > 0 and (up < most or down > least) and p_up + p_down > 0:
        if up < most:
            p_up *= (good - up) * (sample - up) / ((up + 1) * (bad - sample + up + 1))
            up, left = up + 1, left - p_up
            if left <= 0:
                return up
        if down > least:
            p_down *= down * (bad - sample + down) / ((good - down + 1) * (sample - down + 1))
            down, left = down - 1, left - p_down
            if left <= 0:
                return down
    return mode


def draw(rng: np.random.Generator, cells: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` rows fall into each cell, when cells have room for ``cells`` rows."""
    total = int(cells.sum())
    if total < _NUMPY_LIMIT or len(cells) == 1:
        return rng.multivariate_hypergeometric(cells, sample, method="marginals") if len(cells) > 1 else np.array([sample])
    half = len(cells) // 2
    left = hypergeometric(rng, int(cells[:half].sum()), int(cells[half:].sum()), sample)
    return np.concatenate([draw(rng, cells[:half], left), draw(rng, cells[half:], sample - left)])


def matrix_row(rows: np.ndarray, cells: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row ``p`` of the communication matrix: rows that partition p sends to every cell.

    The matrix has margins ``rows`` and ``cells``. It is defined by halving the partitions again and
    again, each half's cells drawn with a seed of its own, so any task finds its row by itself in
    log2(partitions) draws and the matrix is never held anywhere.
    """
    low, high = 0, len(rows)
    while high - low > 1:
        middle = (low + high) // 2
        left = draw(np.random.default_rng([seed, low, high]), cells, int(rows[low:middle].sum()))
        if p < middle:
            high, cells = middle, left
        else:
            low, cells = middle, cells - left
    return cells


def layout(total: int, shards: int, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, shard, first slot) of every cell: shards differ by one row at most, cells cut a shard evenly."""
    size, shard, first = [], [], []
    for s in range(shards):
        n = total // shards + (s < total % shards)
        k = max(1, -(-n // cell_rows))
        cuts = np.arange(k + 1) * n // k
        size.append(np.diff(cuts))
        shard.append(np.full(k, s))
        first.append(cuts[:-1])
    return np.concatenate(size), np.concatenate(shard), np.concatenate(first)


def _numbered(docs: DataFrame):
    """``docs`` with _file, _chunk and _row, where rows of a chunk are numbered without gaps, and the chunks."""
    row = F.col("_metadata.row_index")
    tagged = docs.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.floor(row / CHUNK).alias("_chunk"), (row % CHUNK).alias("_row"))
    chunks = tagged.groupBy("_file", "_chunk").agg(F.count("*").alias("n"), F.max("_row").alias("last")).orderBy("_file", "_chunk").collect()
    return (tagged, chunks) if all(c["n"] == c["last"] + 1 for c in chunks) else None


def shard(docs: DataFrame, shards: int = 16, seed: int = 4, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a uniformly random order, cut into shards of (nearly) equal row counts.

    Every chunk of a source file draws exactly how many of its rows go to each cell, deals them out in
    a random order of its own, and after the exchange every cell puts its rows into random order again.
    Cells are fixed ranges of slots, so slots are gapless without ordering a shard in one task. A row is
    known by its file and its place in it, which no retry, lost executor or new split changes; frames
    that are not plain scans of whole Parquet files are written to the shared folder first. The driver
    holds one number per ``CHUNK`` rows. The same files, seed and shard count give the same result.

    Nulls, repeated ids and repeated rows are rows like any other; an empty table gives no rows;
    columns named shard or slot are replaced, all others pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    try:
        numbered = _numbered(docs)
    except AnalysisException:  # no file source below
        numbered = None
    if numbered is None:
        path = scratch_path(spark, "shard-input")
        docs.write.parquet(path)
        numbered = _numbered(spark.read.schema(docs.schema).parquet(path))
    tagged, chunks = numbered
    place = {(c["_file"], c["_chunk"]): i for i, c in enumerate(chunks)}
    rows = np.array([c["n"] for c in chunks], dtype=np.int64)
    size, of_shard, first = layout(int(rows.sum()), shards, cell_rows)

    @F.pandas_udf("cell long, shard int, first long, tie long")
    def assign(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for file, chunk, row in batches:
            frame = pd.DataFrame({"p": [place[k] for k in zip(file, chunk)], "row": row.to_numpy()})
            cell = np.empty(len(frame), dtype=np.int64)
            for p, index in frame.groupby("p").indices.items():
                if p not in held:
                    held.clear()  # rows come file by file
                    labels = np.repeat(np.arange(len(size)), matrix_row(rows, size, p, seed))
                    np.random.default_rng([seed, 1, p]).shuffle(labels)
                    held[p] = labels
                cell[index] = held[p][frame["row"].to_numpy()[index]]
            yield pd.DataFrame({"cell": cell, "shard": of_shard[cell].astype(np.int32), "first": first[cell], "tie": frame["p"].to_numpy()})

    dealt = tagged.withColumn("_to", assign("_file", "_chunk", "_row"))
    within = Window.partitionBy("_to.cell").orderBy(F.xxhash64(F.lit(seed), "_to.cell", "_to.tie", "_row"), "_to.tie", "_row")
    slot = F.col("_to.first") + F.row_number().over(within) - 1
    return dealt.select(*docs.columns, F.col("_to.shard").alias("shard"), slot.cast("int").alias("slot"))
