"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from logspark.llm.tables import exact, free, settled
from logspark.llm.words import NON_SPACE, Words, pieces
from logspark.session import cut_lineage

BLOCK = 64  # words of a block, at most
LEAST_BLOCKS = 16  # blocks of the smallest target
MAX_SOURCES = 1_000_000  # weights are set per source, so their number is bounded by whoever sets them


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = 3.0) -> np.ndarray:
    """Shares of the total by weight; a share stops at ``most`` times its source and the excess is dealt again by weight."""
    total, out, open_ = float(sizes.sum()), np.zeros(len(sizes)), sizes > 0
    while open_.any():
        rest = total - out[~open_].sum()
        share = rest * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        open_ &= ~over
    return out


def sainte_lague(targets_: np.ndarray, seats: int) -> np.ndarray:
    """Seats per source by the highest quotients target / (2k + 1); ties go to the earlier source.

    The divisor is found by bisection, and the seats of quotients that tie with it are dealt in one go, so the work
    does not grow with the number of seats.
    """
    t = np.maximum(targets_, 0.0)
    got = np.zeros(len(t), dtype=np.int64)
    if seats <= 0 or not t.sum():
        return got
    low, high = 0.0, 2 * t.max() + 1  # quotients above the line are in; at ``high`` none is
    for _ in range(200):
        line = (low + high) / 2
        if np.ceil((t / line - 1) / 2).clip(0).sum() > seats:
            low = line
        else:
            high = line
    got = np.ceil((t / high - 1) / 2).clip(0).astype(np.int64)
    while (rest := int(seats - got.sum())) > 0:
        got[np.argsort(-(t / (2 * got + 1)), kind="stable")[: min(rest, int((t > 0).sum()))]] += 1
    return got


@dataclass
class Mix:
    """``docs``: id, size, source, source_size, target, taken, ``runs``; ``quotas``: blocks per (shard, source); ``block``: words of one.

    ``runs`` is an array of (copy, first word, end word, shard): the words of the document that the mix takes, and
    the shard whose quota they fill.
    """

    docs: DataFrame
    quotas: dict
    block: int = 1


def _sizes(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            size = pa.array(Words(batch.column(text), NON_SPACE, lower=False).counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [size], [*names, "size"])

    return run


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    block: int | None = None, most: float = 3.0, shards: int = 16, seed: int = 9,
) -> Mix:
    """Which words of which documents a mixture takes, as often as its source's target asks.

    Sources stand in the order of their code points (null last) and get ``weights`` in turn. The words
    of a source, its documents in seeded order, are one line cut into blocks of ``block`` words: ``BLOCK`` if not
    given, or as few as leave the smallest target ``LEAST_BLOCKS`` of them. The
    blocks of the mixture are apportioned to sources by highest quotients, cumulatively over ``shards``
    (the method is house monotone, so a shard's quota is a difference of two apportionments). A source
    takes its blocks in turn from a seeded start, round and round: all whole rounds, then one run. The first
    blocks of that order are the quota of shard 0, the next ones of shard 1, and so on; a run belongs to the shard
    of its first block.

    A document's place in its line comes from sums over cells of about sqrt(n) documents, so no task
    orders a whole source. Only one row per source reaches the driver (``MAX_SOURCES`` at most, else
    ValueError: give rare sources one name first).

    Null text has no words and is never taken; such rows are returned with 0. Rows repeating an id are
    documents of their own. No documents, or none with words: targets of 0.
    """
    spark = docs.sparkSession
    keys = docs.select(exact(id_col).alias("id"), exact(source_col).cast("string").alias("source"), F.xxhash64(F.lit(seed), exact(id_col), exact(text_col)).alias("place"), exact(text_col).alias("text"))
    sized = keys.mapInArrow(_sizes("text", ["id", "source", "place"]), T.StructType([*keys.schema.fields[:3], T.StructField("size", T.LongType())]))
    sized = cut_lineage(sized)
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    found = per.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give rare ones a common name")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    size = np.array([r["size"] for r in found], dtype=np.int64)
    goal = targets(size, np.array([weights[i % len(weights)] for i in range(len(found))], dtype=float), most)
    if block is None:
        least = goal[goal > 0].min(initial=BLOCK * LEAST_BLOCKS)
        block = int(min(BLOCK, max(1, least // LEAST_BLOCKS)))
    have = -(-size // block)
    total = int(round(goal.sum() / block))
    marks = [total * s // shards for s in range(shards + 1)]
    line = [np.minimum(sainte_lague(goal, m), np.floor(most * have).astype(np.int64)) for m in marks]
    line = list(np.maximum.accumulate(np.array(line)))  # so it is but for ties
    quota = line[-1]
    rng = np.random.default_rng(seed)
    start = [int(rng.integers(n)) if n else 0 for n in have]
    quotas = {(s, r["source"]): int(line[s + 1][i] - line[s][i]) for s in range(shards) for i, r in enumerate(found)}

    rows = [(r["source"], int(size[i]), float(goal[i]), int(quota[i] // have[i]) if have[i] else 0,
             start[i] * block, int(quota[i] % have[i]) * block if have[i] else 0, int(have[i]), [int(x[i]) for x in line[1:]]) for i, r in enumerate(found)]
    table = settled(spark.createDataFrame(rows, "of string, source_size long, target double, rounds long, start long, extra long, have long, marks array<long>"), "sources")
    cells = math.isqrt(sum(r["rows"] for r in found)) + 1
    sized = sized.withColumn("cell", F.pmod(F.shiftrightunsigned("place", 1), F.lit(cells)))
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.groupBy("source", "cell").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy("source", "cell").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    placed = placed.join(table, F.col("source").eqNullSafe(F.col("of")))
    at = F.col("before") + F.col("ahead")
    # the run of the last, partial round: [start, start + extra), going on at 0 where the line ends
    round_ = F.ceil(F.col("source_size") / block) * block
    ends = F.least(F.col("start") + F.col("extra"), round_)
    wrap = F.greatest(F.col("start") + F.col("extra") - round_, F.lit(0))
    cut = lambda a, b: F.struct(F.greatest(a - at, F.lit(0)).alias("first"), F.least(b - at, F.col("size")).alias("end"))
    part = F.filter(F.array(cut(F.lit(0), wrap), cut(F.col("start"), ends)), lambda r: r["end"] > r["first"])
    def run(copy, first, end):
        """One run, with the shard that the place of its first block in the source's order falls to."""
        turned = F.floor((at + first) / block) - F.floor(F.col("start") / block)
        k = (copy - 1) * F.col("have") + F.pmod(turned, F.col("have"))
        shard = F.least(F.size(F.filter("marks", lambda m: m <= k)), F.lit(shards - 1))
        return F.struct(copy.cast("int").alias("copy"), first.cast("long").alias("first"), end.cast("long").alias("end"), shard.alias("shard"))

    whole = F.when((F.col("rounds") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(1), F.col("rounds")), lambda c: run(c, F.lit(0), F.col("size"))))
    whole = F.coalesce(whole, F.array().cast("array<struct<copy: int, first: bigint, end: bigint, shard: int>>"))
    runs = F.concat(whole, F.transform(part, lambda r: run(F.col("rounds") + 1, r["first"], r["end"])))
    out = placed.withColumn("runs", runs)
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
    return Mix(out.select("id", "source", "place", "size", "source_size", "target", taken.alias("taken"), "runs"), quotas, block)


def mixed_documents(docs: DataFrame, plan: Mix, id_col: str = "doc_id", text_col: str = "text", seed: int = 9) -> DataFrame:
    """The mixture itself: a row per copy and run of words taken, with the columns of ``docs``.

    Whole documents keep their text to the byte; the few that a run cuts have the taken words joined
    by single spaces. Rows that repeat id and text are numbered on both sides, so each gets a plan of its own. ``seed`` is
    that of the plan.
    """
    id_, place, nth, size, runs, run = free([*docs.columns, "id", "place", "size", "runs"], "id", "place", "nth", "size", "runs", "run")
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))  # noqa: E731  rows that repeat id and text are alike
    plans = plan.docs.select(F.col("id").alias(id_), F.col("place").alias(place), number("id", "place").alias(nth), F.col("size").alias(size), F.col("runs").alias(runs))
    rows = docs.withColumn(place, F.xxhash64(F.lit(seed), exact(id_col), exact(text_col)))
    rows = rows.withColumn(nth, number(exact(id_col), F.col(place)))
    both = rows.join(plans.where(F.size(runs) > 0).withColumnsRenamed({place: place + "_p", nth: nth + "_p"}),
                     exact(id_col).eqNullSafe(F.col(id_)) & (F.col(place) == F.col(place + "_p")) & (F.col(nth) == F.col(nth + "_p")))
    each = both.withColumn(run, F.explode(runs))
    words = F.filter(F.split(exact(text_col), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    first, end = F.col(f"{run}.first"), F.col(f"{run}.end")
    piece = F.array_join(F.slice(words, first.cast("int") + 1, (end - first).cast("int")), " ")
    whole = (first == 0) & (end == F.col(size))
    taken = F.when(whole, exact(text_col)).otherwise(piece)
    return each.select(*[taken.alias(c) if c == text_col else exact(c) for c in docs.columns])
