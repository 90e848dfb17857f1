"""How far the sources of a language differ in their words: exact divergences over run-length encoded count columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from logspark.llm.tables import exact, settled
from logspark.llm.words import Words, pieces, word_array

_BYTE = np.arange(256)
#: a-z, A-Z and every byte of a non-ASCII character
LETTERS = (_BYTE >= 0x80) | ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90))
SCALE = 1_000_000_000
SEGMENT = 8_192  # terms of one stretch of the ordered vocabulary
BLOCK = 64  # sources on each side of one comparison task


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per (lang, source, term), combined per piece of a batch; strings are compared, not hashes."""
    for batch in pieces(batches, "text", 1 << 22):
        words = Words(batch.column("text"), LETTERS, lower=True)
        if not len(words.starts):
            continue
        term = word_array(words).dictionary_encode()
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        n_terms, n_sources = len(term.dictionary), len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
        once, times = np.unique(words.row_of() * n_terms + term.indices.to_numpy(), return_counts=True)
        cell, at, docs = np.unique(group[once // n_terms] * n_terms + once % n_terms, return_inverse=True, return_counts=True)
        count = np.zeros(len(cell), dtype=np.int64)
        np.add.at(count, at, times)
        of = pa.array(cell // n_terms)
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(np.asarray(of) // n_sources)), source.dictionary.take(pa.array(np.asarray(of) % n_sources)),
             term.dictionary.take(pa.array(cell % n_terms)).cast(pa.string()), pa.array(count), pa.array(docs.astype(np.int64))],
            ["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), exact for whole numbers up to 9e15: long division, three digits a step."""
    rest = count.astype(np.int64) + 1
    out = np.zeros_like(rest)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def _share(count: str, whole: str) -> str:
    """``share`` as a SQL expression."""
    rest, out = f"({count} + 1)", "0L"
    for _ in range(3):
        out, rest = f"({out} * 1000L + ({rest} * 1000L) div {whole})", f"(({rest} * 1000L) % {whole})"
    return f"({out} + 1)"


def run_lengths(dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first position, value) of every run of equal values."""
    first = np.concatenate(([0], np.flatnonzero(np.diff(dense)) + 1))
    return first, dense[first]


def divergence(first_a: np.ndarray, p_a: np.ndarray, first_b: np.ndarray, p_b: np.ndarray, size: int) -> tuple[int, int]:
    """Sums of floor((p - q)^2 / q) over ``size`` positions for (p, q) = (a, b) and (b, a), from the runs of both.

    The boundaries of both are merged; between two of them neither column changes, so f is evaluated
    once and multiplied by the length of the stretch.
    """
    edge = np.union1d(first_a, first_b)
    length = np.diff(np.append(edge, size))
    p = p_a[np.searchsorted(first_a, edge, side="right") - 1]
    q = p_b[np.searchsorted(first_b, edge, side="right") - 1]
    square = (p - q) ** 2
    return int((square // q * length).sum()), int((square // p * length).sum())


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length columns of the sources in every stretch of up to ``SEGMENT`` terms of one language, in the order they come."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        code = lang.indices.to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1, [batch.num_rows]))
        for low, high in zip(cuts, cuts[1:]):
            for a in range(low, high, SEGMENT):
                rows = batch.slice(a, min(SEGMENT, high - a))
                by = rows.column("by_source")
                entry = by.flatten()
                at = np.repeat(np.arange(rows.num_rows), np.diff(by.offsets.to_numpy()))
                source = entry.field("source").dictionary_encode()
                own, count = source.indices.to_numpy(), entry.field("n").to_numpy()
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(len(source.dictionary) + 1))
                firsts, values = [], []
                for s in range(len(source.dictionary)):
                    mine = order[ends[s] : ends[s + 1]]
                    dense = np.zeros(rows.num_rows, dtype=np.int64)
                    dense[at[mine]] = count[mine]
                    first, value = run_lengths(dense)
                    firsts.append(first)
                    values.append(value)
                n = len(source.dictionary)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("lang").slice(0, 1).take(pa.array([0] * n, pa.int32())), pa.array([(part << 32) + made] * n, pa.int64()),
                     pa.array([rows.num_rows] * n, pa.int64()), source.dictionary, pa.array(firsts, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))],
                    ["lang", "segment", "terms", "source", "firsts", "counts"])
                made += 1


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of all pairs of two blocks of sources in one stretch of the vocabulary."""
    _, _, low, high = key
    terms = rows["terms"].iloc[0]
    size = 0 if pd.isna(terms) else int(terms)
    sides = []
    for r in rows.itertuples():
        first = np.zeros(1, dtype=np.int64) if r.firsts is None else np.asarray(r.firsts)
        count = np.zeros(1, dtype=np.int64) if r.counts is None else np.asarray(r.counts)
        sides.append((r.block, r.source, first, share(count, r.whole) if size else None))
    out = []
    for i, (block_a, a, first_a, p_a) in enumerate(sides):
        for block_b, b, first_b, p_b in sides[i + 1 :]:
            if low != high and block_a == block_b:
                continue
            there, back = divergence(first_a, p_a, first_b, p_b, size) if size else (0, 0)
            out += [(rows["lang"].iloc[0], a, b, there), (rows["lang"].iloc[0], b, a, back)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200,
) -> DataFrame:
    """Rows ``lang, source, part, item, value, rank``: how a source's words differ from other sources and from its language.

    Terms are runs of letters and non-ASCII characters after lower-casing A-Z. A language keeps the terms
    in at least ``min_docs`` of its documents (V of them). With N occurrences of kept terms, a count c has the share
    p = 1 + floor(10^9 (c + 1) / (N + V)). Part ``pair``: the sum over kept terms of floor((p - q)^2 / q) for every
    other source of the language, all ranks. Part ``term``: that value against the whole language for terms the
    source overuses, ranks up to ``top``. All numbers are whole and exact while N + V is below 9e15.

    The vocabulary of a language is ordered by its vectors of counts, so equal counts stand together, and
    cut into stretches. Every source is a run-length column in a stretch; a pair of sources is the
    intersection of their run boundaries, f times the length between two of them. Pairs are compared
    in blocks of ``BLOCK`` sources per stretch, so no task holds a whole language or a whole vocabulary.
    The result has S (S - 1) rows for S sources of a language, as asked for.

    Null text, lang and source count as ''. A source without kept terms still has its pairs; a language
    without any has values of 0. Repeated rows are documents of their own; ties rank by item in UTF-8
    order. Empty table: no rows. Other columns are ignored, whatever their names.
    """
    clean = [F.coalesce(exact(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*clean)
    counted = rows.mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("by_source"))
    kept = settled(vectors.where(F.col("docs") >= min_docs).select("lang", "term", "n", "by_source"), "terms")

    of_lang = kept.groupBy("lang").agg((F.sum("n") + F.count("*")).alias("lang_whole"), F.count("*").alias("v"))
    single = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("by_source").alias("e")).select("lang", "term", "lang_n", F.col("e.source").alias("source"), F.col("e.n").alias("n"))
    of_source = single.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = settled(groups.select(
        "lang", "source", "lang_whole", (F.coalesce("n", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("whole"), F.floor(numbered / BLOCK).cast("int").alias("block")), "groups")

    def ranked(found: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    shares = single.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), F.expr(_share("n", "whole")).alias("p"), F.expr(_share("lang_n", "lang_whole")).alias("q"))
    over = shares.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = ranked(over, "term").where(F.col("rank") <= top)

    ordered = kept.select("lang", "by_source").repartitionByRange("lang", "by_source").sortWithinPartitions("lang", "by_source")
    runs = settled(ordered.mapInArrow(_encode, "lang string, segment long, terms long, source string, firsts array<long>, counts array<long>"), "runs")
    segments = runs.select("lang", "segment", "terms").distinct()
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    sides = groups.join(blocks, "lang").join(segments, "lang", "left").join(runs.drop("terms"), ["lang", "segment", "source"], "left")
    sides = sides.select("lang", "segment", "source", "terms", "whole", "block", "firsts", "counts", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    sides = sides.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = sides.groupBy("lang", "segment", "low", "high").applyInPandas(_compare, "lang string, source string, item string, value long")
    pairs = ranked(found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
    return pairs.unionByName(terms)
