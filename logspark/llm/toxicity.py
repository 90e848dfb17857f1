"""Toxicity by weak supervision: mined voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from logspark.llm.words import ALNUM, BASES, Words, distinct, mix, pieces, spans_hash
from logspark.session import cut_lineage, scratch_path

PER_CLASS = 10_000  # labelled rows of each class that the classifier is fitted on, at most
PART = 1 << 20  # labelled ids that are broadcast at once
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes of the word beginnings that patterns look at
MOST_VOTERS = 48
MOST_FEATURES = 1 << 18  # entries that are broadcast, 2 MB of hashes
STRENGTH = 15.0  # likelihood ratio statistic an entry must reach
ODDS = 2.0  # and log odds ratio
VOTER_ODDS = 3.5  # of entries that may vote
CANDIDATES = 256  # strongest of them, of which those that repeat others are left out; more while voters are wanting
MOST_CANDIDATES = 2_048  # whose pairs are counted, 32 MB a task
_BITS = 22


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def entries(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every lexicon entry (whole word) and pattern (beginning of a longer word) of a batch, each once a row."""
    data = words.data.astype(np.uint64) + np.uint64(1)
    row, length = words.row_of(), words.ends - words.starts
    rows, keys = [row], [mix(spans_hash(data, words.starts, words.ends, BASES[0]))]
    for k in PREFIXES:
        at = length > k
        rows.append(row[at])
        keys.append(mix(spans_hash(data, words.starts[at], words.starts[at] + k, BASES[0]) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(keys)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        row, key = entries(Words(batch.column("text"), ALNUM, lower=True))
        every, row = distinct(key, row)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[row]
        key, start = np.unique(every, return_index=True)
        hits = np.add.reduceat(toxic, start) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(start, len(every)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(hits.astype(np.int64)), pa.array((total - hits).astype(np.int64))], ["entry", "toxic", "clean"])


def _present(lexicon: np.ndarray):
    """Numbers of the lexicon's entries that stand in each text."""
    keys = np.sort(lexicon)
    number = np.argsort(lexicon, kind="stable")
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[keys >> np.uint64(64 - _BITS)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, key = entries(Words(batch.column("text"), ALNUM, lower=True))
            likely = np.flatnonzero(seen[key >> np.uint64(64 - _BITS)])
            spot = np.searchsorted(keys, key[likely]).clip(max=len(keys) - 1)
            true = keys[spot] == key[likely]
            held, entry = distinct(row[likely][true], number[spot[true]])
            first = np.searchsorted(held, np.arange(batch.num_rows + 1))
            found = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(entry.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "entries"])

    return run


def _together(n: int):
    """How many documents hold entries i and j, for i, j < n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n), dtype=np.int64)
        for batch in batches:
            for found in batch.column("entries").to_pylist():
                low = [e for e in found or () if e < n]
                total[np.ix_(low, low)] += 1
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])

    return run


def choose_voters(present: DataFrame, n: int, alike: float = 0.8, most: int = MOST_VOTERS) -> list[int]:
    """The strongest of the first ``n`` entries, without those that nearly always stand next to a stronger one."""
    both = np.zeros((n, n))
    for r in present.where(F.size("entries") > 0).mapInArrow(_together(n), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        both[r["i"], r["j"]] = r["n"]
    size = np.sqrt(np.maximum(np.diag(both), 1))
    chosen: list[int] = []
    for e in range(n):
        if len(chosen) < most and all(both[e, c] < alike * size[e] * size[c] for c in chosen):
            chosen.append(e)
    return chosen


@dataclass
class LabelModel:
    """A document casts no vote with P(silent | class); if it votes, voter j is among them with P(hit | toxic), P(miss | clean).

    ``overlap`` discounts voters that repeat each other; a voter that abstains next to others says nothing.
    """

    hit: np.ndarray
    miss: np.ndarray
    silent: np.ndarray
    prior: float
    overlap: np.ndarray

    def weights(self) -> tuple[np.ndarray, float, float]:
        """Log odds that each vote adds, those of a document that votes, and those of one that does not."""
        base = np.log(self.prior / (1 - self.prior))
        voted = np.log1p(-self.silent[0]) - np.log1p(-self.silent[1])
        return (np.log(self.hit) - np.log(self.miss)) / self.overlap, float(base + voted), float(base + np.log(self.silent[0] / self.silent[1]))


def _posterior(bits: np.ndarray, model: LabelModel) -> np.ndarray:
    weight, voted, silent = model.weights()
    return 1 / (1 + np.exp(-np.clip(np.where(bits.any(axis=1), bits @ weight + voted, silent), -50, 50)))


def _expect(model: LabelModel, n: int):
    """Sums for the next step: of posteriors, of votes and of pairs of votes, under both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n + 1, n + 1))
        silent = np.zeros(2)
        for batch in batches:
            mask, count = batch.column("mask").to_numpy(), batch.column("n").to_numpy()
            bits = (mask[:, None] >> np.arange(n) & 1).astype(float)
            p = _posterior(bits, model)
            share = np.stack([p, 1 - p]) * count
            silent += share[:, mask == 0].sum(axis=1)
            voted = np.hstack([bits, (mask != 0)[:, None]])
            total += np.stack([voted.T @ (voted * s[:, None]) for s in share])
        sums = np.concatenate([total.ravel(), silent])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], ["at", "total"])

    return run


def fit_label_model(masks: DataFrame, model: LabelModel, steps: int = 8, alike: float = 0.5) -> LabelModel:
    """Expectation maximisation over ``mask, n`` (bit sets of votes and how many documents cast them).

    Each step is one aggregate over all documents' vote patterns; about 2 (voters + 1)^2 sums reach the
    driver. Voters that correlate by at least ``alike`` among toxic votes share the weight of their
    evidence (``overlap``: one plus those correlations), so ten spellings of one stem count once.
    """
    n = len(model.hit)
    for _ in range(steps):
        sums = np.zeros(2 * (n + 1) ** 2 + 2)
        for r in masks.mapInArrow(_expect(model, n), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
            sums[r["at"]] = r["total"]
        both, silent = sums[:-2].reshape(2, n + 1, n + 1), sums[-2:]
        voted = both[:, n, n]
        if voted[0] <= 0:
            break
        rate = (both[:, n, :n] + 0.1) / (voted[:, None] + 10.0)
        own = both[0, n, :n] / voted[0]
        spread = np.sqrt(np.maximum(own * (1 - own), 1e-12))
        correlation = (both[0, :n, :n] / voted[0] - np.outer(own, own)) / np.outer(spread, spread)
        correlation = np.where(correlation >= alike, np.minimum(correlation, 1), 0)
        np.fill_diagonal(correlation, 0)
        size = voted + silent
        model = LabelModel(
            rate[0], rate[1], ((silent + 0.5) / (size + 1)).clip(1e-6, 1 - 1e-6), float((size[0] / size.sum()).clip(1e-6, 1 - 1e-6)), 1 + correlation.sum(axis=1),
        )
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, seed: int = 5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on).

    Labels are learnt only from rows that are not ``held_out`` and serve to find voters: words and word
    beginnings far more frequent in toxic texts, counted over all such rows. The strongest vote; a
    generative model of their accuracies and correlations is fitted to the votes of all documents, labelled
    or not. A logistic regression over all entries (the ``MOST_FEATURES`` strongest, should there be more)
    is then trained on its posteriors for at most ``per_class`` labelled rows of each class, taken by a hash of their
    id, and scores every whole text. Those rows' ids, ``PART`` labels at a time, the lexicon and sums per pair of
    voters are broadcast or collected.

    Null and empty texts have no entries and get the score of a text without any. Without labels of both
    classes, or without entries that tell them apart, all scores are 0. Several labels of one id count
    as their maximum, null labels as none. Rows repeating an id are scored one by one. Empty table: no
    rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = cut_lineage(known.groupBy(F.col(id_col).alias("of")).agg(F.max(F.col(label_col).cast("long")).alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.lit(seed), "of")
    taken = [known.where(F.col("toxic") == y).orderBy(order, "of").limit(per_class) for y in (0, 1)]
    sample = cut_lineage(taken[0].unionByName(taken[1]))
    t, c = (sizes.get(y, 0) for y in (1, 0))
    lexicon = _lexicon(_counts(rows, known, t + c), t, c) if t and c else []
    plain = rows.select("id", held_out(F.col("id")).alias("held_out"))
    if not lexicon:
        return plain.select(F.col("id").alias(id_col), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    keys = np.array([r["entry"] for r in lexicon], dtype=np.int64).view(np.uint64)
    path = scratch_path(spark, "entries")
    rows.mapInArrow(_present(keys), f"id {docs.schema[id_col].dataType.simpleString()}, entries array<int>").write.parquet(path)
    present = spark.read.parquet(path)
    odds_of = lambda r: np.log((r["toxic"] + 0.5) / (t + 1)) - np.log((r["clean"] + 0.5) / (c + 1))
    able = sum(1 for r in lexicon if odds_of(r) >= VOTER_ODDS)  # they come first
    tried = min(able, CANDIDATES)
    voters = choose_voters(present, tried)
    while len(voters) < MOST_VOTERS and tried < min(able, MOST_CANDIDATES):
        tried = min(able, 2 * tried, MOST_CANDIDATES)
        voters = choose_voters(present, tried)
    if not voters:
        return plain.select(F.col("id").alias(id_col), "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    pick = lambda values, e: F.element_at(F.array(*[F.lit(values.get(i)) for i in range(max(voters) + 1)]), e + 1)
    votes = F.filter("entries", lambda e: (e <= max(voters)) & pick({v: True for v in voters}, e).isNotNull())
    mask = F.aggregate(votes, F.lit(0).cast("long"), lambda m, e: m + pick({v: 1 << k for k, v in enumerate(voters)}, e).cast("long"))
    cast = present.select("id", "entries", mask.alias("mask"))
    masks = cut_lineage(cast.groupBy("mask").agg(F.count("*").alias("n")))
    quiet = {r["toxic"]: r["share"] for r in cast.select("id", "mask").join(known, F.col("id") == F.col("of")).groupBy("toxic").agg(F.avg((F.col("mask") == 0).cast("double")).alias("share")).collect()}
    hits, misses = (np.array([(lexicon[v][k] + 0.5) / (n + 1) for v in voters]) for k, n in (("toxic", t), ("clean", c)))
    start = LabelModel(hits, misses, np.array([quiet.get(1, 0.5), quiet.get(0, 0.5)]).clip(0.01, 0.99), sizes[1] / (sizes[0] + sizes[1]), np.ones(len(voters)))
    weight, voted, silent = fit_label_model(masks, start).weights()

    odds = F.aggregate(votes, F.lit(voted), lambda s, e: s + pick({v: float(w) for v, w in zip(voters, weight)}, e))
    odds = F.when(F.size(votes) > 0, odds).otherwise(silent)
    learn = present.join(F.broadcast(sample.select("of")), F.col("id") == F.col("of")).select("entries", (1 / (1 + F.exp(-odds))).alias("q"))
    both = learn.select("entries", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("q").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("weight")))).alias("y"))
    vocabulary = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(lexicon))], "names", "features")
    vocabulary.setBinary(True)
    names = F.transform("entries", lambda e: e.cast("string"))
    train = cut_lineage(both.select(names.alias("names"), "y.label", "y.weight"))
    fitted = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(vocabulary.transform(train))
    scored = fitted.transform(vocabulary.transform(present.select("id", names.alias("names"))))
    score = vector_to_array("probability")[1]
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def _counts(rows: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """How many toxic and clean rows hold each entry, over all ``known`` ones: their ids are broadcast ``PART`` at a time, so no text is shuffled."""
    parts = -(-size // PART)
    path = scratch_path(rows.sparkSession, "counts")
    for k in range(parts):
        some = known.where(F.pmod(F.xxhash64("of"), F.lit(parts)) == k) if parts > 1 else known
        counted = rows.join(F.broadcast(some), F.col("id") == F.col("of")).select("text", "toxic").mapInArrow(_count, "entry long, toxic long, clean long")
        if parts == 1:
            return counted
        counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _lexicon(counted: DataFrame, t: int, c: int) -> list:
    """Entries that point to toxic texts, those that may vote and then the strongest first: by the likelihood ratio of their counts in t toxic and c clean texts."""
    total = counted.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.lit(t / (t + c))
    both = F.col("toxic") + F.col("clean")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    strength = 2 * (part(F.col("toxic"), both * share) + part(F.col("clean"), both * (1 - share)))
    ratio = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    strong = total.select("*", strength.alias("strength")).where((F.col("strength") >= STRENGTH) & (ratio >= ODDS))
    return strong.orderBy((ratio >= VOTER_ODDS).desc(), F.col("strength").desc(), "entry").limit(MOST_FEATURES).collect()
