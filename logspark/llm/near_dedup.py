"""Near-duplicates by Order MinHash: candidates share several minimum shingles in the same order; banded alignment decides."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from logspark.llm.tables import exact, free, settled
from logspark.llm.words import ALNUM, BASES, Words, mix, pieces, spans_hash, word_bytes
from logspark.session import cut_lineage, scratch_path

SHINGLE = 5
TABLES = 12
MINIMA = 3
LEAST = 0.8
LEADERS = 3  # turns of leaders; how much is left to the exact way, not what is found
PARITY = 4096  # most bits of a text's parity sketch; a longer text only has a weaker bound
NEAREST = 2  # turns of nearest pairs before all that are left; how much is left, not what is found
BLOCK = 512  # texts of one bucket on each side of one comparison
OFTEN = 1 / 16  # share of a crowded bucket's sample from which a shingle counts as frequent there; decides the work, not what is found
SPLITS = 4  # turns of splitting crowded buckets; what is crowded then is compared block by block


class Shingles:
    """Occurrence-labelled shingles of a batch: the k-th time a shingle stands in a row it is another label.

    ``first[i]:first[i + 1]`` are those of row i, in text order. A row of fewer than ``size`` words is one shingle.
    """

    def __init__(self, words: Words, size: int):
        hashes = words.hashes()
        at, key = words.windows(size, hashes)
        row = words.row_of()[at] if len(at) else at
        few = np.flatnonzero((words.counts > 0) & (words.counts < size))
        if len(few):
            whole = mix(spans_hash(hashes, words.first[few], words.first[few + 1], BASES[1]))
            row, key = np.concatenate([row, few]), np.concatenate([key, whole])
            order = np.argsort(row, kind="stable")
            row, key = row[order], key[order]
        order = np.lexsort((key, row))
        sorted_key, sorted_row = key[order], row[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_row[1:] != sorted_row[:-1])
        begin = np.flatnonzero(fresh)
        nth = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
        self.label = np.empty_like(key)
        self.label[order] = mix(sorted_key + nth.astype(np.uint64) * np.uint64(BASES[0]))
        self.row = row
        self.first = np.searchsorted(row, np.arange(len(words.first)))

    def sketch(self, tables: int, minima: int) -> np.ndarray:
        """(rows, tables) hashes of the ``minima`` least labels under each table's order, joined as they stand in the text."""
        rows = np.flatnonzero(np.diff(self.first))
        out = np.zeros((len(self.first) - 1, tables), dtype=np.uint64)
        if not len(rows):
            return out
        starts, sizes = self.first[rows], np.diff(self.first)[rows]
        most = np.uint64(2**64 - 1)
        for t in range(tables):
            value = mix(self.label ^ np.uint64(((t + 1) * BASES[1]) % 2**64))
            best, place = [], []
            for _ in range(minima):
                least = np.minimum.reduceat(value, starts)
                spot = np.flatnonzero(value == np.repeat(least, sizes))
                seen = np.searchsorted(spot, starts)  # the first place, should labels ever tie
                spot = spot[seen]
                best.append(np.where(least == most, np.uint64(0), self.label[spot]))
                place.append(np.where(least == most, len(value), spot))
                value[spot] = most
            order = np.argsort(np.stack(place), axis=0, kind="stable")
            ordered = np.take_along_axis(np.stack(best), order, axis=0)
            joined = np.full(len(rows), t + 1, dtype=np.uint64)
            for part in ordered:
                joined = mix(joined * np.uint64(BASES[0]) + part)
            out[rows, t] = joined
        return out


def _nodes(words: Words, column: pa.Array) -> list[bytes]:
    """128-bit BLAKE2 name of every row's word sequence; of the text itself where it has no words."""
    length = words.ends - words.starts
    ends = np.concatenate(([0], np.cumsum(length)))[words.first]
    body, sizes = memoryview(word_bytes(words)), memoryview(length.astype(np.uint32)).cast("B")
    out = []
    for i, n in enumerate(words.counts.tolist()):
        name = hashlib.blake2b(digest_size=16)
        if n:  # letters and the lengths of the words: no two sequences are alike in both
            name.update(sizes[4 * words.first[i] : 4 * words.first[i + 1]])
            name.update(body[ends[i] : ends[i + 1]])
        else:
            name.update((column[i].as_py() or "").encode())
        out.append(name.digest())
    return out


def _parity(shingles: Shingles) -> list[bytes]:
    """A bit set per row: whether an odd number of its labels fall into each of as many places as it has labels, about.

    Two sets of labels differ in at least as many labels as their bits differ. A set of twice the bits folds
    onto the narrower one, half upon half.
    """
    n = np.diff(shingles.first)
    bits = np.clip(2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64, PARITY)
    first = np.concatenate(([0], np.cumsum(bits)))
    place = (shingles.label >> np.uint64(52)).astype(np.int64) & (bits - 1)[shingles.row]
    odd = np.packbits(np.bincount(first[shingles.row] + place, minlength=first[-1]).astype(np.uint8) & 1, bitorder="little")
    return [odd[a // 8 : b // 8].tobytes() for a, b in zip(first, first[1:])]


def _sketches(tables: int, minima: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), ALNUM, lower=True)
            shingles = Shingles(words, size)
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32()), pa.array(shingles.sketch(tables, minima).ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(_nodes(words, batch.column("text")), pa.binary()), pa.array(np.diff(shingles.first), pa.int64()), keys, pa.array(_parity(shingles), pa.binary())],
                ["id", "node", "n", "keys", "parity"])

    return run


def aligned(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Share of shingles that an alignment of two labelled sequences matches: m / (len(a) + len(b) - m); 0 below ``least``.

    A passing alignment leaves at most ``band`` shingles unmatched, so only pairs of places that are no
    further apart can be in it. Labels are unique within a row, so the longest common subsequence is the
    longest increasing run of places.
    """
    total = len(a) + len(b)
    need = math.ceil(total * least / (1 + least) - 1e-9)
    if min(len(a), len(b)) < need:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(i) < need:
        return 0.0
    near = np.abs(i - j) <= total - 2 * need
    j = j[near][np.argsort(i[near], kind="stable")]
    matched = len(j)
    if matched >= need and np.any(np.diff(j) < 0):
        tails: list[int] = []
        for x in j.tolist():
            k = bisect.bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    return matched / (total - matched) if matched >= need else 0.0


def _align(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "a_text", 1 << 19):
            a, b = (Shingles(Words(batch.column(c), ALNUM, lower=True), size) for c in ("a_text", "b_text"))
            score = [aligned(a.label[a.first[i] : a.first[i + 1]], b.label[b.first[i] : b.first[i + 1]], least) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score, pa.float64())], ["a", "b", "similarity"])

    return run


def _components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame | None:
    """``a, b`` -> ``node, label``, one label per component; with ``labels`` the links are added to those components.

    Every round points each node at its least neighbour, follows the pointers three steps on, and goes on with
    the links between the nodes they lead to. Names are digests, so chains of pointers are short and links fall off quickly.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def renamed(names: DataFrame) -> DataFrame:
        ends = lambda c: names.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        both = edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left").select(F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
        return both.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    if labels is not None:
        edges = renamed(labels)
    while True:
        edges = settled(edges)
        if edges.isEmpty():
            return labels
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
        for _ in range(2):
            to = settled(to.withColumnRenamed("label", "via").join(to.select(F.col("node").alias("via"), "label"), "via").select("node", "label"))
        if labels is None:
            labels = to
        else:
            fresh = to.join(labels.select("node"), "node", "left_anti")
            moved = labels.join(to.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = settled(moved.unionByName(fresh))
        edges = renamed(to)


def _texts(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """One ``node, text`` for every node asked for by the id of a row that holds it."""
    wanted = asked.select(F.col("id").alias("holder"), "node").hint("shuffle_hash")
    held = rows.join(wanted, F.col("id").eqNullSafe(F.col("holder"))).select("id", "node", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):  # an id may be repeated with another text
            own = _nodes(Words(batch.column("text"), ALNUM, lower=True), batch.column("text"))
            done: set[bytes] = set()
            keep = [i for i, (x, y) in enumerate(zip(own, batch.column("node").to_pylist())) if x == y and not (y in done or done.add(y))]
            yield batch.take(pa.array(keep, pa.int64())).select(["node", "text"])

    return held.mapInArrow(same, "node binary, text string")


def _folded(data: list[bytes], bits: int) -> np.ndarray:
    """Bit sets of at least ``bits`` as rows of 64-bit numbers, wider ones folded to that width."""
    out = np.empty((len(data), bits // 64), dtype=np.uint64)
    for i, x in enumerate(data):
        row = np.frombuffer(x, dtype=np.uint64)
        while len(row) > bits // 64:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _possible(rows: dict[str, list], same: bool, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, the others that can be similar to row i, in how many bits they differ), every pair once; exact as a filter.

    Pairs of unlike labels whose lengths allow ``least`` and whose parity sketches differ in no more bits than
    two texts with that many shingles in common may differ in shingles.
    """
    n = np.array(rows["n"])
    _, label = np.unique(np.array([x.hex() for x in rows["label"]]), return_inverse=True)
    block = np.array(rows["block"])
    by_bits: dict[int, np.ndarray] = {}
    size = np.array([8 * len(x) for x in rows["parity"]])
    for i in range(len(n)):
        other = np.arange(i + 1, len(n)) if same else np.flatnonzero(block[i + 1 :] != block[i]) + i + 1
        other = other[(label[other] != label[i]) & (np.minimum(n[other], n[i]) >= least * np.maximum(n[other], n[i]))]
        if not len(other):
            continue
        found, gaps = [], []
        for bits in np.unique(np.minimum(size[other], size[i])):
            mine = other[np.minimum(size[other], size[i]) == bits]
            if bits not in by_bits:  # rows below this width never take part
                wide = np.flatnonzero(size >= bits)
                held = np.zeros((len(n), bits // 64), dtype=np.uint64)
                held[wide] = _folded([rows["parity"][k] for k in wide], int(bits))
                by_bits[bits] = held
            gap = np.bitwise_count(by_bits[bits][mine] ^ by_bits[bits][i]).sum(axis=1, dtype=np.int64)
            need = np.ceil((n[mine] + n[i]) * (least / (1 + least)) - 1e-9)
            ok = gap <= n[mine] + n[i] - 2 * need
            found.append(mine[ok])
            gaps.append(gap[ok])
        yield i, np.concatenate(found), np.concatenate(gaps)


def _frequent(sample: DataFrame, size: int) -> DataFrame:
    """``bucket, often``: the labels that at least ``OFTEN`` of the ``bucket, text`` of a bucket hold."""

    def run(table: pa.Table) -> pa.Table:
        shingles = Shingles(Words(pa.concat_arrays(table.column("text").chunks), ALNUM, lower=True), size)
        label, held = np.unique(shingles.label, return_counts=True)
        often = label[held >= max(2, table.num_rows * OFTEN)].view(np.int64)
        return pa.table({"bucket": table.column("bucket")[:1], "often": pa.array([often], pa.list_(pa.int64()))})

    return sample.groupBy("bucket").applyInArrow(run, "bucket long, often array<long>")


def _rare(size: int):
    """``keys``: the first ``spare`` + 1 labels of a text that are not in ``often``; ``near``: there are no more than ``spare``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            shingles = Shingles(Words(batch.column("text"), ALNUM, lower=True), size)
            keys, near = [], []
            for i, spare in enumerate(batch.column("spare").to_pylist()):
                often = batch.column("often")[i].values
                own = shingles.label[shingles.first[i] : shingles.first[i + 1]].view(np.int64)
                rare = np.setdiff1d(own, often.to_numpy(zero_copy_only=False)) if often is not None else np.sort(own)
                keys.append(rare[: spare + 1])
                near.append(len(rare) <= spare)
            kept = batch.select(["bucket", "node", "label", "n", "parity"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(keys, pa.list_(pa.int64())), pa.array(near, pa.bool_())], [*kept.schema.names, "keys", "near"])

    return run


def _split(members: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """``bucket, node, label, n, parity`` with crowded buckets split: similar texts of unlike labels of a bucket meet in one of its parts.

    Two similar texts lack at most ``spare`` of each other's shingles, a bound by their lengths. In an order in which the shingles that are
    frequent in the bucket come last, the first one they share is therefore among the first ``spare`` + 1 of both. If it is not a
    frequent one, they meet in the part of that shingle, which few texts hold; if it is, neither has more than ``spare``
    others, and they meet in the part of such texts. Which shingles count as frequent is taken from a sample of about
    ``BLOCK`` texts; that decides how large parts are, never what meets. Parts of one label, of the same texts (128 bits) as another, or whose texts
    meet in the last part anyway are dropped, crowded ones are split again.
    """
    names = ["bucket", "node", "label", "n", "parity"]
    done = None
    for turn in range(SPLITS + 1):
        sizes = settled(members.groupBy("bucket").agg(F.count("*").alias("m"), F.min("n").alias("fewest"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").drop("x", "y"))
        crowded = sizes.where(F.col("m") > BLOCK)
        last = turn == SPLITS or crowded.isEmpty()
        part = members.join(sizes if last else sizes.where(F.col("m") <= BLOCK), "bucket", "left_semi").select(names)
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        held = members.join(crowded, "bucket").join(texts.select("node", "text"), "node")
        sample = held.where(F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("m") / BLOCK)) == 0).select("bucket", "text")
        other = F.greatest("fewest", F.ceil(F.col("n") * least - 1e-6))
        spare = F.col("n") - F.ceil((F.col("n") + other) * (least / (1 + least)) - 1e-6)
        asked = held.join(settled(_frequent(sample, size)), "bucket", "left").select(*names, spare.cast("long").alias("spare"), "often", "text")
        keyed = settled(asked.mapInArrow(_rare(size), "bucket long, node binary, label binary, n long, parity binary, keys array<long>, near boolean"))
        done = done.unionByName(keyed.where("near").select(names))
        keys = keyed.select("bucket", "node", "label", "near", F.explode("keys").alias("key"))
        same = [F.count("*").alias("m"), *(F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"set{i}") for i in range(2))]
        shared = keys.groupBy("bucket", "key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.bool_and("near").alias("near"), *same).where("x < y AND NOT near")
        shared = shared.groupBy("bucket", "m", "set0", "set1").agg(F.min("key").alias("key")).select("bucket", "key")
        parts = keys.join(shared, ["bucket", "key"]).select("bucket", "node", "key").join(keyed.drop("keys", "near"), ["bucket", "node"])
        members = settled(parts.withColumn("bucket", F.xxhash64("bucket", "key")).select(names))


def _dealt(members: DataFrame) -> DataFrame:
    """``bucket, low, high, block, node, n, parity``: the members of a bucket in blocks; every pair of unlike labels meets in one (bucket, low, high).

    Up to ``BLOCK`` members are one block. Beyond that those of the commonest label, which need not be compared with each other, are in blocks of
    their own and copied only per block of the others.
    """
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("bucket").agg(F.sum("k").alias("m"), F.max(F.struct("k", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1")
    crowded = F.col("m") > BLOCK
    few = F.when(crowded, F.ceil((F.col("m") - F.col("major.k")) / BLOCK)).otherwise(1)
    many = F.when(crowded, F.ceil(F.col("major.k") / BLOCK)).otherwise(0)
    sizes = settled(sizes.select("bucket", few.cast("int").alias("few"), many.cast("int").alias("many"), F.when(crowded, F.col("major.label")).alias("major")))
    most = F.col("label").eqNullSafe(F.col("major"))
    block = F.when(most, F.col("few") + F.pmod(F.xxhash64("node"), F.greatest("many", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), "few"))
    dealt = members.join(sizes, "bucket").withColumn("block", block.cast("int")).withColumn("most", most)
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(F.col("most"), 0).otherwise(F.col("many")))).alias("other"))
    return dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "parity")


def _bucket_pairs(dealt: DataFrame, least: float, nearest: bool) -> DataFrame:
    """``a, b, gap``: every pair of ``bucket, low, high, block, node, label, n, parity`` that meets, of unlike labels, that can be ``least`` similar.

    With ``nearest``, of every text in a comparison only the pair that differs in the fewest bits: at most one row per member.

    What leaves a task are pairs that pass the bounds of ``_possible``, before any text is moved.
    """
    keys = ["bucket", "low", "high"]
    unlike = dealt.groupBy(*keys).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select(*keys)
    dealt = dealt.join(unlike, keys, "left_semi")
    names = ["block", "node", "label", "n", "parity"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key, rows):
            a, b, gap = [], [], []
            best: dict[int, tuple[int, int]] = {}
            for i, others, gaps in _possible(rows, key[1] == key[2], least) if len(rows["n"]) > 1 else ():
                if nearest:
                    for j, g in zip(others.tolist(), gaps.tolist()):
                        for one, two in ((i, j), (j, i)):
                            if one not in best or g < best[one][0]:
                                best[one] = (g, two)
                    continue
                for j, g in zip(others.tolist(), gaps.tolist()):
                    x, y = sorted((rows["node"][i], rows["node"][j]))
                    a.append(x)
                    b.append(y)
                    gap.append(g)
            for x, y in {tuple(sorted((rows["node"][i], rows["node"][j]))) for i, (_, j) in best.items()}:
                a.append(x)
                b.append(y)
                gap.append(0)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(gap, pa.int64())], ["a", "b", "gap"])

        held_key, held = None, {n: [] for n in names}
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in names}
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high")], axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]))
            for start, end in zip(cuts, cuts[1:]):
                key = tuple(keys[start].tolist())
                if key != held_key and held_key is not None:
                    yield pairs(held_key, held)
                    held = {n: [] for n in names}
                held_key = key
                for n in names:
                    held[n] += columns[n][start:end]
        if held_key is not None:
            yield pairs(held_key, held)

    found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "a binary, b binary, gap long")
    return found.groupBy("a", "b").agg(F.min("gap").alias("gap"))


def near_links(sketched: DataFrame, texts: DataFrame, size: int, least: float) -> tuple[DataFrame, DataFrame] | None:
    """``a, b, similarity`` between distinct texts, enough to connect every group, and ``node, label`` of the groups; None without candidates.

    In each bucket all members are aligned with one leader, which is linear in the bucket. For
    ``LEADERS`` turns a bucket that is not one group by its last leader takes another of its members, linked or
    not, as the next leader for those that have not led; the order of leaders is another one in every table. Buckets
    whose members are then still of several groups are decided exactly: of all their pairs, those that the
    parity sketches of their shingles do not rule out are aligned (``_bucket_pairs``). Buckets of more than ``BLOCK`` members are first split by their rare
    shingles, which parts no similar texts (``_split``). For ``NEAREST`` turns only the nearest
    pair of every text is, which joins most groups that can be joined; then all that are still of unlike groups. So every pair of a bucket is either aligned, ruled out by a bound, or in one group by then.
    """
    alike = settled(sketched.select("node", "n", F.posexplode("keys").alias("t", "bucket")).withColumn("linked", F.lit(False)).withColumn("hit", F.lit(False)))
    seen = links = None

    def decided(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b").select("a", "b", "a_text", "b_text")
        return settled(both.mapInArrow(_align(size, least), "a binary, b binary, similarity double"))

    for turn in range(1, LEADERS + 1):
        head = F.min(F.struct("linked", F.xxhash64("node", "t", F.lit(turn)).alias("order"), "node", "n"))
        leaders = settled(alike.groupBy("bucket").agg(head.alias("h"), F.count("*").alias("m"), F.bool_and("hit").alias("one")).where("m > 1 AND NOT one").select(
            F.col("bucket").alias("of"), F.col("h.node").alias("leader"), F.col("h.n").alias("leader_n")))
        members = settled(alike.drop("hit").join(leaders, (F.col("bucket") == F.col("of")) & (F.col("node") != F.col("leader"))).drop("of"))
        if members.isEmpty():
            break
        fits = F.least("n", "leader_n") >= least * F.greatest("n", "leader_n")
        pairs = members.where(fits).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        scored = decided(pairs)
        good = scored.where(F.col("similarity") >= least)
        seen = scored.select("a", "b") if seen is None else seen.unionByName(scored.select("a", "b"))
        links = good if links is None else links.unionByName(good)
        found = links.select("a", "b", F.lit(True).alias("found"))
        left = members.withColumn("a", F.least("leader", "node")).withColumn("b", F.greatest("leader", "node")).join(found, ["a", "b"], "left")
        hit = F.coalesce("found", F.lit(False))
        alike = settled(left.select("node", "n", "t", "bucket", (F.col("linked") | hit).alias("linked"), hit.alias("hit")))
    if links is None:
        return None
    labels = _components(links)
    if labels is None:  # pairs, but no links: every text stands alone so far
        labels = sketched.limit(0).select("node", F.col("node").alias("label"))
    still = alike.join(alike.groupBy("bucket").agg(F.count("*").alias("m"), F.bool_and("hit").alias("one")).where("m > 1 AND NOT one").select("bucket"), "bucket")
    still = still.select("bucket", "node").join(sketched.select("node", "n", "parity"), "node").join(labels, "node", "left")
    still = settled(still.withColumn("label", F.coalesce("label", "node")))
    dealt = settled(_dealt(_split(still, texts, size, least)))
    for nearest in (*[True] * NEAREST, False):
        named = dealt.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs = settled(_bucket_pairs(named, least, nearest).join(seen, ["a", "b"], "left_anti").select("a", "b"))
        if pairs.isEmpty():
            if nearest:
                continue
            break
        scored = decided(pairs)
        seen = seen.unionByName(scored.select("a", "b"))
        more = scored.where(F.col("similarity") >= least)
        links = links.unionByName(more)
        labels = _components(more, labels)
    return links, labels


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, size: int = SHINGLE, tables: int = TABLES, minima: int = MINIMA,
) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (least id of its class), ``class_size``, ``kept`` (it is that id).

    Words are runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z; shingles are ``size`` words.
    Texts of equal words are one node (texts without words: equal texts). Two nodes are linked when a banded
    alignment of their occurrence-labelled shingles matches ``least`` of them (matched / all); classes are
    connected components. Candidates have the same ``minima`` least shingles in the same order in one
    of ``tables`` random orders (at similarity 0.8 about half the time per table).

    Null counts as empty; empty texts are one class. Of ids the null one is the greatest. Rows repeating an
    id are rows of their own; identical ones are in one class and share ``kept``. Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(exact(id_col).alias("id"), F.coalesce(exact(text_col), F.lit("")).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    path = scratch_path(spark, "sketches")
    rows.mapInArrow(_sketches(tables, minima, size), f"id {id_type}, node binary, n long, keys array<long>, parity binary").write.parquet(path)
    every = spark.read.parquet(path)
    nodes = cut_lineage(every.groupBy("node").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    first = nodes.select(F.col("node").alias("held"), F.col("rep").alias("holder"))
    sketched = every.where("n > 0").join(first, (F.col("node") == F.col("held")) & F.col("id").eqNullSafe(F.col("holder")))
    path = scratch_path(spark, "nodes")
    sketched.select("node", "id", "n", "keys", "parity").write.parquet(path)
    sketched = spark.read.parquet(path)
    shared = sketched.select(F.explode("keys").alias("bucket"), "node").groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    shared = cut_lineage(shared.select("bucket"))
    asked = sketched.select("id", "node", F.explode("keys").alias("bucket")).join(shared, "bucket", "left_semi").select("id", "node").distinct()
    path = scratch_path(spark, "candidates")
    _texts(rows, cut_lineage(asked)).write.parquet(path)
    texts = spark.read.parquet(path)
    members = sketched.join(cut_lineage(texts.select("node").distinct()), "node", "left_semi").select("node", "n", "keys", "parity").dropDuplicates(["node"])
    linked = near_links(cut_lineage(members), texts, size, least)
    classes = nodes.select("node", "rep", "copies")
    if linked is not None:
        labels = linked[1]
        named = nodes.join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
        sums = named.groupBy("label").agg(F.min("rep").alias("rep"), F.sum("copies").alias("copies"))
        classes = cut_lineage(cut_lineage(named.select("node", "label")).join(cut_lineage(sums), "label").select("node", "rep", "copies"))
    out = every.select("id", "node").join(classes, "node")
    return out.select(
        F.col("id").alias(id_col), F.col("rep").alias("class_id"), F.col("copies").cast("long").alias("class_size"), F.col("id").eqNullSafe(F.col("rep")).alias("kept"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **named) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, all columns as they were.

    Of rows that repeat that id with the same text one stays; an id repeated with other texts stays if any of its
    texts leads a class.
    """
    mark, nth = free(docs.columns, "kept", "nth")
    kept = near_classes(docs, id_col, text_col, **named).where("kept").select(exact(id_col).alias(mark)).distinct()
    rows = docs.join(kept, exact(id_col).eqNullSafe(F.col(mark))).drop(mark)
    again = Window.partitionBy(exact(id_col), F.xxhash64(exact(text_col))).orderBy(F.lit(0))
    return rows.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).drop(nth)
