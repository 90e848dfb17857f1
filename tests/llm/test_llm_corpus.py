"""Operators on the corpus as a whole: near-duplicates, mixing, sharding, toxicity, chat."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, none, rows  # noqa: F401
from logspark.llm import chat, mixing, near_dedup, sharding, toxicity

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def labelled(text):
    w, seen, out = WORD.findall((text or "").translate(LOW)), Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        s = tuple(w[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def brute_classes(rows):
    nodes = defaultdict(list)
    for i, t in rows:
        nodes[tuple(WORD.findall((t or "").translate(LOW))) or ("", t or "")].append(i)
    names, up = list(nodes), {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    seqs = [labelled(" ".join(n)) if n[0] else [] for n in names]
    for x in range(len(names)):
        for y in range(x):
            a, b = seqs[x], seqs[y]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) >= 0.8 * max(len(a), len(b)) * 0.9:
                m = lcs(a, b)
                if m / (len(a) + len(b) - m) >= 0.8:
                    up[root(x)] = root(y)
    classes = defaultdict(list)
    for x, n in enumerate(names):
        classes[root(x)] += nodes[n]
    return {i: (min(v, key=lambda i: (i is None, i)), len(v)) for v in classes.values() for i in v}


def test_near_classes(spark, docs, rows, none):
    want = brute_classes([(r[0], r[1]) for r in rows])
    found = near_dedup.near_classes(docs).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.class_id, r.class_size) for r in found} == want
    assert want[0][1] == 5  # copies, and one with a word changed (the upper-cased text differs beyond A-Z)
    left = near_dedup.drop_near(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter({c for c, _ in want.values()})
    assert near_dedup.near_classes(none).count() == 0


def test_near_chain_and_shared_passage(spark):
    """A chain whose ends differ is one class; texts that share half of their words are not."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = [word() for _ in range(150)]
    rows = [(0, " ".join(text))]
    for i in range(1, 12):
        text = list(text)
        text[13 * i % 150] = word()
        rows.append((i, " ".join(text)))
    shared = [word() for _ in range(80)]
    rows += [(100 + i, " ".join(shared + [word() for _ in range(60)])) for i in range(40)]
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.class_size) for r in found} == brute_classes(rows)
    assert max(r.class_size for r in found) == 12


def test_near_crowded_bucket(spark, monkeypatch):
    """All texts in one bucket and in no other: every pair is decided, however many groups there are."""
    real = near_dedup._sketches

    def crowded(tables, minima, size):
        run = real(tables, minima, size)

        def crowd(batches):
            for batch in run(batches):
                names = [int.from_bytes(x[:7], "big") for x in batch.column("node").to_pylist()]
                keys = pa.array([[7] + [x * 64 + t for t in range(1, tables)] for x in names], pa.list_(pa.int64()))
                yield batch.set_column(batch.schema.names.index("keys"), "keys", keys)

        return crowd

    monkeypatch.setattr(near_dedup, "_sketches", crowded)
    monkeypatch.setattr(near_dedup, "BLOCK", 8, raising=False)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared, rows = [word() for _ in range(60)], []
    for family in range(10):
        text = shared + [word() for _ in range(90)]
        for _ in range(7):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[60 + rng.randrange(90)] = word()
            text[60 + rng.randrange(90)] = word()
    rows += [(100 + i, " ".join(shared + [word() for _ in range(80)])) for i in range(20)]
    found = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert {r.doc_id: (r.class_id, r.class_size) for r in found} == want
    assert sorted(Counter(c for c, _ in want.values()).values()) == [1] * 20 + [7] * 10


def test_near_crowded_bucket_is_split(spark, monkeypatch):
    """Variants of one text in one bucket, each with a twin: all twins meet, and copies of members grow with the bucket, not its square."""
    from logspark.llm.words import ALNUM, Words

    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]

    def changed(text, n):
        text = list(text)
        for at in rng.sample(range(len(text)), n):
            text[at] = word()
        return text

    for m in (64, 256):
        half = [changed(base, rng.randrange(5, 12)) for _ in range(m // 2)]
        column = pa.array([" ".join(t) for t in [*half, *(changed(t, 1) for t in half)]], pa.large_string())
        words = Words(column, ALNUM, lower=True)
        shingles, names = near_dedup.Shingles(words, 5), near_dedup._nodes(words, column)
        rows = [(7, x, x, int(n), p) for x, n, p in zip(names, np.diff(shingles.first), near_dedup._parity(shingles))]
        members = spark.createDataFrame(rows, "bucket long, node binary, label binary, n long, parity binary")
        texts = spark.createDataFrame(list(zip(names, column.to_pylist())), "node binary, text string")
        dealt = near_dedup._dealt(near_dedup._split(members, texts, 5, 0.8)).collect()
        part = lambda i: shingles.label[shingles.first[i] : shingles.first[i + 1]]
        links = {frozenset((names[i], names[j])) for i in range(m) for j in range(i) if near_dedup.aligned(part(i), part(j), 0.8) >= 0.8}
        together = defaultdict(list)
        for r in dealt:
            together[r.bucket, r.low, r.high].append((bytes(r.node), r.block))
        met = {frozenset((a, b)) for (_, low, high), v in together.items() for a, x in v for b, y in v if low == high or x != y}
        assert links <= met and len(links) >= m // 2
        assert len(dealt) < 8 * m  # 64 * 4 and 256 * 16 when every block met every other
        assert max(map(len, together.values())) <= 64


def test_components_by_contraction(spark):
    rng = random.Random(12)
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)] + [(200, 201), (201, 200)]
    later = [(5, 120), (201, 300), (300, 301), (400, 401)]
    frame = lambda e: spark.createDataFrame([(name(a), name(b)) for a, b in e], "a binary, b binary")

    def groups(rows):
        out = defaultdict(set)
        for r in rows:
            out[bytes(r.label)].add(bytes(r.node))
        return {frozenset(v) for v in out.values()}

    def brute(edges):
        up = {}
        root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
        for a, b in edges:
            up[root(a)] = root(b)
        out = defaultdict(set)
        for x in {x for e in edges for x in e}:
            out[root(x)].add(name(x))
        return {frozenset(v) for v in out.values() if len(v) > 1}

    first = near_dedup._components(frame(edges))
    assert groups(first.collect()) == brute(edges)
    assert groups(near_dedup._components(frame(later), first).collect()) == brute(edges + later)
    assert near_dedup._components(frame([])) is None


def test_near_names_and_bounds():
    """Sequences that polynomial hashes modulo 2^64 confuse have names of their own; parity sketches never rule out a link."""
    from logspark.llm.words import ALNUM, Words

    bits = [bin(i).count("1") % 2 for i in range(2048)]
    texts = [" ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits), "ab c", "a bc", "abc", "A-b C", "...", "", "..."]
    column = pa.array(texts, pa.large_string())
    names = near_dedup._nodes(Words(column, ALNUM, lower=True), column)
    assert len(set(names)) == 8 and names[6] == names[8] and all(len(x) == 16 for x in names)
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(260)]
    family = []
    for i in range(60):
        text = list(base[: rng.randrange(150, 260)])
        for _ in range(rng.randrange(9)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(900)}"
        family.append(" ".join(text))
    shingles = near_dedup.Shingles(Words(pa.array(family, pa.large_string()), ALNUM, lower=True), 5)
    rows = {"n": np.diff(shingles.first).tolist(), "label": [bytes([i]) for i in range(60)], "block": [0] * 60, "parity": near_dedup._parity(shingles)}
    possible = {(i, j) for i, others, _ in near_dedup._possible(rows, True, 0.8) for j in others.tolist()}
    part = lambda i: shingles.label[shingles.first[i] : shingles.first[i + 1]]
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if near_dedup.aligned(part(i), part(j), 0.8) >= 0.8}
    assert links <= possible and 5 < len(links) and len(possible) < 60 * 59 / 4


def test_toxic_words_rare_in_the_sample(spark, monkeypatch):
    """Words too rare in the classifier's sample to pass the test there are entries all the same: all labelled rows count."""
    monkeypatch.setattr(toxicity, "PART", 1000, raising=False)
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice("the a of to in we you it on at".split()) for _ in range(12))
    rows = [(i, plain() + (" zorgly" if i < 60 else " vilest" if i < 1500 else ""), int(i < 1500)) for i in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, per_class=150).collect()}
    assert min(score[i] for i in range(60)) > max(score[i] for i in range(1500, 3000)) + 0.1


def test_mix(docs, rows, none):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    plan = mixing.mix(docs, block=16)
    got = plan.docs.collect()
    assert Counter((r.id, r["size"]) for r in got) == Counter((r[0], count(r[1])) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    total = sum(count(r[1]) for r in rows)
    per = defaultdict(lambda: [0, 0])
    for r in got:
        per[r.source][0] = r.target
        per[r.source][1] += r.taken
    assert sum(t for t, _ in per.values()) == pytest.approx(total)
    assert all(abs(t - n) <= 3 * 16 + 1 for t, n in per.values())
    again = Counter((r.id, r.place, r.taken) for r in mixing.mix(docs.repartition(2), block=16).docs.collect())
    assert again == Counter((r.id, r.place, r.taken) for r in got)  # identical rows may change places
    mixed = mixing.mixed_documents(docs.dropDuplicates(["doc_id"]), mixing.mix(docs.dropDuplicates(["doc_id"]), block=16))
    plain = mixing.mix(docs.dropDuplicates(["doc_id"]), block=16)
    assert mixed.columns == docs.columns
    assert sum(count(r.text) for r in mixed.collect()) == plain.docs.agg(F.sum("taken")).first()[0]
    assert mixing.mix(none).docs.count() == 0
    assert sum(plan.quotas.values()) * 16 == pytest.approx(total, abs=16 * 8)


def test_mix_many_small_sources_and_repeated_rows(spark):
    """Every source comes within a block of its target, runs fill their shards' quotas, and repeated rows keep to the plan."""
    say = lambda n, tag: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(i, say(50, "a"), "big", "k", 1) for i in range(100)] + [(1000 + i, say(5, "b"), f"s{i:03}", "k", 1) for i in range(200)] + [(3, say(50, "a"), "big", "k", 1)] * 7
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, `_run` string, `a.b` int").repartition(3)
    plan = mixing.mix(frame, shards=4)
    got = plan.docs.collect()
    per = defaultdict(lambda: [0.0, 0])
    for r in got:
        per[r.source][0] = r.target
        per[r.source][1] += r.taken
    assert len(per) == 201 and all(abs(t - n) <= 3 * plan.block and n > 0 for t, n in per.values())
    filled = Counter()
    for r in got:
        for x in r.runs:
            filled[x["shard"], r.source] += x["end"] - x["first"]
    for s in range(4):  # a run stands with its first block
        assert abs(filled[s, "big"] - plan.quotas[s, "big"] * plan.block) <= 2 * 50
    mixed = mixing.mixed_documents(frame, plan).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in got)
    assert {r["_run"] for r in mixed} == {"k"} and {r["a.b"] for r in mixed} == {1}


def test_targets_and_sainte_lague():
    assert mixing.targets(np.array([100, 100, 100]), np.array([5.0, 2.0, 1.0])).tolist() == pytest.approx([187.5, 75.0, 37.5])
    capped = mixing.targets(np.array([10, 100, 400, 0]), np.array([5.0, 2.0, 1.0, 5.0]))
    assert capped.tolist() == pytest.approx([30.0, 300.0, 180.0, 0.0])
    rng = np.random.default_rng(1)
    for _ in range(50):
        t = rng.integers(0, 60, 7).astype(float)
        seats = int(rng.integers(0, 90))
        brute = np.zeros(7, dtype=int)
        for _ in range(seats if t.sum() else 0):
            brute[np.argmax(t / (2 * brute + 1))] += 1
        assert mixing.sainte_lague(t, seats).sum() == (seats if t.sum() else 0)
        if len(set(t)) == 7:
            assert np.abs(mixing.sainte_lague(t, seats) - brute).sum() <= 2  # quotients may tie
    assert mixing.sainte_lague(np.full(5, 3.0), 12).tolist() == [3, 3, 2, 2, 2]


def test_shard(spark, docs, rows, none, tmp_path):
    path = str(tmp_path / "docs.parquet")
    docs.write.parquet(path)
    for frame, shards in ((spark.read.parquet(path), 4), (docs, 5), (spark.read.parquet(path).where("doc_id % 2 = 0"), 3)):
        out = sharding.shard(frame, shards, cell_rows=3).collect()
        n = frame.count()
        assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in frame.select("doc_id").collect())
        slots = defaultdict(list)
        for r in out:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == min(shards, n)
    one, two = ({(r.doc_id, r.shard, r.slot) for r in sharding.shard(spark.read.parquet(path), 4).collect()} for _ in range(2))
    assert one == two
    assert sharding.shard(none, 4).count() == 0


def test_communication_matrix_has_its_margins_and_is_uniform():
    rows, (size, shard, first) = np.array([5, 0, 17, 8]), sharding.layout(30, 4, 3)
    for seed in range(20):
        matrix = np.stack([sharding.matrix_row(rows, size, p, seed) for p in range(4)])
        assert matrix.sum(axis=1).tolist() == rows.tolist() and matrix.sum(axis=0).tolist() == size.tolist()
    mean = np.mean([sharding.matrix_row(rows, size, 2, s) for s in range(2000)], axis=0)
    assert np.allclose(mean, 17 * size / 30, atol=0.15)
    rng = np.random.default_rng(2)
    big = [sharding.hypergeometric(rng, 7 * 10**8, 3 * 10**9, 1000) for _ in range(300)]
    assert np.mean(big) == pytest.approx(1000 * 7 / 37, rel=0.02) and np.std(big) == pytest.approx(12.4, rel=0.2)


def test_toxicity(spark, docs, none):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    bad = ["vilword", "zorg", "zorgling", "zorgish", "snarkel", "muckpot"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 4) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, int(toxic)))
    labels += [(5000, 1), (None, 1), (7, None), (1, 0), (1, 0)]
    frame = spark.createDataFrame(rows + [(9000, None), (9001, ""), (9001, ""), (None, "zorg")], "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.score_toxicity(frame, table).collect()
    assert len(found) == 1204 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    got = {r.doc_id: r for r in found}
    test = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 8 == 0) for i in test]) > 0.97
    assert got[9000].score == got[9001].score < 0.5 and got[None].predicted == 1
    flipped = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(frame, flipped).collect()} == pytest.approx({r.doc_id: r.score for r in found})
    assert {r.score for r in toxicity.score_toxicity(docs, table.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, table).count() == 0


def test_chat(spark):
    turns = [(1, 0, "ann", "hello"), (1, 1, "bob", "hi\nthere"), (1, 2, "cy", None), (1, 3, "ann", ""), (1, 3, "ann", ""), (1, None, "bob", "last"), (2, 0, "system", "rules"), (None, 0, None, "x"), (None, 1, "dee", "é" * 50)]
    turns += [(3, i, f"p{i % 3}", "w" * (i % 7)) for i in range(300)]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("part", F.lit(1)).withColumn("block", F.lit(2))
    got = chat.perspectives(frame, part_chars=500).collect()
    want = defaultdict(list)
    for conv in (1, None, 3):
        mine = sorted({t[1:] for t in turns if t[0] == conv}, key=lambda t: (t[0] is None, t[0], t[1] or "", hashlib.md5((t[2] or "").encode()).digest()))
        for who in {t[1] for t in mine} - {None, "system"}:
            for _, speaker, text in mine:
                kind = "system" if speaker in (None, "system") else "assistant" if speaker == who else f"user name={speaker}"
                want[conv, who].append((kind, f"<|im_start|>{kind}\n{text or ''}<|im_end|>\n"))
    made = defaultdict(list)
    for r in sorted(got, key=lambda r: r.part):
        made[r.conv_id, r.perspective].append(r)
    assert set(made) == set(want)
    for key, parts in made.items():
        assert "".join(r.text for r in parts) == "".join(s for _, s in want[key])
        trained = [r.text[s["start"] : s["end"]] for r in parts for s in r.loss]
        assert trained == [s.split("\n", 1)[1] for kind, s in want[key] if kind == "assistant"]
        assert all(len(r.text) < 500 + 100 for r in parts)
    assert sum(r.n_rows for r in got if r.conv_id == 1 and r.perspective == "bob") == 6
    assert len(made[3, "p0"]) > 10
    assert chat.perspectives(frame.limit(0)).count() == 0
