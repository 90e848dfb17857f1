"""Source divergence, packing and vector codes against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, none, rows  # noqa: F401
from logspark.llm import divergence, packing, vector_codes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTER = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, top=200):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [LETTER.findall(t.translate(LOW)) for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        mine = [(s, w) for (_, l, s), w in zip(rows, words) if l == lang]
        often = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t, n in often.items() if n >= 3)
        count = defaultdict(Counter)
        for s, w in mine:
            count[s].update(t for t in w if t in often and often[t] >= 3)
        whole = sum(count.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        of = {s: p(count[s]) for s in {s for s, _ in mine}}
        q = p(whole)
        for s in of:
            pair = sorted(((-sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept), o.encode()) for o in of if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pair)}
            term = sorted((-((of[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if count[s][t] and of[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(term[:top])}
    return out


def test_divergence(spark, docs, rows, none, monkeypatch):
    found = divergence.source_divergence(docs, top=7)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in found.collect()} == brute_divergence([(r[1], r[2], r[3]) for r in rows], 7)
    assert divergence.source_divergence(none).count() == 0
    rng = random.Random(2)
    made = [(" ".join(f"w{rng.choice('abcdefg')}{rng.choice('xyz')}é" for _ in range(rng.randrange(40))) or None, rng.choice(["a", "B", None]), f"s{int(rng.random() ** 3 * 150)}") for _ in range(900)]
    made += [("only here", "lone", "x"), (None, "lone", "y"), ("1234 -- 5", None, "z")]
    monkeypatch.setattr(divergence, "SEGMENT", 5)
    frame = spark.createDataFrame([(t, l, s, 1, "clash") for t, l, s in made], "`te.xt` string, lang string, source string, n int, term string").repartition(4)
    got = [tuple(r) for r in divergence.source_divergence(frame, "te.xt").collect()]
    assert set(got) == brute_divergence(made) and len(got) == len(set(got))  # more sources than one block, several segments
    assert ("lone", "x", "pair", "y", 0, 1) in got


def test_shares_and_runs():
    for count, whole in ((0, 1), (5, 7), (10**12, 3 * 10**12 + 1), (8 * 10**15, 9 * 10**15 - 1)):
        assert divergence.share(np.array([count]), whole)[0] == 1 + 10**9 * (count + 1) // whole
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 3, 500), np.sort(rng.integers(0, 3, 500))
    p, q = divergence.share(a, 700), divergence.share(b, 900)
    (fa, ca), (fb, cb) = divergence.run_lengths(a), divergence.run_lengths(b)
    assert len(fb) == 3
    want = tuple(sum((int(x) - int(y)) ** 2 // int(y) for x, y in pairs) for pairs in (zip(p, q), zip(q, p)))
    assert divergence.divergence(fa, divergence.share(ca, 700), fb, divergence.share(cb, 900), 500) == want


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return str(public.path("byte_bpe_50k.json"))


@lru_cache
def _model(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def ids_of(vocabulary, text):
    return _model(vocabulary).encode(text or "", add_special_tokens=False).ids + [0]


def test_pack(spark, docs, rows, none, vocabulary):
    for capacity in (2048, 64):
        made = packing.pack(docs, vocabulary, capacity=capacity, keep_ids=True).cache()
        got = made.collect()
        by_doc = defaultdict(list)
        for r in got:
            assert 0 < r.length <= capacity and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
            by_doc[r.doc_id].append(r)
        texts = defaultdict(Counter)
        for r in rows:
            texts[r[0]][r[1]] += 1
        assert set(by_doc) == set(texts)
        for doc, held in texts.items():
            want = Counter()
            for text, n in held.items():
                ids = ids_of(vocabulary, text)
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    want[k, a, np.array(ids[a:b], dtype="<u4").tobytes()] += n
            assert Counter((r.piece, r.start, bytes(r.ids)) for r in by_doc[doc]) == want
        sequences = defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
        for parts in sequences.values():
            parts.sort()
            assert [o for o, _, _ in parts] == [0, *np.cumsum([n for _, n, _ in parts])[:-1].tolist()] and sum(n for _, n, _ in parts) <= capacity
        assert len(sequences) <= -(-sum(r.length for r in got) // capacity) + 1
        whole = {r.sequence_id: (r.ids, r.lengths) for r in packing.sequences(made).collect()}
        assert whole == {s: (np.frombuffer(b"".join(d for _, _, d in parts), "<u4").tolist(), [n for _, n, _ in parts]) for s, parts in sequences.items()}
    assert packing.pack(none, vocabulary).count() == 0


def test_words_encoded_apart_have_the_ids_of_the_whole(vocabulary):
    import pyarrow as pa

    texts = ["It's  a\tfew words, don't-they? x 1 2a  b\n\n c", " lead", "trail ", "é à la carte 日本 語 text", "<|endoftext|> a <|endoftext|>b", "", None, "a" * 3000, "tab\t x   y  z", "🙂 smile 🙂x y", "q  'll 'll x 'll"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab '1é\n\t.  ") for _ in range(200)) for _ in range(120)]
    encoder = packing.Encoder(vocabulary)
    for batch in (texts, texts[::-1]):  # new words, then known ones
        first, ids = encoder.encode(pa.array(batch, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(vocabulary, t)[:-1] for t in batch]


def test_repeated_words_stay_known(vocabulary, monkeypatch):
    """When the memory of words is full, those met again stay; ids are right and the memory bounded, also by a batch beyond it."""
    import pyarrow as pa

    monkeypatch.setattr(packing, "MEMORY", 100)
    encoder, learned = packing.Encoder(vocabulary), Counter()
    real = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: (learned.update(words.to_pylist()), real(words)))
    common = [f" common{chr(97 + i)}" for i in range(20)]
    for n in range(12):
        texts = ["x" + "".join(common), "".join(f" once{chr(97 + n)}{chr(97 + i)}" for i in range(25))]
        first, ids = encoder.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(vocabulary, t)[:-1] for t in texts]
        assert len(encoder.known) == len(encoder.first) - 1 <= 100
    assert [learned[w] for w in common] == [1] * 20
    texts = [" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)), "".join(common)]
    first, ids = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [ids_of(vocabulary, t)[:-1] for t in texts]


def placed(configs):
    out = Counter()
    for config, n in configs:
        assert n > 0
        for size, k in config:
            out[size] += k * n
    return out


def least_bins(demand, capacity):
    """A lower bound: large pieces need bins of their own, and what they leave open takes only so much of the rest."""
    out = -(-sum(s * n for s, n in demand.items()) // capacity)
    for a in range(1, capacity // 2 + 1):
        big = sum(n for s, n in demand.items() if s > capacity // 2)
        free = sum((capacity - s) * n for s, n in demand.items() if capacity // 2 < s <= capacity - a)
        rest = sum(s * n for s, n in demand.items() if a <= s <= capacity // 2)
        out = max(out, big + max(0, -(-(rest - free) // capacity)))
    return out


def test_configurations():
    assert packing.configurations({}, 10) == []
    for demand, capacity, best in (({10: 4}, 10, 4), ({6: 3, 4: 3}, 10, 3), ({1: 25}, 10, 3), ({7: 5, 5: 5, 3: 5}, 10, 8)):
        configs = packing.configurations(demand, capacity)
        assert placed(configs) == demand and all(sum(s * k for s, k in c) <= capacity for c, _ in configs)
        assert sum(n for _, n in configs) == best
    rng = np.random.default_rng(4)
    for n in (300, 30_000, 3_000_000_000):  # the work is bounded by lengths, not by pieces
        lengths, weight = np.arange(1, 257), rng.random(256) ** 3
        demand = {int(s): int(c) for s, c in zip(lengths, np.floor(n * weight / weight.sum())) if c}
        configs = packing.configurations(demand, 256, rounds=60)
        assert placed(configs) == demand and all(sum(s * k for s, k in c) <= 256 for c, _ in configs)
        bins = sum(n for _, n in configs)
        assert bins <= 1.005 * least_bins(demand, 256) + 2
        program = packing.linear_program(np.array(sorted(demand, reverse=True)), np.array([demand[s] for s in sorted(demand, reverse=True)], dtype=float), 256, 60)
        share = Counter()
        for config, x in program.items():
            for s, k in config:
                share[s] += k * x
        assert all(share[s] <= demand[s] * (1 + 1e-6) for s in demand)
        assert sum(s * x for s, x in share.items()) > 0.5 * sum(s * c for s, c in demand.items())  # the program places most


def test_knapsack_is_exact():
    rng = random.Random(8)
    for _ in range(30):
        length = np.array(rng.sample(range(1, 12), 4))
        value, most = np.array([rng.random() for _ in range(4)]), np.array([rng.randrange(4) for _ in range(4)])
        table = packing.Knapsack(length, value, most, 20)
        choices = [c for c in np.ndindex(*(most + 1)) if (c * length).sum() <= 20]
        best = max((c * value).sum() for c in choices)
        got = table.choice(20)
        assert sum(value[i] * k for i, k in got.items()) == pytest.approx(best) == pytest.approx(table.best[20])
        assert sum(length[i] * k for i, k in got.items()) <= 20 and all(k <= most[i] for i, k in got.items())


def brute_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label); plain loops over whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((gap(v[p * width : (p + 1) * width], e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                held[p, near(p, v)[1]].append(v[p * width : (p + 1) * width])
        for (p, k), members in held.items():
            books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = [(i, "".join(f"{near(p, v)[1]:02x}" for p in range(parts)), sum(near(p, v)[0] for p in range(parts)), label) for i, v, label in kept]
    total = Counter()
    for _, _, e, label in out:
        total[label] += e
    return Counter((i, c, e, total[label]) for i, c, e, label in out), books


def test_vector_codes(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(8)], i % 3 if i % 5 else None) for i in range(400)]
    rows += [(500 + i, list(rows[7][1]), 1) for i in range(150)]  # one vector many times
    rows += [(i, [round(x) * 0.5 for x in v], label) for i, v, label in ((1000 + i, rows[i][1], 2) for i in range(100))]  # many ties
    rows += [(2, None, 1), (-9, [None] + [0.0] * 7, 1), (-8, [float("nan")] * 8, 1), (-7, [float("inf")] + [0.0] * 7, None), (None, [1.0] * 8, None), (2000, rows[2][1], None)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    for entries, rounds in ((64, 2), (5, 3), (256, 1)):
        made = vector_codes.compress(frame, parts=4, entries=entries, rounds=rounds)
        want, books = brute_codes(rows, 4, entries, rounds)
        assert [b.tolist() for b in made.books] == books
        assert Counter(tuple(r) for r in made.rows.collect()) == want
        assert len(made.digest()) == 64
    few = vector_codes.compress(frame.where("vec_id < 3 AND vec_id >= 0"), parts=4)
    assert sorted(r.error for r in few.rows.collect()) == [0, 0, 0] and len(few.books[0]) == 3
    empty = vector_codes.compress(frame.limit(0))
    assert empty.rows.count() == 0 and empty.rows.columns == made.rows.columns and empty.books == []
    assert vector_codes.compress(frame.where("embedding IS NULL")).rows.count() == 0
    for bad in (spark.createDataFrame([(1, [1.0] * 6, 1)], frame.drop("code").schema), spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], frame.drop("code").schema), spark.createDataFrame([(1, [1e30] * 8, 1)], frame.drop("code").schema)):
        with pytest.raises(Exception, match="cannot be cut|too large"):
            vector_codes.compress(bad, parts=4)


def test_dual_tree_prunes():
    rng = np.random.default_rng(5)
    entries = rng.integers(-2000, 2000, (64, 2))
    points = np.concatenate([entries[rng.integers(0, 64, 4000)] + rng.integers(-30, 30, (4000, 2)), np.repeat(entries[:1], 2000, axis=0)])
    found = vector_codes.dual_tree(vector_codes.Tree.over(points, 16), entries)
    gap = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert found.code.tolist() == gap.argmin(axis=1).tolist() and found.error.tolist() == gap.min(axis=1).tolist()
    assert found.count.tolist() == np.bincount(found.code, minlength=64).tolist()
    assert all(found.sums[k].tolist() == points[found.code == k].sum(axis=0).tolist() for k in range(64))
    assert found.looked < 0.1 * gap.size  # most points are assigned by whole nodes or few entries
