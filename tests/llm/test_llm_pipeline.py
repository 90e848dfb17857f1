"""The pipeline stage by stage against brute force on the smallest tables."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from test_llm_corpus import brute_classes
from logspark.llm import queries
from logspark.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, f"test-{name}")
        stage(spark, docs, FOLDER).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_stages_and_columns(tables):
    names = list(tables)
    assert names == ["documents", "toxicity", "near_dedup", "decontaminate", "mix", "shard"]
    assert all(tables[n].columns == tables["documents"].columns for n in names[:-1])
    assert tables["shard"].columns == [*tables["documents"].columns, "shard", "slot"]
    for before, after in zip(names[:3], names[1:4]):  # filters: rows of the predecessor, untouched
        assert not Counter(tables[after].collect()) - Counter(tables[before].collect())


def test_toxic_go(spark, tables):
    scored = queries.QUERIES["op5_toxicity"](spark, FOLDER).collect()
    clean = {r.doc_id for r in scored if not r.predicted}
    assert {r.doc_id for r in tables["toxicity"].collect()} == clean


def test_one_of_each_class_stays(tables):
    rows = [(r.doc_id, r.text) for r in tables["toxicity"].collect()]
    assert Counter(r.doc_id for r in tables["near_dedup"].collect()) == Counter({c for c, _ in brute_classes(rows).values()})


def test_contaminated_go(spark, tables):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[min(10, len(w))].add(tuple(w[i : i + 10]))
    want = {r.doc_id for r in tables["near_dedup"].collect() if not any(tuple(w[i : i + n]) in held for w in [words(r.text)] for n, held in windows.items() for i in range(len(w) - n + 1))}
    assert {r.doc_id for r in tables["decontaminate"].collect()} == want


def test_mixture_meets_its_targets(tables):
    before, after = Counter(), Counter()
    for r in tables["decontaminate"].collect():
        before[r.source] += count(r.text)
    for r in tables["mix"].collect():
        after[r.source] += count(r.text)
        assert r.n_chars == len(r.text)
    order = sorted(before, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = sum(before.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * before[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * before[s] for s in over}
        open_ -= over
    assert all(abs(after[s] - target[s]) <= 2 * 64 for s in order)


def test_shards_hold_the_mixture(tables):
    rows = tables["shard"].collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in tables["mix"].collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
