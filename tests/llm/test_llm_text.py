"""Operators on texts against brute force over awkward documents."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from llm_fixtures import docs, none, rows  # noqa: F401
from logspark.llm import decontaminate, exact_dedup, line_dedup, secrets, substring
from logspark.session import scratch_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
least = lambda i: -(2**63) if i is None else i


def words(text):
    return WORD.findall((text or "").translate(LOW))


def bag(rows):
    return Counter(tuple(r) for r in rows)


def test_exact_copies(docs, rows, none):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOW)].append(r[0])
    keep = {t: max(ids, key=lambda i: (i is not None, i)) for t, ids in groups.items()}
    want = []
    for r in rows:
        t = (r[1] or "").translate(LOW)
        want.append((r[0], keep[t], len(groups[t]), r[0] == keep[t], bytes.fromhex(sha(t))))
    found = exact_dedup.find_copies(docs, digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "digest")
    assert Counter((*r[:4], bytes(r[4])) for r in found.collect()) == Counter(want)
    lazy = exact_dedup.find_copies(docs).collect()
    assert {r.digest is None for r in lazy if r.group_size > 1} == {False} and any(r.digest is None for r in lazy)
    assert exact_dedup.find_copies(none).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and len({(r.text or "").translate(LOW) for r in left.collect()}) == len(groups)


def test_lines(docs, rows, none):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(least(r[0]))
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == least(r[0])]
        want.append((r[0], len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    found = line_dedup.drop_repeated_lines(docs)
    assert bag(found.select("doc_id", "n_lines", "n_dropped", "sha256").collect()) == Counter(want)
    assert sum(w[2] for w in want) >= 4
    assert line_dedup.drop_repeated_lines(none).count() == 0


def test_windows(docs, rows, none):
    n, cut = 13, re.compile(r"[^\x20\x09-\x0D]+")
    first = {}
    for r in rows:
        w = cut.findall(r[1] or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, 2**63), least(r[0]))
    want = []
    for r in rows:
        w = cut.findall(r[1] or "")
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < least(r[0]) for j in range(i, i + n)}
        want.append((r[0], len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    found = substring.drop_repeated_windows(docs, n)
    assert bag(found.select("doc_id", "n_words", "n_removed", "kept").collect()) == Counter(want)
    assert sum(w[2] > 0 for w in want) >= 5
    assert substring.drop_repeated_windows(none).count() == 0


def test_overloaded_sketch_changes_nothing(docs, monkeypatch):
    want = bag(substring.drop_repeated_windows(docs).collect())
    lines = bag(line_dedup.drop_repeated_lines(docs).select("doc_id", "n_dropped", "n_lines").collect())
    from logspark.llm import sketch

    monkeypatch.setattr(sketch.Twice, "__call__", lambda self, hashes: hashes == hashes)  # everything is suspected
    assert bag(substring.drop_repeated_windows(docs).collect()) == want
    assert bag(line_dedup.drop_repeated_lines(docs).select("doc_id", "n_dropped", "n_lines").collect()) == lines


@pytest.mark.parametrize("max_chars", [32_000_000, 150])
def test_leaks(spark, docs, rows, none, max_chars):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(words(texts[4])[5:30])), (10, texts[4]), (2, "the very same"), (None, "licence, IN many"), (3, None), (4, ""), (5, "..."), (6, "nowhere at all to be found"), (2, "the very same")]
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k : k + 10])].add(i)
    want = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for k in range(len(w)):
            for size in {len(x) for x in wins}:
                if k + size <= len(w) and tuple(w[k : k + size]) in wins:
                    hit |= set(range(k, k + size))
                    found |= wins[tuple(w[k : k + size])]
        want.append((r[0], len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_leaks(docs, bench, max_chars=max_chars)
    got = [(r.doc_id, r.leak.n_words, r.leak["n_hit"], tuple(r.leak["items"])) for r in out.collect()]
    assert Counter(got) == Counter(want) and out.columns == [*docs.columns, "leak"]
    clean = {w[0] for w in want if not w[2]}
    kept = decontaminate.clean(docs, bench, max_chars=max_chars)
    assert {r.doc_id for r in kept.collect()} == clean and kept.columns == docs.columns
    cut = decontaminate.clean(docs, bench, drop=False, max_chars=max_chars).collect()
    assert len(cut) == len(rows) and not any("the very same line" in (r.text or "") for r in cut)
    assert {r.doc_id: r.text for r in cut if r.doc_id in clean} == {r[0]: r[1] for r in rows if r[0] in clean}
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("leak.n_hit > 0").count() == 0


RULES = [
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
]


def brute_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, n) in enumerate(RULES) for m in p.finditer(text or "") if len(m.group(g)) >= n]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_secrets_and_ledger(spark, docs, rows, none):
    ledger = scratch_path(spark, "ledger")
    got = secrets.scan_history(docs, ledger).collect()
    assert Counter((r.doc_id, tuple(tuple(s) for s in r.spans)) for r in got) == Counter((r[0], tuple(brute_spans(r[1]))) for r in rows)
    assert sum(len(r.spans) for r in got) >= 6
    blobs = spark.read.parquet(ledger).count()
    assert blobs == len({r[1] or "" for r in rows})
    more = docs.unionByName(spark.createDataFrame([(99, "token=abcdefgh99"), (0, "token=abcdefgh99")], "doc_id long, text string"), allowMissingColumns=True)
    again = secrets.scan_history(more, ledger).collect()  # two new paths, one new blob
    assert spark.read.parquet(ledger).count() == blobs + 1
    assert sorted(r.doc_id for r in again if r.spans and r.spans[0]["end"] == 16 and r.spans[0].start == 0) == [0, 99]
    rules = (*secrets.BASE, secrets.Rule("word", 1, "hunter[0-9]"))
    third = secrets.scan_history(more, ledger, rules).collect()
    assert sum(s["kind"] == "word" for r in third for s in r.spans) == 2
    scanned = [r.rules for r in spark.read.parquet(ledger).collect()]
    assert sum(x == ["word@1"] for x in scanned) == blobs + 1  # old blobs were scanned for the new rule alone
    assert secrets.scan_history(none, scratch_path(spark, "ledger")).count() == 0
