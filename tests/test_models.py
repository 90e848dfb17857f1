import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logspark.operators import components as CC, drift as R, pivots, scoring as S, vectors as I
from logspark.plans.analysis import analyze, build_baseline, compare_runs, merge_baseline
from logspark.operators.pivots import VectorIndex, build_pivots, write_index
from logspark.operators.storage import baseline_annotate
from logspark.session import numbered
from conftest import plan_of

NOW = 1_779_000_000_000


def vec_frame(frame, matrix):
    return frame([(i, [float(x) for x in row]) for i, row in enumerate(matrix)], "id long, vector array<float>")


def blobs(sizes, seed=42, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = np.eye(len(sizes), 16)
    return np.vstack([c + rng.normal(0, spread, (n, 16)) for c, n in zip(centers, sizes)]).astype(np.float32)


# --- grouping ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(2))
def test_components(frame, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(40)] + [(0, i) for i in range(100, 130)] + [(200 + i, 201 + i) for i in range(20)]
    label = {n: n for e in edges for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.id: r.component for r in CC.connected_components(frame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in label.items() if n in got} and set(label) - set(got) <= {a for a, b in edges if a == b}


def brute_density(matrix, eps, min_samples, min_size):
    x = matrix.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    gap = 1 - x @ x.T
    close = (gap <= eps + 1e-12) & ~np.eye(len(x), dtype=bool)
    core = close.sum(1) + 1 >= min_samples
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = label.copy()
        for i in np.flatnonzero(core):
            near = np.flatnonzero(close[i] & core)
            new[i] = min([new[i], *label[near]])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(close[i] & core)
        if len(near):
            label[i] = label[min(near, key=lambda j: (round(gap[i, j], 12), j))]
    ids, counts = np.unique(label, return_counts=True)
    small = ids[counts < min_size]
    return np.where(np.isin(label, small), -1, label)


@pytest.mark.parametrize("tile", [1000, 13])
def test_density_clusters(frame, tile):
    rng = np.random.default_rng(1)
    matrix = np.vstack([blobs([30, 30]), rng.normal(0, 1, (15, 16)), blobs([3], seed=3) * [[-1] * 16]]).astype(np.float32)
    got = {r.id: r.label for r in I.density_clusters(vec_frame(frame, matrix), 0.1, 3, 5, tile_rows=tile).collect()}
    expected = brute_density(matrix, 0.1, 3, 5)
    assert [got[i] for i in range(len(matrix))] == expected.tolist() and len(set(expected) - {-1}) == 2 and -1 in expected


def test_cosine_groups(frame):
    matrix = np.vstack([blobs([6, 6]), np.zeros((1, 16))]).astype(np.float32)
    got = {r.id: r.label for r in I.cosine_groups(vec_frame(frame, matrix), 0.3, tile_rows=4).collect()}
    assert [got[i] for i in range(13)] == [0] * 6 + [6] * 6 + [12]


def test_forest_never_lists_all_pairs(frame):
    """200 equal vectors: 19 900 close pairs, but at most one edge per vector and tile."""
    same = vec_frame(frame, np.ones((200, 4), dtype=np.float32))
    assert I._forest(build_pivots(same, 64), 0.1).count() <= 200 * 7
    assert I.cosine_groups(same, 0.1, tile_rows=64).select("label").distinct().count() == 1


def directions(n, groups, dim=24, seed=2):
    """n unit vectors round ``groups`` directions."""
    rng = np.random.default_rng(seed)
    center = rng.normal(0, 1, (groups, dim))
    x = center[rng.integers(0, groups, n)] + rng.normal(0, 0.05, (n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_pivot_blocks_are_bounded_and_lose_no_pair(frame):
    matrix = np.vstack([directions(300, 12), np.repeat(directions(1, 1), 200, axis=0), np.zeros((3, 24))]).astype(np.float32)
    rows = vec_frame(frame, matrix)
    for metric, reach in (("cosine", 0.05), ("l2", 0.4), ("cosine", 1.0)):
        index = build_pivots(rows, 32, metric)
        held = {r.id: r.block for r in index.rows.select("id", "block").collect()}
        assert len(held) == 503 and max(Counter(held.values()).values()) <= 60
        met = {(r.low, r.high) for r in index.pairs(reach).collect()}
        x = matrix.astype(np.float64)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            gap = 1 - x @ x.T
        else:
            gap = np.linalg.norm(x[:, None] - x[None], axis=2)
        for i, j in zip(*np.nonzero(np.triu(gap <= reach, 1))):
            assert (min(held[i], held[j]), max(held[i], held[j])) in met
        every = len(index.blocks) * (len(index.blocks) + 1) // 2
        assert len(met) <= every and (reach >= 1 or len(met) < 0.5 * every)  # the copies of one vector fill blocks that must all meet


def test_compared_blocks_grow_with_the_rows_not_their_square(frame):
    """Templates that come in groups: four times as many make far fewer than sixteen times the pairs."""
    few, many = (build_pivots(vec_frame(frame, directions(n, n // 25)), 20).pairs(0.02).count() for n in (250, 1000))
    assert many < 8 * few


def test_inverted_file_is_exact_and_reads_part(frame, tmp_path, spark):
    matrix = np.vstack([directions(900, 30), np.zeros((2, 24))]).astype(np.float32)
    rows = vec_frame(frame, matrix).withColumn("template", F.concat(F.lit("t"), F.col("id").cast("string")))
    asked = [(int(i), [float(v) for v in matrix[i]]) for i in range(0, 900, 50)]
    for metric in ("cosine", "l2"):
        path = str(tmp_path / metric)
        write_index(rows, path, 24, metric)
        index = VectorIndex(spark, path)
        order = lambda df: sorted((r.query_id, r.rank, r.id, r.template, round(r.distance, 7)) for r in df.collect())
        one = asked[:1]
        assert order(index.search(one, 4)) == order(I.semantic_search_many(rows, one, 4, metric))
        assert 0 < index.read < len(index.blocks) / 2
        edge = [*asked, (10_000, [0.0] * 24), (10_001, [1.0] + [0.0] * 23)]
        assert order(index.search(edge, 4)) == order(I.semantic_search_many(rows, edge, 4, metric))
        assert len(index.search(one, 2000).collect()) == 902 and index.search([], 3).count() == 0
    write_index(rows.limit(0), str(tmp_path / "none"))
    assert VectorIndex(spark, str(tmp_path / "none")).search(asked, 3).count() == 0


# --- nearest ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_paths_agree(frame, metric):
    vectors, centers = vec_frame(frame, blobs([20, 20, 20])), vec_frame(frame, blobs([9, 9], seed=7, spread=0.5)).withColumnRenamed("id", "cluster_id")
    order = lambda df: [(r.id, r.nearest_id, round(r.distance, 9)) for r in df.orderBy("id").collect()]
    small = order(I.nearest_centroid(vectors, centers, metric))
    large = order(I.nearest_centroid(vectors, centers, metric, broadcast_limit=5))
    sql = vectors.crossJoin(centers.select("cluster_id", F.col("vector").alias("c"))).withColumn("d", F.round(I.distance(F.col("vector"), F.col("c"), metric), 9))
    brute = [(r.id, r.b.cluster_id, r.b.d) for r in sql.groupBy("id").agg(F.min_by(F.struct("cluster_id", "d"), F.struct("d", "cluster_id")).alias("b")).orderBy("id").collect()]
    assert small == large == brute


def test_scores_and_presets(frame):
    vectors = vec_frame(frame, [[1, 0], [0, 1], [1, 1]]).withColumn("template", F.concat(F.lit("t"), F.col("id").cast("string")))
    base = frame([(5, [1.0, 0.0], "known")], "cluster_id int, vector array<double>, representative_template string")
    got = {r.template: (round(r.distance, 6), r.label, r.nearest_template) for r in I.score_anomalies(vectors, base).collect()}
    assert got == {"t0": (0.0, "known", "known"), "t1": (1.0, "high_risk_anomaly", "known"), "t2": (0.292893, "known", "known")}
    assert {r.label for r in I.score_anomalies(vectors, base.limit(0)).collect()} == {"high_risk_anomaly"}
    levels = frame([(d,) for d in (0.39, 0.40, 0.55, 0.70)], "d double").select(I.classify_distance(F.col("d"), "security").alias("l")).collect()
    assert [r.l for r in levels] == ["known", "rare_known", "new_pattern", "high_risk_anomaly"]


def test_search_is_top_k(frame):
    vectors = vec_frame(frame, blobs([5, 5])).withColumn("template", F.lit("t"))
    assert "TakeOrderedAndProject" in plan_of(I.semantic_search(vectors, [1.0] + [0.0] * 15, 3))
    assert {r.id for r in I.semantic_search(vectors, [1.0] + [0.0] * 15, 5).collect()} == set(range(5))


def test_embedding_similarity(frame):
    texts = ["user <NUMBER> logged in", "user <NUMBER> logged out", "kernel panic at <HEX>", "user <NUMBER> logged in"]
    v = I.embed_templates(frame([(t,) for t in texts], "template string"), 128).collect()
    assert len(v) == 3
    by = {r.template: np.array(r.vector) for r in v}
    assert by[texts[0]] @ by[texts[1]] > by[texts[0]] @ by[texts[2]] and abs(np.linalg.norm(by[texts[2]]) - 1) < 1e-5


def test_projection(frame):
    v = vec_frame(frame, blobs([60, 5])).withColumn("label", (F.col("id") >= 60).cast("int"))
    rows = I.project_2d(v, n=50).collect()
    assert len(rows) == 55 and all(math.isfinite(r.x) and math.isfinite(r.y) for r in rows)


# --- severity ---------------------------------------------------------------------------------------

CLUSTER = "cluster_id int, size long, representative_template string, representative_raw string"


def score(frame, cluster, anomaly=None, services=0, others=999):
    clusters = frame([cluster, (999, others, "zzz", "zzz")], CLUSTER)
    anomalies = frame([(cluster[2], *anomaly)], "template string, distance double, label string") if anomaly else None
    links = frame([(cluster[0], f"s{i}") for i in range(services)], "source_cluster_id int, target_service string") if services else None
    return S.severity(clusters, anomalies, links).where(F.col("cluster_id") == cluster[0]).first()


def test_severity_bands(frame):
    assert score(frame, (1, 1, "ok", "ok"), (0.1, "known")).priority == "P3"
    assert score(frame, (1, 100, "ok", "ok"), (0.7, "new_pattern"), others=900).priority == "P2"
    assert score(frame, (1, 900, "error", "error"), (0.95, "high_risk_anomaly"), 2, others=100).priority == "P1"
    for word in ("crash", "oom-kill", "out of memory", "segfault", "kernel panic", "deadlock", "data loss", "fatal"):
        r = score(frame, (1, 1, f"got {word}", "x"), (0.1, "known"))
        assert (r.priority, r.composite_score, r.keyword_flag) == ("P0", 0.8, True)


def test_severity_parts(frame):
    plain, noise = score(frame, (1, 10, "ok", "ok")), score(frame, (-1, 10, "ok", "ok"))
    assert round(noise.composite_score - plain.composite_score, 4) == 0.10 and noise.is_noise_cluster and plain.breakdown.anomaly == 0.175
    wide = score(frame, (1, 10, "ok", "ok"), services=4)
    assert round(wide.composite_score - plain.composite_score, 4) == 0.1 and wide.breakdown.causal == 0.1
    r = score(frame, (1, 10, "Connection refused to upstream", "x"), (0.8, "new_pattern"), 3)
    assert r.p1_keyword_flag and not r.keyword_flag and abs(sum(r.breakdown) - r.composite_score) < 2e-4


def test_blocks_are_held_in_turns(frame, monkeypatch):
    """Few vectors held at a time: the same clusters; what a task finds is merged, not kept per pair of blocks."""
    x = blobs([30, 30, 2])
    want = {r.id: r.label for r in I.density_clusters(vec_frame(frame, x), 0.3, 3, 5).collect()}
    monkeypatch.setattr(pivots, "HELD_BYTES", 16 * 8 * 24)
    assert {r.id: r.label for r in I.density_clusters(vec_frame(frame, x), 0.3, 3, 5, tile_rows=8).collect()} == want
    monkeypatch.undo()
    edges = I._forest(build_pivots(vec_frame(frame, np.ones((600, 4), dtype=np.float32)), 8), 0.1)
    assert 599 <= edges.distinct().count() and edges.count() <= 600 * 8 * 4


# --- drift ------------------------------------------------------------------------------------------

SNAP = "ord int, cluster_id int, template string, size long, anomaly_score double, priority string"


def one(frame, template="db connection timeout", size=100, score=0.2, priority="P2"):
    return frame([(1, 1, template, size, score, priority)], SNAP)


@pytest.mark.parametrize("after, kind, severity", [
    ({}, "stable", "LOW"), ({"priority": "P0"}, "escalated", "CRITICAL"), ({"priority": "P1"}, "escalated", "HIGH"), ({"priority": "P3"}, "de_escalated", "LOW"),
    ({"size": 150}, "volume_surge", "MEDIUM"), ({"size": 50}, "volume_drop", "LOW"), ({"score": 0.36}, "anomaly_spike", "HIGH"),
])
def test_drift_kinds(frame, after, kind, severity):
    a, b = one(frame), one(frame, **after)
    (e,) = R.drift_events(R.drift_pairs(a, b), a, b).collect()
    assert (e.kind, e.severity) == (kind, severity)


def test_emerged_and_resolved(frame):
    a, b = one(frame, "alpha beta"), one(frame, "gamma delta", priority="P1")
    events = R.drift_events(R.drift_pairs(a, b), a, b)
    assert [(e.kind, e.severity, e.priority_before, e.priority_after) for e in events.collect()] == [("emerged", "HIGH", "none", "P1"), ("resolved", "LOW", "P2", "resolved")]
    report = R.drift_report(events, a, b, "r1", "r2").first()
    assert (report.emerged, report.resolved, report.matched_pairs) == (1, 1, 0)
    assert report.summary.startswith("r1 -> r2: health worse (-0.17).") and "New: 1." in report.summary


def test_health(frame):
    assert R.health_score(one(frame, score=0.0, priority="P3")).first().health == 1.0
    assert R.health_score(one(frame, score=1.0, priority="P0")).first().health == 0.0
    assert R.health_score(one(frame, score=0.0, priority="unknown")).first().health == 1.0
    assert R.health_score(one(frame).limit(0)).first().health == 1.0


def jaccard(a, b):
    a, b = (set(re.findall("[a-z0-9]+", x.lower())) for x in (a, b))
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("seed", range(4))
def test_drift_matching_is_the_sequential_one(frame, seed):
    rnd = random.Random(seed)
    words = ["the", "of", *[f"w{i}" for i in range(14)]]
    make = lambda n: [(i, i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 4, 6, 9]))), 1, 0.0, "P3") for i in range(n)]
    a, b = make(40), make(45)
    free, expected = set(range(45)), {}
    for i, _, ta, *_ in a:
        best, at = 0.40, None
        for j, _, tb, *_ in b:
            if j in free and jaccard(ta, tb) > best:
                best, at = jaccard(ta, tb), j
        if at is not None:
            expected[i] = at
            free.discard(at)
    fa, fb = frame(a, SNAP), frame(b, SNAP)
    assert {(r.ord_a, r.ord_b) for r in R.drift_candidates(fa, fb).collect()} == {(x[0], y[0]) for x in a for y in b if jaccard(x[2], y[2]) > 0.40}
    assert {r.ord_a: r.ord_b for r in R.drift_pairs(fa, fb).collect()} == expected


def sequential(a, b):
    free, out = {j for j, *_ in b}, {}
    for i, _, ta, *_ in a:
        sims = [(-jaccard(ta, tb), j) for j, _, tb, *_ in b if j in free and jaccard(ta, tb) > 0.40]
        if sims:
            out[i] = min(sims)[1]
            free.discard(out[i])
    return out


def rounds_of(monkeypatch, call):
    """The result of ``call`` and how often it cut the lineage."""
    calls, cut = [], R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: calls.append(1) or cut(df))
    return call(), len(calls)


@pytest.mark.parametrize("seed, block", [(0, 1 << 16), (1, 7), (2, 1 << 16), (3, 5)])
def test_drift_matching_of_crowded_classes(frame, monkeypatch, seed, block):
    """Few token sets with many templates each, equal similarities, interleaved ords, short blocks."""
    monkeypatch.setattr(R, "BLOCK", block)
    rnd = random.Random(seed)
    sets = ["", "a b c", "a b d", "a b c d", "a c d e", "b c"]
    make = lambda n: [(i, i, "-".join(rnd.sample(t := rnd.choice(sets).split(), len(t))), 1, 0.0, "P3") for i in range(n)]
    a, b = make(48), make(40)
    assert {r.ord_a: r.ord_b for r in R.drift_pairs(frame(a, SNAP), frame(b, SNAP)).collect()} == sequential(a, b)


def test_drift_rounds_do_not_grow_with_equal_templates(frame, monkeypatch):
    """Two A classes take turns on one B class and, when it is full, on a less similar one."""
    def cuts_of(n):
        a = [(i, i, f"{'x' if i % 2 else 'y'} p q r s t", 1, 0.0, "P3") for i in range(2 * n)]
        b = [(i, i, "p q r s t", 1, 0.0, "P3") for i in range(n)] + [(n + i, n + i, "p q r s", 1, 0.0, "P3") for i in range(n)]
        got, cuts = rounds_of(monkeypatch, lambda: {r.ord_a: r.ord_b for r in R.drift_pairs(frame(a, SNAP), frame(b, SNAP)).collect()})
        monkeypatch.undo()
        assert got == sequential(a, b)
        return cuts

    assert cuts_of(4) == cuts_of(24)


def test_drift_work_does_not_grow_with_chains(frame, monkeypatch):
    """Every A pushes the next one off its B: the matching is found without a round for each."""
    def cuts_of(n):
        own = [" ".join(f"b{i}w{j}" for j in range(5)) for i in range(n)]
        a = [(i, i, own[i] if i == 0 else f"{own[i - 1]} {own[i]}", 1, 0.0, "P3") for i in range(n)]
        b = [(i, i, own[i], 1, 0.0, "P3") for i in range(n)]
        got, cuts = rounds_of(monkeypatch, lambda: {r.ord_a: r.ord_b for r in R.drift_pairs(frame(a, SNAP), frame(b, SNAP)).collect()})
        monkeypatch.undo()
        assert got == sequential(a, b) == {i: i for i in range(n)}
        return cuts

    assert cuts_of(4) == cuts_of(16)


def test_numbered(frame):
    rows = [(i % 2, (i * 7) % 5, f"t{i * 11 % 40:02d}") for i in range(40)]
    got = {tuple(r)[:3]: r.rank for r in numbered(frame(rows, "k int, n int, t string"), "rank", ["k"], [F.col("n").desc(), F.col("t")]).collect()}
    want = {r: i + 1 for k in (0, 1) for i, r in enumerate(sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2])))}
    assert got == want


def test_drift_pairs_of_nothing(frame):
    empty, null = frame([], SNAP), frame([(1, 1, None, 1, 0.0, "P3")], SNAP)
    some = frame([(1, 1, "a b", 1, 0.0, "P3")], SNAP)
    assert R.drift_pairs(empty, some).count() == R.drift_pairs(some, empty).count() == R.drift_pairs(null, some).count() == R.drift_pairs(null, null).count() == 0


# --- compositions -----------------------------------------------------------------------------------


def raw_lines(frame):
    text = []
    for i in range(20):
        stamp = f"2026-05-10T10:{i:02d}:00"
        text += [(f"{stamp}.000Z ERROR connection refused for user {i} password=x{i}", "f", 3 * i, "api"), (f"{stamp}.050Z WARN query slow after {i} ms", "f", 3 * i + 1, "db")]
        text += [(f"{stamp}.700Z INFO page rendered ok", "f", 3 * i + 2, "web")]
    text += [("2026-05-10T11:00:00Z FATAL kernel panic on node 7", "f", 90, "node")]
    return frame(text, "raw_text string, source string, line_number long, source_label string")


def test_analyze(frame):
    lines = raw_lines(frame)
    rows, meta = build_baseline(lines.where("raw_text not like '%panic%'"), NOW)
    assert meta.first().logs_processed == 60
    points = frame([(1_778_407_200_000 + i * 1000, 50.0 + i) for i in range(5)], "timestamp long, cpu_percent double").select("*", *[F.lit(1.0).alias(c) for c in ("memory_percent", "disk_iops", "network_drops", "network_errors")])
    done = analyze(lines, NOW, baseline=rows, telemetry=points, run_id="r9")
    summary = done.summary.first()
    assert (summary.raw_lines, summary.templates) == (61, 4) and done.clusters.agg(F.sum("size")).first()[0] == 61
    assert not any("password=x" in r.representative_raw for r in done.clusters.collect())
    panic = done.clusters.where("representative_raw like '%panic%'").first()
    assert (panic.priority, panic.anomaly_label) == ("P0", "high_risk_anomaly")
    link = done.links.first()
    assert (link.source_service, link.target_service, link.avg_delay_ms, link.occurrences) == ("api", "db", 50.0, 20)
    assert done.incident.first().run_id == "r9" and done.incident.first().summary == "4 clusters in 61 lines"
    status = {r.cluster_id: r.status for r in done.telemetry.collect()}
    assert set(status.values()) <= {"correlated", "no_data_in_window", "skipped_non_incident", "skipped_noise"} and len(status) == done.clusters.count()


def test_a_known_template_is_known_in_any_run(frame):
    lines = raw_lines(frame)
    rows, _ = build_baseline(lines, NOW)
    for part in ("rendered", "panic", "slow"):
        found = analyze(lines.where(f"raw_text like '%{part}%'"), NOW, baseline=rows).anomalies.collect()
        assert [(r.label, round(r.distance, 6)) for r in found] == [("known", 0.0)]


@pytest.mark.parametrize("n", [50, 51])
def test_groups_do_not_change_with_the_number_of_templates(frame, n):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    lines = frame([(f"ERROR {words[i]} {words[i - 1]}x stopped {words[-i]}y", "f", i, "api") for i in range(1, n + 1)], "raw_text string, source string, line_number long, source_label string")
    labels = {r.representative_raw: r["size"] for r in analyze(lines, NOW).clusters.collect()}
    assert sum(labels.values()) == n and all(r.cluster_id >= 0 for r in analyze(lines, NOW).clusters.collect())


def test_analyze_does_not_depend_on_partitioning(frame):
    pick = lambda lines: sorted((r.size, r.representative_template, r.priority) for r in analyze(lines, NOW).clusters.collect())
    assert pick(raw_lines(frame)) == pick(raw_lines(frame).repartition(7))


def test_compare_runs(frame):
    a = analyze(raw_lines(frame).where("raw_text not like '%panic%'"), NOW).clusters
    b = analyze(raw_lines(frame).where("raw_text not like '%rendered%'"), NOW).clusters
    events, report = compare_runs(a, b, "1", "2")
    r = report.first()
    assert (r.emerged, r.resolved, r.matched_pairs) == (1, 1, 2) and events.count() == 4


BASE = "cluster_id int, vector array<double>, size long, representative_template string, representative_raw string, label string, is_acknowledged boolean"


def test_baseline_upkeep(frame):
    base = frame([(0, [1.0, 0.0], 3, "a", "ra", "good", True), (1, [0.0, 1.0], 1, "b", "rb", None, False)], BASE)
    updates = frame([(0, "", None), (1, "new", True)], "cluster_id int, label string, is_acknowledged boolean")
    assert [(r.label, r.is_acknowledged) for r in baseline_annotate(base, updates).orderBy("cluster_id").collect()] == [(None, True), ("new", True)]
    incoming = frame([(7, [1.0, 0.2], 1, "a2", "r"), (8, [-1.0, -1.0], 5, "c", "rc"), (-1, [9.0, 9.0], 5, "n", "n")], "cluster_id int, vector array<double>, size long, representative_template string, representative_raw string")
    got = {r.cluster_id: ([round(x, 6) for x in r.vector], r["size"], r.label) for r in merge_baseline(base, incoming).collect()}
    assert got == {0: ([1.0, 0.05], 4, "good"), 1: ([0.0, 1.0], 1, None), 2: ([-1.0, -1.0], 5, None)}
