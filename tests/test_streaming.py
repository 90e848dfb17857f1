import re

import pytest
from pyspark.sql import functions as F

from logspark.functions.timing import at_ms
from logspark.operators.aggregate import extract_metrics
from logspark.operators.storage import read_stored
from logspark.operators.windows import suppress_repeats
from logspark.streaming import ingest as K, state as KS
from conftest import plan_of

ONCE = {"availableNow": True}


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_ingest_survives_a_repeated_batch(spark, frame, tmp_path):
    lines = [('{"service":"a","message":"m1","_tenant_id":"t1"}',), ("{broken",), ('{"service":"b","message":"m2"}',), ("[1]",)]
    frame(lines, "value string").repartition(2).write.text(str(tmp_path / "in"))
    finish(K.start_log_ingest(K.open_folder(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"), ONCE))
    stored = {(r.tenant_id, r.source, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stored == {("t1", "a", "m1"), ("default_tenant", "b", "m2")} and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    sink = K.idempotent_sink(str(tmp_path / "twice"))
    for _ in range(2):
        sink(frame([(1,), (2,)], "x int"), 5)
    sink(frame([(3,)], "x int"), 6)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "twice")).collect()) == [1, 2, 3]


def test_compacted_batches_hold_every_row_once(spark, frame, tmp_path, monkeypatch):
    """Lost before each of its moves and deletions in turn, the compaction is completed by the next call."""
    whole = {n: getattr(K.Files, n) for n in ("move", "delete")}

    def batches(inbox):
        sink = K.idempotent_sink(inbox)
        for i in (0, 1, 1, 2):
            rows = [(t, f"b{i}", d) for t in ("007", "a:b") for d in (1, 2)]
            sink(frame(rows, "tenant_id string, message string, d long").select("tenant_id", F.lit("s").alias("source"), "message", at_ms(F.col("d") * 86_400_000).alias("timestamp")), i)

    expected = sorted((t, f"b{i}") for i in (0, 1, 2) for t in ("007", "a:b") for _ in (1, 2))
    lost, done = 0, False
    while not done:
        inbox, table, left = str(tmp_path / f"in{lost}"), str(tmp_path / f"table{lost}"), [lost]
        batches(inbox)

        def failing(name):
            def run(self, *args):
                left[0] -= 1
                if left[0] < 0:
                    raise OSError("lost")
                return whole[name](self, *args)

            return run

        for name in whole:
            monkeypatch.setattr(K.Files, name, failing(name))
        try:
            K.compact_batches(spark, inbox, table)
            done = True
        except OSError:
            pass
        for name in whole:
            monkeypatch.setattr(K.Files, name, whole[name])
        K.compact_batches(spark, inbox, table)
        assert sorted((r.tenant_id, r.message) for r in read_stored(spark, table).collect()) == [x for x in expected if x[1] != "b2"]
        assert K.compact_batches(spark, inbox, table, through=2) == 1 and K.compact_batches(spark, inbox, table, through=2) == 0
        assert sorted((r.tenant_id, r.message) for r in read_stored(spark, table).collect()) == expected
        lost += 1
    assert lost > 7
    assert re.search(r"PartitionFilters: \[[^\]]*tenant_id", plan_of(read_stored(spark, table).where(F.col("tenant_id") == "007")))


def test_live_tail(frame):
    rows = [('{"level":"warn","service":"api-1","message":"x","_tenant_id":"t"}',), ('{"log":"an ERROR here"}',), ("plain error",), ('{"message":"' + "m" * 300 + '"}',)]
    out = [(r.tenant_id, r.level, r.service, len(r.message)) for r in K.live_tail(frame(rows, "value string")).collect()]
    assert out == [("t", "WARN", "api-1", 1), ("default_tenant", "ERROR", "api", 13), ("default_tenant", "ERROR", "unknown", 11), ("default_tenant", "INFO", "api", 300)]
    assert [r.service for r in K.live_tail(frame(rows, "value string"), level="warn", service="API").collect()] == ["api-1"]


def log_stream(spark, frame, tmp_path, batches):
    """One file per batch, read in this order."""
    import os
    import time

    schema = None
    for i, times in enumerate(batches):
        df = frame([(t,) for t in times], "t long").select(
            at_ms(F.col("t") * 1000).alias("timestamp"), F.lit("t").alias("tenant_id"), F.lit("s").alias("source"), F.lit("ERROR").alias("level"), F.lit("m").alias("message"), F.lit("{}").alias("raw_json"))
        part = tmp_path / f"part{i}"
        df.coalesce(1).write.parquet(str(part))
        (source,) = part.glob("*.parquet")
        target = tmp_path / "in" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(source.read_bytes())
        os.utime(target, (time.time() + i, time.time() + i))
        schema = df.schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_metrics_drop_and_count_late_rows(spark, frame, tmp_path):
    stream = log_stream(spark, frame, tmp_path, [[0, 10, 70], [5000, 5010], [5020], [20], [9000]])
    rules = [{"id": 1, "query": "level:ERROR", "window_seconds": 60}]
    late = KS.count_late_rows(spark)
    query = KS.stream_metrics(stream, rules, "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(**ONCE).start()
    finish(query)
    got = {r.bucket_ms: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the row at second 20 came two batches after its window was passed; the last window is still open
    assert got == {0: 2.0, 60_000: 1.0, 4_980_000: 3.0} and late.of(query) == 1
    spark.streams.removeListener(late)
    on_time = spark.read.parquet(str(tmp_path / "in")).where("unix_millis(timestamp) not in (20000, 9000000)")
    assert got == {r.bucket_ms: r.value for r in extract_metrics(on_time, rules).collect()}


def test_rules_by_width():
    rules = [{"id": 1, "window_seconds": 60, "query": "a"}, {"id": 2, "window_seconds": 5, "query": "b"}, {"id": 3, "query": "c"}, {"id": 4, "query": "d", "enabled": False}]
    assert {k: [r["id"] for r in v] for k, v in KS.rules_by_width(rules).items()} == {60: [1, 3], 5: [2]}
    with pytest.raises(ValueError):
        KS.stream_metrics(None, rules)


def test_suppression_over_batches(spark, frame, tmp_path):
    batches = [[0, 5, 9, 10], [11, 20, 31], [32, 41, 55, 55]]
    stream = log_stream(spark, frame, tmp_path, batches).select(F.lit("f").alias("fingerprint"), (F.unix_millis("timestamp") / 1000).cast("long").alias("ts_ms"))
    finish(KS.stream_alert_suppression(stream, 10).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(**ONCE).start())
    got = sorted(r.ts_ms for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = suppress_repeats(frame([("f", t) for b in batches for t in b], "fingerprint string, ts_ms long"), 10)
    assert got == sorted(r.ts_ms for r in batch.collect() if r.fired) == [0, 10, 20, 31, 41, 55]


@pytest.mark.parametrize("batches", [[[1, 6, 10, 11, 12, 21, 32, 33, 42, 56, 56, 500]], [[12, 33, 1], [11, 10, 56, 32], [6, 21, 42], [56, 500]]])
def test_held_suppression_does_not_depend_on_batches(spark, frame, tmp_path, batches):
    stream = log_stream(spark, frame, tmp_path, batches).select(F.lit("f").alias("fingerprint"), (F.unix_millis("timestamp") / 1000).cast("long").alias("ts_ms"))
    fired = KS.stream_alert_suppression(stream, 10, "100 milliseconds")
    finish(fired.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(**ONCE).start())
    assert sorted(r.ts_ms for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 11, 21, 32, 42, 56]


def test_idle_templates_leave_the_state(spark, frame, tmp_path):
    """A template is forgotten once the watermark is 100 s past its last row, and not before."""
    batches = [[1, 1, 2], [3, 90, 91], [1001, 95], [2, 3], [4000], [2003, 4003]]
    stream = log_stream(spark, frame, tmp_path, batches)
    named = (F.unix_millis("timestamp") / 1000).cast("long") % 10
    counts = KS.stream_template_counts(stream, F.concat(F.lit("t"), named.cast("string")), idle_ms=100_000, lateness="10 seconds")
    seen = {}
    note = lambda b, i: seen.update({(i, r.template): r.n for r in b.collect()})
    finish(counts.writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
    by_template = lambda t: [n for (_, x), n in sorted(seen.items()) if x == t]
    assert by_template("t1") == [2, 3, 4]  # 1, 1 | 91 | 1001
    assert by_template("t3")[-1] == 2  # 2003 and 4003: what came before was forgotten
    assert by_template("t0") == [1, 1]  # 90, forgotten when 4000 comes


def test_watch_directory(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one\n\ntwo\n")
    run = lambda: finish(K.watch_directory(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda b, i: seen.append(sorted(r.raw_text for r in b.collect()))))
    run()
    (tmp_path / "in" / "b.log").write_text("three\n")
    run()
    assert seen == [["one", "two"], ["three"]]
