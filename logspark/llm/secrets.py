"""Secret scans over a ledger of content-addressed blobs. DataFrame functions only.

Every historical version of a file is named by the SHA-256 of its text. A blob is scanned once per
rule version; what was found is kept in the ledger and joined back to all paths that ever held it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logspark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates, leftmost and non-overlapping; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The kinds and patterns every scan must report, in the order ties are listed.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)

LEDGER = "blob binary, rules array<string>, spans array<struct<kind: string, start: int, end: int>>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> in code points, end exclusive.

    A run of gaps and matches alternates, so a match starts where the lengths before it end.
    """
    pattern = F.lit(rule.pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("span"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length).alias("value"),
    )
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["span"], F.lit(0))
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    every = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"])
    return F.when(F.regexp_like(text, pattern), every).otherwise(none)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan_history(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``versions``: path, ``blob`` (binary SHA-256), ``spans`` sorted by start, then by the order of ``rules``.

    ``ledger`` is a Parquet folder that all executors reach; it is created by the first scan and
    grows by one row per blob and scan. Only pairs of blob and rule version that it lacks are scanned,
    each in one version that holds the blob. A version with a new rule, or a rule with a new number,
    scans old blobs for that rule alone.

    Null text is the empty blob. Rows repeating a path are versions of it and all come back; a null
    path is a path like any other. An empty table gives no rows and leaves the ledger as it is.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    held = versions.select(F.col(path_col).alias("path"), blob.alias("blob"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    todo = held.groupBy("blob").agg(F.min("path").alias("holder"))
    if _exists(spark, ledger):
        known = spark.read.schema(LEDGER).parquet(ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("known"))
        todo = todo.join(known, "blob", "left").select("blob", "holder", F.array_except(keys, F.coalesce("known", F.array().cast("array<string>"))).alias("todo"))
    else:
        todo = todo.withColumn("todo", keys)
    todo = cut_lineage(todo.where(F.size("todo") > 0))
    texts = versions.select(F.col(path_col).alias("path"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    unseen = texts.join(todo.hint("shuffle_hash"), F.col("path").eqNullSafe(F.col("holder")) & (F.col("digest") == F.col("blob")))
    none = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    hits = F.concat(*[F.when(F.array_contains("todo", r.key), spans(F.col("text"), r)).otherwise(none) for r in rules])
    unseen.select("blob", F.col("todo").alias("rules"), hits.alias("spans")).write.mode("append").parquet(ledger)
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array_intersect("rules", keys)
    seen = spark.read.schema(LEDGER).parquet(ledger).where((F.size("spans") > 0) & (F.size(current) > 0))
    seen = seen.select("blob", F.filter("spans", lambda s: F.exists(current, lambda k: F.substring_index(k, "@", 1) == s["kind"])).alias("spans"))
    seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    seen = cut_lineage(seen.select("blob", F.transform(F.array_sort(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")))
    return held.join(seen, "blob", "left").select(F.col("path").alias(path_col), "blob", F.coalesce("spans", none).alias("spans"))


def spans_text(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
