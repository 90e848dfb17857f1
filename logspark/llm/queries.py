"""Registered queries of the package, with the SQL that must return the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logspark.llm import chat, decontaminate, divergence, exact_dedup, line_dedup, mixing, near_dedup, packing, secrets, sharding, substring, toxicity, vector_codes
from logspark.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER_SQL = f"translate(coalesce(text, ''), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"


@query("op2_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({LOWER_SQL}) AS h FROM documents),
         g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _spans_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s AS start, s + length(m) AS stop
        FROM (SELECT doc_id, m, v, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
              FROM (SELECT doc_id, unnest(gaps) AS gap, unnest(list_append(hits, '')) AS m, unnest(list_append(vals, '')) AS v, unnest(range(len(gaps))) AS i
                    FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals
                          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, '{pattern}')))
              WINDOW w AS (PARTITION BY doc_id ORDER BY i))
        WHERE length(v) >= {least}"""


_ANY_CASE = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"


@query("op7_secret_scan", f"""
    WITH hits AS ({_spans_sql("assign", 0, _ANY_CASE + '["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8)}
                  UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 16)}
                  UNION ALL {_spans_sql("hex", 2, "[0-9a-f]+", 0, 32)}),
         per AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
                        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans FROM hits GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents LEFT JOIN per USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_history(table(spark, sf_dir, "documents"), scratch_path(spark, "ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE]))
    return found.select(
        "doc_id", *[secrets.count_kind(F.col("spans"), r.kind).alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


@query("op1_decontaminate", r"""
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
         items AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
         wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
                  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
         sizes AS (SELECT DISTINCT n FROM wins),
         spots AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
                   FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
         hits AS (SELECT doc_id, s.n, i, item_id FROM spots s JOIN wins USING (n, win)),
         hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
         hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
                       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), decontaminate.digest(F.col("leak.items")).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


@query("op9_mix_sources")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.docs.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op4_shard")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


_LINE_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{exact_dedup.UPPER}', '{exact_dedup.LOWER}')"


@query("op3_line_dedup", f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
         keyed AS (SELECT doc_id, i, line, {_LINE_KEY} AS k FROM lines),
         firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
         marked AS (SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.col("sha256").alias("kept_sha256"))


@query("op10_substring_dedup", r"""
    WITH words AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
         spots AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
         firsts AS (SELECT win, min(doc_id) AS first FROM spots GROUP BY win HAVING count(DISTINCT doc_id) > 1),
         gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM spots JOIN firsts USING (win) WHERE doc_id > first),
         every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
         marked AS (SELECT e.doc_id, e.p, word, g.p IS NOT NULL AS removed FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p),
         per AS (SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS kept FROM marked GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM words LEFT JOIN per USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.drop_repeated_windows(table(spark, sf_dir, "documents"), n=13)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_chat_format", f"""
    WITH msgs AS (SELECT conv_id, turn, CASE WHEN role <> 'system' THEN role END AS speaker, coalesce(text, '') AS t, count(*) AS n FROM conversations GROUP BY ALL),
         who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM msgs WHERE speaker IS NOT NULL),
         each AS (SELECT m.conv_id, perspective, turn, speaker, n, coalesce(speaker = perspective, false) AS own, t || '<|im_end|>' || chr(10) AS body,
                         '<|im_start|>' || CASE WHEN speaker IS NULL THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) AS head
                  FROM msgs m JOIN who ON m.conv_id IS NOT DISTINCT FROM who.conv_id),
         placed AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker NULLS FIRST, head || body
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM each),
         parts AS (SELECT *, start // {chat.PART_CHARS} AS part, min(start) OVER (PARTITION BY conv_id, perspective, start // {chat.PART_CHARS}) AS base FROM placed)
    SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_messages, CAST(sum(n) AS BIGINT) AS n_rows, string_agg(head || body, '' ORDER BY start) AS text,
           coalesce(string_agg(CAST(CAST(start - base + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start - base + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY start) FILTER (WHERE own), '') AS loss_spans
    FROM parts GROUP BY conv_id, perspective, part""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("loss", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return made.withColumn("loss_spans", spans).drop("loss")


@query("op11_source_divergence", rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
         groups AS (SELECT DISTINCT lang, source FROM d),
         e AS (SELECT r, lang, source, unnest(w) AS term FROM d),
         kept AS (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
         langs AS (SELECT lang, count(*) AS v, sum(n) + count(*) AS whole FROM kept GROUP BY lang),
         c AS (SELECT lang, source, term, count(*) AS c FROM e JOIN kept USING (lang, term) GROUP BY lang, source, term),
         sums AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
         wholes AS (SELECT lang, source, coalesce(sums.n, 0) + v AS whole FROM groups JOIN langs USING (lang) LEFT JOIN sums USING (lang, source)),
         p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1) // CAST(whole AS HUGEINT) AS p
               FROM wholes JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
         q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // CAST(whole AS HUGEINT) AS q FROM kept JOIN langs USING (lang)),
         sides AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
                   FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
         pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
                   FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sides s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
         terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    WHERE part = 'pair' OR rank <= 200""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """Lloyd rounds spelled out, one after the other."""
    gap = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
    out = [f"""v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
                     FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
           f"""pieces AS (SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS p))""",
           f"""b0 AS (SELECT p, r - 1 AS e, x AS y FROM pieces WHERE r <= {entries})"""]
    for k in range(rounds + 1):
        out.append(f"a{k} AS (SELECT r, p, min(struct_pack(d := {gap}, e := e)) AS m FROM pieces JOIN b{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            out.append(f"""s{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT p, a{k}.m.e AS e, unnest(range(len(x))) AS i, unnest(x) AS c FROM pieces JOIN a{k} USING (r, p)) GROUP BY p, e, i)""")
            out.append(f"""n{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM s{k} GROUP BY p, e)""")
            out.append(f"b{k + 1} AS (SELECT p, e, coalesce(n{k}.y, b{k}.y) AS y FROM b{k} LEFT JOIN n{k} USING (p, e))")
    last = f"a{rounds}"
    return f"""WITH {', '.join(out)},
        coded AS (SELECT r, string_agg(printf('%02x', {last}.m.e), '' ORDER BY p) AS code, CAST(sum({last}.m.d) AS BIGINT) AS error FROM {last} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
        FROM coded JOIN v USING (r)"""


@query("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return made.rows.withColumn("codebooks_sha256", F.lit(made.digest()))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
