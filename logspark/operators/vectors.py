"""Embedding, grouping, centroids, anomaly distance and nearest-template search.

Distances are ``cosine`` (1 - similarity) or ``l2``. Two sizes matter: the number of distinct
templates (thousands of times smaller than the logs) and the number of baseline centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from logspark.operators.components import connected_components
from logspark.operators.pivots import PivotIndex, build_pivots
from logspark.session import cut_lineage

# Cluster size, core size and anomaly thresholds per analysis mode.
PRESETS = {
    "general": {"min_cluster_size": 5, "min_samples": 3, "low": 0.55, "medium": 0.70, "high": 0.85},
    "security": {"min_cluster_size": 3, "min_samples": 2, "low": 0.40, "medium": 0.55, "high": 0.70},
    "performance": {"min_cluster_size": 10, "min_samples": 5, "low": 0.60, "medium": 0.75, "high": 0.90},
}
# Largest set of centroids sent to every task, in bytes of float64.
BROADCAST_BYTES = 64 << 20
MERGED = 1 << 20  # edges after which a task reduces them to a spanning forest


def embed_templates(templates: DataFrame, dim: int = 256, column: str = "template") -> DataFrame:
    """Distinct templates -> unit vectors: signed token counts hashed into ``dim`` places.

    A vector depends on its text alone, so vectors of different runs and of a stored baseline compare.
    Place and sign of a token come from its MD5; placeholders, which stand for what varies, weigh a
    quarter of a word. A text without tokens is the zero vector.
    """
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit("([a-z0-9]+|<[a-z_]+>)"), F.lit(1))


    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        known: dict[str, tuple[int, float]] = {}

        def place(token: str) -> tuple[int, float]:
            if token not in known:
                if len(known) > 1_000_000:
                    known.clear()
                digest = hashlib.md5(token.encode()).hexdigest()
                known[token] = int(digest[:8], 16) % dim, (0.25 if token[0] == "<" else 1.0) * (1 if int(digest[8], 16) % 2 == 0 else -1)
            return known[token]

        for batch in batches:
            out = []
            for tokens in batch:
                vector = np.zeros(dim)
                for i, sign in map(place, tokens):
                    vector[i] += sign
                norm = np.linalg.norm(vector)
                out.append((vector / norm if norm else vector).astype(np.float32))
            yield pd.Series(out)

    return templates.select(column).distinct().select(column, embed(words).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x))


# --- grouping ----------------------------------------------------------------------------------


def _close_rows(pdf, eps):
    """Ids and boolean closeness matrix of one pair of blocks (within cosine distance eps)."""
    import numpy as np

    pdf = pdf.sort_values("id")
    x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    gap = 1.0 - x @ x.T
    close = gap <= eps + 1e-12
    low, high = pdf["low"].iloc[0], pdf["high"].iloc[0]
    if low != high:
        own = pdf["own"].to_numpy()
        close &= own[:, None] != own[None, :]
    np.fill_diagonal(close, False)
    return pdf, gap, close


def _label_local(close):
    """Smallest reachable row index per row of a symmetric closeness matrix."""
    import numpy as np

    size = len(close)
    label = np.arange(size)
    while True:
        reached = np.where(close, label[None, :], size).min(axis=1, initial=size)
        new = np.minimum(label, reached)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _degrees(index: PivotIndex, eps: float) -> DataFrame:
    close_rows = _close_rows

    def count(pdf):
        import pandas as pd

        pdf, _, close = close_rows(pdf, eps)
        return pd.DataFrame({"id": pdf["id"].to_numpy(), "near": close.sum(axis=1)})

    total = lambda df: df.groupBy("id").agg(F.sum("near").alias("near"))
    return total(index.compared(eps, count, "id long, near long", combine=total))


def _roots(a, b):
    """The nodes of edges and the smallest node that each reaches."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label != label[label]).any():
            label = label[label]


def _forest(index: PivotIndex, eps: float, rows: DataFrame | None = None) -> DataFrame:
    """Edges that span the components of what a task compares: at most one per vector it holds, never all pairs."""
    close_rows, label_local, roots = _close_rows, _label_local, _roots

    def span(pdf):
        import pandas as pd

        pdf, _, close = close_rows(pdf, eps)
        ids = pdf["id"].to_numpy()
        label = label_local(close)
        return pd.DataFrame({"a": ids, "b": ids[label]}).query("a != b")

    def merge(parts):
        import pandas as pd

        held, new, size = [], [], 0

        def spanning():
            nodes, root = roots(*(pd.concat([*held, *new])[c].to_numpy() for c in "ab"))
            return pd.DataFrame({"a": nodes, "b": root}).query("a != b")

        for part in parts:
            new.append(part)
            size += len(part)
            if size >= MERGED:
                held, new, size = [spanning()], [], 0
        if held or size:
            yield spanning()

    return index.compared(eps, span, "a long, b long", rows, merge)


def _borders(index: PivotIndex, marked: DataFrame, eps: float) -> DataFrame:
    """Nearest core within eps of every non-core vector (``core`` column), lowest id on ties."""
    close_rows = _close_rows

    def nearest(pdf):
        import numpy as np
        import pandas as pd

        pdf, gap, close = close_rows(pdf, eps)
        ids, core = pdf["id"].to_numpy(), pdf["core"].to_numpy().astype(bool)
        gap = np.where(close & core[None, :], np.round(gap, 12), np.inf)
        if not len(ids):
            return pd.DataFrame(columns=["id", "gap", "core_id"])
        best = gap.argmin(axis=1)
        at = gap[np.arange(len(ids)), best]
        keep = ~core & np.isfinite(at)
        return pd.DataFrame({"id": ids[keep], "gap": at[keep], "core_id": ids[best][keep]})

    least = lambda df: df.groupBy("id").agg(F.min(F.struct("gap", "core_id")).alias("_b")).select("id", "_b.gap", "_b.core_id")
    return least(index.compared(eps, nearest, "id long, gap double, core_id long", marked, combine=least)).select("id", "core_id")


def cosine_groups(vectors: DataFrame, threshold: float = 0.3, tile_rows: int = 1024) -> DataFrame:
    """``id, vector`` -> ``id, label``: components of the graph of pairs within ``threshold``.

    Single linkage, label = smallest member id, no noise. Exact: blocks of at most some ``tile_rows`` vectors are
    compared unless their pivots and rings put them further apart (``PivotIndex.pairs``).
    """
    index = build_pivots(vectors.select("id", "vector"), tile_rows)
    found = connected_components(_forest(index, threshold))
    return vectors.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def density_clusters(
    vectors: DataFrame, eps: float, min_samples: int = 3, min_cluster_size: int = 5, tile_rows: int = 1024
) -> DataFrame:
    """``id, vector`` -> ``id, label`` (-1 = noise): DBSCAN at one eps, small clusters dropped. Exact.

    Core = at least ``min_samples`` vectors within eps, itself included; clusters are the components
    of the cores, label = smallest core id; other vectors join their nearest core within eps.
    """
    index = build_pivots(vectors.select("id", "vector"), tile_rows)
    degrees = _degrees(index, eps)
    marked = index.rows.join(degrees, "id", "left").withColumn("core", F.coalesce("near", F.lit(0)) + 1 >= min_samples).drop("near")
    marked = cut_lineage(marked)
    cores = marked.where("core").select("id", "vector", "block")
    linked = connected_components(_forest(index, eps, cores))
    core_labels = cores.select("id").join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("label"))
    core_labels = cut_lineage(core_labels)
    border = _borders(index, marked, eps).join(core_labels.select(F.col("id").alias("core_id"), "label"), "core_id").select("id", "label")
    labelled = cut_lineage(core_labels.unionByName(border))
    big = labelled.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= min_cluster_size).select("label")
    kept = labelled.join(big, "label")
    return vectors.select("id").join(kept, "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


# --- clusters ----------------------------------------------------------------------------------


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per cluster, combined before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col("vector").cast("array<double>")))
    return vectors.groupBy(F.col(label).alias("cluster_id")).agg(vector_to_array(mean).alias("centroid"), F.count("*").alias("members"))


def representatives(vectors: DataFrame, centers: DataFrame, label: str = "label") -> DataFrame:
    """Member nearest (L2) to its centroid, the lowest id on ties."""
    near = vectors.join(centers.select(F.col("cluster_id").alias(label), "centroid"), label)
    gap = F.round(distance(F.col("vector"), F.col("centroid"), "l2"), 9)
    best = F.min_by(F.struct("id", "template"), F.struct(gap, "id"))
    return near.groupBy(F.col(label).alias("cluster_id")).agg(best.alias("_b")).select(
        "cluster_id", F.col("_b.id").alias("representative_id"), F.col("_b.template").alias("representative_template")
    )


def build_clusters(vectors: DataFrame, templates: DataFrame, first: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(clusters, members) from labelled vectors, template counts and each template's first record.

    ``vectors`` = ``id, vector, template, label``; ``templates`` = ``template, n``; ``first`` =
    ``template, raw_text, source, line_number, timestamp``.
    """
    members = vectors.select(F.col(label).alias("cluster_id"), "template").join(templates, "template").select("cluster_id", "template", "n")
    sizes = members.groupBy("cluster_id").agg(F.sum("n").alias("size"), F.count("*").alias("templates"))
    reps = representatives(vectors, centroids(vectors, label), label)
    named = reps.join(first, reps["representative_template"] == first["template"], "left")
    stamp = F.coalesce(F.unix_millis("timestamp"), F.lit(0))
    clusters = sizes.join(named, "cluster_id").select(
        "cluster_id", "size", "templates", "representative_template", F.col("raw_text").alias("representative_raw"),
        F.col("source").alias("representative_source"), F.col("line_number").alias("representative_line"),
        stamp.alias("representative_timestamp_ms"),
    )
    return clusters, members


def project_2d(vectors: DataFrame, label: str = "label", n: int | None = None) -> DataFrame:
    """First two principal components of all vectors, or of the n lowest ids per cluster."""
    rows = vectors.withColumn("_v", array_to_vector(F.col("vector").cast("array<double>")))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(rows)
    picked = rows
    if n is not None:
        picked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(label).orderBy("id"))).where(F.col("_rank") <= n)
    xy = vector_to_array("_p")
    return model.transform(picked).select("id", label, xy[0].alias("x"), xy[1].alias("y"))


# --- nearest centroid --------------------------------------------------------------------------


def _nearest_local(ids, x, center_ids, centers, metric):
    """Nearest centroid per row of ``x``; equal distances go to the lowest id."""
    import numpy as np

    def unit(m):
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    if metric == "cosine":
        gap = 1.0 - unit(x) @ unit(centers).T
    else:
        square = (x * x).sum(1)[:, None] + (centers * centers).sum(1)[None, :] - 2.0 * (x @ centers.T)
        gap = np.sqrt(np.maximum(square, 0.0))
    best = np.round(gap, 12).argmin(axis=1)
    return center_ids[best], gap[np.arange(len(x)), best]


def nearest_centroid(
    vectors: DataFrame, centers: DataFrame, metric: str = "cosine", broadcast_limit: int | None = None
) -> DataFrame:
    """``vectors`` + ``nearest_id, distance``; ``centers`` = ``cluster_id, vector``. Exact.

    Up to ``broadcast_limit`` centroids (by default as many as ``BROADCAST_BYTES`` hold) are sent to the tasks and matched by matrix products with
    no shuffle. Beyond it, the centroids are cut into chunks; every chunk meets every block of
    vectors and only one candidate per vector and chunk is shuffled.
    """
    if broadcast_limit is None:
        one = centers.select(F.size("vector")).first()
        broadcast_limit = BROADCAST_BYTES // (8 * max(1, one[0] if one else 1))
    few = centers.select(F.col("cluster_id").cast("long"), F.col("vector").cast("array<double>")).limit(broadcast_limit + 1)
    size = few.count()
    match = _nearest_local
    schema = vectors.schema
    if size <= broadcast_limit:
        shared = vectors.sparkSession.sparkContext.broadcast(_as_arrays(few))

        def score(batches):
            import numpy as np

            ids, rows = shared.value
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    pdf["nearest_id"], pdf["distance"] = None, None
                    yield pdf
                    continue
                x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
                pdf["nearest_id"], pdf["distance"] = match(None, x, ids, rows, metric)
                yield pdf

        from pyspark.sql.types import DoubleType, LongType, StructType

        out = StructType(list(schema.fields)).add("nearest_id", LongType()).add("distance", DoubleType())
        return vectors.mapInPandas(score, out)
    return _nearest_chunked(vectors, centers, metric, broadcast_limit)


def _as_arrays(centers: DataFrame):
    """(ids, matrix) of a bounded set of centroids, in id order."""
    import numpy as np

    table = centers.toArrow()
    ids = table["cluster_id"].to_numpy()
    flat = table["vector"].combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order] if len(ids) else np.zeros((0, 0))


def _nearest_chunked(vectors: DataFrame, centers: DataFrame, metric: str, chunk_rows: int, block_rows: int = 20_000) -> DataFrame:
    """Nearest centroid when the centroids outgrow one task: blocks of vectors x chunks of centroids.

    Rows get a number of their own (fixed by the checkpoint), so ``vectors`` needs no id.
    """
    names = vectors.columns
    vectors = cut_lineage(vectors.withColumn("_row", F.monotonically_increasing_id()))
    chunks = max(1, math.ceil(centers.count() / chunk_rows))
    blocks = max(1, math.ceil(vectors.count() / block_rows))
    block = F.pmod(F.xxhash64("_row"), F.lit(blocks))
    asked = vectors.select("_row", F.col("vector").cast("array<double>"), block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    held = centers.select(
        F.col("cluster_id").cast("long").alias("cluster_id"), F.col("vector").cast("array<double>"),
        F.pmod(F.xxhash64("cluster_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
    )
    match = _nearest_local

    def score(left, right):
        import numpy as np
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame(columns=["_row", "nearest_id", "distance"])
        right = right.sort_values("cluster_id")
        ids = right["cluster_id"].to_numpy(np.int64)
        rows = np.stack(right["vector"].to_numpy()).astype(np.float64)
        nearest, gap = match(None, np.stack(left["vector"].to_numpy()).astype(np.float64), ids, rows, metric)
        return pd.DataFrame({"_row": left["_row"].to_numpy(), "nearest_id": nearest, "distance": gap})

    candidates = asked.groupBy("block", "chunk").cogroup(held.groupBy("block", "chunk")).applyInPandas(score, "_row long, nearest_id long, distance double")
    order = F.struct(F.round("distance", 12), "nearest_id")
    best = candidates.groupBy("_row").agg(F.min_by(F.struct("nearest_id", "distance"), order).alias("_b"))
    return vectors.join(best, "_row", "left").select(*names, "_b.nearest_id", "_b.distance")


def assign_to_clusters(vectors: DataFrame, centers: DataFrame, eps: float, metric: str = "cosine") -> DataFrame:
    """New vectors -> nearest cluster within eps, else -1."""
    matched = nearest_centroid(vectors, centers, metric)
    return matched.withColumn("label", F.when(F.col("distance") <= eps, F.col("nearest_id")).otherwise(F.lit(-1)))


def classify_distance(distance_col: Column, mode: str = "general", thresholds: tuple[float, float, float] | None = None) -> Column:
    """high_risk_anomaly / new_pattern / rare_known / known."""
    p = PRESETS[mode]
    low, medium, high = thresholds or (p["low"], p["medium"], p["high"])
    return (
        F.when(distance_col >= high, "high_risk_anomaly").when(distance_col >= medium, "new_pattern")
        .when(distance_col >= low, "rare_known").otherwise("known")
    )


def score_anomalies(
    vectors: DataFrame, baseline: DataFrame, metric: str = "cosine", mode: str = "general",
    thresholds: tuple[float, float, float] | None = None,
) -> DataFrame:
    """``template, distance, label, nearest_cluster_id, nearest_template``.

    An empty baseline scores everything 1.0 / high risk.
    """
    names = baseline.select(F.col("cluster_id").cast("long").alias("nearest_id"), F.col("representative_template").alias("nearest_template"))
    matched = nearest_centroid(vectors, baseline.select("cluster_id", "vector"), metric).join(names, "nearest_id", "left")
    gap = F.coalesce("distance", F.lit(1.0))
    label = F.when(F.col("nearest_id").isNull(), "high_risk_anomaly").otherwise(classify_distance(gap, mode, thresholds))
    return matched.select("template", gap.alias("distance"), label.alias("label"), F.col("nearest_id").alias("nearest_cluster_id"), "nearest_template")


def semantic_search(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine") -> DataFrame:
    """k nearest stored templates to one query vector: a top-k, so no full sort and no shuffle of vectors."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.withColumn("distance", distance(F.col("vector"), asked, metric))
    return scored.orderBy(F.round("distance", 9), "id").limit(k)


def semantic_search_many(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, metric: str = "cosine") -> DataFrame:
    """k nearest templates for a batch of queries -> ``query_id, id, template, distance, rank``.

    Every task keeps its own k best per query (one matrix product per batch); only those are merged.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def best(batches):
        import numpy as np
        import pandas as pd

        ids = [q[0] for q in shared.value]
        asked = np.array([q[1] for q in shared.value], dtype=np.float64)
        held = None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
            unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-300)
            parts = []
            for q, one in zip(ids, asked):  # a column of distances at a time, cut to the k best before texts are touched
                gap = 1.0 - unit(x) @ unit(one) if metric == "cosine" else np.linalg.norm(x - one, axis=1)
                kth = np.partition(np.round(gap, 9), min(k, len(gap)) - 1)[min(k, len(gap)) - 1]
                near = np.flatnonzero(np.round(gap, 9) <= kth)
                parts.append(pd.DataFrame({"query_id": q, "id": pdf["id"].to_numpy()[near], "template": pdf["template"].to_numpy()[near], "distance": gap[near]}))
            part = pd.concat(parts)
            held = part if held is None else pd.concat([held, part])
            held["_d"] = held["distance"].round(9)
            held = held.sort_values(["query_id", "_d", "id"]).groupby("query_id").head(k).drop(columns="_d")
        if held is not None:
            yield held

    local = vectors.select("id", "template", "vector").mapInPandas(best, "query_id long, id long, template string, distance double")
    order = W.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
