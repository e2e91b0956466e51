"""Rank fusion, score blending, re-ranking and the expansion of hits by their tree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def rrf(sparse: DataFrame, dense: DataFrame, k: int = 10, alpha: float = 0.5, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two rankings (``query_id, doc_id, score, rank``). A document that one list lacks
    counts as ``rrf_k`` places after that list's end."""

    def leg(df: DataFrame, name: str) -> DataFrame:
        return df.select("query_id", "doc_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))

    both = leg(sparse, "bm25").join(leg(dense, "dense"), ["query_id", "doc_id"], "full_outer")
    sized = both.selectExpr("*", "count(bm25_rank) OVER (PARTITION BY query_id) AS nb", "count(dense_rank) OVER (PARTITION BY query_id) AS nd")
    missing = lambda rank, n: F.coalesce(F.col(rank), F.col(n) + rrf_k) + rrf_k
    scored = sized.withColumn("score", F.round(alpha / missing("bm25_rank", "nb") + (1 - alpha) / missing("dense_rank", "nd"), 9))
    return scored.selectExpr("query_id", "doc_id", "score", "bm25_score", "dense_score", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank").where(F.col("rank") <= k)


def fused(legs: dict[str, DataFrame], k: int = 10, weights: dict[str, float] | DataFrame | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of rankings (name to ``query_id, doc_id, score, rank``), each with its weight: the same for all
    questions, or a table ``query_id`` with a column for each name (a question that it lacks, or a null, weighs 1). A document that a
    list lacks counts as ``rrf_k`` places after that list's end. ``query_id, doc_id, score, rank`` and ``<name>_score`` of each list.

    The lists are united and grouped once, whatever their number.
    """
    names = list(legs)
    parts = [df.select("query_id", "doc_id", F.lit(i).alias("leg"), F.col("score").cast("double").alias("s"), F.col("rank").alias("r")) for i, df in enumerate(legs.values())]
    both = reduce(DataFrame.unionByName, parts)
    of = lambda c, i: F.max(F.when(F.col("leg") == i, F.col(c)))
    joined = both.groupBy("query_id", "doc_id").agg(*(of("s", i).alias(f"{n}_score") for i, n in enumerate(names)), *(of("r", i).alias(f"r{i}") for i in range(len(names))))
    sized = joined.selectExpr("*", *(f"count(r{i}) OVER (PARTITION BY query_id) AS n{i}" for i in range(len(names))))
    if isinstance(weights, DataFrame):
        own = weights.select("query_id", *(F.col(n).cast("double").alias(f"w{i}") for i, n in enumerate(names)))
        sized = sized.join(own, "query_id", "left")
        weight = [F.coalesce(f"w{i}", F.lit(1.0)) for i in range(len(names))]
    else:
        weight = [F.lit(float((weights or {}).get(n, 1.0))) for n in names]
    total = reduce(lambda a, b: a + b, (w / (F.coalesce(f"r{i}", F.col(f"n{i}") + rrf_k) + rrf_k) for i, w in enumerate(weight)))
    scored = sized.withColumn("score", F.round(total, 9))
    placed = scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)")).where(F.col("rank") <= k)
    return placed.select("query_id", "doc_id", "score", *(f"{n}_score" for n in names), "rank")


def blended(hits: DataFrame, importance: Column, weight: float = 0.7, digits: int = 6) -> DataFrame:
    """``weight`` of the score and the rest of the importance, ranked anew."""
    scored = hits.withColumn("score", F.round(weight * F.col("score") + (1 - weight) * importance, digits))
    return scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"))


def overlap_score(query: Column, text: Column) -> Column:
    """The offline default for a cross-encoder: the share of distinct query tokens that the text has."""
    return F.size(F.array_intersect(query, text)) / F.nullif(F.size(F.array_distinct(query)), F.lit(0))


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """Replace the order by ``rerank_score``; a model is a pandas UDF (query, text) -> double in the same place."""
    scored = hits.withColumn("rerank_score", F.round(score, 6))
    return scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, doc_id)")).where(F.col("rank") <= k)


def with_context(hits: DataFrame, chunks: DataFrame, siblings: bool = False) -> DataFrame:
    """Hits (``chunk_id``, ...) with ``parent_text``, ``children_texts`` in order and, if asked for, ``sibling_ids``.
    Missing relatives are left out. Only hits' relatives are read from ``chunks``, by joins on ids. Hits that have their
    ``parent_chunk_id`` are not looked up for it."""
    found = hits.select("chunk_id").distinct()
    if "parent_chunk_id" in hits.columns:
        own, out = hits.select("chunk_id", "parent_chunk_id").distinct(), hits
    else:
        own = chunks.select("chunk_id", "parent_chunk_id").join(found, "chunk_id", "left_semi")
        out = hits.join(own, "chunk_id", "left")
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text"))
    parents = parents.join(own.select("parent_chunk_id").distinct(), "parent_chunk_id", "left_semi")
    out = out.join(parents, "parent_chunk_id", "left")
    ids = found.select(F.col("chunk_id").alias("of"))
    below = chunks.select(F.col("parent_chunk_id").alias("of"), "chunk_index", "text").join(ids, "of", "left_semi")
    children = below.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("children_texts"))
    out = out.join(children.withColumnRenamed("of", "chunk_id"), "chunk_id", "left").withColumn("children_texts", F.coalesce("children_texts", F.array().cast("array<string>")))
    if siblings:
        next_to = hits.select("chunk_id").distinct().join(own, "chunk_id").select(F.col("chunk_id").alias("of"), "parent_chunk_id")
        near = next_to.join(chunks.select("parent_chunk_id", "chunk_index", F.col("chunk_id").alias("sibling")), "parent_chunk_id").where("sibling <> of")
        near = near.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "sibling"))), lambda x: x["sibling"]).alias("sibling_ids"))
        out = out.join(near.withColumnRenamed("of", "chunk_id"), "chunk_id", "left")
    return out


def ancestors(chunks: DataFrame, ids: DataFrame, depth: int = 3) -> DataFrame:
    """``chunk_id, distance, ancestor_id`` up to the root. Trees have three levels, so two joins reach it."""
    link = chunks.select(F.col("chunk_id").alias("child"), F.col("parent_chunk_id").alias("up"))
    now = ids.select("chunk_id", F.col("chunk_id").alias("at"))
    out = None
    for d in range(1, depth):
        now = now.join(link, F.col("at") == F.col("child")).where("up IS NOT NULL").select("chunk_id", F.col("up").alias("at"))
        part = now.select("chunk_id", F.lit(d).alias("distance"), F.col("at").alias("ancestor_id"))
        out = part if out is None else out.unionByName(part)
    return out


Scorer = Callable[[Column, Column], Column]
