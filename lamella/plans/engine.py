"""Index build and batch retrieval: the plans that put the operators together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metadata import document_type
from ..functions.query import analysis, route
from ..functions.text import clean_text, tokens
from ..operators import assembly, bm25, chunking, dense, fusion
from .dialogue import alpha_by_type


@dataclass(frozen=True)
class Config:
    top_k: int = 10
    alpha: float = 0.5
    widen: int = 3  # candidates before re-ranking, times top_k
    leg: int = 2  # candidates of each leg, times those
    budget: int = 3000
    probes: int | None = 8  # cells that a question reads where an index has them; None reads all


def build_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Clean, type and chunk documents."""
    clean = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return chunking.chunk_tree(clean.withColumn("kind", document_type(F.col("text"))), type_col="kind")


def analysed(queries: DataFrame, id_col: str = "query_id", text_col: str = "query", tokenise: Callable[[Column], Column] = tokens) -> DataFrame:
    q = F.col(text_col)
    return queries.select(F.col(id_col).alias("query_id"), q.alias("query"), tokenise(q).alias("tokens"), analysis(q).alias("analysis"), route(q).alias("route"))


def leg_weights(asked: DataFrame, fields: float = 0.25) -> DataFrame:
    """``query_id, bm25, dense, fields``: each question's weights of the three legs for ``fusion.fused``; the first two follow its type."""
    alpha = alpha_by_type(F.col("analysis.query_type"))
    return asked.select("query_id", alpha.alias("bm25"), (1 - alpha).alias("dense"), F.lit(fields).alias("fields"))


def hybrid(toks: DataFrame, vectors: DataFrame | None, queries: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Both legs, fused. ``queries`` has query_id, tokens and vector; without ``vectors`` the sparse leg stands alone."""
    wide = config.top_k * config.widen
    sparse = bm25.search(toks, queries.select("query_id", "tokens"), wide * config.leg)
    if vectors is None:
        return sparse.where(F.col("rank") <= wide)
    return fusion.rrf(sparse, dense.search(vectors, queries.select("query_id", "vector"), wide * config.leg), wide, config.alpha)


def retrieve(toks: DataFrame, vectors: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Fused candidates re-ranked to top_k. Tokens are joined to candidates only."""
    found = hybrid(toks, vectors, queries, config)
    text = toks.select("doc_id", F.col("tokens").alias("doc_tokens"))
    asked = queries.select("query_id", F.col("tokens").alias("query_tokens"))
    return fusion.rerank(found.join(text, "doc_id").join(asked, "query_id"), fusion.overlap_score(F.col("query_tokens"), F.col("doc_tokens")), config.top_k).drop("doc_tokens", "query_tokens")


def answer_context(hits: DataFrame, texts: DataFrame, config: Config = Config()) -> DataFrame:  # noqa: B008
    """``query_id, context`` of hits within the budget; ``texts`` has doc_id, text."""
    joined = hits.join(texts, "doc_id")
    return assembly.context(assembly.within_budget(joined, F.length("text"), config.budget), F.col("text"))
