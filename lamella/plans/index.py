"""Index build, and retrieval over chunks: one plan from questions to cited, expanded passages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metadata import metadata
from ..functions.text import clean_text, tokens
from ..operators import assembly, bm25, cells, chunking, dense, fusion, postings
from ..sources import index_store
from ..sources.work import settled
from .engine import Config, analysed

Embedder = Callable[[Column], Column]
Tokeniser = Callable[[Column], Column]

_FREQUENT = "enitrasoudlhcmgpvbfwyzkxjq"


def letters(text: Column) -> Column:
    """A small embedder without a model: how often each letter occurs. Letters are taken out one after another, frequent ones first, so
    that less and less is looked through; sizes before and after tell how many there were."""
    start = F.struct(F.lower(text).alias("rest"), F.array().cast("array<int>").alias("sizes"))

    def step(s: Column, c: Column) -> Column:
        return F.struct(F.replace(s["rest"], c, F.lit("")).alias("rest"), F.array_append(s["sizes"], F.octet_length(s["rest"])).alias("sizes"))

    def counts(sizes: Column) -> Column:
        return F.array(*((F.get(sizes, F.lit(i)) - F.get(sizes, F.lit(i + 1))).cast("float") for i in (_FREQUENT.index(c) for c in "abcdefghijklmnopqrstuvwxyz")))

    left = F.aggregate(F.array(*map(F.lit, _FREQUENT)), start, step, lambda s: F.array_append(s["sizes"], F.octet_length(s["rest"])))
    return F.when(text.isNotNull(), chunking.once(left, counts)).otherwise(F.array(*[F.lit(None).cast("float")] * 26))


def hashed(text: Column) -> Column:
    return dense.hashed_embedding(tokens(text))


@dataclass
class Index:
    """Documents and chunks with dense vectors, and the chunks' BM25 model; all of them tables at rest. Questions and re-ranked
    texts are cut into tokens as the chunks were. With postings and cells both legs read only what a question needs."""

    documents: DataFrame
    chunks: DataFrame
    model: bm25.Model
    tokenise: Tokeniser = tokens
    postings: postings.Postings | None = None
    cells: cells.Cells | None = None


def inverted(index: Index, path: str, clusters: int = 64, segment_docs: int = postings.SEGMENT_DOCS) -> Index:
    """The index with postings and vector cells of its chunks, kept under ``path``; both can be searched by level."""
    held = postings.write(index.model, f"{path}/postings", "hierarchy_level", segment_docs)
    vectors = cells.write(index.chunks, f"{path}/cells", clusters, id_col="chunk_id", by="hierarchy_level")
    return replace(index, postings=held, cells=vectors)


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", embed: Embedder = hashed, levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """Documents (``doc_id, text, metadata, embedding``) and their chunks with embeddings, as an index keeps them."""
    clean = docs.select(F.col(id_col).alias("doc_id"), clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    described = clean.withColumn("metadata", metadata(F.col("text"))).withColumn("embedding", embed(F.col("text")))
    return described, chunked(clean.select("doc_id", "text", metadata(F.col("text"))["document_type"].alias("kind")), embed, levels)


def chunked(clean: DataFrame, embed: Embedder = hashed, levels: int = 3) -> DataFrame:
    """Chunks with embeddings of clean documents (``doc_id, text, kind``)."""
    return chunking.chunk_tree(clean, type_col="kind", levels=levels).withColumn("embedding", embed(F.col("text")))


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", embed: Embedder = hashed, levels: int = 3, tokenise: Tokeniser = tokens) -> Index:
    """Clean, describe, chunk, embed and count documents, and keep everything under ``path``. Chunks lie by level, so that
    a level is a pruned scan."""
    spark = docs.sparkSession
    described, _ = prepared(docs, id_col, text_col, embed, levels)
    index_store.create(spark, f"{path}/documents", described)
    clean = index_store.read(spark, f"{path}/documents").select("doc_id", "text", F.col("metadata.document_type").alias("kind"))  # clean-up is done once
    index_store.write_chunks(chunked(clean, embed, levels), f"{path}/chunks")
    stored = index_store.read(spark, f"{path}/chunks")
    bm25.fit(bm25.tokenised(stored, "chunk_id", keep=["hierarchy_level"], tokenise=tokenise), f"{path}/bm25")
    return opened(spark, path, tokenise)


def opened(spark: SparkSession, path: str, tokenise: Tokeniser = tokens) -> Index:
    """An index that ``build`` has kept, with the tokeniser it was built with."""
    return Index(index_store.read(spark, f"{path}/documents"), index_store.read(spark, f"{path}/chunks"), bm25.load(spark, f"{path}/bm25"), tokenise)


def questions(queries: DataFrame, embed: Embedder = hashed, id_col: str = "query_id", text_col: str = "query", tokenise: Tokeniser = tokens) -> DataFrame:
    """``query_id, query, tokens, vector, target_level, ...`` of questions."""
    return analysed(queries, id_col, text_col, tokenise).withColumn("vector", embed(F.col("query"))).withColumn("target_level", F.col("analysis.target_level"))


def chunk_hits(index: Index, asked: DataFrame, level: int | str | None = None, mode: str = "hybrid", config: Config = Config()) -> DataFrame:  # noqa: B008
    """``query_id, doc_id, score, bm25_score, dense_score, rank`` over chunks (``doc_id`` is a chunk's id).

    ``level`` is a level, ``auto`` (each question's own target level) or none for all; it is applied before both legs search.
    ``mode`` is hybrid, dense or sparse.
    """
    if level == "auto":
        parts = [chunk_hits(index, asked.where(F.col("target_level") == i), i, mode, config) for i in range(3)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    wide = config.top_k * config.widen
    at = F.col("hierarchy_level") == level if level is not None else None
    rows = index.chunks if at is None else index.chunks.where(at)
    sparse = close = None
    if mode != "dense":
        words = asked.select("query_id", "tokens")
        sparse = index.postings.search(words, wide * config.leg, value=level) if index.postings else index.model.search(words, wide * config.leg, where=at)
    if mode != "sparse":
        vectors = asked.select("query_id", "vector")
        close = index.cells.search(vectors, wide * config.leg, config.probes, level) if index.cells else dense.search(rows, vectors, wide * config.leg, "chunk_id")
    null = F.lit(None).cast("double")
    if sparse is None:
        return close.where(F.col("rank") <= wide).select("query_id", "doc_id", "score", null.alias("bm25_score"), F.col("score").alias("dense_score"), "rank")
    if close is None:
        return sparse.where(F.col("rank") <= wide).select("query_id", "doc_id", "score", F.col("score").alias("bm25_score"), null.alias("dense_score"), "rank")
    return fusion.rrf(sparse, close, wide, config.alpha)


def retrieve(index: Index, asked: DataFrame, level: int | str | None = None, mode: str = "hybrid", score: fusion.Scorer = fusion.overlap_score, rerank: bool = True, config: Config = Config()) -> DataFrame:  # noqa: B008
    """Candidates with their chunk's columns, re-ranked to the best ``top_k``. Without ``rerank`` the fused order is cut."""
    hits = settled(chunk_hits(index, asked, level, mode, config), "hits")  # small: chunks are met where they lie, and searched once
    if not rerank:
        hits = hits.where(F.col("rank") <= config.top_k)
    rows = index.chunks.select(F.col("chunk_id").alias("doc_id"), F.col("doc_id").alias("document_id"), "parent_chunk_id", "hierarchy_level", "chunk_type", "section_title", "text")
    found = hits.join(rows, "doc_id")
    if not rerank:
        return found.withColumnRenamed("doc_id", "chunk_id").withColumn("rerank_score", F.lit(None).cast("double"))
    words = asked.select("query_id", F.col("tokens").alias("query_tokens"))
    scored = fusion.rerank(found.join(words, "query_id"), score(F.col("query_tokens"), index.tokenise(F.col("text"))), config.top_k)
    return scored.drop("query_tokens").withColumnRenamed("doc_id", "chunk_id")


def expanded(index: Index, hits: DataFrame, siblings: bool = False) -> DataFrame:
    """Hits with parent and children, and siblings if asked for. Hits are written before they are joined to their relatives."""
    return fusion.with_context(settled(hits, "expanded"), index.chunks, siblings)


def prompts(hits: DataFrame, shown: int = 3) -> DataFrame:
    """``query_id, prompt``: the first ``shown`` expanded hits as blocks, in rank order."""
    source = F.coalesce(F.col("document_id").cast("string"), F.lit(assembly.NO_SOURCE))
    block = assembly.block(source, F.coalesce("section_title", F.lit(assembly.NO_SECTION)), F.col("hierarchy_level"), F.col("bm25_score"), F.col("dense_score"), F.col("text"), F.col("parent_text"), F.col("children_texts"))
    first = hits.where(F.col("rank") <= shown).select("query_id", "rank", block.alias("t"))
    return assembly.context(first, F.col("t"), "\n\n").withColumnRenamed("context", "prompt")


def query_summary(hits: DataFrame) -> DataFrame:
    """``query_id, num_chunks, top_score`` of what a query found."""
    return hits.groupBy("query_id").agg(F.count("*").alias("num_chunks"), F.max(F.coalesce("rerank_score", "score")).alias("top_score"))
