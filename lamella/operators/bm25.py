"""BM25: corpus statistics, sparse vectors, a model that is fitted once and kept, and search of a stated query set
against all documents.

Documents are counted once, into a row of terms and frequencies each (``counted``); statistics, vectors and searches
read those rows. The queries' weights are broadcast in blocks of bounded size; a task scores its documents and
keeps the best k of each query while they stream by, and only those leave it. A pair of query and document is
never a row, so a word that occurs everywhere costs no join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .mask import Mask, collected
from .topk import Best

K1, B = 1.5, 0.75


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, tokenise: Callable[[Column], Column] = tokens) -> DataFrame:
    """``doc_id, tokens`` and the columns of ``keep``."""
    return docs.select(F.col(id_col).alias("doc_id"), tokenise(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"), *(keep or []))


#: Tokens, and cells of a table of questions and documents, that a task works on at a time.
_PIECE = 1 << 18


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in pieces of at most about ``_PIECE`` tokens (second column), so that a task's memory doesn't follow the batch."""
    size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy())
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _PIECE, side="right")))
        yield batch.slice(at, to - at)
        at = to


def counted(toks: DataFrame) -> DataFrame:
    """``doc_id, length, terms, tfs``: each document's distinct terms in the order of their first occurrence in the piece of a batch, and
    how often they occur; other columns than tokens stay."""
    others = [c for c in toks.columns if c not in ("doc_id", "tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            lists = batch.column(1)
            row = pc.list_parent_indices(lists).to_numpy()
            flat = pc.list_flatten(lists).dictionary_encode()
            size = max(len(flat.dictionary), 1)
            key, n = np.unique(row * size + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
            offsets = pa.array(np.searchsorted(key // size, np.arange(batch.num_rows + 1)).astype(np.int32))
            terms = pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(key % size)))
            tfs = pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))
            length = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), length, terms, tfs, *batch.columns[2:]], ["doc_id", "length", "terms", "tfs", *others])

    kinds = "".join(f", `{c}` {toks.schema[c].dataType.simpleString()}" for c in others)
    return toks.select("doc_id", "tokens", *others).mapInArrow(run, f"doc_id {toks.schema['doc_id'].dataType.simpleString()}, length int, terms array<string>, tfs array<int>{kinds}")


def term_frequencies(toks: DataFrame) -> DataFrame:
    """``doc_id, term, tf``, a row for each term of a document; no shuffle."""
    return _postings(counted(toks)).select("doc_id", "term", "tf")


def _postings(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "length", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc_id", "length", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: ``doc_count, avg_doc_length``; documents without tokens count."""
    size = F.size("tokens") if "tokens" in toks.columns else F.col("length")
    return toks.agg(F.count("*").alias("doc_count"), F.coalesce(F.avg(F.greatest(size, F.lit(0))), F.lit(0.0)).alias("avg_doc_length"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def vocabulary(toks: DataFrame) -> DataFrame:
    """``term, df, idf``. Distinct terms are taken within the document, so one aggregation is enough."""
    terms = F.array_distinct("tokens") if "tokens" in toks.columns else F.col("terms")
    df = toks.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(corpus_stats(toks))).select("term", "df", idf(F.col("doc_count"), F.col("df")).alias("idf"))


def term_ids(vocab: DataFrame) -> DataFrame:
    """Terms numbered in order from 0: terms are counted by their first two characters, a small table whose running sum gives
    each of these groups its first number, and sorted within the groups."""
    ranged = vocab.withColumn("prefix", F.substring("term", 1, 2))
    firsts = ranged.groupBy("prefix").count().selectExpr("prefix", "sum(count) OVER (ORDER BY prefix) - count AS first")
    return ranged.join(firsts, "prefix").selectExpr("term", "df", "idf", "first + row_number() OVER (PARTITION BY prefix ORDER BY term) - 1 AS term_id")


def weight(tf: Column, length: Column, avg: Column, idf_: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))


def sparse_vectors(toks: DataFrame) -> DataFrame:
    """``doc_id, term, tf, weight`` of every document's terms; ``toks`` has tokens or is ``counted``."""
    docs = counted(toks) if "tokens" in toks.columns else toks
    joined = _postings(docs).join(vocabulary(docs), "term").crossJoin(F.broadcast(corpus_stats(docs).select("avg_doc_length")))
    return joined.select("doc_id", "term", "tf", weight(F.col("tf"), F.col("length"), F.col("avg_doc_length"), F.col("idf")).alias("weight"))


@dataclass
class Model:
    """What is fitted once: counted documents, the vocabulary with ids and idf, and two numbers."""

    documents: DataFrame
    terms: DataFrame
    doc_count: int
    avg_doc_length: float

    def info(self) -> DataFrame:
        """One row: size of the vocabulary, documents, their average length, the parameters."""
        return self.terms.agg(F.count("*").alias("vocabulary_size")).select("vocabulary_size", F.lit(self.doc_count).cast("long").alias("doc_count"), F.lit(float(self.avg_doc_length)).alias("avg_doc_length"), F.lit(K1).alias("k1"), F.lit(B).alias("b"))

    def vectors(self) -> DataFrame:
        """``doc_id, term_id, weight`` of every document."""
        joined = _postings(self.documents).join(self.terms, "term")
        return joined.select("doc_id", "term_id", weight(F.col("tf"), F.col("length"), F.lit(float(self.avg_doc_length or 1)), F.col("idf")).alias("weight"))

    def encode(self, toks: DataFrame, id_col: str = "query_id") -> DataFrame:
        """``id, term_id, weight`` of other texts (``tokens``); terms that the model lacks count for the length only."""
        docs = counted(toks.withColumnRenamed(id_col, "doc_id").select("doc_id", "tokens"))
        joined = _postings(docs).join(self.terms, "term")
        return joined.select(F.col("doc_id").alias(id_col), "term_id", weight(F.col("tf"), F.col("length"), F.lit(float(self.avg_doc_length or 1)), F.col("idf")).alias("weight"))

    def search(self, queries: DataFrame, k: int = 10, classic: bool = False, where: Column | None = None, k1: float = K1, b: float = B, block: int = 2000, filters: DataFrame | None = None) -> DataFrame:
        """``query_id, doc_id, score, rank``: the k best documents of each query (``query_id, tokens``).

        By default both sides are weighted (the dot product of two sparse vectors); ``classic`` counts the query's
        tokens instead. ``where`` keeps documents out of the search, not out of the statistics; ``filters`` (``query_id, column, value``) keep
        them out of one query's. Ties go to the smaller id.
        """
        rows = self.documents.where(where) if where is not None else self.documents
        out = None
        for part in _blocks(queries, block):
            asked = rows.sparkSession.createDataFrame([(t,) for t in sorted({t for _, ts in part for t in ts})], "asked string")
            idfs = {r["term"]: r["idf"] for r in self.terms.join(F.broadcast(asked), F.col("term") == F.col("asked")).select("term", "idf").collect()}  # at most the block's terms
            found = _scored(rows, queries, part, idfs, self.avg_doc_length or 1.0, k, classic, k1, b, filters=filters)
            out = found if out is None else out.unionByName(found)
        return ranked(out, k)


def fit(toks: DataFrame, path: str) -> Model:
    """Count ``toks`` (``doc_id, tokens`` and columns to filter by) and keep the model under ``path``."""
    counted(toks).write.mode("overwrite").parquet(f"{path}/documents")
    docs = toks.sparkSession.read.parquet(f"{path}/documents")
    term_ids(vocabulary(docs)).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    corpus_stats(docs).write.mode("overwrite").parquet(f"{path}/stats")
    return load(toks.sparkSession, path)


def load(spark: SparkSession, path: str) -> Model:
    """A model that ``fit`` has kept."""
    stats = spark.read.parquet(f"{path}/stats").first()
    return Model(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/vocabulary"), stats["doc_count"], stats["avg_doc_length"])


def _blocks(queries: DataFrame, block: int) -> Iterator[list[tuple[object, list[str]]]]:
    """Queries as (id, tokens), collected block by block; those without a token find nothing and are left out."""
    queries = queries.where(F.size("tokens") > 0)
    n = max(1, -(-queries.count() // block))
    for i in range(n):
        yield [(r["query_id"], r["tokens"] or []) for r in queries.where(F.coalesce(F.pmod(F.xxhash64("query_id"), F.lit(n)), F.lit(0)) == i).collect()]


def _scored(rows: DataFrame, queries: DataFrame, part: list[tuple[object, list[str]]], idfs: dict[str, float], avg: float, k: int, classic: bool = False, k1: float = K1, b: float = B, plain: bool = False, filters: DataFrame | None = None) -> DataFrame:
    """The best k of ``rows`` (``doc_id, length, terms, tfs`` and columns to filter by) in each task for some queries; ``plain`` adds up
    the rows' numbers as they are. ``filters`` are each query's own."""
    term_no = {t: i for i, t in enumerate(sorted(idfs))}
    code, query, weights = [], [], []
    for q, (_, ts) in enumerate(part):
        for t in sorted(set(ts) & idfs.keys()):
            tf = ts.count(t)
            code.append(term_no[t])
            query.append(q)
            weights.append(tf if classic or plain else idfs[t] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ts) / avg)))
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(np.array(code)[order] if code else np.empty(0), np.arange(len(term_no) + 1))
    packed = (pa.array(list(term_no), pa.string()), np.array([idfs[t] for t in term_no]), first, np.array(query, np.int64)[order], np.array(weights, float)[order], [q for q, _ in part])
    columns, wanted = collected(filters, packed[-1], rows)
    shared = rows.sparkSession.sparkContext.broadcast((*packed, Mask(columns, packed[-1], wanted)))
    query_type = pa.int64() if queries.schema["query_id"].dataType.simpleString() in ("bigint", "int") else pa.string()
    out_type = {"int": pa.int32()}.get(queries.schema["query_id"].dataType.simpleString(), query_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf_, first, query, wq, ids, mask = shared.value
        best = Best(ids, out_type, k, 0.0)
        step = min(64, max(1, _PIECE // max(len(ids), 1)))
        for batch in batches:
            for at in range(0, batch.num_rows if len(terms) else 0, step):
                piece = batch.slice(at, step)
                row = pc.list_parent_indices(piece.column(2)).to_numpy()
                number = pc.index_in(pc.list_flatten(piece.column(2)), value_set=terms)
                known = number.is_valid().to_numpy(zero_copy_only=False)
                row, number = row[known], pc.drop_null(number).to_numpy()
                tf = pc.list_flatten(piece.column(3)).to_numpy()[known].astype(float)
                length = piece.column(1).to_numpy().astype(float)[row]
                w = tf if plain else idf_[number] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg))
                n = first[number + 1] - first[number]
                where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[number], n)
                scores = np.bincount(query[where] * piece.num_rows + np.repeat(row, n), np.repeat(w, n) * wq[where], len(ids) * piece.num_rows)
                scores = scores.reshape(len(ids), piece.num_rows)
                allowed = mask(piece.columns[4:])
                best.add(piece.column(0), scores if allowed is None else np.where(allowed, scores, 0.0))
        got = best.batch()
        if got is not None:
            yield got

    return rows.select("doc_id", "length", "terms", "tfs", *columns).mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def search(toks: DataFrame, queries: DataFrame, k: int = 10, classic: bool = False, k1: float = K1, b: float = B, block: int = 2000) -> DataFrame:
    """As ``Model.search``, for documents (``doc_id, tokens``) that no model was fitted on: document frequencies of the
    queries' terms are counted first. Where more than one block or search is expected, fit a model."""
    rows, out = counted(toks), None
    for part in _blocks(queries, block):
        shared = toks.sparkSession.sparkContext.broadcast(pa.array(sorted({t for _, ts in part for t in ts}), pa.string()))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms = shared.value
            df = np.zeros(len(terms), np.int64)
            n = length = 0
            for batch in batches:
                number = pc.drop_null(pc.index_in(pc.list_flatten(batch.column(1)), value_set=terms)).to_numpy()
                df += np.bincount(number, minlength=len(terms))
                n, length = n + batch.num_rows, length + int(pc.sum(batch.column(0)).as_py() or 0)
            some = np.flatnonzero(df)
            # no token is blank: the corpus' totals travel along
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([terms.take(pa.array(some)), pa.array(["", " "])]), pa.array([*df[some].tolist(), n, length], pa.int64())], ["term", "df"])

        df = {r["term"]: r["df"] for r in rows.select("length", "terms").mapInArrow(count, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        n, length = df.pop("", 0), df.pop(" ", 0)
        idfs = {t: float(np.log((n - d + 0.5) / (d + 0.5) + 1)) for t, d in df.items()}
        found = _scored(rows, queries, part, idfs, length / n if length else 1.0, k, classic, k1, b)
        out = found if out is None else out.unionByName(found)
    return ranked(out, k)


def ranked(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Rank from 1 by score, then id; Spark keeps k rows a query in each task before it shuffles."""
    order = F.expr(f"row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {id_col})")
    return scored.withColumn("rank", order).where(F.col("rank") <= k)
