"""An inverted index for BM25 at rest, with the largest weight of every block.

Documents are dealt by hash to segments of about ``segment_docs``; a block holds one term's postings in one segment, and
how much of a score it can give at most. A posting is a document's place in its segment and how often it has the term; ids and lengths
are kept once a segment, in a row without a term. Blocks lie in folders by the term's bucket (and by a column such as a chunk's
level), sorted by term, so a question reads its terms' folders and row groups only. A search first reads the blocks' largest
weights, without postings: their sum over a question's terms bounds every score in a segment. The segments of the highest bounds
are scored, which gives each question a k-th score to beat; of the others only those whose bound reaches it are read. The result is the
same as that of a scan of all documents (``bm25.Model.search``), ties included.

The blocks of a segment meet in one task, which scores all questions that chose it and hands on the best k of each: a posting is dealt
once, however many questions have its term, and a pair of question and document is never a row.

A question costs a row for each segment that has one of its terms. For thousands of questions at a time the scan, which reads everything
once, is the better choice. No document's terms are numbered or sorted by one task; a term that every document has is as many
blocks as there are segments.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.work import settled
from . import bm25
from .topk import Best

SEGMENT_DOCS, BUCKETS = 4096, 64
_MEMBERS = -1  # the bucket of segments' own rows
_SLACK = 1e-6  # scores are rounded to six digits before they are compared


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _stretches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by their first ``n`` columns, as lists of slices with equal ones."""
    key, held = None, []
    for batch in batches:
        at = 0
        for now, same in groupby(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True)):
            size = sum(1 for _ in same)
            if now != key and held:
                yield held
                held = []
            key = now
            held.append(batch.slice(at, size))
            at += size
    if held:
        yield held


def _part(tf: np.ndarray, length: np.ndarray, avg: float) -> np.ndarray:
    """What a posting adds to a score, less the question's weight of the term."""
    return tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * length / avg))


def _segment_blocks(parts: list[pa.RecordBatch], avg: float) -> list[list[pa.Array]]:
    """The columns of one segment's row and of its blocks, from its documents (last columns ``doc_id, length, terms, tfs``)."""
    *place, doc, length, terms, tfs = (pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns))
    owner, flat = pc.list_parent_indices(terms).to_numpy(), pc.list_flatten(terms).dictionary_encode()
    if not len(flat):
        return []
    count, code = pc.list_flatten(tfs), flat.indices.to_numpy()
    part = _part(count.to_numpy().astype(float), length.to_numpy().astype(float)[owner], avg)
    order = np.argsort(code, kind="stable")
    size = len(flat.dictionary)
    offsets = np.searchsorted(code[order], np.arange(size + 1)).astype(np.int32)
    at, tf = (pa.ListArray.from_arrays(pa.array(offsets), c) for c in (pa.array(owner[order].astype(np.int32)), count.take(pa.array(order)).cast(pa.int32())))
    ids, lengths = (pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (doc, length.cast(pa.int32())))
    same = pa.array(np.zeros(size, np.int64))
    own = [*(c.slice(0, 1) for c in place), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, at.type), pa.nulls(1, tf.type), ids, lengths]
    return [own, [*(c.take(same) for c in place), flat.dictionary, pa.array(np.maximum.reduceat(part[order], offsets[:-1])), at, tf, pa.nulls(size, ids.type), pa.nulls(size, lengths.type)]]


def write(model: bm25.Model, path: str, by: str | None = None, segment_docs: int = SEGMENT_DOCS, buckets: int = BUCKETS) -> Postings:
    """Keep the postings of a fitted model under ``path``; ``by`` is a column of its documents that searches may filter by."""
    segments = max(1, -(-model.doc_count // segment_docs))
    keys = [by] if by else []
    kinds = [f"`{c}` {model.documents.schema[c].dataType.simpleString()}" for c in keys]
    id_type = model.documents.schema["doc_id"].dataType.simpleString()
    columns = ["term string", "most double", "at array<int>", "tf array<int>", f"ids array<{id_type}>", "lengths array<int>"]
    avg = float(model.avg_doc_length or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _stretches(batches, 1 + len(keys)):
            for got in _segment_blocks(parts, avg):
                yield pa.RecordBatch.from_arrays(got, ["segment", *keys, *(c.split()[0] for c in columns)])

    # documents are dealt to segments whole, in an order of their own, so that a task that runs again gives them the same places
    dealt = model.documents.select(F.pmod(F.xxhash64("doc_id"), F.lit(segments)).alias("segment"), *keys, "doc_id", "length", "terms", "tfs")
    dealt = dealt.repartition("segment").sortWithinPartitions("segment", *keys, "doc_id", F.xxhash64("terms", "tfs"))
    rows = dealt.mapInArrow(run, ", ".join(["segment long", *kinds, *columns]))
    bucket = F.when(F.col("term").isNull(), F.lit(_MEMBERS)).otherwise(_bucket(buckets))
    blocks = rows.select(*keys, "term", "segment", "most", "at", "tf", "ids", "lengths").withColumn("bucket", bucket)
    order = [*keys, "bucket", "term", "segment"]
    blocks.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(*keys, "bucket").parquet(f"{path}/blocks")
    terms = model.terms.select("term", "idf").withColumn("bucket", _bucket(buckets))
    terms.repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    told = [(by, float(model.avg_doc_length or 1), buckets, blocks.schema.json())]  # empty folders tell no schema
    model.terms.sparkSession.createDataFrame(told, "by string, avg_doc_length double, buckets int, schema string").write.mode("overwrite").parquet(f"{path}/about")
    return opened(model.terms.sparkSession, path)


def opened(spark: SparkSession, path: str) -> Postings:
    """Postings that ``write`` has kept."""
    about = spark.read.parquet(f"{path}/about").first()
    blocks = spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{path}/blocks")
    terms = spark.read.schema("term string, idf double, bucket int").parquet(f"{path}/terms")
    return Postings(blocks, terms, about["by"], about["avg_doc_length"], about["buckets"])


@dataclass
class Postings:
    blocks: DataFrame
    terms: DataFrame
    by: str | None
    avg_doc_length: float
    buckets: int

    def asked(self, part: list[tuple[object, list[str]]], id_type: str, classic: bool = False, k1: float = bm25.K1, b: float = bm25.B) -> tuple[DataFrame, list[int], list[str]]:
        """``query_id, term, weight`` of the terms that the index has (with their idf in the weight), their buckets and the terms."""
        spark = self.blocks.sparkSession
        rows = [(q, t, float(ts.count(t)), float(len(ts))) for q, ts in part for t in set(ts)]
        own = spark.createDataFrame(rows, f"query_id {id_type}, term string, tf double, length double").withColumn("bucket", _bucket(self.buckets))
        buckets = sorted(r[0] for r in own.select("bucket").distinct().collect())
        words = sorted({t for _, ts in part for t in ts})
        known = self._only(self.terms, buckets, words)
        weight = F.col("tf") if classic else bm25.weight(F.col("tf"), F.col("length"), F.lit(self.avg_doc_length), F.col("idf"), k1, b)
        met = known.join(F.broadcast(own.drop("bucket")), "term").select("query_id", "term", (weight * F.col("idf")).alias("weight"))
        held = spark.createDataFrame(met.collect(), f"query_id {id_type}, term string, weight double")  # a block of questions' own terms
        return held, buckets, words

    @staticmethod
    def _only(rows: DataFrame, buckets: list[int], words: list[str]) -> DataFrame:
        """Rows of some terms: folders by bucket, and row groups by term unless there are too many to list."""
        rows = rows.where(F.col("bucket").isin(buckets))
        return rows.where(F.col("term").isin(words)) if len(words) <= 500 else rows

    def _blocks(self, buckets: list[int], words: list[str], value: object) -> DataFrame:
        rows = self._only(self.blocks, buckets, words)
        if value is not None:
            if not self.by:
                raise ValueError("these postings weren't written by a column")
            rows = rows.where(F.col(self.by) == value)
        return rows

    def _members(self, value: object) -> DataFrame:
        """``(by,) segment, ids, lengths`` of the segments' documents, in the order of their places."""
        rows = self.blocks.where(F.col("bucket") == _MEMBERS)
        return (rows if value is None else rows.where(F.col(self.by) == value)).select(*self._place, "ids", "lengths")

    @property
    def _place(self) -> list[str]:
        return [*([self.by] if self.by else []), "segment"]

    def bounds(self, asked: DataFrame, buckets: list[int], words: list[str], value: object = None) -> DataFrame:
        """``query_id, (by,) segment, bound``: what a document of the segment can score at most."""
        most = self._blocks(buckets, words, value).select(*self._place, "term", "most").join(F.broadcast(asked), "term")
        return most.groupBy("query_id", *self._place).agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))

    def scored(self, asked: DataFrame, chosen: DataFrame, buckets: list[int], words: list[str], value: object = None) -> DataFrame:
        """``query_id, doc_id, score`` of all documents in chosen segments (``query_id, (by,) segment``)."""
        wanted = chosen.join(F.broadcast(asked), "query_id")
        met = self._blocks(buckets, words, value).drop("ids", "lengths").join(wanted, ["term", *self._place])
        met = met.select("query_id", "weight", *self._place, F.explode(F.arrays_zip("at", "tf")).alias("p"))
        of = self._members(value).select(*self._place, F.posexplode(F.arrays_zip("ids", "lengths")).alias("at", "d")).select(*self._place, "at", F.col("d.ids").alias("doc_id"), F.col("d.lengths").alias("length"))
        tf = F.col("tf").cast("double")
        part = tf * (bm25.K1 + 1) / (tf + bm25.K1 * (1 - bm25.B + bm25.B * F.col("length") / self.avg_doc_length))
        met = met.select("query_id", "weight", *self._place, "p.at", "p.tf").join(of, [*self._place, "at"])
        return met.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * part), 6).alias("score"))

    def best(self, asked: DataFrame, chosen: DataFrame, k: int, buckets: list[int], words: list[str], value: object = None) -> DataFrame:
        """``query_id, doc_id, score``: the k best documents of each question in each task, in its chosen segments
        (``query_id, (by,) segment``); what ``scored`` gives, less those that can't be among the k best."""
        own = [r for r in asked.collect() if r["query_id"] is not None]  # a block of questions' own terms
        ids, terms = list(dict.fromkeys(r["query_id"] for r in own)), sorted({r["term"] for r in own})
        number, term_no = {q: i for i, q in enumerate(ids)}, {t: i for i, t in enumerate(terms)}
        own.sort(key=lambda r: r["term"])
        first = np.searchsorted([term_no[r["term"]] for r in own], np.arange(len(terms) + 1))
        query, weight = np.array([number[r["query_id"]] for r in own], np.int64), np.array([r["weight"] for r in own], float)
        id_type = asked.schema["query_id"].dataType.simpleString()
        kind = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
        shared = self.blocks.sparkSession.sparkContext.broadcast((ids, terms, number, first, query, weight))
        place, n_place, avg = self._place, len(self._place), self.avg_doc_length

        def segment(parts: list[pa.RecordBatch], found: Best) -> None:
            _, terms, number, first, query, weight = shared.value
            asking = parts[0].column(n_place + 3)[0].as_py()  # the row without a term comes first
            if asking is None:
                return
            some = np.array(sorted(number[q] for q in asking if q in number), np.int64)
            row = np.full(len(number), -1)
            row[some] = np.arange(len(some))
            lists, counts = (pa.concat_arrays([p.column(n_place + i) for p in parts]) for i in (1, 2))
            code = pc.fill_null(pc.index_in(pa.concat_arrays([p.column(n_place) for p in parts]), value_set=pa.array(terms, pa.string())), 0).to_numpy()
            code, at = code[pc.list_parent_indices(lists).to_numpy()], pc.list_flatten(lists).to_numpy()
            if not len(at) or not len(some):
                return
            docs, length = (parts[0].column(n_place + i)[0].values for i in (4, 5))
            size = len(docs)
            part = _part(pc.list_flatten(counts).to_numpy().astype(float), length.to_numpy().astype(float)[at], avg)
            n = first[code + 1] - first[code]
            piece = np.cumsum(n) // bm25._PIECE
            scores = np.zeros(len(some) * size)
            for lo, hi in zip(*(lambda c: (c, [*c[1:], len(n)]))(np.searchsorted(piece, np.unique(piece)).tolist()), strict=True):
                m = n[lo:hi]
                where = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[code[lo:hi]], m)
                mine = row[query[where]]
                cell, add = mine * size + np.repeat(at[lo:hi], m), weight[where] * np.repeat(part[lo:hi], m)
                scores += np.bincount(cell[mine >= 0], add[mine >= 0], len(scores))
            found.add(docs, scores.reshape(len(some), size), some)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Best(shared.value[0], kind, k, 0.0)
            for parts in _stretches(batches, n_place):
                segment(parts, found)
            if (got := found.batch()) is not None:
                yield got

        heads = chosen.groupBy(*place).agg(F.collect_set("query_id").alias("queries"))
        blocks = self._blocks(buckets, words, value).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        blocks = blocks.join(F.broadcast(heads.select(*place)), place, "left_semi").select(*place, "term", "at", "tf", F.lit(None).cast(f"array<{id_type}>").alias("queries"), "ids", "lengths")
        heads = heads.join(self._members(value), place).select(*place, F.lit(None).cast("string").alias("term"), *(F.lit(None).cast("array<int>").alias(c) for c in ("at", "tf")), "queries", "ids", "lengths")
        rows = blocks.unionByName(heads).repartition(*place).sortWithinPartitions(*place, "term")
        return rows.mapInArrow(run, f"query_id {id_type}, doc_id {self._id_type}, score double")

    def search(self, queries: DataFrame, k: int = 10, classic: bool = False, value: object = None, seeds: int = 4, block: int = 200) -> DataFrame:
        """``query_id, doc_id, score, rank`` as ``bm25.Model.search`` gives, for questions (``query_id, tokens``); ``value`` is that of the
        ``by`` column. ``seeds`` segments are scored first."""
        id_type = queries.schema["query_id"].dataType.simpleString()
        out = []
        for part in bm25._blocks(queries, block):
            if any(ts for _, ts in part):
                out.append(self._search(part, id_type, k, classic, value, seeds))
        if not out:
            return queries.sparkSession.createDataFrame([], f"query_id {id_type}, doc_id {self._id_type}, score double, rank int")
        return bm25.ranked(reduce(DataFrame.unionByName, out), k)

    @property
    def _id_type(self) -> str:
        return self.blocks.schema["ids"].dataType.elementType.simpleString()

    def _search(self, part: list[tuple[object, list[str]]], id_type: str, k: int, classic: bool, value: object, seeds: int) -> DataFrame:
        asked, buckets, words = self.asked(part, id_type, classic)
        bounds = self.bounds(asked, buckets, words, value)
        order = ", ".join(self._place)
        numbered = bounds.withColumn("place", F.expr(f"row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, {order})"))
        first = settled(numbered.where(F.col("place") <= seeds).drop("place"), "seeds")
        seeded = settled(self.best(asked, first, k, buckets, words, value), "seeded")
        kth = bm25.ranked(seeded, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = bounds.join(F.broadcast(kth), "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - _SLACK)).drop("kth")
        rest = rest.join(F.broadcast(first.select("query_id", *self._place)), ["query_id", *self._place], "left_anti")
        return seeded.unionByName(self.best(asked, rest, k, buckets, words, value))
