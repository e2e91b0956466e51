"""Dense vectors: cosine as an expression, exact k-NN of a stated query set, and a default embedder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import ranked
from .mask import Mask, collected
from .topk import Best


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda z, x: z + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """The offline default for a text embedder: counts of hashed tokens. A model goes in the same place, as a
    pandas UDF from text to array<float>."""
    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("float"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4000, filters: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k vectors of highest cosine for each query (``query_id, vector``).

    Queries are broadcast in blocks of about ``block`` vectors; a task multiplies its batches by a block and keeps the best k of
    each query while they stream by. A vector that is null, zero, has null elements or another length than the query's matches nothing; without queries
    the result is empty. ``filters`` (``query_id, column, value``) keep vectors out of one query's search.
    """
    others = [c for c in vectors.columns if c not in (id_col, vector_col, "doc_id", "v")] if filters is not None else []
    rows = vectors.select(F.col(id_col).alias("doc_id"), F.col(vector_col).cast("array<float>").alias("v"), *others).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["doc_id"].dataType.simpleString()
    query_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kinds[0], pa.string())
    n = max(1, -(-queries.count() // block))
    out = None
    for i in range(n):
        some = queries.where(F.coalesce(F.pmod(F.xxhash64("query_id"), F.lit(n)), F.lit(0)) == i).collect()
        by_size: dict[int, list[tuple[object, list[float]]]] = {}
        for r in some:
            if r["vector"] and None not in r["vector"]:
                by_size.setdefault(len(r["vector"]), []).append((r["query_id"], r["vector"]))
        for size, part in sorted(by_size.items()):
            q = np.array([v for _, v in part], float)
            length = np.sqrt((q * q).sum(axis=1, keepdims=True))
            columns, wanted = collected(filters, [i for i, _ in part], rows)
            shared = vectors.sparkSession.sparkContext.broadcast(([i for i, _ in part], q / np.where(length > 0, length, np.nan), Mask(columns, [i for i, _ in part], wanted)))

            def run(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
                ids, q, mask = shared.value
                best = Best(ids, query_type, k)
                step = min(2048, max(64, (1 << 19) // len(ids)))  # vectors at a time, so that a table of scores stays small
                for batch in batches:
                    for at in range(0, batch.num_rows, step):
                        piece = batch.slice(at, step)
                        v = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
                        norm = np.sqrt((v * v).sum(axis=1))
                        score = (q @ v.T) / np.where(norm > 0, norm, np.nan)
                        allowed = mask(piece.columns[2:])
                        best.add(piece.column(0), score if allowed is None else np.where(allowed, score, np.nan))
                got = best.batch()
                if got is not None:
                    yield got

            found = rows.where(F.size("v") == size).select("doc_id", "v", *columns).mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return ranked(out, k)
