"""Approximate nearest neighbours by an inverted file of quantised vectors, with exact re-ranking.

A coarse quantiser (k-means over a bounded sample of unit vectors) deals vectors to cells, which are folders; what is left of a vector
in its cell is quantised in ``parts`` pieces, one byte each. A search reads the cells nearest to each question. From tables of
products it has each vector's cosine up to the stored length of its quantisation error, so an upper bound; a vector is compared exactly
where that reaches the question's k-th score so far. A task keeps the best k of each question and hands on only those, so pairs of question
and vector are never rows, however loose the bounds are: inside the probed cells nothing is lost, and probing all cells is an exact search.

Every row is indexed, the sample only places the centres. A cell with a third of all rows is many files of one folder, read by many tasks.
Vectors that are null, zero, hold nulls or differ in length from the sample's are left out, as the exact search leaves them.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bm25 import ranked
from .topk import Best

CODES = 256
_SLACK = 1e-6  # scores are rounded to six digits before they are compared


def kmeans(rows: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres of some rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        near = nearest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, rows)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], rows[rng.integers(0, len(rows), len(centres))])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(rows[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Quantiser:
    """Centres of the cells, and for each piece of the residual its code words."""

    centres: np.ndarray
    bounds: list[int]
    words: list[np.ndarray]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, code and length of the error of unit vectors."""
        cell = nearest(unit, self.centres)
        rest = unit - self.centres[cell]
        code = np.empty((len(unit), len(self.words)), np.uint8)
        for m, w in enumerate(self.words):
            piece = rest[:, self.bounds[m] : self.bounds[m + 1]]
            code[:, m] = nearest(piece, w)
            piece -= w[code[:, m]]
        return cell, code, np.sqrt((rest * rest).sum(axis=1))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query, piece and code word their product."""
        out = np.zeros((len(queries), len(self.words), CODES))
        for m, w in enumerate(self.words):
            out[:, m, : len(w)] = queries[:, self.bounds[m] : self.bounds[m + 1]] @ w.T
        return out


def trained(sample: np.ndarray, cells: int, parts: int) -> Quantiser:
    centres = kmeans(sample, cells)
    rest = sample - centres[nearest(sample, centres)]
    bounds = np.linspace(0, sample.shape[1], parts + 1).astype(int).tolist()
    return Quantiser(centres, bounds, [kmeans(rest[:, a:b], CODES) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])


def _usable(vectors: DataFrame, id_col: str, vector_col: str, by: str | None) -> DataFrame:
    v = F.col(vector_col).cast("array<float>")
    return vectors.select(F.col(id_col).alias("doc_id"), v.alias("v"), *([F.col(by).alias("of")] if by else [F.lit(0).alias("of")])).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL) AND exists(v, x -> x <> 0)")


def write(vectors: DataFrame, path: str, cells: int = 64, parts: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = 20_000, by: str | None = None) -> Cells:
    """Train on at most ``sample`` vectors (those of the smallest hashes) and keep all of them under ``path``, by cell, and by a
    column that searches may filter by."""
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col, by)
    some = rows.select("v").orderBy(F.xxhash64("v")).limit(sample).collect()
    size = len(some[0]["v"]) if some else 1
    held = np.array([r["v"] for r in some if len(r["v"]) == size], float).reshape(-1, size)
    held = held if len(held) else np.ones((1, size))
    model = trained(held / np.sqrt((held * held).sum(axis=1, keepdims=True)), cells, min(parts, size))
    shared = spark.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                v = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
                cell, code, error = shared.value.encode(v / np.sqrt((v * v).sum(axis=1, keepdims=True)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), piece.column(2), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["doc_id", "v", "of", "cell", "code", "error"])

    coded = rows.where(F.size("v") == size).mapInArrow(encode, f"doc_id {id_type}, v array<float>, of {rows.schema['of'].dataType.simpleString()}, cell int, code binary, error double")
    coded.repartitionByRange("of", "cell", F.xxhash64("doc_id")).write.mode("overwrite").partitionBy("of", "cell").parquet(f"{path}/vectors")
    told = [(bytearray(pickle.dumps(model)), coded.schema.json())]  # empty folders tell no schema
    spark.createDataFrame(told, "quantiser binary, schema string").write.mode("overwrite").parquet(f"{path}/quantiser")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> Cells:
    """Cells that ``write`` has kept."""
    told = spark.read.parquet(f"{path}/quantiser").first()
    vectors = spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(f"{path}/vectors")
    return Cells(vectors, pickle.loads(bytes(told["quantiser"])))


class _Bounded:
    """Candidates of each query whose upper bound reaches the k-th lower bound so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor, self.held, self.size = k, np.full(queries, -np.inf), [], 0

    def add(self, q: np.ndarray, ids: pa.Array, cell: int, low: np.ndarray, high: np.ndarray) -> None:
        """``low`` and ``high`` have a row for each of the queries ``q`` and a column for each id."""
        i, d = np.nonzero(high >= self.floor[q][:, None])
        if len(i):
            self.held.append((q[i], ids.take(pa.array(d)), np.full(len(i), cell, np.int32), low[i, d], high[i, d]))
            self.size += len(i)
            if self.size > 4 * self.k * len(self.floor) + 200_000:
                self.cut()

    def cut(self) -> None:
        q, cell, low, high = (np.concatenate([h[j] for h in self.held]) for j in (0, 2, 3, 4))
        ids = pa.concat_arrays([h[1] for h in self.held])
        order = np.lexsort([-low, q])
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[place == self.k - 1]
        self.floor[q[last]] = low[last]
        keep = np.flatnonzero(high >= self.floor[q])
        self.held = [(q[keep], ids.take(pa.array(keep)), cell[keep], low[keep], high[keep])]
        self.size = len(keep)


@dataclass
class Cells:
    vectors: DataFrame
    quantiser: Quantiser

    def _of(self, value: object) -> DataFrame:
        return self.vectors if value is None else self.vectors.where(F.col("of") == value)

    def candidates(self, queries: DataFrame, part: list[tuple[object, list[float]]], k: int, probes: int | None, value: object = None) -> DataFrame:
        """``query_id, doc_id, cell, low, high`` with all of the k best vectors of the probed cells, from
        the codes alone. Where bounds are loose these are many rows, so ``search`` decides by the vectors in the task."""
        unit = np.array([v for _, v in part], float)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        near = unit @ self.quantiser.centres.T
        probed = np.argsort(-near, axis=1, kind="stable")[:, : probes or near.shape[1]]
        asking = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
        ids = [i for i, _ in part]
        id_type = queries.schema["query_id"].dataType.simpleString()
        kind = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
        shared = self.vectors.sparkSession.sparkContext.broadcast((ids, near, asking, self.quantiser.tables(unit)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, near, asking, tables = shared.value
            found = _Bounded(len(ids), k)
            parts = np.arange(tables.shape[1])
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    piece = batch.slice(at, 2048)
                    cell = piece.column(1).to_numpy()
                    code = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint8).reshape(piece.num_rows, len(parts))
                    error = piece.column(3).to_numpy()
                    for c in np.unique(cell).tolist():
                        rows, q = np.flatnonzero(cell == c), asking[c]
                        for lo in range(0, len(q), 64):
                            some = q[lo : lo + 64]
                            product = near[some, c][:, None] + tables[some][:, parts[None, :], code[rows]].sum(axis=2)
                            found.add(some, piece.column(0).take(pa.array(rows)), c, product - error[rows] - 1e-9, product + error[rows] + 1e-9)
            if found.held:
                found.cut()
                q, d, cell, low, high = found.held[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind).take(pa.array(q)), d, pa.array(cell), pa.array(low), pa.array(high)], ["query_id", "doc_id", "cell", "low", "high"])

        rows = self._of(value).where(F.col("cell").isin(sorted(asking))).select("doc_id", "cell", "code", "error")
        return rows.mapInArrow(run, f"query_id {id_type}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, cell int, low double, high double")

    def nearest(self, queries: DataFrame, part: list[tuple[object, list[float]]], k: int, probes: int | None, value: object = None) -> DataFrame:
        """``query_id, doc_id, score``: the k best vectors of the probed cells in each task for some queries."""
        unit = np.array([v for _, v in part], float)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        near = unit @ self.quantiser.centres.T
        probed = np.argsort(-near, axis=1, kind="stable")[:, : probes or near.shape[1]]
        asking = {int(c): np.flatnonzero((probed == c).any(axis=1)) for c in np.unique(probed)}
        ids = [i for i, _ in part]
        id_type = queries.schema["query_id"].dataType.simpleString()
        kind = {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())
        shared = self.vectors.sparkSession.sparkContext.broadcast((ids, unit, near, asking, self.quantiser.tables(unit)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, unit, near, asking, tables = shared.value
            best = Best(ids, kind, k)
            for batch in batches:
                cells = batch.column(1).to_numpy()
                for c in np.unique(cells).tolist():
                    rows, q = np.flatnonzero(cells == c), asking[c]
                    for at in range(0, len(rows), 1024):
                        piece = batch.take(pa.array(rows[at : at + 1024]))
                        v = piece.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, unit.shape[1]).astype(float)
                        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
                        code = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint8).reshape(piece.num_rows, -1)
                        error = piece.column(3).to_numpy()
                        for lo in range(0, len(q), 64):
                            some = q[lo : lo + 64]
                            if np.isinf(best.floor[some]).all():  # nothing to beat yet
                                best.add(piece.column(0), unit[some] @ v.T, some)
                                continue
                            most = near[some, c][:, None] + error
                            for m in range(tables.shape[1]):
                                most += tables[some, m][:, code[:, m]]
                            open_ = most >= best.floor[some][:, None] - _SLACK
                            mine, there = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                            if len(mine):
                                best.add(piece.column(0).take(pa.array(there)), unit[some[mine]] @ v[there].T, some[mine])
            got = best.batch()
            if got is not None:
                yield got

        rows = self._of(value).where(F.col("cell").isin(sorted(asking))).select("doc_id", "cell", "code", "error", "v")
        return rows.mapInArrow(run, f"query_id {id_type}, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = 8, value: object = None, block: int = 1000) -> DataFrame:
        """``query_id, doc_id, score, rank`` as ``dense.search`` gives, from the ``probes`` cells nearest to each question (``query_id,
        vector``), or from all of them (None); ``value`` is that of the ``by`` column. Questions without a usable vector of the same length find nothing."""
        size = self.quantiser.bounds[-1]
        usable = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector"))
        usable = usable.where((F.size("vector") == size) & F.expr("NOT exists(vector, x -> x IS NULL) AND exists(vector, x -> x <> 0)"))
        n = max(1, -(-usable.count() // block))
        out = []
        for i in range(n):
            mine = usable.where(F.coalesce(F.pmod(F.xxhash64("query_id"), F.lit(n)), F.lit(0)) == i)
            part = [(r["query_id"], r["vector"]) for r in mine.collect()]
            if not part:
                continue
            out.append(self.nearest(usable, part, k, probes, value))
        if not out:
            kinds = queries.schema["query_id"].dataType.simpleString(), self.vectors.schema["doc_id"].dataType.simpleString()
            return self.vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, doc_id {kinds[1]}, score double, rank int")
        return ranked(reduce(DataFrame.unionByName, out), k)
