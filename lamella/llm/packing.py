"""Best-fit packing of tokenised documents into sequences, by vector best fit.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths: at most
``capacity`` numbers, whatever the size of the corpus. Lengths are placed from the longest down. A bin has
three capacities left (tokens, documents, attention cost), and a length goes into the group of equal
bins that fits under every one of them and scores best: by the norm of what would remain, or by the
weighted dot product of the need and the residual's direction (the best aligned bin, the tightest of equals). A plan step says "the r0-th to r1-th piece of length L go, q to a
sequence, into sequences s, s+1, ... at offset o"; each piece finds its step from its rank among pieces of its
length, and ranks come from counts in salted buckets, never from one task for one length.

Defined cases: null and empty texts are a document of the end token alone; ids may be null or repeat (each row
is a document of its own); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, texts, unused
from .wordids import WordTokenizer

PIECE_SCHEMA = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and vocabulary."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of at most ``capacity`` tokens; only longer documents are cut."""
    source = texts(docs, id_col, text_col)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lamella.llm.packing import _tokenizer  # the worker's own module holds the memory

        tok = _tokenizer(tokenizer)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    owner, rows = [], []
                    for i, ids in enumerate(tok.encode(part.column(1).to_pylist())):
                        data = ids.astype("<u4").tobytes() + end
                        for k, b in enumerate(range(0, len(data), step)):
                            cut = data[b : b + step]
                            owner.append(i)
                            rows.append((k, b // 4, len(cut) // 4, zlib.crc32(cut)))
                    cols = np.array(rows, np.int64).reshape(-1, 4)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(owner)), pa.array(cols[:, 0].astype(np.int32)), *(pa.array(cols[:, j]) for j in (1, 2, 3))],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
        finally:
            tok.forget()  # a worker outlives its task and serves other stages

    return source.mapInArrow(run, PIECE_SCHEMA.format(id=source.schema["doc_id"].dataType.simpleString()))


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. ``documents`` and ``attention`` (sum of squared lengths) default to values that
    tokens alone already imply, so that they cost no sequence; lower them to make them bind."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.int64)


def plan(counts: dict[int, int], limits: Limits) -> np.ndarray:
    """Steps ``(length, r0, r1, q, sequence, offset)`` that place ``counts[length]`` pieces of each length.

    Bins of equal residual and neighbouring numbers are one group, so the work follows the number of
    distinct lengths, not of pieces.
    """
    full = limits.vector
    scale = np.array(limits.weights) / full
    steps: list[tuple[int, ...]] = []
    left = np.zeros((64, 3), np.int64)  # residual vectors, one for each group
    first, size = np.zeros(64, np.int64), np.zeros(64, np.int64)
    used = 0
    n_bins = 0

    def add(residual: np.ndarray, at: int, bins: int) -> None:
        nonlocal left, first, size, used
        if residual[0] <= 0:
            return
        if used == len(size):
            keep = np.flatnonzero(size[:used] > 0)
            used = len(keep)
            grown = max(64, 2 * used)
            new_left, new_first, new_size = np.zeros((grown, 3), np.int64), np.zeros(grown, np.int64), np.zeros(grown, np.int64)
            new_left[:used], new_first[:used], new_size[:used] = left[keep], first[keep], size[keep]
            left, first, size = new_left, new_first, new_size
        left[used], first[used], size[used] = residual, at, bins
        used += 1

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = np.flatnonzero((size[:used] > 0) & (left[:used] >= need).all(axis=1))
            if len(fits):
                rest = np.sqrt((((left[fits] - need) * scale) ** 2).sum(axis=1))
                if limits.rule == "norm":
                    g = int(fits[np.argmin(rest)])  # the tightest
                else:  # the best aligned, and the tightest among equals
                    have = left[fits] * scale
                    aligned = have @ (need * scale) / np.sqrt((have**2).sum(axis=1))
                    g = int(fits[np.lexsort([rest, -np.round(aligned / aligned.max(), 9)])[0]])
                residual, at, bins = left[g].copy(), int(first[g]), int(size[g])
                size[g] = 0
            else:
                per = int((full // need).min())
                residual, at, bins = full.copy(), n_bins, -(-todo // per)
                n_bins += bins
            q = min(int((residual // need).min()), todo)
            whole = min(bins, todo // q)
            steps.append((length, rank, rank + whole * q, q, at, int(full[0] - residual[0])))
            add(residual - q * need, at, whole)
            todo, rank = todo - whole * q, rank + whole * q
            if bins > whole:
                add(residual, at + whole, bins - whole)
                if whole and todo and todo < q:  # the last pieces share the next bin of this group
                    continue
    return np.array(steps, np.int64).reshape(-1, 6)


def pack(cut: DataFrame, limits: Limits | None = None, buckets: int = 64, per_bucket: int = 1_000_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, start, length, ids_crc32``). The pieces of one length are
    ranked in at least ``buckets`` buckets, and in more where there are over ``per_bucket`` pieces for each."""
    limits = limits or Limits()
    spark = cut.sparkSession
    names = cut.columns
    salt = unused("salt", names)
    kept = stored(cut.withColumn(salt, F.monotonically_increasing_id()), "pieces")  # tokenised once; the salt parts equal rows
    counts = {int(r[0]): int(r[1]) for r in kept.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(buckets, -(-sum(counts.values()) // per_bucket))
    salted = kept.withColumn("bucket", F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    by_bucket = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = by_bucket.selectExpr("length AS of_length", "bucket AS of_bucket", "sum(n) OVER (PARTITION BY length ORDER BY bucket) - n AS before")
    steps = plan(counts, limits)
    steps = steps[np.lexsort([steps[:, 1], steps[:, 0]])]
    shared = spark.sparkContext.broadcast(steps)

    ranked = salted.selectExpr("*", f"row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece, ids_crc32, {salt}) - 1 AS place")
    ranked = ranked.join(before, (F.col("length") == F.col("of_length")) & (F.col("bucket") == F.col("of_bucket")))
    ranked = ranked.select(*names, (F.col("before") + F.col("place")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        base = int(table[:, 1:3].max(initial=0)) + 1
        keys = table[:, 0] * base + table[:, 1]
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
                row = table[np.searchsorted(keys, length * base + rank, side="right") - 1]
                k = rank - row[:, 1]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(row[:, 4] + k // row[:, 3]), pa.array(row[:, 5] + k % row[:, 3] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
