"""Removal of long repeated byte strings, by distributed prefix doubling.

``doubled_starts`` is the plain method: a row for each position with the rank of its first 16 bytes; ranks that occur once
drop out, and the others are paired with the rank one string further on and ranked anew, for 32, 64, ... bytes, until
the whole length is reached. It needs several shuffles of every position of the corpus. ``repeated_starts``, which
``deduplicate`` takes by default, gives the same with far less:

Every start position of a string of ``length`` bytes is ranked by an ever longer part of its string; a
position whose rank is unique drops out, and what is still tied when the whole length is reached is
repeated. Two things keep this affordable on a corpus:

* Positions travel in runs. The start ``p`` is represented by its anchor, the least hashed 16-gram among
  the ``WINDOW`` ones from ``p`` on. The anchor depends on the string alone, so equal strings have their
  anchor at the same distance, and about one position in 128 is an anchor. All starts of a run share the
  bytes behind the anchor (the core); their union is the run's extent.
* Runs are split only while undecided. A run whose core occurs once holds no repeated string; one whose
  whole extent occurs twice holds nothing else; any other is cut into runs of ``STEPS[i]`` starts, whose
  cores are longer: the rank of the old core paired with the hash of the new one is sorted and ranked anew.
  At runs of one start, core, extent and string are the same.

Ranks are 64-bit hashes, used in pairs (core, extent) of one group; that equal ranks stand for equal strings is
not checked byte by byte. Matching text is never compared in groups: ranks are counted with map-side aggregation
and joined back, the hot ones by broadcast, so a passage that fills a third of the corpus is no large group. Long
texts are read in slices of a mebibyte, so memory doesn't follow their length.

Defined cases: null text is empty; texts shorter than ``length`` keep every byte; a text may match itself,
overlaps count; rows that repeat entirely count as copies of each other; null ids are kept; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, per_batch, stored, texts

GRAM, WINDOW = 16, 256
STEPS = (256, 16, 1)
_LOW = np.uint64((1 << 24) - 1)
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, by in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, np.uint64(by))
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """Hashes of any substring of one text, from prefix sums."""

    def __init__(self, raw: bytes) -> None:
        n = len(raw)
        self.up, down = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(raw, np.uint8)] * down[:n], dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.prefix[end] - self.prefix[start]) * self.up[start])

    def grams(self, lo: int, hi: int) -> np.ndarray:
        return _mix((self.prefix[lo + GRAM : hi + GRAM] - self.prefix[lo:hi]) * self.up[lo:hi])


def runs(h: Hashes, n: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors and, for each, the first and last start that it stands for."""
    m = n - length + 1
    if m <= 0:
        return (np.empty(0, np.int64),) * 3
    size = m + WINDOW - 1
    x = (h.grams(0, size) & ~_LOW) | np.arange(size, dtype=np.uint64)
    step = 1
    while step < WINDOW:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    at = (x & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    return at[first], first, np.append(first[1:], m) - 1


def _ranks(h: Hashes, anchor: np.ndarray, before: np.ndarray, block: np.ndarray, size: int, near: np.ndarray, far: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the cores and extents of runs: starts at distance near..far before the anchor, inside the
    run of ``size`` starts that begins at distance ``block``; ``before`` is the rank that ties them so far."""
    core = h.of(anchor - block, anchor - (block + size - 1) + length)
    core = _mix(core + _mix(before + block.astype(np.uint64) + np.uint64(size)))
    extent = h.of(anchor - far, anchor - near + length)
    return core, _mix(extent + _mix(core + near.astype(np.uint64) * np.uint64(512) + far.astype(np.uint64)))


_ROW = "key long, anchor long, near int, far int, core long, extent long, open boolean"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _batch(key: np.ndarray, anchor: np.ndarray, near: np.ndarray, far: np.ndarray, core: np.ndarray, extent: np.ndarray, opened: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(key), pa.array(anchor), pa.array(near.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(extent.view(np.int64)), pa.array(opened)]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _cat(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
    return _batch(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else None


def _first_runs(docs: DataFrame, length: int) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for begin in range(0, len(raw) - length + 1, _SLICE):
                part = raw[begin : begin + _SLICE + length - 1]
                h = Hashes(part)
                a, lo, hi = runs(h, len(part), length)
                core, extent = _ranks(h, a, np.zeros(len(a), np.uint64), np.zeros(len(a), np.int64), WINDOW, a - hi, a - lo, length)
                parts.append((np.full(len(a), key), a + begin, a - hi, a - lo, core, extent, np.ones(len(a), bool)))
        return _cat(parts)

    return docs.select("key", "raw").mapInArrow(per_batch(one), _ROW)


def _settle(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Count ranks. Returns the repeated runs and, for what stays open, one row for each distinct extent."""
    rows = stored(rows, "runs")
    tied = stored(rows.groupBy("core").agg(F.count("*").alias("of_core")).where("of_core > 1"), "cores")
    rows = stored(join_hot(rows, tied, "core", "of_core", rows.count()).select(*_NAMES), "tied")
    total = rows.count()
    kinds = rows.groupBy("core", "extent").agg(F.count("*").alias("n"), F.min(F.struct("key", "anchor", "near", "far", "open")).alias("one"))
    kinds = stored(kinds.select("core", "extent", "n", "one.*"), "extents")
    twice = kinds.where("n > 1").select("extent", F.col("core").alias("its_core"), "n")
    repeated = join_hot(rows.where("open"), twice, "extent", "n", total).where("core = its_core").select("key", (F.col("anchor") - F.col("far")).alias("lo"), (F.col("anchor") - F.col("near")).alias("hi"))
    undecided = stored(kinds.groupBy("core").agg(F.count("*").alias("n_kinds"), F.max(F.expr("n = 1 AND open")).alias("some")).where("some"), "undecided")
    rest = join_hot(kinds, undecided, "core", "n_kinds", total).withColumn("open", F.expr("open AND n = 1"))
    return repeated, rest.select("key", "anchor", "near", "far", "core", "open")


def _contexts(docs: DataFrame, rest: DataFrame, length: int) -> DataFrame:
    """The bytes of each run that is still looked at: from its first start to its last string's end."""
    wanted = rest.groupBy("key").agg(F.collect_list(F.struct("anchor", "near", "far", "core", "open")).alias("runs"))
    schema = "key long, anchor long, near int, far int, core long, open boolean, bytes binary"

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for key, raw, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for r in wanted:
                out.append((key, r["anchor"], r["near"], r["far"], r["core"], r["open"], raw[r["anchor"] - r["far"] : r["anchor"] - r["near"] + length]))
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    joined = docs.select("key", "raw").join(wanted.hint("shuffle_hash").withColumnRenamed("key", "of"), F.col("key") == F.col("of")).select("key", "raw", "runs")
    return stored(joined.mapInArrow(per_batch(one), schema), "contexts")


def _split(contexts: DataFrame, size: int, length: int) -> DataFrame:
    """Cut runs into runs of ``size`` starts; ``core`` of the context is the rank so far."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for key, anchor, near, far, core, opened, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block = np.arange(near // size * size, far + 1, size)
            lo, hi = np.maximum(block, near), np.minimum(block + size - 1, far)
            before = np.full(len(block), core & _MASK, np.uint64)
            h, shift = Hashes(raw), np.full(len(block), far)  # the anchor's place in these bytes
            c, e = _ranks(h, shift, before, block, size, lo, hi, length)
            parts.append((np.full(len(block), key), np.full(len(block), anchor), lo, hi, c, e, np.full(len(block), opened)))
        return _cat(parts)

    return contexts.select("key", "anchor", "near", "far", "core", "open", "bytes").mapInArrow(per_batch(one), _ROW)


def _narrowed(contexts: DataFrame, rest: DataFrame, length: int) -> DataFrame:
    """The part of each context that belongs to a run still looked at, with that run's rank."""
    runs_of = rest.selectExpr("key AS k", "anchor AS a", "near AS n", "far AS f", "core AS c", "open AS o")
    both = contexts.join(runs_of.hint("shuffle_hash"), F.expr("key = k AND anchor = a AND n >= near AND f <= far"))
    part = F.expr(f"substring(bytes, far - f + 1, f - n + {length})")
    return both.select("key", "anchor", F.col("n").alias("near"), F.col("f").alias("far"), F.col("c").alias("core"), F.col("o").alias("open"), part.alias("bytes"))


def repeated_starts(docs: DataFrame, length: int) -> DataFrame:
    """``key, lo, hi``: runs of starts whose string of ``length`` bytes starts elsewhere too."""
    if length < WINDOW + GRAM:
        raise ValueError(f"strings must have {WINDOW + GRAM} bytes at least")
    repeated, rest = _settle(_first_runs(docs, length))
    found = [repeated]
    contexts = _contexts(docs, rest, length)
    for i, size in enumerate(STEPS[1:]):
        repeated, rest = _settle(_split(contexts, size, length))
        found.append(repeated)
        if i + 2 < len(STEPS):
            contexts = _narrowed(contexts, rest, length)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def doubled_starts(docs: DataFrame, length: int) -> DataFrame:
    """``key, lo, hi`` as ``repeated_starts``, a row for each start, by plain prefix doubling over all positions."""
    if length < GRAM:
        raise ValueError(f"strings must have {GRAM} bytes at least")

    def first(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for begin in range(0, len(raw) - GRAM + 1, _SLICE):
                part = raw[begin : begin + _SLICE + GRAM - 1]
                rank = Hashes(part).grams(0, len(part) - GRAM + 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), key)), pa.array(np.arange(begin, begin + len(rank))), pa.array(rank)], ["key", "pos", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from first(batch)

    def tied(ranks: DataFrame) -> DataFrame:
        ranks = stored(ranks, "ranks")
        again = ranks.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1")
        return stored(join_hot(ranks, stored(again, "again"), "rank", "n", ranks.count()).select("key", "pos", "rank"), "positions")

    alive, size = tied(docs.select("key", "raw").mapInArrow(run, "key long, pos long, rank long")), GRAM
    while size < length:
        step = min(size, length - size)
        later = alive.select(F.col("key").alias("of"), (F.col("pos") - step).alias("at"), F.col("rank").alias("next"))
        paired = alive.join(later, F.expr("key = of AND pos = at")).select("key", "pos", F.xxhash64("rank", "next").alias("rank"))
        alive, size = tied(paired), size + step
    return alive.select("key", F.col("pos").alias("lo"), F.col("pos").alias("hi"))


def cut(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Remove every byte of strings that start in lo..hi: removed bytes, maximal runs, and what is left."""
    left, n_spans, end, at = [], 0, -1, 0
    for lo, hi in sorted(spans):
        if lo > end:
            left.append(raw[at:lo])
            n_spans += 1
        end = max(end, hi + length)
        at = end
    left.append(raw[at:])
    kept = b"".join(left)
    return len(raw) - len(kept), n_spans, kept


def deduplicate(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", every_position: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` for every row; kept is what is left, as bytes. ``every_position`` takes the plain
    method instead of the one by runs; results are the same."""
    rows = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("doc_id", "raw"))
    # rows that repeat entirely: one stands for all in the search, and every start of theirs is repeated
    again = stored(rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("of")), "again")
    same = F.col("key") == F.col("of")
    searched = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates(["key"]))
    found = (doubled_starts if every_position else repeated_starts)(searched, length).distinct().join(again, same, "left_anti")
    spans = found.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).select(F.col("key").alias("of"), "spans", F.lit(False).alias("whole"))
    spans = stored(spans.unionByName(again.select("of", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), F.lit(True).alias("whole"))), "spans")  # plain, so that a hot key can be split
    joined = rows.join(spans.hint("shuffle_hash"), same, "left").select("doc_id", "raw", "spans", "whole")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for raw, spans, whole in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                at = [(0, len(raw) - length)] if whole and len(raw) >= length else [(s["lo"], s["hi"]) for s in spans or ()]
                got.append(cut(raw, at, length))
            sizes = np.array([len(x) for x in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInArrow(run, schema)
