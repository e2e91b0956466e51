"""Periodic runs of words by suffix automata.

A run is a stretch of words with smallest period q (words q apart are equal) that no neighbour extends; those of at least
``min_length`` words and ``min_exponent`` periods are found. Each state of a text's suffix automaton stands for word strings
that end at the same positions. Position sets are merged up the suffix links, the smaller one into the larger, in order: when a position
comes between neighbours, a distance to one of them that doesn't exceed the state's length is a square, because the state's
longest string then overlaps or touches itself at that distance. That string can't be prolonged to the left with both ends, so
the square's stretch begins where the run does, and it is the whole run where the next words differ; every run has such a pair, since
its last period's shift is one. Of equal stretches the smallest period counts.

Only words in some string of ``max(1, min_length - floor(min_length / min_exponent))`` words that occurs twice in its text can be in a run, because
a run repeats that much of itself one period on. Those stretches, found by sorting hashes, are the automata's input; other texts have none.

Spark deals texts to tasks; an automaton holds one stretch of one text, about 600 bytes a word of it. Texts are read in slices, and for each word
three numbers are held.

Defined cases: a null or empty text, or one without words, has no runs and collapses to the empty text; rows stay as they are,
repeated ones too, null ids too; an empty table gives an empty result; other columns are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts
from .wordhash import in_parts, slices, windows

RUN = "struct<start:long,length:long,period:long>"
_BLOCK = 2048


class Positions:
    """Ordered positions in blocks, so that an insertion moves few of them."""

    __slots__ = ("blocks", "size")

    def __init__(self, one: int) -> None:
        self.blocks, self.size = [[one]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Insert and return the neighbours (-1 where there is none)."""
        blocks = self.blocks
        k = 0
        if len(blocks) > 1:
            lo, hi = 0, len(blocks) - 1
            while lo < hi:  # the last block that begins at or before x
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if blocks[mid][0] <= x else (lo, mid - 1)
            k = lo
        block = blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else -1
        after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        block.insert(i, x)
        self.size += 1
        if len(block) > _BLOCK:
            blocks[k : k + 1] = [block[: _BLOCK // 2], block[_BLOCK // 2 :]]
        return before, after


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of each state, and the state of each prefix."""
    length, link, step, ends = [0], [-1], [{}], []
    last = 0
    for c in words:
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
        ends.append(cur)
    return length, link, ends


def runs_of(words: list[int], min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, in order."""
    n = len(words)
    length, link, ends = automaton(words)
    held: list[Positions | None] = [None] * len(length)
    for i, state in enumerate(ends):
        held[state] = Positions(i)
    best: dict[tuple[int, int], int] = {}
    for state in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        mine, up = held[state], link[state]
        if not state or up <= 0:  # the root's string is empty
            held[state] = None
            continue
        other, held[state] = held[up], None
        if other is None:
            held[up] = mine
            continue
        if mine.size > other.size:
            mine, other = other, mine
        size, last = length[up], -1
        for x in mine:
            before, after = other.add(x)
            if before == last:  # neighbours in their own set already, where they share a longer string
                before = -1
            last = x
            for a, b in ((before, x), (x, after)):
                d = b - a
                # a square's stretch has size + d words; it is maximal where the next words differ
                if a >= 0 and 0 < d <= size and size + d >= min_length and size >= (min_exponent - 1) * d and (b + 1 == n or words[a + 1] != words[b + 1]):
                    at = (a - size + 1, size + d)
                    best[at] = min(d, best.get(at, d))
        held[up] = other
    return sorted((start, size, q) for (start, size), q in best.items())


def repeated_stretches(h: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """``(text, first word, end)`` of the longest stretches of words inside strings of ``width`` words that their text has twice."""
    every = windows(h, width)
    text = np.searchsorted(bounds, np.arange(len(every)), side="right") - 1
    inside = np.arange(len(every)) + width <= bounds[text + 1]
    at = np.flatnonzero(inside)
    key = every[at] ^ (text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = at[twice]
    if not len(starts):
        return
    new = np.concatenate([[True], (np.diff(starts) > width) | (text[starts[1:]] != text[starts[:-1]])])
    first = np.flatnonzero(new)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(starts)], strict=True):
        t = int(text[starts[lo]])
        yield t, int(starts[lo] - bounds[t]), int(starts[hi - 1] + width - bounds[t])


def text_runs(raws: list[bytes], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in raws]
    width = max(1, min_length - min_length // min_exponent)
    for at, h, bounds in in_parts(raws):
        for text, lo, hi in repeated_stretches(h, bounds, width):
            begin = int(bounds[text])
            _, ids = np.unique(h[begin + lo : begin + hi], return_inverse=True)
            out[at + text] += [(lo + s, n, q) for s, n, q in runs_of(ids.tolist(), min_length, min_exponent)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(raw: bytes, found: list[tuple[int, int, int]], most: int = 1 << 22) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    out, at = [], 0
    for start, end, _ in slices(raw, most):
        n = len(start)
        kept = np.ones(n, bool)
        for s, size, q in found:
            kept[max(s + q - at, 0) : max(s + size - at, 0)] = False
        at += n
        lo, size = start[kept], (end - start)[kept] + 1
        if not len(lo):
            continue
        begin = np.cumsum(size) - size
        here = int(start[0])
        part = np.frombuffer(raw, np.uint8, int(end[-1]) - here, here)
        took = np.append(part, np.uint8(32))[np.repeat(lo - here - begin, size) + np.arange(int(size.sum()))]
        took[begin + size - 1] = 32
        out.append(took.tobytes())
    return b"".join(out)[:-1]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """``doc_id, runs, collapsed``: runs in order of start, then period; the collapsed text in bytes."""
    source = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                raws = batch.column(1).to_pylist()
                found = text_runs(raws, min_length, min_exponent)
                kept = [collapsed(raw, r) if r else b" ".join(raw.split()) if len(raw) < 1 << 20 else collapsed(raw, r) for raw, r in zip(raws, found, strict=True)]
                rows = pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in found], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(kept, pa.binary())], ["doc_id", "runs", "collapsed"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed binary")


def strongest(found: str) -> Column:
    """Of a column of runs the one with the greatest exponent, compared exactly; ties go to the smaller start, then period."""
    more = "l.length * r.period > r.length * l.period"
    same = "l.length * r.period = r.length * l.period"
    order = f"CASE WHEN {more} THEN -1 WHEN {same} AND (l.start < r.start OR l.start = r.start AND l.period < r.period) THEN -1 WHEN {same} AND l.start = r.start AND l.period = r.period THEN 0 ELSE 1 END"
    return F.expr(f"get(array_sort({found}, (l, r) -> {order}), 0)")


def periodic_copy(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with known runs, for tests of the search: where crc32 of the id, h, ends in 0, the words from place ``g % n`` on, g
    being the other digits of h, repeat their first ``1 + floor((n - g % n) / (3 + g % 8))``. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    made = (
        "array_join(transform(sequence(0, size(w) - 1), i -> element_at(w, cast(IF(i < g % size(w), i, g % size(w) + "
        "(i - g % size(w)) % (1 + floor((size(w) - g % size(w)) / (3 + g % 8)))) AS int) + 1)), ' ')"
    )
    held = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"))
    held = held.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"))).withColumn("g", F.expr("h div 10"))
    return held.select("doc_id", F.when(F.size("w") > 0, F.expr(made)).otherwise(F.col("text")).alias("text"))
