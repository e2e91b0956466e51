"""Benchmark decontamination by latent semantic retrieval.

Passages (windows of words) are TF-IDF vectors over hashed words. A randomised SVD, with its products summed
over Spark tasks, gives a latent space; every passage of the corpus is projected, and benchmark items whose
cosine with a passage reaches ``min_cosine`` are candidates. A candidate is kept if the longest common
subsequence of words covers ``min_lcs`` of the item and enough of the answer (a given column, or the item's
rarest words) occurs in the passage's surroundings, which also finds paraphrases that drop or change words.

A space of fixed rank keeps little of some items once there are more of them than dimensions. So places where a
document shares ``SEED`` consecutive words with an item are candidates too, whatever the cosine; verbatim copies
never depend on the space. An item shorter than ``min_words`` words is found by its whole run of words only.

The SVD is fitted on all passages of the benchmark and of all documents; document frequencies are counted over all
documents, and every passage is searched. Benchmark items are broadcast in blocks of ``block`` items, so that what is
broadcast is bounded.

Defined cases: null and empty texts hold nothing; null and wordless items match nothing; ids may be null or repeat; empty tables give
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .wordhash import hashed

DIMS, RANK, EXTRA = 1 << 15, 256, 16
WINDOW, STRIDE = 48, 16
SEED = 4
_PUNCTUATION = b".,;:!?\"'()[]"
_BLANK = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def plain(raw: bytes) -> bytes:
    """Lower case, punctuation as blanks."""
    return raw.lower().translate(_BLANK)


def words(raw: bytes) -> list[bytes]:
    return plain(raw).split()


def word_hashes(raw: bytes) -> np.ndarray:
    return hashed([plain(raw)])[0]


def features(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(DIMS - 1)).astype(np.int64)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words."""
    size = max(len(h) - n + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + size]
    return out


def passages(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one word of each passage of a text of n words."""
    first = np.arange(0, max(n - WINDOW + STRIDE, 1), STRIDE)
    return first, np.minimum(first + WINDOW, n)


def vectors(h: np.ndarray, first: np.ndarray, end: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors of passages as (row, feature, value)."""
    size = end - first
    row = np.repeat(np.arange(len(first)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    key, n = np.unique(row * DIMS + h[at], return_counts=True)
    row, col = key // DIMS, key % DIMS
    x = n * idf[col]
    return row, col, x / np.sqrt(np.bincount(row, x * x, len(first)))[row]


@dataclass
class Space:
    """The latent space. Only features of the benchmark can bring a passage nearer to it, so ``basis`` has a row
    for each of those; ``index`` is a feature's row or -1. Norms are of whole TF-IDF vectors."""

    idf: np.ndarray
    index: np.ndarray
    basis: np.ndarray  # benchmark's features x rank


def _parts(raws: list[bytes], most: int = 1 << 19) -> Iterator[list[bytes]]:
    """Texts in lists of about ``most`` bytes."""
    part, size = [], 0
    for raw in raws:
        part.append(raw)
        size += len(raw)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


_FAN = 16  # pieces in which arrays are summed


def _summed(rows: DataFrame, fn, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sum over all texts (one column) of what ``fn(list of plain texts, total)`` adds to an array, as pieces with their places.
    Each task has an array of its own; their pieces are added up in other tasks, so the driver gets the sum only."""
    cut = np.linspace(0, size, _FAN + 1).astype(int).tolist()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            raws = batch.column(0).to_pylist()
            for part in _parts(raws):
                fn([plain(r) for r in part], total)
                some = True
        for k in range(_FAN if some else 0):
            v = total[cut[k] : cut[k + 1]].astype(np.float32)
            at = np.flatnonzero(v).astype(np.int32)
            few = 2 * len(at) < len(v)  # places and values of what isn't zero, or all values
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at.tobytes() if few else None], pa.binary()), pa.array([(v[at] if few else v).tobytes()], pa.binary())], ["k", "at", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = totals.setdefault(k, np.zeros(cut[k + 1] - cut[k]))
                where = slice(None) if at is None else np.frombuffer(at, np.int32)
                total[where] += np.frombuffer(v, np.float32)
        for k, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["k", "v"])

    parts = rows.mapInArrow(one, "k long, at binary, v binary").repartition("k").mapInArrow(add, "k long, v binary")
    for r in parts.toLocalIterator():
        yield cut[r["k"]], np.frombuffer(r["v"], np.float32)


def _total(pieces: Iterator[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    out = np.zeros(size, np.float32)
    for at, v in pieces:
        out[at : at + len(v)] = v
    return out


def _idf(docs: DataFrame) -> np.ndarray:
    def count(raws: list[bytes], total: np.ndarray) -> None:
        h, cut = hashed(raws)
        once = np.unique(np.repeat(np.arange(len(raws)), np.diff(cut)) * DIMS + features(h))
        total[:DIMS] += np.bincount(once % DIMS, minlength=DIMS)
        total[DIMS] += len(raws)

    got = _total(_summed(docs, count, DIMS + 1), DIMS + 1).astype(float)
    return np.log((got[DIMS] + 1) / (got[:DIMS] + 1)) + 0.1


#: With at most so many features of the benchmark their products are counted in one pass; with more, each round of the SVD is a pass.
_GRAM = 1 << 12
_ROWS = 1024  # passages whose pairs of words are counted at a time


def add_products(raws: list[bytes], order: np.ndarray, square: np.ndarray, n: int, total: np.ndarray) -> None:
    """Add the products of features, over all passages of some texts, to ``total``: flat, n + 1 rows and columns, of which the last
    ones mean nothing. Values are words' numbers in the passage by the square of its length; a product is told once, at the lesser feature's
    row, and a feature's own by half, so that the sum with the transposed is A'A without the idf.

    ``order`` numbers features, the benchmark's n first, and ``square`` has their idf's square; both end with a place for no word."""
    h, cut = hashed(raws)
    size = np.diff(cut)
    count = np.where(size > 0, np.maximum(-(-(size - (WINDOW - STRIDE)) // STRIDE), 1), 0)
    owner = np.repeat(np.arange(len(size)), count)
    first = cut[owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    place = np.arange(WINDOW)
    x = np.concatenate([order[features(h)], np.full(WINDOW, order[DIMS])])[first[:, None] + place]
    x[place >= (cut[owner + 1] - first)[:, None]] = order[DIMS]
    x.sort(axis=1)
    again, length = np.zeros(len(x)), np.zeros(len(x))
    for j in range(WINDOW):  # the k-th time of a word adds 2 k - 1 squares
        again = (again + 1) * (x[:, j] == x[:, j - 1]) if j else again
        length += (2 * again + 1) * square[x[:, j]]
    known = (x < n).sum(axis=1)
    by = np.argsort(known, kind="stable")
    for at in range(0, len(by), _ROWS):
        some = by[at : at + _ROWS]
        wide = int(known[some[-1]])
        y = np.ascontiguousarray(np.minimum(x[some, :wide], n).T, np.int64)
        row, part = y * (n + 1), np.tile(1 / length[some], (wide, 1))
        for d in range(wide):
            np.add.at(total, (row[: wide - d] + y[d:]).ravel(), (part[d:] if d else part / 2).ravel())


def fit(docs: DataFrame, items: DataFrame, weight: float = 8.0, rounds: int = 2, seed: int = 3) -> Space:
    """Randomised SVD of the TF-IDF matrix of all passages of the corpus and the benchmark.

    ``docs`` and ``items`` have a column ``raw``. The benchmark as a whole counts ``weight`` times as much as the corpus does, whatever
    their sizes, so that the space keeps what tells its items apart.
    """
    idf = _idf(docs.select("raw"))
    # a task has an array of its own: few of them, which read several partitions each
    cores = docs.sparkSession.sparkContext.defaultParallelism
    held, own = (x.coalesce(max(cores, x.rdd.getNumPartitions() // 32)) for x in (docs.select("raw"), items.select("raw")))

    def seen(raws: list[bytes], total: np.ndarray) -> None:
        h, cut = hashed(raws)
        total[features(h)] = 1
        total[DIMS] += sum(len(passages(n)[0]) for n in np.diff(cut).tolist() if n)

    told = _total(_summed(own, seen, DIMS + 1), DIMS + 1)
    used = np.flatnonzero(told[:DIMS])
    index = np.full(DIMS, -1)
    index[used] = np.arange(len(used))
    size = min(RANK + EXTRA, len(used))
    if not size:
        return Space(idf, index, np.zeros((0, 0), np.float32))
    times = _gram(held, own, used, idf, weight / float(told[DIMS])) if len(used) <= _GRAM else _passes(held, own, index, idf, weight / float(told[DIMS]))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(used), size)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(times(q) + np.float32(1e-6) * q)[0]
    _, vec = np.linalg.eigh(q.T @ times(q))
    return Space(idf, index, (q @ vec[:, ::-1][:, :RANK]).astype(np.float32))


def _gram(docs: DataFrame, items: DataFrame, used: np.ndarray, idf: np.ndarray, by: float):
    """q -> A'A q, from the products of the benchmark's features, which are counted in one pass; ``by`` is the weight of the items' passages."""
    n = len(used)
    order, square = np.zeros(DIMS + 1, np.uint16), np.zeros(DIMS + 1)
    order[np.concatenate([used, np.setdiff1d(np.arange(DIMS), used), [DIMS]])] = np.arange(DIMS + 1)
    square[order[:DIMS]] = idf**2

    def count(raws: list[bytes], total: np.ndarray) -> None:
        add_products(raws, order, square, n, total)
        total.reshape(n + 1, n + 1)[n] = total.reshape(n + 1, n + 1)[:, n] = 0

    g = _total(_summed(docs, count, (n + 1) ** 2), (n + 1) ** 2)
    value = idf[used]
    all_ = float(2 * (g[:: n + 2][:n] * value**2).sum())
    g *= 1 / all_ if all_ else 0
    for at, v in _summed(items, count, (n + 1) ** 2):
        g[at : at + len(v)] += np.float32(by) * v
    g = g.reshape(n + 1, n + 1)[:n, :n]
    g *= value[:, None].astype(np.float32)
    g *= value.astype(np.float32)
    return lambda q: g @ q + g.T @ q


def _passes(docs: DataFrame, items: DataFrame, index: np.ndarray, idf: np.ndarray, by: float):
    """q -> A'A q, by a pass over all texts; ``by`` is the weight of the items' passages."""
    sc = docs.sparkSession.sparkContext

    def square(raws: list[bytes], total: np.ndarray) -> None:
        for raw in raws:
            h = features(hashed([raw])[0])
            if len(h):
                _, col, x = vectors(h, *passages(len(h)), idf)
                total[0] += (x[index[col] >= 0] ** 2).sum()

    all_ = float(_total(_summed(docs, square, 1), 1)[0])

    def times(q: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(q.astype(np.float32))

        def run(raws: list[bytes], total: np.ndarray) -> None:
            q = shared.value
            total = total.reshape(q.shape)
            for raw in raws:
                h = features(hashed([raw])[0])
                if len(h):
                    first, end = passages(len(h))
                    row, col, x = vectors(h, first, end, idf)
                    col = index[col]
                    row, col, x = row[col >= 0], col[col >= 0], x[col >= 0, None].astype(np.float32)
                    if not len(row):
                        continue
                    y = np.zeros((len(first), q.shape[1]), np.float32)
                    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    y[row[starts]] = np.add.reduceat(q[col] * x, starts)
                    order = np.argsort(col, kind="stable")
                    starts = np.flatnonzero(np.concatenate([[True], np.diff(col[order]) > 0]))
                    total[col[order][starts]] += np.add.reduceat((y[row] * x)[order], starts)

        sums = [_total(_summed(rows, run, q.size), q.size).reshape(q.shape) for rows in (docs, items)]
        shared.destroy()
        return sums[0] * np.float32(1 / all_ if all_ else 0) + sums[1] * np.float32(by)

    return times


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by the bit-parallel method."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Items:
    """A block of benchmark items, ready to be compared."""

    ids: list
    words: list[list[int]]  # hashes of words
    answers: list[set[int]]
    latent: np.ndarray  # rank x items, unit columns
    #: What a word adds to a passage: benchmark's features x items, or x rank where there are more items.
    adds: np.ndarray
    #: A feature's row of ``adds``, the last one (zeros) for those of no item.
    row: np.ndarray
    #: For a number of words, the sorted hashes of the items' runs, where each one's places begin, and item and first word of the places.
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    #: For a number of words, which low bits of a run's hash occur: a first look before the runs are searched.
    seen: dict[int, np.ndarray]

    @staticmethod
    def of(ids: list, raws: list[bytes], answers: list[bytes | None], space: Space, min_words: int, answer_words: int) -> Items:
        kept, cols, all_words, all_answers, short = [], [], [], [], []
        for i, raw, answer in zip(ids, raws, answers, strict=True):
            h = word_hashes(raw)
            told = set(word_hashes(answer).tolist()) if answer else set()
            if len(h) < max(min_words, SEED):
                if len(h):
                    short.append((i, h, told or set(h.tolist())))
                continue
            f = features(h)
            _, col, x = vectors(f, np.array([0]), np.array([len(f)]), space.idf)
            z = x @ space.basis[space.index[col]]
            rare = sorted(set(h.tolist()), key=lambda w: (-space.idf[w % DIMS], w))[:answer_words]
            kept.append(i)
            all_words.append(h)
            all_answers.append(told or set(rare))
            cols.append(z / max(float(np.sqrt(z @ z)), 1e-9))
        latent = np.stack(cols, axis=1).astype(np.float32) if cols else np.zeros((space.basis.shape[1], 0), np.float32)
        direct = 0 < len(kept) <= space.basis.shape[1]
        of = np.flatnonzero(space.index >= 0)
        adds = (space.basis @ latent if direct else space.basis) * space.idf[of, None].astype(np.float32)
        row = np.full(len(space.index), len(of), np.int32)
        row[of] = np.arange(len(of))
        adds = np.concatenate([adds, np.zeros((1, adds.shape[1]), np.float32)])
        places: dict[int, list[tuple[np.ndarray, int, np.ndarray]]] = {}
        for c, h in enumerate(all_words):
            g = grams(h, SEED)
            places.setdefault(SEED, []).append((g, c, np.arange(len(g))))
        for i, h, answer in short:
            places.setdefault(len(h), []).append((grams(h, len(h)), len(kept), np.zeros(1, np.int64)))
            kept.append(i)
            all_words.append(h)
            all_answers.append(answer)
        seeds, seen = {}, {}
        for n, got in places.items():
            key, item, at = np.concatenate([g for g, _, _ in got]), np.concatenate([np.full(len(g), c) for g, c, _ in got]), np.concatenate([a for _, _, a in got])
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            seeds[n] = (key, np.append(first, len(order)), item[order], at[order])
            seen[n] = np.zeros(_LOOK, bool)
            seen[n][_low(key)] = True
        return Items(kept, [h.tolist() for h in all_words], all_answers, latent, adds, row, seeds, seen)


_LOOK = 1 << 20


def _low(g: np.ndarray) -> np.ndarray:
    return ((g ^ (g >> np.uint64(29))) & np.uint64(_LOOK - 1)).astype(np.int64)


#: Words that are summed at a time; a multiple of ``STRIDE``.
_SEGMENT = 1 << 16
_BLOCKS = 128  # blocks whose words are summed at a time


def search(f: np.ndarray, cut: np.ndarray, idf: np.ndarray, items: Items, min_cosine: float) -> list[tuple[int, int, int, int, float]]:
    """Candidates: text, item, first word, end word, best cosine; sorted, with overlapping passages as one.

    ``f`` are the features of all texts' words and ``cut`` where texts begin. A passage's vector is the sum of its
    words', summed in blocks of ``STRIDE`` words; its norm takes each word as occurring once in the passage."""
    if not items.latent.shape[1] or not len(f):
        return []
    texts_of, lows, highs = [], [], []  # segments that begin at a block of a text; passages belong to where they begin
    for t, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        for x in range(a, max(b - WINDOW + STRIDE, a + (a < b)), _SEGMENT):
            texts_of.append(t)
            lows.append(x)
            highs.append(min(b, x + _SEGMENT + WINDOW - STRIDE))
    hits: list[tuple[int, int, int, int, float]] = []
    at = 0
    while at < len(lows):
        to, size = at + 1, highs[at] - lows[at]
        while to < len(lows) and size + highs[to] - lows[to] <= _SEGMENT:
            size += highs[to] - lows[to]
            to += 1
        hits += _near(f, np.array(texts_of[at:to]), np.array(lows[at:to]), np.array(highs[at:to]), cut, idf, items, min_cosine)
        at = to
    out: list[tuple[int, int, int, int, float]] = []
    for t, c, lo, hi, x in sorted(hits):
        if out and out[-1][:2] == (t, c) and lo <= out[-1][3]:
            _, _, a, b, y = out.pop()
            lo, hi, x = a, max(b, hi), max(x, y)
        out.append((t, c, lo, hi, x))
    return out


def _near(f: np.ndarray, texts_of: np.ndarray, low: np.ndarray, high: np.ndarray, cut: np.ndarray, idf: np.ndarray, items: Items, min_cosine: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of some segments that come near an item: text, item, first word, end word, cosine."""
    span = WINDOW // STRIDE
    size = high - low
    n_blocks = -(-size // STRIDE) + span
    block0 = np.cumsum(n_blocks) - n_blocks
    which = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    h = f[low[which] + inside]
    total, width = int(n_blocks.sum()), items.adds.shape[1]
    rows = np.full(total * STRIDE, len(items.adds) - 1, np.int32)  # the last row adds nothing
    rows[block0[which] * STRIDE + inside] = items.row[h]
    sums = np.empty((total, width), np.float32)
    some = np.empty((_BLOCKS * STRIDE, width), np.float32)
    for at in range(0, total, _BLOCKS):
        to = min(total, at + _BLOCKS)
        np.take(items.adds, rows[at * STRIDE : to * STRIDE], axis=0, out=some[: (to - at) * STRIDE], mode="clip")
        np.add.reduce(some[: (to - at) * STRIDE].reshape(to - at, STRIDE, width), axis=1, out=sums[at:to])
    n_passages = np.maximum(-(-(size - (WINDOW - STRIDE)) // STRIDE), 1)
    owner = np.repeat(np.arange(len(size)), n_passages)
    nth = np.arange(n_passages.sum()) - np.repeat(np.cumsum(n_passages) - n_passages, n_passages)
    z = sums[block0[owner] + nth]
    for k in range(1, span):
        z += sums[block0[owner] + nth + k]
    if items.adds.shape[1] != items.latent.shape[1] or items.latent.shape[1] > items.latent.shape[0]:
        z = z @ items.latent
    word0 = np.cumsum(size) - size
    first = word0[owner] + nth * STRIDE
    end = np.minimum(first + WINDOW, (word0 + size)[owner])
    square = np.concatenate([[0], np.cumsum(idf[h] ** 2)])
    norm = np.sqrt(np.maximum(square[end] - square[first], 1e-9)).astype(np.float32)
    rows, cols = np.nonzero(z >= min_cosine * norm[:, None])
    mine = owner[rows]
    begin = low[mine] - cut[texts_of[mine]] - word0[mine]
    # that norm takes repeated words as different ones and is too small for them: no candidate is lost, but the value is told with the right one
    whole = norm.astype(float)
    for r in np.unique(rows).tolist():
        own, count = np.unique(h[first[r] : end[r]], return_counts=True)
        whole[r] = np.sqrt(max(float(((idf[own] * count) ** 2).sum()), 1e-9))
    return list(zip(texts_of[mine].tolist(), cols.tolist(), (begin + first[rows]).tolist(), (begin + end[rows]).tolist(), np.minimum(z[rows, cols] / whole[rows], 1.0).tolist(), strict=True))


def shared_runs(h: np.ndarray, cut: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """Text, item, first word, end word of the stretches of texts that share a run of words with the item."""
    found: set[tuple[int, int, int, int]] = set()
    for n, (key, first, item, place) in items.seeds.items():
        g = grams(h, n)
        some = np.flatnonzero(items.seen[n][_low(g)])
        k = np.minimum(np.searchsorted(key, g[some]), len(key) - 1)
        same = key[k] == g[some]
        some, k = some[same], k[same]
        text = np.searchsorted(cut, some, side="right") - 1
        within = some + n <= cut[text + 1]
        for p, t, q in zip(some[within].tolist(), text[within].tolist(), k[within].tolist(), strict=True):
            at, size = p - int(cut[t]), int(cut[t + 1] - cut[t])
            for j in range(first[q], first[q + 1]):
                c = int(item[j])
                begin = at - int(place[j])
                found.add((t, c, max(begin, 0), min(begin + len(items.words[c]), size)))
    out: list[tuple[int, int, int, int]] = []
    for t, c, lo, hi in sorted(found):
        if out and out[-1][:2] == (t, c) and lo <= out[-1][2 + 1]:
            out[-1] = (t, c, out[-1][2], max(hi, out[-1][3]))
        else:
            out.append((t, c, lo, hi))
    return out


def cosine_of(f: np.ndarray, item: np.ndarray, idf: np.ndarray) -> float:
    """The cosine of a stretch of a text and an item, without the latent space."""
    got = []
    for x in (f, item):
        _, col, value = vectors(x, np.array([0]), np.array([len(x)]), idf)
        got.append(dict(zip(col.tolist(), value.tolist(), strict=True)))
    return sum(v * got[1].get(c, 0.0) for c, v in got[0].items())


def check(ws: list, lo: int, hi: int, item: list, answer: set, min_lcs: float = 0.0, min_answer: float = 0.0) -> tuple[float, float]:
    """Shares of the item in the common subsequence, and of the answer in the passage and what surrounds it.
    Long runs of candidate passages are compared in overlapping pieces of three item lengths; a piece that reaches both
    limits goes before one that doesn't, and the sequences are only compared where the words could suffice."""
    n = len(item)
    lo, hi = max(0, lo - n), min(len(ws), hi + n)
    best = (False, 0.0, 0.0)
    for a in range(lo, max(hi - 2 * n, lo + 1), max(n, 1)):
        near = ws[a : a + max(3 * n, WINDOW)]
        have = set(near)
        told = len(answer & have) / max(len(answer), 1)
        if told >= min_answer and sum(map(have.__contains__, item)) >= min_lcs * n:
            share = lcs(item, near) / n
            best = max(best, (share >= min_lcs, share, told))
    return best[1:]


def judged(raws: list[bytes], idf: np.ndarray, items: Items, min_cosine: float, min_lcs: float, min_answer: float) -> list[tuple[int, int, float, float, float]]:
    """Items that texts hold: text, item, cosine, share of the item, share of the answer."""
    h, cut = hashed([plain(r) for r in raws])
    f = features(h)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    near = search(f, cut, idf, items, min_cosine)
    seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for t, c, lo, hi, _ in near:
        seen.setdefault((t, c), []).append((lo, hi))
    for t, c, lo, hi in shared_runs(h, cut, items):
        if not any(a <= lo and hi <= b for a, b in seen.get((t, c), ())):
            own = np.array(items.words[c], np.uint64)
            near.append((t, c, lo, hi, cosine_of(f[cut[t] + lo : cut[t] + hi], features(own), idf)))
    held, ws = -1, []
    for t, c, lo, hi, cosine in sorted(near):
        if t != held:
            held, ws = t, h[cut[t] : cut[t + 1]].tolist()
        share, answer = check(ws, lo, hi, items.words[c], items.answers[c], min_lcs, min_answer)
        if share >= min_lcs and answer >= min_answer:
            best[t, c] = max(best.get((t, c), (0.0, 0.0, 0.0)), (share, answer, cosine))
    return [(t, c, cosine, share, answer) for (t, c), (share, answer, cosine) in sorted(best.items())]


def item_blocks(source: DataFrame, items: DataFrame, item_id_col: str, item_text_col: str, answer_col: str | None, min_words: int, answer_words: int, block: int, space: Space | None):
    """The benchmark as broadcast blocks ``(idf, Items)`` of about ``block`` items; its id type."""
    raw = F.coalesce(F.col(item_text_col).cast("binary"), F.lit(b""))
    answer = F.col(answer_col).cast("binary") if answer_col else F.lit(None).cast("binary")
    bench = items.select(F.col(item_id_col).alias("id"), raw.alias("raw"), answer.alias("answer"))
    space = space or fit(source.select("raw"), bench.select("raw"))
    n = max(1, -(-bench.count() // block))
    out = []
    for k in range(n):
        rows = bench.where(F.pmod(F.xxhash64("id", "raw"), F.lit(n)) == k).collect()
        part = Items.of([r["id"] for r in rows], [bytes(r["raw"]) for r in rows], [r["answer"] and bytes(r["answer"]) for r in rows], space, min_words, answer_words)
        out.append(items.sparkSession.sparkContext.broadcast((space.idf, part)))
    return out, bench.schema["id"].dataType.simpleString()


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None,
    min_cosine: float = 0.25, min_lcs: float = 0.6, min_answer: float = 0.25, min_words: int = 8, answer_words: int = 8, block: int = 20_000, space: Space | None = None,
) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, answer_share`` for each document and benchmark item it holds."""
    source = texts(docs, id_col, text_col)
    blocks, id_type = item_blocks(source, items, item_id_col, item_text_col, answer_col, min_words, answer_words, block, space)
    out = None
    for shared in blocks:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            idf, part = shared.value
            for batch in batches:
                at, got, row = [], [], 0
                for raws in _parts(batch.column(1).to_pylist()):
                    for t, c, *shares in judged(raws, idf, part, min_cosine, min_lcs, min_answer):
                        at.append(row + t)
                        got.append((part.ids[c], *shares))
                    row += len(raws)
                if got:
                    ids, *cols = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids), *(pa.array(c, pa.float64()) for c in cols)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

        found = source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, item_id {id_type}, cosine double, lcs_share double, answer_share double")
        out = found if out is None else out.unionByName(found)
    return out


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", min_cosine: float = 0.25, min_lcs: float = 0.6, min_answer: float = 0.25, min_words: int = 8, answer_words: int = 8, block: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``items`` (``item_id, text``), as they are and without a shuffle."""
    blocks, _ = item_blocks(texts(docs, docs.columns[0], text_col), items, "item_id", "text", None, min_words, answer_words, block, None)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out, place = docs, docs.columns.index(text_col)
    for shared in blocks:

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            idf, part = shared.value
            for batch in batches:
                clean, row = np.ones(batch.num_rows, bool), 0
                for raws in _parts([(t or "").encode() for t in batch.column(place).to_pylist()]):
                    clean[[row + x[0] for x in judged(raws, idf, part, min_cosine, min_lcs, min_answer)]] = False
                    row += len(raws)
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
    return out
