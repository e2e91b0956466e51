"""Language-model scoring with an interpolated modified Kneser-Ney model of any order from two up.

Counting: map tasks count runs of ``order`` word hashes and deal packed blocks out by key range; a reduce task
merges one range after another and writes each as a sorted hash array into the shared folder. What the runs of one
order say about shorter ones (after how many words a run occurs) goes to the next exchange, which does the same for
that order, down to single words; what they say about their contexts (how often, followed by how many words once,
twice, more often) is merged there too. Contexts that are frequent, which could hold a third of all runs, are found first
and their ranges are cut further, so no range depends on one of them. Scoring: workers map these files into memory
and look up sorted batches; nothing of the model passes through the driver but sizes and the counts of counts.

The model's files need a folder that all workers have mounted (``model_dir``, else the session's shared folder). A file's
content follows from its range alone and files are put in place by renaming, so a task that runs again after a loss
writes the same file again. Counts have 64 bits wherever they are added up; a file's numbers take the fewest bytes that
hold its largest.

Defined cases: null text is empty; a text without words has the end token alone; without training rows all
scores are 0; ids may be null or repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, texts
from .wordhash import hashed, mix

START, END = np.uint64(1), np.uint64(2)
_HIGH = np.uint64(((1 << 24) - 1) << 40)
_LOW = np.uint64((1 << 40) - 1)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def run_hash(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of runs of words, given place by place; a word stands for itself."""
    h = words[0]
    for w in words[1:]:
        h = mix(h * _TURN + mix(w))
    return h


def range_key(context: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What ranges are cut by: 24 bits of the context's hash, then 40 of the run's, so that a context stays together and
    a frequent one can be cut."""
    return (context & _HIGH) | (key & _LOW)


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by END; and each text's number of tokens."""
    h, cut = hashed([r.lower() for r in raws])
    sizes = np.diff(cut) + 1
    out = np.full(len(h) + len(raws), END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(raws)), sizes - 1)] = h
    return out, sizes


def runs(tok: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the ``order - 1`` tokens before it, START where the text has none, and itself."""
    at = np.arange(len(tok))
    inside = at - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return [np.where(inside >= j, tok[np.maximum(at - j, 0)], START) for j in range(order - 1, 0, -1)] + [tok]


def _parts(raws: Iterator[bytes], most: int = 6 << 20) -> Iterator[list[bytes]]:
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


def _fewest(x: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pack(*cols: np.ndarray) -> bytes:
    cols = tuple(_fewest(c) for c in cols)
    head = np.array([len(cols), len(cols[0]), *(c.itemsize for c in cols)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(c.tobytes() for c in cols))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    k, n = np.frombuffer(data, np.int64, 2).tolist()
    at, out = 8 * (2 + k), []
    for size in np.frombuffer(data, np.int64, k, 16).tolist():
        out.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.uint64))
        at += n * size
    return out


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order and the starts of equal keys in it."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)


def _summed(key: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the columns."""
    order, first = _grouped(key)
    return (key[order[first]], *(np.add.reduceat(c[order].astype(np.uint64), first) for c in cols))


def _save(path: str, array: np.ndarray) -> None:
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, path)


@dataclass
class Model:
    """Where the arrays are and the few numbers that scoring needs besides them."""

    path: str
    order: int
    parts: int
    bounds: dict[int, np.ndarray] = field(default_factory=dict)  # by order, where ranges are cut besides evenly
    n_docs: int = 0
    n_tokens: int = 0
    n_types: int = 0
    n_pairs: int = 0  # distinct runs of two words
    discount: dict[int, tuple[float, float, float]] = field(default_factory=dict)  # by order
    word_counts: tuple[int, int, int] = (0, 0, 0)  # words that follow one, two, more words


def discounts(t: list[int]) -> tuple[float, float, float]:
    """The modified discounts from the numbers of items seen once to four times; plain ones where those are missing."""
    if min(t) <= 0:
        return (0.5, 1.0, 1.5)
    y = t[0] / (t[0] + 2 * t[1])
    return tuple(min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3))  # type: ignore[return-value]


def _frequent(rows: DataFrame, order: int) -> tuple[dict[int, list[tuple[int, float]]], int, int]:
    """For each order, contexts with a share of 1 / 4096 of the tokens or more (so at most 4096 each); tokens; texts. Only
    where ranges are cut depends on these lists, no count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(x for x in batch.column(0).to_pylist()):
                tok, sizes = tokens(part)
                cols: list[list] = [[0], [0], [len(tok)], [len(sizes)]]
                for k in range(2, order + 1):
                    context, n = np.unique(run_hash(runs(tok, sizes, k)[:-1]), return_counts=True)
                    top = n * 4096 >= len(tok)  # whatever is frequent in the corpus is frequent in a batch somewhere
                    for c, x in zip(cols, ([k] * int(top.sum()), context[top].view(np.int64).tolist(), n[top].tolist(), [0] * int(top.sum())), strict=True):
                        c += x
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["k", "context", "n", "texts"])

    got = rows.mapInArrow(run, "k long, context long, n long, texts long").groupBy("k", "context").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    total = got.where("k = 0").first()
    if total is None:
        return {}, 0, 0
    found: dict[int, list[tuple[int, float]]] = {k: [] for k in range(2, order + 1)}
    for r in got.where((F.col("k") > 0) & (F.col("n") * 4096 >= int(total["n"]))).collect():
        found[r["k"]].append((r["context"] % (1 << 64), r["n"] / total["n"]))
    return found, int(total["n"]), int(total["texts"])


def _cuts(parts: int, frequent: list[tuple[int, float]]) -> np.ndarray:
    """Cuts besides the even ones: within frequent contexts."""
    cuts = set()
    for context, share in frequent:
        k = int(np.ceil(share * 2 * parts))
        if k > 1:
            base = context & int(_HIGH)
            cuts |= {base + (j << 40) // k for j in range(k + 1)}
    return np.array(sorted(c for c in cuts if 0 < c < 1 << 64), np.uint64)


def _range_of(key: np.ndarray, parts: int, cuts: np.ndarray) -> np.ndarray:
    """The number of each key's range: one of ``parts`` even ones, and which of the cuts lie before."""
    even = ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (even + np.searchsorted(cuts, key, side="right").astype(np.uint64)).astype(np.int64)


#: Kinds of blocks: runs and contexts carry their order besides.
_RUNS, _CONTEXTS, _WORDS, _SUMS = 100, 200, 300, 400


def _blocks(kind: int, part: np.ndarray, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Packed blocks of columns by range; ``part`` is sorted."""
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(part))
    blobs = [_pack(*(c[a:b] for c in cols)) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(first), pa.int32()), pa.array(part[first]), pa.array(blobs, pa.binary())], ["kind", "part", "blob"])


def local_path(folder: str) -> str:
    """The shared folder as workers open it. Arrays are mapped into memory, so it must be a mounted path."""
    path = folder[5:] if folder.startswith("file:") else folder
    if "://" in path:
        raise ValueError(f"{folder} is no mounted folder; give model_dir, a path that all workers share")
    return "/" + path.lstrip("/")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, parts: int | None = None, model_dir: str | None = None, flush: int = 3_000_000, per_part: int = 2_000_000, tasks: int = 4096) -> Model:
    """Count all of ``docs`` and write the model's arrays, in at least a range for every ``per_part`` tokens; each exchange has at most
    ``tasks`` partitions, whose ranges are settled one after another."""
    if order < 2:
        raise ValueError("the order is two at least")
    spark: SparkSession = docs.sparkSession
    rows = texts(docs, id_col, text_col).select("raw")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent, n_tokens, n_docs = _frequent(rows, order)
    parts = max(parts, -(-n_tokens // per_part))
    path = f"{local_path(model_dir or shared_dir(spark))}/ngram-{uuid.uuid4().hex}"
    os.makedirs(path)
    model = Model(path, order, parts, {k: _cuts(parts, [x for x in v if x[1] * 4 * parts >= 1]) for k, v in frequent.items()}, n_docs, n_tokens)
    bounds, even = model.bounds, np.empty(0, np.uint64)

    def dealt(words: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """Runs with their counts, as blocks; equal neighbours are added up."""
        k = len(words)
        key, context = run_hash(words), run_hash(words[:-1])
        place = range_key(context, key)
        order_ = np.argsort(place, kind="stable")
        key, place = key[order_], place[order_]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(n[order_].astype(np.uint64), first)
        at = order_[first]
        return _blocks(_RUNS + k, _range_of(place[first], parts, bounds[k]), [*(w[at] for w in words), n])

    def by_hash(kind: int, key: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
        key, *cols = _summed(key, *cols)
        return _blocks(kind, _range_of(key, parts, even), [key, *cols])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            for part in _parts(x for x in batch.column(0).to_pylist()):
                tok, sizes = tokens(part)
                got.append(runs(tok, sizes, order))
                held += len(tok)
                if held >= flush:
                    words = [np.concatenate(x) for x in zip(*got, strict=True)]
                    got, held = [], 0
                    yield dealt(words, np.ones(len(words[0]), np.uint8))
        if held:
            words = [np.concatenate(x) for x in zip(*got, strict=True)]
            yield dealt(words, np.ones(len(words[0]), np.uint8))

    def sums(name: str, key: np.ndarray, n: np.ndarray, more: list[int]) -> pa.RecordBatch:
        seen = np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)
        return pa.RecordBatch.from_arrays([pa.array([_SUMS], pa.int32()), pa.array([0], pa.int64()), pa.array([f"{name} {len(key)} {' '.join(map(str, [*seen[1:6].tolist(), *more]))}".encode()], pa.binary())], ["kind", "part", "blob"])

    def settle(kind: int, p: int, cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Write one range; what follows from it for others."""
        if kind > _WORDS - 1:
            word, after, count_ = _summed(*cols)
            _save(f"{path}/word-{p}-key.npy", word)
            _save(f"{path}/word-{p}-n.npy", np.stack([_fewest(after), _fewest(count_)], axis=1) if len(word) else np.zeros((0, 2), np.uint8))
            yield sums("word", word, after, [int(((count_ > 0) & (word != START)).sum())])
        elif kind > _CONTEXTS:
            k = kind - _CONTEXTS
            context, *stats = _summed(*cols)
            _save(f"{path}/context{k}-{p}-key.npy", context)
            _save(f"{path}/context{k}-{p}-n.npy", _fewest(np.stack(stats, axis=1)))
        else:
            *words, n = cols
            k = kind - _RUNS
            order_, first = _grouped(run_hash(words))
            n = np.add.reduceat(n[order_], first)
            words = [w[order_[first]] for w in words]
            key = run_hash(words)
            _save(f"{path}/run{k}-{p}-key.npy", key)
            _save(f"{path}/run{k}-{p}-n.npy", _fewest(n))
            yield sums(f"run{k}", key, n, [0])
            yield by_hash(_CONTEXTS + k, run_hash(words[:-1]), n, n == 1, n == 2, n > 2)
            one, zero = np.ones(len(n), np.uint8), np.zeros(len(n), np.uint8)
            if k > 2:
                yield dealt(words[1:], one)
            else:
                yield by_hash(_WORDS, words[1], one, zero)
            if k == order:  # every token but the ends is the last of a context
                yield by_hash(_WORDS, words[-2], zero, n)

    def merge(of: tuple[int, ...]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                passed = []
                for i, (kind, p, blob) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                    if kind not in of:
                        passed.append(i)
                        continue
                    if (kind, p) != now and held:
                        yield from settle(*now, [np.concatenate(x) for x in zip(*held, strict=True)])
                        held = []
                    now = (kind, p)
                    held.append(_unpack(blob))
                if passed:
                    yield batch.take(pa.array(passed))
            if held:
                yield from settle(*now, [np.concatenate(x) for x in zip(*held, strict=True)])

        return run

    schema = "kind int, part long, blob binary"
    found = rows.mapInArrow(count, schema)
    for k in range(order, 0, -1):  # each exchange merges the runs of one order and the contexts of the one above
        of = (_RUNS + k, _CONTEXTS + k + 1) if k > 1 else (_CONTEXTS + 2, _WORDS)
        found = found.repartition(min(parts, tasks), F.xxhash64("kind", "part")).sortWithinPartitions("kind", "part").mapInArrow(merge(of), schema)
    told = F.split(F.col("blob").cast("string"), " ")
    totals = found.where(F.col("kind") == _SUMS).groupBy(told[0].alias("name")).agg(*(F.sum(told[i].cast("long")).alias(f"s{i}") for i in range(1, 8)))
    for r in totals.collect():  # a row for each order
        name, n, *seen, types = r
        if name == "word":
            model.n_types, model.word_counts = types + (n_docs > 0), (seen[0], seen[1], sum(seen[2:]))
            model.discount[1] = discounts(seen[:4])
        else:
            model.discount[int(name[3:])] = discounts(seen[:4])
            if name == "run2":
                model.n_pairs = n
    _complete(spark, model)
    return model


def _complete(spark: SparkSession, model: Model) -> None:
    """Empty arrays for the ranges into which nothing fell, so that each has its files. Tasks look for themselves; the driver lists nothing."""
    kinds = [("word", 2, model.parts)]
    for k in range(2, model.order + 1):
        kinds += [(f"context{k}", 4, model.parts), (f"run{k}", 0, model.parts + len(model.bounds.get(k, [])))]  # runs have cuts besides
    most = max(n for _, _, n in kinds)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for kind, columns, n in kinds:
                    name = f"{model.path}/{kind}-{p}"
                    if p < n and not os.path.exists(f"{name}-n.npy"):
                        _save(f"{name}-key.npy", np.zeros(0, np.uint64))
                        _save(f"{name}-n.npy", np.zeros((0, columns) if columns else 0, np.uint8))
            yield batch

    ranges = spark.range(0, most, 1, min(most, spark.sparkContext.defaultParallelism))
    ranges.mapInArrow(fill, "id long").write.format("noop").mode("overwrite").save()


class Lookup:
    """A worker's view of the arrays: files are mapped into memory when a key first falls into them, the last ``most`` stay."""

    def __init__(self, model: Model, most: int = 8192) -> None:
        self.m = model
        self.most = most
        self._open: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def _file(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        if name in self._open:
            self._open.move_to_end(name)
        else:
            if len(self._open) >= self.most:
                self._open.popitem(last=False)
            # training leaves files for every range: a missing one is lost, or the folder isn't mounted here
            self._open[name] = tuple(np.load(f"{self.m.path}/{name}-{x}.npy", mmap_mode="r") for x in ("key", "n"))  # type: ignore[assignment]
        return self._open[name]

    def find(self, kind: str, keys: np.ndarray, part: np.ndarray, columns: int) -> np.ndarray:
        """The numbers of keys, zeros for unknown ones."""
        order = np.lexsort([keys, part])
        sorted_part = part[order]
        out = np.zeros((len(keys), columns), np.int64)
        first = np.flatnonzero(np.concatenate([[True], sorted_part[1:] != sorted_part[:-1]])) if len(keys) else np.empty(0, np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            have, vals = self._file(f"{kind}-{sorted_part[a]}")
            if len(have):
                mine = keys[order[a:b]]
                at = np.minimum(np.searchsorted(have, mine), len(have) - 1)
                ok = have[at] == mine
                out[order[a:b][ok]] = vals[at[ok]].reshape(-1, columns)
        return out

    def hashes(self, kind: str, keys: np.ndarray, columns: int) -> np.ndarray:
        """Of files in even ranges, for keys that repeat."""
        one, back = np.unique(keys, return_inverse=True)
        return self.find(kind, one, _range_of(one, self.m.parts, np.empty(0, np.uint64)), columns)[back]

    def score(self, raws: list[bytes]) -> list[np.ndarray]:
        """For each text: tokens, known tokens, base score, score."""
        m = self.m
        tok, sizes = tokens(raws)

        def less(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
            return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)

        after, count = self.hashes("word", tok, 2).T
        count = np.where(tok == END, m.n_docs, count)
        kinds, plain = max(m.n_pairs, 1), (0.5, 1.0, 1.5)
        rest = sum(d * k for d, k in zip(m.discount.get(1, plain), m.word_counts, strict=True)) / kinds if m.n_pairs else 1.0
        p = less(after, m.discount.get(1, plain)) / kinds + rest / (m.n_types + 1)
        for k in range(2, m.order + 1) if m.n_tokens else ():
            words = runs(tok, sizes, k)
            context, key = run_hash(words[:-1]), run_hash(words)
            stats = self.hashes(f"context{k}", context, 4)
            n = self.find(f"run{k}", key, _range_of(range_key(context, key), m.parts, m.bounds[k]), 1)[:, 0]
            some = np.maximum(stats[:, 0], 1)
            p = np.where(stats[:, 0] > 0, less(n, m.discount[k]) / some + stats[:, 1:] @ np.array(m.discount[k]) / some * p, p)
        base = np.log10((count + 0.5) / (m.n_tokens + 0.5 * (m.n_types + 1)))
        first = np.cumsum(sizes) - sizes
        return [sizes, np.add.reduceat((count > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, perplexity`` of every whole text; scores are log10."""
    source = texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(model)
        for batch in batches:
            at = 0
            for part in _parts(x for x in batch.column(1).to_pylist()):
                cols = look.score(part)
                ids = batch.column(0).slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, cols), pa.array(10 ** np.minimum(-cols[3] / cols[0], 300))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double")
