"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles is hashed to a signature of ``symbols`` minima, of which ``BITS`` bits each are kept: two
sets agree in a symbol with about their Jaccard similarity, so pairs at the threshold differ in at most ``radius`` symbols
but for a stated share ``miss``, which fixes the radius. Signatures within the radius are found without loss: they are split
into so many chunks that by the pigeonhole principle some chunk of such a pair has at most ``errors`` differing symbols, and for
every choice of so many places of a chunk its other symbols are a key. Such a pair meets in one key at least.

Documents of equal sets are one class, classes of equal signatures one node. Keys are counted (with partial
sums before the shuffle) and those of one node dropped. Nodes of one key are compared in full and linked with union-find, which
hands out a spanning forest, never all pairs; a key above ``unit_limit`` nodes is dealt to pairs of chunks. The links only say
which classes are to be compared: inside what they connect the shingle sets decide, exactly, so nothing is linked by
chance, and what may be missed is bounded by ``miss`` for each pair at the threshold and far less above it.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than
a shingle give one shingle of the whole sequence; repeated rows and ids are kept; a null id is never a component's name unless
the component has no other; an empty table gives an empty result; other columns are not read. Very long texts are read in
slices; eight bytes for each of their words and shingles are held. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, per_batch, stored, texts
from .components import components
from .simhash import _class_of, _grid, _link, _roots, verified_links, whole_units
from .wordhash import in_parts, mix, windows

SYMBOLS, BITS = 64, 8
_RANDOM = np.random.default_rng(20_13)
_TIMES = _RANDOM.integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, 4096, np.uint64)


def shingle_sets(raws: list[bytes], shingle: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles, in lower case."""
    for _, h, bounds in in_parts([r.lower() for r in raws]):
        every = windows(h, shingle)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(every[lo : hi - shingle + 1] if hi - lo >= shingle else windows(h[lo:hi], hi - lo) if hi > lo else every[:0])


def signature(found: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The low ``BITS`` bits of mixed minima of a non-empty set under ``symbols`` orders."""
    low = np.full(symbols, ~np.uint64(0))
    for i in range(0, len(found), 1 << 12):
        low = np.minimum(low, (found[i : i + (1 << 12), None] * _TIMES[:symbols] + _PLUS[:symbols]).min(axis=0))
    return (mix(low) >> np.uint64(64 - BITS)).astype(np.uint8)


def radius_for(similarity: float, symbols: int = SYMBOLS, miss: float = 1e-6) -> int:
    """The smallest number of differing symbols that pairs of this similarity exceed with probability ``miss`` at most."""
    p = (1 - similarity) * (1 - 0.5**BITS)
    log_f = np.concatenate([[0], np.cumsum(np.log(np.arange(1, symbols + 1)))])
    d = np.arange(symbols + 1)
    share = np.exp(log_f[symbols] - log_f[d] - log_f[symbols - d] + d * np.log(p) + (symbols - d) * np.log1p(-p)) if p else (d == 0).astype(float)
    over = np.concatenate([np.cumsum(share[::-1])[::-1][1:], [0]])
    return int(np.flatnonzero(over <= miss)[0])


def key_places(symbols: int, radius: int, errors: int = 1) -> list[tuple[list[int], list[int]]]:
    """``(places of a chunk, those of them that may differ)`` for every key. With ``errors`` + 1 differing symbols in each
    chunk a pair would exceed the radius."""
    n = -(-(radius + 1) // (errors + 1))
    chunks = [x.tolist() for x in np.array_split(np.arange(symbols), n)]
    if min(map(len, chunks)) <= errors:
        raise ValueError(f"{symbols} symbols are too few for a radius of {radius} with {errors} errors a chunk")
    return [(chunk, list(free)) for chunk in chunks for free in combinations(chunk, errors)]


def keys_of(signatures: np.ndarray, places: list[tuple[list[int], list[int]]]) -> np.ndarray:
    """A 64-bit key for each signature (rows) and each of ``places`` (columns)."""
    symbols = signatures.shape[1]
    each = mix(signatures.astype(np.uint64) + (np.arange(symbols, dtype=np.uint64) << np.uint64(BITS)) + np.uint64(1 << 32))
    out = np.empty((len(signatures), len(places)), np.uint64)
    for k, (chunk, free) in enumerate(places):
        out[:, k] = mix(each[:, chunk].sum(axis=1) - each[:, free].sum(axis=1) + np.uint64(k))
    return out


_SMALL = 48


def linked(bounds: np.ndarray, signatures: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between rows of one group (from ``bounds[g]`` to ``bounds[g + 1]``) within the radius."""
    n = len(signatures)
    parent = np.arange(n)
    lo, hi = bounds[:-1], bounds[1:]
    small = hi - lo <= _SMALL
    step = max(1, (1 << 16) // _SMALL**2)
    for k in range(0, int(small.sum()), step):
        a, b = lo[small][k : k + step], hi[small][k : k + step]
        _, i, j = _grid(a, b, a, b)
        keep = i < j
        i, j = i[keep], j[keep]
        near = (signatures[i] != signatures[j]).sum(axis=1) <= radius
        _link(parent, i[near], j[near])
    for a, b in zip(lo[~small].tolist(), hi[~small].tolist(), strict=True):
        # one row against all others at a time; the largest component's rows need not meet each other
        at, done = np.arange(a, b), np.zeros(b - a, bool)
        k = 0
        while True:
            done[k] = True
            near = at[(signatures[a:b] != signatures[a + k]).sum(axis=1) <= radius]
            _link(parent, np.full(len(near), a + k), near)
            mine = _roots(parent, at)
            root, count = np.unique(mine, return_counts=True)
            left = np.flatnonzero(~done & (mine != root[count.argmax()]))
            if not len(left):
                break
            k = int(left[0])
    root = _roots(parent, np.arange(n))
    far = np.flatnonzero(root != np.arange(n))
    return far, root[far]


def near_links(nodes: DataFrame, radius: int, symbols: int = SYMBOLS, errors: int = 1, unit_limit: int = 500_000) -> DataFrame:
    """Links ``(a, b)`` over nodes (``node, sig``, all different) that connect exactly those connected by pairs within the radius."""
    places = key_places(symbols, radius, errors)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, symbols)
                node = np.repeat(part.column(0).to_numpy(), len(places))
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(sig, places).view(np.int64).ravel()), pa.array(node)], ["key", "node"])

    each = nodes.select("node", "sig").mapInArrow(keys, "key long, node long")
    shared = stored(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    met = join_hot(each, shared, "key", "n", nodes.count() * len(places))
    # a large key's nodes fall into so many parts, and each pair of parts is a unit
    met = met.withColumn("parts", F.ceil(F.col("n") / unit_limit).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    rows = met.select(unit.alias("unit"), "node").join(nodes.select("node", "sig"), "node").select("unit", "node", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_units(batches, 100_000):
            unit, node = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(2))
            sig = np.frombuffer(b"".join(x for b in got for x in b.column(2).to_pylist()), np.uint8).reshape(len(unit), symbols)
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            a, b = linked(np.append(first, len(unit)), sig, radius)
            a, b = np.unique(np.stack([np.maximum(node[a], node[b]), np.minimum(node[a], node[b])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, symbols: int = SYMBOLS, errors: int = 1, miss: float = 1e-6,
    unit_limit: int = 500_000, block: int = 512, few: int = 200_000,
) -> DataFrame:
    """``doc_id, fp, n_shingles, component_id``: the smallest id reachable over pairs of at least ``similarity``, itself included.

    fp names the class of equal sets (null for empty ones). ``few`` bounds the classes whose ids are broadcast to fetch their texts;
    above it they are joined by shuffle.
    """
    source = texts(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = list(shingle_sets(batch.column(1).to_pylist(), shingle))
        sigs = [signature(h, symbols).tobytes() if len(h) else None for h in sets]
        fps = [_class_of(h) if len(h) else None for h in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "fp", "n_shingles", "sig"])

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [h for h in shingle_sets(batch.column(0).to_pylist(), shingle) if len(h)]
        return pa.RecordBatch.from_arrays([pa.array([_class_of(h) for h in sets], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], ["of", "set"])

    each = stored(source.mapInArrow(per_batch(signed), f"doc_id {id_type}, fp long, n_shingles long, sig binary"), "signatures")
    full = each.where("fp IS NOT NULL")
    classes = stored(full.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("sig").alias("sig")), "classes")
    nodes = stored(classes.groupBy("sig").agg(F.min("fp").alias("node"), F.count("*").alias("of")), "nodes")
    alike = join_hot(classes.select("fp", "sig"), nodes.where(F.col("of") > 1), "sig", "of", classes.count()).where("fp <> node").select(F.col("fp").alias("a"), F.col("node").alias("b"))
    candidates = components(near_links(nodes, radius_for(similarity, symbols, miss), symbols, errors, unit_limit).unionByName(alike))
    near = stored(candidates.join(classes, candidates.node == classes.fp).select("fp", "root", "first_id"), "near")
    wanted = near.select(F.col("first_id").alias("wanted_id")).distinct()
    wanted = wanted.hint("broadcast" if near.count() <= few else "shuffle_hash")
    held = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("raw")
    sets = held.mapInArrow(per_batch(again), "of long, set binary").join(near.select("fp", "root"), F.col("of") == F.col("fp"))
    sets = stored(sets.groupBy("fp").agg(F.first("root").alias("root"), F.first("set").alias("set")), "sets")
    roots = components(verified_links(sets, similarity, block))
    named = roots.join(classes, roots.node == classes.fp).select("node", "root", "first_id")
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    renamed = named.join(first, "root").select(F.col("node").alias("fp"), "component_id")
    of_class = stored(classes.join(renamed, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id")), "labels")
    out = join_hot(full.select("doc_id", "fp", "n_shingles"), of_class, "fp", "n", each.count()).select("doc_id", "fp", "n_shingles", "component_id")
    return out.unionByName(each.where("fp IS NULL").select("doc_id", "fp", "n_shingles", F.col("doc_id").alias("component_id")))
