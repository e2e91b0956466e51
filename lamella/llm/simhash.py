"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint has a bit for each of 64 majority votes over the hashed shingles of a text. Equal
fingerprints form one class. Classes are joined to each other by walking pairs of trie nodes together:
a pair carries the number of bits in which its paths differ and is dropped as soon as that exceeds the
budget.

To spread the walk, four tries are built, each on the fingerprint turned by 16 bits. Two fingerprints
that differ in at most three bits agree in a whole block of 16, so in one of the four tries their paths
stay together over the first 16 levels: a trie node of that depth is one unit of work and its pairs
need no other. A node above ``node_limit`` fingerprints is cut by up to 16 of its next bits into pairs of subnodes
within the budget, and a task holds one unit at a time. Inside a unit the walk links with union-find and hands out only a spanning forest,
never all pairs of a group.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any
other; fewer words than a shingle give one shingle of the whole sequence; repeated rows and ids are kept;
a null id is kept and never is a component's name unless the component has no other; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, per_batch, stored, texts
from .components import components

BITS, BLOCK = 64, 16
_CUT = 16  # bits by which a large node is cut at most


def fingerprint(raw: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    k = min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.dtype("<u8"))
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):  # eight bytes a shingle become 64
        votes += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * votes > len(h)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``; fp is the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "fp"])

    out = texts(docs, id_col, text_col)
    return out.mapInArrow(per_batch(run), f"doc_id {out.schema['doc_id'].dataType.simpleString()}, fp long")


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        p = parent[i]
        up = parent[p]
        if np.array_equal(p, up):
            return p
        parent[i] = up
        i = up


def _link(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of all pairs; the smaller index becomes the root."""
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b = np.maximum(ra[apart], rb[apart]), np.minimum(ra[apart], rb[apart])
        np.minimum.at(parent, a, b)


def stars(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A forest's links (``a`` to its root ``b``, as indices) as links ``a, b`` of each name to its component's smallest one: units that
    meet the same classes then give the same links, whatever order they hold them in."""
    hub = names.copy()
    np.minimum.at(hub, b, names[a])
    ends, hubs = np.concatenate([names[a], names[np.unique(b)]]), np.concatenate([hub[b], hub[np.unique(b)]])
    return pa.RecordBatch.from_arrays([pa.array(ends[ends != hubs]), pa.array(hubs[ends != hubs])], ["a", "b"])


def _grid(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All leaf pairs of pairs of ranges: the pair's number and the two leaves."""
    nb = bhi - blo
    size = (ahi - alo) * nb
    which = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return which, alo[which] + k // nb[which], blo[which] + k % nb[which]


#: Pairs of leaves of two nodes that may be listed.
_PAIRS = 1 << 16


def _link_blocks(parent: np.ndarray, wide: np.ndarray, alo: int, ahi: int, blo: int, bhi: int, budget: int) -> None:
    """Links within two ranges of leaves that can't be told apart by their path, one leaf against all others at
    a time. Leaves of the largest component need not be compared with each other."""
    at = np.arange(alo, ahi) if alo == blo else np.concatenate([np.arange(alo, ahi), np.arange(blo, bhi)])
    done = np.zeros(len(at), bool)
    k = 0
    while True:
        done[k] = True
        near = at[np.bitwise_count(wide[at] ^ wide[at[k]]).sum(axis=1) <= budget]
        _link(parent, np.full(len(near), at[k]), near)
        root, count = np.unique(_roots(parent, at), return_counts=True)
        left = np.flatnonzero(~done & (_roots(parent, at) != root[count.argmax()]))
        if not len(left):
            return
        k = left[0]


def trie_links(
    unit: np.ndarray, side: np.ndarray, value: np.ndarray, budget: int, leaf: int = 24, chunk: int = 1 << 17, wide: np.ndarray | None = None, wide_budget: int = 0
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between values of the same unit that differ in at most ``budget`` bits.

    Rows of a unit have side 0, or side 0 and 1 where two subnodes meet. Returns two index arrays into
    the input. Node pairs are walked depth first in chunks, so the frontier stays bounded; a pair of
    nodes that already lie in one component, or whose remaining levels cannot exceed the budget, is
    settled without going down. ``wide`` are longer fingerprints (rows of 64-bit words) that must also be within
    ``wide_budget`` bits.
    """
    order = np.lexsort([value, side, unit])
    v, u, s = value[order], unit[order], side[order]
    n = len(v)
    w = None if wide is None else wide[order]
    parent = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (u[1:] != u[:-1]) | (s[1:] != s[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    two = np.zeros(len(lo), bool)
    two[1:] = u[lo[1:]] == u[lo[:-1]]
    second = np.flatnonzero(two)
    alone = np.ones(len(lo), bool)
    alone[second] = alone[second - 1] = False
    for limit in sorted({1, budget} - {0}) if budget else [0]:
        stack = [
            (0, lo[alone], hi[alone], lo[alone], hi[alone], np.zeros(int(alone.sum()), np.int64)),
            (0, lo[second - 1], hi[second - 1], lo[second], hi[second], np.zeros(len(second), np.int64)),
        ]
        while stack:
            level, alo, ahi, blo, bhi, e = stack.pop()
            if len(alo) > chunk:
                for i in range(0, len(alo), chunk):
                    stack.append((level, *(x[i : i + chunk] for x in (alo, ahi, blo, bhi, e))))
                continue
            if not len(alo):
                continue
            # settled: every leaf of both nodes is in one component already
            root = _roots(parent, np.arange(n)) if len(alo) > 64 else None
            if root is not None:
                edge = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
                one = (edge[ahi - 1] == edge[alo]) & (edge[bhi - 1] == edge[blo]) & (root[alo] == root[blo])
                alo, ahi, blo, bhi, e = (x[~one] for x in (alo, ahi, blo, bhi, e))
            # the levels left can't exceed the budget
            sure = e + (BITS - level) <= limit if w is None else np.zeros(len(e), bool)
            if sure.any():
                for x, y in ((alo[sure], ahi[sure]), (blo[sure], bhi[sure])):
                    i = np.repeat(x, y - x)
                    _link(parent, np.arange(len(i)) - np.repeat(np.cumsum(y - x) - (y - x), y - x) + i, i)
                _link(parent, alo[sure], blo[sure])
                alo, ahi, blo, bhi, e = (x[~sure] for x in (alo, ahi, blo, bhi, e))
            small = ((ahi - alo) * (bhi - blo) <= leaf) | (level == BITS)
            if small.any():
                rows = np.stack([x[small] for x in (alo, ahi, blo, bhi)], axis=1)
                large = (rows[:, 1] - rows[:, 0]) * (rows[:, 3] - rows[:, 2]) > _PAIRS
                for x in rows[large].tolist():
                    _link_blocks(parent, w, *x, wide_budget)
                _, i, j = _grid(*rows[~large].T)
                ok = np.flatnonzero((i != j) & (np.bitwise_count(v[i] ^ v[j]) <= limit))
                if w is not None:
                    ok = ok[np.bitwise_count(w[i[ok]] ^ w[j[ok]]).sum(axis=1) <= wide_budget]
                _link(parent, i[ok], j[ok])
                alo, ahi, blo, bhi, e = (x[~small] for x in (alo, ahi, blo, bhi, e))
            if not len(alo):
                continue
            bit = np.uint64(BITS - 1 - level)
            ones = np.concatenate([[0], np.cumsum((v >> bit) & np.uint64(1))]).astype(np.int64)
            amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
            same = alo == blo
            parts = [
                (alo, amid, blo, bmid, e, np.ones(len(e), bool)),
                (amid, ahi, bmid, bhi, e, np.ones(len(e), bool)),
                (alo, amid, bmid, bhi, e + 1, e < limit),
                (amid, ahi, blo, bmid, e + 1, ~same & (e < limit)),
            ]
            kept = [[x[ok & (p[0] < p[1]) & (p[2] < p[3])] for x in p[:5]] for *p, ok in parts]
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))
    root = _roots(parent, np.arange(n))
    far = np.flatnonzero(root != np.arange(n))
    return order[far], order[root[far]]


def _turned(fp: Column, by: int) -> Column:
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _masks(bits: int, budget: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= budget]


def links(fps: DataFrame, budget: int = 3, node_limit: int = 20_000) -> DataFrame:
    """Links ``(a, b)`` of a spanning forest over distinct fingerprints within ``budget`` (at most 3) bits.

    Sizes of the 4 x 65,536 trie nodes are counted first. That table has a fixed bound; only nodes above
    ``node_limit`` are broadcast.
    """
    if not 0 <= budget < BITS // BLOCK:
        raise ValueError("four blocks find pairs of at most three differing bits")
    fp = F.col("fp")
    turned = fps.select("fp", F.posexplode(F.array(*(_turned(fp, BLOCK * i) for i in range(BITS // BLOCK)))).alias("turn", "v"))
    turned = turned.withColumn("node", F.col("turn") * (1 << BLOCK) + F.shiftrightunsigned("v", BITS - BLOCK).cast("int"))
    hot = turned.groupBy("node").count().where(F.col("count") > node_limit)
    cut = hot.select(F.col("node").alias("hot_node"), F.least(F.lit(_CUT), F.ceil(F.log2(F.col("count") / node_limit))).cast("int").alias("bits"))
    parts = turned.join(F.broadcast(cut), F.col("node") == F.col("hot_node"), "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    sub = F.expr(f"IF(bits = 0, 0, cast(shiftrightunsigned(shiftleft(v, {BLOCK}), 64 - bits) AS int))")
    near = F.lit(0)
    options = {b: _masks(b, budget) for b in range(_CUT + 1)}
    choice = F.when(F.lit(False), F.array(near))
    for b, masks in options.items():
        choice = choice.when(F.col("bits") == b, F.array(*map(F.lit, masks)))
    # a subnode meets itself and each subnode within the budget; a pair's unit is named by its smaller one
    met = (
        parts.withColumn("sub", sub)
        .withColumn("mask", F.explode(choice))
        .withColumn("other", F.col("sub").bitwiseXOR(F.col("mask")))
        .select("fp", "v", "node", F.least("sub", "other").alias("low"), F.greatest("sub", "other").alias("high"), (F.col("sub") > F.col("other")).cast("int").alias("side"))
        .withColumn("unit", F.xxhash64("node", "low", "high"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_units(batches):
            unit, side, v, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(4))
            yield stars(fp, *trie_links(unit, side, v.view(np.uint64), budget))

    return met.select("unit", "side", "v", "fp").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def whole_units(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by their first column, in lists of about ``most`` rows that never part a unit."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        if size >= most:
            last = held[-1].column(0)[-1].as_py()
            cut = int(np.searchsorted(unit, last, side="right"))
            if cut:
                held.append(batch.slice(0, cut))
            if cut == batch.num_rows:
                size += cut
                continue
            yield held
            batch, held, size = batch.slice(cut), [], 0
        held.append(batch)
        size += batch.num_rows
    if held:
        yield held


def _labelled(each: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``each`` (``doc_id, fp``, ...) with the smallest id of its component over ``edges`` between classes ``fp, first_id, n``."""
    roots = components(edges)
    # only classes with a link to another class need their component's first id; they are few
    named = roots.join(classes, roots.node == classes.fp).select("node", "root", "first_id")
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(first, "root").select(F.col("node").alias("fp"), "component_id")
    of_class = classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "first_id").alias("component_id"))
    return join_hot(each, stored(of_class, "labels"), "fp", "n", each.count()).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, node_limit: int = 20_000) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id reachable over links, itself included."""
    each = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return _labelled(each, classes, links(classes.select("fp"), budget, node_limit))


WORDS = 4


def shingles(raw: bytes, shingle: int = 5) -> np.ndarray:
    """The sorted hashes of the set of a text's word shingles."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - k + 1].tolist()
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[s:e]) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(raw: bytes, shingle: int = 5) -> np.ndarray:
    """A SimHash of ``64 * WORDS`` bits over the set of word shingles."""
    return _wide(shingles(raw, shingle))


def _wide(h: np.ndarray) -> np.ndarray:
    """The bits of a set of hashes; each hash is extended by mixing."""
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    votes = np.zeros(BITS * WORDS, np.int64)
    for i in range(0, len(h), 1 << 14):
        x = h[i : i + (1 << 14), None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).astype("<u8")
        votes += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(h), bitorder="little").view("<u8").astype(np.uint64)


def _class_of(h: np.ndarray) -> int:
    """The name of a set of shingles, signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.astype("<u8").tobytes())).view(np.int64))


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two sets of equal size with this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _tries(p: float, prefix: int, limit: int, miss: float) -> int:
    """Tries such that a pair whose bits differ with probability ``p`` each is missed with probability ``miss`` at
    most: by more than ``limit`` differing bits, or because no try has its prefix equal. The tries select from the same
    bits, so the number of differing ones is summed over."""
    bits = BITS * WORDS
    log_f = np.concatenate([[0], np.cumsum(np.log(np.arange(1, bits + 1)))])
    d = np.arange(bits + 1)
    weight = np.exp(log_f[bits] - log_f[d] - log_f[bits - d] + d * np.log(p) + (bits - d) * np.log1p(-p)) if p else (d == 0).astype(float)
    rest = np.maximum(bits - prefix - d, 0)
    equal = np.where(d <= bits - prefix, np.exp(log_f[bits - prefix] - log_f[rest] - log_f[bits] + log_f[bits - d]), 0)
    seen = d <= limit
    over = float(weight[~seen].sum())
    if over >= miss:
        raise ValueError(f"{limit} of {bits} bits alone miss a share of {over:.4f}")
    tries = 1
    while over + float((weight[seen] * (1 - equal[seen]) ** tries).sum()) > miss:
        tries += 1
    return tries


def similar_links(classes: DataFrame, similarity: float, miss: float = 0.02, prefix: int = 14, unit_limit: int = 50_000) -> DataFrame:
    """Candidate links ``(a, b)`` over classes (``fp, wide``): they connect all of at least ``similarity``, and others.

    A similarity of 0.8 leaves too many differing bits for four blocks, so there are more tries, each over its
    own order of 64 of the bits, and a pair is met where it agrees in the first ``prefix`` bits of one. The number of
    tries follows from the prefix such that a pair of large sets at the threshold is missed with probability ``miss`` at most, and closer pairs
    far less; neither depends on the table. (Sets of a few shingles, whose votes tie, are ``few_links``' part.) The walk
    allows three standard deviations over the expected bits. A unit above ``unit_limit`` classes is dealt to chunks,
    each pair of which is a unit of its own.
    """
    n = classes.count()
    p = differing_share(similarity)
    bits = BITS * WORDS
    budget, wide_budget = (int(np.ceil(m * p + 3 * np.sqrt(m * p * (1 - p)))) for m in (BITS, bits))
    tries = _tries(p, prefix, wide_budget, miss)
    orders = np.stack([np.random.default_rng(i).permutation(bits)[:BITS] for i in range(tries)])

    def paths(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        raw = np.frombuffer(b"".join(part.column(column).to_pylist()), np.uint8).reshape(part.num_rows, -1)
        every = np.unpackbits(raw, axis=1, bitorder="little")
        for t in range(tries):
            v = np.ascontiguousarray(np.packbits(every[:, orders[t]], axis=1)).view(">u8").astype(np.uint64).ravel()
            yield t, v, ((v >> np.uint64(BITS - prefix)) + np.uint64(t << 32)).view(np.int64)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                got = [np.unique(u, return_counts=True) for _, _, u in paths(batch.slice(at, 4096), 1)]
                unit, count = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(count.astype(np.int64))], ["unit", "n"])

    hot: dict[int, int] = {}
    if n > unit_limit:
        counted = classes.select("fp", "wide").mapInArrow(sizes, "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))
        hot = {r["unit"]: -(-r["n"] // unit_limit) for r in counted.where(F.col("n") > unit_limit).toLocalIterator()}
    names = ["unit", "side", "v", "fp", "wide"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large = np.array(sorted(hot), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fp = part.column(0).to_numpy(zero_copy_only=False)
                for _, v, unit in paths(part, 1):
                    cut = np.isin(unit, large) if len(large) else np.zeros(len(unit), bool)
                    plain = np.flatnonzero(~cut)
                    rows, units, sides = [plain], [unit[plain]], [np.zeros(len(plain), np.int32)]
                    for u in np.unique(unit[cut]).tolist():
                        i = np.flatnonzero(unit == u)
                        k = (fp[i].view(np.uint64) % np.uint64(hot[u])).astype(np.int64)
                        for other in range(hot[u]):
                            key = [xxhash.xxh3_64_intdigest(b"%d %d %d" % (u, min(a, other), max(a, other))) for a in k.tolist()]
                            rows.append(i)
                            units.append(np.array(key, np.uint64).view(np.int64))
                            sides.append((k > other).astype(np.int32))
                    i = np.concatenate(rows)
                    cols = [pa.array(np.concatenate(units)), pa.array(np.concatenate(sides)), pa.array(v[i].view(np.int64)), pa.array(fp[i]), part.column(1).take(pa.array(i))]
                    yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in whole_units(batches):
            unit, side, v, fp = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in got]) for i in range(4))
            wide = np.frombuffer(b"".join(x for b in got for x in b.column(4).to_pylist()), "<u8").reshape(len(fp), WORDS)
            yield stars(fp, *trie_links(unit, side, v.view(np.uint64), budget, 64, 1 << 15, wide, wide_budget))

    met = classes.select("fp", "wide").mapInArrow(spread, "unit long, side int, v long, fp long, wide binary")
    return met.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


#: Sets of so many shingles are few, and so many common ones of the least are a key.
FEW, _COMMON = 20, 3


def few_keys(h: np.ndarray, similarity: float) -> list[int]:
    """Keys of a set (sorted hashes) of at most ``FEW`` shingles: every choice of ``_COMMON`` of its first ones.

    Two sets of n and m elements with the similarity share ``o = ceil(similarity * max(n, m))`` elements at least, so their n - o + 3
    and m - o + 3 smallest have three in common: such a pair meets in a key.
    """
    n = len(h)
    if not _COMMON < n <= FEW:
        return []  # equal sets are one class, and with three or fewer no other set is similar enough above 0.75
    first = h[: n - int(np.ceil(similarity * n - 1e-9)) + _COMMON].tolist()
    return [int(np.uint64(xxhash.xxh3_64_intdigest(np.array(x, "<u8").tobytes())).view(np.int64)) for x in combinations(first, _COMMON)]


def few_links(classes: DataFrame) -> DataFrame:
    """Candidate links ``(a, b)`` over classes (``fp, keys``): they connect all pairs of small sets that are similar enough, without
    exception. Each class is linked to the smallest one with the same key, so no group becomes pairs."""
    each = classes.where("size(keys) > 0").select("fp", F.explode("keys").alias("key"))
    low = stored(each.groupBy("key").agg(F.min("fp").alias("first"), F.count("*").alias("n")).where("n > 1"), "keys")
    total = low.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_hot(each, low, "key", "n", total).where("fp <> first").select(F.col("fp").alias("a"), F.col("first").alias("b"))


def _alike(common: np.ndarray, m: np.ndarray, n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of m and n elements with so many common ones reach the similarity."""
    return common >= similarity * (m + n - common) - 1e-9


def exact_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between the sets whose Jaccard similarity is ``similarity`` at least, by counting common elements."""
    n = len(sets)
    parent, size = np.arange(n), np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(of, kind="stable")
    posted, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(of))])
    begin = np.concatenate([[0], np.cumsum(size)])
    for i in range(n):
        mine = of[begin[i] : begin[i + 1]]
        lo, count = first[mine], first[mine + 1] - first[mine]
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        common = np.bincount(posted[at], minlength=n)
        near = np.flatnonzero((common > 0) & _alike(common, size[i], size, similarity))
        _link(parent, np.full(len(near), i), near)
        if i % 64 == 0 and not _roots(parent, np.arange(n)).any():
            break
    root = _roots(parent, np.arange(n))
    far = np.flatnonzero(root != np.arange(n))
    return far, root[far]


def verified_links(sets: DataFrame, similarity: float, block: int = 512, rounds: int = 6) -> DataFrame:
    """Links ``(a, b)`` that connect exactly those classes of one candidate component that links of ``similarity`` connect.

    ``sets`` (``root, fp, set``) has the shingles of each class. A component of at most ``block`` classes is one unit
    of work. In a larger one every class is first compared with one pivot, for some rounds, each pivot being one that was near to none
    before; what the pivots don't connect is dealt to blocks, and each pair of blocks of different groups is a unit.
    """

    def as_sets(column: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u8") for x in column.to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, fps, held = None, [], []

        def done() -> pa.RecordBatch:
            a, b = exact_links(held, similarity) if len(held) > 1 else (np.zeros(0, np.int64),) * 2
            return stars(np.array(fps, np.int64), a, b)

        for batch in batches:
            for u, fp, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_sets(batch.column(2)), strict=True):
                if u != unit and held:
                    yield done()
                    fps, held = [], []
                unit = u
                fps.append(fp)
                held.append(h)
        if held:
            yield done()

    def within(rows: DataFrame) -> DataFrame:
        return rows.select("unit", "fp", "set").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")

    sizes = stored(sets.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    small = sets.join(sizes.where(F.col("n") <= block), "root").select(F.col("root").cast("string").alias("unit"), "fp", "set")
    if sizes.where(F.col("n") > block).isEmpty():
        return within(small)

    def by_pivot(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [bool(_alike(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), similarity)) for a, b in zip(as_sets(batch.column(2)), as_sets(batch.column(4)), strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3)), pa.array(ok, pa.bool_())], ["root", "fp", "pivot", "ok"])

    # rows of a component are dealt to parts, and its pivot goes to each of them
    parts = sizes.where(F.col("n") > block).select("root", F.ceil(F.col("n") / 4096).cast("int").alias("parts"))
    every = stored(sets.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")), "large")
    left, edges = every, None
    for _ in range(rounds):
        pivots = left.groupBy("root").agg(F.min(F.struct("fp", "set")).alias("s"), F.max("parts").alias("parts"))
        pivots = stored(pivots.select("root", F.col("s.fp").alias("pivot"), F.col("s.set").alias("pivot_set"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), "pivots")
        # all of the component, not only what is left: who is near two pivots joins their groups
        met = every.join(pivots, ["root", "part"]).select("root", "fp", "set", "pivot", "pivot_set")
        judged = stored(met.mapInArrow(per_batch(by_pivot), "root long, fp long, pivot long, ok boolean"), "judged").where("ok")
        now = judged.select("root", "fp", "pivot")
        edges = now if edges is None else edges.unionByName(now)
        left = stored(left.join(now.select("fp"), "fp", "left_anti"), "left")
        if left.isEmpty():
            break
    pivoted = edges.where("pivot <> fp").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    # a class has at most ``rounds`` pivots, so a component has few different sets of them; sets that overlap are one group
    near = stored(edges.groupBy("root", "fp").agg(F.array_sort(F.collect_set("pivot")).alias("near")), "near")
    reach = F.expr(f"aggregate(sequence(1, {rounds}), near, (z, i) -> array_distinct(flatten(filter(sets, s -> arrays_overlap(s, z)))))")
    named = near.groupBy("root").agg(F.collect_set("near").alias("sets")).select("root", "sets", F.explode("sets").alias("near"))
    named = named.select(F.col("root").alias("r"), F.col("near").alias("s"), F.array_min(reach).alias("label"))
    grouped = near.join(named, (F.col("root") == F.col("r")) & (F.col("near") == F.col("s"))).select("fp", "label")
    labels = stored(every.select("root", "fp").join(grouped, "fp", "left"), "pivoted")
    groups = labels.groupBy("root", "label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    groups = stored(groups.withColumn("others", F.count("*").over(Window.partitionBy("root"))).where("others > 1 OR label IS NULL").drop("others"), "groups")
    blocks = groups.select("root", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k")).withColumn("block", F.concat_ws(" ", F.coalesce(F.col("label").cast("string"), F.lit("-")), "k"))
    other = blocks.select("root", F.col("label").alias("label2"), F.col("block").alias("block2"))
    pairs = blocks.join(other, "root").where("block <= block2 AND (label IS NULL OR NOT label <=> label2)")
    units = pairs.select(F.concat_ws(" ", "root", "block", "block2").alias("unit"), "root", F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    placed = labels.join(groups.withColumnRenamed("root", "r").withColumnRenamed("label", "l"), F.expr("root = r AND label <=> l"))
    placed = placed.select("fp", "root", F.concat_ws(" ", F.coalesce(F.col("label").cast("string"), F.lit("-")), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("string")).alias("block"))
    rows = every.select("fp", "set").join(placed, "fp").join(units, ["root", "block"])
    return pivoted.unionByName(within(small.unionByName(rows.select("unit", "fp", "set"))))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, miss: float = 0.02, prefix: int = 14, unit_limit: int = 50_000, block: int = 512) -> DataFrame:
    """``doc_id, fp, component_id`` for links of a Jaccard similarity of at least ``similarity`` (over 0.75) between sets of word
    shingles. fp names the class of equal sets. Candidates come from 256-bit fingerprints, which miss a pair of large sets at the
    threshold with probability ``miss`` at most, and between sets of up to ``FEW`` shingles from common ones, which miss none; the sets
    themselves decide."""
    if similarity <= 0.75:
        raise ValueError("sets of three shingles have no keys, and reach 0.75 with another set")
    source = texts(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, shingle) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_wide(h).astype("<u8").tobytes() for h in sets], pa.binary()), pa.array([_class_of(h) for h in sets], pa.int64()), pa.array([few_keys(h, similarity) for h in sets], pa.list_(pa.int64()))], ["doc_id", "wide", "fp", "keys"])

    def again(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, shingle) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([_class_of(h) for h in sets], pa.int64()), pa.array([h.astype("<u8").tobytes() for h in sets], pa.binary())], ["of", "set"])

    each = stored(source.mapInArrow(per_batch(run), f"doc_id {id_type}, wide binary, fp long, keys array<long>"), "fingerprints")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("wide").alias("wide"), F.min("keys").alias("keys")), "classes")
    near = components(similar_links(classes, similarity, miss, prefix, unit_limit).unionByName(few_links(classes)))
    near = stored(near.join(classes, near.node == classes.fp).select("fp", "root", "first_id"), "near")
    wanted = near.select(F.col("first_id").alias("wanted_id")).distinct()
    held = source.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("raw")
    sets = held.mapInArrow(per_batch(again), "of long, set binary").join(near.select("fp", "root"), F.col("of") == F.col("fp"))
    sets = stored(sets.groupBy("fp").agg(F.first("root").alias("root"), F.first("set").alias("set")), "sets")
    return _labelled(each.select("doc_id", "fp"), classes.select("fp", "first_id", "n"), verified_links(sets, similarity, block))
