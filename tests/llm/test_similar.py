import random

import numpy as np
import pytest

from lamella.llm import simhash
from lamella.llm.components import _small_star, components


def graded(seed=0, n=40, words=320):
    """Texts, each with copies whose similarity to it runs from 0.6 to 0.97."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(50_000)}"
    rows = []
    for i in range(n):
        base = [word() for _ in range(words)]
        rows.append((1000 * i, " ".join(base)))
        for k in range(1, 16):
            t = list(base)
            for at in rng.sample(range(words), k):
                t[at] = word()
            rows.append((1000 * i + k, " ".join(t)))
    return rows


def brute(rows, similarity=0.8, k=5):
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + k]) for i in range(max(len(ws) - k + 1, 1))} if ws else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= similarity * union - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("block, unit_limit", [(512, 50_000), (4, 50)])
def test_components_match_brute_force(spark, block, unit_limit):
    rows = graded() + [(90_001, None), (90_002, ""), (90_003, "a b"), (90_004, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, block=block, unit_limit=unit_limit).collect()}
    want = dict(zip([i for i, _ in rows], brute(rows), strict=True))
    assert len(set(want.values())) > 60  # below the threshold they stay apart
    assert got == want


def test_small_sets_are_never_missed(spark):
    """Sets of up to 25 shingles with a word more, fewer or changed at an end or inside: every pair of up to 20 shingles is found."""
    rng = random.Random(5)
    rows = []
    for g in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 24))]
        copies = [words, words[1:], words[:-1], [*words, "new"], ["new", *words], words[2:], [*words, "x", "y"], ["z", *words[1:]]]
        rows += [(100 * g + k, " ".join(w)) for k, w in enumerate(copies)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = {}
    for g in range(400):
        own = [r for r in rows if r[0] // 100 == g]
        want |= dict(zip([i for i, _ in own], brute(own), strict=True))
    near = {i for i, t in rows if len(t.split()) <= 24}
    assert {i: c for i, c in got.items() if i in near and want[i] in near} == {i: c for i, c in want.items() if i in near and c in near}
    with pytest.raises(ValueError, match="three shingles"):
        simhash.similar(spark.createDataFrame(rows[:1], "doc_id long, text string"), similarity=0.75)


def test_groups_that_pivots_connect(spark):
    """A long chain of texts, each near its neighbours only, and a large group of edited copies."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    chain = [word() for _ in range(700)]
    rows = [(i, " ".join(chain[5 * i : 5 * i + 100])) for i in range(100)]
    base = [word() for _ in range(150)]
    rows += [(1000 + i, " ".join(word() if rng.random() < 0.012 else w for w in base)) for i in range(500)]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=16).collect()}
    assert got == dict(zip([i for i, _ in rows], brute(rows), strict=True))


def test_exact_links():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 3, 9], [], [9, 10])]
    a, b = simhash.exact_links(sets, 0.8)
    assert (a.tolist(), b.tolist()) == ([1], [0])


def test_paths_alike_do_not_fill_memory():
    n = 100_000
    rng = np.random.default_rng(1)
    wide = np.zeros((n, 4), np.uint64)
    wide[:, 1:] = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
    wide[-1, 1:] = ~np.uint64(0)
    a, b = simhash.trie_links(np.zeros(n, np.int64), np.zeros(n, np.int64), wide[:, 0].copy(), 18, 64, 1 << 15, wide, 56)
    assert len(set(a.tolist()) | set(b.tolist())) == n - 1


def test_near_copies_have_few_candidate_links(spark):
    """A group of near copies meets in many tries; a class is linked to the smallest of its unit, which is mostly the same one."""
    rng = np.random.default_rng(5)
    bits = np.tile(rng.integers(0, 2, 64 * simhash.WORDS).astype(np.uint8), (400, 1))
    for row in bits:
        row[rng.choice(len(row), 6, replace=False)] ^= 1
    rows = [(int(fp), bytearray(np.packbits(b, bitorder="little").tobytes())) for fp, b in zip(rng.permutation(400), bits, strict=True)]
    links = {(r.a, r.b) for r in simhash.similar_links(spark.createDataFrame(rows, "fp long, wide binary"), 0.8).collect()}
    assert len(links) < 12 * 400
    assert {r.root for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()} == {0}


def test_a_small_star_makes_no_row_twice(spark):
    edges = spark.createDataFrame([(1000, i) for i in range(300)] + [(2000, i) for i in range(300)], "a long, b long")
    got = [(r.a, r.b) for r in _small_star(edges, 600).collect()]
    assert len(got) == 600
    assert set(got) == {(i, 0) for i in range(1, 300)} | {(1000, 0), (2000, 0)}
