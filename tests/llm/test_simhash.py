import random

import numpy as np
import pytest
import xxhash

from lamella.llm import simhash
from lamella.llm.common import stored
from lamella.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "é É  x\x0by z Straße a a a a", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_links_match_brute_force(budget):
    rng = random.Random(budget)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(60)})
    v = np.array(values, np.uint64)
    a, b = simhash.trie_links(np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), v, budget)
    assert all((values[i] ^ values[j]).bit_count() <= 64 for i, j in zip(a, b))
    parent = {i: i for i in range(len(v))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        parent[find(i)] = find(j)
    brute = {i: i for i in range(len(v))}

    def bfind(i):
        while brute[i] != i:
            i = brute[i]
        return i

    for i in range(len(v)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                brute[bfind(i)] = bfind(j)
    groups = lambda f: sorted(sorted(k for k in range(len(v)) if f(k) == r) for r in {f(i) for i in range(len(v))})
    assert groups(find) == groups(bfind)


@pytest.mark.parametrize("limit", [20_000, 8])
def test_near_duplicates_match_brute_force(spark, limit):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(40, 300))] for _ in range(40)]
    rows = [(i, " ".join(t), "x") for i, t in enumerate(base)]
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((100 + i, " ".join(t), "y"))
    rows += [(500, None, None), (501, "", "z"), (502, " \n", "z"), (503, "one two", "z"), (503, "one two", "z"), (504, "ONE  two", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = simhash.near_duplicates(docs, node_limit=limit).collect()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    ids = [r[0] for r in rows]
    roots = brute_components(fps)
    want = sorted((ids[i], fps[i], min(ids[j] for j in range(len(rows)) if roots[j] == roots[i])) for i in range(len(rows)))
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_components_of_a_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_units_are_streamed_whole():
    import pyarrow as pa

    unit = np.sort(np.random.default_rng(2).integers(0, 40, 5000))
    batches = [pa.RecordBatch.from_arrays([pa.array(unit[i : i + 300])], ["unit"]) for i in range(0, 5000, 300)]
    parts = [np.concatenate([b.column(0).to_numpy() for b in held]) for held in simhash.whole_units(iter(batches), most=700)]
    assert np.concatenate(parts).tolist() == unit.tolist() and len(parts) > 4
    assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))


def test_hot_classes_and_stars(spark):
    """One class with most rows, and one node with most links, are joined by broadcast and lose nothing."""
    docs = spark.createDataFrame([(i, "the very same text of some words" if i < 3000 else f"other text number {i} of {i * 7}") for i in range(3600)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = {i: simhash.fingerprint(t.encode()) for i, t in [(0, "the very same text of some words")]}
    assert {got[i] for i in range(3000)} == {0} and len(got) == 3600 and fps
    edges = spark.createDataFrame([(i, 5000) for i in range(1, 3000)] + [(7000, 7001)], "a long, b long")
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 1) for i in [*range(1, 3000), 5000]} | {(7000, 7000), (7001, 7000)}


def test_stars_need_no_round_and_none_is_made_twice(spark, monkeypatch):
    made = []
    monkeypatch.setattr("lamella.llm.components.stored", lambda df, label: made.append(label) or stored(df, label))
    for links, roots, rounds in (
        ([(i, 1) for i in range(2, 40)] + [(1, 7), (50, 60), (60, 50)], {i: 1 for i in range(1, 40)} | {50: 50, 60: 50}, 0),
        ([(1, 9), (2, 9), (2, 8), (3, 8)], {i: 1 for i in (1, 2, 3, 8, 9)}, 2),
        ([], {}, 0),
    ):
        made.clear()
        assert {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == roots
        assert made.count("nodes") == 1 + rounds and len(made) == 2 + 4 * rounds
