import random

import numpy as np
import pytest

from lamella.llm import minhash, wordhash


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        if doc is not None:
            low[r] = min(low.get(r, doc), doc)
    return sorted(((doc, len(sets[i]), low.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(rng, words, share):
    return [rng.choice(["neu", "alt", "x%d" % rng.randrange(99)]) if rng.random() < share else w for w in words]


def corpus(seed, groups, copies):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        n = rng.choice([4, 5, 7, 10, 12, 20, 60, 200])
        base = ["w%d" % rng.randrange(5000) for _ in range(n)]
        for _ in range(copies):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.002, 0.01, 0.02, 0.04]))))
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("limits", [{}, {"unit_limit": 7, "block": 5, "few": 0}])
def test_components_are_those_of_all_pairs(spark, limits):
    rows = corpus(5, 45, 9)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "A b"), (5004, "a  B"), (5005, "a b c"), (None, "null id one two three four"), (None, "null id one two three four"), (7000, rows[0][1]), (7000, rows[0][1].upper())]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string").repartition(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, similarity=0.85, **limits).collect()), key=repr)
    assert got == brute(rows, 85)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(9)
    base = ["w%d" % rng.randrange(10**6) for _ in range(300)]
    rows = [(i, " ".join(edited(rng, base, 0.01))) for i in range(1500)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), similarity=0.85, unit_limit=500)
    assert out.where("component_id <> 0").count() == brute_count(rows)


def brute_count(rows):
    """Copies that reach the first by links of 85 percent, by growing its component."""
    sets = [shingles(t) for _, t in rows]
    out, todo, left = set(), [0], set(range(1, len(rows)))
    while todo:
        i = todo.pop()
        near = {j for j in left if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
        left -= near
        todo += near
        out.add(i)
    return len(left)


@pytest.mark.parametrize(("symbols", "radius", "errors"), [(64, 23, 1), (64, 23, 0), (48, 17, 2), (16, 3, 1)])
def test_every_pair_within_the_radius_shares_a_key(symbols, radius, errors):
    rng = np.random.default_rng(1)
    places = minhash.key_places(symbols, radius, errors)
    one = rng.integers(0, 256, (400, symbols)).astype(np.uint8)
    other = one.copy()
    for row in other:
        at = rng.choice(symbols, rng.integers(0, radius + 1), replace=False)
        row[at] ^= rng.integers(1, 256, len(at)).astype(np.uint8)
    assert (minhash.keys_of(one, places) == minhash.keys_of(other, places)).any(axis=1).all()
    assert not (minhash.keys_of(one[1:], places) == minhash.keys_of(one[:-1], places)).any()


def test_pairs_at_the_threshold_stay_within_the_radius():
    rng = np.random.default_rng(2)
    over, agree = 0, []
    radius = minhash.radius_for(0.85)
    for n in (17, 34, 170, 1700):
        for _ in range(250):
            h = rng.integers(0, 1 << 63, n + n * 3 // 17, np.uint64)
            same, rest = h[: n * 17 // 20 * 1], h[n * 17 // 20 :]
            a, b = np.concatenate([same, rest[::2]]), np.concatenate([same, rest[1::2]])
            share = len(same) / len(h)
            differ = (minhash.signature(a) != minhash.signature(b)).sum()
            agree.append(1 - differ / minhash.SYMBOLS - share - (1 - share) / 256)
            if share >= 0.85:
                over += differ > radius
    assert over == 0
    assert abs(np.mean(agree)) < 0.01


def test_word_windows_are_the_same_in_slices():
    rng = random.Random(3)
    raw = " ".join("ab cé defg\n".split()[rng.randrange(3)] * rng.randrange(1, 9) for _ in range(3000)).encode()
    want = wordhash.hashes(raw)
    for most in (1, 7, 100, 5000):
        got = [np.concatenate(x) for x in zip(*wordhash.slices(raw, most), strict=True)]
        assert all((g == w).all() for g, w in zip(got, want, strict=True))
    sets = list(minhash.shingle_sets([raw, b"", b"a", b" a b c d e f ", raw.upper()]))
    assert [len(s) for s in sets[1:4]] == [0, 1, 2]
    assert len(sets[0]) == len(shingles(raw.decode()))
    assert (sets[0] == sets[4]).all()
