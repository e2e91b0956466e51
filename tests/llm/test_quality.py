import math
import random

import numpy as np
from pyspark.sql import functions as F

from lamella.llm import quality


def corpus(n=400):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 150))]
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "###" for w in words]
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_and_odd_rows(spark):
    rows, marks = corpus()
    odd = [(1000, None), (1001, ""), (1002, "x" * 200_000), (None, "null id"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(4)
    labels = spark.createDataFrame(marks + [(5000, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _ in rows if i % 3 == 0]
    truth = np.array(["!!" not in rows[i][1] and "###" not in rows[i][1] for i in held])
    assert np.mean((np.array([got[i] for i in held]) >= 0.3) == truth) > 0.97
    clashing = docs.withColumn("raw", F.lit("r")).withColumn("__quality", F.lit("q"))
    kept = quality.scored_rows(clashing, model, "quality")
    assert kept.columns == [*clashing.columns, "quality"]
    assert {(r.raw, r["__quality"], r.score) for r in kept.collect()} == {("r", "q", "clash")}
    assert quality.score(docs.where("false"), model).count() == 0


def test_score_is_the_sum_of_bins(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # only a pair of features tells
    m = quality.fit_gam(x, y, pairs=1)
    assert set(next(iter(m.pairs))) == {0, 1}
    assert np.mean((m.score(x) > 0.5) == y) > 0.9
    b = m.bins(x[:5])
    by_hand = [m.intercept + sum(t[b[i, f]] for f, t in enumerate(m.single)) + sum(t[b[i, f], b[i, g]] for (f, g), t in m.pairs.items()) for i in range(5)]
    assert np.allclose(m.score(x[:5]), 1 / (1 + np.exp(-np.array(by_hand))))


def test_trees_and_quadrants_match_exhaustive_search():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 12):
        g, h = rng.normal(size=n), rng.uniform(0.1, 1, n)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 2.0)
        cuts = [0, n]
        for _ in range(2):
            options = [(gain(a, i) + gain(i, b) - gain(a, b), i) for a, b in zip(cuts, cuts[1:]) for i in range(a + 1, b)]
            best = max(options, key=lambda x: x[0], default=(0, 0))
            if best[0] > 1e-9:
                cuts = sorted([*cuts, best[1]])
        want = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + 2.0)) for a, b in zip(cuts, cuts[1:])])
        assert np.allclose(quality._tree(g, h, 3, 2.0), want)
    g, h = rng.normal(size=(5, 4)), rng.uniform(0.1, 1, (5, 4))
    cells = lambda i, j: [(slice(0, i), slice(0, j)), (slice(i, 5), slice(0, j)), (slice(0, i), slice(j, 4)), (slice(i, 5), slice(j, 4))]
    worth = {(i, j): sum(g[c].sum() ** 2 / (h[c].sum() + 1.0) for c in cells(i, j)) for i in range(1, 5) for j in range(1, 4)}
    top = max(worth, key=worth.get)
    want = np.empty((5, 4))
    for c in cells(*top):
        want[c] = g[c].sum() / (h[c].sum() + 1.0)
    got = quality._quadrants(g, h, 1.0)
    assert math.isclose(got[0], worth[top]) and np.allclose(got[1], want)


def test_every_score_by_plain_lookups(spark):
    """The distributed scores against loops over features, cuts and tables."""
    rows, marks = corpus(150)
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string").repartition(3)
    m = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"), cycles=20, pair_cycles=5)
    for r in docs.join(quality.score(docs, m), "doc_id").collect():
        x = quality.features([(r.text or "").encode()])[0]
        b = [sum(c <= v for c in cuts) for cuts, v in zip(m.cuts, x)]
        z = m.intercept + sum(t[b[f]] for f, t in enumerate(m.single)) + sum(t[b[f], b[g]] for (f, g), t in m.pairs.items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def test_rows_of_a_repeated_id_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(2, "B!! " * 30)], "doc_id long, text string")
    seen = []
    fitted, quality.fit_gam = quality.fit_gam, lambda x, y, **kw: seen.append(len(y)) or quality.Gam()
    try:
        quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), max_rows=50)
    finally:
        quality.fit_gam = fitted
    assert seen == [50]
