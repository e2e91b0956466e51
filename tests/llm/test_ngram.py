import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lamella.llm import ngram


def split(text):
    return (text or "").encode().lower().split()


def brute(train, texts, order):
    """The same model, from dictionaries."""
    grams = {k: Counter() for k in range(1, order + 1)}
    count = Counter()
    for t in train:
        seq = [*["<s>"] * (order - 1), *split(t), "</s>"]
        grams[order].update(zip(*(seq[j:] for j in range(order))))
        count.update(seq[order - 1 :])
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    n, v = sum(count.values()), len(count)
    d = {k: ngram.discounts([sum(c == x for c in grams[k].values()) for x in (1, 2, 3, 4)]) for k in grams}
    total, kinds = defaultdict(int), defaultdict(lambda: [0, 0, 0])
    for k in grams:
        for g, c in grams[k].items():
            total[k, g[:-1]] += c
            kinds[k, g[:-1]][min(c, 3) - 1] += 1
    off = lambda c, x: max(c - (0, *x)[min(c, 3)], 0)

    def probability(g):
        pairs = total[1, ()]
        rest = sum(x * y for x, y in zip(d[1], kinds[1, ()])) / pairs if pairs else 1
        p = off(grams[1][g[-1:]], d[1]) / max(pairs, 1) + rest / (v + 1)
        for k in range(2, order + 1):
            h = g[-k:]
            if total[k, h[:-1]]:
                p = off(grams[k][h], d[k]) / total[k, h[:-1]] + sum(x * y for x, y in zip(d[k], kinds[k, h[:-1]])) / total[k, h[:-1]] * p
        return p

    out = []
    for t in texts:
        seq = [*["<s>"] * (order - 1), *split(t), "</s>"]
        own = list(zip(*(seq[j:] for j in range(order))))
        out.append((len(own), sum(count[g[-1]] > 0 for g in own), sum(math.log10((count[g[-1]] + 0.5) / (n + 0.5 * (v + 1))) for g in own), sum(math.log10(probability(g)) for g in own)))
    return out, sum(probability((*["<s>"] * (order - 1), w)) for w in [*count, "unk"])


def corpus(seed):
    rng = random.Random(seed)
    words = ["the"] * 30 + ["Of", "é", "x\x0b", "ß"] * 4 + [f"w{i}" for i in range(80)]
    texts = [None, "", "  \n", "one"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return texts + ["the " * 3000]


@pytest.mark.parametrize("order,parts,flush", [(2, 1, 10**9), (2, 7, 500), (3, 5, 700), (4, 3, 10**9)])
def test_matches_brute_force(spark, order, parts, flush):
    texts = corpus(parts)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(5)
    train = docs.where("doc_id % 3 <> 1")
    model = ngram.train(train, order=order, parts=parts, flush=flush)
    got = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram.score(docs, model).collect()}
    want, total = brute([t for i, t in enumerate(texts) if i % 3 != 1], texts, order)
    assert total == pytest.approx(1)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i][:2] == w[:2]
        assert got[i][2:] == pytest.approx(w[2:])
    if parts > 1:
        assert len(model.bounds[2])  # the frequent word's range was cut


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    model = ngram.train(docs.where("false"))
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram.score(docs.orderBy("doc_id"), model).collect()] == [(1, 0, 0.0, 0.0), (3, 0, 0.0, 0.0)]
    assert ngram.score(docs.where("false"), model).count() == 0


def test_counts_beyond_32_bits():
    big = np.array([5, 1 << 40], np.uint64)
    assert ngram._fewest(big).dtype == np.uint64
    key, total = ngram._summed(np.array([7, 7], np.uint64), np.array([(1 << 32) - 1] * 2, np.uint32))
    assert total.tolist() == [2 * ((1 << 32) - 1)]
    assert [x.tolist() for x in ngram._unpack(ngram._pack(np.array([1, 2], np.uint64), big))] == [[1, 2], [5, 1 << 40]]


def test_runs_with_one_context_and_range_key_are_kept_apart():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 1 << 63, 200_000).astype(np.uint64) for _ in range(2)]
    words[0][:] = 12345  # one context with many followers
    assert len(np.unique(ngram.run_hash(words))) == 200_000


def test_lost_files_are_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c d{i}") for i in range(50)], "doc_id long, text string")
    model = ngram.train(docs, model_dir=str(tmp_path), parts=40)
    want = sorted(ngram.score(docs, model).collect())
    files = sorted(p.name for p in (tmp_path / model.path.rsplit("/", 1)[1]).iterdir())
    ranges = {"word": 40, "context2": 40, "run2": 40 + len(model.bounds[2])}
    assert files == sorted(f"{kind}-{p}-{x}.npy" for kind, n in ranges.items() for p in range(n) for x in ("key", "n"))
    few = ngram.train(docs, model_dir=str(tmp_path), parts=40, tasks=3)
    assert sorted(ngram.score(docs, few).collect()) == want
    some = next(p for p in (tmp_path / model.path.rsplit("/", 1)[1]).glob("word-*-key.npy") if len(np.load(p)))
    some.unlink()
    with pytest.raises(Exception, match="No such file"):
        ngram.score(docs, model).collect()
