import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest

from lamella.llm import periodic, queries


def brute(words, min_length, min_exponent):
    """Every maximal stretch for every period, and of equal stretches the smallest period."""
    best, n = {}, len(words)
    for q in range(1, n // min_exponent + 1):
        start = 0
        for i in range(q, n + 1):
            if i == n or words[i] != words[i - q]:
                if i - start >= max(min_length, min_exponent * q):
                    best.setdefault((start, i - start), q)
                start = i - q + 1
    return sorted((s, size, q) for (s, size), q in best.items())


def some_words(rng, n):
    words = []
    while len(words) < n:
        kind = rng.randrange(4)
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 12))]
        words += unit * rng.randrange(1, 9) if kind else [rng.randrange(3) for _ in range(rng.randrange(30))]
        if kind == 3:
            words += unit[: rng.randrange(len(unit))]
    return words[:n]


@pytest.mark.parametrize(("min_length", "min_exponent"), [(24, 3), (6, 3), (2, 2), (8, 2), (1, 4)])
def test_runs_are_those_of_a_plain_search(min_length, min_exponent):
    rng = random.Random(4)
    for k in range(150):
        words = some_words(rng, rng.randrange(1, 160))
        want = brute(words, min_length, min_exponent)
        assert periodic.runs_of(words, min_length, min_exponent) == want
        text = " ".join(map(str, words)).encode()
        assert periodic.text_runs([b"", text, b"a b", text], min_length, min_exponent) == [[], want, brute(["a", "b"], min_length, min_exponent), want]


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(brute(words, 24, 3), key=lambda r: (r[0], r[2]))
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_query_matches_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = ["w%d" % rng.randrange(30) if rng.random() < 0.5 else "ü" for _ in range(rng.randrange(200))] if i % 2 else some_words(rng, rng.randrange(300))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(map(str, words)), "clash"))
    rows += [(1000, None, ""), (1001, "", ""), (None, "a " * 50, ""), (7, "a b " * 30, ""), (7, "a b " * 30, "")]
    schema = "doc_id long, text string, runs string"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == sorted((plain_row(*r[:2]) for r in rows), key=repr)
    assert sum(r.n_runs > 0 for r in got) > 60
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert queries.op11_periodic_runs(spark, str(tmp_path / "empty")).count() == 0


def test_long_texts():
    """Near linear in the words, for one word over and over, for a long period and for texts in slices."""
    rng = random.Random(1)
    for words in (["a"] * 60_000, [str(rng.randrange(10**6)) for _ in range(15_000)] * 4, ["x", "y", "z"] * 20_000):
        began = time.time()
        (found,) = periodic.text_runs([" ".join(words).encode()], 24, 3)
        assert [(s, n) for s, n, _ in found] == [(0, 60_000)]
        assert time.time() - began < 30
    words = [w for k in range(50) for w in [str(rng.randrange(10**6)) for _ in range(100)] + ["é%d" % k] * 40]
    raw = " ".join(words).encode()
    want = [(k * 140 + 100, 40, 1) for k in range(50)]
    assert periodic.text_runs([raw], 24, 3) == [want]
    kept = b" ".join(w.encode() for i, w in enumerate(words) if i % 140 <= 100)
    assert {periodic.collapsed(raw, want, most) for most in (10, 1000, 1 << 22)} == {kept}
