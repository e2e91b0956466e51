import hashlib
import random
from collections import Counter

import pytest

from lamella.llm import suffix

LENGTH = 400


def digest(kept):
    return hashlib.sha256(kept).hexdigest()


def brute(texts):
    seen = Counter(t[i : i + LENGTH] for t in texts for i in range(len(t) - LENGTH + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, digest(kept)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    rand = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [rand(n) for n in (398, 399, 400, 401, 450, 700, 1500)]
    texts = [None, "", "short", rand(399), rand(400)]
    texts += [texts[4], "a" * 1000, "a" * 405, "ab" * 600, ("line of text\n" * 90), rand(3000)]
    whole = rand(2500)
    texts += [whole, whole, whole[:1300] + "X" + whole[1300:], whole[5:], whole[:-3], "y" + whole]
    for _ in range(40):
        t = rand(rng.randint(0, 800))
        for _ in range(rng.randint(1, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, 0, rng.randint(0, 40)])
            t += p[a:] + rand(rng.randint(0, 600))
        if rng.random() < 0.3:
            i = rng.randrange(len(t))
            t = t[:i] + "#" + t[i + 1 :]
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed,plain,piece", [(0, False, 1 << 20), (1, False, 700), (1, True, 700)])
def test_matches_brute_force(spark, monkeypatch, seed, plain, piece):
    monkeypatch.setattr(suffix, "_SLICE", piece)  # what the closures hold: long texts are read in slices
    texts = corpus(seed)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id " + texts[11], "x"), (11, texts[11], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_bytes, r.n_removed, r.n_spans, digest(bytes(r.kept)))) for r in suffix.deduplicate(docs, LENGTH, every_position=plain).collect())
    want = brute([(t or "").encode() for _, t, _ in rows])
    assert got == sorted(((r[0] is None, r[0] or 0), w) for r, w in zip(rows, want))
    assert sum(w[1] > 0 for w in want) > 20


def test_rows_that_repeat_are_searched_once(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdé \n") for _ in range(3000))
    rows = [(None, text)] * 300 + [(7, "start " + text[500:1500] + " end")] * 2 + [(8, "x" + text[100:900]), (9, "short"), (9, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, search = [], suffix.repeated_starts
    monkeypatch.setattr(suffix, "repeated_starts", lambda d, length: seen.append(d.count()) or search(d, length))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, digest(bytes(r.kept))) for r in suffix.deduplicate(docs, LENGTH).collect())
    want = brute([t.encode() for _, t in [*rows[:2], *rows[300:]]])
    assert got == sorted((r[0] or 0, *w) for r, w in zip(rows, [want[0]] * 300 + want[2:], strict=True))
    assert seen == [4]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.deduplicate(docs).count() == 0


def test_cut():
    assert suffix.cut(b"abcdefghij", [(1, 2), (7, 7)], 2) == (5, 2, b"aefgj")
    assert suffix.cut(b"abcdef", [(2, 2), (0, 0), (2, 3)], 2) == (5, 1, b"f")
    assert suffix.cut(b"", [], 2) == (0, 0, b"")


@pytest.mark.parametrize("plain", [False, True])
def test_a_very_common_passage(spark, plain):
    """A passage in most documents, at different places, and one document that is most of the rows."""
    rng = random.Random(6)
    rand = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = rand(430)
    texts = [rand(rng.randint(0, 90)) + passage + rand(rng.randint(0, 90)) for _ in range(1500)] + [rand(600) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix.deduplicate(docs, LENGTH, every_position=plain).collect()}
    assert all(got[i][0] >= 430 and got[i][1] == 1 for i in range(1500)) and all(got[i] == (0, 0) for i in range(1500, 1520))
