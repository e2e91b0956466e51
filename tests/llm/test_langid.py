import random

import numpy as np
import pytest

from lamella.llm import langid

ALPHABETS = {"aa": "abcdefg", "bb": "efghijk", "gr": "αβγδεζ"}


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(ALPHABETS))
        out.append((i, " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 60))), lang))
    return out


def test_held_out_accuracy_and_odd_rows(spark):
    rows = texts(1, 400)
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 -- \n", None), (1003, "αβγ αβγ δεζ " * 4000, None), (None, "αβγδ εζ", "gr"), (3, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", docs_literal()).repartition(4)
    model = langid.fit(docs.where("doc_id % 4 <> 2"), dims=1 << 12)
    assert model.langs == ["aa", "bb", "gr"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert len(got) == 405
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "gr", "gr"]
    assert all(0 <= r.score <= 1 for r in got.values())


def docs_literal():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_no_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()] == [("und", 0.0)]
    assert langid.predict(docs.where("false"), model).count() == 0


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(4000, 3)) * 2
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=r) for r in p])
    assert langid.temperature(s * 4, y) == pytest.approx(4, rel=0.15)


def test_every_prediction_by_plain_loops(spark):
    """Weights, TF-IDF and softmax with dictionaries, against the distributed predictions; and document frequencies by hand."""
    import math
    from collections import Counter

    rows = texts(3, 120)
    docs = spark.createDataFrame(rows + [(500, None, None), (501, "1 2", None)], "doc_id long, text string, lang string").repartition(3)
    dims = 1 << 10
    model = langid.fit(docs, dims=dims)
    df = Counter(k for _, t, _ in rows for k in langid.grams(t, dims)[0].tolist())
    for k in range(dims):
        assert math.isclose(model.idf[k], math.log((1 + len(rows)) / (1 + df[k])) + 1)
    for r in docs.join(langid.predict(docs, model).select("doc_id", "lang_pred", "score"), "doc_id").collect():
        counts = dict(zip(*(x.tolist() for x in langid.grams(r.text, dims)), strict=True))
        if not counts:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = {k: (1 + math.log(n)) * model.idf[k] for k, n in counts.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(float(model.weights[i, k]) * v / size for k, v in x.items()) + model.bias[i]) / model.temperature for i in range(len(model.langs))]
        p = [math.exp(v - max(z)) for v in z]
        assert model.langs[max(range(len(z)), key=z.__getitem__)] == r.lang_pred
        assert math.isclose(r.score, max(p) / sum(p), rel_tol=1e-5)


def test_grams_by_plain_windows():
    """Counts of one to three neighbouring letters and blanks, whatever they are hashed to."""
    for text in ("Ab c", "a", "  x--y 1é ", "日本 語"):
        at, n = langid.grams(text, 1 << 20)
        c, last = " ", " "
        for ch in text.lower():
            now = ch if ch.isalpha() else " "
            if not (now == " " and last == " "):
                c += now
            last = now
        c += " "
        want = Counter2([c[i : i + k] for k in (1, 2, 3) for i in range(len(c) - k + 1)])
        assert sorted(n.tolist()) == sorted(want.values()) and len(at) == len(want)


def Counter2(items):
    out = {}
    for x in items:
        out[x] = out.get(x, 0) + 1
    return out


def test_repeated_ids_do_not_crowd_out_others(spark):
    """400 rows of 20 ids in two languages: the bound is one of ids first, so all of them train."""
    rows = [(i % 20, "abc abd " * 5 if i % 2 else "xyz xzz " * 5, "aa" if i % 2 else "xx") for i in range(400)]
    models = [langid.fit(spark.createDataFrame(rows[::step], "doc_id long, text string, lang string").repartition(n), dims=1 << 10, max_rows=200) for step, n in ((1, 7), (-1, 2))]
    assert [m.langs for m in models] == [["aa", "xx"]] * 2
    assert (models[0].weights == models[1].weights).all()
    assert models[0].predict("abd abc")[0] == "aa" and models[0].predict("xyz")[0] == "xx"
