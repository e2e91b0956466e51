import random

import numpy as np

from lamella.llm import decontam as dc


def fixture(seed=0):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(6000)]
    common = vocab[:30]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(vocab)
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "too short"), (103, items[3][1])]
    docs, truth = [], set()
    for i in range(150):
        body = [word() for _ in range(rng.randint(0, 400))]
        kind = i % 5
        if kind < 3:
            k, text = rng.choice(items[:40])
            ws = text.split()
            if kind == 1:  # a paraphrase: some words go or change
                ws = [rng.choice(vocab) if rng.random() < 0.12 else w for w in ws if rng.random() > 0.06]
            at = rng.randint(0, len(body))
            if kind == 2:  # only a few words in common
                ws = ws[:6]
            else:
                truth.add((i, k))
                truth |= {(i, 103)} if k == 3 else set()
            body[at:at] = ws
        docs.append((i, " ".join(body), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "the " * 30_000 + items[5][1].upper() + ".", "x"), (None, items[6][1], "x")]
    truth |= {(902, 5), (None, 6)}
    return docs, items, truth


def test_finds_copies_and_paraphrases_only(spark):
    docs, items, truth = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string, cosine string").repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b, block=25).collect()}
    assert len(truth & got) >= 0.95 * len(truth)
    assert not got - truth


def test_candidates_recall_against_brute_force(spark):
    docs, items, _ = fixture(1)
    d = spark.createDataFrame([(t or "",) for _, t, _ in docs], "raw string").selectExpr("cast(raw AS binary) AS raw")
    b = spark.createDataFrame([(t or "",) for _, t in items], "raw string").selectExpr("cast(raw AS binary) AS raw")
    space = dc.fit(d, b)
    block = dc.Items.of([i for i, _ in items], [(t or "").encode() for _, t in items], [None] * len(items), space, 8, 8)

    def dense(ws):
        h = dc.features(np.array(ws, np.uint64))
        _, col, x = dc.vectors(h, np.array([0]), np.array([len(h)]), space.idf)
        out = np.zeros(dc.DIMS)
        out[col] = x
        return out

    q = np.stack([dense(w) for w in block.words])
    found = total = 0
    for _, t, _ in docs:
        ws = dc.word_hashes((t or "").encode())
        near = {c for _, c, *_ in dc.search(dc.features(ws), np.array([0, len(ws)]), space.idf, block, 0.25)}
        if len(ws):
            cosine = np.max([q @ dense(ws[a:e]) for a, e in zip(*dc.passages(len(ws)))], axis=0)
            want = set(np.flatnonzero(cosine >= 0.28).tolist())
            total += len(want)
            found += len(want & near)
    assert total > 50 and found >= 0.9 * total


def test_answer_column_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(30))
    b = spark.createDataFrame([(1, text, "word3 word4"), (2, text, "paris")], "item_id long, text string, answer string")
    d = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b, answer_col="answer").collect()} == {(7, 1)}
    assert dc.contaminated(d.where("false"), b).count() == 0
    assert dc.contaminated(d, b.where("false")).count() == 0


def test_verbatim_items_beyond_the_rank(spark):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(15, 59))) for i in range(2000)]
    docs = [(i, f"{text(60)} {t} {text(60)}") for i, t in items]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(2000)}


def test_short_items_verbatim(spark):
    b = spark.createDataFrame([(1, "Who wrote Faust?", "goethe"), (2, "capital of france", None), (3, "one two three four five six seven", None)], "item_id long, text string, answer string")
    filler = " ".join(f"f{i}" for i in range(100))
    texts = [f"{filler} who wrote faust? Goethe did {filler}", f"{filler} who wrote faust {filler}", "the Capital of France", "capital france of", f"{filler} one two three four five six seven", "one two three four five six"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(d, b, answer_col="answer").collect()} == {(0, 1), (2, 2), (4, 3)}
    assert {r.doc_id for r in dc.clean_rows(d, b.select("item_id", "text")).collect()} == {3, 5}


def test_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert dc.lcs(a, b) == t[-1][-1]


def test_a_window_that_fails_one_limit_hides_no_other():
    item = list(range(10))
    ws = [-1] * 40 + [0, 1, 2, 3, 4, 5, 6, 7] + [-2] * 120 + [0, 1, 2, 3, 8, 9] + [-3] * 40  # more of the item, then its answer
    assert dc.check(ws, 0, len(ws), item, {8, 9}, 0.6, 0.25) == (0.6, 1.0)


def test_paraphrases_beyond_the_rank_against_brute_force(spark):
    """Items with every fourth word or so replaced and others dropped, more of them than dimensions."""
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(4000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, text(rng.randint(15, 59))) for i in range(600)]
    docs = []
    for i, ws in items:
        other = [rng.choice(vocab) if rng.random() < 0.25 else w for w in ws if rng.random() > 0.05]
        docs.append((i, text(60) + other + text(60)))
    share = {i: dc.lcs(ws, d) / len(ws) for (i, ws), (_, d) in zip(items, docs, strict=True)}
    want = {i for i in share if share[i] >= 0.6}
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    got = {r.doc_id for r in dc.contaminated(d, b).where("doc_id = item_id").collect()}
    assert len(want) > 400 and got <= {i for i in share if share[i] >= 0.6}
    assert len(got & want) >= 0.9 * len(want)


def test_cosines_of_passages_with_repeated_words(spark):
    """A passage that says an item's words over and over isn't nearer to it than itself."""
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta"), (1, "one two three four five six seven eight nine")]
    docs = [(0, items[0][1] * 1), (1, (items[0][1] + " ") * 6), (2, "alpha alpha alpha " + items[0][1]), (3, "eight " * 20 + items[1][1])]
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 0), (2, 0), (3, 1)}
    assert all(0 <= r.cosine <= 1 for r in got)


def topics(rng, n=220):
    """Documents of two words each, which no other document has, and items that have all of these words."""
    vocab = [f"t{i}" for i in range(2 * n)]
    docs = [" ".join(rng.choice(vocab[2 * i : 2 * i + 2]) for _ in range(48)) for i in range(n)]
    rng.shuffle(vocab)
    return docs, [" ".join(vocab[i::5]) for i in range(5)]


def fitted(spark, docs, items):
    rows = lambda ts: spark.createDataFrame([(t,) for t in ts], "raw string").selectExpr("cast(raw AS binary) AS raw")
    return dc.fit(rows(docs).repartition(3), rows(items))


def kept(space, text):
    """The share of a passage's vector that the space keeps."""
    h = dc.features(dc.word_hashes(text.encode()))
    _, col, x = dc.vectors(h, np.array([0]), np.array([len(h)]), space.idf)
    some = space.index[col] >= 0
    return float(np.linalg.norm(x[some] @ space.basis[space.index[col[some]]]))


def test_the_space_is_fitted_on_all_documents(spark, monkeypatch):
    docs, items = topics(random.Random(2))
    space = fitted(spark, docs, items)
    assert min(kept(space, t) for t in docs) > 0.99
    monkeypatch.setattr(dc, "_GRAM", 0, raising=False)  # by passes over the texts instead of products of features
    space = fitted(spark, docs, items)
    assert min(kept(space, t) for t in docs) > 0.99


def test_products_of_features_against_brute_force():
    rng = random.Random(4)
    raws = [" ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(n)).encode() for n in (0, 1, 3, 47, 48, 49, 65, 300, 2000)]
    idf = np.random.default_rng(1).random(dc.DIMS) + 0.1
    used = np.unique(dc.features(dc.word_hashes(b" ".join(b"w%d" % i for i in range(0, 60, 2)))))
    index = np.full(dc.DIMS, -1)
    index[used] = np.arange(len(used))
    want = np.zeros((len(used), len(used)))
    for raw in raws:
        h = dc.features(dc.word_hashes(raw))
        if len(h):
            row, col, x = dc.vectors(h, *dc.passages(len(h)), idf)
            a = np.zeros((row.max() + 1, len(used)))
            a[row[index[col] >= 0], index[col[index[col] >= 0]]] = x[index[col] >= 0]
            want += a.T @ a
    n = len(used)
    order, square = np.zeros(dc.DIMS + 1, np.uint16), np.zeros(dc.DIMS + 1)
    order[np.concatenate([used, np.setdiff1d(np.arange(dc.DIMS), used), [dc.DIMS]])] = np.arange(dc.DIMS + 1)
    square[order[: dc.DIMS]] = idf**2
    total = np.zeros((n + 1) ** 2)
    dc.add_products(raws, order, square, n, total)
    got = total.reshape(n + 1, n + 1)[:n, :n] * idf[used] * idf[used][:, None]
    assert np.allclose(got + got.T, want)


def test_clean_rows_fits_on_all_documents(spark, monkeypatch):
    docs, items = topics(random.Random(3), 230)
    seen, gram = [], dc._gram
    monkeypatch.setattr(dc, "_gram", lambda docs, *rest: (seen.append(docs.count()), gram(docs, *rest))[1])
    d = spark.createDataFrame([*enumerate(docs), (900, f"x y z {items[0]}")], "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in dc.clean_rows(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()} == set(range(230))
    assert seen == [231]
