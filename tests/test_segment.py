import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from lamella.functions import fixed_values as fv
from lamella.functions import entities, segment
from lamella.plans import index

LATIN = r"[^\W\d_]"


def brute(stretch, words):
    """The best of all ways, with every one written out."""
    n = len(stretch)
    free = segment.clusters(stretch)
    nodes = [i for i in range(n + 1) if free[i]]
    ways = []

    def go(p, unknown, pieces):
        if p == n:
            ways.append((unknown, sum(k for _, k in pieces), [(-len(w) if k else 0) for w, k in pieces], pieces))
            return
        later = [q for q in nodes if q > p]
        for q in later:
            if stretch[p:q] in words:
                go(q, unknown, [*pieces, (stretch[p:q], True)])
        go(later[0], unknown + later[0] - p, [*pieces, (stretch[p : later[0]], False)])

    go(0, 0, [])
    best = min(ways, key=lambda w: w[:3])[3]
    out = []
    for i, (w, k) in enumerate(best):
        if not k and i and not best[i - 1][1]:
            out[-1] += w
        else:
            out.append(w)
    return out


def test_best_of_all_ways():
    rng = random.Random(6)
    for _ in range(400):
        words = {"".join(rng.choice("abก") for _ in range(rng.randrange(1, 5))) for _ in range(6)}
        stretch = "".join(rng.choice("abกกเา") for _ in range(rng.randrange(1, 11)))
        root = segment.trie(words)
        assert segment.shortest(stretch, root) == brute(stretch, words), (stretch, words)


def test_clusters_stay_whole():
    free = segment.clusters("เกี่ยว")
    assert [i for i, f in enumerate(free) if f] == [0, 4, 5, 6]
    # a dictionary word that would part a mark from its consonant isn't taken
    assert segment.shortest("กิน", segment.trie(["ก", "น"])) == ["กิ", "น"]


def test_tokens_of_mixed_text():
    cut = segment.cutter(["ที่ดิน", "ค่าธรรมเนียม", "การ", "โอน", "ที่"], stopwords=frozenset(["การ"]))
    assert cut(["ค่าธรรมเนียมการโอนที่ดิน 75 บาท e-QLands", "", "ที่ดินABC12 ๕๐"]) == [["ค่าธรรมเนียม", "โอน", "ที่ดิน", "75", "บาท", "e", "qlands"], [], ["ที่ดิน", "abc12", "๕๐"]]
    latin = segment.cutter(["is", "land", "island", "the", "he"], script=LATIN)
    assert latin(["TheIsland,island2heland"]) == [["the", "island", "island", "2", "he", "land"]]


def test_table_is_checked_and_counted(spark):
    words = spark.createDataFrame([("a",), ("b",), ("b",), ("",), (None,)], "word string")
    assert segment.collected(words) == ["a", "b"]
    with pytest.raises(ValueError, match="more than 1"):
        segment.collected(words, most=1)
    toks = spark.createDataFrame([(["x", "y", "x", "9"],), (["y"],), (None,), (["abcdefgh"],)], "tokens array<string>")
    assert [tuple(r) for r in segment.word_table(toks, longest=5).collect()] == [("y", 2), ("x", 1)]


def test_thai_question_finds_its_chunk(spark, tmp_path):
    """Without blanks a clause is one token; with the dictionary its words match."""
    texts = ["ผู้ซื้อต้องชำระค่าธรรมเนียมการโอนที่ดินร้อยละสอง", "ผู้เช่าต้องยื่นคำขอจดทะเบียนการเช่าห้องชุด", "ผู้จำนองยื่นเอกสารต่อสำนักงานทุกครั้ง", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = segment.segmenter(spark, segment.domain_words(), stopwords=fv.THAI_STOPWORDS)
    asked = spark.createDataFrame([(0, "ค่าธรรมเนียมโอนที่ดิน"), (1, "จดทะเบียนเช่า"), (2, "เอกสารจำนอง")], "query_id long, query string")
    built = index.build(docs, str(tmp_path / "cut"), embed=index.letters, tokenise=cut)
    hits = index.retrieve(built, index.questions(asked, index.letters, tokenise=cut), mode="sparse")
    assert {r.query_id: r.document_id for r in hits.where("rank = 1").collect()} == {0: 0, 1: 1, 2: 2}
    plain = index.build(docs, str(tmp_path / "plain"), embed=index.letters)
    assert index.retrieve(plain, index.questions(asked, index.letters), mode="sparse").count() == 0


def test_all_short_stretches_and_null(spark):
    words = ["a", "ab", "ba", "abb"]
    stretches = ["".join(x) for n in range(1, 6) for x in product("ab", repeat=n)]
    cut = segment.segmenter(spark, words, script=LATIN)
    df = spark.createDataFrame([(s,) for s in [*stretches, None]], "t string")
    got = {r.t: r.tokens for r in df.select("t", cut(F.col("t")).alias("tokens")).collect()}
    assert got == {None: [], **{s: brute(s, set(words)) for s in stretches}}


def test_entities_are_those_of_a_search_for_each(spark):
    rng = random.Random(3)
    table = [("t%d" % rng.randrange(3), "".join(rng.choice("abก") for _ in range(rng.randrange(1, 5)))) for _ in range(40)]
    texts = ["".join(rng.choice("abก ") for _ in range(rng.randrange(0, 60))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    find = entities.finder(spark, entities.collected(spark.createDataFrame([*table, ("x", ""), ("x", None)], "type string, needle string")))
    got = {r.t: [tuple(f) for f in r.f] for r in df.select("t", find(F.col("t")).alias("f")).collect()}
    for t in [*texts, None]:
        want = []
        for kind, needle in sorted(set(table)):
            places = [i for i in range(len(t or "")) if t.startswith(needle, i)]
            want += [(kind, needle, len(places), places[0])] if places else []
        assert got[t] == want
    assert entities.automaton([])("abc") == []
    with pytest.raises(ValueError, match="more than 1"):
        entities.collected(spark.createDataFrame(table, "type string, needle string"), most=1)


def test_flags_of_a_chunk(spark):
    text = "หากผู้โอนเป็นคนต่างด้าว เว้นแต่กรณีตามมาตรา 5\n1. โฉนดที่ดิน\n๒) บัตรประชาชน\na | b\n--- | ---"
    find = entities.finder(spark, entities.default_table())
    row = spark.createDataFrame([(text,), (None,)], "t string").select("t", find(F.col("t")).alias("f")).select("t", "f", entities.flags(F.col("f"), F.col("t")).alias("g")).orderBy(F.desc("t")).first()
    assert [(f.type, f.needle) for f in row.f if f.type in ("person", "document")] == [("document", "บัตรประชาชน"), ("document", "โฉนดที่ดิน"), ("person", "คนต่างด้าว"), ("person", "ผู้โอน")]
    assert tuple(row.g) == (True, True, 2, True, 1, False, True, 2, True, 1)
