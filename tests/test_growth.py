"""What a job does once, and what a task holds."""

import pyarrow as pa
from pyspark.sql import functions as F

from lamella.operators import bm25
from lamella.plans import index
from lamella.plans.chunk_queries import structured

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_structured_texts_are_split_once(spark):
    assert plan(structured(spark, SF).select("text")).count("split(") == 1


def test_tokens_are_counted_in_pieces(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([["a"] * 200_000, None, ["b"] * 100_000, ["c"] * 300_000, []])], ["doc_id", "tokens"])
    got = list(bm25._pieces(batch))
    assert [p.column(0).to_pylist() for p in got] == [[0, 1], [2], [3], [4]]
    toks = spark.createDataFrame([(1, ["b", "a", "b"]), (2, None), (3, [])], "doc_id long, tokens array<string>")
    assert sorted((r.doc_id, r.length, sorted(zip(r.terms, r.tfs, strict=True))) for r in bm25.counted(toks).collect()) == [(1, 3, [("a", 1), ("b", 2)]), (2, 0, []), (3, 0, [])]


def test_questions_without_words_cost_no_block(spark):
    asked = spark.createDataFrame([(i, ["a"] if i == 7 else []) for i in range(10)] + [(10, None)], "query_id long, tokens array<string>")
    assert list(bm25._blocks(asked, 2)) == [[(7, ["a"])]]


def test_letters(spark):
    got = spark.createDataFrame([("AabZ é",), ("",)], "t string").select(index.letters(F.col("t")).alias("v"))
    assert [(r.v[0], r.v[1], r.v[25], sum(r.v[2:25])) for r in got.collect()] == [(2.0, 1.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0.0)]
    assert "regexp" not in plan(got).lower()


def test_hits_are_searched_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two\nthree"), (2, "two four")], "doc_id long, text string")
    built = index.build(docs, str(tmp_path), embed=index.letters, levels=2)
    asked = index.questions(spark.createDataFrame([(1, "two")], "query_id long, query string"), index.letters)
    hits = index.retrieve(built, asked, level=0, mode="sparse", rerank=False)
    assert "MapInArrow" not in plan(hits)
    got = index.expanded(built, hits)
    assert plan(got).count("hits-") <= 1
    assert sorted((r.document_id, r.children_texts) for r in got.collect()) == [(1, ["one two\nthree"]), (2, ["two four"])]


def test_texts_are_cleaned_once_for_an_index(spark, tmp_path, monkeypatch):
    read = []
    monkeypatch.setattr(index.index_store, "write_chunks", lambda chunks, path, write=index.index_store.write_chunks: (read.append(chunks.inputFiles()), write(chunks, path)))
    docs = str(tmp_path / "docs")
    spark.createDataFrame([(1, " one  two\r\nthree"), (2, None)], "doc_id long, text string").write.parquet(docs)
    built = index.build(spark.read.parquet(docs), str(tmp_path / "index"), embed=index.letters, levels=2)
    assert all("/index/documents/" in f for f in read[0])
    assert sorted((r.doc_id, r.hierarchy_level, r.text) for r in built.chunks.collect()) == [(1, 0, "one two\nthree"), (1, 1, "one two\nthree"), (2, 0, ""), (2, 1, "")]


def test_patterns_are_tried_where_their_words_are(spark):
    """With the same groups as without: texts that have a pattern's words but no match, matches, null."""
    from lamella.functions.metadata import metadata

    texts = ["นาที 5 วัน บาท", "ใช้ ๕ นาที 7 วัน 10.5 บาท ร้อยละ 2 และ 3%", "%", "มาตรา ๓ คำสั่งที่ 4/2 กฎกระทรวงฉบับที่ 1 (พ.ศ. 2520) พ.ร.บ. x", "first\nsecond", "", None]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", metadata(F.col("t")).alias("m"))
    got = {r.i: r.m for r in m.collect()}
    assert [got[i].service.processing.standard for i in (0, 2, 4)] == [None] * 3 or got[0].service.processing.standard.time_minutes is None
    assert (got[1].service.processing.standard.time_minutes, got[1].service.processing.standard.time_days) == (5, 7)
    assert sorted((f.amount, f.unit) for f in got[1].fees.all_fees) == [(2.0, "%"), (3.0, "%"), (10.5, "บาท")]
    assert [got[i].fees.has_fees for i in (0, 1, 2, 5)] == [False, True, False, False]
    assert [r.type for r in got[3].legal_references] == ["พ.ร.บ.", "กฎกระทรวง", "มาตรา", "คำสั่ง"]
    assert (got[4].title, got[5].title, got[6].title, got[6].fees.all_fees) == ("first", None, None, None)
    assert got[3].version_info.law_year == "2520"


def test_letters_of_null(spark):
    v = spark.createDataFrame([(None,), ("zZq eé",)], "t string").select(index.letters(F.col("t")).alias("v")).collect()
    assert v[0].v == [None] * 26
    assert (v[1].v[25], v[1].v[16], v[1].v[4], sum(v[1].v)) == (2.0, 1.0, 1.0, 4.0)


def test_strip_is_no_search_and_takes_all_white_space(spark):
    import random

    from lamella.functions.text import WHITE, strip

    chars = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32') AS c")
    assert {r.c for r in chars.where(r"c rlike '(?U)^\\s$'").collect()} == set(WHITE)
    rng = random.Random(6)
    texts = ["".join(rng.choice(WHITE + "aé​\x1c") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    assert "regexp" not in plan(rows.select(strip(F.col("t")))).lower()
    assert rows.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_relatives_of_few_hits_shuffle_no_chunks(spark, tmp_path):
    """Hits bring their parent's id and are known to be few, so that chunks are read for parents and children only and stay where they lie."""
    docs = spark.createDataFrame([(i, f"one two {i}\nthree") for i in range(50)], "doc_id long, text string")
    built = index.build(docs, str(tmp_path), embed=index.letters, levels=2)
    asked = index.questions(spark.createDataFrame([(1, "two 7")], "query_id long, query string"), index.letters)
    got = index.expanded(built, index.retrieve(built, asked, level=1, mode="sparse", rerank=False))
    assert sum("total_chunks" in line for line in plan(got).splitlines() if "Relation" in line) == 2
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    top = got.where("rank = 1").first()
    assert (top.document_id, top.text, top.parent_text, top.children_texts) == (7, "one two 7\nthree", "one two 7\nthree", [])
