import math
import re

import pytest
from pyspark.sql import functions as F

from lamella.functions import text as T
from lamella.functions.metadata import metadata
from lamella.functions.query import analysis, parse_route, route
from lamella.operators import assembly, bm25, chunking, dense, fusion, memory, metrics
from lamella.plans import engine
from lamella.sources import index_store, text_files


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("a\n\n \n\n\nb", "a\n\n\n\nb"), ("  a \t b\r\nc\rd ", "a b\nc\nd"), ("x�\u0000y", "xy"), ("", ""), (None, None), ("　a \n b", "a\nb")],
)
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


def test_bm25_fixture(spark):
    docs = spark.createDataFrame([("a", "apple banana apple"), ("b", "banana cherry"), ("c", "cherry cherry date"), ("d", None)], "doc_id string, text string")
    toks = bm25.tokenised(docs.where("doc_id <> 'd'"))
    assert bm25.corpus_stats(toks).first().avg_doc_length == pytest.approx(2.666667, abs=1e-6)
    assert {r.term: round(r.idf, 6) for r in bm25.vocabulary(toks).collect()} == {"apple": 0.980829, "banana": 0.470004, "cherry": 0.470004, "date": 0.980829}
    weights = {(r.doc_id, r.term): round(r.weight, 6) for r in bm25.sparse_vectors(toks).collect()}
    assert weights == {("a", "apple"): 1.347062, ("a", "banana"): 0.444974, ("b", "banana"): 0.529582, ("b", "cherry"): 0.529582, ("c", "cherry"): 0.645499, ("c", "date"): 0.928596}
    queries = spark.createDataFrame([(1, ["apple", "cherry"])], "query_id long, tokens array<string>")
    assert [(r.doc_id, r.score) for r in bm25.search(toks, queries, classic=True).orderBy("rank").collect()] == [("a", 1.347062), ("c", 0.645499), ("b", 0.529582)]
    assert [(r.doc_id, r.score) for r in bm25.search(toks, queries).orderBy("rank").collect()] == [("a", 1.488718), ("c", 0.341844), ("b", 0.280457)]
    assert [r.term_id for r in bm25.term_ids(bm25.vocabulary(toks)).orderBy("term").collect()] == [0, 1, 2, 3]
    assert bm25.corpus_stats(bm25.tokenised(docs)).first().doc_count == 4


def test_rrf_fixture(spark):
    leg = lambda ids: spark.createDataFrame([(1, d, 1.0, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id string, score double, rank int")
    got = {r.doc_id: round(r.score, 6) for r in fusion.rrf(leg("xyz"), leg("yw")).collect()}
    assert got == {"y": 0.016261, "x": 0.012295, "w": 0.012130, "z": 0.012035}
    empty = leg("xyz").where("false")
    assert fusion.rrf(leg("x"), empty).first().score == pytest.approx(0.5 / 61 + 0.5 / 120)


def test_query_analysis_fixture(spark):
    cases = {
        "ค่าธรรมเนียมโอนที่ดิน 2%": ("section", 1, False, "medium", "RAG"),
        "คนต่างชาติซื้อที่ดินในไทยได้ไหม": ("mixed", 2, False, "medium", "RAG"),
        "โฉนดที่ดินคืออะไร": ("document", 0, False, "long", "RAG"),
        "คนต่างชาติจะโอนที่ดินมรดกต้องเสียค่าธรรมเนียมเท่าไหร่และมีขั้นตอนอย่างไร": ("document", 0, True, "short", "RAG"),
        "สวัสดีครับ": ("mixed", 2, False, "medium", "ABOUT_BOT"),
        "this": ("mixed", 2, False, "medium", "ABOUT_BOT"),
        "weather": ("mixed", 2, False, "medium", "OUT_OF_SCOPE"),
    }
    rows = spark.createDataFrame([(q,) for q in cases], "q string").select("q", analysis(F.col("q")).alias("a"), route(F.col("q")).alias("r"), route(F.col("q"), False).alias("w")).collect()
    for r in rows:
        assert (r.a.query_type, r.a.target_level, r.a.is_complex, r.a.estimated_answer_length, r.r) == cases[r.q]
    assert {r.q: r.w for r in rows}["this"] == "OUT_OF_SCOPE"
    assert one(spark, "`rag`", parse_route) == "RAG" and one(spark, "none", parse_route) == "OUT_OF_SCOPE"


def test_metadata(spark):
    text = "คู่มือสำหรับประชาชน : การโอน  ที่ดิน\nหน่วยงานที่ให้บริการ : กรมที่ดิน สาขา\nใช้เวลา 30 นาที หรือ 15 นาที ภายใน 3 วัน\nค่าธรรมเนียม 75 บาท 2 % ร้อยละ 2 และ 75 บาท\nมาตรา 93 มาตรา 93 มาตรา 5 ทวิ\nพ.ศ. 2550\ne-QLands เวลา 20 นาที"
    m = one(spark, text, metadata)
    assert m.document_type == "คู่มือปชช" and m.title == "การโอน ที่ดิน"
    assert m.service.processing.standard.time_minutes == 15 and m.service.processing.standard.time_days == 3
    assert m.service.processing.alternative.time_minutes == 20
    assert [(f.amount, f.unit) for f in m.fees.all_fees] == [(75.0, "บาท"), (2.0, "%")]
    assert [r.section for r in m.legal_references if r.type == "มาตรา"] == ["93", "5 ทวิ"]
    assert m.version_info.law_year == "2550" and m.categories.level1 == "การโอน"
    assert [c.type for c in m.service.channels] == ["online", "walk-in"]
    plain = one(spark, "nothing here", metadata)
    assert plain.document_type == "อื่นๆ" and plain.organization.service_location == ["สำนักงานที่ดิน"] and not plain.fees.has_fees


def brute_sliding(text, limit=600):
    parts = [p for p in re.findall(r"[^.!?๏]*[.!?๏]|[^.!?๏]+", text) if p]
    size = lambda s: math.ceil(len(s) / 4)
    out, now = [], []
    for p in parts:
        if now and sum(map(size, now)) + size(p) > limit:
            out.append("".join(now))
            now = now[-2:] + [p]
        else:
            now.append(p)
    if now:
        out.append("".join(now))
    return [x.strip() for x in out if x.strip()]


def test_chunk_tree(spark):
    listed = "\n".join(["intro"] + [f"{i}. item {i}\nmore {i}" for i in range(10)])
    table = "\n".join(["a | b", "--- | ---", *(f"r{i} | {i}" for i in range(3))])
    required = "\n".join(["รายการเอกสาร หลักฐานประกอบ", *(f"{i}) paper" for i in range(1, 17))])
    long = " ".join(f"Sentence number {i} has some words." for i in range(400))
    text = "\n".join(["หลักเกณฑ์ first line", "x", "ขั้นตอน", listed, "ค่าธรรมเนียม", table, required, "*** กรณี special", "only once", "หมวด 1", long])
    docs = spark.createDataFrame([(1, text, "ระเบียบกรม"), (2, long, "x"), (3, None, "x"), (4, "ข้อ 1 one\nข้อ 2 two", "ระเบียบกรม")], "doc_id long, text string, kind string")
    rows = [r.asDict() for r in chunking.chunk_tree(docs, type_col="kind").orderBy("doc_id", "chunk_index").collect()]
    mine = [r for r in rows if r["doc_id"] == 1]
    sections = [(r["chunk_type"], r["section_title"]) for r in mine if r["hierarchy_level"] == 1]
    assert [s for s, _ in sections] == ["section_default", "section_steps", "section_fees", "section_documents", "section_special", "section_chapter"]
    assert sections[0][1] is None
    lists = [r["text"] for r in mine if r["chunk_type"] == "steps_list_part"]
    assert [len(re.findall(r"(?m)^\d+\.", t)) for t in lists] == [6, 6, 2]
    assert [r["text"] for r in mine if r["chunk_type"] == "fees_table"] == ["a | b\nr0 | 0\nr1 | 1\nr2 | 2"]
    assert [len(re.findall(r"\d+\)", r["text"])) for r in mine if r["chunk_type"].startswith("documents_")] == [5, 10, 1]
    assert [r["chunk_type"] for r in mine if r["chunk_type"] in ("section_special", "special_procedure")] == ["section_special", "special_procedure"]
    assert [r["text"] for r in rows if r["doc_id"] == 2 and r["hierarchy_level"] == 2] == brute_sliding(long)
    assert [r["chunk_type"] for r in rows if r["doc_id"] == 4 and r["hierarchy_level"] == 2] == ["legal_article", "legal_article"]
    for d in (1, 2, 3, 4):
        own = [r for r in rows if r["doc_id"] == d]
        assert [r["chunk_index"] for r in own] == list(range(len(own))) and {r["total_chunks"] for r in own} == {len(own)}
        assert own[0]["previous_chunk_index"] is None and own[-1]["next_chunk_index"] is None
        ids = {r["chunk_id"] for r in own}
        assert len(ids) == len(own) and all(r["parent_chunk_id"] in ids for r in own[1:])


def test_summary_and_groups(spark):
    lines = ["x" * 400, "y" * 100, "z" * 50, "w"]
    got = spark.createDataFrame([(lines,)], "l array<string>").select(chunking.summary(F.col("l")).alias("s")).first().s
    assert got == "\n".join(lines[:3])  # the running count may reach the limit before a line is added


def test_context_expansion(spark):
    docs = spark.createDataFrame([(1, "\n".join(["a. b. c."] * 5))], "doc_id long, text string")
    chunks = engine.build_chunks(docs).persist()
    section = chunks.where("hierarchy_level = 1").select(F.lit(1).alias("query_id"), "chunk_id")
    got = fusion.with_context(section, chunks, siblings=True).first()
    assert got.parent_text.startswith("a. b.") and len(got.children_texts) == chunks.where("hierarchy_level = 2").count()
    leaf = chunks.where("hierarchy_level = 2").select("chunk_id")
    assert sorted(r.distance for r in fusion.ancestors(chunks, leaf).collect()) == [1, 2] * leaf.count() or leaf.count() > 1
    lost = fusion.with_context(spark.createDataFrame([(1, "none")], "query_id int, chunk_id string"), chunks).first()
    assert lost.parent_text is None and lost.children_texts == []


def test_dense(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [-1.0, 0.0]), (6, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 0.0])], "query_id long, vector array<float>")
    got = [(r.query_id, r.doc_id, r.score) for r in dense.search(vectors, queries, 3).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1.0), (10, 6, 1.0), (10, 3, 0.707107)]
    assert vectors.where("vec_id = 2").select(dense.cosine(F.col("embedding"), F.col("embedding")).alias("c")).first().c is None


def test_memory(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(25)]
    messages = spark.createDataFrame(rows, "session_id long, seq long, role string, content string")
    s = memory.statistics(messages).first()
    assert (s.total_messages, s.user_messages, s.assistant_messages, s.total_turns, s.utilisation) == (20, 10, 10, 13, "20/20")
    assert memory.context_window(messages).first().context == "Assistant: m21\nUser: m22\nAssistant: m23\nUser: m24"
    assert memory.context_window(messages, max_chars=4).first().context == "... m24"
    assert memory.last(messages, 0).count() == 25 and memory.last(messages, 3, "user").count() == 3
    with pytest.raises(Exception, match="role not allowed"):
        memory.checked(messages.withColumn("role", F.lit("system"))).collect()


def test_assembly(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.0, 0.5, 1500), (1, 2, "a", 0.9, 0.4, 1500), (1, 3, "b", 0.7, 0.3, 10), (2, 1, "b", None, 0.1, 4000)], "query_id long, rank int, filename string, rerank_score double, score double, n int")
    assert [(r.query_id, r["rank"]) for r in assembly.within_budget(hits, F.col("n")).orderBy("query_id", "rank").collect()] == [(1, 1), (1, 2)]
    assert sorted((r.query_id, r.filename, r.shown_score) for r in assembly.citations(hits, "filename").collect()) == [(1, "a", "0.5000"), (1, "b", "0.7000"), (2, "b", "0.1000")]
    answers = spark.createDataFrame([(1, "aé"), (2, "")], "query_id long, answer string")
    got = [(r.query_id, r.type, r.content) for r in assembly.events(answers).orderBy("query_id", "seq").collect()]
    assert got == [(1, "status", "generating"), (1, "token", "a"), (1, "token", "é"), (1, "final", "aé"), (2, "status", "generating"), (2, "final", "")]


def test_metrics(spark):
    judged = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id long, rank int, relevant boolean")
    got = {r.query_id: r for r in metrics.by_query(judged, 2).collect()}
    assert (got[1].precision, got[1].recall, got[1].reciprocal_rank) == (0.5, 0.5, 0.5)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)), abs=1e-6)
    assert (got[2].precision, got[2].recall, got[2].reciprocal_rank, got[2].ndcg) == (0, 0, 0, 0)


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "in/คู่มือ").mkdir(parents=True)
    (tmp_path / "in/คู่มือ/a(N).txt").write_bytes("﻿สวัสดี  x\r\n".encode())
    (tmp_path / "in/b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "in/c.md").write_text("no")
    got = {r.filename: r for r in text_files.read_text(spark, str(tmp_path / "in")).collect()}
    assert {k: r.text for k, r in got.items()} == {"a(N).txt": "สวัสดี x", "b.txt": "café"}
    assert got["b.txt"].document_type == "" and got["a(N).txt"].relative_path.endswith("a(N).txt")
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, v int, x string")
    new = spark.createDataFrame([(2, 2, None), (3, 1, "c"), (1, 0, "old")], "id long, v int, x string")
    merged = index_store.upsert(old, new, "id", "v")
    assert sorted((r.id, r.x) for r in merged.collect()) == [(1, "a"), (2, None), (3, "c")]
    index_store.export_json(merged, str(tmp_path / "dump"), "points")
    assert index_store.import_json(spark, str(tmp_path / "dump"), merged.schema).count() == 3
    path = index_store.snapshot(merged, str(tmp_path / "snap"), 1)
    assert index_store.read(spark, path).count() == 3
    chunks = engine.build_chunks(spark.createDataFrame([(1, "a. b.")], "doc_id long, text string"))
    index_store.write_chunks(chunks, str(tmp_path / "chunks"))
    kept = index_store.filtered(index_store.read(spark, str(tmp_path / "chunks")), min_importance=0.8, level=1)
    assert kept.count() == 1


def test_streaming_memory(spark, tmp_path):
    from lamella.streaming.sessions import session_memory

    rows = [(s, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for s in (1, 2) for i in range(6)]
    schema = "session_id long, seq long, role string, content string"
    for b in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 3 == b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = session_memory(stream, max_messages=4).writeStream.outputMode("update").format("memory").queryName("mem").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.session_id: r for r in spark.sql("SELECT * FROM mem ORDER BY total_turns, held").collect()}
    assert last[1].held == 4 and last[1].total_turns == 3


def test_dialogue(spark):
    from lamella.plans import dialogue

    requests = spark.createDataFrame([(1, 7, "hello"), (2, 7, "ค่าธรรมเนียมโอน"), (3, 8, "weather"), (4, 8, "จำนอง")], "query_id long, session_id long, query string")
    contexts = spark.createDataFrame([(2, "c" * 900), (1, "unused")], "query_id long, context string")
    got = {r.query_id: (r.route, r.answer) for r in dialogue.answers(requests, contexts).collect()}
    assert got == {1: ("ABOUT_BOT", dialogue.ABOUT_ANSWER), 2: ("RAG", "c" * 500), 3: ("OUT_OF_SCOPE", dialogue.OUT_OF_SCOPE_ANSWER), 4: ("RAG", dialogue.NO_CONTEXT_ANSWER)}
    messages = spark.createDataFrame([(7, 0, "user", "a"), (7, 1, "assistant", "b")], "session_id long, seq long, role string, content string")
    kept = dialogue.remembered(messages, requests, dialogue.answers(requests, contexts)).orderBy("session_id", "seq").collect()
    assert [(r.session_id, r.seq, r.role) for r in kept] == [(7, i, ("user", "assistant")[i % 2]) for i in range(6)] + [(8, i, ("user", "assistant")[i % 2]) for i in range(4)]
    words = spark.createDataFrame([(["fee", "land"],)], "t array<string>").select(dialogue.expanded(F.col("t"), {"fee": ["cost", "land"]}).alias("x")).first().x
    assert words == ["fee", "cost", "land"]
    hits = spark.createDataFrame([(1, 1, 1.0, 1, "a"), (1, 2, 0.9, 2, "a"), (1, 3, 0.8, 3, "b")], "query_id long, doc_id long, score double, rank int, g string")
    assert [r.doc_id for r in dialogue.diversified(hits, "g").orderBy("rank").collect()] == [1, 3, 2]


def test_thai_digits(spark):
    text = "ใช้เวลา ๓๐ นาที ภายใน 99999999999 วัน หรือ ๓ วัน\nค่าธรรมเนียม ๗๕.๕ บาท ร้อยละ ๒\nมาตรา ๙๓ และ มาตรา 93\nพ.ศ. ๒๕๕๐\n๑. แรก"
    m = one(spark, text, metadata)
    assert (m.service.processing.standard.time_minutes, m.service.processing.standard.time_days) == (30, 3)
    assert [(f.amount, f.unit) for f in m.fees.all_fees] == [(75.5, "บาท"), (2.0, "%")]
    assert [r.section for r in m.legal_references if r.type == "มาตรา"] == ["๙๓", "93"]
    assert m.version_info.law_year == "๒๕๕๐" and m.content_features.has_lists
    docs = spark.createDataFrame([(1, "ระเบียบ\nข้อ ๑ หนึ่ง\nข้อ ๒ สอง", "ระเบียบกรม"), (2, "x\nหมวด ๑\ny", "x"), (3, "x\n๑. a\n๒. b\n๓. c", "x"), (4, "a\nหมวด ๑\nno article", "ระเบียบกรม")], "doc_id long, text string, kind string")
    rows = chunking.chunk_tree(docs, type_col="kind").collect()
    assert [r.text for r in rows if r.doc_id == 1 and r.hierarchy_level == 2] == ["ข้อ ๑ หนึ่ง", "ข้อ ๒ สอง"]
    assert [r.section_title for r in rows if r.doc_id == 2 and r.hierarchy_level == 1] == [None, "หมวด ๑"]
    assert [r.chunk_type for r in rows if r.doc_id == 3 and r.hierarchy_level == 2] == ["default_list"]
    assert not [r for r in rows if r.doc_id == 4 and r.hierarchy_level == 2]


def test_stopwords_keep_repeats(spark):
    assert one(spark, "a b b b c", lambda t: T.tokens(t, ["a"])) == ["b", "b", "b", "c"]


def test_children_are_linked(spark):
    docs = spark.createDataFrame([(1, "a. b.\nขั้นตอน\nc.")], "doc_id long, text string")
    rows = {r.chunk_id: r for r in chunking.chunk_tree(docs).collect()}
    for r in rows.values():
        assert all(rows[c].parent_chunk_id == r.chunk_id for c in r.child_chunk_ids)
        assert r.parent_chunk_id is None or r.chunk_id in rows[r.parent_chunk_id].child_chunk_ids
    s = chunking.statistics(chunking.chunk_tree(docs)).first()
    assert (s.total_documents, s.level1_chunks, s.total_chunks) == (1, 2, len(rows))


def test_dense_search_of_odd_vectors(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [None, 1.0]), (4, [])], "vec_id long, embedding array<float>")
    q = lambda rows: spark.createDataFrame(rows, "query_id long, vector array<float>")
    assert dense.search(vectors, q([])).count() == 0
    assert dense.search(vectors, q([(1, None), (2, [])])).count() == 0
    assert [(r.query_id, r.doc_id) for r in dense.search(vectors, q([(1, [1.0, 0.0]), (2, [2.0]), (3, [None, 1.0])]), block=1).orderBy("query_id").collect()] == [(1, 1), (2, 2)]
    assert dense.search(vectors.where("false"), q([(1, [1.0, 0.0])])).count() == 0


def test_many_ties_stay_bounded():
    import numpy as np
    import pyarrow as pa

    from lamella.operators.topk import Best

    best = Best([7, 8], pa.int64(), 3)
    for i in reversed(range(100)):
        best.add(pa.array(range(i * 1000, i * 1000 + 1000)), np.ones((2, 1000)))
        assert best.size <= 110_000
    got = best.batch()
    assert got.column(1).to_pylist() == [0, 1, 2, 0, 1, 2] and got.column(0).to_pylist() == [7, 7, 7, 8, 8, 8]


def test_bm25_model_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([("a", "apple banana apple", 1), ("b", "banana cherry", 2), ("c", "cherry cherry date", 2), ("e", None, 2)], "doc_id string, text string, level int")
    bm25.fit(bm25.tokenised(docs, keep=["level"]), str(tmp_path / "m"))
    model = bm25.load(spark, str(tmp_path / "m"))
    info = model.info().first()
    assert (info.vocabulary_size, info.doc_count) == (4, 4) and info.avg_doc_length == 2.0
    queries = spark.createDataFrame([(1, ["apple", "cherry", "unknown"]), (2, None)], "query_id long, tokens array<string>")
    whole = [(r.doc_id, r.score) for r in model.search(queries).orderBy("rank").collect()]
    assert whole == [(r.doc_id, r.score) for r in bm25.search(bm25.tokenised(docs), queries).orderBy("rank").collect()] and [d for d, _ in whole] == ["a", "c", "b"]
    assert [(r.doc_id, r.score) for r in model.search(queries, where=F.col("level") == 2).orderBy("rank").collect()] == whole[1:]
    dot = {}
    q = {r.term_id: r.weight for r in model.encode(queries).where("query_id = 1").collect()}
    for r in model.vectors().collect():
        dot[r.doc_id] = dot.get(r.doc_id, 0) + r.weight * q.get(r.term_id, 0)
    assert {d: round(s, 6) for d, s in dot.items() if s} == dict(whole)
