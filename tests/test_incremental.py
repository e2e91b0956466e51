import json

import pytest
from pyspark.sql import functions as F

from lamella.operators import cells
from lamella.plans import chain, dialogue, incremental, index
from lamella.streaming import requests as serving

TEXTS = {
    0: "intro words\nขั้นตอน\n1. apply at the office\n2. pay the fee\n3. wait\nค่าธรรมเนียม\nthe fee is 75 baht. it is paid once.",
    1: "another document. about mortgages and banks.",
    2: "ระเบียบกรมที่ดิน\nข้อ ๑ one rule\nข้อ ๒ another rule",
    3: "third text on rules and fees",
    4: None,
}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "doc_id long, text string")


def state(held):
    """All that retrieval depends on."""
    docs = sorted((r.doc_id, r.text) for r in held.documents.collect())
    chunks = sorted((r.chunk_id, r.doc_id, r.hierarchy_level, r.chunk_index, r.text, tuple(r.embedding)) for r in held.chunks.collect())
    terms = sorted((r.term, r.df, round(r.idf, 9), r.term_id) for r in held.model.terms.collect())
    counted = sorted((r.doc_id, r.length, r.hierarchy_level, tuple(sorted(zip(r.terms, r.tfs, strict=True)))) for r in held.model.documents.collect())
    return docs, chunks, terms, counted, held.model.doc_count, round(held.model.avg_doc_length, 9)


def asked(spark, *queries):
    return index.questions(spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), index.letters)


def test_changes_give_the_index_of_a_fresh_build(spark, tmp_path):
    path = str(tmp_path / "index")
    first = incremental.upsert(frame(spark, {0: "old fee text", 1: TEXTS[1], 5: "goes away", 6: "goes too"}), path, embed=index.letters)
    assert (first.number, len(first.segments)) == (1, 1)
    early = state(incremental.opened(spark, path))
    incremental.upsert(frame(spark, TEXTS), path, spark.createDataFrame([(5,), (77,), (None,)], "doc_id long"), embed=index.letters)
    incremental.upsert(frame(spark, {7: "short lived", 3: "wrong for a while"}), path, embed=index.letters)
    last = incremental.upsert(frame(spark, {3: TEXTS[3]}), path, spark.createDataFrame([(6,), (7,)], "doc_id long"), embed=index.letters)
    assert last.number == 4
    fresh = index.build(frame(spark, TEXTS), str(tmp_path / "fresh"), embed=index.letters)
    assert state(incremental.opened(spark, path)) == state(fresh)
    hits = [sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in index.retrieve(held, asked(spark, "fee paid", "rule", "banks")).collect()) for held in (incremental.opened(spark, path), fresh)]
    assert hits[0] == hits[1] != []
    # every version stays as it was; compaction changes none
    assert state(incremental.opened(spark, path, 1)) == early
    packed = incremental.compacted(spark, path)
    assert (packed.number, len(packed.segments)) == (5, 1)
    assert state(incremental.opened(spark, path)) == state(fresh)
    assert incremental.versions(spark, path) == [1, 2, 3, 4, 5]
    incremental.upsert(frame(spark, {9: "new"}), path, embed=index.letters)
    assert {r.doc_id for r in incremental.opened(spark, path).documents.collect()} == {*TEXTS, 9}


def test_unchanged_documents_are_left_alone(spark, tmp_path):
    path = str(tmp_path)
    incremental.upsert(frame(spark, TEXTS), path, embed=index.letters)
    same = incremental.upsert(frame(spark, TEXTS | {1: "another  document. about mortgages and banks.\n"}), path, embed=index.letters)
    assert same.number == 1
    rows = [(1, "b", 1), (1, "a", 2), (2, "x", 1), (2, "y", 1), (None, "lost", 1)]
    incremental.upsert(spark.createDataFrame(rows, "doc_id long, text string, v long"), path, version_col="v", embed=index.letters)
    _, segment = incremental.manifest(spark, path).segments[-1]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/segments/{segment}/documents").select("doc_id", "text").collect()) == [(1, "a"), (2, "y")]
    assert incremental.opened(spark, path).documents.count() == len(TEXTS)
    # a commit that only deletes has no chunks
    incremental.upsert(frame(spark, TEXTS).where("false"), path, spark.createDataFrame([(2,)], "doc_id long"), embed=index.letters)
    assert sorted({r.doc_id for r in incremental.opened(spark, path).chunks.collect()}) == [0, 1, 3, 4]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path)
    one = incremental.commit(spark, path, incremental.Version(1, [(1, "s")]))
    with pytest.raises(incremental.Conflict):
        incremental.commit(spark, path, incremental.Version(1, [(1, "t")]))
    assert incremental.manifest(spark, path) == one
    assert json.loads((tmp_path / "manifests" / "000000000001.json").read_text()) == {"number": 1, "segments": [[1, "s"]], "chunk_schema": ""}
    with pytest.raises(ValueError, match="no version"):
        incremental.opened(spark, str(tmp_path / "none"))


def test_both_legs_by_files(spark, tmp_path):
    held = index.build(frame(spark, TEXTS), str(tmp_path / "index"), embed=index.letters)
    files = index.inverted(held, str(tmp_path / "files"), clusters=3, segment_docs=2)
    q = asked(spark, "fee paid", "rule", "banks and mortgages")
    for level in (None, 1, 2, "auto"):
        rows = [sorted((r.query_id, r["rank"], r.chunk_id, r.score, r.bm25_score, r.dense_score) for r in index.retrieve(x, q, level, config=index.Config(probes=None)).collect()) for x in (held, files)]
        assert rows[0] == rows[1] != []
    assert isinstance(files.cells, cells.Cells)


def test_chain_answers_and_remembers(spark, tmp_path):
    held = index.build(frame(spark, TEXTS), str(tmp_path / "index"), embed=index.letters)
    rows = [(1, "s", "ค่าธรรมเนียม fee paid"), (2, "s", "and the weather"), (3, "t", "hello"), (4, "u", "เอกสาร rule")]
    requests = spark.createDataFrame(rows, "query_id long, session_id string, query string")
    history = spark.createDataFrame([("s", 0, "user", "banks"), ("s", 1, "assistant", "yes")], "session_id string, seq long, role string, content string")
    rewrite = lambda context, query: F.when(query.contains("weather"), F.concat(F.lit("ที่ดิน "), F.regexp_extract(context, "User: (\\w+)", 1))).otherwise(query)
    got = {r.query_id: r for r in chain.answered(held, requests, history, index.letters, rewrite=rewrite).collect()}
    assert {i: r.route for i, r in got.items()} == {1: "RAG", 2: "RAG", 3: "ABOUT_BOT", 4: "RAG"}
    assert got[2].asked == "ที่ดิน banks" and got[2].query == "and the weather"
    assert "75 baht" in got[1].answer and "source: 1" in got[2].answer and got[3].answer == dialogue.ABOUT_ANSWER and got[3].num_chunks == 0
    assert got[1].num_chunks > 0 and len(got[1].answer) <= 500


def test_stream_and_batches_give_the_same_memory(spark, tmp_path):
    held = index.build(frame(spark, TEXTS), str(tmp_path / "index"), embed=index.letters)
    schema = "query_id long, session_id string, query string"
    parts = [[(1, "s", "ค่าธรรมเนียม fee"), (2, "s", "hello"), (3, "t", "เอกสาร rule")], [(4, "t", "and more"), (5, "u", "banks ที่ดิน")], [(6, "s", "โฉนด waits")]]
    options = {"embed": index.letters, "rewrite": lambda context, query: F.concat(query, F.lit(" "), F.right(context, F.lit(5)))}
    source = tmp_path / "in"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / str(i)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        serving.serve(stream, held, str(tmp_path / "stream"), str(tmp_path / "checkpoint"), **options).awaitTermination()
    step = serving.batch_answered(held, str(tmp_path / "batch"), **options)
    for i, part in enumerate(parts):
        step(spark.createDataFrame(part, schema), i)
        step(spark.createDataFrame(part, schema), i)  # an attempt that was repeated
    rows = [sorted(tuple(r) for r in serving.memory(spark, str(tmp_path / name)).collect()) for name in ("stream", "batch")]
    assert rows[0] == rows[1]
    assert [(r[0], r[1]) for r in rows[0]] == [("s", i) for i in range(6)] + [("t", i) for i in range(4)] + [("u", 0), ("u", 1)]
    told = [sorted((r.query_id, r.asked, r.answer) for r in serving.answers(spark, str(tmp_path / name)).collect()) for name in ("stream", "batch")]
    assert told[0] == told[1]
    assert len(told[0]) == 6 and told[0][3][1].startswith("and more ")
