import pytest
from pyspark.sql import functions as F

from lamella.functions import models
from lamella.operators import assembly, memory
from lamella.plans import dialogue, index
from lamella.sources import index_store

TEXTS = [
    "intro words\nขั้นตอน\n1. apply at the office\n2. pay the fee\n3. wait\nค่าธรรมเนียม\nthe fee is 75 baht. it is paid once.",
    "another document. about mortgages and banks.",
    "ระเบียบกรมที่ดิน\nข้อ ๑ one rule\nข้อ ๒ another rule",
]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(9, None)], "doc_id long, text string")
    path = str(tmp_path_factory.mktemp("index"))
    index.build(docs, path, embed=index.letters)
    return index.opened(spark, path)


def asked(spark, *queries):
    return index.questions(spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), index.letters)


def test_chunk_retrieval_from_a_kept_index(spark, built):
    q = asked(spark, "fee paid", "mortgages banks", "rule")
    hits = index.retrieve(built, q, level=2)
    top = {r.query_id: r for r in hits.where("rank = 1").collect()}
    assert top[0].document_id == 0 and "fee" in top[0].text and top[1].document_id == 1 and top[2].document_id == 2 and top[2].chunk_type == "legal_article"
    assert {r.hierarchy_level for r in hits.collect()} == {2}
    whole = index.expanded(built, hits, siblings=True)
    first = whole.where("query_id = 2 AND rank = 1").first()
    assert first.parent_text.startswith("ระเบียบกรมที่ดิน") and len(first.sibling_ids) == 1
    cited = assembly.production_citations(whole, "document_id").where("query_id = 2").orderBy("rank").collect()
    assert len(cited) <= 3 and cited[0].has_parent and cited[0].num_children == 0 and cited[0].section == assembly.NO_SECTION
    prompt = index.prompts(whole).where("query_id = 2").first().prompt
    assert prompt.startswith("source: 2\nsection: ") and "level: 2" in prompt
    told = {r.query_id: r for r in index.query_summary(hits).collect()}
    assert told[2].top_score == 1.0 and told[2].num_chunks == hits.where("query_id = 2").count()


def test_modes_and_levels(spark, built):
    q = asked(spark, "fee paid", "ค่าธรรมเนียม fee", "ขั้นตอน apply")
    levels = {r.query_id: r.target_level for r in q.collect()}
    assert levels == {0: 2, 1: 1, 2: 0}
    auto = index.chunk_hits(built, q, "auto").join(built.chunks.select(F.col("chunk_id").alias("doc_id"), "hierarchy_level"), "doc_id")
    assert all(levels[r.query_id] == r.hierarchy_level for r in auto.collect())
    close = index.retrieve(built, q, mode="dense", rerank=False)
    assert close.where("bm25_score IS NULL AND dense_score IS NOT NULL").count() == close.count() > 0
    sparse = index.retrieve(built, q, mode="sparse", rerank=False)
    assert sparse.where("dense_score IS NULL").count() == sparse.count() > 0
    assert index.retrieve(built, q.where("false")).count() == 0


def test_model_adapters(spark):
    rows = spark.createDataFrame([("A b  a",), (None,), ("the x",)], "t string")
    cut = models.tokenizer(lambda: lambda texts: [t.split(" ") for t in texts], frozenset({"the"}))
    assert [r.x for r in rows.select(cut("t").alias("x")).collect()] == [["a", "b", "a"], [], ["x"]]
    embed = models.embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=1)
    assert [r.x for r in rows.select(embed("t").alias("x")).collect()] == [[6.0, 1.0], None, [5.0, 1.0]]
    score = models.reranker(lambda: lambda pairs: [float(len(a) + len(b)) for a, b in pairs])
    assert [r.x for r in rows.select(score(F.lit("q"), "t").alias("x")).collect()] == [7.0, 1.0, 6.0]


def test_collections(spark, tmp_path):
    t = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.0, 0.0])], "id long, v array<float>")
    path = str(tmp_path / "c")
    assert index_store.create(spark, path, t, recreate=False) and not index_store.create(spark, path, t.limit(1), recreate=False)
    assert index_store.read(spark, path).count() == 2
    info = index_store.collection_info(index_store.read(spark, path), "v").first()
    assert (info.points_count, info.vector_size, info.status) == (2, 2, "green")
    assert [r.id for r in index_store.by_ids(t, spark.createDataFrame([(2,), (7,), (2,)], "id long"), "id").collect()] == [2]
    failed = index_store.export_all(spark, {"c": path, "none": str(tmp_path / "none")}, str(tmp_path / "dump"))
    assert set(failed) == {"none"}
    to = index_store.import_collection(spark, str(tmp_path / "dump/c"), str(tmp_path / "in"), t.schema, name="other", recreate=True)
    index_store.import_collection(spark, str(tmp_path / "dump/c"), str(tmp_path / "in"), t.schema, name="other")
    assert to.endswith("/other") and index_store.read(spark, to).count() == 4
    index_store.import_collection(spark, str(tmp_path / "dump/c"), str(tmp_path / "in"), t.schema, name="other", recreate=True)
    assert index_store.read(spark, to).count() == 2
    snaps = index_store.snapshot_all(spark, {"c": path}, str(tmp_path / "snap"), 3)
    index_store.create(spark, path, t.limit(1))
    index_store.restore(spark, str(tmp_path / "snap/c"), 3, path)
    assert snaps["c"].endswith("version=3") and index_store.read(spark, path).count() == 2
    assert index_store.delete(spark, path) and not index_store.exists(spark, path)


def test_memory_extras(spark):
    m = spark.createDataFrame([(1, 0, "user", "a", 0), (1, 1, "assistant", "b", 90), (2, 0, "user", "c", 5)], "session_id long, seq long, role string, content string, s long").withColumn("at", F.timestamp_seconds("s"))
    assert {r.session_id: r.duration_seconds for r in memory.statistics(m).collect()} == {1: 90.0, 2: 0.0}
    assert {r.session_id for r in memory.without_session(m, spark.createDataFrame([(1,)], "session_id long")).collect()} == {2}
    asks = spark.createDataFrame([(1, 1, "and then?"), (2, 9, "alone")], "query_id long, session_id long, query string")
    got = {r.query_id: r["query"] for r in dialogue.condensed(m, asks, lambda context, query: F.concat(context, F.lit(" | "), query)).collect()}
    assert got == {1: "User: a\nAssistant: b | and then?", 2: "alone"}
    kinds = spark.createDataFrame([("chunk",), ("document",), (None,)], "k string").select(dialogue.alpha_by_type(F.col("k")).alias("a"))
    assert [r.a for r in kinds.collect()] == [0.65, 0.35, 0.5]


def test_optional_parts_may_be_missing(tmp_path):
    """The entry and its queries without the optional folder and the pipeline."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "lamella"), tmp_path / "lamella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lamella/llm").mkdir()  # a folder that is left over
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert 'chunk_retrieval' in q and set(o) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
