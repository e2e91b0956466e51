import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import bm25, cells, dense, postings


def words(rng, n):
    return ["w%d" % min(int(rng.paretovariate(0.6)), 3000) for _ in range(n)]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = [(i, i % 3, words(rng, rng.randrange(0, 60))) for i in range(3000)]
    rows += [(5000 + i, 0, rows[7][2]) for i in range(40)]  # ties
    toks = spark.createDataFrame([*rows, (9000, 1, None), (9001, 1, [])], "doc_id long, level int, tokens array<string>").repartition(4)
    path = str(tmp_path_factory.mktemp("files"))
    model = bm25.fit(toks, f"{path}/model")
    asked = [(q, words(rng, rng.randrange(1, 9))) for q in range(30)] + [(100, []), (101, None), (102, ["nowhere"]), (103, ["w1", "w1", "nowhere"]), (104, rows[7][2])]
    return model, postings.write(model, f"{path}/postings", by="level", segment_docs=16, buckets=8), spark.createDataFrame(asked, "query_id long, tokens array<string>")


def pairs(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize(("classic", "value", "k"), [(False, None, 10), (True, None, 3), (False, 1, 5)])
def test_same_rows_as_a_scan(kept, classic, value, k):
    model, files, asked = kept
    want = model.search(asked, k, classic, where=None if value is None else F.col("level") == value)
    assert pairs(files.search(asked, k, classic, value, block=9)) == pairs(want)


def test_a_question_reads_its_blocks_only(spark, kept):
    model, files, _ = kept
    asked, buckets, terms = files.asked([(0, ["w2900", "w17"])], "bigint")
    plan = files.bounds(asked, buckets, terms, 2)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "level" in line)
    assert "PartitionFilters: [isnotnull(level" in scan and "bucket" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "In(term" in scan.split("PushedFilters")[1] and "postings" not in scan.split("ReadSchema")[1]
    assert len(buckets) <= 2 < 8
    whole = files.bounds(asked, buckets, terms)
    best = {r.doc_id: r.score for r in files.search(spark.createDataFrame([(0, ["w2900", "w17"])], "query_id long, tokens array<string>")).collect()}
    top = {(r.level, r.segment): r.bound for r in whole.collect()}
    scored = files.scored(asked, whole.select("query_id", "level", "segment"), buckets, terms).collect()
    assert len(scored) >= len(best)
    assert max(r.score for r in scored) == max(best.values()) <= max(top.values()) + 1e-6


def test_a_posting_is_dealt_once(kept):
    """However many questions have its term, and a task hands on k rows of a question."""
    _, files, asked = kept
    part = [(r.query_id, ["w1", "w2", "w3"]) for r in asked.collect()]
    own, buckets, terms = files.asked(part, "bigint")
    everywhere = files.bounds(own, buckets, terms).select("query_id", "level", "segment")
    found = files.best(own, everywhere, 3, buckets, terms)
    assert "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() <= 3 * len(part) * found.rdd.getNumPartitions() < files.scored(own, everywhere, buckets, terms).count()
    assert pairs(bm25.ranked(found, 3)) == pairs(bm25.ranked(files.scored(own, everywhere, buckets, terms).where("score > 0"), 3))


def test_other_ids_and_no_documents(spark, tmp_path):
    toks = spark.createDataFrame([("x", ["a", "b"]), ("y", ["b"])], "doc_id string, tokens array<string>")
    files = postings.write(bm25.fit(toks, str(tmp_path / "m")), str(tmp_path / "p"))
    asked = spark.createDataFrame([("q", ["b", "a"])], "query_id string, tokens array<string>")
    assert [(r.query_id, r.doc_id) for r in files.search(asked).orderBy("rank").collect()] == [("q", "x"), ("q", "y")]
    with pytest.raises(ValueError, match="by a column"):
        files.search(asked, value=1)
    assert files.search(asked.where("false")).count() == 0
    none = postings.write(bm25.fit(toks.where("false"), str(tmp_path / "m0")), str(tmp_path / "p0"))
    assert none.search(asked).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    v = centres[rng.integers(0, 40, 4000)] + 0.5 * rng.normal(size=(4000, 24))
    v[:1300] = centres[0] + 0.3 * rng.normal(size=(1300, 24))  # a third in one place
    v[50:70] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [0.0] * 24), (9002, [1.0] * 5), (9003, [None] + [1.0] * 23)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def test_all_cells_are_exact_and_few_are_near(spark, vectors, tmp_path):
    files = cells.write(vectors, str(tmp_path), cells=32, parts=6, sample=2000)
    assert files.vectors.count() == 4000
    asked = vectors.where("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 24), (-3, [1.0])], asked.schema))
    exact = dense.search(vectors, asked)
    assert pairs(files.search(asked, probes=None, block=30)) == pairs(exact)
    want = {(r.query_id, r.doc_id) for r in exact.collect()}
    recall = {p: len(want & {(r.query_id, r.doc_id) for r in files.search(asked, probes=p).collect()}) / len(want) for p in (1, 6)}
    assert recall[1] < recall[6]
    assert recall[6] >= 0.9
    part = [(r.query_id, r.vector) for r in asked.where("query_id = 40").collect()]
    found = files.candidates(asked, part, 10, 2)
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [cell" in scan and "v:array" not in scan
    assert 10 <= found.count() < 1300
    again = cells.opened(spark, str(tmp_path))
    assert pairs(again.search(asked, k=3, probes=6)) == pairs(files.search(asked, k=3, probes=6))


def test_small_tables(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, vector array<float>")
    files = cells.write(few, str(tmp_path / "few"))
    assert [(r.doc_id, r.score) for r in files.search(asked).orderBy("rank").collect()] == [(2, 1.0), (2, 1.0), (1, 0.0)]
    none = cells.write(few.where("false"), str(tmp_path / "none"))
    assert none.search(asked).count() == 0


def test_loose_bounds_keep_no_pairs(spark, tmp_path):
    """Vectors without structure, whose bounds tell nothing: results are those of a scan, and a task hands on k rows of a question."""
    rng = np.random.default_rng(11)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3000, 48)))], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    files = cells.write(vectors, str(tmp_path), cells=8, parts=2)
    part = [(r.query_id, r.vector) for r in asked.collect()]
    found = files.nearest(asked, part, 5, None)
    assert found.count() <= 5 * len(part) * found.rdd.getNumPartitions()
    assert pairs(files.search(asked, k=5, probes=None)) == pairs(dense.search(vectors, asked, k=5))


def test_an_id_lies_once_in_the_files(spark, tmp_path):
    """Not with each of its document's terms; repeated ids stay documents of their own, as in a scan."""
    rng = random.Random(3)
    rows = [(f"{i:064d}", words(rng, 120)) for i in range(400)]
    toks = spark.createDataFrame([*rows, (rows[5][0], rows[5][1]), (rows[6][0], ["w1"])], "doc_id string, tokens array<string>").repartition(3)
    model = bm25.fit(toks, str(tmp_path / "m"))
    files = postings.write(model, str(tmp_path / "p"), segment_docs=32, buckets=4)
    size = lambda path: sum(f.stat().st_size for f in path.rglob("*.parquet"))
    assert size(tmp_path / "p" / "blocks") < 2 * size(tmp_path / "m" / "documents")
    told = files.blocks.where("ids IS NOT NULL").selectExpr("explode(ids) AS doc_id")
    assert told.count() == 402
    asked = spark.createDataFrame([(q, words(rng, 5)) for q in range(20)], "query_id long, tokens array<string>")
    assert pairs(files.search(asked)) == pairs(model.search(asked))
    assert pairs(postings.opened(spark, str(tmp_path / "p")).search(asked, 3)) == pairs(model.search(asked, 3))
