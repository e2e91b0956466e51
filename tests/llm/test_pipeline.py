import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import quality, simhash

SF = "/root/testdata/sf0.001"


def near_copies():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i in range(60):  # about 0.97, far above the threshold; and copies with most sentences replaced, far below
        t = list(base[i])
        t[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(t)))
        u = list(base[i])
        for k in rng.sample(range(400), 100):
            u[k] = rng.choice(words)
        rows.append((200 + i, " ".join(u)))
    return rows


def test_similar_links_near_copies_only(spark):
    rows = near_copies() + [(900, None), (901, ""), (902, "a b"), (902, "a b"), (903, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs).collect()}
    assert all(got[100 + i] == got[i] == i for i in range(60))
    assert all(got[200 + i] == 200 + i for i in range(60))
    assert (got[900], got[901], got[902], got[903]) == (900, 900, 902, 902)


def test_one_large_group(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    rows = []
    for i in range(500):
        t = list(base)
        t[rng.randrange(600)] = f"x{i}"
        rows.append((i, " ".join(t)))
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.component_id for r in got.collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small test tables")
def test_stages_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    good = docs.orderBy("doc_id").first()
    odd = [(10_001, None), (10_002, ""), (10_003, good.text), (10_004, good.text + " " + leak), (10_005, good.text[:200] + " me@mail.example.com " + good.text[200:]), (10_006, "long words " * 20_000)]
    more = spark.createDataFrame(odd, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    now = docs.unionByName(more)
    for name in ("length", "raw", "kept_id", "quality_score", "__quality", "text_in", "spans_in", "fp"):
        now = now.withColumn(name, F.lit("clash"))
    ids = {"input": {r.doc_id for r in now.select("doc_id").collect()}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == now.columns
            now = out.persist()
            ids[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert good.doc_id in ids["simhash_near_dedup"] and 10_003 not in ids["simhash_near_dedup"]
    assert 10_004 not in ids["benchmark_decontamination"]
    assert not now.where("text LIKE '%@mail.example.com%'").count()
    packed = out.groupBy("doc_id").agg(F.sum("length").alias("n")).count()
    assert packed == len(ids["pii"])
    kept = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").collect()
    assert sum(r.doc_id in ids["quality_classifier"] for r in kept) >= 0.97 * len(kept)
    empty = now.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()] == [0.5, 0.5]
