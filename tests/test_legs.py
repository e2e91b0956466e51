import random

import pytest
from pyspark.sql import functions as F

from lamella.functions import query
from lamella.operators import bm25, chunking, dense, fields, fusion, memory, tables
from lamella.plans import engine


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_filters_are_those_of_each_question_alone(spark, tmp_path):
    rng = random.Random(1)
    docs = [(i, rng.choice(["x", "y", None]), i % 3 == 0, [f"w{rng.randrange(20)}" for _ in range(12)], [rng.random() for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, kind string, flag boolean, tokens array<string>, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(q, [f"w{q}", "w3"], [1.0, q / 10, 0.0, 0.2]) for q in range(12)], "query_id long, tokens array<string>, vector array<double>")
    wanted = [(1, "kind", "x"), (2, "flag", "true"), (3, "kind", "x"), (3, "kind", "y"), (4, "kind", "y"), (4, "flag", "false"), (5, "kind", "nowhere"), (77, "kind", "x")]
    filters = spark.createDataFrame(wanted, "query_id long, column string, value string")
    model = bm25.fit(df.select("doc_id", "tokens", "kind", "flag"), str(tmp_path))
    got = [rows_of(model.search(asked, 7, filters=filters, block=5)), rows_of(dense.search(df, asked, 7, "doc_id", block=5, filters=filters))]
    alone = [[], []]
    for q in range(12):
        conditions = [F.col("kind").isin(*vs) if c == "kind" else F.col("flag") == (vs[0] == "true") for c in ("kind", "flag") if (vs := [v for i, k, v in wanted if (i, k) == (q, c)])]
        where = conditions[0] if conditions else F.lit(True)
        for c in conditions[1:]:
            where = where & c
        mine = asked.where(F.col("query_id") == q)
        alone[0] += rows_of(model.search(mine, 7, where=where))
        alone[1] += rows_of(dense.search(df.where(where), mine, 7, "doc_id"))
    assert got == alone
    with pytest.raises(ValueError, match="no column other"):
        model.search(asked, filters=spark.createDataFrame([(1, "other", "x")], filters.schema))


def test_filters_of_questions(spark):
    asked = spark.createDataFrame([(0, "คู่มือการโอนของคนต่างด้าว"), (1, "ระเบียบการจำนอง จองคิว ด่วน"), (2, "weather"), (3, None)], "query_id long, query string")
    got = sorted(tuple(r) for r in query.filter_rows(asked).collect())
    assert got == [(0, "category_level1", "การโอน"), (0, "document_type", "คู่มือปชช"), (0, "special_cases", "คนต่างด้าว"), (1, "category_level1", "ภาระผูกพัน"), (1, "document_type", "ระเบียบกรม"), (1, "has_e_qlands", "true")]
    assert [r[0] for r in asked.orderBy("query_id").select(query.sort_by(F.col("query"))).collect()] == [None, "processing_time_asc", None, None]


def test_field_matches(spark):
    docs = spark.createDataFrame([(0, "Fee table", "fees land", None), (1, "land land", None, "fee"), (2, None, None, None)], "doc_id long, title string, tags string, keywords string")
    rows = fields.field_terms(docs, {c: F.col(c) for c in ("title", "tags", "keywords")}, fields.WEIGHTS)
    asked = spark.createDataFrame([("a", ["land", "fee", "fee"]), ("b", ["nothing"]), ("c", [])], "query_id string, tokens array<string>")
    assert rows_of(fields.search(rows, asked)) == [("a", 1, 0, 5.0), ("a", 2, 1, 4.0)]


def test_fusion_of_any_number_of_rankings(spark):
    rng = random.Random(4)
    legs = {}
    for name in ("one", "two", "three"):
        got = [(q, d, 1.0 / (i + 1), i + 1) for q in range(5) for i, d in enumerate(rng.sample(range(20), rng.randrange(0, 9)))]
        legs[name] = spark.createDataFrame(got, "query_id long, doc_id long, score double, rank int")
    two = {n: legs[n] for n in ("one", "two")}
    want = [(r.query_id, r["rank"], r.doc_id, r.score) for r in fusion.rrf(legs["one"], legs["two"], 10, 0.7).collect()]
    assert rows_of(fusion.fused(two, 10, {"one": 0.7, "two": 0.3})) == sorted(want)
    weights = {0: (1.0, 2.0, 0.5), 1: (0.0, 0.0, 1.0), 3: (None, 1.0, 1.0)}
    table = spark.createDataFrame([(q, *w) for q, w in weights.items()], "query_id long, one double, two double, three double")
    got = {(r.query_id, r.doc_id): (r.score, r.two_score) for r in fusion.fused(legs, 100, table).collect()}
    held = {n: {(r.query_id, r.doc_id): (r["rank"], r.score) for r in df.collect()} for n, df in legs.items()}
    for q, d in {k for ranks in held.values() for k in ranks}:
        total = 0
        for name, w in zip(legs, weights.get(q, (1, 1, 1)), strict=True):
            size = sum(k[0] == q for k in held[name])
            total += (1 if w is None else w) / (held[name].get((q, d), (size + 60,))[0] + 60)
        assert got.pop((q, d)) == (round(total, 9), held["two"].get((q, d), (0, None))[1])
    assert not got


def test_weights_by_type_of_question(spark):
    asked = engine.analysed(spark.createDataFrame([(0, "ค่าธรรมเนียม"), (1, "ขั้นตอน"), (2, "plain"), (3, "เท่าไหร่")], "query_id long, query string"))
    assert {r.query_id: (r.bm25, round(r.dense, 2), r.fields) for r in engine.leg_weights(asked).collect()} == {0: (0.5, 0.5, 0.25), 1: (0.35, 0.65, 0.25), 2: (0.5, 0.5, 0.25), 3: (0.65, 0.35, 0.25)}


def test_coverage_of_chunks(spark):
    long = "\n".join(f"line {i}" for i in range(30))
    listed = "preamble that no rule takes\nขั้นตอน\nstray words\n" + "\n".join(f"{i}. step {i}" for i in range(1, 9))
    docs = spark.createDataFrame([(0, long), (1, listed), (2, None), (3, "gone")], "doc_id long, text string")
    two = chunking.chunk_tree(docs.where("doc_id <> 3"), levels=2)
    got = {r.doc_id: tuple(r)[1:] for r in chunking.coverage(docs, two).collect()}
    assert got[0] == (30, 10, sum(len(f"line {i}") for i in range(20, 30)), 0, 0)
    assert got[1][:2] == (11, 0) and got[2] == (0, 0, 0, 0, 0) and got[3] == (1, 1, 4, 0, 0)
    three = chunking.chunk_tree(docs)
    got = {r.doc_id: tuple(r)[1:] for r in chunking.coverage(docs, three.where("hierarchy_level <> 1")).collect()}
    # without sections: lists repeat steps between their parts and drop the words before the first; passages have lost their parents
    assert got[1][1] >= 2 and got[1][3] >= 1 and got[1][4] == three.where("doc_id = 1 AND hierarchy_level = 2").count()


def test_nearest_earlier_turns(spark):
    rng = random.Random(2)
    rows = [(s, i, "user", [rng.choice([0.0, 1.0]) for _ in range(3)]) for s in ("a", "b") for i in range(40)] + [("c", 0, "user", [1.0, 0.0, 0.0]), ("a", 99, "user", None)]
    df = spark.createDataFrame(rows, "session_id string, seq long, role string, v array<double>").repartition(4)
    got = sorted((r.session_id, r.seq, r["rank"], r.earlier_seq, r.score) for r in memory.similar_turns(df, F.col("v"), 2, 6).collect())
    want = []
    for s in ("a", "b"):
        mine = [(i, v) for t, i, _, v in rows if t == s]
        for place, (i, v) in enumerate(mine):
            if not v or not any(v):
                continue
            near = [(-round(sum(x * y for x, y in zip(v, u, strict=True)) / (sum(x * x for x in v) * sum(x * x for x in u)) ** 0.5, 6), j) for j, u in mine[max(place - 6, 0) : place] if u and any(u)]
            want += [(s, i, n + 1, j, abs(x)) for n, (x, j) in enumerate(sorted(near)[:2])]
    assert [(*r[:4], abs(r[4])) for r in got] == want


def test_cells_of_tables(spark):
    text = "fees\n| item | baht |\n|---|:--|\n| deed | ๑,๒๐๐.๕ บาท |\n| | 2 % | more |\n\nsteps\na | b\n\x01c|\nend |"
    got = [tuple(r)[1:] for r in tables.rows(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")).orderBy("table_no", "row_no", "column_no").collect()]
    assert got == [
        (0, 0, 0, "item", "deed", None, None), (0, 0, 1, "baht", "๑,๒๐๐.๕ บาท", 1200.5, "บาท"),
        (0, 1, 0, "item", "deed", None, None), (0, 1, 1, "baht", "2 %", 2.0, "%"), (0, 1, 2, None, "more", None, None),
        (1, 0, 0, None, "a", None, None), (1, 0, 1, None, "b", None, None), (1, 1, 0, None, "c", None, None), (1, 2, 0, None, "end", None, None),
    ]
    many = "\n".join(f"x | {i}" for i in range(20_000))
    assert tables.rows(spark.createDataFrame([(1, many)], "doc_id long, text string")).where("column_no = 1").agg(F.sum("number")).first()[0] == sum(range(20_000))
