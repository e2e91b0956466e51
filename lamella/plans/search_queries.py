"""Registered queries over dictionaries, inverted files and incremental indexes, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import entities, segment
from ..functions.metadata import title
from ..functions.text import TOKEN_BREAK, clean_text
from ..operators import assembly, bm25, cells, chunking, dense, fields, fusion, memory, postings, tables
from . import chain, dialogue, engine, incremental, index
from .chunk_queries import _BELOW, _CHUNKS, _FUSED, _LETTERS, QUERIES, _index, _path
from .engine import Config
from .queries import _ASKED, _BM25, _DENSE, _RANKED, _messages, _query, _questions, _table, _vector_queries

__all__ = ["QUERIES"]

#: Letters of any script, for texts whose blanks were taken out.
_LETTER = r"[^\W\d_]"


@_query(r"""
    WITH t AS MATERIALIZED (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[ \t]+', '', 'g')) AS text, list_distinct(list_filter(string_split_regex(lower(text), '[^\pL\pM\pN]+'), lambda x: regexp_full_match(x, '\pL{1,24}'))) AS terms FROM documents),
    v AS MATERIALIZED (SELECT term FROM (SELECT unnest(terms) AS term FROM t) GROUP BY term ORDER BY count(*) DESC, term LIMIT 20000),
    parts AS MATERIALIZED (SELECT doc_id, part, k FROM (SELECT doc_id, regexp_extract_all(text, '\pL+|\pN+') AS ps FROM t), unnest(ps) WITH ORDINALITY AS u(part, k)),
    c AS MATERIALIZED (SELECT DISTINCT part FROM parts WHERE regexp_matches(part, '^\pL')),
    c2 AS MATERIALIZED (SELECT part, length(part) AS size, row_number() OVER () AS id FROM c),
    hit AS MATERIALIZED (SELECT id, i, list(n) AS ns FROM (SELECT id, i, n, substr(part, i, n) AS word FROM c2, unnest(range(1, size + 1)) AS a(i), unnest(range(1, least(24, size - i + 1) + 1)) AS b(n)) WHERE word IN (SELECT term FROM v) GROUP BY id, i),
    steps AS (SELECT id, list({'ns': coalesce(ns, []), 'cost': []::BIGINT[], 'pick': ''} ORDER BY i DESC) AS st FROM (SELECT id, i FROM c2, unnest(range(1, size + 1)) AS a(i)) LEFT JOIN hit USING (id, i) GROUP BY id),
    -- from each letter to the end: what is outside the dictionary and words, in one number, and the first piece's length as a letter (a: outside)
    way AS (SELECT id, list_reduce([{'ns': []::BIGINT[], 'cost': [0::BIGINT], 'pick': ''}] || st, lambda s, x: list_transform(
                [list_min(list_concat([{'c': s.cost[1] + 4294967296, 'n': 0::BIGINT}], list_transform(x.ns, lambda n: {'c': s.cost[n] + 1, 'n': -n})))],
                lambda best: {'ns': []::BIGINT[], 'cost': list_concat([best.c], s.cost[:24]), 'pick': chr((97 - best.n)::INT) || s.pick})[1]).pick AS pick FROM steps),
    toks AS MATERIALIZED (SELECT part, string_split(ltrim(list_reduce(list_concat([{'i': 1::BIGINT, 'n': 0, 'ch': '', 'o': false}], list_transform(range(1, size + 1), lambda i: {'i': i, 'n': ascii(pick[i]) - 97, 'ch': part[i], 'o': false})),
                lambda s, x: CASE WHEN s.i <> x.i THEN {'i': s.i, 'n': 0, 'ch': s.ch || x.ch, 'o': s.o} WHEN x.n = 0 THEN {'i': x.i + 1, 'n': 0, 'ch': s.ch || CASE WHEN s.o THEN '' ELSE ' ' END || x.ch, 'o': true}
                             ELSE {'i': x.i + x.n, 'n': 0, 'ch': s.ch || ' ' || x.ch, 'o': false} END).ch), ' ') AS ts FROM way JOIN c2 USING (id))
    SELECT t.doc_id, coalesce(sum(len(coalesce(ts, [part]))) FILTER (part IS NOT NULL), 0)::BIGINT AS n_tokens, md5(coalesce(string_agg(array_to_string(coalesce(ts, [part]), ' '), ' ' ORDER BY k), '')) AS tokens_md5
    FROM t LEFT JOIN parts USING (doc_id) LEFT JOIN toks USING (part) GROUP BY t.doc_id""")
def dictionary_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts without their blanks, segmented by a table of the commonest words."""
    docs = _table(spark, sf_dir, "documents")
    words = segment.collected(segment.word_table(bm25.tokenised(docs)), "word")
    cut = segment.segmenter(spark, words, _LETTER)
    toks = docs.select("doc_id", cut(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t]+", "")).alias("tokens"))
    return toks.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@_query(_ASKED + _RANKED.format(_BM25.format("weight"), "score > 0", 10))
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's rows, by blocks of postings at rest."""
    path = _path(spark, "postings")
    model = bm25.fit(bm25.tokenised(_table(spark, sf_dir, "documents")), f"{path}/model")
    return postings.write(model, path, segment_docs=256).search(_questions(spark, sf_dir))


@_query(_RANKED.format(_DENSE, "score IS NOT NULL", 10))
def cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of quantised vectors, which bounds make exact."""
    return cells.write(_table(spark, sf_dir, "embeddings"), _path(spark, "cells")).search(_vector_queries(spark, sf_dir), probes=None)


@_query()
def cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``probes, recall``: the share of the exact neighbours that a search of few cells finds."""
    vectors, asked = _table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir)
    held = cells.write(vectors, _path(spark, "cells"))
    exact = dense.search(vectors, asked).select("query_id", "doc_id")
    out = None
    for probes in (1, 4, 16):
        found = exact.join(held.search(asked, probes=probes).select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
        row = found.agg(F.lit(probes).alias("probes"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


@_query(_CHUNKS + _FUSED + " SELECT query_id, doc_id AS chunk_id, score, rerank_score, rank FROM best")
def chunk_retrieval_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval in one level with both legs by files."""
    built, asked = _index(spark, sf_dir)
    held = index.inverted(built, _path(spark, "files"), segment_docs=256)
    return index.retrieve(held, asked, level=1, config=Config(probes=None)).select("query_id", "chunk_id", "score", "rerank_score", "rank")


@_query(
    _CHUNKS.replace("FROM main.documents", "FROM main.documents WHERE doc_id % 11 <> 3")
    + " SELECT term, df, round(idf, 6) AS idf, any_value(n)::BIGINT AS doc_count, round(any_value(avgdl), 6) AS avg_doc_length FROM v, s GROUP BY term, df, idf"
)
def incremental_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of older texts, brought up to date by upserts and deletions; its statistics are those of a fresh build."""
    docs, path = _table(spark, sf_dir, "documents"), _path(spark, "incremental")
    older = docs.where("doc_id % 7 <> 1").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text")))
    incremental.upsert(older, path, embed=index.letters, levels=2)
    incremental.upsert(docs, path, docs.where("doc_id % 11 = 3").select("doc_id"), embed=index.letters, levels=2)
    model = incremental.opened(spark, path).model
    return model.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.lit(model.doc_count).cast("long").alias("doc_count"), F.lit(round(model.avg_doc_length, 6)).alias("avg_doc_length"))


_DOMAIN = "CASE WHEN item_id % 2 = 0 THEN 'ที่ดิน ' || text ELSE text END"


@_query(
    _CHUNKS.replace("text, list_filter(string_split_regex(lower(text), '[^\\pL\\pM\\pN]+'), lambda x: x <> '') AS toks FROM benchmark", f"text, list_filter(string_split_regex(lower(text), '[^\\pL\\pM\\pN]+'), lambda x: x <> '') AS toks FROM (SELECT item_id, {_DOMAIN} AS text FROM benchmark)")
    + _BELOW
    + f""", z_x AS (SELECT query_id, rank, 'source: ' || document_id || chr(10) || 'section: {assembly.NO_SECTION}' || chr(10) || 'level: 0' || chr(10) || text || chr(10) || array_to_string(list_transform(texts[:2], lambda c: left(c, 200) || '...'), chr(10)) AS t FROM h JOIN k USING (document_id) WHERE rank <= 3),
    z_told AS (SELECT query_id, left(string_agg(t, chr(10) || chr(10) ORDER BY rank), 500) AS answer FROM z_x GROUP BY query_id),
    z_r AS (SELECT item_id AS query_id, item_id % 7 AS session_id, {_DOMAIN} AS query FROM benchmark),
    z_routed AS (SELECT z_r.*, CASE WHEN regexp_matches(lower(query), 'hello|hi') THEN 'ABOUT_BOT' WHEN contains(query, 'ที่ดิน') THEN 'RAG' ELSE 'OUT_OF_SCOPE' END AS route FROM z_r),
    z_done AS (SELECT z_routed.*, CASE route WHEN 'ABOUT_BOT' THEN '{dialogue.ABOUT_ANSWER}' WHEN 'RAG' THEN coalesce(answer, '{dialogue.NO_CONTEXT_ANSWER.replace("'", "''")}') ELSE '{dialogue.OUT_OF_SCOPE_ANSWER.replace("'", "''")}' END AS answer FROM z_routed LEFT JOIN z_told USING (query_id)),
    z_m AS (SELECT conv_id AS session_id, max(turn) AS seq FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
    z_turns AS (SELECT z_done.*, coalesce(z_m.seq, -1) + 2 * row_number() OVER (PARTITION BY session_id ORDER BY query_id) AS last FROM z_done LEFT JOIN z_m USING (session_id))
    SELECT session_id, (last - 1)::BIGINT AS seq, 'user' AS role, query AS content FROM z_turns UNION ALL SELECT session_id, last::BIGINT, 'assistant', answer FROM z_turns"""
)
def dialogue_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of the benchmark's items as requests, half of them about the collection: search, expansion, prompt and answer in one call."""
    built, _ = _index(spark, sf_dir)
    query = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("ที่ดิน "), "text")).otherwise(F.col("text"))
    requests = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 7).alias("session_id"), query.alias("query"))
    messages = _messages(spark, sf_dir)
    told = chain.answered(built, requests, messages, index.letters, level=0, mode="sparse", rerank=False)
    return dialogue.appended(messages, requests, told)


_OWN = "SELECT query_id, doc_id, round(sum(qw.weight * w.weight), 6) AS score FROM qw JOIN w USING (term) JOIN documents d USING (doc_id) WHERE {} GROUP BY query_id, doc_id"


@_query(
    _ASKED
    + _RANKED.format(_OWN.format("CASE query_id % 3 WHEN 0 THEN lang = 'en' WHEN 1 THEN lang IN ('de', 'fr') AND source IN ('src1', 'src2', 'src3', 'src8') ELSE true END"), "score > 0", 10)
)
def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan for all questions, each with filters of its own."""
    docs, asked = _table(spark, sf_dir, "documents"), _questions(spark, sf_dir)
    model = bm25.fit(bm25.tokenised(docs, keep=["lang", "source"]), _path(spark, "bm25"))
    wanted = F.when(F.col("query_id") % 3 == 0, F.array(F.struct(F.lit("lang").alias("column"), F.lit("en").alias("value")))).when(
        F.col("query_id") % 3 == 1, F.array(*(F.struct(F.lit(c).alias("column"), F.lit(v).alias("value")) for c, v in [("lang", "de"), ("lang", "fr"), *(("source", f"src{i}") for i in (1, 2, 3, 8))]))
    )
    filters = asked.select("query_id", F.explode(wanted).alias("f")).select("query_id", "f.column", "f.value")
    return model.search(asked, filters=filters)


@_query(
    _ASKED
    + f", b AS ({_RANKED.format(_BM25.format('weight'), 'score > 0', 60)}), d AS ({_RANKED.format(_DENSE, 'score IS NOT NULL', 60)}), "
    + r"""f0 AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g')), '[^\pL\pM\pN]+'), lambda x: x <> '')) AS title, [lang, source] AS category FROM documents),
    fs AS (SELECT query_id, doc_id, round(sum(x), 6) AS score FROM (SELECT query_id, doc_id, 3.0 * len(list_intersect(list_distinct(toks), title)) + 2.0 * len(list_intersect(list_distinct(toks), category)) AS x FROM q, f0) GROUP BY query_id, doc_id),
    m AS ("""
    + _RANKED.format("SELECT * FROM fs", "score > 0", 60)
    + """),
    everyone AS (SELECT query_id, doc_id FROM b UNION SELECT query_id, doc_id FROM d UNION SELECT query_id, doc_id FROM m),
    joint AS (SELECT query_id, doc_id, b.rank AS br, d.rank AS dr, m.rank AS mr FROM everyone LEFT JOIN b USING (query_id, doc_id) LEFT JOIN d USING (query_id, doc_id) LEFT JOIN m USING (query_id, doc_id)),
    sized AS (SELECT *, count(br) OVER p AS nb, count(dr) OVER p AS nd, count(mr) OVER p AS nm, query_id IN (SELECT item_id FROM benchmark) AS known, CASE WHEN query_id % 2 = 0 THEN 0.35 ELSE 0.5 END::DOUBLE AS alpha FROM joint WINDOW p AS (PARTITION BY query_id)),
    fused AS (SELECT query_id, doc_id, round(CASE WHEN known THEN alpha ELSE 1 END / (coalesce(br, nb + 60) + 60) + CASE WHEN known THEN 1 - alpha ELSE 1 END / (coalesce(dr, nd + 60) + 60) + CASE WHEN known THEN 0.25 ELSE 1 END / (coalesce(mr, nm + 60) + 60), 9) AS score FROM sized)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 10"""
)
def three_leg_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, vectors and metadata fields as three rankings, weighted by the type of each question."""
    docs = _table(spark, sf_dir, "documents")
    asked = _questions(spark, sf_dir)
    typed = _table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("ขั้นตอน "), "text")).otherwise(F.col("text")).alias("query"))
    weights = engine.leg_weights(engine.analysed(typed, "item_id"), fields=0.25)
    named = {"title": title(F.col("text")), "category": F.concat_ws(" ", "lang", "source")}
    legs = {
        "bm25": bm25.fit(bm25.tokenised(docs), _path(spark, "bm25")).search(asked, 60),
        "dense": dense.search(_table(spark, sf_dir, "embeddings"), _vector_queries(spark, sf_dir), 60),
        "fields": fields.search(fields.field_terms(docs, named, fields.WEIGHTS), asked, 60),
    }
    return fusion.fused(legs, 10, weights).select("query_id", "doc_id", "score", "rank")


@_query(
    _CHUNKS
    + """, held AS (SELECT doc_id, line, bool_or(pos < sp + 20) AS held FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, section_id) AS sp FROM n) WHERE line <> '' GROUP BY doc_id, line)
    SELECT d.doc_id, count(line) AS n_lines, count(line) FILTER (NOT held) AS lost_lines, coalesce(sum(length(line)) FILTER (NOT held), 0)::BIGINT AS lost_chars, 0::BIGINT AS repeated_lines, 0::BIGINT AS n_orphans
    FROM main.documents d LEFT JOIN held USING (doc_id) GROUP BY d.doc_id"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that summaries and section heads leave out, of whole documents."""
    clean = _table(spark, sf_dir, "documents").select("doc_id", clean_text(F.coalesce("text", F.lit(""))).alias("text"))
    return chunking.coverage(clean, chunking.chunk_tree(clean, levels=2))


@_query(f"""
    WITH m AS (SELECT conv_id AS session_id, turn AS seq, {_LETTERS.format("text")} AS e FROM conversations WHERE role IN ('user', 'assistant')),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM m),
    p AS (SELECT a.session_id, a.seq, b.seq AS earlier_seq, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM o a JOIN o b ON a.session_id = b.session_id AND b.k < a.k AND b.k >= a.k - 5 WHERE list_sum(a.e) > 0 AND list_sum(b.e) > 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, seq ORDER BY score DESC, earlier_seq) AS rank FROM p) WHERE rank <= 2""")
def similar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session of five remembered messages has nearest to each message."""
    return memory.similar_turns(_messages(spark, sf_dir), index.letters(F.col("content")), k=2, window=5)


@_query(r"""
    WITH needles AS (SELECT DISTINCT term FROM (SELECT unnest(string_split_regex(lower(text), '[^\pL\pM\pN]+')) AS term FROM benchmark) WHERE length(term) >= 5),
    hits AS (SELECT doc_id, term, instr(lower(text), term) - 1 AS first FROM documents, needles WHERE contains(lower(text), term))
    SELECT d.doc_id, count(term) AS n_needles, count(DISTINCT length(term) % 2) AS n_types, coalesce(min(first), -1)::BIGINT AS first, md5(coalesce(string_agg(term, ' ' ORDER BY term), '')) AS needles_md5 FROM documents d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id""")
def entity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's longer words in whole documents, all at once."""
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), TOKEN_BREAK)).alias("needle")).where(F.length("needle") >= 5)
    find = entities.finder(spark, entities.collected(words.withColumn("type", (F.length("needle") % 2).cast("string"))))
    found = _table(spark, sf_dir, "documents").select("doc_id", find(F.lower("text")).alias("f"))
    needles = F.array_sort(F.transform("f", lambda x: x["needle"]))
    return found.select(
        "doc_id", F.size("f").cast("long").alias("n_needles"), F.size(F.array_distinct(F.transform("f", lambda x: x["type"]))).cast("long").alias("n_types"),
        F.coalesce(F.array_min(F.transform("f", lambda x: x["first"])), F.lit(-1)).cast("long").alias("first"), F.md5(F.array_join(needles, " ")).alias("needles_md5"),
    )


@_query(r"""
    WITH l AS (SELECT doc_id, k, line FROM (SELECT doc_id, string_split(replace(text, chr(1), ''), chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS u(line, k)),
    g AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM l WHERE contains(line, '|')),
    t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS table_no, row_number() OVER (PARTITION BY doc_id, g ORDER BY k) AS n, regexp_matches(line, '^[\s|:]*-[\s|:-]*$') AS rule,
             list_transform(string_split(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^\||\|$', '', 'g'), '|'), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g')) AS cs FROM g),
    h AS (SELECT a.doc_id, a.table_no, a.cs AS headers FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.table_no = b.table_no AND a.n = 1 AND b.n = 2 AND b.rule),
    r AS (SELECT doc_id, table_no, n, cs, headers, row_number() OVER (PARTITION BY doc_id, table_no ORDER BY n) - 1 AS row_no FROM t LEFT JOIN h USING (doc_id, table_no) WHERE NOT rule AND (headers IS NULL OR n > 2)),
    f AS (SELECT *, last_value(nullif(cs[1], '') IGNORE NULLS) OVER (PARTITION BY doc_id, table_no ORDER BY row_no) AS first FROM r),
    c AS (SELECT doc_id, table_no, row_no, j - 1 AS column_no, headers[j] AS header, CASE WHEN j = 1 THEN first ELSE nullif(cs[j], '') END AS value FROM f, unnest(range(1, len(cs) + 1)) AS u(j))
    SELECT doc_id, table_no, row_no, column_no, header, value, TRY_CAST(replace(nullif(regexp_extract(value, '([0-9][0-9,]*(?:\.[0-9]+)?)', 1), ''), ',', '') AS DOUBLE) AS number, CASE WHEN contains(value, 'บาท') THEN 'บาท' WHEN contains(value, '%') THEN '%' END AS unit FROM c""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all pipe tables of whole documents."""
    return tables.rows(_table(spark, sf_dir, "documents")).withColumns({c: F.col(c).cast("long") for c in ("table_no", "row_no", "column_no")})
