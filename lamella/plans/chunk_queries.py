"""Registered queries over chunks, kept models and derived documents, and the SQL each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.metadata import metadata
from ..operators import assembly, bm25, chunking, fusion
from ..sources.work import settled, work_dir
from . import index
from .queries import _ASKED, _BM25, _RANKED, _SECTIONS, QUERIES, _query, _questions, _table

__all__ = ["QUERIES"]

_THAI = "๐๑๒๓๔๕๖๗๘๙"


def _path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_query(_ASKED + _RANKED.format(_BM25.format("weight"), "score > 0", 10))
def bm25_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted, kept, opened again, searched."""
    path = _path(spark, "bm25")
    bm25.fit(bm25.tokenised(_table(spark, sf_dir, "documents")), path)
    return bm25.load(spark, path).search(_questions(spark, sf_dir))


_CLEANED = r"""
    WITH RECURSIVE documents AS MATERIALIZED (
        SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(replace(replace(replace(replace(coalesce(text, ''), chr(65533), ''), chr(0), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)), '^\s+|\s+$', '', 'g') AS text
        FROM main.documents),"""
_CHUNKS = (
    _CLEANED
    + _SECTIONS.split("WITH", 1)[1]
    + r""",
    sec AS (SELECT doc_id, section_id, array_to_string(list(line ORDER BY pos) FILTER (pos < sp + 20), chr(10)) AS text FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, section_id) AS sp FROM n) GROUP BY doc_id, section_id),
    summ AS (SELECT doc_id, array_to_string(list(line ORDER BY pos), chr(10)) AS text FROM (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n) WHERE before <= 500 GROUP BY doc_id),
    chunks AS MATERIALIZED (
        SELECT doc_id AS document_id, 1 AS level, section_id::BIGINT AS section_id, sha256(concat_ws('/', doc_id, 1, section_id, 0)) AS doc_id, text FROM sec
        UNION ALL SELECT doc_id, 0, -1, sha256(concat_ws('/', doc_id, 0, 0, 0)), text FROM summ),
    t AS MATERIALIZED (SELECT doc_id, level, list_filter(string_split_regex(lower(text), '[^\pL\pM\pN]+'), lambda x: x <> '') AS toks FROM chunks),
    s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
    tf AS MATERIALIZED (SELECT doc_id, level, len, term, count(*) AS tf FROM (SELECT doc_id, level, len(toks) AS len, unnest(toks) AS term FROM t) GROUP BY ALL),
    v AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf, s GROUP BY term),
    w AS (SELECT doc_id, level, tf.term, tf, idf, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) AS weight FROM tf JOIN v USING (term), s),
    q AS (SELECT item_id AS query_id, text, list_filter(string_split_regex(lower(text), '[^\pL\pM\pN]+'), lambda x: x <> '') AS toks FROM benchmark),
    qf AS (SELECT query_id, len, term, count(*) AS tf FROM (SELECT query_id, len(toks) AS len, unnest(toks) AS term FROM q) GROUP BY ALL),
    qw AS (SELECT query_id, qf.term, qf.tf, idf * qf.tf * 2.5 / (qf.tf + 1.5 * (0.25 + 0.75 * qf.len / avgdl)) AS weight FROM qf JOIN v USING (term), s)"""
)
_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower({0})) - length(replace(lower({0}), c, '')))::DOUBLE)"
_SPARSE = "SELECT query_id, doc_id, round(sum(qw.weight * w.weight), 6) AS score FROM qw JOIN w USING (term) WHERE level = {} GROUP BY query_id, doc_id"
_CLOSE = f"SELECT a.query_id, c.doc_id, round(list_cosine_similarity(a.e, c.e), 6) AS score FROM (SELECT query_id, {_LETTERS.format('text')} AS e FROM q) a, (SELECT doc_id, level, {_LETTERS.format('text')} AS e FROM chunks) c WHERE level = {{}} AND list_sum(c.e) > 0 AND list_sum(a.e) > 0"
_FUSED = f""",
    b AS ({_RANKED.format(_SPARSE.format(1), 'score > 0', 60)}), d AS ({_RANKED.format(_CLOSE.format(1), 'score IS NOT NULL', 60)}),
    joint AS (SELECT query_id, doc_id, b.rank AS br, d.rank AS dr FROM b FULL JOIN d USING (query_id, doc_id)),
    sized AS (SELECT *, count(br) OVER p AS nb, count(dr) OVER p AS nd FROM joint WINDOW p AS (PARTITION BY query_id)),
    fused AS (SELECT query_id, doc_id, round(0.5 / (coalesce(br, nb + 60) + 60) + 0.5 / (coalesce(dr, nd + 60) + 60), 9) AS score FROM sized),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 30),
    re AS (SELECT top.query_id, top.doc_id, top.score, round(len(list_intersect(list_distinct(q.toks), list_distinct(t.toks))) / nullif(len(list_distinct(q.toks)), 0), 6) AS rerank_score FROM top JOIN t USING (doc_id) JOIN q USING (query_id)),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, doc_id) AS rank FROM re) WHERE rank <= 10)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[index.Index, DataFrame]:
    """An index of summaries and sections, built, kept and opened; and the benchmark's items as questions."""
    path = _path(spark, "index")
    built = index.build(_table(spark, sf_dir, "documents"), path, embed=index.letters, levels=2)
    asked = index.questions(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), index.letters)
    return built, asked


@_query(_CHUNKS + _FUSED + " SELECT query_id, doc_id AS chunk_id, score, rerank_score, rank FROM best")
def chunk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, asked = _index(spark, sf_dir)
    return index.retrieve(built, asked, level=1).select("query_id", "chunk_id", "score", "rerank_score", "rank")


@_query(_CHUNKS + ", d AS (" + _RANKED.format(_CLOSE.format(1), "score IS NOT NULL", 10) + ") SELECT query_id, doc_id AS chunk_id, score, rank FROM d")
def dense_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense leg alone."""
    built, asked = _index(spark, sf_dir)
    return index.retrieve(built, asked, level=1, mode="dense", rerank=False).select("query_id", "chunk_id", "score", "rank")


_BELOW = ", b AS (" + _RANKED.format(_SPARSE.format(0), "score > 0", 10) + "), k AS (SELECT document_id, count(*) AS num_children, list(text ORDER BY section_id) AS texts FROM chunks WHERE level = 1 GROUP BY document_id), h AS (SELECT b.*, c.document_id, c.text FROM b JOIN chunks c USING (doc_id))"


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, asked = _index(spark, sf_dir)
    return index.expanded(built, index.retrieve(built, asked, level=0, mode="sparse", rerank=False))


@_query(_CHUNKS + _BELOW + " SELECT query_id, doc_id AS chunk_id, rank, NULL::VARCHAR AS parent_text, num_children, md5(array_to_string(texts, chr(10))) AS children_md5 FROM h JOIN k USING (document_id)")
def expanded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with their sections as children."""
    return _summaries(spark, sf_dir).select("query_id", "chunk_id", "rank", "parent_text", F.size("children_texts").cast("long").alias("num_children"), F.md5(F.array_join("children_texts", "\n")).alias("children_md5"))


@_query(
    _CHUNKS
    + _FUSED
    + ", f AS (SELECT best.*, c.document_id FROM best JOIN chunks c USING (doc_id)) SELECT f.query_id, f.doc_id AS chunk_id, f.rank, md5(p.text) AS parent_md5 FROM f JOIN chunks p ON p.document_id = f.document_id AND p.level = 0"
)
def parent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections with their document's summary as parent."""
    built, asked = _index(spark, sf_dir)
    return index.expanded(built, index.retrieve(built, asked, level=1)).select("query_id", "chunk_id", "rank", F.md5("parent_text").alias("parent_md5"))


@_query(
    _CHUNKS
    + _BELOW
    + f" SELECT query_id, rank, document_id::VARCHAR AS source, '{assembly.NO_SECTION}' AS section, score, left(text, 500) AS text, list_transform(texts, lambda x: left(x, 200)) AS children_texts, false AS has_parent, num_children FROM h JOIN k USING (document_id) WHERE rank <= 3"
)
def production_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = assembly.production_citations(_summaries(spark, sf_dir), "document_id")
    return cited.select("query_id", "rank", "source", "section", "score", "text", "children_texts", "has_parent", F.col("num_children").cast("long").alias("num_children"))


@_query(
    _CHUNKS
    + _BELOW
    + f""", x AS (SELECT query_id, rank, 'source: ' || document_id || chr(10) || 'section: {assembly.NO_SECTION}' || chr(10) || 'level: 0' || chr(10) || text || chr(10) || array_to_string(list_transform(texts[:2], lambda c: left(c, 200) || '...'), chr(10)) AS t FROM h JOIN k USING (document_id) WHERE rank <= 3)
    SELECT query_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY rank)) AS prompt_md5 FROM x GROUP BY query_id"""
)
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.prompts(_summaries(spark, sf_dir)).select("query_id", F.md5("prompt").alias("prompt_md5"))


@_query(_CHUNKS + _FUSED + " SELECT query_id, count(*) AS num_chunks, max(coalesce(rerank_score, score)) AS top_score FROM best GROUP BY query_id")
def query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, asked = _index(spark, sf_dir)
    return index.query_summary(index.retrieve(built, asked, level=1))


@_query(_CHUNKS + " SELECT count(*) AS total_chunks, count(*) FILTER (level = 0) AS total_documents, count(*) FILTER (level = 1) AS level1_chunks, round(count(*) / count(*) FILTER (level = 0), 6) AS avg_chunks FROM chunks")
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, _ = _index(spark, sf_dir)
    return chunking.statistics(built.chunks).select("total_chunks", "total_documents", "level1_chunks", F.round("avg_chunks", 6).alias("avg_chunks"))


# Documents with every kind of section, made of the words of a document: its n-th items are its first words.
_N = "(3 + doc_id % 20)"
_WORD = "regexp_replace(coalesce(string_split(text, ' ')[i], ''), '[^A-Za-z]', '', 'g')"


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n, kind, text``: a regulation with steps, fees, required documents, a special case and Thai-numbered articles."""
    docs = _table(spark, sf_dir, "documents")
    n = (3 + F.col("doc_id") % 20).cast("int")
    thai = lambda i: F.translate(i, "0123456789", _THAI)

    def first_words(split: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.regexp_replace(F.coalesce(F.get(split, i - 1), F.lit("")), "[^A-Za-z]", ""))

    def text(words: Column) -> Column:
        each = lambda fn: F.array_join(F.transform(words, lambda w, i: fn((i + 1).cast("string"), w)), "\n")
        parts = [
            F.lit("intro\nขั้นตอน"), each(lambda i, w: F.concat(i, F.lit(". "), w)), F.lit("ค่าธรรมเนียม\na | b\n--- | ---"), each(lambda i, w: F.concat(w, F.lit(" | "), i)),
            F.lit("รายการเอกสาร"), each(lambda i, w: F.concat(i, F.lit(") "), w)), F.lit("*** กรณี x\nonce\nหมวด ๑"), each(lambda i, w: F.concat(F.lit("ข้อ "), thai(i), F.lit(" "), w)),
        ]
        return F.concat_ws("\n", *parts)

    # a text is split once, not for each item
    words = chunking.once(F.split(F.coalesce("text", F.lit("")), " "), first_words)
    return docs.select("doc_id", n.alias("n"), F.lit(fv.REGULATION_TYPE).alias("kind"), chunking.once(words, text).alias("text"))


_ITEMS = f"""
    WITH w AS (SELECT doc_id, {_N} AS n, i, {_WORD} AS w FROM documents, unnest(range(1, {_N} + 1)) AS r(i)),
    d AS (SELECT doc_id, any_value(n) AS n, list(i || '. ' || w ORDER BY i) AS steps, list(w || ' | ' || i ORDER BY i) AS fees, list(i || ') ' || w ORDER BY i) AS needed,
                 list('ข้อ ' || translate(i::VARCHAR, '0123456789', '{_THAI}') || ' ' || w ORDER BY i) AS articles FROM w GROUP BY doc_id),
    c AS (
        SELECT doc_id, n, 1 AS section_id, 0 AS ordinal, 'steps_list' AS chunk_type, 0.85 AS importance_score, 'ขั้นตอน' || chr(10) || array_to_string(steps, chr(10)) AS text FROM d WHERE n <= 5
        UNION ALL SELECT doc_id, n, 1, g // 4, 'steps_list_part', 0.80, array_to_string(steps[g + 1 : g + 6], chr(10) || chr(10)) FROM d, unnest(range(0, n, 4)) AS r(g) WHERE n > 5
        UNION ALL SELECT doc_id, n, 2, 0, 'fees_table', 0.9, 'a | b' || chr(10) || array_to_string(fees, chr(10)) FROM d
        UNION ALL SELECT doc_id, n, 3, 0, 'documents_complete', 0.95, 'รายการเอกสาร' || chr(10) || array_to_string(needed, chr(10)) FROM d WHERE n <= 10
        UNION ALL SELECT doc_id, n, 3, k, 'documents_' || name, imp, 'รายการเอกสาร (' || name || '):' || chr(10) || chr(10) || array_to_string(needed[a : b], chr(10))
            FROM d, (VALUES (0, 'mandatory', 1, 5, 0.95), (1, 'conditional', 6, 15, 0.85), (2, 'special', 16, 99, 0.85)) AS g(k, name, a, b, imp) WHERE n > 10 AND n >= a
        UNION ALL SELECT doc_id, n, 4, 0, 'special_procedure', 0.90, '*** กรณี x' || chr(10) || 'once' FROM d
        UNION ALL SELECT doc_id, n, 5, i - 1, 'legal_article', 0.95, articles[i] FROM d, unnest(range(1, n + 1)) AS r(i))"""


@_query(_ITEMS + " SELECT doc_id, section_id::BIGINT AS section_id, ordinal::BIGINT AS ordinal, chunk_type, importance_score::DOUBLE AS importance_score, text FROM c")
def chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages by the rules for lists, tables, required documents, special cases and articles."""
    tree = chunking.chunk_tree(structured(spark, sf_dir), type_col="kind").where("hierarchy_level = 2")
    return tree.select("doc_id", F.col("section_id").cast("long").alias("section_id"), F.col("ordinal").cast("long").alias("ordinal"), "chunk_type", "importance_score", "text")


_TREE = """,
    a AS (SELECT doc_id, section_id, 2 AS level, ordinal FROM c UNION ALL SELECT doc_id, s, 1, -1 FROM d, unnest(range(0, 6)) AS r(s) UNION ALL SELECT doc_id, -1, 0, -1 FROM d),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, level, ordinal) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM a),
    i AS (SELECT *, sha256(concat_ws('/', doc_id, level, greatest(section_id, 0), greatest(ordinal, 0))) AS chunk_id FROM o)"""


@_query(
    _ITEMS
    + _TREE
    + """ SELECT doc_id, chunk_id, k::BIGINT AS chunk_index, level::BIGINT AS hierarchy_level, total::BIGINT AS total_chunks, CASE WHEN k > 0 THEN k - 1 END::BIGINT AS previous_chunk_index, CASE WHEN k < total - 1 THEN k + 1 END::BIGINT AS next_chunk_index,
          CASE level WHEN 1 THEN sha256(concat_ws('/', doc_id, 0, 0, 0)) WHEN 2 THEN sha256(concat_ws('/', doc_id, 1, section_id, 0)) END AS parent_chunk_id FROM i"""
)
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbering, neighbours and parents of all chunks of a tree."""
    tree = chunking.chunk_tree(structured(spark, sf_dir), type_col="kind")
    return tree.select("doc_id", "chunk_id", *(F.col(x).cast("long").alias(x) for x in ("chunk_index", "hierarchy_level", "total_chunks", "previous_chunk_index", "next_chunk_index")), "parent_chunk_id")


@_query(
    _ITEMS
    + _TREE
    + ", p AS (SELECT *, CASE level WHEN 1 THEN sha256(concat_ws('/', doc_id, 0, 0, 0)) WHEN 2 THEN sha256(concat_ws('/', doc_id, 1, section_id, 0)) END AS parent FROM i) SELECT parent AS chunk_id, md5(string_agg(chunk_id, ',' ORDER BY k)) AS children_md5, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent"
)
def child_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children's ids in order, of all chunks that have some."""
    tree = chunking.chunk_tree(structured(spark, sf_dir), type_col="kind").where("size(child_chunk_ids) > 0")
    return tree.select("chunk_id", F.md5(F.array_join("child_chunk_ids", ",")).alias("children_md5"), F.size("child_chunk_ids").cast("long").alias("n_children"))


@_query(
    _ITEMS
    + """, s AS (SELECT doc_id, s AS section_id, sha256(concat_ws('/', doc_id, 1, s, 0)) AS chunk_id FROM d, unnest(range(0, 6)) AS r(s))
    SELECT a.chunk_id, string_agg(b.chunk_id, ',' ORDER BY b.section_id) AS sibling_ids FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.section_id <> b.section_id GROUP BY a.chunk_id"""
)
def section_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = chunking.chunk_tree(structured(spark, sf_dir), type_col="kind", levels=2)
    tree = settled(tree.select("chunk_id", "parent_chunk_id", "chunk_index", "hierarchy_level", "text"), "tree")  # every join below reads it
    hits = tree.where("hierarchy_level = 1").select("chunk_id")
    return fusion.with_context(hits, tree, siblings=True).select("chunk_id", F.array_join("sibling_ids", ",").alias("sibling_ids"))


_SECTION_ROWS = "(VALUES (0, NULL, 'default'), (1, 'ขั้นตอน', 'steps'), (2, 'ค่าธรรมเนียม', 'fees'), (3, 'รายการเอกสาร', 'documents'), (4, '*** กรณี x', 'special'), (5, 'หมวด ๑', 'chapter')) AS s(section_id, title, section_type)"


@_query(
    f"SELECT doc_id, section_id::BIGINT AS section_id, title, section_type, CASE section_id WHEN 0 THEN 1 WHEN 1 THEN n + 1 WHEN 2 THEN n + 3 WHEN 3 THEN n + 1 WHEN 4 THEN 2 ELSE n + 1 END::BIGINT AS n_lines FROM (SELECT doc_id, {_N} AS n FROM documents), {_SECTION_ROWS}"
)
def section_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    sec = chunking.sections(structured(spark, sf_dir), type_col="kind")
    return sec.select("doc_id", F.col("section_id").cast("long").alias("section_id"), "title", "section_type", F.size("lines").cast("long").alias("n_lines"))


# Documents in the language that the metadata patterns are for, with numbers of both scripts: k is a number from 1 to 50.
_K = "(doc_id % 50 + 1)"
_T = "translate({}::VARCHAR, '0123456789', '" + _THAI + "')"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") % 50 + 1).cast("int")
    thai = lambda c: F.translate(c.cast("string"), "0123456789", _THAI)
    plain = lambda c: c.cast("string")
    needed = F.array_join(F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(thai(i), F.lit(") x"))), "\n")
    words = [
        F.lit("คู่มือสำหรับประชาชน : การโอน  ที่ "), plain(k), F.lit("\nหน่วยงานที่ให้บริการ : สำนักงานที่ดินจังหวัด "), plain(k), F.lit(" \nใช้เวลา "), thai(k), F.lit(" นาที หรือ "), plain(k + 5), F.lit(" นาที ภายใน "),
        thai(k + 1), F.lit(" วัน และ 99999999999999999999 วัน\nค่าธรรมเนียม "), thai(k), F.lit(".5 บาท และ "), plain(k), F.lit(".5 บาท ร้อยละ "), thai(k % 5), F.lit("\nมาตรา "), thai(k), F.lit(" และ มาตรา "), plain(k),
        F.lit(" และ มาตรา "), plain(k), F.lit("\nพ.ศ. 25"), F.lpad(plain(k), 2, "0"), F.lit("\nจดทะเบียน e-QLands ใช้ "), thai(k), F.lit(" นาที\nรายการเอกสาร หลักฐานประกอบ\n"), needed, F.lit("\nแบบฟอร์ม (N) ต้องประกาศ คำสั่งศาล"),
    ]
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(*words).alias("text"))


@_query(
    f"""SELECT doc_id, 'คู่มือปชช' AS document_type, 'การโอน ที่ ' || k AS title, 'สำนักงานที่ดินจังหวัด ' || k AS organization, 'สำนักงานที่ดินจังหวัด' AS locations, 'N' AS version, true AS is_latest, '25' || lpad(k::VARCHAR, 2, '0') AS law_year, 'จดทะเบียน' AS service_category,
        k::BIGINT AS minutes, (k + 1)::BIGINT AS days, k::BIGINT AS queue_minutes, true AS requires_announcement, true AS requires_court_order, false AS requires_consent, 'online,walk-in' AS channels,
        {_T.format('k')} || ',' || k AS sections, (k + 0.5)::DOUBLE AS first_fee, 2::BIGINT AS n_fees, k::BIGINT AS n_documents, true AS has_legal_references, true AS has_e_qlands, false AS has_e_service, true AS has_fees
    FROM (SELECT doc_id, {_K} AS k FROM documents)"""
)
def metadata_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of the metadata struct that plain prose never fills."""
    m = described(spark, sf_dir).select("doc_id", metadata(F.col("text")).alias("m"))
    joined = lambda c: F.array_join(c, ",")
    return m.select(
        "doc_id", "m.document_type", "m.title", F.col("m.organization.full").alias("organization"), joined(F.col("m.organization.service_location")).alias("locations"), "m.version_info.version", "m.version_info.is_latest", "m.version_info.law_year", "m.categories.service_category",
        F.col("m.service.processing.standard.time_minutes").alias("minutes"), F.col("m.service.processing.standard.time_days").alias("days"), F.col("m.service.processing.alternative.time_minutes").alias("queue_minutes"),
        "m.service.requirements.requires_announcement", "m.service.requirements.requires_court_order", "m.service.requirements.requires_consent", joined(F.transform("m.service.channels", lambda c: c["type"])).alias("channels"),
        joined(F.transform(F.filter("m.legal_references", lambda r: r["type"] == fv.SECTION), lambda r: r["section"])).alias("sections"), F.get(F.transform("m.fees.all_fees", lambda f: f["amount"]), F.lit(0)).alias("first_fee"),
        F.size("m.fees.all_fees").cast("long").alias("n_fees"), F.col("m.required_documents.count").cast("long").alias("n_documents"), "m.content_features.has_legal_references", "m.content_features.has_e_qlands", "m.content_features.has_e_service", "m.fees.has_fees",
    )


@_query(r"SELECT doc_id, ceil(length(text) / 4)::BIGINT AS n_tokens, list_filter(string_split_regex(lower(text), '[^\pL\pM\pN]+'), lambda x: x NOT IN ('', 'the', 'de', 'und', 'la')) AS tokens FROM documents")
def stopped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", T.token_count(t).cast("long").alias("n_tokens"), T.tokens(t, ["the", "de", "und", "la"]).alias("tokens"))
