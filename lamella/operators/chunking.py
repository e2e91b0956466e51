"""Three-level chunk trees: document summary, sections, passages.

Everything happens on the document's own row, in array functions: lines, sections, passages and the numbering of
chunks. A tree needs no shuffle, and the rows of chunks come out of one explode (an outer one: Spark would infer a
filter from a plain one and compute the tree twice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import first_of, strip, token_count, unicode

SUMMARY_CHARS, SECTION_LINES = 500, 20
TABLE_TOKENS, TABLE_ROWS = 1500, 10
LIST_ITEMS, LIST_GROUP, LIST_STEP = 5, 6, 4
ARTICLE_TOKENS, WINDOW_TOKENS, OVERLAP = 800, 600, 2


#: At the start of a line, blanks aside; anchored once, so that other places of a line are not tried.
_HEADER = r"^\s*(?:" + "|".join(p.removeprefix("^") for p in fv.SECTION_HEADERS) + ")"


def section_array(text: Column) -> Column:
    """Sections of a text as structs ``section_id, start_line, end_line, title, section_type, lines``. A header in the first
    line opens no section, so section 0 never has a title."""
    lines = F.split(text, "\n")
    opens = F.filter(F.transform(lines, lambda line, i: F.when((i > 0) & F.regexp_like(line, F.lit(unicode(_HEADER))), i)), lambda i: i.isNotNull())
    edges = F.concat(F.array(F.lit(0)), opens, F.array(F.size(lines)))

    def cut(held: Column) -> Column:  # lines and edges are held in a struct, so that they are computed once
        def section(start: Column, k: Column) -> Column:
            end = F.get(held["edges"], k + 1)
            title = F.when(k > 0, strip(F.get(held["lines"], start)))
            return F.struct(
                k.alias("section_id"), start.alias("start_line"), (end - 1).alias("end_line"), title.alias("title"),
                F.coalesce(first_of(title, fv.SECTION_TYPES), F.lit("default")).alias("section_type"), F.slice(held["lines"], start + 1, end - start).alias("lines"),
            )

        return F.transform(F.slice(held["edges"], F.lit(1), F.size(held["edges"]) - 1), section)

    return once(F.struct(lines.alias("lines"), edges.alias("edges")), cut)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str | None = None) -> DataFrame:
    """``doc_id, document_type`` and the sections' fields, a row for each section."""
    kind = F.col(type_col) if type_col else F.lit(fv.OTHER_TYPE)
    rows = docs.select(F.col(id_col).alias("doc_id"), kind.alias("document_type"), F.explode_outer(section_array(F.coalesce(F.col(text_col), F.lit("")))).alias("s"))
    return rows.select("doc_id", "document_type", "s.*")


def summary(lines: Column) -> Column:
    """Lines up to and including the one that crosses the limit of characters."""
    state = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, line: Column) -> Column:
        return F.when(s["n"] <= SUMMARY_CHARS, F.struct((s["n"] + F.length(line)).alias("n"), F.array_append(s["kept"], line).alias("kept"))).otherwise(s)

    return F.array_join(F.aggregate(lines, state, step, lambda s: s["kept"]), "\n")


def items(lines: Column, start: str) -> Column:
    """Items that begin at lines matching ``start``; what stands before the first is dropped."""
    found = F.filter(F.transform(lines, lambda line, i: F.when(F.regexp_like(line, F.lit(unicode(start))), i + 1)), lambda i: i.isNotNull())

    def joined(at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(lines) + 1)
        return F.transform(at, lambda i, k: F.array_join(F.slice(lines, i, end(k) - i), "\n"))

    return once(found, joined)


def _chunk(text: Column, kind: Column | str, importance: float | Column, shift: Column | int = 0) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    importance = F.lit(importance) if isinstance(importance, float) else importance
    shift = F.lit(shift) if isinstance(shift, int) else shift
    return F.struct(text.alias("text"), kind.alias("chunk_type"), importance.cast("double").alias("importance_score"), shift.cast("int").alias("shift"))



def sentences(text: Column) -> Column:
    """Split after each sentence end."""
    return F.filter(F.regexp_extract_all(text, F.lit(rf"(?s)[^{fv.SENTENCE_ENDS}]*[{fv.SENTENCE_ENDS}]|[^{fv.SENTENCE_ENDS}]+"), 0), lambda s: s != "")


def sliding(text: Column, limit: int = WINDOW_TOKENS, overlap: int = OVERLAP) -> Column:
    """Greedy runs of sentences up to ``limit`` tokens; each run begins with the last sentences of the one before.
    A sentence above the limit stays whole."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def runs(held: Column) -> Column:
        size = lambda i: F.element_at(held["sizes"], i)
        piece = lambda first, last: F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))

        def step(s: Column, i: Column) -> Column:
            again = F.greatest(i - overlap, s["first"])
            n = F.aggregate(F.slice(held["sizes"], again, i - again + 1), F.lit(0).cast("long"), lambda z, x: z + x)
            moved = F.struct(again.cast("int").alias("first"), n.alias("n"), F.array_append(s["done"], piece(s["first"], i - 1)).alias("done"))
            grown = F.struct(s["first"].alias("first"), (s["n"] + size(i)).alias("n"), s["done"].alias("done"))
            return F.when((s["n"] + size(i) > limit) & (i > s["first"]), moved).otherwise(grown)

        total = F.size(held["sentences"])
        start = F.struct(F.lit(1).alias("first"), F.lit(0).cast("long").alias("n"), none.alias("done"))
        cuts = F.aggregate(F.sequence(F.lit(1), total), start, step, lambda s: F.array_append(s["done"], piece(s["first"], total)))
        return F.transform(F.when(total > 0, cuts).otherwise(none), lambda c: strip(F.array_join(F.slice(held["sentences"], c["first"], c["last"] - c["first"] + 1), "")))

    sized = once(sentences(text), lambda x: F.struct(x.alias("sentences"), F.transform(x, lambda y: token_count(y).cast("long")).alias("sizes")))
    return F.filter(once(sized, runs), lambda x: x != "")


def _groups(of: Column, size: int, step: int) -> Column:
    """Overlapping groups of an array, as arrays."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(of) - 1, F.lit(0)), F.lit(step)), lambda i: F.slice(of, i + 1, F.lit(size)))


def passage_array(section: Column, document_type: Column) -> Column:
    """Level-2 chunks of a section (struct ``lines, section_type``, ...): the first rule that applies decides."""
    return once(F.struct(section["lines"].alias("lines"), section["section_type"].alias("kind"), F.array_join(section["lines"], "\n").alias("text")), lambda s: _passages(s, document_type))


def by_table(lines: Column, kind: Column) -> Column:
    """Lines of a pipe table: whole, or in groups of rows under its header."""

    def split(table: Column) -> Column:
        head, rows = F.get(table, F.lit(0)), F.slice(table, F.lit(3), F.greatest(F.size(table) - 2, F.lit(0)))
        whole = F.concat_ws("\n", head, F.array_join(rows, "\n"))
        parts = F.transform(_groups(rows, TABLE_ROWS, TABLE_ROWS), lambda g, i: _chunk(F.concat_ws("\n", head, F.lit("| --- | --- |"), F.array_join(g, "\n")), F.concat(kind, F.lit("_table_part")), 0.85, i * TABLE_ROWS))
        return F.when(token_count(whole) <= TABLE_TOKENS, F.array(_chunk(whole, F.concat(kind, F.lit("_table")), 0.9))).otherwise(parts)

    return once(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), split)


def by_list(text: Column, lines: Column, kind: Column) -> Column:
    """Numbered items: together, or in overlapping groups."""
    few = lambda listed: F.array(_chunk(text, F.concat(kind, F.lit("_list")), 0.85))
    many = lambda listed: F.transform(_groups(listed, LIST_GROUP, LIST_STEP), lambda g: _chunk(F.array_join(g, "\n\n"), F.concat(kind, F.lit("_list_part")), 0.80))
    return once(items(lines, r"^\d+\."), lambda listed: F.when(F.size(listed) <= LIST_ITEMS, few(listed)).otherwise(many(listed)))


def by_article(lines: Column) -> Column:
    """Articles of a regulation; long ones in windows."""
    long = lambda a: F.transform(sliding(a), lambda t: _chunk(t, "legal_article_long", 0.7))
    return F.flatten(F.transform(items(lines, fv.ARTICLE_PATTERN), lambda a: F.when(token_count(a) <= ARTICLE_TOKENS, F.array(_chunk(a, "legal_article", 0.95))).otherwise(long(a))))


def by_documents(text: Column, lines: Column) -> Column:
    """Required documents: together, or as mandatory, conditional and special ones."""

    def group(name: str, part: Column, importance: float) -> Column:
        return F.when(F.size(part) > 0, _chunk(F.concat(F.lit(f"{fv.DOCUMENT_GROUP_PREFIX} ({name}):\n\n"), F.array_join(part, "\n")), f"documents_{name}", importance))

    def split(needed: Column) -> Column:
        rest = F.greatest(F.size(needed) - 15, F.lit(0))
        groups = F.array(group("mandatory", F.slice(needed, 1, 5), 0.95), group("conditional", F.slice(needed, 6, 10), 0.85), group("special", F.slice(needed, F.lit(16), rest), 0.85))
        return F.when(F.size(needed) > 10, F.filter(groups, lambda c: c.isNotNull())).otherwise(F.array(_chunk(text, "documents_complete", 0.95)))

    return once(items(lines, r"^\d+\)"), split)


def _passages(s: Column, document_type: Column) -> Column:
    text, lines, kind = s["text"], s["lines"], s["kind"]
    return (
        F.when(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---")), by_table(lines, kind))
        .when(F.regexp_count(text, F.lit(unicode(r"(?md)^\d+\."))) >= 3, by_list(text, lines, kind))
        .when((document_type == fv.REGULATION_TYPE) & kind.isin("chapter", "default"), by_article(lines))
        .when(kind == "special", F.array(_chunk(text, "special_procedure", 0.90)))
        .when(kind == "criteria", by_list(text, lines, kind))
        .when(kind == "documents", by_documents(text, lines))
        .otherwise(F.transform(sliding(text), lambda t: _chunk(t, kind, 0.7)))
    )


def chunk_id(doc: Column, level: int, section: Column, ordinal: Column) -> Column:
    """Deterministic, so reruns and joins agree."""
    return F.sha2(F.concat_ws("/", doc.cast("string"), F.lit(level), section.cast("string"), ordinal.cast("string")), 256)


def chunk_tree(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str | None = None, levels: int = 3) -> DataFrame:
    """All chunks of the first ``levels`` levels, linked and numbered within their document: ``chunk_index`` (the summary, then each section
    followed by its passages), the number of chunks, the neighbours' indexes and the children's ids in order."""
    doc, zero, none = F.col("doc_id"), F.lit(0), F.lit(None).cast("string")
    kind = F.col(type_col).cast("string") if type_col else F.lit(fv.OTHER_TYPE)
    rows = docs.select(F.col(id_col).alias("doc_id"), kind.alias("document_type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    root = chunk_id(doc, 0, zero, zero)

    def chunk(level: int, section: Column, ordinal: Column, id_: Column, parent: Column, c: Column, title: Column, start: Column, end: Column, children: Column) -> Column:
        return F.struct(
            section.cast("int").alias("section_id"), ordinal.cast("int").alias("ordinal"), F.lit(level).alias("hierarchy_level"), id_.alias("chunk_id"), parent.alias("parent_chunk_id"), children.alias("child_chunk_ids"), c["text"].alias("text"),
            c["chunk_type"].alias("chunk_type"), title.alias("section_title"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), c["importance_score"].alias("importance_score"),
        )

    def of_section(s: Column) -> Column:
        id_ = chunk_id(doc, 1, s["section_id"], zero)
        head = _chunk(F.array_join(F.slice(s["lines"], 1, SECTION_LINES), "\n"), F.concat(F.lit("section_"), s["section_type"]), 0.9)

        def linked(below: Column) -> Column:
            ids = F.transform(below, lambda c, k: chunk_id(doc, 2, s["section_id"], k))
            first = chunk(1, s["section_id"], F.lit(-1), id_, root, head, s["title"], s["start_line"], F.least(s["start_line"] + SECTION_LINES, s["end_line"]), ids)
            rest = F.transform(below, lambda c, k: chunk(2, s["section_id"], k, chunk_id(doc, 2, s["section_id"], k), id_, c, s["title"], s["start_line"] + c["shift"], s["end_line"], F.array().cast("array<string>")))
            return F.concat(F.array(first), rest)

        none_below = F.array().cast("array<struct<text:string,chunk_type:string,importance_score:double,shift:int>>")
        return once(passage_array(s, F.col("document_type")) if levels > 2 else none_below, linked)

    def tree_of(sections: Column) -> Column:
        lines = F.split("text", "\n")
        below = F.transform(sections, lambda s: chunk_id(doc, 1, s["section_id"], zero))
        top = chunk(0, F.lit(-1), F.lit(-1), root, none, _chunk(summary(lines), "document_summary", 1.0), none, zero, F.size(lines), below)
        every = F.concat(F.array(top), F.flatten(F.transform(sections, of_section)))
        return once(every, lambda t: F.transform(t, lambda c, i: F.struct(c.alias("c"), i.alias("chunk_index"), F.size(t).alias("total_chunks"))))

    tree = rows.select("doc_id", "document_type", once(section_array(F.col("text")), tree_of).alias("tree"))
    out = tree.select("doc_id", "document_type", F.explode_outer("tree").alias("t")).select("doc_id", "document_type", "t.*")
    return out.selectExpr(
        "doc_id", "document_type", "c.*", "chunk_index", "total_chunks", "IF(chunk_index > 0, chunk_index - 1, NULL) AS previous_chunk_index", "IF(chunk_index < total_chunks - 1, chunk_index + 1, NULL) AS next_chunk_index"
    )


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, documents, chunks for each document, and chunks by level."""
    by_level = [F.count_if(F.col("hierarchy_level") == i).alias(f"level{i}_chunks") for i in range(3)]
    total = chunks.agg(F.count("*").alias("total_chunks"), F.count_if(F.col("hierarchy_level") == 0).alias("total_documents"), *by_level)
    return total.withColumn("avg_chunks", F.col("total_chunks") / F.nullif(F.col("total_documents"), F.lit(0)))


def coverage(docs: DataFrame, chunks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, lost_lines, lost_chars, repeated_lines, n_orphans``: what the chunks make of each document.

    Lines are distinct, stripped and not blank. A line is lost if no chunk below the summary has it as a line (windows over sentences
    break lines: there the loss is told from above); repeated if several chunks of the lowest level have it. An orphan is a chunk whose
    parent is not among its document's chunks. A document without chunks has lost all its lines. Ids of documents must differ.
    """
    stripped = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: x != "")
    own = chunks.select("doc_id", "chunk_id", "parent_chunk_id", "hierarchy_level", F.when(F.col("hierarchy_level") > 0, F.array_distinct(stripped)).alias("lines"))
    low = F.array_sort(F.flatten(F.collect_list(F.when(F.col("hierarchy_level") == 2, F.col("lines")))))
    held = own.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("held"), low.alias("low"), F.collect_set("chunk_id").alias("ids"), F.collect_list("parent_chunk_id").alias("parents"))
    again = F.size(F.array_distinct(F.filter("low", lambda x, i: (i > 0) & (x == F.get(F.col("low"), i - 1)))))
    held = held.select(F.col("doc_id").alias("of"), "held", again.alias("again"), F.size(F.filter("parents", lambda p: ~F.array_contains(F.col("ids"), p))).alias("n_orphans"))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc_id", F.array_distinct(stripped).alias("lines"))
    met = lines.join(held, F.col("doc_id") == F.col("of"), "left").withColumn("lost", F.array_except("lines", F.coalesce("held", F.array().cast("array<string>"))))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return met.select(
        "doc_id", count(F.size("lines")).alias("n_lines"), count(F.size("lost")).alias("lost_lines"), count(F.aggregate("lost", F.lit(0), lambda z, x: z + F.length(x))).alias("lost_chars"),
        count(F.col("again")).alias("repeated_lines"), count(F.col("n_orphans")).alias("n_orphans"),
    )
