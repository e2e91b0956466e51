"""Query analysis and routing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import first_of, has_any, tokens, words


def analysis(query: Column) -> Column:
    low = F.lower(query)
    doc, sec, chunk = (has_any(low, w) for w in (fv.DOCUMENT_QUERY, fv.SECTION_QUERY, fv.CHUNK_QUERY))
    return F.struct(
        F.when(doc, "document").when(sec, "section").when(chunk, "chunk").otherwise("mixed").alias("query_type"),
        F.when(doc, 0).when(sec, 1).otherwise(2).alias("target_level"),
        ((F.size(words(query)) > 10) | has_any(query, fv.COMPLEX_QUERY)).alias("is_complex"),
        tokens(query).alias("keywords"),
        F.when(has_any(low, fv.SHORT_ANSWER), "short").when(has_any(low, fv.LONG_ANSWER), "long").otherwise("medium").alias("estimated_answer_length"),
    )


def route(query: Column, substrings: bool = True) -> Column:
    """Keyword routing. ``substrings=False`` asks Latin words to stand alone, so that 'this' is no greeting."""
    low = F.lower(query)
    about = has_any(low, fv.ABOUT_WORDS)
    if not substrings:
        latin = "|".join(w for w in fv.ABOUT_WORDS if w.isascii())
        about = has_any(low, [w for w in fv.ABOUT_WORDS if not w.isascii()]) | F.regexp_like(low, F.lit(rf"\b(?:{latin})\b"))
    return F.when(about, "ABOUT_BOT").when(has_any(low, fv.DOMAIN_WORDS), "RAG").otherwise("OUT_OF_SCOPE")


def parse_route(answer: Column) -> Column:
    """A language model's answer as a route: the first of three names that it contains."""
    up = F.upper(answer)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name in ("RAG", "OUT_OF_SCOPE", "ABOUT_BOT"):
        out = out.when(F.contains(up, F.lit(name)), name)
    return out.otherwise("OUT_OF_SCOPE")


def filters(query: Column) -> Column:
    """What a question asks of metadata, as structs (column, value); columns without a hit are left out."""
    found = [F.struct(F.lit(column).alias("column"), first_of(query, table).alias("value")) for column, table in fv.FILTERS]
    return F.filter(F.array(*found), lambda f: f["value"].isNotNull())


def sort_by(query: Column) -> Column:
    """The order that a question asks for, or null."""
    return F.when(has_any(query, fv.FAST_WORDS), F.lit(fv.FASTEST_FIRST))


def filter_rows(queries, id_col: str = "query_id", text_col: str = "query"):
    """``query_id, column, value`` of all questions, as searches take them."""
    each = queries.select(F.col(id_col).alias("query_id"), F.explode(filters(F.col(text_col))).alias("f"))
    return each.select("query_id", "f.column", "f.value")
