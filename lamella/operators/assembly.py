"""From ranked hits to what is shown: context within a budget, prompt text, citations, event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import fresh


#: What stands for a missing source and section; our own wording.
NO_SOURCE, NO_SECTION = "unknown source", "general"


def production_citations(hits: DataFrame, source: str, section: str = "section_title", shown: int = 3, text_chars: int = 500, relative_chars: int = 200) -> DataFrame:
    """The first ``shown`` expanded hits of each query, repeats kept: source, section, scores, cut texts, whether there is a parent and how many
    children."""
    cut = lambda c, n: F.substring(c, 1, n)
    return hits.where(F.col("rank") <= shown).select(
        "query_id", "rank", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"), F.coalesce(section, F.lit(NO_SECTION)).alias("section"), "score", "rerank_score",
        cut(F.col("text"), text_chars).alias("text"), cut(F.col("parent_text"), relative_chars).alias("parent_text"), F.transform("children_texts", lambda c: cut(c, relative_chars)).alias("children_texts"),
        F.col("parent_text").isNotNull().alias("has_parent"), F.size("children_texts").alias("num_children"),
    )


def within_budget(hits: DataFrame, size: Column, budget: int = 3000) -> DataFrame:
    """Hits of each query in rank order until the first that would overflow the budget."""
    return hits.withColumn("used", size.cast("long")).withColumn("used", F.expr("sum(used) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)")).where(F.col("used") <= budget)


def context(hits: DataFrame, text: Column, joiner: str = "\n---\n\n") -> DataFrame:
    """``query_id, context``: texts in rank order."""
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("t"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["t"]), joiner).alias("context"))


def block(source: Column, section: Column, level: Column, bm25: Column, dense: Column, text: Column, parent: Column, children: Column) -> Column:
    """One document of a prompt: header, scores if both legs have one, text, excerpt of parent and two children."""
    cut = lambda x, n: F.concat(F.substring(x, 1, n), F.lit("..."))
    scores = F.when(bm25.isNotNull() & dense.isNotNull(), F.format_string("bm25 %.3f, dense %.3f", bm25, dense))
    return F.concat_ws("\n", F.concat(F.lit("source: "), source), F.concat(F.lit("section: "), section), F.concat(F.lit("level: "), level.cast("string")), scores, text, F.when(parent.isNotNull(), cut(parent, 500)), F.array_join(F.transform(F.slice(children, 1, 2), lambda c: cut(c, 200)), "\n"))


def citations(hits: DataFrame, source: str, rerank: str = "rerank_score", score: str = "score") -> DataFrame:
    """The first hit of each source; a re-rank score of zero falls back to the score."""
    shown = F.when(F.coalesce(F.col(rerank), F.lit(0.0)) != 0, F.col(rerank)).otherwise(F.col(score))
    place = fresh("place", hits.columns)
    first = hits.withColumn(place, F.expr(f"row_number() OVER (PARTITION BY query_id, {source} ORDER BY rank)")).where(F.col(place) == 1)
    return first.select("query_id", F.col(source), "rank", F.format_string("%.4f", shown).alias("shown_score"))


def events(answers: DataFrame, id_col: str = "query_id", answer_col: str = "answer") -> DataFrame:
    """The event sequence of a streamed answer: a status, one token for each character, the final answer."""
    n = F.length(answer_col)
    chars = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit("token").alias("type"), F.substring(F.col(answer_col), i, F.lit(1)).alias("content")))
    chars = F.when(n > 0, chars).otherwise(F.array().cast("array<struct<type:string,content:string>>"))
    ends = lambda kind, text: F.array(F.struct(F.lit(kind).alias("type"), text.alias("content")))
    return answers.select(id_col, F.posexplode(F.concat(ends("status", F.lit("generating")), chars, ends("final", F.col(answer_col)))).alias("seq", "e")).select(id_col, "seq", "e.type", "e.content")
