"""Batch dialogue: requests are routed, each route answers its branch, and branches are united.

A generator is a column expression (or pandas UDF) from context to text; the offline default quotes the context's
beginning. Constant answers are our own wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import route

ABOUT_ANSWER = "I answer questions about the documents in this collection."
OUT_OF_SCOPE_ANSWER = "This question is outside the collection, so I can't answer it."
NO_CONTEXT_ANSWER = "No passage of the collection answers this."


def routed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("route", route(F.col("query")))


def default_generator(context: Column) -> Column:
    return F.substring(context, 1, 500)


def answers(requests: DataFrame, contexts: DataFrame, generate=default_generator) -> DataFrame:
    """``query_id, route, answer``. ``contexts`` (``query_id, context``) is joined for the branch that retrieves only."""
    asked = routed(requests).select("query_id", "query", "route")
    fixed = F.when(F.col("route") == "ABOUT_BOT", ABOUT_ANSWER).otherwise(OUT_OF_SCOPE_ANSWER)
    constant = asked.where("route <> 'RAG'").select("query_id", "route", fixed.alias("answer"))
    found = asked.where("route = 'RAG'").join(contexts, "query_id", "left")
    told = found.select("query_id", "route", F.coalesce(generate(F.col("context")), F.lit(NO_CONTEXT_ANSWER)).alias("answer"))
    return constant.unionByName(told)


def appended(messages: DataFrame, requests: DataFrame, answered: DataFrame, max_answer: int = 500) -> DataFrame:
    """``session_id, seq, role, content``: a user and an assistant message for each request (``query_id, session_id, query``), numbered
    after the session's last message; long answers are cut."""
    last = messages.groupBy("session_id").agg(F.max("seq").alias("last_seq"))
    order = F.expr("row_number() OVER (PARTITION BY session_id ORDER BY query_id)")
    both = requests.select("query_id", "session_id", "query").join(answered.select("query_id", "answer"), "query_id").join(last, "session_id", "left").withColumn("turn", order)
    base = F.coalesce("last_seq", F.lit(-1)) + (F.col("turn") - 1) * 2
    pair = F.array(F.struct((base + 1).alias("seq"), F.lit("user").alias("role"), F.col("query").alias("content")), F.struct((base + 2).alias("seq"), F.lit("assistant").alias("role"), F.substring("answer", 1, max_answer).alias("content")))
    return both.select("session_id", F.explode(pair).alias("m")).select("session_id", F.col("m.seq").cast("long").alias("seq"), "m.role", "m.content")


def remembered(messages: DataFrame, requests: DataFrame, answered: DataFrame, max_answer: int = 500) -> DataFrame:
    """``messages`` with what ``appended`` adds to them."""
    held = messages.select("session_id", F.col("seq").cast("long").alias("seq"), "role", "content")
    return held.unionByName(appended(messages, requests, answered, max_answer))


def expanded(tokens: Column, synonyms: dict[str, list[str]]) -> Column:
    """Query tokens and, after each, its synonyms; first occurrences only."""
    table = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.array(*map(F.lit, v))) for k, v in sorted(synonyms.items()))))
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))))


def diversified(hits: DataFrame, group: str, penalty: float = 0.3) -> DataFrame:
    """Rank anew with a penalty for each earlier hit of the same group, a greedy diversification in one window."""
    earlier = F.expr(f"row_number() OVER (PARTITION BY query_id, {group} ORDER BY rank) - 1")
    scored = hits.withColumn("diverse_score", F.round(F.col("score") * F.pow(F.lit(1 - penalty), earlier), 6))
    return scored.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY diverse_score DESC, doc_id)"))


#: Weight of the sparse leg by type of query, exact ones higher.
ALPHA = {"chunk": 0.65, "section": 0.5, "document": 0.35, "mixed": 0.5}


def alpha_by_type(query_type: Column) -> Column:
    return F.coalesce(*(F.when(query_type == k, F.lit(v)) for k, v in ALPHA.items()), F.lit(0.5))


def condensed(history: DataFrame, requests: DataFrame, rewrite=None, turns: int = 2) -> DataFrame:
    """``query_id, query`` with follow-up questions as they stand by themselves: ``rewrite`` (a column from history and question, such as
    a model) gets the session's last turns; the offline default leaves the question alone."""
    from ..operators.memory import context_window

    told = requests.join(context_window(history, turns), "session_id", "left")
    query = F.col("query") if rewrite is None else F.when(F.col("context").isNotNull(), rewrite(F.col("context"), F.col("query"))).otherwise(F.col("query"))
    return told.withColumn("query", query).drop("context")
