"""Conversation memory: bounded buffers, context windows and statistics by session.

``messages`` has session_id, seq, role, content. Windows are partitioned by session; statistics are plain
aggregates with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dense import dot, norm

ROLES = ("user", "assistant")


def fresh(name: str, taken: list[str]) -> str:
    """A column name that no column of ``taken`` has, whatever the case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def checked(messages: DataFrame) -> DataFrame:
    """Only roles that a memory takes; the others are an error of the caller and fail the job."""
    return messages.withColumn("role", F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise(F.raise_error(F.concat(F.lit("role not allowed: "), F.coalesce("role", F.lit("null"))))))


def last(messages: DataFrame, n: int, role: str | None = None) -> DataFrame:
    """The last n messages of each session, the first of them in place 1; all for n = 0, as slicing by -0 does."""
    rows = messages.where(F.col("role") == role) if role else messages
    if n:
        back = fresh("back", rows.columns)
        rows = rows.withColumn(back, F.expr("row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)")).where(F.col(back) <= n).drop(back)
    return rows


def context_window(messages: DataFrame, turns: int = 2, max_chars: int = 2000) -> DataFrame:
    """``session_id, context``: the last turns as lines by speaker, cut to the last characters."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "content")
    rows = last(messages, 2 * turns).select("session_id", "seq", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    joined = rows.groupBy("session_id").agg(text.alias("t"))
    return joined.select("session_id", F.when(F.length("t") > max_chars, F.concat(F.lit("..."), F.right("t", F.lit(max_chars)))).otherwise(F.col("t")).alias("context"))


def statistics(messages: DataFrame, max_messages: int = 20) -> DataFrame:
    """Counts of what the buffer holds; turns count every user message ever, evicted or not. With a timestamp ``at`` also how long
    the session lasted."""
    name = fresh("back", messages.columns)
    back = messages.withColumn(name, F.expr("row_number() OVER (PARTITION BY session_id ORDER BY seq DESC)"))
    held = F.col(name) <= max_messages
    return back.groupBy("session_id").agg(
        F.count_if(held).alias("total_messages"),
        F.count_if(held & (F.col("role") == "user")).alias("user_messages"),
        F.count_if(held & (F.col("role") == "assistant")).alias("assistant_messages"),
        F.count_if(F.col("role") == "user").alias("total_turns"),
        F.concat(F.count_if(held).cast("string"), F.lit(f"/{max_messages}")).alias("utilisation"),
        *([(F.max("at").cast("double") - F.min("at").cast("double")).alias("duration_seconds")] if "at" in messages.columns else []),
    )


def without_session(messages: DataFrame, sessions_: DataFrame) -> DataFrame:
    """Messages of other sessions: what is left when sessions are deleted."""
    return messages.join(sessions_.select("session_id").distinct(), "session_id", "left_anti")


def sessions(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def similar_turns(messages: DataFrame, vector: Column, k: int = 3, window: int = 200) -> DataFrame:
    """``session_id, seq, earlier_seq, score, rank``: for each message the ``k`` earlier ones of its session, among the last ``window``,
    whose vectors are nearest by cosine. ``window`` is what a session remembers, so a long session costs as much for each
    message as a short one. Messages without a usable vector find nothing and aren't found; ties go to the earlier message."""
    rows = messages.select("session_id", "seq", vector.alias("vector")).withColumn("length", norm(F.col("vector")))
    earlier = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-window, -1)
    held = rows.withColumn("before", F.collect_list(F.struct("seq", "vector", "length")).over(earlier)).where("length > 0")
    near = F.transform(F.filter("before", lambda b: b["length"] > 0), lambda b: F.struct((-F.round(dot(F.col("vector"), b["vector"]) / (F.col("length") * b["length"]), 6)).alias("less"), b["seq"].alias("earlier_seq")))
    best = held.select("session_id", "seq", F.posexplode(F.slice(F.array_sort(near), 1, k)).alias("place", "n"))
    return best.select("session_id", "seq", "n.earlier_seq", (F.lit(0.0) - F.col("n.less")).alias("score"), (F.col("place") + 1).alias("rank"))
