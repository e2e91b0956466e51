"""From requests to remembered answers in one plan: condense, route, retrieve, expand, prompt, answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.query import route
from . import dialogue, index
from .engine import Config


def answered(
    held: index.Index, requests: DataFrame, messages: DataFrame, embed: index.Embedder = index.hashed, generate: Callable[[Column], Column] = dialogue.default_generator, rewrite=None,
    level: int | str | None = None, mode: str = "hybrid", rerank: bool = True, shown: int = 3, config: Config = Config(),  # noqa: B008
) -> DataFrame:
    """``query_id, session_id, query, asked, route, answer, num_chunks`` of requests (``query_id, session_id, query``).

    ``asked`` is the question as it stands by itself (``rewrite`` gets the session's last turns of ``messages``). Only requests
    that are routed to the collection are searched; ``generate`` makes an answer of a prompt. Ids of requests must differ.
    """
    own = requests.select("query_id", "session_id", "query")
    asked = dialogue.condensed(messages, own, rewrite).select("query_id", F.col("query").alias("asked"))
    wanted = asked.where(route(F.col("asked")) == "RAG")
    hits = index.retrieve(held, index.questions(wanted, embed, text_col="asked", tokenise=held.tokenise), level, mode, rerank=rerank, config=config)
    contexts = index.prompts(index.expanded(held, hits.where(F.col("rank") <= shown)), shown).withColumnRenamed("prompt", "context")
    told = dialogue.answers(asked.withColumnRenamed("asked", "query"), contexts, generate)
    found = hits.groupBy("query_id").agg(F.count("*").alias("num_chunks"))
    whole = own.join(asked, "query_id").join(told, "query_id").join(found, "query_id", "left")
    return whole.select("query_id", "session_id", "query", "asked", "route", "answer", F.coalesce("num_chunks", F.lit(0)).cast("long").alias("num_chunks"))
