"""Search in metadata: matches of a question's words in a document's fields, each with its weight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import bm25

#: Weights of fields unless others are given.
WEIGHTS = {"title": 3.0, "category": 2.0, "tags": 2.0, "keywords": 1.0}


def field_terms(docs: DataFrame, fields: dict[str, Column], weights: dict[str, float], id_col: str = "doc_id", tokenise: Callable[[Column], Column] = tokens, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, length, terms, tfs``: for every distinct word of a field an entry with the field's weight. Null fields have none."""

    def entries(field: Column, weight: float) -> Column:
        return F.transform(F.array_distinct(tokenise(F.coalesce(field, F.lit("")))), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("weight")))

    every = F.flatten(F.array(*(entries(c, weights[name]) for name, c in fields.items())))
    rows = docs.select(F.col(id_col).alias("doc_id"), every.alias("e"), *(keep or []))
    return rows.select("doc_id", F.size("e").alias("length"), F.col("e.term").alias("terms"), F.col("e.weight").alias("tfs"), *(keep or []))


def search(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 2000, filters: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score, rank``: for each question (``query_id, tokens``) the documents of ``field_terms`` with the largest sum of
    weights of entries that are one of its distinct words."""
    out = None
    for part in bm25._blocks(queries, block):
        once = [(q, sorted(set(ts))) for q, ts in part]
        found = bm25._scored(rows, queries, once, {t: 1.0 for _, ts in once for t in ts}, 1.0, k, plain=True, filters=filters)
        out = found if out is None else out.unionByName(found)
    return bm25.ranked(out, k)
