"""Adapters for models behind columns: each is loaded once for a worker process and fed Arrow batches.

``load`` is called in the worker; what it returns is called with lists. The offline defaults (``functions.text.tokens``,
``operators.dense.hashed_embedding``, ``operators.fusion.overlap_score``) go in the same places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F


def tokenizer(load: Callable[[], Callable[[list[str]], list[list[str]]]], stopwords: frozenset[str] = frozenset()):
    """text -> array<string>: a dictionary segmenter; blanks go, tokens are lower-cased, stopwords go, repeats stay."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = load()
        for texts in parts:
            got = cut(texts.fillna("").tolist())
            yield pd.Series([[w for w in (t.strip().lower() for t in ts) if w and w not in stopwords] for ts in got])

    return run


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 16):
    """text -> array<float>, in batches of the model's own size; null stays null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            out = pd.Series([None] * len(texts), dtype=object)
            some = [i for i, t in enumerate(texts) if t is not None]
            for a in range(0, len(some), batch):
                at = some[a : a + batch]
                for i, v in zip(at, encode([texts.iloc[i] for i in at]), strict=True):
                    out.iloc[i] = list(v)
            yield out

    return run


def reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]):
    """(query, text) -> double: a cross-encoder over pairs of one batch at a time."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = load()
        for query, text in parts:
            yield pd.Series(score(list(zip(query.fillna("").tolist(), text.fillna("").tolist(), strict=True))), dtype=float)

    return run
