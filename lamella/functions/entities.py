"""Named things in texts: all words of a table are found in one pass, by an Aho-Corasick automaton.

The table (type, needle) is broadcast, so its size is checked; the automaton is built once in a worker process and reads each text
once, however many needles there are. Needles are found wherever they occur, inside words and over each other, as a search for each
needle alone would find them. Laws, fees and durations are patterns, not words, and come from ``metadata``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv

FOUND = "array<struct<type:string,needle:string,count:int,first:int>>"


def default_table() -> list[tuple[str, str]]:
    return [(kind, needle) for kind, needles in fv.ENTITIES.items() for needle in needles]


def collected(table: DataFrame, most: int = 500_000) -> list[tuple[str, str]]:
    """A table of ``type, needle`` whose size is checked before it is broadcast; blank and null needles are left out."""
    rows = table.select("type", "needle").where("type IS NOT NULL AND needle <> ''").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} needles: raise the limit where workers have the memory")
    return sorted((r[0], r[1]) for r in rows)


def automaton(table: list[tuple[str, str]]) -> Callable[[str], list[tuple[str, str, int, int]]]:
    """text to ``(type, needle, count, first place)`` in order of type, then needle; a needle may have several types."""
    import ahocorasick

    kinds: dict[str, list[str]] = {}
    for kind, needle in sorted(set(table)):
        kinds.setdefault(needle, []).append(kind)
    found_by = ahocorasick.Automaton()
    for needle in kinds:
        found_by.add_word(needle, needle)
    if kinds:
        found_by.make_automaton()

    def find(text: str) -> list[tuple[str, str, int, int]]:
        if not kinds or not text:
            return []
        count: Counter[str] = Counter()
        first: dict[str, int] = {}
        for end, needle in found_by.iter(text):
            count[needle] += 1
            first.setdefault(needle, end - len(needle) + 1)
        return sorted((kind, needle, n, first[needle]) for needle, n in count.items() for kind in kinds[needle])

    return find


def finder(spark: SparkSession, table: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """text -> array of structs ``type, needle, count, first`` (from 0); null has none."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf(FOUND)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = automaton(shared.value)
        for texts in parts:
            yield pd.Series([[dict(zip(("type", "needle", "count", "first"), x, strict=True)) for x in find(t)] for t in texts.fillna("")], dtype=object)

    return run


def flags(found: Column, text: Column) -> Column:
    """What a chunk has, from what a finder with ``default_table`` found in it and its text."""

    def number(kind: str) -> Column:
        return F.aggregate(F.filter(found, lambda f: f["type"] == kind), F.lit(0), lambda z, f: z + f["count"])

    items = F.regexp_count(text, F.lit(r"(?m)^\s*(?:[0-9๐-๙]+[.)]|[-•])\s"))
    return F.struct(
        (F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))).alias("has_table"), (items > 0).alias("has_list"), items.alias("list_items_count"),
        (number("law") > 0).alias("has_legal_ref"), number("law").alias("legal_ref_count"), (number("example") > 0).alias("has_example"),
        (number("condition") > 0).alias("has_conditions"), number("condition").alias("condition_count"), (number("exception") > 0).alias("has_exceptions"), number("exception").alias("exception_count"),
    )
