"""Dictionary segmentation of scripts that write no blanks between words.

A user's word table becomes a trie. Inside a stretch of the script, places between character clusters (a consonant with the vowels
and marks that hang on it) are nodes and dictionary words are edges; of all ways through a stretch the one with the fewest
characters outside the dictionary is taken, then the one with the fewest dictionary words, then the one whose words are longest
from the left. Neighbouring clusters outside the dictionary are one token; runs of other letters and digits are tokens as they
are. The way is found from the end of a stretch to its start, in time proportional to its length and the longest word's.

The table is broadcast, so its size is checked; the trie is built once in a worker process.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv

THAI = "[฀-๿]"
#: Vowels that stand before their consonant; and vowels and marks that hang on what is before them.
_LEADING = "เ-ไ"
_HANGING = "ะ-ฺๅ็-๎̀-ͯ"
_JOINED = re.compile(f"(?<=[{_LEADING}])|(?=[{_HANGING}])")
_END = ""  # the key under which a trie's node says that a word ends


def trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[_END] = True
    root.pop(_END, None)  # the empty word
    return root


def clusters(stretch: str) -> list[bool]:
    """For each place from 0 to the end whether a word may begin or end there."""
    free = [True] * (len(stretch) + 1)
    for m in _JOINED.finditer(stretch):
        free[m.start()] = False
    free[0] = free[-1] = True
    return free


def shortest(stretch: str, root: dict) -> list[str]:
    """The tokens of one stretch."""
    n = len(stretch)
    free = clusters(stretch)
    # from each place to the end: characters outside the dictionary and words, in one number; where the first piece ends; whether it is a word
    cost, end, known = [0] * (n + 1), [n] * (n + 1), [False] * (n + 1)
    for p in range(n - 1, -1, -1):
        if not free[p]:
            continue
        q = p + 1
        while not free[q]:
            q += 1
        best, stop, is_word = cost[q] + ((q - p) << 32), q, False
        node, q = root, p
        while q < n:
            node = node.get(stretch[q])
            if node is None:
                break
            q += 1
            if _END in node and free[q] and cost[q] + 1 <= best:
                best, stop, is_word = cost[q] + 1, q, True
        cost[p], end[p], known[p] = best, stop, is_word
    out, p = [], 0
    while p < n:
        q = end[p]
        if not known[p]:
            while q < n and not known[q]:
                q = end[q]
        out.append(stretch[p:q])
        p = q
    return out


def cutter(words: Iterable[str], script: str = THAI, stopwords: frozenset[str] = frozenset()) -> Callable[[list[str]], list[list[str]]]:
    """Texts to lists of tokens in lower case, without stopwords; ``script`` is a class of characters."""
    root = trie(w.lower() for w in words)
    parts = re.compile(rf"({script}+)|(?:(?!{script})[^\W_])+")
    mark = re.compile(r"[^\W_]")

    def cut(texts: list[str]) -> list[list[str]]:
        out = []
        for text in texts:
            found: list[str] = []
            for m in parts.finditer(text.lower()):
                found += shortest(m[0], root) if m[1] else [m[0]]
            out.append([t for t in found if t not in stopwords and mark.search(t)])
        return out

    return cut


def collected(words: DataFrame, column: str = "word", most: int = 500_000) -> list[str]:
    """A word table whose size is checked before it is broadcast."""
    rows = words.select(column).where(F.length(column) > 0).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} words: raise the limit where workers have the memory")
    return sorted(r[0] for r in rows)


def segmenter(spark: SparkSession, words: Iterable[str], script: str = THAI, stopwords: Iterable[str] = ()) -> Callable[[Column], Column]:
    """text -> array<string>, to be given wherever a tokeniser is taken. Null becomes no tokens."""
    shared = spark.sparkContext.broadcast((sorted(set(words)), script, frozenset(stopwords)))

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut = cutter(*shared.value)
        for texts in parts:
            yield pd.Series(cut(texts.fillna("").tolist()), dtype=object)

    return run


def domain_words() -> list[str]:
    """The words that the engine's own patterns know, for a table to begin with."""
    needles = [w for row in (*fv.CATEGORIES, *fv.TAGS, *fv.SECTION_TYPES) for w in row[0 if isinstance(row[0], list) else 1]]
    listed = [*needles, *fv.PRIMARY_KEYWORDS, *fv.DOMAIN_WORDS, *fv.DOCUMENT_QUERY, *fv.SECTION_QUERY, *fv.CHUNK_QUERY, *fv.THAI_STOPWORDS]
    return sorted({w for w in listed if re.fullmatch(f"{THAI}+", w)})


def word_table(tokens: DataFrame, most: int = 20_000, longest: int = 24) -> DataFrame:
    """``word, df``: of rows with ``tokens`` the ``most`` words of up to ``longest`` letters that the most rows have (a table's size is its
    feature); ties go to the smaller word."""
    each = tokens.select(F.explode(F.array_distinct("tokens")).alias("word")).where(F.col("word").rlike(rf"^\p{{L}}{{1,{longest}}}$"))
    return each.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(most)
