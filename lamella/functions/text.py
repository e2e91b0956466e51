"""Scalar text functions as column expressions: clean-up, strip, counts, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_BREAK = r"[^\p{L}\p{M}\p{N}]+"

#: Unicode white space, what ``(?U)\s`` takes.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def has_any(text: Column, needles: list[str]) -> Column:
    """Whether the text contains one of the needles, as plain text."""
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def first_of(text: Column, table: list[tuple[list[str], str]], default: Column | None = None) -> Column:
    """The value of the first row of the table one of whose needles the text contains."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for needles, value in table:
        out = out.when(has_any(text, needles), F.lit(value))
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space runs become one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """Line ends unified, control and replacement characters dropped, blanks collapsed, each line stripped.

    Newline runs collapse before lines are stripped, so lines of white space alone can leave longer runs."""
    t = F.replace(F.replace(text, F.lit("�"), F.lit("")), F.lit("\u0000"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-cased runs of letters, marks and digits, without stopwords. The default tokeniser; a dictionary
    segmenter can be plugged in wherever a token column is taken (``functions.models``). Repeats stay: they are counted."""
    out = F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda w: w != "")
    return without(out, stopwords) if stopwords else out


def without(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens that are no stopwords, in order and with repeats."""
    return F.filter(tokens, lambda w: ~w.isin(*stopwords))


def digits(text: Column) -> Column:
    """Thai digits as the ones that can be cast to numbers."""
    return F.translate(text, "๐๑๒๓๔๕๖๗๘๙", "0123456789")


def unicode(pattern: str) -> str:
    """The pattern with classes that take all scripts' digits, letters and blanks, as the matched results have them."""
    return "(?U)" + pattern


def token_count(text: Column) -> Column:
    """Approximate number of model tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def file_info(text: Column, size_bytes: Column | None = None) -> Column:
    kb = F.bround((size_bytes if size_bytes is not None else F.lit(0)) / 1024, 2)
    return F.struct(kb.alias("file_size_kb"), F.size(F.split(text, "\n")).alias("line_count"), F.size(words(text)).alias("word_count"), F.length(text).alias("char_count"))
