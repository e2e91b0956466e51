"""Pipe tables of texts as rows: fees, steps, whatever has cells.

A table is a run of lines that have a pipe. If its second line is a rule (dashes, colons, pipes), the first is its header. All of it
happens on the document's own row, in array functions, so texts aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import digits, strip, unicode
from .chunking import once

_RULE = r"^[\s|:]*-[\s|:-]*$"
_NUMBER = r"(\d[\d,]*(?:\.\d+)?)"


def blocks(text: Column) -> Column:
    """Tables as arrays of their lines, in order."""
    plain = F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit("")), r"(?md)^[^|\n]*$", "\u0001")
    runs = F.filter(F.split(plain, "\n?\u0001[\u0001\n]*"), lambda x: x != "")
    return F.transform(runs, lambda x: F.split(F.regexp_replace(x, r"^\n|\n$", ""), "\n"))


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\||\|$", ""), r"\|"), strip)


def number(cell: Column) -> Column:
    """The first number of a cell, in digits of either script."""
    return F.replace(digits(F.nullif(F.regexp_extract(cell, unicode(_NUMBER), 1), F.lit(""))), F.lit(","), F.lit("")).try_cast("double")


def unit(cell: Column) -> Column:
    return F.when(F.contains(cell, F.lit(fv.BAHT)), fv.BAHT).when(F.contains(cell, F.lit("%")), "%")


def rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, table_no, row_no, column_no, header, value, number, unit``, all numbers from 0.

    An empty first cell belongs to the row above and takes its value (a span); other empty cells are null. A cell beyond the header
    has no header, as all cells of a table without one. Rules inside a table are left out. A null text has no tables.
    """
    each = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(blocks(F.coalesce(F.col(text_col), F.lit("")))).alias("table_no", "lines"))
    ruled = F.coalesce(F.regexp_like(F.get("lines", F.lit(1)), F.lit(_RULE)), F.lit(False))
    body = F.filter(F.when(ruled, F.slice("lines", F.lit(3), F.size("lines"))).otherwise(F.col("lines")), lambda x: ~F.regexp_like(x, F.lit(_RULE)))
    told = each.select("doc_id", "table_no", F.when(ruled, cells(F.get("lines", F.lit(0)))).alias("headers"), F.transform(body, cells).alias("body"))
    start = F.array().cast("array<string>")

    def first_cells(held: Column) -> Column:
        step = lambda z, r: F.concat(z, F.array(F.coalesce(F.nullif(F.get(r, F.lit(0)), F.lit("")), F.element_at(F.concat(F.array(F.lit(None).cast("string")), z), -1))))
        return F.zip_with(F.aggregate(held, start, step), held, lambda f, r: F.struct(f.alias("first"), r.alias("cells")))

    lined = told.select("doc_id", "table_no", "headers", F.posexplode(once(F.col("body"), first_cells)).alias("row_no", "r"))
    placed = lined.select("doc_id", "table_no", "row_no", "headers", "r.first", F.posexplode("r.cells").alias("column_no", "cell"))
    value = F.when(F.col("column_no") == 0, F.col("first")).otherwise(F.nullif("cell", F.lit("")))
    out = placed.select("doc_id", "table_no", "row_no", "column_no", F.get("headers", F.col("column_no")).alias("header"), value.alias("value"))
    return out.select("*", number(F.col("value")).alias("number"), unit(F.col("value")).alias("unit"))
