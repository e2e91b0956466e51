"""Filters of each question on its own, applied while rows stream by.

A filter is a row ``query_id, column, value``. A search of many questions reads its rows once; for each batch the
distinct values of a filtered column are looked up in a table of which questions allow them, which gives a bitmap of
questions by rows. Questions without a filter for a column allow every value of it; of several values of one column
one must hold, of several columns all. A row's null is allowed only where nothing is asked of its column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Mask:
    """Which questions (by place in a block) allow a row, from its columns' values as text."""

    def __init__(self, columns: list[str], questions: list, wanted: list[tuple[object, str, str]]) -> None:
        place = {q: i for i, q in enumerate(questions)}
        self.free = {c: np.ones(len(questions), bool) for c in columns}
        self.of: dict[str, dict[str, np.ndarray]] = {c: {} for c in columns}
        for q, c, v in wanted:
            if q in place:
                self.free[c][place[q]] = False
                self.of[c].setdefault(v, np.zeros(len(questions), bool))[place[q]] = True

    def __call__(self, columns: list[pa.Array]) -> np.ndarray | None:
        """A row for each question, a column for each row of the batch; None where there is no filter."""
        out = None
        for (c, free), values in zip(self.free.items(), columns, strict=True):
            coded = values.cast(pa.string()).dictionary_encode()
            table = np.stack([*(free | self.of[c].get(v, False) for v in coded.dictionary.to_pylist()), free])
            codes = coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)
            allowed = table[codes].T
            out = allowed if out is None else out & allowed
        return out


def collected(filters: DataFrame | None, questions: list, rows: DataFrame) -> tuple[list[str], list[tuple[object, str, str]]]:
    """The filtered columns and the filters of a block of questions, whose number bounds theirs."""
    if filters is None:
        return [], []
    ask = filters.sparkSession.createDataFrame([(q,) for q in questions], f"query_id {filters.schema['query_id'].dataType.simpleString()}") if questions else None
    if ask is None:
        return [], []
    got = [(r[0], r[1], r[2]) for r in filters.join(ask, "query_id", "left_semi").select("query_id", "column", "value").distinct().collect()]
    columns = sorted({c for _, c, _ in got})
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"the searched rows have no column {missing[0]}")
    return columns, got
