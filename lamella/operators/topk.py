"""The best k of each query in one task, kept while its rows stream by; no Spark in here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS = 6


class Best:
    """Scores are rounded to ``DIGITS``; ties go to the smaller id, so no more than k rows of a query stay."""

    def __init__(self, queries: list, query_type: pa.DataType, k: int, above: float | None = None) -> None:
        self.queries, self.type, self.k, self.above = pa.array(queries, query_type), query_type, k, above
        self.floor = np.full(len(queries), -np.inf)
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, scores: np.ndarray, of: np.ndarray | None = None) -> None:
        """``scores`` has a row for each query, or for each of the queries ``of``, and a column for each id; NaN is no score."""
        scores = np.round(scores, DIGITS)
        keep = scores >= (self.floor if of is None else self.floor[of])[:, None]
        if self.above is not None:
            keep &= scores > self.above
        q, d = np.nonzero(keep)
        if len(q):
            self.held.append((q if of is None else of[q], ids.take(pa.array(d)), scores[q, d]))
            self.size += len(q)
            if self.size > 4 * self.k * len(self.floor) + 100_000:
                self._cut()

    def _cut(self) -> None:
        q, s = np.concatenate([x[0] for x in self.held]), np.concatenate([x[2] for x in self.held])
        ids = pa.concat_arrays([x[1] for x in self.held])
        order = pc.sort_indices(pa.table({"q": q, "s": s, "id": ids}), sort_keys=[("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        q, s = q[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        keep = place < self.k
        self.held = [(q[keep], ids.take(pa.array(order[keep])), s[keep])]
        self.size = int(keep.sum())

    def batch(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        self._cut()
        q, ids, s = self.held[0]
        return pa.RecordBatch.from_arrays([self.queries.take(pa.array(q)), ids, pa.array(s)], ["query_id", "doc_id", "score"])
