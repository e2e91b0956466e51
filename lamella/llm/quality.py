"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees on binned features are boosted in cycles, one feature after another, and add up to one
lookup table for each feature; afterwards pairs of features with the largest residual gain get
two-dimensional tables in the same way. A score is the sum of a document's bins, through a sigmoid.

The model is fitted on at most ``max_rows`` labelled rows, the ones with the smallest hash of the id; all
else runs over every whole text in one narrow pass.

Defined cases: null text is empty text and gets a score like any other; null labels don't train; without
a single usable label the score is 0.5 for all; several labels for one id each train; ids may repeat; an empty
table gives an empty result; other columns are not read, and ``scored_rows`` keeps them all, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, texts, unused
from .textstats import measure_all

FEATURES = (
    "log_words", "chars_per_word", "symbols_per_word", "dup_lines", "repeated", "distinct", "top_share", "upper_share",
    "digit_share", "bang_per_word", "pipe_per_word", "stops_per_word", "commas_per_word", "runs", "upper_words", "long_words",
    "words_per_line",
)


def features(raws: list[bytes]) -> np.ndarray:
    m = {k: v.astype(np.float64) for k, v in measure_all(raws).items()}
    w, lines, letters = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1), np.maximum(m["n_upper"] + m["n_lower"], 1)
    return np.stack(
        [
            np.log1p(m["n_words"]), m["word_chars"] / w, m["n_symbols"] / w, m["n_dup_lines"] / lines, m["n_repeat_words"] / w,
            m["n_distinct"] / w, m["top_count"] / w, m["n_upper"] / letters, m["n_digits"] / np.maximum(m["word_chars"], 1),
            m["n_bang"] / w, m["n_pipe"] / w, m["n_stop"] / w, m["n_comma"] / w, m["n_runs"] / w, m["n_upper_words"] / w,
            m["n_long_words"] / w, m["n_words"] / lines,
        ],
        axis=1,
    )


@dataclass
class Gam:
    """Lookup tables: ``single[f][bin]`` and ``pairs[(f, g)][bin_f, bin_g]``, on the log-odds scale."""

    cuts: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.intercept)
        for f, t in enumerate(self.single):
            out += t[b[:, f]]
        for (f, g), t in self.pairs.items():
            out += t[b[:, f], b[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.cuts:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values, by bin, of a tree on one feature: the best splits of the histogram, greedily."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    edges = [0, len(g)]
    gain_of = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain_of(a, at) + gain_of(at, b) - gain_of(a, b)
                i = int(np.argmax(gains))
                best = max(best, (float(gains[i]), int(at[i])))
        if best[1] < 0:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's histogram into four quadrants: its gain and its values."""
    sg, sh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = sg[-1, -1], sh[-1, -1]
    a = [(sg, sh), (sg[-1:, :] - sg, sh[-1:, :] - sh), (sg[:, -1:] - sg, sh[:, -1:] - sh)]
    a.append((tg - sg[-1:, :] - sg[:, -1:] + sg, th - sh[-1:, :] - sh[:, -1:] + sh))
    gain = sum(x**2 / (y + ridge) for x, y in a)[:-1, :-1]
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + ridge) for x, y in a]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[i + 1 :, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 48, cycles: int = 160, leaves: int = 3, pairs: int = 6, pair_cycles: int = 60, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """Newton boosting in cycles over the features, then over the ``pairs`` best pairs."""
    ok = np.isfinite(x).all(axis=1)
    x, y = x[ok], y[ok].astype(float)
    if not len(y):
        return Gam()
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    m = Gam([np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])], float(np.log(p / (1 - p))))
    b = m.bins(x)
    sizes = [len(c) + 1 for c in m.cuts]
    m.single = [np.zeros(s) for s in sizes]
    at = np.full(len(y), m.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-at))
        return y - q, q * (1 - q)

    for _ in range(cycles):
        for f, s in enumerate(sizes):
            g, h = slopes()
            t = rate * _tree(np.bincount(b[:, f], g, s), np.bincount(b[:, f], h, s), leaves, ridge)
            m.single[f] += t
            at += t[b[:, f]]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        code, n = b[:, f] * sizes[k] + b[:, k], sizes[f] * sizes[k]
        return np.bincount(code, g, n).reshape(sizes[f], sizes[k]), np.bincount(code, h, n).reshape(sizes[f], sizes[k])

    ranked = sorted(((_quadrants(*grid(f, k), 10 * ridge)[0], f, k) for f in range(len(sizes)) for k in range(f)), reverse=True)[:pairs]
    m.pairs = {(f, k): np.zeros((sizes[f], sizes[k])) for _, f, k in ranked}
    for _ in range(pair_cycles):
        for f, k in m.pairs:
            t = rate * _quadrants(*grid(f, k), 10 * ridge)[1]
            m.pairs[f, k] += t
            at += t[b[:, f], b[:, k]]
    return m


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 12_000, **options) -> Gam:
    """Fit on labelled documents. The sample is at most ``max_rows`` labels and as many rows that have them, the smallest
    by hash, so its size is the bound on what is broadcast and on what reaches the driver (17 doubles a row)."""
    chosen = (
        labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("y"))
        .where("y IN (0, 1) AND label_id IS NOT NULL")
        .orderBy(F.xxhash64("label_id"), "label_id", "y")
        .limit(max_rows)
    )
    rows = texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("raw", "y", F.xxhash64("doc_id", "raw").alias("h"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "h"])

    # a repeated id brings a row for each copy: the bound holds for rows too
    got = rows.mapInArrow(per_batch(run), "x array<double>, y int, h long").orderBy("h", "y").limit(max_rows).toPandas()
    if not len(got):
        return Gam()
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort([*x.T, got["y"].to_numpy()])  # the fit doesn't depend on the order of arrival
    return fit_gam(x[order], got["y"].to_numpy()[order], **options)


def score(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every document, by bin additions."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1).to_pylist())))], ["doc_id", "score"])

    out = texts(docs, id_col, text_col)
    return out.mapInArrow(per_batch(run), f"doc_id {out.schema['doc_id'].dataType.simpleString()}, score double")


def scored_rows(docs: DataFrame, model: Gam, name: str, text_col: str = "text") -> DataFrame:
    """All of ``docs``' columns and a column ``name`` with the score: for filters that keep the rows as they are."""
    names = docs.columns
    if name != unused(name, names):
        raise ValueError(f"there is a column {name} already")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [x or b"" for x in batch.column(len(names)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(features(raws)))], [*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.withColumn(unused("raw", names), F.col(text_col).cast("binary")).mapInArrow(per_batch(run), schema)
