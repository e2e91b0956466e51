"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (anything else counts as a blank) are hashed into a fixed number of features.
Document frequencies are counted over all training rows. The weights are trained by follow the regularised
leader with elastic-net penalties on at most ``max_rows`` rows, the ones with the smallest hash of the id;
a tenth of those is left out to fit the temperature that calibrates the probabilities.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows with a null language don't
train; without training rows all is ``und``; with one language everything with a letter gets it, score 1;
ids may be null (they never train) or repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once for a worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_TABLE: list[np.ndarray] = []


def grams(text: str | None, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs; none without a letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _TABLE[0][c]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(letter, c, 32).astype(np.uint32)
    blank = c == 32
    c = np.concatenate([[32], c[~(blank & np.concatenate([[True], blank[:-1]]))], [32]]).astype(np.uint32)  # one blank for many
    a, b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
    one = c * a
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * b + c[1:] * a
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * a + c[2:] * b
    counts = np.zeros(dims, np.int64)
    for i, x in enumerate((one, two, three)):
        x = x ^ np.uint32(i * 0x27D4EB2F)
        counts += np.bincount((x ^ (x >> np.uint32(16))) % np.uint32(dims), minlength=dims)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x features
    bias: np.ndarray
    temperature: float = 1.0

    @property
    def dims(self) -> int:
        return len(self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = grams(text, self.dims)
        if not self.langs or not len(at):
            return UNKNOWN, 0.0
        z = (self.weights[:, at] @ weigh(at, n, self.idf) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return (x / np.sqrt((x * x).sum())).astype(np.float64) if len(x) else x.astype(np.float64)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dims: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised (proximal) leader, one row at a time; the bias is not penalised."""
    z, n = np.zeros((classes, dims)), np.zeros((classes, dims))
    zb, nb = np.zeros(classes), np.zeros(classes)
    weight = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w, b = weight(z[:, at], n[:, at]), -zb / ((beta + np.sqrt(nb)) / alpha)
            s = w @ x + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            for g, zz, nn, ww, cols in ((p[:, None] * x, z, n, w, at), (p, zb, nb, b, slice(None))):
                old = nn[..., cols]
                new = old + g * g
                zz[..., cols] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * ww
                nn[..., cols] = new
    return weight(z, n), -zb / ((beta + np.sqrt(nb)) / alpha)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The scale that makes held-back rows likeliest, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(texts: DataFrame, dims: int, fan: int = 16) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs: a vector for each task, summed in ``fan`` tasks, then here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = grams(text, dims)
                total[at] += 1
                total[dims] += len(at) > 0
        yield pa.RecordBatch.from_arrays([pa.array([int(total[:dims].sum()) & 0xFFFF], pa.int32()), pa.array([total.tobytes()])], ["k", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, np.int64)
        for batch in batches:
            for v in batch.column(1).to_pylist():
                total += np.frombuffer(v, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()])], ["k", "v"])

    vectors = texts.mapInArrow(count, "k int, v binary").repartition(fan).mapInArrow(add, "k int, v binary").collect()
    total = sum((np.frombuffer(bytes(r["v"]), np.int64) for r in vectors), np.zeros(dims + 1, np.int64))
    return total[:dims], int(total[dims])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 1 << 15, max_rows: int = 4000, **options) -> Model:
    """Train on rows with a language: those of at most ``max_rows`` ids, the smallest by hash. At most ``max_rows`` rows reach the driver, as
    sparse features, and which ones doesn't depend on how the table is partitioned."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    df, n = _frequencies(rows.select("text"), dims)
    idf = np.log((1 + n) / (1 + df)) + 1
    chosen = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("chosen")).distinct().orderBy(F.xxhash64("chosen"), "chosen").limit(max_rows)
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("text", "lang", F.xxhash64("doc_id").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [grams(t, dims) for t in batch.column(0).to_pylist()]
            cols = [pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([weigh(a, n, idf).astype(np.float32).tobytes() for a, n in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(1), batch.column(2)], ["at", "x", "lang", "h"])

    got = sample.mapInArrow(run, "at binary, x binary, lang string, h long").orderBy("h", "lang", "at", "x").limit(max_rows).toPandas()
    got = got[got["at"].map(len) > 0].sort_values(["h", "lang", "at"])
    langs = sorted(set(got["lang"]))
    if not langs:
        return Model([], idf, np.zeros((0, dims)), np.zeros(0))
    xs = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float)) for a, x in zip(got["at"], got["x"], strict=True)]
    y = np.array([langs.index(v) for v in got["lang"]])
    back = np.arange(len(y)) % 10 == 9
    use = np.flatnonzero(~back)
    weights, bias = ftrl([xs[i] for i in use], y[use], len(langs), dims, **options)
    model = Model(langs, idf, weights.astype(np.float32), bias)
    held = np.flatnonzero(back)
    model.temperature = temperature(np.array([weights[:, xs[i][0]] @ xs[i][1] + bias for i in held]).reshape(len(held), len(langs)), y[held])
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
