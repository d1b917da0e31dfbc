"""Language identification: sparse multinomial logistic regression over character n-grams.

Method. A text is lower-cased, everything but letters becomes a single blank, and
its character 1- to 3-grams are hashed to ``2**BITS`` features. A feature's weight
in a text is its count times its inverse document frequency (over all documents
that may be learned from), divided by the sum of these over the text. The weights
are trained with follow-the-regularised-leader (proximal, per-coordinate rates)
under an elastic-net penalty, on a bounded sample of labelled documents; part of
the sample is held back for the temperature by which the logits are divided.

Cases. A null text, or one without a letter, is ``und`` with score 0; so is every
text where nothing could be learned. With one language only, it is predicted
with score 1. Rows with a null language or id are not learned from, but are
predicted. Repeated rows get the same prediction. An empty table gives an empty
result. Whole texts are read, however long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_rows, sample_ids, small_batches

BITS = 16
#: Documents that the weights are trained on at most. Counts of documents for the
#: inverse frequencies are over all.
MOST_DOCS = 4000
UNKNOWN = "und"
#: Brings a text's weights, which sum to 1, to a size that suits the penalties.
SCALE = 30.0
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_PIECE = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> np.ndarray:
    """Feature numbers of all n-grams of ``text``, repeats included; empty without a letter."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of blanks in a row, the first
    c = np.where(letter, c, np.uint32(32))[keep]
    c = np.concatenate([np.uint32([32]), c, np.uint32([32] if letter[-1] else [])])
    a, b, d = _MULTIPLIERS
    one, two, three = c * a, c * b, c * d
    parts = [one, one[:-1] + two[1:] + np.uint32(77), one[:-2] + two[1:-1] + three[2:] + np.uint32(5077)]
    h = np.concatenate(parts)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each feature the number of texts of ``docs`` that have it, and that of texts."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                has = np.zeros(1 << BITS, bool)
                has[ngrams(text)] = True
                total += has
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["feature", "n"]
        )

    rows = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # at most one row a feature
    df = np.zeros(1 << BITS, np.int64)
    real = found[found.feature >= 0]
    df[real.feature.to_numpy()] = real.n.to_numpy()
    return df, int(found.n[found.feature == -1].sum())


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        """Of one text that has features."""
        num = np.zeros(len(self.languages))
        den = 0.0
        table = self._weighted()
        for at in range(0, len(features), _PIECE):
            part = features[at : at + _PIECE]
            num += table[part].sum(axis=0, dtype=np.float64)
            den += self.idf[part].sum(dtype=np.float64)
        return SCALE * num / max(den, 1e-12) + self.bias

    def _weighted(self) -> np.ndarray:
        if "_table" not in self.__dict__:
            object.__setattr__(self, "_table", (self.idf[:, None] * self.weights).astype(np.float32))
        return self.__dict__["_table"]

    def predict(self, text: str | None) -> tuple[str, float]:
        f = ngrams(text)
        if not len(f) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(f) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    alpha: float = 0.3,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.05,
    epochs: int = 2,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (feature numbers, values, class) rows."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bz, bn = np.zeros(classes), np.zeros(classes)

    def weights(z, n, l1=l1, l2=l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            at, v, y = rows[r]
            za, na = z[at], n[at]
            w, b = weights(za, na), weights(bz, bn, 0.0, 0.0)
            error = _softmax(v @ w + b)
            error[y] -= 1
            g = v[:, None] * error
            sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / alpha
            z[at], n[at] = za + g - sigma * w, na + g * g
            sigma = (np.sqrt(bn + error**2) - np.sqrt(bn)) / alpha
            bz, bn = bz + error - sigma * b, bn + error**2
    return weights(z, n), weights(bz, bn, 0.0, 0.0)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least cross-entropy."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(-4, 3, 141))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> LanguageModel:
    """Learn from ``docs`` with an id and a language, of the learning part alone."""
    small_batches(docs.sparkSession)
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    df, total = document_frequencies(learn)
    idf = np.log((1 + total) / (1 + df)) + 1
    ids = sample_ids(learn, most_docs, "lang")
    sampled = learn.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "lang", "text")

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(ngrams(t), return_counts=True) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([x.astype(np.uint16).tobytes() for x, _ in found], pa.binary()),
                    pa.array([x.astype(np.int32).tobytes() for _, x in found], pa.binary()),
                ],
                names=["doc_id", "lang", "features", "counts"],
            )

    got = sampled.mapInArrow(unique, "doc_id long, lang string, features binary, counts binary").collect()
    got = sorted((r for r in got if r.features), key=lambda r: (r.doc_id, r.lang))
    languages = tuple(sorted({r.lang for r in got}))
    rows = []
    for r in got:
        at = np.frombuffer(r.features, np.uint16).astype(np.int64)
        v = np.frombuffer(r.counts, np.int32) * idf[at]
        rows.append((at, SCALE * v / v.sum(), languages.index(r.lang)))
    cut = max(1, len(rows) // 5)
    held, learned = rows[::5][:cut], [r for k, r in enumerate(rows) if k % 5] or rows
    weights, bias = train_ftrl(learned, max(len(languages), 1))
    logits = np.array([v @ weights[at] + bias for at, v, _ in held]).reshape(len(held), max(len(languages), 1))
    temperature = fit_temperature(logits, np.array([y for _, _, y in held], np.int64)) if len(languages) > 1 else 1.0
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), bias, temperature)


def predict(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        m = shared.value

        def batch(cols):
            found = [m.predict(t) for t in cols[0]]
            return [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]

        return batch

    return map_rows(docs, ["text"], schema, make, keep)
