"""Quality: ordinal cumulative-link regression over hashed text features.

Method. Words and their shapes (capitals, signs, lengths) are hashed to features
that weigh in by their share of the text; so are bucketed measures of the whole
text (repeated words and lines, signs, capitals, length). One weight vector,
shared by all grades, gives a latent quality; ordered thresholds cut it into the
grades: P(grade <= k) = sigmoid(threshold_k - quality). Thresholds stay in order,
for each is the one before plus an exponential. From the grades' probabilities
come the expected grade and the tail probability, by which documents are selected.

Cases. A null or empty text is a text without words, and is scored so. Rows
without an id or with a null rating are not learned from. Without ratings, or with
a single grade, every text gets that grade (0 without any) and the tail
probability 1. Repeated rows score alike. An empty table gives an empty result.
Texts are read whole. Input columns whose names an output has are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_rows, sample_ids, small_batches

BITS = 16
#: Rated documents that the model is fitted on at most.
MOST_DOCS = 8000
MEMO = 100_000
#: Documents whose tail probability is below this are rejected.
REJECT_BELOW = 0.25
_UPPER, _SIGNS = bytes(range(65, 91)), b"!#$%&*|<>=@\\^~{}"
_RUNS = re.compile(r"(.)\1+")


def _feature(kind: str, text: str) -> int:
    return zlib.crc32(f"{kind}\0{text}".encode("utf-8", "replace")) & ((1 << BITS) - 1)


class _Kinds(dict):
    """For ``str.translate``: letters to A or a, digits to 0, others to themselves; filled as met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = self[code] = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        return kind


_KINDS = _Kinds()


def shape(word: str) -> str:
    """The word's kinds of characters, runs cut short: ``AA!!`` for ``THE!!``."""
    return _RUNS.sub(r"\1\1", word.translate(_KINDS))


class Featurizer:
    """The two features of a word, remembered; and those of a whole text."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def word(self, word: str) -> int:
        """The features of the word and of its shape, in one number."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        found = self.memo[word] = _feature("w", word.lower()) << BITS | _feature("s", shape(word))
        return found

    def measures(self, text: str, words: list[str]) -> list[int]:
        """Bucketed measures of the whole text, a feature each."""
        n, lines = len(words), [x for x in text.split("\n") if x]
        size = max(len(text), 1)
        raw = text.encode("utf-8", "replace")
        upper = (len(raw) - len(raw.translate(None, _UPPER))) / size
        plain = len(text) - (len(raw) - len(raw.translate(None, _SIGNS)))
        values = {
            "distinct": int(20 * len(set(words)) / max(n, 1)),
            "lines": int(10 * len(set(lines)) / max(len(lines), 1)),
            "pairs": int(20 * len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)),
            "upper": int(20 * upper),
            "signs": int(40 * (1 - plain / size)),
            "length": int(np.log2(n + 1)),
        }
        # repetition means little in a short text and much in a long one
        values["distinct x length"] = values["distinct"] * 100 + min(values["length"], 12)
        return [_feature("m", f"{k}:{v}") for k, v in values.items()]

    def words(self, text: str) -> tuple[list[str], np.ndarray]:
        words = text.split()
        memo, make = self.memo, self.word
        found = np.array([memo.get(w) or make(w) for w in words], np.int64)
        return words, np.stack([found >> BITS, found & ((1 << BITS) - 1)], axis=1).reshape(-1)


@dataclass(frozen=True)
class QualityModel:
    grades: tuple[int, ...]
    weights: np.ndarray
    thresholds: np.ndarray

    def latent(self, featurize: Featurizer, text: str | None) -> float:
        text = text or ""
        words, at = featurize.words(text)
        total = self.weights[featurize.measures(text, words)].sum()
        return float(total + (self.weights[at].sum() / len(words) if words else 0.0))

    def grade_probabilities(self, latent: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - latent[:, None], -60, 60)))
        edge = np.zeros((len(latent), 1))
        return np.diff(np.concatenate([edge, below, edge + 1], axis=1), axis=1)


def ordinal_loss(latent: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean minus log-likelihood of the grades ``y``, and its gradients by latent qualities and by thresholds."""
    cut = np.concatenate([[-np.inf], thresholds, [np.inf]])
    up = 1 / (1 + np.exp(-np.clip(cut[y + 1] - latent, -60, 60)))
    low = 1 / (1 + np.exp(-np.clip(cut[y] - latent, -60, 60)))
    p = np.maximum(up - low, 1e-9)
    d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
    by_cut = np.bincount(y + 1, -d_up, len(cut)) + np.bincount(y, d_low, len(cut))
    return float(-np.log(p).mean()), (d_up - d_low) / len(y), by_cut[1:-1] / len(y)


def train(
    rows: list[tuple[np.ndarray, np.ndarray, int]], grades: int, epochs: int = 30, rate: float = 0.3, l2: float = 1e-5
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds, by AdaGrad on the likelihood of the grades."""
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    y = np.array([g for _, _, g in rows])
    share = np.cumsum(np.bincount(y, minlength=grades)[:-1] + 0.5) / (len(y) + 0.5 * grades)
    start = np.log(share / (1 - share))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    free_seen = np.full(len(free), 1e-2)
    sizes = np.array([len(a) for a, _, _ in rows])
    at_all, v_all = np.concatenate([a for a, _, _ in rows]), np.concatenate([v for _, v, _ in rows])
    ends = np.cumsum(sizes)
    rng = np.random.default_rng(9)

    def thresholds(free):
        return np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in np.array_split(order, max(1, len(rows) // 64)):
            n = sizes[part]
            pos = np.repeat(ends[part] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at, v, row = at_all[pos], v_all[pos], np.repeat(np.arange(len(part)), n)
            latent = np.bincount(row, v * w[at], len(part))
            _, g_latent, g_cut = ordinal_loss(latent, y[part], thresholds(free))
            g_free = np.cumsum(g_cut[::-1])[::-1].copy()
            g_free[1:] *= np.exp(free[1:])
            g = np.bincount(at, v * g_latent[row], 1 << BITS) + l2 * w
            hit = np.flatnonzero(g)
            seen[hit] += g[hit] ** 2
            w[hit] -= rate * g[hit] / np.sqrt(seen[hit])
            free_seen += g_free**2
            free = free - 0.1 * rate * g_free / np.sqrt(free_seen)
    return w, thresholds(free)


def fit(docs: DataFrame, ratings: DataFrame, rating: str = "quality", most_docs: int = MOST_DOCS) -> QualityModel:
    """Learn from rated documents of the learning part alone."""
    small_batches(docs.sparkSession)
    usable = ratings.where(~held_out(F.col("doc_id")) & F.col(rating).isNotNull())
    ids = sample_ids(usable.select("doc_id", F.col(rating).cast("int").alias("grade")), most_docs, "grade")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurize = Featurizer()
        for b in batches:
            found = []
            for text in b.column(2).to_pylist():
                words, at = featurize.words(text or "")
                at, n = np.unique(at, return_counts=True)
                extra = np.array(featurize.measures(text or "", words))
                found.append((np.concatenate([at, extra]), np.concatenate([n / max(len(words), 1), np.ones(len(extra))])))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([a.astype(np.int32).tobytes() for a, _ in found], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary()),
                ],
                names=["doc_id", "grade", "at", "v"],
            )

    got = texts.mapInArrow(features, "doc_id long, grade int, at binary, v binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.at))
    grades = tuple(sorted({r.grade for r in got}))
    if len(grades) < 2:
        return QualityModel(grades or (0,), np.zeros(1 << BITS), np.zeros(0))
    rows = [
        (np.frombuffer(r["at"], np.int32), np.frombuffer(r["v"], np.float32), grades.index(r.grade)) for r in got
    ]
    weights, thresholds = train(rows, len(grades))
    return QualityModel(grades, weights, thresholds)


SCORES = T.StructType(
    [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())]
)


def score(docs: DataFrame, model: QualityModel, tail_from: int = 1, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the expected grade, and the probability of a grade of ``tail_from`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, featurize = shared.value, Featurizer()
        grades = np.array(m.grades, float)

        def batch(cols):
            p = m.grade_probabilities(np.array([m.latent(featurize, t) for t in cols[0]], float))
            tail = p[:, grades >= tail_from].sum(axis=1) if len(grades) > 1 else np.ones(len(p))
            return [pa.array(p @ grades, pa.float64()), pa.array(np.clip(tail, 0, 1), pa.float64())]

        return batch

    return map_rows(docs, ["text"], SCORES, make, keep)


def select_good(docs: DataFrame, model: QualityModel, least: float = REJECT_BELOW) -> DataFrame:
    """``docs`` without those whose tail probability is below ``least``."""
    names = [f"`{c}`" for c in docs.columns]
    schema = T.StructType([T.StructField("_quality_tail", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m, featurize = shared.value, Featurizer()
        grades = np.array(m.grades, float)

        def batch(cols):
            p = m.grade_probabilities(np.array([m.latent(featurize, t) for t in cols[0]], float))
            return [pa.array(p[:, grades >= 1].sum(axis=1) if len(grades) > 1 else np.ones(len(p)), pa.float64())]

        return batch

    return map_rows(docs, ["text"], schema, make).where(F.col("_quality_tail") >= least).select(*names)
