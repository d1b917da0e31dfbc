"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Method. From a text come densities of two lexicons (a short built-in list of
insults, and words and word beginnings learned from the labels by the
log-likelihood ratio), their closeness to words of the second person, and rates of
capitals, punctuation, obfuscation (a sign or digit between letters) and drawn-out
letters. Boosted regression trees on the logistic loss give a margin, isotonic
regression (pool adjacent violators) makes it a probability. The lexicon that a
training document's features use is learned from the other half of the sample, and
so are the margins that the calibration is fitted to.

Cases. A null or empty text scores as a text without words. Rows without an id,
or with a null label, are not learned from. Where no labels are there, or only one
class, all scores are the class's share (0 without labels). Repeated rows score
alike. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_rows, materialize, sample_ids, small_batches

#: Labelled documents that the model is fitted on at most.
MOST_DOCS = 8000
#: What a unit of the learned lexicon needs at least: the statistic, and the log odds.
LEAST_STRENGTH, LEAST_ODDS = 18, 2
#: Words kept in a worker's memo; it is emptied when full.
MEMO = 100_000

# Insults and words of the second person.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown "
    "imbecile fool garbage filth vermin creep bastard bitch whore slut asshole dickhead retard "
    "abruti connard salaud merde dummkopf arschloch scheisse schlampe idiota estupido imbecil puta mierda".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton tes vous votre vos "
    "du dich dir dein deine deiner ihr euch usted ustedes ti tus vosotros".split()
)
NEAR = 5
_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES = (3, 4, 5, 6, 7)
_UPPER = bytes(range(65, 91))
_PUNCT = b".,;:!?'\"()-"
_SIGNS = b"@#$%&*^~|<>=+_\\/"
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1
for _c in b"@$*!#%&0123456789":
    _KIND[_c] = 2

FEATURES = (
    "insult_density", "insult_log_count", "learned_density", "learned_log_count", "learned_strongest",
    "learned_weight_density", "second_person_density", "near_second_person_density", "capitals",
    "punctuation", "exclamation", "signs", "obfuscation", "drawn_out", "log_words",
)


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings (with a star)."""
    return [word, *[word[:n] + "*" for n in _PREFIXES if len(word) > n]]


class Featurizer:
    """Features of texts under a lexicon of units and their weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo: dict[str, tuple[int, float]] = {}

    def _word(self, word: str) -> tuple[int, float]:
        """(1 insult | 2 learned | 4 second person, learned weight)"""
        weight = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)
        found = ((word in INSULTS) | 2 * (weight > 0) | 4 * (word in SECOND_PERSON), weight)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found
        return found

    def __call__(self, text: str | None) -> list[float]:
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = _WORD.findall(text.lower())
        n, size = max(len(words), 1), max(len(raw), 1)
        memo = self.memo
        marks = [(k, x) for k, w in enumerate(words) if (x := memo.get(w) or self._word(w))[0]]
        insults = sum(m & 1 for _, (m, _) in marks)
        learned = [w for _, (m, w) in marks if m & 2]
        second = np.array([k for k, (m, _) in marks if m & 4])
        hits = np.array([k for k, (m, _) in marks if m & 3])
        near = 0
        if len(second) and len(hits):
            right = np.searchsorted(second, hits)
            gap = np.minimum(
                np.abs(second[np.minimum(right, len(second) - 1)] - hits),
                np.abs(second[np.maximum(right - 1, 0)] - hits),
            )
            near = int((gap <= NEAR).sum())
        byte = np.frombuffer(raw, np.uint8)
        kind = _KIND[byte]
        hidden = int(((kind[:-2] == 1) & (kind[1:-1] == 2) & (kind[2:] == 1)).sum()) if len(kind) > 2 else 0
        drawn = int(((byte[:-2] == byte[1:-1]) & (byte[1:-1] == byte[2:]) & (kind[2:] == 1)).sum()) if len(kind) > 2 else 0

        def rate(chars: bytes) -> float:
            return (len(raw) - len(raw.translate(None, chars))) / size

        return [
            insults / n, math.log1p(insults), len(learned) / n, math.log1p(len(learned)),
            max(learned, default=0.0), sum(learned) / n, len(second) / n, near / n, rate(_UPPER),
            rate(_PUNCT), rate(b"!?"), rate(_SIGNS), hidden / size, drawn / size, math.log1p(len(words)),
        ]


def strength(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Log-likelihood ratio statistic of a unit, 0 unless toxic documents have it more often."""
    n, total = toxic + clean, all_toxic + all_clean
    if not n or not toxic or toxic * total <= n * all_toxic:
        return 0.0
    g = 0.0
    for k, expected in (
        (toxic, n * all_toxic / total),
        (clean, n * all_clean / total),
        (all_toxic - toxic, all_toxic - n * all_toxic / total),
        (all_clean - clean, all_clean - n * all_clean / total),
    ):
        if k > 0 and expected > 0:
            g += 2 * k * math.log(k / expected)
    return g


def lexicon_of(counts: list[tuple[str, int, int]], all_toxic: int, all_clean: int) -> dict[str, float]:
    """Units that speak for toxicity, with the log odds that they give."""
    ranked = []
    for unit, toxic, clean in counts:
        g = strength(toxic, clean, all_toxic, all_clean)
        odds = math.log((toxic + 0.5) / (clean + 0.5)) - math.log((all_toxic + 1) / (all_clean + 1))
        if g >= LEAST_STRENGTH and odds >= LEAST_ODDS:
            ranked.append((-g, unit, odds))
    return {u: odds for _, u, odds in sorted(ranked)}


@dataclass
class Trees:
    """Boosted trees of depth ``depth``, stored as complete trees over raw thresholds."""

    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, l2: float = 2.0) -> Trees:
    """Gradient boosting with second-order steps on histograms of up to 48 bins."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Trees(base=math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 49)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            gs, hs = g[rows].sum(), h[rows].sum()
            for f, e in enumerate(edges):
                if not len(e) or len(rows) < 10:
                    continue
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
                ok = (hl > 0.5) & (hs - hl > 0.5)
                gain = np.where(ok, gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2), 0)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], cut[at] = gain[k], f, e[k]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
        leaf = np.zeros(inner + 1)
        np.add.at(leaf, node - inner, -g)
        weight = np.bincount(node - inner, h, inner + 1)
        leaf = rate * leaf / (weight + l2)
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
        margin += leaf[node - inner]
    return model


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing fit, to be joined by lines."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, m = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + m]
    return np.array([m / n for _, n, m in blocks]), np.array([s / n for s, n, _ in blocks])


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(features), *self.knots), 0.0, 1.0)


def _unit_counts(sample: DataFrame) -> list:
    """(unit, toxic documents and clean ones of either fold) of units that toxic documents share.

    Copies of one toxic document share all its rare words, which says nothing. So a
    unit must stand between different words in several toxic documents: the pairs of
    its neighbours, a bit each of 64, are told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[tuple[int, str], list[int]] = {}
            for fold, toxic, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                words = ["", *_WORD.findall((text or "").lower()), ""]
                seen: set[str] = set()
                for k in {w: k for k, w in reversed(list(enumerate(words)))}.values():
                    if not words[k]:
                        continue
                    place = 1 << (zlib.crc32(f"{words[k - 1]} {words[k + 1]}".encode("utf-8", "replace")) & 63)
                    for u in units(words[k]):
                        if u not in seen:
                            seen.add(u)
                            found = counts.setdefault((fold, u), [0, 0, 0])
                            found[toxic] += 1
                            found[2] |= place * toxic
            keys, values = list(counts), np.array(list(counts.values()), np.uint64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.string()),
                    pa.array(values[:, 1].astype(np.int64)),
                    pa.array(values[:, 0].astype(np.int64)),
                    pa.array(np.ascontiguousarray(values[:, 2]).view(np.int64)),
                ],
                names=["fold", "unit", "toxic", "clean", "places"],
            )

    schema = "fold int, unit string, toxic long, clean long, places long"
    rows = sample.select("fold", "toxic", "text").mapInArrow(run, schema)
    wide = rows.groupBy("unit").agg(
        *[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("toxic", "clean")],
        F.bit_or("places").alias("places"),
    )
    many = F.bit_count("places") >= F.least(F.lit(20), F.greatest(F.lit(4), (F.col("toxic0") + F.col("toxic1")) / 3))
    return wide.where("toxic0 + toxic1 >= 4 and toxic0 + toxic1 > 0.3 * (clean0 + clean1)").where(many).collect()


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> ToxicityModel:
    """Learn from labelled documents of the learning part alone."""
    small_batches(docs.sparkSession)
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull())
    ids = sample_ids(usable.select("doc_id", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")), most_docs, "toxic")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(2)).cast("int")
    sample = materialize(texts.select("doc_id", fold.alias("fold"), F.col("toxic").cast("int").alias("toxic"), "text"), "labelled")
    totals = {(r.fold, r.toxic): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    n = {(k, t): totals.get((k, t), 0) for k in (0, 1) for t in (0, 1)}
    share = (n[0, 1] + n[1, 1]) / max(sum(n.values()), 1)
    if share in (0.0, 1.0):
        return ToxicityModel({}, Trees(), (np.array([0.0]), np.array([share])))
    counts = _unit_counts(sample)
    lexicons = [lexicon_of([(r.unit, r[f"toxic{k}"], r[f"clean{k}"]) for r in counts], n[k, 1], n[k, 0]) for k in (0, 1)]
    whole = lexicon_of(
        [(r.unit, r.toxic0 + r.toxic1, r.clean0 + r.clean1) for r in counts], n[0, 1] + n[1, 1], n[0, 0] + n[1, 0]
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [Featurizer(lexicons[1]), Featurizer(lexicons[0])]  # of the other half
        for b in batches:
            ids, fold, toxic, text = (c.to_pylist() for c in b.columns)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([of[k](t) for k, t in zip(fold, text, strict=True)], pa.list_(pa.float64()))],
                names=["doc_id", "fold", "toxic", "x"],
            )

    got = sample.mapInArrow(features, "doc_id long, fold int, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r.doc_id, r.x))
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    fold = np.array([r.fold for r in got])
    margin = np.zeros(len(y))
    for k in (0, 1):
        if (fold != k).any() and (fold == k).any():
            margin[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return ToxicityModel(whole, boost(x, y), isotonic(margin, y))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score``, the probability of the label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        featurize = Featurizer(m.lexicon)
        return lambda cols: [pa.array(m.scores(np.array([featurize(t) for t in cols[0]]).reshape(len(cols[0]), -1)), pa.float64())]

    return map_rows(docs, ["text"], T.StructType([T.StructField("score", T.DoubleType())]), make, keep)
