"""Secret scans: known shapes, and character Markov models for the unknown ones.

Method. The base kinds are found by pattern: ``assign`` (a keyword, an operator
and a value of 8 or more characters), ``access`` (AKIA keys of 16 or more) and
``hex`` (32 or more digits); matches run from left to right and don't overlap
within a kind, and those that are too short are dropped after matching. The
method adds spans of kind ``markov``: maximal runs of key characters, of
``least_run`` characters or more, ``least_distinct`` different ones and a digit,
that a character Markov model of random strings explains better than one of
ordinary identifiers. Both models are order-1
transition tables with add-one smoothing, trained from labelled samples; the
decision is the log-likelihood ratio a character. A run that overlaps a base
span is not added. Offsets are code points, ends exclusive; an ``assign`` span
is the whole match.

Cases. A null text counts as empty: no spans, and the SHA-256 of the empty
string. Rows are independent: repeated rows and null ids just stay. An empty
table gives an empty result. Texts of any length are scanned whole. Columns whose
names an output has are replaced, all others are left alone.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, sample_ids

KINDS = ("assign", "access", "hex", "markov")
# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_RUN_CHARS = "[A-Za-z0-9+/_=-]"
#: Characters of a run that the models are asked about, and different ones among them:
#: in fewer, the ratio says too little.
LEAST_RUN, LEAST_DISTINCT = 20, 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mask(chars: str) -> bytes:
    """A translation table: these characters to ``x``, all others to a blank."""
    return bytes(120 if chr(c) in chars else 32 for c in range(256))


_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX_MASK, _RUN_MASK = _mask("0123456789abcdef"), _mask(_ALNUM + "+/_=-")
_SYMBOL = {c: k for k, c in enumerate(_ALNUM + "+/_=-")}
_OTHER = len(_SYMBOL)


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds; ``raw`` is the text in UTF-8."""
    found = []
    low = raw.translate(_LOWER)
    if any(k in low for k in _KEYWORDS):
        found += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN
        ]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if b"x" * LEAST_HEX in raw.translate(_HEX_MASK):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass(frozen=True)
class MarkovModels:
    """Log transition probabilities of random strings less those of ordinary ones."""

    ratio: np.ndarray
    threshold: float
    least_run: int = LEAST_RUN
    least_distinct: int = LEAST_DISTINCT

    def score(self, run: str) -> float:
        """The log-likelihood ratio a character: above 0 speaks for a random string."""
        at = np.array([_OTHER, *[_SYMBOL.get(c, _OTHER) for c in run]])
        return float(self.ratio[at[:-1], at[1:]].sum()) / max(len(run), 1)

    def is_secret(self, run: str) -> bool:
        return (
            len(run) >= self.least_run
            and any(c.isdigit() for c in run)
            and len(set(run)) >= self.least_distinct
            and self.score(run) > self.threshold
        )


def train(samples: Iterable[tuple[str, int]], threshold: float = 0.3) -> MarkovModels:
    """Both models from labelled strings (1: random, 0: ordinary)."""
    counts = np.ones((2, _OTHER + 1, _OTHER + 1))
    for text, label in samples:
        at = [_OTHER, *[_SYMBOL.get(c, _OTHER) for c in text]]
        np.add.at(counts[label], (at[:-1], at[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return MarkovModels(logs[1] - logs[0], threshold)


def labelled_samples(words: Iterable[str], n: int = 4000, seed: int = 5) -> list[tuple[str, int]]:
    """Random strings over the usual key alphabets (1), and identifiers made of ``words`` (0).

    The identifiers are the words alone and joined in the usual ways, some with a
    version or a number.
    """
    rng = random.Random(seed)
    alphabets = [_ALNUM, _ALNUM + "+/", _ALNUM + "_-", "0123456789abcdef", _ALNUM[:26] + "0123456789"]
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 48))), 1) for _ in range(n)]
    words = sorted({w for w in words if w}) or ["value"]
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        style = rng.randint(0, 4)
        text = (
            "_".join(w) if style == 0 else "-".join(w) if style == 1 else "/".join(w) if style == 2
            else "".join(x.capitalize() for x in w) if style == 3 else "_".join(w).upper()
        )
        if rng.random() < 0.3:
            text += rng.choice(["_", "-", ""]) + str(rng.randint(0, 2030))
        out.append((text, 0))
    return out


def fit(docs: DataFrame, most_docs: int = 500, most_words: int = 20_000) -> MarkovModels:
    """Models whose ordinary words come from whole texts of a sample of at most ``most_docs`` documents.

    Of these texts' distinct words, ``most_words`` at most are taken, those of least hash.
    """
    ids = sample_ids(docs, most_docs)
    words = F.explode(F.split(F.lower(F.col("text")), "[^a-z]+"))
    found = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(words.alias("w")).where(F.length("w").between(3, 15)).distinct()
    rows = found.orderBy(F.xxhash64("w", F.lit(13)), "w").limit(most_words).collect()
    return train(labelled_samples(r.w for r in rows))


def scan_text(text: str | None, models: MarkovModels) -> tuple[list, list]:
    """The base spans, and all spans, as (start, kind index, end)."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    base = base_spans(text, raw)
    more = []
    if b"x" * models.least_run in raw.translate(_RUN_MASK):
        for m in re.finditer(f"{_RUN_CHARS}{{{models.least_run},}}", text):
            a, b = m.span()
            if not any(s < b and a < e for s, _, e in base) and models.is_secret(m[0]):
                more.append((a, 3, b))
    return base, sorted(base + more)


def _join(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


REPORT = T.StructType(
    [
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def scan(docs: DataFrame, models: MarkovModels, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``REPORT``: counts, digest and spans of the secrets."""

    def batch(cols):
        rows = []
        for text in cols[0]:
            base, spans = scan_text(text, models)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return [pa.array([r[i] for r in rows], kinds[i]) for i in range(5)]

    return map_rows(docs, ["text"], REPORT, lambda: batch, keep)


def redact(docs: DataFrame, models: MarkovModels, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of each secret, and ``n_chars`` where that column exists.

    Overlapping spans are replaced as one. Texts without a secret stay as they
    are, null included.
    """

    def clean(text):
        spans = scan_text(text, models)[1]
        if not spans:
            return text
        out, at = [], 0
        for a, _, b in spans:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def batch(cols):
        return [pa.array([clean(t) for t in cols[0]], pa.string())]

    out = map_rows(docs, ["text"], T.StructType([T.StructField("text", T.StringType())]), lambda: batch)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), changed).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])
