"""Encoding and decoding with a piece model, as a weighted finite-state transducer.

Method. Three transducers are compiled from the model file: the normaliser (the
model's table of rewritten character sequences, longest first; blanks taken together
if it says so; a blank before the text; blanks to the blank sign), the pieces (a trie
whose final states emit piece ids), and the byte fallback (a character that no piece
spells emits the pieces of its UTF-8 bytes, or the unknown piece where the model has
none of these). Composed with a text they give a lattice whose states are text
positions together with the piece that ends there; the encoding is its shortest path
in the tropical semiring.

In a model of scored pieces an arc costs minus its piece's score, and the unknown
piece ten more than the dearest piece. Of equally short paths the one whose last
piece begins first is taken; sums are in double precision.

In a model of the merging kind the shortest path by scores alone would be wrong.
There a sequence of pieces is the encoding exactly if each two neighbours are: merging
the text of the two alone gives the two (Berglund and van der Merwe, 2023). So an arc
costs 0 where its piece may follow the last one and infinity where it may not, and
each prefix of a text has one piece that it ends in at finite cost. Whether two pieces
may be neighbours is read from the merges along their common border, each against the
time at which the piece beside it grows.

Where no piece has a blank sign behind another sign, the lattice falls apart at the
blank signs; the shortest path of a part is
found once for all its copies in a batch and remembered for a while.

Cases. A null text has null ids, 0 tokens and decodes to null. An empty text has no
ids. Signs that a text shares with the blank sign come back as blanks, and rewritten
ones as what they became, so that with a model that rewrites nothing only a text
with that sign doesn't make the round trip. Repeated rows are encoded alike, rows
without an id too. An empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, map_rows

#: The usual place of the model file; a parameter everywhere.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
MEMO = 150_000
#: Characters of a group of texts that are encoded together.
GROUP_CHARS = 1_500_000
_PART = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_SCORED, _MERGING = 1, 2
#: Fixed value: what the unknown piece costs beyond the dearest one.
UNKNOWN_COST = 10.0
_NEVER = np.int32(2**30)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of a serialized message's fields."""
    at, end = 0, len(data)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            if n is None:
                n = varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Table:
    """A fixed map from non-negative int64 keys to int32 values, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        size = 1 << max(4, int(np.ceil(np.log2(4 * max(len(keys), 1)))))
        self.shift, self.mask, self.missing = np.uint64(64 - int(np.log2(size))), size - 1, missing
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, missing, np.int32)
        slot = self._slot(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = self.keys[slot[rest]] < 0
            first = np.unique(slot[rest[free]], return_index=True)[1]
            put = rest[free][first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.ones(len(rest), bool)
            left[np.flatnonzero(free)[first]] = False
            rest = rest[left]
            slot[rest] = (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(self.missing))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def rewrites(table: bytes) -> dict[str, str]:
    """The rules of a compiled normaliser: a double-array trie of UTF-8 sequences, and what each becomes.

    Fixed format: the trie's size in bytes, its 32-bit units, then texts that end in a
    zero byte, to whose offsets the leaves point.
    """
    if not table:
        return {}
    size = struct.unpack("<I", table[:4])[0]
    unit = np.frombuffer(table[4 : 4 + size], "<u4").astype(np.int64)
    texts = table[4 + size :]
    label = unit & 0x800000FF
    child = (unit >> 10) << ((unit & 512) >> 6)
    found: dict[str, str] = {}
    letters = np.arange(1, 256)
    open_ = [(int(child[0]), b"")]
    while open_:
        base, key = open_.pop()
        at = base ^ letters
        ok = at < len(unit)
        ok[ok] = label[at[ok]] == letters[ok]
        for c, k in zip(letters[ok].tolist(), at[ok].tolist(), strict=True):
            below = k ^ int(child[k])
            if unit[k] >> 8 & 1:
                start = int(unit[below] & 0x7FFFFFFF)
                try:
                    found[(key + bytes([c])).decode()] = texts[start : texts.index(b"\0", start)].decode()
                except UnicodeDecodeError:  # part of a character: never met in a text
                    pass
            open_.append((below, key + bytes([c])))
    return found


class Normalizer:
    """Text to text, before blanks become blank signs."""

    def __init__(self, rules: dict[str, str], one_blank: bool):
        self.rules, self.one_blank = rules, one_blank
        self.longest: dict[str, int] = {}
        for key in rules:
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))

    def __call__(self, text: str) -> str:
        longest, rules = self.longest, self.rules
        if longest and not longest.keys().isdisjoint(text):
            out, at = [], 0
            while at < len(text):
                for n in range(min(longest.get(text[at], 0), len(text) - at), 0, -1):
                    if (to := rules.get(text[at : at + n])) is not None:
                        out.append(to)
                        at += n
                        break
                else:
                    out.append(text[at])
                    at += 1
            text = "".join(out)
        # blank signs of the text's own are blanks at its end, and there alone
        return re.sub(" +", " ", text).lstrip(" ").rstrip(f" {BLANK}") if self.one_blank else text


class Transducer:
    """The compiled model: tables only, so that it can be broadcast."""

    def __init__(self, path: str):
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    p = dict(_fields(value))
                    score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                    pieces.append((p[1].decode("utf-8"), score, p.get(3, _NORMAL)))
                elif number == 2:
                    trainer = dict(_fields(value))
                elif number == 3:
                    normalizer = dict(_fields(value))
        kind = trainer.get(3, _SCORED)
        if kind not in (_SCORED, _MERGING):
            raise ValueError("only models of scored pieces and of merged ones are supported")
        if not normalizer.get(5, 1) or trainer.get(24, 0) or any(k == _USER for *_, k in pieces):
            raise ValueError("symbols of a user, blanks that stay blanks or that end words are not supported")
        self.normalize = Normalizer(rewrites(normalizer.get(2, b"")), bool(normalizer.get(4, 1)))
        self.plain = not self.normalize.rules and not self.normalize.one_blank
        self.weighted = kind == _SCORED
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == _UNKNOWN), 0)
        self.fallback = bool(trainer.get(35, 0))
        surface = trainer.get(44, " \u2047 ".encode())
        self.bytes = np.full(256, self.unknown, np.int32)
        self.text = []
        for i, (s, _, kind) in enumerate(pieces):
            if kind == _BYTE:
                self.bytes[int(s[3:5], 16)] = i
                self.text.append(bytes([int(s[3:5], 16)]))
            elif kind == _UNKNOWN:
                self.text.append(surface)
            else:
                self.text.append(b"" if kind == 3 else s.replace(BLANK, " ").encode())
        kinds = (_NORMAL,) if self.weighted else (_NORMAL, _UNUSED)
        vocab = {s: i for i, (s, _, kind) in enumerate(pieces) if kind in kinds}
        #: Whether no piece goes on behind a blank sign, so that a text falls apart there.
        self.parted = not any(BLANK in s.lstrip(BLANK) for s in vocab)
        scores = [p[1] for p in pieces]
        if self.weighted:
            self.vocab, self.n = vocab, len(scores)
            self.cost = -np.array(scores, float)
            self.unknown_cost = max((-scores[i] for i in vocab.values()), default=0.0) + UNKNOWN_COST
            self.length = np.zeros(self.n, np.int32)
            for s, i in vocab.items():
                self.length[i] = len(s)
            self._trie(list(vocab))
        else:
            if not self.parted:
                raise ValueError("a merged piece has the blank sign behind another sign")
            self._compile(vocab, scores)

    def _compile(self, vocab: dict[str, int], scores: list[float]) -> None:
        """Ranks of merges, borders of pieces, and the trie."""
        distinct = sorted({scores[i] for i in vocab.values()}, reverse=True)
        rank_of = {s: k for k, s in enumerate(distinct)}
        signs = sorted({c for s in vocab for c in s} - set(vocab))
        self.ids = dict(vocab) | {c: len(scores) + k for k, c in enumerate(signs)}
        self.vocab, self.rank = vocab, {s: rank_of[scores[i]] for s, i in vocab.items()}
        n = len(scores) + len(signs)
        right, left = {}, {}  # the last merge of each piece that merging its text gives
        reachable = []
        for s in vocab:
            if len(s) == 1:
                reachable.append(s)
                continue
            parts, last = self._merge(s)
            if len(parts) == 1:
                reachable.append(s)
                left[s], right[s] = last
        depth = max(map(len, vocab))
        #: Along the last (first) signs of a piece, from the single sign up: symbols, and when each grows.
        self.right, self.left = np.full((n, depth + 1), -1, np.int32), np.full((n, depth + 1), -1, np.int32)
        self.right_grows, self.left_grows = np.full((n, depth + 1), _NEVER, np.int32), np.full((n, depth + 1), _NEVER, np.int32)
        for s in [*reachable, *signs]:
            for part, ids, grows in ((right, self.right, self.right_grows), (left, self.left, self.left_grows)):
                spine = [s]
                while len(spine[-1]) > 1:
                    spine.append(part[spine[-1]])
                spine.reverse()
                row = self.ids[s]
                ids[row, : len(spine)] = [self.ids[x] for x in spine]
                grows[row, : len(spine) - 1] = [self.rank[x] for x in spine[1:]]
        pairs = {}
        for s in vocab:
            for k in range(1, len(s)):
                if s[:k] in self.ids and s[k:] in self.ids:
                    pairs[self.ids[s[:k]] * n + self.ids[s[k:]]] = self.rank[s]
        self.n = n
        self.pairs = Table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)), int(_NEVER))
        self._trie(reachable)
        self.length = np.zeros(n, np.int32)
        for s, i in self.ids.items():
            self.length[i] = len(s)
        # runs of blanks have equal scores: their merges go by place, not by rank
        self.is_run = np.zeros(n, bool)
        for s, i in vocab.items():
            self.is_run[i] = len(s) > 1 and not s.strip(BLANK)
        self.spelled = {i: s for s, i in self.ids.items()}
        self.runs: dict[tuple[int, int], bool] = {}

    def _trie(self, pieces: list[str]) -> None:
        """The trie of ``pieces``, whose final states know their ids."""
        nodes, keys, targets = {"": 0}, [], []
        for s in pieces:
            for k in range(1, len(s) + 1):
                if s[:k] not in nodes:
                    nodes[s[:k]] = len(nodes)
                    keys.append((nodes[s[: k - 1]] << 21) | ord(s[k - 1]))
                    targets.append(nodes[s[:k]])
        self.trie = Table(np.array(keys, np.int64), np.array(targets, np.int32), -1)
        self.final = np.full(len(nodes), -1, np.int32)
        for s in pieces:
            self.final[nodes[s]] = self.vocab[s]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces of a short text by merging best pairs first, and the last pair merged."""
        parts, last = list(text), None
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == _NEVER:
                break
            last = (parts[k], parts[k + 1])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts, last

    def may_follow(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether pieces ``u`` and ``v`` can be neighbours: no merge crosses their border."""
        ok = np.ones(len(u), bool)
        run = self.is_run[u] | self.is_run[v]
        for k in np.flatnonzero(run):
            pair = (int(u[k]), int(v[k]))
            if pair not in self.runs:
                a, b = self.spelled[pair[0]], self.spelled[pair[1]]
                self.runs[pair] = self._merge(a + b)[0] == [a, b]
            ok[k] = self.runs[pair]
        open_ = np.flatnonzero(~run)
        i, j = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        while len(open_):
            a, b, ia, jb = u[open_], v[open_], i[open_], j[open_]
            x, y = self.right[a, ia], self.left[b, jb]
            gx, gy = self.right_grows[a, ia], self.left_grows[b, jb]
            t = self.pairs(x.astype(np.int64) * self.n + y)
            crossed = (t < gx) & (t <= gy) & (t < _NEVER)
            ok[open_[crossed]] = False
            grow_left = gx <= gy
            live = ~crossed & (np.minimum(gx, gy) < _NEVER)
            i[open_[live & grow_left]] += 1
            j[open_[live & ~grow_left]] += 1
            open_ = open_[live]
        return ok


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL) -> Transducer:
    return Transducer(path)


class Encoder:
    """Encodes texts with a transducer; remembers parts and neighbours."""

    SLOTS = 1 << 20

    def __init__(self, model: Transducer):
        self.model = model
        self.memo: dict[str, bytes] = {}
        self.pair_keys = np.full(self.SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(self.SLOTS, bool)

    def _may_follow(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """``may_follow`` behind a table of recent pairs."""
        key = u.astype(np.int64) * self.model.n + v
        slot = ((key * 0x9E3779B1) >> 7) & (self.SLOTS - 1)
        ok = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            found = self.model.may_follow(u[new], v[new])
            ok[new] = found
            self.pair_keys[slot[new]] = key[new]
            self.pair_ok[slot[new]] = found
            same = self.pair_keys[slot[new]] == key[new]  # of two that share a slot, the one that stayed
            self.pair_ok[slot[new[same]]] = found[same]
        return ok

    def shortest_paths(self, parts: list[str]) -> list[bytes]:
        """The ids of each part (normalised text), as packed 32-bit integers.

        Positions are relaxed from left to right in all parts at once; the open
        arcs of a position are walks in the trie that began at or before it.
        """
        m = self.model
        order = sorted(range(len(parts)), key=lambda k: -len(parts[k]))
        text = "".join(parts[k] for k in order)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.array([len(parts[k]) for k in order], np.int64)
        base = np.cumsum(size) - size
        #: The piece that the shortest path to each position ends in (by place of its last sign).
        last = np.full(len(code), -1, np.int32)
        #: What that path costs, in a model of scored pieces.
        path = np.zeros(len(code) if m.weighted else 0)
        at = node = np.zeros(0, np.int64)
        begin = np.zeros(0, np.int64)
        for r in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -r, side="left"))  # parts longer than r
            live = at < n
            at = np.concatenate([at[live], np.arange(n)])
            begin = np.concatenate([begin[live], np.full(n, r)])
            node = np.concatenate([node[live], np.zeros(n, np.int64)])
            sign = code[base[:n] + r]
            node = m.trie((node << 21) | sign[at]).astype(np.int64)
            live = node >= 0
            at, begin, node = at[live], begin[live], node[live]
            piece = m.final[node]
            arc = np.flatnonzero(piece >= 0)
            if m.weighted:
                self._relax(arc, at, begin, piece, base, r, n, last, path)
                continue
            before = np.where(begin[arc] > 0, last[np.maximum(base[at[arc]] + begin[arc] - 1, 0)], -1)
            free = before < 0  # the part's start, or a byte
            ok = free.copy()
            ok[~free] = self._may_follow(before[~free], piece[arc[~free]])
            arc = arc[ok]
            last[base[at[arc]] + r] = piece[arc]
            single = np.full(n, True)
            single[at[arc]] = False
            # no piece ends here: the sign goes out as bytes (marked by its place)
            last[base[:n][single] + r] = -2
        out_part, out_id, out_step = [], [], []
        k, end, step = np.arange(len(size)), base + size - 1, 0
        live = size > 0
        k, end = k[live], end[live]
        while len(k):
            piece = last[end]
            byte = piece < 0
            out_part.append(k)
            out_id.append(np.where(byte, -code[end] - 1, piece))
            out_step.append(np.full(len(k), -step))
            end = end - np.where(byte, 1, m.length[piece])
            go = end >= base[k]
            k, end, step = k[go], end[go], step + 1
        result = [b""] * len(parts)
        if not out_part:
            return result
        part, ids = np.concatenate(out_part), np.concatenate(out_id)
        sort = np.lexsort((np.concatenate(out_step), part))
        part, ids = part[sort], ids[sort]
        edge = np.searchsorted(part, np.arange(len(size) + 1)).tolist()
        packed = np.maximum(ids, 0).astype("<i4").tobytes()
        bytes_in = np.zeros(len(size) + 1, bool)
        bytes_in[part[ids < 0]] = True
        for k, target in enumerate(order):
            if bytes_in[k]:
                spelled = []
                for i in ids[edge[k] : edge[k + 1]].tolist():
                    spelled += [i] if i >= 0 else m.bytes[list(chr(-i - 1).encode("utf-8", "replace"))].tolist() if m.fallback else [m.unknown]
                result[target] = np.array(spelled, "<i4").tobytes()
            else:
                result[target] = packed[4 * edge[k] : 4 * edge[k + 1]]
        return result

    def _relax(self, arc, at, begin, piece, base, r: int, n: int, last: np.ndarray, path: np.ndarray) -> None:
        """The least costs up to position ``r`` of the first ``n`` parts, over the arcs that end there."""
        m = self.model
        spelled = np.zeros(n, bool)
        spelled[at[arc[begin[arc] == r]]] = True
        bare = np.flatnonzero(~spelled)  # no piece is this sign alone: it may be unknown
        upto = lambda k, b: np.where(b > 0, path[np.maximum(base[k] + b - 1, 0)], 0.0)
        where = np.concatenate([at[arc], bare])
        cost = np.concatenate([upto(at[arc], begin[arc]) + m.cost[piece[arc]], upto(bare, np.full(len(bare), r)) + m.unknown_cost])
        what = np.concatenate([piece[arc], np.full(len(bare), -2)])
        first = np.concatenate([begin[arc], np.full(len(bare), r)])
        order = np.lexsort((first, cost, where))
        lead = order[np.unique(where[order], return_index=True)[1]]
        last[base[where[lead]] + r], path[base[where[lead]] + r] = what[lead], cost[lead]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as packed 32-bit integers."""
        if not self.model.plain:
            texts = [self.model.normalize(t) for t in texts]
        split = []
        for t in texts:
            if not self.model.parted:
                split.append(["\0" + (BLANK if self.model.prefix else "") + t.replace(" ", BLANK)] if t else [])
            elif self.model.prefix and t and BLANK not in t and "\0" not in t and "  " not in t and t[0] != " " and t[-1] != " ":
                split.append(t.split(" "))  # a word stands for itself behind a blank
            elif t:
                whole = (BLANK if self.model.prefix else "") + t.replace(" ", BLANK)
                split.append(["\0" + p for p in _PART.findall(whole)])  # marked: as it is
            else:
                split.append([])
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = [w for w in {w for words in split for w in words} if w not in memo]
        parts = [w[1:] if w[:1] == "\0" else BLANK + w for w in new]
        for a, b in chunks(map(len, parts), GROUP_CHARS):
            memo.update(zip(new[a:b], self.shortest_paths(parts[a:b]), strict=True))
        found = [b"".join([memo[w] for w in words]) for words in split]
        return found if self.model.fallback else [self._one_unknown(x) for x in found]

    def _one_unknown(self, packed: bytes) -> bytes:
        """Unknown pieces in a row are one."""
        ids = np.frombuffer(packed, "<i4")
        again = (ids[1:] == self.model.unknown) & (ids[:-1] == self.model.unknown)
        return ids[np.concatenate([[True], ~again])].tobytes() if again.any() else packed


def decode_ids(model: Transducer, ids: np.ndarray) -> str:
    """The text of ids: the inverse transducer's only path."""
    text = model.text
    raw = b"".join([text[i] for i in ids.tolist()])
    if model.prefix and raw[:1] == b" ":
        raw = raw[1:]
    return raw.decode("utf-8", "replace")


IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())])


def encode(docs: DataFrame, model: Transducer | None = None, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` and ``n_tokens``; with ``check`` also ``round_trip``.

    ``round_trip`` tells whether decoding the ids gives the text back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or load())
    schema = T.StructType([*IDS.fields, *([T.StructField("round_trip", T.BooleanType())] if check else [])])

    def make():
        m = shared.value
        encoder = Encoder(m)

        def batch(cols):
            texts = cols[0]
            packed: list[bytes] = []
            for a, b in chunks([len(t or "") for t in texts], GROUP_CHARS):
                packed += encoder.encode([t or "" for t in texts[a:b]])
            n = np.array([len(p) // 4 for p in packed], np.int64)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            null = np.array([t is None for t in texts], bool)
            ids = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(null))
            out = [ids, pa.array(n, pa.int32())]
            if check:
                same = [
                    t is None or decode_ids(m, np.frombuffer(p, "<i4")) == t for t, p in zip(texts, packed, strict=True)
                ]
                out.append(pa.array(same, pa.bool_()))
            return out

        return batch

    return map_rows(docs, ["text"], schema, make, keep)


def decode(rows: DataFrame, model: Transducer | None = None, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with the column ``text`` that their ids spell; null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(model or load())

    def make():
        m = shared.value

        def batch(cols):
            found = [None if x is None else decode_ids(m, np.array([i for i in x if i is not None], np.int64)) for x in cols[0]]
            return [pa.array(found, pa.string())]

        return batch

    return map_rows(rows, [ids], T.StructType([T.StructField("text", T.StringType())]), make, keep)
