"""Substring dedup: near-duplicate paragraphs by MinHash banding, and repeated passages inside them.

Method. A paragraph is a line (words are lower-cased runs of non-blanks). The word
5-grams of one of at least ``LEAST_WORDS`` words are hashed, ``BANDS`` x ``ROWS``
MinHash values are taken of them, and paragraphs that agree on a whole band are
candidates. With 9 bands of 4 values a pair of Jaccard similarity 0.8 is found with
probability 0.991, one of 0.9 with 0.9999. A shorter paragraph, down to
``least_words``, is looked for as a whole: all its exact copies are found. Each candidate pair is verified by the exact Jaccard
similarity of the 5-gram sets, and verified links are clustered by components; a
cluster keeps its first occurrence (smallest doc_id, then place).

Within a band each paragraph is first compared with the band's least one only;
that settles bands whose members are all alike, however many. Then members of one
band that are still in different components are compared with one another within
tasks, large bands in pairs of shards: first by their MinHash values (at least
``AGREE`` of 36; a pair of similarity 0.8 has fewer once in 100,000 times), then
exactly, and what leaves a task is one link for each merge, never all pairs.

A passage that repeats inside longer paragraphs is found by winnowing: of every
``SLIDE`` consecutive windows of ``WINDOW`` words the one with the least hash is
recorded, so that two documents which share a run of ``WINDOW + SLIDE - 1`` words
(51) or more share a recorded window. Each passage of such windows is extended
word by word, to the left and right, until it differs from the cluster's first.

Cases. Null and empty texts have no words and give no row. Rows without an id are
not looked at. A repeated row counts as another occurrence in the same document,
and a cluster counts only if it spans two document ids. An empty table gives an
empty result. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core import discard, settled
from ..links import components, join_hot
from .blocks import deal, group_starts
from .common import map_rows, materialize, small_batches, tidy_shuffles

#: Words of a paragraph that takes part in the banding.
LEAST_WORDS = 50
#: Words of a paragraph whose exact copies are repeats; below, the same words are
#: rather a heading, a list item or a greeting than a passage.
LEAST_EXACT = 20
SHINGLE = 5
BANDS, ROWS = 9, 4
SIMILARITY = 0.8
WINDOW, SLIDE = 30, 22
#: MinHash values in which two paragraphs agree before they are compared exactly.
AGREE = 19
#: Members of a band that one task compares with one another, twice at most.
SHARD = 1000
MEMO = 150_000
#: Paragraph hashes that may be broadcast; more go through a shuffled join.
BROADCAST_HASHES = 500_000

_K = np.uint64(0x9E3779B97F4A7C15)
_K_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_A = np.random.default_rng(41).integers(0, 2**31, BANDS * ROWS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(43).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def run_hashes(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    n = len(w)
    if n < size:
        return np.zeros(0, np.uint64)
    down = np.cumprod(np.full(n, _K_INVERSE), dtype=np.uint64)
    up = np.cumprod(np.full(n, _K), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * down, dtype=np.uint64)])
    return _mix((sums[size:] - sums[:-size]) * up[: n - size + 1])


def winnow(h: np.ndarray, slide: int = SLIDE) -> np.ndarray:
    """Places of the least hash of every ``slide`` consecutive ones (of equal ones the first).

    Where a text repeats itself, so that equal hashes follow one another, one in
    ``slide`` places is enough.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= slide:
        return np.array([int(h.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(h, slide)
    at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    new = np.ones(len(at), bool)
    new[1:] = h[at[1:]] != h[at[:-1]]
    step = (at - np.maximum.accumulate(np.where(new, at, 0))) // slide
    new[1:] |= step[1:] != step[:-1]
    return at[new]


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS * ROWS) MinHash values of 32-bit shingles."""
    least = np.empty((len(starts), BANDS * ROWS), np.uint32)
    for i in range(BANDS * ROWS):
        y = shingles * _A[i] + _B[i]
        y ^= y >> np.uint32(15)
        least[:, i] = np.minimum.reduceat(y * np.uint32(2246822519), starts)
    return least


def minhash(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) band keys; paragraph k's shingles begin at ``starts[k]``."""
    least = signatures(shingles, starts)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(starts), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = _mix(key * _K + least[:, i])
        keys[:, b] = key
    return keys.view(np.int64)


def _scan(least_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows of paragraphs (with bands and shingles; short ones without) and of recorded windows."""
    memo: dict[str, int] = {}

    def word_hashes(words: list[str]) -> np.ndarray:
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words):
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "replace"))
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    for batch in batches:
        doc, start, end, hashes = [], [], [], []
        shingles, sizes = [], []
        window_doc, window_at, window_hash = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = [x.split() for x in (text or "").lower().split("\n")]
            n = sum(map(len, lines))
            if n < min(WINDOW, least_words):
                continue
            w = word_hashes(list(itertools.chain.from_iterable(lines)))
            if n >= WINDOW:
                grams = run_hashes(w, SHINGLE)
                windows = run_hashes(w, WINDOW)
                at = winnow(windows)
                window_doc.append(np.full(len(at), doc_id))
                window_at.append(at)
                window_hash.append(windows[at])
            low = 0
            for line in lines:
                high = low + len(line)
                if len(line) >= least_words:
                    doc.append(doc_id)
                    start.append(low)
                    end.append(high)
                    hashes.append(xxhash.xxh64_intdigest(w[low:high].tobytes()))
                    if len(line) >= LEAST_WORDS:
                        s = np.unique((grams[low : high - SHINGLE + 1] >> np.uint64(32)).astype(np.uint32))
                    else:
                        s = np.zeros(0, np.uint32)
                    shingles.append(s)
                    sizes.append(len(s))
                low = high
        if doc:
            flat = np.concatenate(shingles)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            banded = np.array(sizes) > 0
            keys = minhash(flat, offsets[:-1][banded]) if banded.any() else np.zeros((0, BANDS), np.int64)
            edges = np.concatenate([[0], np.cumsum(BANDS * banded)])
            yield _rows(
                doc, start, end, np.array(hashes, np.uint64).view(np.int64),
                pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(keys.ravel())),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int32))),
            )
        if window_doc:
            at = np.concatenate(window_at)
            none = pa.nulls(len(at), pa.list_(pa.int64())), pa.nulls(len(at), pa.list_(pa.int32()))
            yield _rows(np.concatenate(window_doc), at, at + WINDOW, np.concatenate(window_hash).view(np.int64), *none)


def _rows(doc, start, end, h, bands, shingles) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(h, pa.int64()), bands, shingles],
        names=["doc_id", "start", "end", "h", "bands", "shingles"],
    )


_SCHEMA = "doc_id long, start int, end int, h long, bands array<long>, shingles array<int>"


def jaccard(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose shingle sets are similar enough."""
    left = sets.select(F.col("h").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("h").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= F.lit(least) * (F.size("sa") + F.size("sb") - common)).select(
        F.col("a").alias("src"), F.col("b").alias("dst")
    )


def _settle(similarity: float):
    """For mapInArrow over dealt rows: links that merge components, one for each merge."""

    def merges(h, c, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
        signs = signatures(np.concatenate(sets), starts)
        _, label = np.unique(c, return_inverse=True)
        root = np.arange(label.max() + 1)
        made: dict[int, set] = {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def members(k: int) -> set:
            if k not in made:
                made[k] = set(sets[k].tolist())
            return made[k]

        src, dst = [], []
        for a in range(len(h) - 1):
            flat = root[root]
            while (flat != root).any():
                root[:] = flat
                flat = root[root]
            apart = np.flatnonzero(root[label[a + 1 :]] != root[label[a]]) + a + 1
            if not len(apart):
                continue
            for b in apart[(signs[apart] == signs[a]).sum(axis=1) >= AGREE].tolist():
                ra, rb = find(label[a]), find(label[b])
                if ra == rb:
                    continue
                common = len(members(a) & members(b))
                if common >= similarity * (len(members(a)) + len(members(b)) - common):
                    root[max(ra, rb)] = min(ra, rb)
                    src.append(int(h[a]))
                    dst.append(int(h[b]))
        return src, dst

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list | None = None

        def settle(cols) -> pa.RecordBatch:
            bucket, i, j, h, c, sets = cols
            starts = group_starts(bucket, i, j).tolist()
            src, dst = [], []
            for s, e in zip(starts, [*starts[1:], len(h)], strict=True):
                if e - s > 1 and (c[s:e] != c[s]).any():
                    x, y = merges(h[s:e], c[s:e], sets[s:e])
                    src += x
                    dst += y
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            lists = batch.column(5)
            values, edges = lists.flatten().to_numpy().view(np.uint32), np.cumsum([0, *lists.value_lengths().to_pylist()])
            cols = [*flat, [values[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]]
            if rest is not None:
                cols = [*[np.concatenate(z) for z in zip(rest[:5], flat, strict=True)], rest[5] + cols[5]]
            last = int(group_starts(*cols[:3])[-1])
            if last >= 2_000:
                yield settle([z[:last] for z in cols])
                cols = [z[last:] for z in cols]
            rest = cols
        if rest is not None:
            yield settle(rest)

    return run


def link_paragraphs(paragraphs: DataFrame, similarity: float = SIMILARITY, candidates: DataFrame | None = None) -> DataFrame:
    """(node, root) of paragraph hashes that verified links connect.

    ``paragraphs`` has ``h``, ``bands`` and ``shingles`` (rows of one ``h`` are alike);
    ``candidates`` (a, b), written already, are pairs to verify beside those of the bands.
    """
    # copies of a paragraph are one row, so that only unlike ones can make a band hot
    keys = materialize(paragraphs.select("h", F.explode("bands").alias("key")).distinct(), "bands")
    full = keys.groupBy("key").agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1")
    full = materialize(full, "full")
    total = _rows_of(full)
    live = join_hot(keys, full, "key", total).where("h != least")
    live = materialize(live.select("key", "h", "least"), "bands")
    first = live.select(F.col("h").alias("a"), F.col("least").alias("b"))
    first = (first if candidates is None else first.unionByName(candidates.select("a", "b"))).distinct()
    first = materialize(first, "pairs")
    wanted = materialize(first.select(F.col("a").alias("h")).union(first.select("b")).distinct(), "candidates")
    if wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES:
        wanted = F.broadcast(wanted)
    sets = materialize(
        paragraphs.select("h", "shingles").join(wanted, "h", "left_semi").dropDuplicates(["h"]), "sets"
    )
    links = materialize(jaccard(first, sets, similarity), "links")
    found = components(links)
    # bands whose members, each compared with the least one by now, are still in different components
    named = live.join(found, live.h == found.node, "left").select("key", "h", F.coalesce("root", "h").alias("c"))
    apart = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
    apart = materialize(apart.where("low != high").select("key", "n"), "apart")
    if apart.isEmpty():
        return found
    open_ = join_hot(named, apart, "key", _rows_of(apart))
    rows = materialize(open_.select(F.col("key").alias("bucket"), "h", "c"), "open")
    dealt = deal(rows, "h", most=SHARD, times=2, carry=sets).select("bucket", "i", "j", "h", "c", "shingles")
    more = materialize(dealt.mapInArrow(_settle(similarity), "src long, dst long"), "links")
    if more.isEmpty():
        return found
    return components(links.unionByName(more))


def find_repeats(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_EXACT) -> DataFrame:
    """A row for each occurrence of a repeated paragraph (of ``least_words`` or more) or passage.

    (doc_id, unit, start_word, end_word, cluster_doc, cluster_start, kept): the
    words are numbered from 0 in the whole text, the end is exclusive; the cluster
    is named by its first occurrence, the one that is kept. Of repeated passages
    within paragraphs, those in the cluster's first document are kept. Shuffle files
    go with the job that made them, units before the texts are shuffled for the
    ends of passages.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    with tidy_shuffles(spark):
        rows, rows_at = settled(source.mapInArrow(functools.partial(_scan, least_words), _SCHEMA), "units", True)
        out = materialize(_repeated_paragraphs(rows.where("bands is not null"), similarity), "repeats")
        shared = materialize(_repeated_windows(rows.where("bands is null")), "passages")
        discard(spark, rows_at)
        far = _reach(shared, source)
    return out.unionByName(_extended(shared, far))


def _repeated_paragraphs(paragraphs: DataFrame, similarity: float) -> DataFrame:
    """Occurrences of paragraphs that repeat in another document, by their clusters."""
    found = link_paragraphs(paragraphs, similarity)
    place = F.struct("doc_id", "start")
    classes = paragraphs.groupBy("h").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows"))
    named = classes.join(found, classes.h == found.node, "left").select("h", "first", "last", "rows", F.coalesce("root", "h").alias("root"))
    named = materialize(named, "paragraphs")
    clusters = named.groupBy("root").agg(F.min("first").alias("cluster"), F.max("last").alias("last"), F.count("*").alias("n"))
    clusters = clusters.where(F.col("cluster.doc_id") != F.col("last")).select("root", "cluster", "n")
    names = join_hot(named.select("h", "root", "rows"), clusters, "root", named.count())
    names = materialize(names.select("h", "cluster", F.col("rows").alias("n")), "names")
    again = join_hot(paragraphs.select("doc_id", "start", "end", "h"), names, "h", _rows_of(names))
    return again.select(
        "doc_id", F.lit("paragraph").alias("unit"), F.col("start").alias("start_word"), F.col("end").alias("end_word"),
        F.col("cluster.doc_id").alias("cluster_doc"), F.col("cluster.start").alias("cluster_start"),
        F.col("cluster").eqNullSafe(F.struct("doc_id", "start")).alias("kept"),
    )


def _rows_of(names: DataFrame) -> int:
    return names.agg(F.sum("n")).first()[0] or 0


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (doc_id, text, places): the word hashes before (nearest first) and after each place."""
    near = SLIDE - 1
    for batch in batches:
        doc, at, before, after = [], [], [], []
        for doc_id, text, places in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            w = text.lower().split()
            for k in places:
                doc.append(doc_id)
                at.append(k)
                for out, words in ((before, w[max(k - near, 0) : k][::-1]), (after, w[k : k + near])):
                    out.append(np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in words], np.uint64).view(np.int64))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(before, kind), pa.array(after, kind)],
            names=["doc_id", "at", "before", "after"],
        )


_PASSAGE = ["doc_id", "cluster_doc", "passage"]
_SIDES = [("left", "start", "first"), ("right", "end", "last")]


def _reach(passages: DataFrame, source: DataFrame) -> DataFrame:
    """Words by which the match of each copy of ``passages`` (materialized) goes on at each side of its windows.

    A run of ``WINDOW + SLIDE - 1`` shared words has a recorded window, so that no
    more than ``SLIDE - 1`` words are left at either side.
    """
    spark = passages.sparkSession
    place = lambda doc, at: F.struct(F.col(doc).alias("doc_id"), F.col(at).cast("int").alias("at"))
    copies = passages.where("doc_id != cluster_doc")
    ends = [copies.select(*_PASSAGE, F.lit(s).alias("side"), place("doc_id", x).alias("a"), place("cluster_doc", y).alias("b")) for s, x, y in _SIDES]
    ends, ends_at = settled(ends[0].unionByName(ends[1]), "ends", True)
    asked = ends.select("a.*").union(ends.select("b.*")).groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    found = source.join(asked, "doc_id").mapInArrow(_edges, "doc_id long, at int, before array<long>, after array<long>")
    # rows of one id with different texts have no words of their own at a place
    words = F.struct("before", "after")
    found = found.groupBy("doc_id", "at").agg(F.min(words).alias("w"), F.max(words).alias("x")).where("w = x")
    found, found_at = settled(found.select(F.struct("doc_id", "at").alias("b"), "w"), "edges", True)
    counts = ends.groupBy("b").agg(F.count("*").alias("n"))
    both = join_hot(ends, found.join(counts, "b"), "b", ends.count()).withColumnRenamed("w", "wb")
    both = both.join(found.select(F.col("b").alias("a"), F.col("w").alias("wa")), "a")

    def common(side: str):
        same = F.zip_with(f"wa.{side}", f"wb.{side}", lambda x, y: x.eqNullSafe(y))
        differs = F.array_position(same, False)
        return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("int")

    far = both.select(*_PASSAGE, "b", "side", F.when(F.col("side") == "left", common("before")).otherwise(common("after")).alias("far"))
    far = materialize(far, "far")
    for path in (ends_at, found_at):
        discard(spark, path)
    return far


def _extended(passages: DataFrame, far: DataFrame) -> DataFrame:
    """Occurrences of ``passages`` to the ends of their matches. What is kept goes as far as its farthest copy."""
    own = far.groupBy(*_PASSAGE).agg(*[F.max(F.when(F.col("side") == s, F.col("far"))).alias(s) for s, _, _ in _SIDES])
    out = passages.where("doc_id != cluster_doc").join(own, _PASSAGE, "left")
    firsts = passages.where("doc_id = cluster_doc")
    for s, x, _ in _SIDES:
        most = far.where(F.col("side") == s).groupBy(F.col("b.doc_id").alias("doc_id"), F.col("b.at").alias(x)).agg(F.max("far").alias(s))
        firsts = firsts.join(most, ["doc_id", x], "left")
    out = out.unionByName(firsts)
    out = out.withColumn("left", F.coalesce("left", F.lit(0))).withColumn("right", F.coalesce("right", F.lit(0)))
    return out.select(
        "doc_id", F.lit("passage").alias("unit"), (F.col("start") - F.col("left")).alias("start_word"),
        (F.col("end") + F.col("right")).alias("end_word"), "cluster_doc", (F.col("first") - F.col("left")).alias("cluster_start"),
        (F.col("doc_id") == F.col("cluster_doc")).alias("kept"),
    )


def _repeated_windows(windows: DataFrame) -> DataFrame:
    """Windows that two documents share, overlapping ones of a document joined to passages."""
    windows = windows.select("doc_id", "start", "end", "h")
    seen = windows.groupBy("h").agg(
        F.min(F.struct("doc_id", "start")).alias("cluster"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    )
    seen = materialize(seen.where(F.col("cluster.doc_id") != F.col("last")).select("h", "cluster", "n"), "seen")
    again = join_hot(windows, seen, "h", _rows_of(seen)).select(
        "doc_id", "start", "end", F.col("cluster.doc_id").alias("cluster_doc"),
        F.col("cluster.start").alias("first"),
    )
    keys = ["doc_id", "cluster_doc"]
    w = Window.partitionBy(*keys).orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = again.withColumn("new", F.coalesce(F.col("start") > far, F.lit(True)).cast("int"))
    marked = marked.withColumn("passage", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "first"))["first"].alias("first"),
        (F.max(F.struct("end", "first"))["first"] + WINDOW).alias("last"),
    )


def _without(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """``text`` without the words of ``spans``; lines that stay whole keep their form."""
    if text is None or not spans:
        return text
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, low, at = [], 0, 0
    for line in text.split("\n"):
        words = line.split()
        high = low + len(words)
        while at < len(merged) and merged[at][1] <= low:
            at += 1
        keep, k, place = [], at, low
        while k < len(merged) and merged[k][0] < high:
            keep += words[place - low : max(merged[k][0], low) - low]
            place = min(merged[k][1], high)
            k += 1
        if place == low:
            out.append(line)
        else:
            keep += words[place - low :]
            if keep:
                out.append(" ".join(keep))
        low = high
    return "\n".join(out)


def remove_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` without the words of occurrences that are not kept.

    Paragraphs that stay whole keep their form; in others the remaining words are
    joined by single blanks. Null texts, rows without an id and texts without such an
    occurrence stay as they are; rows that share an id are cut alike. Words are those
    of the text as it was scanned. Other columns stay, whatever their names.
    """
    gone = repeats.where(~F.col("kept")).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.collect_set(F.struct("start_word", "end_word")).alias("spans")
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    both = docs.select(row).join(gone, F.col("row.doc_id") == F.col("id"), "left").select("row", F.col("row.text").alias("text"), "spans")

    def make():
        def batch(cols):
            spans = [[(s["start_word"], s["end_word"]) for s in x or ()] for x in cols[1]]
            return [pa.array([_without(t, s) for t, s in zip(cols[0], spans, strict=True)], pa.string())]

        return batch

    cut = map_rows(both, ["text", "spans"], T.StructType([T.StructField("cut", T.StringType())]), make, keep=["row"])
    return cut.select(*[F.col("cut").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
