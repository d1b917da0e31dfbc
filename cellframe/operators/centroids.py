"""Trimmed means of every dimension of groups of vectors: exact, in a few passes, without exploding or sorting vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a task's histograms in all, and values around the trimmed edges that the driver gathers in all.
_BINS, _GATHERED = 1 << 22, 1 << 20


def _flat(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every value that isn't missing, and its place: group times ``width`` plus dimension."""
    lengths = np.nan_to_num(b.column(1).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float) + 0.0  # one zero only
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(b.column(0).to_numpy().astype(np.int64) * width - starts, lengths) + np.arange(len(x))
    good = ~np.isnan(x)
    return (at, x) if good.all() else (at[good], x[good])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    u = np.ascontiguousarray(x, float).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(u >= top, ~u, u | top)


def _histogram(rows: DataFrame, width: int, sides: list[tuple[np.ndarray, ...]], bins: int) -> dict[str, np.ndarray]:
    """(e, bin, n, lo, hi) of the values within each bracket; ``sides`` have lo, hi, first key and shift by place."""
    size = len(sides[0][0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(sides) * size * bins
        n, least, most = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf)
        for b in batches:
            at, x = _flat(b, width)
            for s, (lo, hi, first, shift) in enumerate(sides):
                inside = np.flatnonzero((x >= lo[at]) & (x <= hi[at]))
                a, v = at[inside], x[inside]
                place = (s * size + a) * bins + ((_ordered(v) - first[a]) >> shift[a]).astype(np.int64)
                np.add.at(n, place, 1)
                np.minimum.at(least, place, v)
                np.maximum.at(most, place, v)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k // bins), pa.array((k % bins).astype(np.int32)), pa.array(n[k]), pa.array(least[k]), pa.array(most[k])], names=["e", "bin", "n", "lo", "hi"])

    found = rows.mapInArrow(count, "e long, bin int, n long, lo double, hi double")
    found = found.groupBy("e", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    table = {c: found.column(c).to_numpy() for c in found.column_names}
    order = np.lexsort((table["bin"], table["e"]))
    return {c: v[order] for c, v in table.items()}


def _between(values: np.ndarray, counts: np.ndarray, first: int, last: int) -> float:
    """The sum of the values of ranks ``first`` to ``last``, from 1, of ascending ``values`` that occur ``counts`` times."""
    upto = np.cumsum(counts)
    take = np.minimum(upto, last) - np.maximum(upto - counts, first - 1)
    return float((values[take > 0] * take[take > 0]).sum())


def trimmed_means(rows: DataFrame, groups: int, width: int, trim: float) -> list[tuple[int, int, float | None]]:
    """(group, d, x) for each dimension with values: the mean without the ``floor(trim * n)`` least and greatest of them.

    ``rows`` are (group from 0, vec), read anew in each pass. Histograms over brackets
    in the order of doubles, each a bin of the one before, close in on both edges, until
    few values or a single one lie around each; these are gathered, and what is between is summed.
    """
    size = groups * width
    if not size:
        return []
    bins = 1 << int(np.clip(np.log2(_BINS // (2 * size)) if 2 * size <= _BINS else 1, 1, 10))
    limit = max(64, _GATHERED // (2 * size))
    sides = [(np.full(size, -np.inf), np.full(size, np.inf), np.zeros(size, np.uint64), np.full(size, 64 - (bins.bit_length() - 1), np.uint64))]
    total = cut = None
    rank = under = inside = low = high = None
    while sides:
        h = _histogram(rows, width, sides, bins)
        if total is None:
            total = np.bincount(h["e"], h["n"], size).astype(np.int64)
            cut = np.floor(trim * total).astype(np.int64)
            rank = [np.minimum(cut + 1, total), np.maximum(total - cut, 1)]
            under, inside = ([np.zeros(size, np.int64) for _ in rank] for _ in range(2))
            low, high = ([np.full(size, np.inf * sign) for _ in rank] for sign in (1, -1))
            asked = [(s, np.flatnonzero(total)) for s in (0, 1)]
            shared = True
        starts = np.searchsorted(h["e"], np.arange(len(sides) * size + 1))
        for s, places in asked:
            for p in places:
                e = p if shared else s * size + p
                a, b = starts[e], starts[e + 1]
                upto = np.cumsum(h["n"][a:b]) + under[s][p]
                k = int(np.searchsorted(upto, rank[s][p]))
                under[s][p], inside[s][p] = upto[k] - h["n"][a + k], h["n"][a + k]
                low[s][p], high[s][p] = h["lo"][a + k], h["hi"][a + k]
        asked = [(s, np.flatnonzero((inside[s] > limit) & (low[s] < high[s]))) for s in (0, 1)]
        sides, shared = [], False
        if any(len(places) for _, places in asked):
            for s, places in asked:
                lo, hi, first, shift = np.full(size, np.inf), np.full(size, -np.inf), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
                lo[places], hi[places] = low[s][places], high[s][places]
                first[places] = _ordered(lo[places])
                span = _ordered(hi[places]) - first[places]
                shift[places] = [max(int(v).bit_length() - (bins.bit_length() - 1), 0) for v in span]
                sides.append((lo, hi, first, shift))

    same = low[0] == low[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        found: dict[int, list[np.ndarray]] = {0: [], 1: []}
        for b in batches:
            at, x = _flat(b, width)
            mid = (x > high[0][at]) & (x < low[1][at])
            np.add.at(sums, at[mid], x[mid])
            for s in (0, 1):
                wanted = (low[s] < high[s]) & ~(same & (s == 1))
                near = wanted[at] & (x >= low[s][at]) & (x <= high[s][at])
                if near.any():
                    found[s].append(np.rec.fromarrays([at[near] + s * size, x[near]], names="e,x"))
        kept = [v for parts in found.values() for v in parts]
        values, n = np.unique(np.concatenate(kept), return_counts=True) if kept else (np.rec.fromarrays([np.zeros(0, np.int64), np.zeros(0)], names="e,x"), np.zeros(0, np.int64))
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([values["e"], -1 - k])), pa.array(np.concatenate([values["x"], np.zeros(len(k))])), pa.array(np.concatenate([n, np.zeros(len(k), np.int64)])), pa.array(np.concatenate([np.zeros(len(n)), sums[k]]))],
            names=["e", "x", "n", "s"],
        )

    # a negative place has the sum of what is between
    found = rows.mapInArrow(gather, "e long, x double, n long, s double").groupBy("e", "x").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    e, x, n, sums = (found.column(c).to_numpy() for c in ("e", "x", "n", "s"))
    between = np.zeros(size)
    between[-1 - e[e < 0]] = sums[e < 0]
    order = np.lexsort((x[e >= 0], e[e >= 0]))
    e, x, n = (v[e >= 0][order] for v in (e, x, n))
    starts = np.searchsorted(e, np.arange(2 * size + 1))

    def values(s: int, p: int) -> tuple[np.ndarray, np.ndarray]:
        if low[s][p] == high[s][p]:
            return np.array([low[s][p]]), np.array([inside[s][p]])
        k = p if same[p] else s * size + p
        return x[starts[k] : starts[k + 1]], n[starts[k] : starts[k + 1]]

    out = []
    for p in np.flatnonzero(total):
        first, last = (int(rank[s][p] - under[s][p]) for s in (0, 1))
        one, two = values(0, p), values(1, p)
        least, most = (v[np.searchsorted(np.cumsum(c), r)] for (v, c), r in ((one, first), (two, last)))
        if least == most:
            mean = float(least)
        elif total[p] <= 2 * cut[p]:
            mean = None
        else:
            whole = _between(*one, first, last) if same[p] else _between(*one, first, int(inside[0][p])) + between[p] + _between(*two, 1, last)
            mean = float(whole / (total[p] - 2 * cut[p]))
        out.append((int(p // width), int(p % width), mean))
    return out
