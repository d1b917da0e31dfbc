"""Links between rows: joins whose keys may be hot, and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import discard, settled

#: A key's rows meet in one task up to this many, however small the partitions are.
LEAST_HOT = 128
#: Links (16 bytes each) that one task settles; more go through rounds of stars.
MOST_IN_TASK = 200_000
#: Links that a task contracts at a time.
_CHUNK = 1_000_000
#: Alternations after which the steps stop; the method needs O(log² n).
MOST_ROUNDS = 60


def join_hot(rows: DataFrame, one: DataFrame, key: str, total: int, least: int = LEAST_HOT) -> DataFrame:
    """``rows`` joined with ``one``, which has one row a key and ``n``, the key's rows in ``rows``.

    No key's rows have to meet in one task: those of a hot key (more than four times
    an even partition of the ``total`` rows) find its row of ``one`` by a broadcast of
    the hot keys alone, at most a quarter as many as there are partitions. ``n`` is
    dropped. Rows whose key is null or not in ``one`` are, too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(least, math.ceil(4 * total / parts))
    if total <= bound:  # no key can have more
        return rows.join(one.drop("n"), key)
    hot = one.where(F.col("n") > bound).drop("n")
    even = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col("n") <= bound).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(even)


def roots_of_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0..n-1 the least member of its component under the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over links: a link from each node to the least of those that this task's links reach."""

    def stars(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([b.column(k).to_numpy() for b in kept]) for k in (0, 1)]
        nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
        root = roots_of_pairs(len(nodes), at[: len(ends[0])], at[len(ends[0]) :])
        out = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], names=["u", "v"])

    kept, n = [], 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            n += b.num_rows
        if n >= _CHUNK:
            yield stars(kept)
            kept, n = [], 0
    if kept:
        yield stars(kept)


def components(links: DataFrame, src: str = "src", dst: str = "dst", most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """(node, root) for each node of ``links`` (whole numbers): root is the smallest node reachable.

    Each task first contracts its own links to stars, so that no more than a link for
    each of its nodes is left. Up to ``most_in_task`` of these are settled by one
    task; more by alternating large-star and small-star steps (Kiveris et al., 2014),
    where a node with very many links costs no task its whole list: minima are
    partial aggregates, and those of the few hot nodes are handed back by a broadcast
    (``join_hot``). Links with a null end and loops are left out. An empty table gives
    an empty result.
    """
    spark = links.sparkSession
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    real = links.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(a.alias("u"), b.alias("v")).where("u != v")
    edges, path = settled(real.mapInArrow(_contract, "u long, v long"), "links", True)
    n = edges.count()
    if n <= min(most_in_task, _CHUNK):
        edges = edges.coalesce(1).mapInArrow(_contract, "u long, v long")
    else:
        before = _mark(edges)
        for _ in range(MOST_ROUNDS):
            moved = _small_star(_large_star(edges, before[0]), before[0]).mapInArrow(_contract, "u long, v long")
            edges, new = settled(moved, "stars", True)
            discard(spark, path)
            path, now = new, _mark(edges)
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("connected components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = settled(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), "roots")
    discard(spark, path)
    return found


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum: alike before and after means settled."""
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.sum(h % 1_000_003), F.bit_xor(h)).first()
    return tuple(row)


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each larger neighbour of a node gets the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.when(F.col("v") > F.col("u"), 1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return join_hot(both.where("v > u"), least, "u", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Each node's smaller neighbours, and the node, get the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(edges, least, "u", n_edges).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
