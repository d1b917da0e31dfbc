"""Embedding near-duplicates: cross-polytope hashing with verified candidate pairs.

Method (Andoni et al., 2015). A vector is rotated by three rounds of random signs
and a fast Hadamard transform; its hash is the axis, with sign, on which its
largest component lies. ``k`` such hashes make a bucket of one table, and a vector
also probes the buckets that its second-largest components name, nearest first.
Vectors that meet in a bucket are compared by cosine in double precision, and a
pair is counted in the first bucket only that the two share, so that it counts
once. ``k`` follows the number of vectors, so that buckets stay small; the number
of tables follows from the wanted recall at the threshold, estimated on random
pairs of exactly that cosine.

Exact copies are one class and are hashed once. What leaves a task is a count for
each vector and a link for each merged one, never all pairs.

Cases. A vector that is null, empty, zero, or holds a null or a non-finite
component links with nothing, copies of itself included, and is its own
component; so does a row without an id, whose component is null. Vectors of
different lengths don't link. Rows that repeat an id are one vector in links and
components: their links add up, and copies under one id don't count. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..links import components, roots_of_pairs
from .blocks import deal, group_starts
from .common import materialize, small_batches

PROBES = 3
#: Tables beyond which near-duplicates are refused, for a vector is in ``PROBES`` buckets of each.
MOST_TABLES = 100
#: A shard has at most so many times the rows of an even partition, a group two shards.
SHARD_TIMES = 1


def rotation_signs(d: int, n: int, seed: int) -> np.ndarray:
    """Random signs of ``n`` rotations of three rounds, for padded dimension ``d``."""
    return np.random.default_rng(seed).integers(0, 2, (n, 3, d)) * 2.0 - 1.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform along the last axis (a power of two)."""
    d, h = x.shape[-1], 1
    while h < d:
        y = x.reshape(*x.shape[:-1], d // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / math.sqrt(d)


def bucket_keys(x: np.ndarray, signs: np.ndarray, k: int) -> np.ndarray:
    """(rows, tables, PROBES) bucket numbers of unit vectors ``x``, nearest first."""
    d = signs.shape[-1]
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    tables = len(signs) // k
    out = np.zeros((len(x), tables, PROBES), np.int64)
    rows = np.arange(len(x))
    for t in range(tables):
        first, second, loss = [], [], []
        for r in signs[t * k : (t + 1) * k]:
            y = x
            for s in r:
                y = hadamard(y * s)
            size = np.abs(y)
            best = size.argmax(axis=1)
            top = size[rows, best]
            size[rows, best] = -1
            next_best = size.argmax(axis=1)
            first.append(2 * best + (y[rows, best] < 0))
            second.append(2 * next_best + (y[rows, next_best] < 0))
            loss.append(top - size[rows, next_best])
        first, second, loss = np.array(first), np.array(second), np.array(loss)
        weight = (2 * d) ** np.arange(k, dtype=np.int64)
        home = weight @ first
        out[:, t, 0] = home
        nearest = np.argsort(loss, axis=0, kind="stable")
        for p in range(1, PROBES):  # one hash at a time takes its second choice
            if p <= k:
                h = nearest[p - 1]
                out[:, t, p] = home + weight[h] * (second[h, rows] - first[h, rows])
            else:
                out[:, t, p] = weight @ second
    return out


def table_plan(d: int, n: int, threshold: float, recall: float, seed: int) -> tuple[int, np.ndarray]:
    """Hashes a table, and the rotations of all tables, for ``n`` vectors of length ``d``."""
    padded = 1 << max(1, (d - 1).bit_length())
    k = max(1, min(6, math.ceil(math.log(max(2, n * PROBES)) / math.log(2 * padded))))
    rng = np.random.default_rng(seed + 1)
    a = rng.normal(size=(1000, d))
    b = rng.normal(size=(1000, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b / np.where(norm > 0, norm, 1)
    signs = rotation_signs(padded, k * 4, seed)
    ka, kb = bucket_keys(a, signs, k), bucket_keys(b, signs, k)
    p = float((ka[:, :, :, None] == kb[:, :, None, :]).any(axis=(2, 3)).mean())
    p = min(p, 0.999)
    tables = max(2, math.ceil(math.log(1 - recall) / math.log(1 - p))) if p > 0 else MOST_TABLES + 1
    if tables > MOST_TABLES:
        raise ValueError(f"recall {recall} at cosine {threshold} takes over {MOST_TABLES} tables: a table finds {p:.4f}")
    return k, rotation_signs(padded, k * tables, seed)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hasher(d: int, k: int, signs: np.ndarray):
    """For mapInArrow: a row for each vector and bucket that it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = bucket_keys(_unit(_vectors(b.column(1), d)), signs, k)
            n, tables, probes = keys.shape
            table = np.arange(tables, dtype=np.int64)[None, :, None]
            flat = (keys * tables + table).reshape(n, tables * probes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(b.column(0).to_numpy(), tables * probes)),
                    pa.array(flat.ravel()),
                ],
                names=["node", "bucket"],
            )

    return run


def _compare(d: int, k: int, signs: np.ndarray, threshold: float):
    """For mapInArrow over dealt rows: links counted once, and merges within a group."""

    def pairs(start: int, end: int, shard, i, j) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = shard[start:end]
        left = start + np.flatnonzero(own == i)
        right = start + np.flatnonzero(own == j)
        for at in range(0, len(left), 512):
            yield left[at : at + 512], right

    def work(node, copies, table, i, j, shard, bucket, x, keys) -> pa.RecordBatch:
        starts = group_starts(bucket, i, j)
        ends = np.append(starts[1:], len(node))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(starts, ends, strict=True):
            for left, right in pairs(s, e, shard, i[s], j[s]):
                near = x[left] @ x[right].T >= threshold - 1e-9
                if i[s] == j[s]:
                    near &= left[:, None] < right[None, :]
                a, b = np.nonzero(near)
                a, b = left[a], right[b]
                ok = node[a] != node[b]
                a, b = a[ok], b[ok]
                exact = (x[a] * x[b]).sum(axis=1) >= threshold
                a, b = a[exact], b[exact]
                at = int(table[s])  # counted where they first meet
                first = np.ones(len(a), bool)
                for t in range(at + 1):
                    ka, kb = keys[a, t], keys[b, t]
                    if t < at:
                        first &= ~(ka[:, :, None] == kb[:, None, :]).any(axis=(1, 2))
                    else:  # of the buckets of one table that both are in, the least
                        same = ka[:, :, None] == kb[:, None, :]
                        least = np.where(same, ka[:, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
                        first &= least == bucket[s] // (len(signs) // k)
                found.append((a[first], b[first]))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        n = np.zeros(len(node), np.int64)
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        root = roots_of_pairs(len(node), a, b)
        out = np.flatnonzero(n > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(node[out]), pa.array(n[out]), pa.array(node[root[out]])], names=["node", "n", "root"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        per_table = len(signs) // k
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(k_) for k_, n in enumerate(batch.schema.names)}
            x = _unit(_vectors(c["embedding"], d))
            flat = [c[n].to_numpy(zero_copy_only=False) for n in ("node", "copies")]
            bucket = c["bucket"].to_numpy(zero_copy_only=False)
            more = [c[n].to_numpy(zero_copy_only=False) for n in ("i", "j", "shard")]
            cols = [*flat, bucket % per_table, *more, bucket, x, bucket_keys(x, signs, k)]
            if rest is not None:
                cols = [np.concatenate(z) for z in zip(rest, cols, strict=True)]
            starts = group_starts(cols[6], cols[3], cols[4])
            if starts[-1] >= 4_000:
                yield work(*[z[: starts[-1]] for z in cols])
                cols = [z[starts[-1] :] for z in cols]
            rest = cols
        if rest is not None and len(rest[0]):
            yield work(*rest)

    return run


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.95,
    recall: float = 0.999,
    seed: int = 17,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``rows``."""
    small_batches(rows.sparkSession)
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    zero = F.forall("v", lambda c: c == 0.0)
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & ~zero
    # 0.0 - (0.0 - c): one zero, so that copies are equal as arrays
    valid = source.where(good).select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"))
    classes = materialize(
        valid.groupBy("v").agg(F.min("id").alias("node"), F.count_distinct("id").alias("copies"))
        .select("node", "copies", F.col("v").alias("embedding")),
        "classes",
    )
    by_length = classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()
    counts = None
    for d, n in by_length:  # one length as a rule
        k, signs = table_plan(d, n, threshold, recall, seed)
        same = classes.where(F.size("embedding") == d)
        hashed = same.select("node", "embedding").mapInArrow(_hasher(d, k, signs), "node long, bucket long")
        hashed = materialize(hashed.distinct(), "buckets")
        # singles are dropped and groups cut before a vector moves
        dealt = deal(hashed, "node", times=SHARD_TIMES, carry=same)
        met = dealt.select("bucket", "i", "j", "shard", "node", "copies", "embedding").mapInArrow(
            _compare(d, k, signs, threshold), "node long, n long, root long"
        )
        counts = met if counts is None else counts.unionByName(met)
    spark = rows.sparkSession
    if counts is None:
        counts = spark.createDataFrame([], "node long, n long, root long")
    counts = materialize(counts, "met")
    comp = components(counts.where("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = counts.groupBy("node").agg(F.sum("n").alias("n"))
    of_class = (
        classes.join(links, "node", "left").join(comp, "node", "left")
        .select(
            F.col("embedding").alias("v"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("component_id"),
        )
    )
    linked = valid.join(of_class, "v").select("id", "n_links", "component_id")
    alone = source.where(~F.coalesce(good, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        (F.col("id") == F.col("component_id")).alias("kept"),
    )


def oracle_sql(threshold: float = 0.95) -> str:
    """The same by comparing all pairs and following links (DuckDB)."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    good AS (
        SELECT DISTINCT vec_id, x FROM v WHERE vec_id IS NOT NULL AND len(x) > 0 AND list_count(x) = len(x)
        AND isfinite(list_sum(x)) AND list_max(list_transform(x, lambda c: abs(c))) > 0
    ),
    pairs AS (
        SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
        ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {threshold}
    ),
    reach AS (
        SELECT vec_id AS node, vec_id AS seen FROM v WHERE vec_id IS NOT NULL
        UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.seen
    ),
    least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
    links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
    FROM v LEFT JOIN least ON node = vec_id LEFT JOIN links ON a = vec_id
    """
