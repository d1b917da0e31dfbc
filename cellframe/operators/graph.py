"""Nearest neighbours, graphs over cells, communities, layouts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import ratio, settled
from ..links import components

#: Bytes of the base vectors that are broadcast at once; more are taken in blocks.
BLOCK_BYTES = 128 << 20
#: Edges that community detection and layouts gather on the driver at most.
MOST_EDGES = 5_000_000
#: Cells up to which ``auto`` compares all pairs.
MOST_EXACT = 200_000
#: Lists of the inverted file at most, sampled vectors a list that place them, and lists that a cell looks into.
MOST_LISTS, SAMPLED, PROBED = 4096, 16, 24
#: Vectors of a list that meet in one task, on either side.
LIST_SHARD = 8192


def knn(
    embeddings: DataFrame, k: int = 30, metric: str = "cosine", block_bytes: int = BLOCK_BYTES,
    method: str = "auto", probes: int = PROBED, seed: int = 0,
) -> DataFrame:
    """(cell_id, rank, nbr_id, dist): the ``k`` nearest other cells, ranks from 1, ties by id.

    ``embeddings`` has cell_id and vec (an array of any numeric type). ``exact``
    compares all pairs: the base is broadcast in blocks of a bounded size, each matched
    with all cells by matrix products of Arrow batches; with several blocks, a cell's
    best of each block meet in a window of ``k`` times the blocks. ``approximate`` looks
    into the ``probes`` nearest lists of an inverted file, so that work grows with
    ``n^1.5`` and each vector moves ``probes + 1`` times. ``auto`` is exact up to
    ``MOST_EXACT`` cells.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    if method not in ("auto", "exact", "approximate"):
        raise ValueError(f"unknown method {method!r}")
    source = embeddings.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("vec").cast("array<double>").alias("vec"))
    row = source.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not row.n:
        return source.sparkSession.createDataFrame([], "cell_id long, rank int, nbr_id long, dist double")
    if method == "approximate" or (method == "auto" and row.n > MOST_EXACT):
        found = _listed(source, row.n, row.d, k, metric, probes, seed)
    else:
        found = _all_pairs(source, row.n, row.d, k, metric, block_bytes)
    order = F.row_number().over(Window.partitionBy("cell_id").orderBy("dist", "nbr_id"))
    return found.select("cell_id", order.alias("rank"), "nbr_id", "dist").where(F.col("rank") <= k)


_NEAR = "cell_id long, nbr_id long, dist double"


def _distances(x: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    dot = x @ base.T
    if metric == "cosine":
        return 1.0 - dot
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (base * base).sum(axis=1)[None, :] - 2 * dot, 0.0))


def _nearest(own: np.ndarray, x: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The ``k`` nearest of ``base``, whose ids ascend, to each row of ``x`` but itself."""
    for at in range(0, len(own), 512):
        mine = own[at : at + 512]
        dist = _distances(x[at : at + 512], base, metric)
        dist[mine[:, None] == ids[None, :]] = np.inf
        top = min(k, len(ids))
        bound = np.partition(dist, top - 1, axis=1)[:, top - 1]
        cells, nbrs, far = [], [], []
        for r in range(len(mine)):
            near = np.flatnonzero((dist[r] <= bound[r]) & np.isfinite(dist[r]))
            near = near[np.argsort(dist[r, near], kind="stable")][:top]
            cells.append(np.full(len(near), mine[r]))
            nbrs.append(ids[near])
            far.append(dist[r, near])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (cells, nbrs, far)], names=["cell_id", "nbr_id", "dist"])


def _all_pairs(source: DataFrame, n: int, d: int, k: int, metric: str, block_bytes: int) -> DataFrame:
    sc = source.sparkSession.sparkContext
    blocks = max(1, math.ceil(n * d * 8 / block_bytes))
    # a file of vectors is small for the work it makes: it is dealt to all tasks
    asking = source.repartition(max(sc.defaultParallelism, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell_id")
    found = None
    for b in range(blocks):
        part = source if blocks == 1 else source.where(F.pmod(F.xxhash64("cell_id"), F.lit(blocks)) == b)
        base = part.orderBy("cell_id").toArrow()  # one block: of bounded size
        if not base.num_rows:
            continue
        ids = base.column("cell_id").to_numpy()
        shared = sc.broadcast((ids, _unit(_matrix(base.column("vec").combine_chunks(), d), metric)))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, base = shared.value
            for batch in batches:
                yield from _nearest(batch.column(0).to_numpy(), _unit(_matrix(batch.column(1), d), metric), ids, base, k, metric)

        got = asking.mapInArrow(nearest, _NEAR)
        found = got if found is None else found.unionByName(got)
    return found


def _centres(x: np.ndarray, lists: int, metric: str, seed: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from sampled rows; a list that loses all its rows keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        label = np.concatenate([_distances(x[a : a + 1024], centres, metric).argmin(axis=1) for a in range(0, len(x), 1024)])
        n = np.bincount(label, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = _unit(np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres), metric)
    return centres


def _listed(source: DataFrame, n: int, d: int, k: int, metric: str, probes: int, seed: int) -> DataFrame:
    """Candidates from an inverted file: each vector is in its nearest list and asks the ``probes`` nearest.

    The lists' places are fitted on a bounded sample, and every vector is indexed. A
    list of many vectors is cut in shards on either side, and each pair of shards is a
    group of its own, so that no task holds a whole hot list.
    """
    spark = source.sparkSession
    lists = int(min(MOST_LISTS, max(1, math.isqrt(n))))
    sample = source.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(SAMPLED * lists).toArrow()
    x = _unit(_matrix(sample.column("vec").combine_chunks(), d), metric)
    shared = spark.sparkContext.broadcast(_centres(x, lists, metric, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        m = min(probes, len(centres))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                dist = _distances(_unit(_matrix(b.column(1), d), metric), centres, metric)
                near = np.argpartition(dist, m - 1, axis=1)[:, :m]
                home = dist.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(home, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, m), pa.int32()), pa.array(near.ravel(), pa.int32()))],
                    names=["cell_id", "home", "near"],
                )

    placed = settled(source.mapInArrow(place, "cell_id long, home int, near array<int>"), "placed")
    asks = placed.select("cell_id", F.explode("near").alias("list"))
    holds = placed.select("cell_id", F.col("home").alias("list"))
    shards = lambda rows, name: rows.groupBy("list").agg(F.ceil(F.count("*") / F.lit(LIST_SHARD)).cast("int").alias(name))
    plan = F.broadcast(shards(asks, "qs").join(shards(holds, "bs"), "list"))  # a row a list

    def dealt(rows: DataFrame, own: str, other: str, asking: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("cell_id", F.lit(seed + 1)), F.col(own)).cast("int")
        spread = rows.join(plan, "list").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("mine", "theirs") if asking else ("theirs", "mine")
        return spread.select("list", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(asking).alias("asks"), "cell_id")

    # ids first, vectors once it is known where to
    groups = dealt(asks, "qs", "bs", True).unionByName(dealt(holds, "bs", "qs", False)).join(source, "cell_id")
    groups = groups.select("list", "i", "j", "asks", "cell_id", "vec")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * (probes + 1) / 200_000))
    groups = groups.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "asks", "cell_id")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, base = None, [], []
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            own = batch.column(4).to_numpy()
            x = _unit(_matrix(batch.column(5), d), metric)
            new = np.ones(len(own), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in keys], axis=0)
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], len(own)], strict=True):
                now = tuple(c[a] for c in keys[:3])
                if now != key:
                    key, ids, base = now, [], []
                if not keys[3][a]:  # the base of a group comes first
                    ids.append(own[a:b])
                    base.append(x[a:b])
                elif ids:
                    if len(ids) > 1:
                        ids, base = [np.concatenate(ids)], [np.concatenate(base)]
                    yield from _nearest(own[a:b], x[a:b], ids[0], base[0], k, metric)

    return groups.mapInArrow(match, _NEAR)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, d)


def _unit(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def knn_edges(neighbours: DataFrame) -> DataFrame:
    """(src, dst): directed edges of weight one; loops and absent neighbours go."""
    return neighbours.where("nbr_id >= 0 and nbr_id != cell_id").select(F.col("cell_id").alias("src"), F.col("nbr_id").alias("dst"))


def resolve_edges(
    graphs: dict[str, DataFrame], adjacency: DataFrame | None = None, neighbors_key: str | None = None, obsp: str | None = None
) -> DataFrame:
    """The graph to use: a given one, else that of ``obsp``, of ``neighbors_key``, or ``connectivities``."""
    if sum(x is not None for x in (adjacency, neighbors_key, obsp)) > 1:
        raise ValueError("give only one of adjacency, neighbors_key and obsp")
    if adjacency is not None:
        return adjacency
    key = obsp if obsp is not None else f"{neighbors_key}_connectivities" if neighbors_key is not None else "connectivities"
    if key not in graphs:
        raise KeyError(f"no graph {key!r}; there are {sorted(graphs)}")
    return graphs[key]


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, component): the least id that undirected edges reach, for every node."""
    found = components(edges)
    return nodes.select("cell_id").join(found, F.col("cell_id") == found.node, "left").select(
        "cell_id", F.coalesce("root", "cell_id").alias("component")
    )


def graph_connectivity(neighbours: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """One row: the share of cells in the largest component of their label's subgraph; null below two labels."""
    of = cells.select("cell_id", F.col(label).alias("label")).where("label is not null")
    edges = knn_edges(neighbours)
    a, b = of.select(F.col("cell_id").alias("src"), F.col("label").alias("la")), of.select(F.col("cell_id").alias("dst"), F.col("label").alias("lb"))
    same = edges.join(a, "src").join(b, "dst").where("la = lb").select("src", "dst")
    found = connected_components(of, same)
    sizes = of.join(found, "cell_id").groupBy("label", "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy("label").agg(F.max("n").alias("largest"), F.sum("n").alias("n"))
    return best.agg(F.when(F.count("*") >= 2, ratio(F.sum("largest"), F.sum("n"))).alias("graph_connectivity"))


class Graph:
    """An undirected weighted graph as adjacency arrays; loops carry inner weight."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.n = n
        loop = src == dst
        self.loops = np.bincount(src[loop], w[loop], n)
        a, b, v = src[~loop], dst[~loop], w[~loop]
        a, b, v = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([v, v])
        order = np.lexsort((b, a))
        a, b, v = a[order], b[order], v[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        self.to, self.w = b[at], np.add.reduceat(v, at) if len(at) else v
        self.start = np.searchsorted(a[at], np.arange(n + 1))
        self.strength = np.bincount(a[at], self.w, n) + 2 * self.loops
        self.total = self.strength.sum()

    def around(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.to[self.start[i] : self.start[i + 1]], self.w[self.start[i] : self.start[i + 1]]

    def modularity(self, part: np.ndarray, resolution: float) -> float:
        if not self.total:
            return 0.0
        rows = np.repeat(np.arange(self.n), np.diff(self.start))
        inner = self.w[part[rows] == part[self.to]].sum() + 2 * self.loops.sum()
        mass = np.bincount(part, self.strength)
        return float(inner / self.total - resolution * (mass**2).sum() / self.total**2)


def _move_nodes(g: Graph, part: np.ndarray, resolution: float, order: np.ndarray) -> np.ndarray:
    """Local moving with a queue: nodes go to the neighbouring community of greatest gain."""
    part = part.copy()
    mass = np.bincount(part, g.strength, g.n)
    queue, queued = list(order), np.ones(g.n, bool)
    head = 0
    while head < len(queue):
        i = queue[head]
        head += 1
        queued[i] = False
        to, w = g.around(i)
        if not len(to):
            continue
        own, k = part[i], g.strength[i]
        mass[own] -= k
        found, at = np.unique(part[to], return_inverse=True)
        gain = np.bincount(at, w) - resolution * k * mass[found] / g.total
        stay = gain[found == own][0] if (found == own).any() else -resolution * k * mass[own] / g.total
        best = int(gain.argmax())
        new = found[best] if gain[best] > stay + 1e-12 else own
        mass[new] += k
        if new != own:
            part[i] = new
            for j in to[(part[to] != new) & ~queued[to]].tolist():
                queued[j] = True
                queue.append(j)
    return np.unique(part, return_inverse=True)[1]


def _refine(g: Graph, part: np.ndarray, resolution: float, order: np.ndarray) -> np.ndarray:
    """Within communities, single nodes join well-connected neighbours' groups, greatest gain first."""
    fine = np.arange(g.n)
    mass, size = g.strength.astype(float).copy(), np.ones(g.n, np.int64)
    whole = np.bincount(part, g.strength, part.max() + 1)
    for i in order:
        if size[fine[i]] != 1:
            continue
        to, w = g.around(i)
        same = part[to] == part[i]
        to, w = to[same], w[same]
        k = g.strength[i]
        if not len(to) or w.sum() < resolution * k * (whole[part[i]] - k) / g.total:
            continue
        found, at = np.unique(fine[to], return_inverse=True)
        gain = np.bincount(at, w) - resolution * k * mass[found] / g.total
        gain[found == fine[i]] = 0
        best = int(gain.argmax())
        if gain[best] > 1e-12:
            old, new = fine[i], found[best]
            mass[old] -= k
            size[old] -= 1
            mass[new] += k
            size[new] += 1
            fine[i] = new
    return np.unique(fine, return_inverse=True)[1]


def leiden_partition(g: Graph, resolution: float = 1.0, seed: int | None = None, iterations: int = 10) -> np.ndarray:
    """Communities by moving, refining and aggregating until nothing moves (Traag et al., 2019).

    Without a seed nodes are taken in their own order.
    """
    rng = None if seed is None else np.random.default_rng(seed)
    member, part, level = np.arange(g.n), np.arange(g.n), g
    if not g.total:
        return part
    for _ in range(max(iterations, 1) * 10):
        order = np.arange(level.n) if rng is None else rng.permutation(level.n)
        part = _move_nodes(level, part, resolution, order)
        if part.max() + 1 == level.n:
            break
        fine = _refine(level, part, resolution, order)
        if fine.max() + 1 == level.n:
            fine = part
        rows = np.repeat(np.arange(level.n), np.diff(level.start))
        up = rows < level.to
        src = np.concatenate([fine[rows[up]], fine])
        dst = np.concatenate([fine[level.to[up]], fine])
        w = np.concatenate([level.w[up], level.loops])
        above = np.zeros(fine.max() + 1, np.int64)
        above[fine] = part
        level = Graph(fine.max() + 1, src, dst, w)
        member, part = fine[member], above
    return part[member]


def _coarser(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, parent), and the edges between parents: nodes that are each other's heaviest neighbour become one.

    ``edges`` (src <= dst, w; a loop is a node's inner weight). Of equally heavy edges a
    hash of the edge decides, so that the heaviest of all has both its ends agree.
    """
    order = F.struct("w", F.xxhash64("src", "dst"))
    links = edges.where("src != dst").select("src", "dst", order.alias("o"))
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "o"))
    best = settled(both.groupBy("src").agg(F.max_by("dst", "o").alias("dst")), "best")
    pairs = best.join(best.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).where("src < dst")
    moved = settled(pairs.select(F.col("dst").alias("node"), F.col("src").alias("parent")), "pairs")
    a, b = moved.toDF("src", "pa"), moved.toDF("dst", "pb")
    up = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("pa", "src").alias("x"), F.coalesce("pb", "dst").alias("y"), "w")
    merged = up.groupBy(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).agg(F.sum("w").alias("w"))
    return moved, settled(merged, "coarser")


def leiden(
    cells: DataFrame, edges: DataFrame, resolution: float = 1.0, random_state: int = 0, use_weights: bool = True,
    flavor: str = "deterministic", n_restarts: int = 4, n_iterations: int = -1, most_edges: int = MOST_EDGES,
) -> DataFrame:
    """(cell_id, cluster): communities as text numbers, the largest being ``0``, ties by least id.

    ``deterministic`` takes nodes in the order of their ids; ``quality`` keeps the
    best of that and ``n_restarts`` random orders. A graph of at most ``most_edges``
    edges is partitioned on the driver. A larger one is first made coarser in a
    distributed way, by merging nodes that are each other's heaviest neighbour, until
    it is small enough; cells without an edge never leave the executors.
    """
    if flavor not in ("deterministic", "quality"):
        raise ValueError(f"unknown flavor {flavor!r}")
    weight = F.col("weight").cast("double") if use_weights and "weight" in edges.columns else F.lit(1.0)
    level = edges.where("src != dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum(weight).alias("w"))
    level = settled(level, "edges")
    above: DataFrame | None = None  # (cell, node of the present level)
    while level.limit(most_edges + 1).count() > most_edges and not level.where("src != dst").isEmpty():
        if above is None:
            above = level.select(F.col("src").alias("cell")).union(level.select("dst")).distinct().withColumn("node", F.col("cell"))
        moved, level = _coarser(level)
        above = settled(above.join(moved, "node", "left").select("cell", F.coalesce("parent", "node").alias("node")), "above")
    table = level.toPandas()  # bounded by ``most_edges``
    ids = np.unique(table[["src", "dst"]].to_numpy(np.int64))
    g = Graph(len(ids), np.searchsorted(ids, table.src.to_numpy(np.int64)), np.searchsorted(ids, table.dst.to_numpy(np.int64)), table.w.to_numpy(float))
    rounds = 10 if n_iterations < 0 else n_iterations
    part = leiden_partition(g, resolution, None, rounds)
    if flavor == "quality":
        others = [leiden_partition(g, resolution, random_state * 1000 + s, rounds) for s in range(n_restarts)]
        part = max([part, *others], key=lambda p: g.modularity(p, resolution))
    spark = cells.sparkSession
    first = np.full(int(part.max()) + 1 if len(part) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, part, ids)  # a community is known by its least node
    found = spark.createDataFrame(pa.table({"node": pa.array(ids, pa.int64()), "c": pa.array(first[part] if len(part) else [], pa.int64())}))
    if above is not None:
        found = above.join(found, "node").select(F.col("cell").alias("node"), "c")
    of = settled(cells.select("cell_id").join(found, F.col("cell_id") == F.col("node"), "left").select("cell_id", F.coalesce("c", "cell_id").alias("c")), "communities")
    sizes = of.groupBy("c").agg(F.count("*").alias("n"), F.min("cell_id").alias("least"))
    name = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "least")) - 1
    return of.join(sizes.select("c", name.cast("string").alias("cluster")), "c").select("cell_id", "cluster")


def leiden_parameters(resolution: float = 1.0, random_state: int = 0, n_iterations: int = -1, flavor: str = "deterministic") -> dict:
    """The record of a partition's parameters that is kept beside it."""
    return {"params": {"resolution": resolution, "random_state": random_state, "n_iterations": n_iterations, "gpu_flavor": flavor}}


def cluster_categories(clusters: DataFrame) -> list[str]:
    """The names of clusters in natural order: 2 before 10."""
    names = [r.cluster for r in clusters.select("cluster").distinct().collect()]
    return sorted(names, key=lambda s: [(0, int(t), "") if t.isdigit() else (1, 0, t) for t in re.findall(r"\d+|\D+", s)])


def modularity(edges: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a partition of an undirected graph, by sums alone."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    both = edges.where("src != dst").select("src", "dst", w.alias("w"))
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    a, b = clusters.select(F.col("cell_id").alias("src"), F.col("cluster").alias("ca")), clusters.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("cb"))
    full = both.join(a, "src").join(b, "dst")
    mass = full.groupBy("ca").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))).alias("i"))
    total = F.sum("m")
    return mass.agg((ratio(F.sum("i"), total) - resolution * ratio(F.sum(F.col("m") * F.col("m")), total * total)).alias("modularity"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: nmi (arithmetic mean of entropies), ari, and the numbers of labels of either side."""
    table = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))

    def entropy(sizes: DataFrame, name: str) -> DataFrame:
        n = F.col("n")
        return sizes.agg(
            F.sum(n).alias("t"), F.sum(n * F.log(n)).alias(f"l{name}"), F.sum(n * (n - 1) / 2).alias(f"c{name}"), F.count("*").alias(f"k{name}")
        ).select("t", f"l{name}", f"c{name}", f"k{name}")

    one = entropy(table.groupBy("a").agg(F.sum("n").alias("n")), "a")
    two = entropy(table.groupBy("b").agg(F.sum("n").alias("n")), "b").drop("t")
    cross = entropy(table, "x").drop("t")
    row = one.crossJoin(two).crossJoin(cross)
    t = F.col("t")
    h_a, h_b, h_x = (F.log(t) - F.col(f"l{k}") / t for k in "abx")
    nmi = F.when((F.col("ka") == 1) & (F.col("kb") == 1), F.lit(1.0)).otherwise(ratio(h_a + h_b - h_x, (h_a + h_b) / 2))
    expected = F.coalesce(ratio(F.col("ca") * F.col("cb"), t * (t - 1) / 2), F.lit(0.0))
    limit = (F.col("ca") + F.col("cb")) / 2
    ari = F.when(limit == expected, F.lit(1.0)).otherwise(ratio(F.col("cx") - expected, limit - expected))
    return row.select(F.greatest(nmi, F.lit(0.0)).alias("nmi"), ari.alias("ari"), F.col("ka").alias(f"n_{a}"), F.col("kb").alias(f"n_{b}"))


def umap_layout(neighbours: DataFrame, n_components: int = 2, min_dist: float = 0.3, epochs: int = 200, seed: int = 42, most_edges: int = MOST_EDGES) -> DataFrame:
    """(cell_id, vec): a low-dimensional layout of the fuzzy neighbour graph (McInnes et al., 2018).

    Descent by attracting edges and repelling random pairs, on the driver over a
    graph of bounded size; the result serves for looking, not for measuring.
    """
    table = neighbours.select("cell_id", "nbr_id", "dist").orderBy("cell_id", "dist", "nbr_id").limit(most_edges + 1).toPandas()
    if len(table) > most_edges:
        raise ValueError(f"more than {most_edges} edges")
    ids, a = np.unique(table.cell_id.to_numpy(), return_inverse=True)
    b = np.searchsorted(ids, table.nbr_id.to_numpy())
    dist, n = table.dist.to_numpy(float), len(ids)
    near = np.full(n, np.inf)
    np.minimum.at(near, a, dist)
    gap = np.maximum(dist - near[a], 0)
    k = np.bincount(a, minlength=n)
    low, high, width = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(64):
        total = np.bincount(a, np.exp(-gap / width[a]), n)
        more = total < np.log2(np.maximum(k, 2))
        low, high = np.where(more, width, low), np.where(more, high, width)
        width = np.maximum(np.where(np.isinf(high), width * 2, (low + high) / 2), 1e-9)
    p = np.exp(-gap / width[a])
    sym: dict[tuple[int, int], float] = {}
    for i, j, w in zip(a.tolist(), b.tolist(), p.tolist(), strict=True):
        key = (min(i, j), max(i, j))
        sym[key] = sym[key] + w - sym[key] * w if key in sym else w
    i, j = np.array([x for x, _ in sym]), np.array([y for _, y in sym])
    w = np.array(list(sym.values()))
    grid = np.linspace(0, 3, 300)
    target = np.where(grid < min_dist, 1.0, np.exp(-(grid - min_dist)))
    fits = [(((1 / (1 + u * grid ** (2 * v)) - target) ** 2).sum(), u, v) for u in np.linspace(0.3, 2.5, 45) for v in np.linspace(0.5, 1.6, 45)]
    _, u, v = min(fits)
    rng = np.random.default_rng(seed)
    y = rng.uniform(-10, 10, (n, n_components))
    for e in range(epochs):
        rate = 1.0 - e / epochs
        on = rng.random(len(w)) < w
        s, t = i[on], j[on]
        d = y[s] - y[t]
        q = (d * d).sum(axis=1)
        pull = np.where(q > 0, -2 * u * v * np.maximum(q, 1e-12) ** (v - 1) / (1 + u * q**v), 0)[:, None] * d
        move = np.zeros_like(y)
        np.add.at(move, s, np.clip(pull, -4, 4))
        np.add.at(move, t, -np.clip(pull, -4, 4))
        for _ in range(5):
            far = rng.integers(0, n, len(s))
            d = y[s] - y[far]
            q = (d * d).sum(axis=1)
            push = (2 * v / ((0.001 + q) * (1 + u * q**v)))[:, None] * d
            np.add.at(move, s, np.clip(push, -4, 4))
        y += rate * np.clip(move, -4, 4)
    rows = [(int(c), [float(x) for x in p]) for c, p in zip(ids, y, strict=True)]
    return neighbours.sparkSession.createDataFrame(rows, "cell_id long, vec array<double>")
