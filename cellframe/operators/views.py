"""The tables behind plots: dots, bars, volcanoes, embeddings, densities, orderings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix, percentiles, ratio


def group_stats(m: AnnotatedMatrix, by: str, genes: list[str] | None = None) -> DataFrame:
    """(group, gene_id, mean, pct): means over all cells of a group, percentages above 0."""
    m.require(by)
    chosen = m.genes.select("gene_id")
    if genes is not None:
        chosen = chosen.where(F.col("gene_id").isin(genes))
    of = m.cells.select("cell_id", F.col(by).alias("group"))
    sizes = of.groupBy("group").agg(F.count("*").alias("n"))
    x = F.col("value").cast("double")
    sums = m.counts.join(F.broadcast(chosen), "gene_id", "left_semi").join(of, "cell_id").groupBy("group", "gene_id").agg(
        F.sum(x).alias("s"), F.count(F.when(x > 0, 1)).alias("e")
    )
    full = sizes.crossJoin(chosen).join(sums, ["group", "gene_id"], "left").fillna(0, ["s", "e"])
    return full.select("group", "gene_id", (F.col("s") / F.col("n")).alias("mean"), (F.col("e") / F.col("n") * 100).alias("pct"))


def dotplot_data(m: AnnotatedMatrix, by: str, genes: list[str] | None = None, z_score: bool = True) -> DataFrame:
    """(group, gene_id, pct, color): color is the mean, or its z-score across groups."""
    stats = group_stats(m, by, genes)
    w = Window.partitionBy("gene_id")
    z = (F.col("mean") - F.avg("mean").over(w)) / (F.stddev_samp("mean").over(w) + 1e-9)
    return stats.select("group", "gene_id", "pct", (z if z_score else F.col("mean")).alias("color"))


def color_limits(dots: DataFrame) -> DataFrame:
    """One row: vmin and vmax, symmetric about 0."""
    return dots.agg(F.max(F.abs("color")).alias("vmax")).select((-F.col("vmax")).alias("vmin"), "vmax")


def dotplot_table(
    m: AnnotatedMatrix, genes: list[str], by: str, expr_threshold: float = 0.0, min_pct: float = 0.0,
    keep_genes: list[str] | None = None,
) -> DataFrame:
    """(Cluster, Gene, AvgExp, Pct), sorted by cluster, then by the order of ``genes``.

    A gene stays if its greatest mean and its greatest percentage reach the
    thresholds, or if it is among ``keep_genes``; unknown genes are passed over.
    """
    stats = group_stats(m, by, genes)
    w = Window.partitionBy("gene_id")
    good = (F.max("mean").over(w) >= expr_threshold) & (F.max("pct").over(w) >= min_pct)
    if keep_genes:
        good = good | F.col("gene_id").isin(keep_genes)
    order = F.array_position(F.lit(list(genes)), F.col("gene_id"))
    return stats.withColumn("_good", good).where("_good").orderBy("group", order).select(
        F.col("group").alias("Cluster"), F.col("gene_id").alias("Gene"), F.col("mean").alias("AvgExp"), F.col("pct").alias("Pct")
    )


def fan_layout(dots: DataFrame, genes: list[str], start_deg: float = -60, end_deg: float = 60, inner: int = 10) -> DataFrame:
    """A dotplot table with theta, r, size, and the rotation and side of the gene's label.

    Genes are spread evenly over the angles in list order, clusters over radii in
    the order of their names.
    """
    present = [r.Gene for r in dots.select("Gene").distinct().collect()]  # as many as plotted genes
    order = [g for g in genes if g in set(present)]
    step = (end_deg - start_deg) / max(len(order) - 1, 1)
    index = F.array_position(F.lit(order), F.col("Gene")) - 1
    degrees = F.lit(float(start_deg)) + index * F.lit(step)
    radius = F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("Cluster")) - 1 + inner
    turn = 90 - degrees
    rotation = (
        F.when((turn > 90) & (turn <= 270), turn - 180).when(turn > 270, turn - 360).when(turn < -90, turn + 180).otherwise(turn)
    )
    right = ((turn > 90) & (turn <= 270)) | (turn < -90)
    return dots.select(
        "Cluster", "Gene", "AvgExp", F.radians(degrees).alias("theta"), radius.cast("long").alias("r"),
        (F.col("Pct") * 2.5).alias("size"), rotation.alias("rotation"), F.when(right, "right").otherwise("left").alias("side"),
    )


def crosstab(cells: DataFrame, rows: str, columns: str) -> DataFrame:
    """(row, column, n) of every pair of values, zeros included."""
    found = cells.groupBy(F.col(rows).alias("row"), F.col(columns).alias("column")).agg(F.count("*").alias("n"))
    grid = found.select("row").distinct().crossJoin(found.select("column").distinct())
    return grid.join(found, ["row", "column"], "left").fillna(0, ["n"])


def stacked_bars(
    cells: DataFrame, group: str, kind: str, mode: str = "relative", label: str = "percentage", min_label: float = 0.03
) -> DataFrame:
    """(kind, group, n, value, center, pct, label, is_small) of the bars' parts that aren't empty.

    Parts are stacked in the order of the groups' names.
    """
    table = crosstab(cells, kind, group)
    of_kind = Window.partitionBy("row")
    pct = F.col("n") / F.sum("n").over(of_kind)
    value = pct if mode == "relative" else F.col("n").cast("double")
    below = of_kind.orderBy("column").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.withColumn("pct", pct).withColumn("value", value).withColumn("base", F.coalesce(F.sum("value").over(below), F.lit(0.0)))
    share, count = F.format_string("%.1f%%", F.col("pct") * 100), F.col("n").cast("string")
    text = {"percentage": share, "count": count, "both": F.concat(count, F.lit("\n("), share, F.lit(")"))}.get(label, F.lit(""))
    return parts.where("n > 0").select(
        F.col("row").alias("kind"), F.col("column").alias("group"), "n", "value",
        (F.col("base") + F.col("value") / 2).alias("center"), "pct", text.alias("label"), (F.col("pct") < min_label).alias("is_small"),
    )


def volcano(deg: DataFrame, logfc: str = "logfc", padj: str = "padj", lfc_thr: float = 1.0, p_thr: float = 0.05) -> DataFrame:
    """``deg`` with ``neg_log10_padj`` (0 counts as 1e-300) and ``status`` Up, Down or NS."""
    p = F.when(F.col(padj) == 0, F.lit(1e-300)).otherwise(F.col(padj))
    sure = F.col(padj) < p_thr
    status = F.when(sure & (F.col(logfc) > lfc_thr), "Up").when(sure & (F.col(logfc) < -lfc_thr), "Down").otherwise("NS")
    return deg.withColumn("neg_log10_padj", -F.log10(p)).withColumn("status", status)


def jitter_table(
    deg: DataFrame, cluster: str = "cluster", gene: str = "gene_id", logfc: str = "logfc",
    highlight: DataFrame | None = None, vrange: tuple[float, float] = (-10, 10), order: str | None = None, seed: int = 0,
) -> DataFrame:
    """(cluster, gene, x_idx, x, y, direction, is_label): points of clusters side by side.

    Clusters stand in the order of their least ``order`` (of their names without
    it); the jitter of at most 0.3 derives from a hash; fold changes of 0 are left
    out.
    """
    key = F.col(order) if order else F.col(cluster)
    firsts = deg.groupBy(F.col(cluster).alias("cluster")).agg(F.min(key).alias("first"))
    idx = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", "cluster")) - 1).cast("long")
    firsts = firsts.select("cluster", idx.alias("x_idx"))
    x = F.col(logfc)
    rows = deg.where(x != 0).select(
        F.col(cluster).alias("cluster"), F.col(gene).alias("gene"),
        F.greatest(F.least(x, F.lit(float(vrange[1]))), F.lit(float(vrange[0]))).alias("y"),
        F.when(x > 0, "up").otherwise("down").alias("direction"),
    ).join(F.broadcast(firsts), "cluster")
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("cluster").cast("string"), F.lit(":"), F.col("gene").cast("string"))), 1, 8), 16, 10)
    rows = rows.withColumn("x", F.col("x_idx") + (digest.cast("double") / 4294967295.0 - 0.5) * 0.6)
    if highlight is None:
        return rows.withColumn("is_label", F.lit(False)).select("cluster", "gene", "x_idx", "x", "y", "direction", "is_label")
    wanted = highlight.select("cluster", F.explode("genes").alias("gene")).withColumn("is_label", F.lit(True))
    out = rows.join(F.broadcast(wanted), ["cluster", "gene"], "left").fillna(False, ["is_label"])
    return out.select("cluster", "gene", "x_idx", "x", "y", "direction", "is_label")


def embedding_points(coords: DataFrame, cells: DataFrame, color: str | None = None, counts: DataFrame | None = None, gene: str | None = None) -> DataFrame:
    """(cell_id, dim1, dim2, color): by a column of the cells, or by a gene's values (absent: 0)."""
    points = coords.select("cell_id", F.get("vec", F.lit(0)).cast("double").alias("dim1"), F.get("vec", F.lit(1)).cast("double").alias("dim2"))
    if color is not None and color in cells.columns:
        return points.join(cells.select("cell_id", F.col(color).alias("color")), "cell_id")
    if counts is None or gene is None:
        raise KeyError(f"{color!r} is neither a column of the cells nor a gene")
    values = counts.where(F.col("gene_id") == gene).groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("color"))
    return points.join(values, "cell_id", "left").fillna(0.0, ["color"])


def centroids(points: DataFrame) -> DataFrame:
    """(color, dim1, dim2, n): medians of each category."""
    return points.groupBy("color").agg(F.median("dim1").alias("dim1"), F.median("dim2").alias("dim2"), F.count("*").alias("n"))


def silverman(points: DataFrame, columns: list[str]) -> DataFrame:
    """One row: ``0.9 min(sd, IQR / 1.34) n^(-1/5)`` of each column (null for n < 2)."""
    stats = points.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("sd", F.stddev_samp), ("n", F.count))])
    long = points.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    quartiles = percentiles(long, ["axis"], "x", {"low": 0.25, "high": 0.75})
    wide = quartiles.agg(*[F.max(F.when(F.col("axis") == c, F.col("high") - F.col("low"))).alias(f"iqr_{c}") for c in columns])
    return stats.crossJoin(wide).select(
        *[(0.9 * F.least(F.col(f"sd_{c}"), F.col(f"iqr_{c}") / 1.34) * F.pow(F.col(f"n_{c}").cast("double"), F.lit(-0.2))).alias(c) for c in columns]
    )


def _grid(points: DataFrame, axes: list[str], adjust: float, n: int, limits: list[tuple[float, float]] | None):
    """Bandwidths and grid nodes of each axis, on the driver: a few numbers."""
    h = silverman(points, axes).first()
    if limits is None:
        ends = points.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max)]).first()
        limits = [(ends[f"min_{c}"], ends[f"max_{c}"]) for c in axes]
    return [None if h[c] is None else h[c] * adjust for c in axes], [np.linspace(a, b, n) if a is not None else np.zeros(n) for a, b in limits]


def weighted_density(
    points: DataFrame, axes: list[str], weight: str, adjust: float = 1.0, n: int | None = None, limits: list[tuple[float, float]] | None = None
) -> DataFrame:
    """(i, j[, k], z) at the nodes of a grid over two or three axes: a Gaussian kernel density.

    Each task sums its points' kernels over the whole grid, and the partial grids
    are summed by node. A bandwidth of 0 (a constant axis) gives null densities.
    """
    d = len(axes)
    if d not in (2, 3):
        raise ValueError("a density has two or three axes")
    n = n or (100 if d == 2 else 30)
    rows = points.select(*[F.col(c).cast("double").alias(c) for c in axes], F.col(weight).cast("double").alias("_w"))
    h, nodes = _grid(rows, axes, adjust, n, limits)
    names = ["i", "j", "k"][:d]
    flat = bool(any(x is None or x == 0 for x in h))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, total = np.zeros((n,) * d), 0.0
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in range(d + 1)]
            for at in range(0, b.num_rows, 2048):
                x = [c[at : at + 2048] for c in cols]
                total += x[-1].sum()
                if flat:
                    continue
                kernels = [np.exp(-0.5 * ((g[:, None] - v[None, :]) / s) ** 2) / math.sqrt(2 * math.pi) for g, v, s in zip(nodes, x, h, strict=False)]
                if d == 2:
                    grid += (kernels[0] * x[-1]) @ kernels[1].T
                else:
                    grid += np.einsum("ap,bp,cp->abc", kernels[0] * x[-1], kernels[1], kernels[2], optimize=True)
        places = np.indices(grid.shape).reshape(d, -1)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(p.astype(np.int32)) for p in places], pa.array(grid.ravel()), pa.array(np.full(grid.size, total))], names=[*names, "s", "w"]
        )

    schema = ", ".join([*[f"{c} int" for c in names], "s double", "w double"])
    sums = rows.mapInArrow(partial, schema).groupBy(*names).agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    scale = F.lit(None).cast("double") if flat else F.lit(float(np.prod([float(x) for x in h])))
    return sums.select(*names, ratio(F.col("s"), F.col("w") * scale).alias("z"))


def cell_density(points: DataFrame, axes: list[str], weight: str, adjust: float = 1.0, n: int | None = None, limits=None) -> DataFrame:
    """``points`` with ``density``: that of the grid node at or below each point."""
    d = len(axes)
    n = n or (100 if d == 2 else 30)
    if limits is None:
        ends = points.agg(*[f(F.col(c).cast("double")).alias(f"{f.__name__}_{c}") for c in axes for f in (F.min, F.max)]).first()
        limits = [(ends[f"min_{c}"], ends[f"max_{c}"]) for c in axes]
    grid = weighted_density(points, axes, weight, adjust, n, limits)
    names = ["i", "j", "k"][:d]

    def node(c: str, low: float, high: float) -> Column:
        nodes = np.linspace(low, high, n).tolist()
        step = (high - low) / (n - 1) if high > low else 1.0
        x = F.col(c).cast("double")
        guess = F.greatest(F.least(F.floor((x - low) / step).cast("int"), F.lit(n - 1)), F.lit(0))
        array = F.lit(nodes)
        up = F.when((guess < n - 1) & (F.get(array, guess + 1) <= x), guess + 1).when(F.get(array, guess) > x, guess - 1).otherwise(guess)
        return F.greatest(F.least(up, F.lit(n - 1)), F.lit(0)).cast("int")

    placed = points.withColumns({k: node(c, a, b) for k, c, (a, b) in zip(names, axes, limits, strict=True)})
    return placed.join(F.broadcast(grid.withColumnRenamed("z", "density")), names, "left").drop(*names)


def ward_order(x: np.ndarray, optimal: bool = False) -> list[int]:
    """Leaves of Ward's tree over the rows of ``x``; with ``optimal``, neighbours as close as its shape allows."""
    k = len(x)
    if k < 3:
        return list(range(k))
    gap = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    d = gap.copy()
    np.fill_diagonal(d, np.inf)
    size, live = np.ones(k), list(range(k))
    tree: dict[int, tuple[int, int] | None] = dict.fromkeys(range(k))
    name, nxt = list(range(k)), k
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        i, j = divmod(int(sub.argmin()), len(live))
        a, b = sorted((live[i], live[j]))
        tree[nxt] = (min(name[a], name[b]), max(name[a], name[b]))
        for c in live:
            if c not in (a, b):
                t = size[a] + size[b] + size[c]
                d[a, c] = d[c, a] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d[a, b]) / t
        size[a] += size[b]
        name[a], nxt = nxt, nxt + 1
        live.remove(b)

    def leaves(node: int) -> list[int]:
        return [node] if tree[node] is None else leaves(tree[node][0]) + leaves(tree[node][1])

    if not optimal:
        return leaves(nxt - 1)
    dist = np.sqrt(gap)

    def best(node: int) -> dict[tuple[int, int], tuple[float, list[int]]]:
        """For each pair of end leaves, the least length of a path through the node's leaves."""
        if tree[node] is None:
            return {(node, node): (0.0, [node])}
        out: dict[tuple[int, int], tuple[float, list[int]]] = {}
        one, two = best(tree[node][0]), best(tree[node][1])
        for (a, b), (c1, p1) in one.items():
            for (c, e), (c2, p2) in two.items():
                cost = c1 + c2 + dist[b, c]
                if cost < out.get((a, e), (np.inf,))[0]:
                    out[a, e] = (cost, p1 + p2)
                    out[e, a] = (cost, (p1 + p2)[::-1])
        return out

    return min(best(nxt - 1).values(), key=lambda v: (v[0], v[1]))[1]


#: Starts of k-means up to which every choice of ``k`` rows is one, and values of the distances that are held at a time.
MOST_STARTS, _HELD = 50_000, 4_000_000


def kmeans_labels(x: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> np.ndarray:
    """Lloyd's algorithm from every ``k`` rows, to its end; the least inertia wins, ties by labels.

    Where these are more than ``MOST_STARTS`` choices, from ``starts`` spread-out ones.
    Clusters are numbered as they first appear.
    """
    n, k = len(x), min(k, len(x))
    if not n:
        return np.zeros(0, int)
    if math.comb(n, k) <= MOST_STARTS:
        chosen = np.array(list(combinations(range(n), k)))
    else:
        chosen = _spread_out(x, k, seed, starts)
    best = None
    step = max(1, _HELD // (n * k))
    for at in range(0, len(chosen), step):
        inertia, label = _lloyd(x, x[chosen[at : at + step]])
        for i in np.flatnonzero(inertia == inertia.min()):
            found = (inertia[i], label[i].tolist())
            best = found if best is None else min(best, found)
    _, first, label = np.unique(best[1], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[label]


def _spread_out(x: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    """``starts`` times ``k`` rows, each drawn by its squared distance to those before it."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(starts):
        rows = [int(rng.integers(len(x)))]
        while len(rows) < k:
            near = ((x[:, None] - x[rows][None]) ** 2).sum(-1).min(1)
            rows.append(int(rng.choice(len(x), p=near / near.sum() if near.sum() > 0 else None)))
        out.append(rows)
    return np.array(out)


def _lloyd(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inertia and labels from each of the starts (starts x k x dimensions); a cluster without rows keeps its center.

    Sums run row by row and dimension by dimension, the way they do in SQL, so that ties are the same ones.
    """
    starts, k, _ = centers.shape
    centers = centers.copy()
    label, inertia, live = np.full((starts, len(x)), -1), np.zeros(starts), np.arange(starts)
    for _ in range(1000):  # rounding could make labels go round
        if not len(live):
            break
        gap = np.zeros((len(live), len(x), k))
        for g in range(x.shape[1]):
            gap += (x[None, :, g, None] - centers[live][:, None, :, g]) ** 2
        gap = np.sqrt(gap)
        new = gap.argmin(axis=2)
        inertia[live] = np.add.accumulate(gap.min(axis=2) ** 2, axis=1)[:, -1]
        moved = (new != label[live]).any(axis=1)
        label[live] = new
        live, new = live[moved], new[moved]
        cluster = (np.arange(len(live))[:, None] * k + new).ravel()
        count = np.bincount(cluster, minlength=len(live) * k).reshape(-1, k)
        for g in range(x.shape[1]):
            total = np.bincount(cluster, np.tile(x[:, g], len(live)), len(live) * k).reshape(-1, k)
            centers[live, :, g] = np.where(count > 0, total / np.maximum(count, 1), centers[live, :, g])
    return inertia, label


def ordering(
    dots: DataFrame, axis: str = "gene_id", manual: list[str] | None = None, km: int | None = None,
    cluster: bool = False, optimal: bool = True, seed: int = 42,
) -> DataFrame:
    """(name, position) of genes or groups: manual, else by k-means, else by Ward's tree, else as named.

    ``dots`` is the small table of (group, gene_id, color); it is gathered, being as
    large as what a plot can show.
    """
    other = "group" if axis == "gene_id" else "gene_id"
    wide = dots.select(axis, other, "color").toPandas().pivot(index=axis, columns=other, values="color").sort_index().fillna(0.0)
    names = list(wide.index)
    if manual is not None:
        names = [g for g in manual if g in set(names)]
    elif km:
        label = kmeans_labels(wide.to_numpy(float), km, seed)
        names = [names[i] for i in np.argsort(label, kind="stable")]
    elif cluster:
        names = [names[i] for i in ward_order(wide.to_numpy(float), optimal)]
    return dots.sparkSession.createDataFrame([(str(g), i) for i, g in enumerate(names)], "name string, position int")
