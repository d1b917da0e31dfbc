"""Principal components of every batch, over cells' lists of nonzero values that are shuffled once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix, discard, settled
from .dense import _BLOCK
from .preprocess import dispersion_of_sums


def _entries(b: pa.RecordBatch, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each cell's batch; the cell, gene and value (log-normalized if ``scale``) of each entry of a gene in the table."""
    lengths = np.nan_to_num(b.column(2).value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = b.column(2).flatten()
    cell, c = np.repeat(np.arange(b.num_rows), lengths), flat.field("c").to_numpy(zero_copy_only=False)
    x = np.asarray(flat.field("x").to_numpy(zero_copy_only=False), float)
    if scale:
        depth = np.bincount(cell, x, b.num_rows)
        x = np.log1p(x * (1e4 / np.where(depth == 0, 1.0, depth))[cell])
    known = c >= 0
    return b.column(0).to_numpy(), cell[known], c[known].astype(np.int64), x[known]


def batch_components(cells: DataFrame, sizes: list[int], m: AnnotatedMatrix, n_top: int, k: int) -> tuple[DataFrame, str]:
    """(b, t, vec) of the typed cells of numbered batches, and the path it is at.

    ``cells`` are (cell_id, b, t), without ``b`` for batches left out, ``sizes`` the batches'
    numbers of cells. Each batch has its own ``n_top`` variable genes and ``k`` components,
    of all its cells. Values above 20 anywhere are taken for counts and log-normalized.
    """
    spark = m.cells.sparkSession
    genes, genes_at = settled(m.genes.select("gene_id").distinct(), "genes", with_path=True)
    column = genes.select("gene_id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_id")) - 1).alias("c"))
    wide = genes.count()
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    entries = m.counts.join(F.broadcast(column), "gene_id", "left").select("cell_id", F.struct(F.coalesce("c", F.lit(-1)).alias("c"), value.alias("x")).alias("e"))
    lists = cells.where("b is not null").join(entries.groupBy("cell_id").agg(F.collect_list("e").alias("e")), "cell_id", "left")
    lists, lists_at = settled(lists.select("b", "t", "e").sortWithinPartitions("b"), "lists", with_path=True)
    top = m.counts.agg(F.max("value").alias("m")).first().m
    scale, several = top is not None and top > 20, len(sizes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, q, v = (np.zeros(several * wide) for _ in range(3))
        for rows in batches:
            b, cell, c, x = _entries(rows, scale)
            at, y = b[cell].astype(np.int64) * wide + c, np.expm1(x)
            np.add.at(s, at, y)
            np.add.at(q, at, y * y)
            np.add.at(v, at, x)
        at = np.flatnonzero((s != 0) | (q != 0) | (v != 0))
        yield pa.RecordBatch.from_arrays([pa.array((at // max(wide, 1)).astype(np.int32)), pa.array((at % max(wide, 1)).astype(np.int32)), pa.array(s[at]), pa.array(q[at]), pa.array(v[at])], names=["batch", "c", "s", "q", "v"])

    found = lists.mapInArrow(sums, "batch int, c int, s double, q double, v double")
    found, sums_at = settled(found.groupBy("batch", "c").agg(*[F.sum(x).alias(x) for x in "sqv"]).join(F.broadcast(column), "c"), "sums", with_path=True)
    n = spark.createDataFrame(list(enumerate(sizes)), "batch int, n long")
    stats = dispersion_of_sums(found.select("batch", "gene_id", "s", "q"), n, genes)
    # two genes of a bin are as far from its mean but for the last digits, which depend on the order of sums
    score = F.round(F.coalesce("normalized", F.lit(0.0)), 9)
    order = F.row_number().over(Window.partitionBy("batch").orderBy(score.desc(), "gene_id"))
    chosen = stats.withColumn("k", order).where(F.col("k") <= n_top).select("batch", "gene_id").join(F.broadcast(column), "gene_id")
    chosen = chosen.join(found.select("batch", "c", "v"), ["batch", "c"], "left").select("batch", "c", F.coalesce("v", F.lit(0.0)).alias("v"))
    place, centre = [np.full(wide, -1, np.int64) for _ in sizes], [np.zeros(0) for _ in sizes]
    picked = chosen.toArrow().to_pandas().sort_values(["batch", "c"])  # the chosen genes of each batch
    for b, part in picked.groupby("batch"):
        place[b][part["c"].to_numpy()] = np.arange(len(part))
        centre[b] = part["v"].to_numpy() / sizes[b]
    shared = spark.sparkContext.broadcast((place, centre))

    def blocks(rows: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Centred dense rows: their batch, their places in ``rows``, values."""
        place, centre = shared.value
        of, cell, c, x = _entries(rows, scale)
        for b in np.unique(of):
            mine, width = np.flatnonzero(of == b), len(centre[b])
            line = np.full(len(of), -1, np.int64)
            line[mine] = np.arange(len(mine))
            at, j = line[cell], place[b][c]
            keep = (at >= 0) & (j >= 0)
            at, j, y = at[keep], j[keep], x[keep]
            step = max(1, _BLOCK // max(width, 1))
            for start in range(0, len(mine), step):
                now = (at >= start) & (at < start + step)
                dense = np.tile(-centre[b], (len(mine[start : start + step]), 1))
                np.add.at(dense, (at[now] - start, j[now]), y[now])
                yield int(b), mine[start : start + step], dense

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the sum of squares of one batch at a time: a file has its batches one after another."""

        def out(b: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["b", "i", "g"])

        last, total = None, None
        for rows in batches:
            for b, _, dense in blocks(rows):
                if b != last:
                    if last is not None:
                        yield out(last, total)
                    last, total = b, 0.0
                total = total + dense.T @ dense
        if last is not None:
            yield out(last, total)

    def added(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(g, float) for g in table.column("g").to_numpy()], axis=0)
        return pa.table({"b": table.column("b").slice(0, 1), "i": table.column("i").slice(0, 1), "g": pa.array([total], pa.list_(pa.float64()))})

    def solved(table: pa.Table) -> pa.Table:
        whole = np.stack(table.sort_by("i").column("g").to_numpy())
        axes = np.linalg.eigh(whole)[1][:, ::-1][:, :k]  # by falling variance
        return pa.table({"b": table.column("b").slice(0, 1), "axes": pa.array([axes.ravel()], pa.list_(pa.float64()))})

    partial = lists.mapInArrow(products, "b int, i int, g array<double>").groupBy("b", "i").applyInArrow(added, "b int, i int, g array<double>")
    axes = {r.b: np.array(r.axes).reshape(len(centre[r.b]), -1) for r in partial.groupBy("b").applyInArrow(solved, "b int, axes array<double>").collect()}
    turned = spark.sparkContext.broadcast(axes)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for b, mine, dense in blocks(rows):
                vec = dense @ turned.value[b]
                d = vec.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vec.size + 1, d), pa.int32()), pa.array(vec.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), b), pa.int32()), rows.column(1).take(pa.array(mine)), lists], names=["b", "t", "vec"])

    scores = settled(lists.where("t is not null").mapInArrow(project, "b int, t int, vec array<double>"), "scores", with_path=True)
    for path in (genes_at, lists_at, sums_at):
        discard(spark, path)
    return scores
