"""Analytic Pearson residuals of counts under a negative binomial null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix
from .dense import dense_rows


def diagnose(m: AnnotatedMatrix) -> DataFrame:
    """One row: has_nan_inf and has_negative (numbers of values), zero_genes, zero_cells."""
    x = F.col("value").cast("double")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    values = m.counts.agg(
        F.count(F.when(odd | x.isNull(), 1)).alias("has_nan_inf"), F.count(F.when(x < 0, 1)).alias("has_negative")
    )
    live = m.counts.where(x != 0)
    genes = m.genes.select("gene_id").join(live.select("gene_id").distinct(), "gene_id", "left_anti").agg(F.count("*").alias("zero_genes"))
    cells = m.cells.select("cell_id").join(live.select("cell_id").distinct(), "cell_id", "left_anti").agg(F.count("*").alias("zero_cells"))
    return values.crossJoin(genes).crossJoin(cells)


@dataclass(frozen=True)
class PearsonModel:
    """``statistics``: a row a gene. Transforms matrices over the same genes."""

    theta: float
    clip: float | None
    statistics: DataFrame

    def _z(self, x: Column, mu: Column) -> Column:
        return F.coalesce(F.try_divide(x - mu, F.sqrt(mu + mu * mu / self.theta)), F.lit(0.0))

    def transform(self, m: AnnotatedMatrix) -> DataFrame:
        """(cell_id, gene_id, z) of every cell and gene, clipped.

        The default bound is the root of the number of cells of this matrix. The
        result is dense by its meaning, and made in place: nonzero values are shuffled
        by cell, and each cell's row is spread out beside the genes, whose table is
        small by nature and broadcast.
        """
        genes = self.statistics.select("gene_id", "p").withColumn("column", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_id")) - 1)
        rows = dense_rows(m.cells, m.counts, genes, genes.count()).join(library_depth(m), "cell_id")
        long = rows.select("cell_id", "depth", F.posexplode("row").alias("column", "x")).join(F.broadcast(genes), "column")
        z = self._z(F.col("x"), F.col("depth") * F.col("p"))
        bound = F.lit(float(self.clip)) if self.clip is not None else F.sqrt(F.lit(m.cells.count()).cast("double"))
        return long.select("cell_id", "gene_id", F.greatest(F.least(z, bound), -bound).alias("z"))


def library_depth(m: AnnotatedMatrix) -> DataFrame:
    """(cell_id, depth) of every cell, 0 where it has no counts."""
    sums = m.counts.groupBy("cell_id").agg(F.sum(F.col("value").cast("double")).alias("depth"))
    return m.cells.select("cell_id").join(sums, "cell_id", "left").fillna(0.0, ["depth"])


def fit(m: AnnotatedMatrix, theta: float = 100.0, clip: float | None = None) -> PearsonModel:
    """Gene statistics: p, mean_counts, mean_expected_mu, expected_variance, residual_variance, is_zero_count.

    The variance of the residuals covers all cells without a dense matrix. At zero
    counts a residual depends on the cell's depth alone, so zeros are summed over
    the histogram of depths, and each nonzero value is put in the place of its zero.
    """
    row = m.counts.agg(F.sum(F.col("value").cast("double")).alias("total")).first()
    n = m.cells.count()
    if not row.total or not n:
        raise ValueError("the total of the counts is 0")
    total = float(row.total)
    depth = library_depth(m)
    sums = m.counts.groupBy("gene_id").agg(F.sum(F.col("value").cast("double")).alias("s"))
    genes = m.genes.select("gene_id").join(sums, "gene_id", "left").fillna(0.0, ["s"]).withColumn("p", F.col("s") / total)
    mu = F.col("depth") * F.col("p")
    at_zero = -F.sqrt(mu * theta / (mu + theta))
    histogram = depth.groupBy("depth").agg(F.count("*").alias("h"))
    zeros = histogram.crossJoin(F.broadcast(genes.where("p > 0"))).groupBy("gene_id").agg(
        F.sum(F.col("h") * at_zero).alias("z1"), F.sum(F.col("h") * at_zero * at_zero).alias("z2")
    )
    z = F.coalesce(F.try_divide(F.col("x") - mu, F.sqrt(mu + mu * mu / theta)), F.lit(0.0))
    values = m.counts.groupBy("cell_id", "gene_id").agg(F.sum(F.col("value").cast("double")).alias("x"))
    own = values.join(depth, "cell_id").join(F.broadcast(genes.select("gene_id", "p")), "gene_id").groupBy("gene_id").agg(
        F.sum(z - at_zero).alias("d1"), F.sum(z * z - at_zero * at_zero).alias("d2")
    )
    mean_mu = F.col("p") * F.lit(total / n)
    stats = genes.join(zeros, "gene_id", "left").join(own, "gene_id", "left").fillna(0.0, ["z1", "z2", "d1", "d2"])
    s1, s2 = (F.col("z1") + F.col("d1")) / n, (F.col("z2") + F.col("d2")) / n
    return PearsonModel(
        theta,
        clip,
        stats.select(
            "gene_id", "p", (F.col("s") / n).alias("mean_counts"), mean_mu.alias("mean_expected_mu"),
            (mean_mu + mean_mu * mean_mu / theta).alias("expected_variance"),
            F.greatest(s2 - s1 * s1, F.lit(0.0)).alias("residual_variance"), (F.col("s") == 0).alias("is_zero_count"),
        ),
    )


def fit_transform(m: AnnotatedMatrix, theta: float = 100.0, clip: float | None = None) -> DataFrame:
    return fit(m, theta, clip).transform(m)
