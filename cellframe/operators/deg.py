"""Differential expression between groups of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix, ratio
from ..functions.multiple import bh_adjust
from ..functions.special import t_p_value, z_p_value

PSEUDO = 1e-9


def two_group_stats(m: AnnotatedMatrix, label: str, first: list[str], second: list[str]) -> DataFrame:
    """(gene_id, mean_1, mean_2, var_1, var_2, pct_1, pct_2, log2fc, t_stat, df) of every gene.

    Variances are those of the population (zeros included); groups may overlap. One
    aggregation over the counts: partial sums are made before anything moves.
    """
    m.require(label)
    g1, g2 = F.col(label).isin(first), F.col(label).isin(second)
    flags = m.cells.where(g1 | g2).select("cell_id", F.coalesce(g1, F.lit(False)).alias("g1"), F.coalesce(g2, F.lit(False)).alias("g2"))
    n = flags.agg(F.sum(F.col("g1").cast("long")).alias("n1"), F.sum(F.col("g2").cast("long")).alias("n2"))
    x = F.col("value").cast("double")
    sums = []
    for k in (1, 2):
        flag = F.col(f"g{k}")
        sums += [
            F.sum(F.when(flag, x)).alias(f"s{k}"),
            F.sum(F.when(flag, x * x)).alias(f"q{k}"),
            F.sum(F.when(flag & (x > 0), 1)).alias(f"e{k}"),
        ]
    by_gene = m.counts.join(flags, "cell_id").groupBy("gene_id").agg(*sums)
    full = m.genes.select("gene_id").join(by_gene, "gene_id", "left").crossJoin(F.broadcast(n))
    zero = F.lit(0.0)
    for k in (1, 2):
        size = F.col(f"n{k}")
        mean = ratio(F.coalesce(f"s{k}", zero), size)
        full = full.withColumn(f"mean_{k}", mean)
        full = full.withColumn(
            f"var_{k}", F.greatest(ratio(F.coalesce(f"q{k}", zero), size) - F.col(f"mean_{k}") ** 2, zero)
        ).withColumn(f"pct_{k}", ratio(F.coalesce(f"e{k}", F.lit(0)), size))
    a, b = ratio(F.col("var_1"), F.col("n1")), ratio(F.col("var_2"), F.col("n2"))
    gap = F.col("mean_1") - F.col("mean_2")
    # null where a group has one cell: there the test isn't defined
    freedom = ratio((a + b) ** 2, ratio(a * a, F.col("n1") - 1) + ratio(b * b, F.col("n2") - 1))
    return full.select(
        "gene_id", "mean_1", "mean_2", "var_1", "var_2", "pct_1", "pct_2",
        (gap / math.log(2)).alias("log2fc"), ratio(gap, F.sqrt(a + b)).alias("t_stat"), freedom.alias("df"),
    )


def two_group_deg(m: AnnotatedMatrix, label: str, first: list[str], second: list[str]) -> DataFrame:
    """(gene_id, log2fc, pct_1, pct_2, pval, padj): Welch's test, adjusted over all genes.

    Sorted by adjusted p, ties by gene. A test that isn't defined (no variance in
    either group, a single cell) has p 1.
    """
    stats = two_group_stats(m, label, first, second).withColumn("pval", t_p_value(F.col("t_stat"), F.col("df")))
    return bh_adjust(stats, "pval").select("gene_id", "log2fc", "pct_1", "pct_2", "pval", "padj").orderBy("padj", "gene_id")


def _nested_sides(m: AnnotatedMatrix, cluster: str, condition: str, target: str, reference: str, min_cells: int) -> tuple[DataFrame, DataFrame]:
    """Cells of clusters with enough cells on both sides, and the sides' sizes."""
    m.require(cluster, condition)
    cells = m.cells.where(F.col(condition).isin(target, reference)).select(
        "cell_id", F.col(cluster).alias("cluster"), (F.col(condition) == target).alias("is_target")
    )
    sizes = cells.groupBy("cluster").agg(
        F.sum(F.col("is_target").cast("long")).alias("n_t"), F.sum((~F.col("is_target")).cast("long")).alias("n_r")
    )
    sizes = sizes.where((F.col("n_t") >= min_cells) & (F.col("n_r") >= min_cells))
    return cells.join(F.broadcast(sizes.select("cluster")), "cluster"), sizes


def nested_deg_stats(
    m: AnnotatedMatrix, cluster: str, condition: str, target: str, reference: str,
    method: str = "wilcoxon", min_cells: int = 10, expr_threshold: float = 0.0,
    pct_counts: DataFrame | None = None, tie_correct: bool = False,
) -> DataFrame:
    """(cluster, gene_id, logfc, statistic, df, pct_target, pct_reference) of each tested cluster and gene.

    ``wilcoxon``: ranks are taken among the nonzero values alone. Zeros are one tied
    block below them (values aren't negative), so nothing is made dense. Ranks of one
    gene in one cluster come from windows over ranges of values; a value's tied ranks are
    averaged by value counts, so the windows run over distinct values, not over cells.
    """
    if method not in ("wilcoxon", "t-test"):
        raise ValueError(f"unknown method {method!r}")
    cells, sizes = _nested_sides(m, cluster, condition, target, reference, min_cells)
    x = F.col("value").cast("double")
    t = F.col("is_target")
    keys = ["cluster", "gene_id"]
    values = m.counts.where(F.col("value") != 0).join(cells, "cell_id")
    sums = values.groupBy(*keys).agg(
        F.sum(F.when(t, x)).alias("s_t"), F.sum(F.when(~t, x)).alias("s_r"),
        F.sum(F.when(t, x * x)).alias("q_t"), F.sum(F.when(~t, x * x)).alias("q_r"),
        F.count(F.when(t, 1)).alias("z_t"), F.count(F.when(~t, 1)).alias("z_r"),
    )
    grid = sizes.crossJoin(m.genes.select("gene_id"))
    full = grid.join(sums, keys, "left").fillna(0, ["s_t", "s_r", "q_t", "q_r", "z_t", "z_r"])
    mean_t, mean_r = F.col("s_t") / F.col("n_t"), F.col("s_r") / F.col("n_r")
    logfc = F.log2((F.expm1(mean_t) + PSEUDO) / (F.expm1(mean_r) + PSEUDO))
    n = F.col("n_t") + F.col("n_r")
    if method == "t-test":
        v_t = ratio(F.greatest(F.col("q_t") - mean_t**2 * F.col("n_t"), F.lit(0.0)), F.col("n_t") - 1) / F.col("n_t")
        v_r = ratio(F.greatest(F.col("q_r") - mean_r**2 * F.col("n_r"), F.lit(0.0)), F.col("n_r") - 1) / F.col("n_r")
        statistic = ratio(mean_t - mean_r, F.sqrt(v_t + v_r))
        freedom = ratio((v_t + v_r) ** 2, ratio(v_t**2, F.col("n_t") - 1) + ratio(v_r**2, F.col("n_r") - 1))
    else:
        by_value = values.groupBy(*keys, x.alias("x")).agg(F.count("*").alias("c"), F.count(F.when(t, 1)).alias("c_t"))
        # values are ranked within ranges (64 an octave) behind the counts of lower ranges, so that no
        # gene's distinct values have to meet in one task
        place = F.floor(F.log2(F.abs("x")) * 64)
        by_value = by_value.withColumn("range", F.when(F.col("x") < 0, -place - 200_000).otherwise(place))
        lower = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = by_value.groupBy(*keys, "range").agg(F.sum("c").alias("s"))
        ranges = ranges.withColumn("before", F.coalesce(F.sum("s").over(lower), F.lit(0))).drop("s")
        below = Window.partitionBy(*keys, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
        # rank among nonzeros, tied ranks averaged; the zero block is added per gene below
        rank = F.col("before") + F.coalesce(F.sum("c").over(below), F.lit(0)) + (F.col("c") + 1) / 2.0
        by_value = by_value.join(ranges, [*keys, "range"]).withColumn("r", rank)
        ranks = by_value.groupBy(*keys).agg(
            F.sum(F.col("r") * F.col("c_t")).alias("r_t"),
            F.sum(F.col("c").cast("double") ** 3 - F.col("c")).alias("ties"),
        )
        full = full.join(ranks, keys, "left").fillna(0, ["r_t", "ties"])
        n_zero = n - F.col("z_t") - F.col("z_r")
        rank_sum = F.col("r_t") + F.col("z_t") * n_zero + (F.col("n_t") - F.col("z_t")) * (n_zero + 1) / 2.0
        spread = F.col("n_t") * F.col("n_r") * (n + 1) / 12.0
        if tie_correct:
            ties = F.col("ties") + n_zero.cast("double") ** 3 - n_zero
            spread = spread * (1 - ties / (n.cast("double") ** 3 - n))
        statistic = ratio(rank_sum - F.col("n_t") * (n + 1) / 2.0, F.sqrt(spread))
        freedom = F.lit(None).cast("double")
    out = full.withColumns({"logfc": logfc, "statistic": statistic, "df": freedom})
    pct = _pct_sides(cells, pct_counts if pct_counts is not None else m.counts, expr_threshold)
    out = out.join(pct, keys, "left")
    none = F.lit(0) if expr_threshold >= 0 else F.lit(1)
    for side, size in (("target", "n_t"), ("reference", "n_r")):
        found, rows = F.coalesce(f"e_{side}", F.lit(0)), F.coalesce(f"rows_{side}", F.lit(0))
        out = out.withColumn(f"pct_{side}", (found + (F.col(size) - rows) * none) / F.col(size))
    return out.select("cluster", "gene_id", "logfc", "statistic", "df", "pct_target", "pct_reference")


def _pct_sides(cells: DataFrame, counts: DataFrame, threshold: float) -> DataFrame:
    """Per cluster and gene, on either side: rows found, and those above the threshold."""
    t = F.col("is_target")
    over = F.col("value") > threshold
    return counts.join(cells, "cell_id").groupBy("cluster", "gene_id").agg(
        F.count(F.when(t & over, 1)).alias("e_target"), F.count(F.when(~t & over, 1)).alias("e_reference"),
        F.count(F.when(t, 1)).alias("rows_target"), F.count(F.when(~t, 1)).alias("rows_reference"),
    )


def pct_expressing(m: AnnotatedMatrix, by: str, threshold: float = 0.0) -> DataFrame:
    """(group, gene_id, pct): share of a group's cells strictly above the threshold."""
    m.require(by)
    sizes = m.cells.groupBy(F.col(by).alias("group")).agg(F.count("*").alias("n"))
    found = m.counts.join(m.cells.select("cell_id", F.col(by).alias("group")), "cell_id").groupBy("group", "gene_id").agg(
        F.count(F.when(F.col("value") > threshold, 1)).alias("e"), F.count("*").alias("rows")
    )
    none = 0 if threshold >= 0 else 1
    full = sizes.crossJoin(m.genes.select("gene_id")).join(found, ["group", "gene_id"], "left").fillna(0, ["e", "rows"])
    return full.select("group", "gene_id", ((F.col("e") + (F.col("n") - F.col("rows")) * none) / F.col("n")).alias("pct"))


def nested_deg(
    m: AnnotatedMatrix, cluster: str, condition: str, target: str, reference: str, method: str = "wilcoxon",
    min_cells: int = 10, compute_pct: bool = True, expr_threshold: float = 0.0, pct_counts: DataFrame | None = None,
    tie_correct: bool = False,
) -> DataFrame:
    """(gene_id, logfc, pvals_adj, cluster[, pct_target, pct_reference]), adjusted within clusters.

    Clusters with too few cells on a side are left out; without any the result is empty.
    """
    stats = nested_deg_stats(m, cluster, condition, target, reference, method, min_cells, expr_threshold, pct_counts, tie_correct)
    p: Column = z_p_value(F.col("statistic")) if method == "wilcoxon" else t_p_value(F.col("statistic"), F.col("df"))
    out = bh_adjust(stats.withColumn("pval", p), "pval", ["cluster"], "pvals_adj")
    pct = ["pct_target", "pct_reference"] if compute_pct else []
    return out.orderBy("cluster", F.col("statistic").desc_nulls_last(), "gene_id").select("gene_id", "logfc", "pvals_adj", "cluster", *pct)


def clip_logfc(deg: DataFrame, logfc: str = "logfc", cluster: str = "cluster", quantile: float = 0.95) -> DataFrame:
    """``deg`` with ``logfc`` clipped within clusters.

    The upper bound is 1 where the greatest is at most 1, else the quantile of the
    positive values; the lower bound mirrors it with the negative ones.
    """
    x = F.col(logfc)
    bounds = deg.groupBy(cluster).agg(
        F.when(F.max(x) <= 1, F.lit(1.0)).otherwise(F.percentile(F.when(x > 0, x), quantile)).alias("_high"),
        F.when(F.min(x) >= -1, F.lit(-1.0)).otherwise(F.percentile(F.when(x < 0, x), 1 - quantile)).alias("_low"),
    )
    clipped = F.when(x.isNull(), x).otherwise(F.greatest(F.least(x, F.col("_high")), F.col("_low")))
    joined = deg.join(F.broadcast(bounds), cluster)
    return joined.select(*[clipped.alias(c) if c == logfc else joined[c] for c in deg.columns])


def highlight_genes(
    deg: DataFrame, strategies: tuple[str, ...] = ("topn",), cluster: str = "cluster", gene: str = "gene_id",
    logfc: str = "logfc", top_n: int = 5, k: int = 3, ktimes_poscut: float = 1.0, ktimes_negcut: float = -1.0,
    manual_genes: list[str] | None = None, exclude_genes: list[str] | None = None, exclude_regex: str | None = None,
) -> DataFrame:
    """(cluster, genes): genes to label, an ascending list for every cluster, maybe empty.

    ``manual``: the given genes that a cluster has. ``ktimes``: genes up in at least
    ``k`` rows beyond the upper cut, or down in as many beyond the lower, in each
    cluster where they are beyond that cut. ``topn``: the ``top_n`` largest and
    smallest fold changes, of equal ones the first gene.
    """
    unknown = set(strategies) - {"manual", "ktimes", "topn"}
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    rows = deg.select(F.col(cluster).alias("cluster"), F.col(gene).alias("gene"), F.col(logfc).alias("x"))
    picked = []
    if "manual" in strategies and manual_genes:
        picked.append(rows.where(F.col("gene").isin(manual_genes)).select("cluster", "gene"))
    if "ktimes" in strategies:
        for beyond in (F.col("x") > ktimes_poscut, F.col("x") < ktimes_negcut):
            often = rows.where(beyond).groupBy("gene").count().where(F.col("count") >= k).select("gene")
            picked.append(rows.where(beyond).join(often, "gene", "left_semi").select("cluster", "gene"))
    if "topn" in strategies:
        for order in (F.col("x").desc(), F.col("x").asc()):
            w = Window.partitionBy("cluster").orderBy(order, "gene")
            top = rows.where("x is not null").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top_n)
            picked.append(top.select("cluster", "gene"))
    clusters = rows.select("cluster").distinct()
    if not picked:
        return clusters.withColumn("genes", F.array().cast("array<string>"))
    found = picked[0]
    for more in picked[1:]:
        found = found.unionByName(more)
    if exclude_genes:
        found = found.where(~F.col("gene").isin(exclude_genes))
    if exclude_regex:
        found = found.where(~F.col("gene").rlike(exclude_regex))
    lists = found.groupBy("cluster").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    return clusters.join(lists, "cluster", "left").withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
