"""One query for each operator, over the driver tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import AnnotatedMatrix, rounded, settled
from ..functions.multiple import bh_adjust
from ..functions.special import chi2_ppf
from ..operators import deg, encoding, graph, metrics, pearson, preprocess, views
from ..sources import tables
from . import datasets
from .adapter import CELLS, COARSE, FINE, LATENT, POINTS, cells, latent, matrix, points, symbols, symbols_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# Integrals from 0 to an argument, by the Gauss-Legendre rule on three panels: engines without special functions can do them.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)
_RULE = ", ".join(f"({(k + (x + 1) / 2) / 3!r}, {w / 6!r})" for k in range(3) for x, w in zip(_NODES.tolist(), _WEIGHTS.tolist(), strict=True))


def _two_sided_sql(table: str, keys: str, argument: str, density: str, extra: str = "") -> str:
    """``p`` (keys, p): 1 less twice the integral of ``density`` in ``u``; 1 where the argument is null."""
    return f"""rule(x, weight) AS (VALUES {_RULE}),
args AS (SELECT {keys}{extra}, least(abs({argument}), 12.0) AS top FROM {table}),
p AS (SELECT {keys}, greatest(1 - 2 * coalesce(sum(weight * top * ({density.replace("{u}", "(x * top)")})), 0), 0) AS p FROM args CROSS JOIN rule GROUP BY {keys})"""


def _adjusted_sql(by: str = "") -> str:
    """``adjusted``: the rows of ``p`` with Benjamini-Hochberg's ``padj``."""
    part = f"PARTITION BY {by} " if by else ""
    whole = f"({part.strip()})"
    return f"""q AS (SELECT *, p * count(*) OVER {whole} / row_number() OVER ({part}ORDER BY p) AS q FROM p),
adjusted AS (SELECT *, least(min(q) OVER ({part}ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0) AS padj FROM q)"""


# ---- differential expression

_GROUPS = ["1-URGENT"], ["2-HIGH", "3-MEDIUM"]
_STATS_SQL = f"""WITH {CELLS}, {FINE},
f AS (SELECT cell_id, cell_type = '1-URGENT' AS g1, cell_type IN ('2-HIGH', '3-MEDIUM') AS g2 FROM cells),
n AS (SELECT CAST(count(*) FILTER (g1) AS DOUBLE) AS n1, CAST(count(*) FILTER (g2) AS DOUBLE) AS n2 FROM f),
s AS (SELECT gene_id, sum(value) FILTER (g1) AS s1, sum(value * value) FILTER (g1) AS q1, count(*) FILTER (g1 AND value > 0) AS e1,
  sum(value) FILTER (g2) AS s2, sum(value * value) FILTER (g2) AS q2, count(*) FILTER (g2 AND value > 0) AS e2
  FROM counts JOIN f USING (cell_id) GROUP BY gene_id),
m AS (SELECT g.gene_id, n1, n2, coalesce(s1, 0) / n1 AS mean_1, coalesce(s2, 0) / n2 AS mean_2,
  greatest(coalesce(q1, 0) / n1 - pow(coalesce(s1, 0) / n1, 2), 0) AS var_1, greatest(coalesce(q2, 0) / n2 - pow(coalesce(s2, 0) / n2, 2), 0) AS var_2,
  coalesce(e1, 0) / n1 AS pct_1, coalesce(e2, 0) / n2 AS pct_2 FROM genes g LEFT JOIN s USING (gene_id) CROSS JOIN n),
t AS (SELECT *, var_1 / n1 AS a, var_2 / n2 AS b FROM m)"""
_T_SQL = """(mean_1 - mean_2) / nullif(sqrt(a + b), 0)"""
_DF_SQL = """(a + b) * (a + b) / nullif(a * a / nullif(n1 - 1, 0) + b * b / nullif(n2 - 1, 0), 0)"""


@query(_STATS_SQL + f""" SELECT gene_id, {_r("mean_1", "mean_1")}, {_r("mean_2", "mean_2")}, {_r("var_1", "var_1")}, {_r("var_2", "var_2")}, {_r("pct_1", "pct_1")},
  {_r("pct_2", "pct_2")}, {_r("(mean_1 - mean_2) / ln(2)", "log2fc")}, {_r(_T_SQL, "t_stat")}, {_r(_DF_SQL, "df")} FROM t""")
def two_group_deg(spark, d):
    found = deg.two_group_stats(matrix(spark, d), "cell_type", *_GROUPS)
    return _round(found, *[c for c in found.columns if c != "gene_id"])


_STUDENT = "exp(lgamma((df + 1) / 2) - lgamma(df / 2) - ln(df * pi()) / 2 - (df + 1) / 2 * ln(1 + {u} * {u} / df))"


def _welch_sql(stats: str) -> str:
    return f"""{stats}, v AS (SELECT *, {_T_SQL} AS t_stat, {_DF_SQL} AS df FROM t),
{_two_sided_sql("v", "gene_id", "CASE WHEN df > 0 THEN t_stat END", _STUDENT, ", df")}, {_adjusted_sql()}
SELECT gene_id, {_r("(mean_1 - mean_2) / ln(2)", "log2fc")}, {_r("pct_1", "pct_1")}, {_r("pct_2", "pct_2")}, {_r("p", "pval", 5)}, {_r("padj", "padj", 5)}
FROM t JOIN adjusted USING (gene_id)"""


@query(_welch_sql(_STATS_SQL))
def two_group_deg_pvalues(spark, d):
    found = deg.two_group_deg(matrix(spark, d), "cell_type", *_GROUPS)
    return _round(_round(found, "log2fc", "pct_1", "pct_2"), "pval", "padj", digits=5)


@query(_welch_sql(_STATS_SQL.replace("cell_type = '1-URGENT' AS g1, cell_type IN ('2-HIGH', '3-MEDIUM') AS g2", "cell_id = (SELECT min(cell_id) FROM cells) AS g1, cell_type = '2-HIGH' AND cell_id <> (SELECT min(cell_id) FROM cells) AS g2")))
def deg_of_one_cell(spark, d):
    """One cell against a group: its variance isn't known, so that no gene differs."""
    m = matrix(spark, d)
    first = m.cells.agg(F.min("cell_id")).first()[0]
    named = m.cells.withColumn("group", F.when(F.col("cell_id") == first, "first").when(F.col("cell_type") == "2-HIGH", "high"))
    found = deg.two_group_deg(AnnotatedMatrix(named, m.genes, m.counts), "group", ["first"], ["high"])
    return _round(_round(found, "log2fc", "pct_1", "pct_2"), "pval", "padj", digits=5)


@query(f"""WITH f AS (SELECT p_partkey, p_brand, ((p_partkey * 7919) % 10007 + 1) / 10008.0 AS p FROM part),
r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p) AS q FROM f)
SELECT p_partkey, p_brand, {_r("least(min(q) OVER (PARTITION BY p_brand ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1.0)", "padj", 9)} FROM r""")
def benjamini_hochberg(spark, d):
    p = ((F.col("p_partkey") * 7919) % 10007 + 1) / 10008.0
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", p.alias("p"))
    return _round(bh_adjust(rows, "p", ["p_brand"]).select("p_partkey", "p_brand", "padj"), "padj", digits=9)


_NESTED = f"""WITH {CELLS}, {COARSE},
c AS (SELECT cell_id, cell_type AS cluster, batch = 'F' AS t FROM cells WHERE batch IN ('F', 'O')),
sizes AS (SELECT cluster, count(*) FILTER (t) AS n_t, count(*) FILTER (NOT t) AS n_r FROM c GROUP BY cluster HAVING count(*) FILTER (t) >= 10 AND count(*) FILTER (NOT t) >= 10),
dense AS (SELECT c.cluster, c.cell_id, c.t, g.gene_id, coalesce(k.value, 0) AS x FROM c JOIN sizes USING (cluster) CROSS JOIN genes g
  LEFT JOIN counts k ON k.cell_id = c.cell_id AND k.gene_id = g.gene_id),
s AS (SELECT cluster, gene_id, avg(x) FILTER (t) AS m_t, avg(x) FILTER (NOT t) AS m_r, var_samp(x) FILTER (t) / count(*) FILTER (t) AS v_t,
  var_samp(x) FILTER (NOT t) / count(*) FILTER (NOT t) AS v_r, avg(CAST(x > 0 AS INT)) FILTER (t) AS pct_target,
  avg(CAST(x > 0 AS INT)) FILTER (NOT t) AS pct_reference FROM dense GROUP BY ALL)"""
_LOGFC = "log2((exp(m_t) - 1 + 1e-9) / (exp(m_r) - 1 + 1e-9))"


_RANK_SUMS = """,
by_value AS (SELECT cluster, gene_id, x, count(*) AS k, count(*) FILTER (t) AS k_t FROM dense GROUP BY ALL),
ranks AS (SELECT *, sum(k) OVER (PARTITION BY cluster, gene_id ORDER BY x) - (k - 1) / 2.0 AS r FROM by_value),
sums AS (SELECT cluster, gene_id, sum(r * k_t) AS rank_sum FROM ranks GROUP BY ALL)"""
_RANK_Z = "(rank_sum - n_t * (n_t + n_r + 1) / 2.0) / sqrt(n_t * n_r * (n_t + n_r + 1) / 12.0)"


@query(_NESTED + _RANK_SUMS + f""" SELECT cluster, gene_id, {_r(_LOGFC, "logfc")}, {_r(_RANK_Z, "statistic")},
  {_r("pct_target", "pct_target")}, {_r("pct_reference", "pct_reference")} FROM sums JOIN s USING (cluster, gene_id) JOIN sizes USING (cluster)""")
def nested_deg_wilcoxon(spark, d):
    found = deg.nested_deg_stats(matrix(spark, d, coarse=True), "cell_type", "batch", "F", "O")
    return _round(found.drop("df"), "logfc", "statistic", "pct_target", "pct_reference")


@query(_NESTED + f"""
SELECT cluster, gene_id, {_r(_LOGFC, "logfc")}, {_r("(m_t - m_r) / nullif(sqrt(v_t + v_r), 0)", "statistic")},
  {_r("(v_t + v_r) * (v_t + v_r) / nullif(v_t * v_t / (n_t - 1) + v_r * v_r / (n_r - 1), 0)", "df", 4)} FROM s JOIN sizes USING (cluster)""")
def nested_deg_t_test(spark, d):
    found = deg.nested_deg_stats(matrix(spark, d, coarse=True), "cell_type", "batch", "F", "O", method="t-test")
    return _round(_round(found.drop("pct_target", "pct_reference"), "logfc", "statistic"), "df", digits=4)


@query(_NESTED + _RANK_SUMS + f""", v AS (SELECT cluster, gene_id, {_RANK_Z} AS z FROM sums JOIN sizes USING (cluster)),
{_two_sided_sql("v", "cluster, gene_id", "z", "exp(-{u} * {u} / 2) / sqrt(2 * pi())")}, {_adjusted_sql("cluster")}
SELECT cluster, gene_id, {_r(_LOGFC, "logfc")}, {_r("padj", "pvals_adj", 5)}, {_r("pct_target", "pct_target")}, {_r("pct_reference", "pct_reference")}
FROM adjusted JOIN s USING (cluster, gene_id)""")
def nested_deg(spark, d):
    found = deg.nested_deg(matrix(spark, d, coarse=True), "cell_type", "batch", "F", "O")
    return _round(_round(found, "logfc", "pct_target", "pct_reference"), "pvals_adj", digits=5)


@query(f"""WITH {CELLS}, {COARSE}, n AS (SELECT cell_type AS "group", count(*) AS n FROM cells GROUP BY 1),
e AS (SELECT cell_type AS "group", gene_id, count(*) FILTER (value > 10) AS e FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2)
SELECT n."group", g.gene_id, {_r("coalesce(e, 0) / n", "pct")} FROM n CROSS JOIN genes g LEFT JOIN e ON e."group" = n."group" AND e.gene_id = g.gene_id""")
def pct_expressing(spark, d):
    return _round(deg.pct_expressing(matrix(spark, d, coarse=True), "cell_type", 10.0), "pct")


def _deg_table(spark, d) -> DataFrame:
    """(cluster, gene_id, logfc, padj): made of group means, for operators on such tables."""
    stats = views.group_stats(matrix(spark, d, coarse=True), "cell_type")
    x = rounded(20 * (F.col("mean") - F.avg("mean").over(Window.partitionBy("gene_id"))), 6)
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("group", "gene_id"))
    return stats.select(F.col("group").alias("cluster"), "gene_id", x.alias("logfc"), ((k * 7919) % 1000 / 1000.0).alias("padj"))


_GROUP_STATS = """n AS (SELECT cell_type AS "group", count(*) AS n FROM cells GROUP BY 1),
gs AS (SELECT cell_type AS "group", gene_id, sum(value) AS s, count(*) FILTER (value > 0) AS e FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2),
stats AS (SELECT n."group", g.gene_id, coalesce(s, 0) / n AS mean, coalesce(e, 0) / n * 100 AS pct FROM n CROSS JOIN genes g
  LEFT JOIN gs ON gs."group" = n."group" AND gs.gene_id = g.gene_id)"""
_DEG = f"""WITH {CELLS}, {COARSE}, {_GROUP_STATS},
deg AS (SELECT "group" AS cluster, gene_id, round(20 * (mean - avg(mean) OVER (PARTITION BY gene_id)), 6) AS logfc,
  (row_number() OVER (ORDER BY "group", gene_id) * 7919) % 1000 / 1000.0 AS padj FROM stats)"""


@query(f"""{_DEG}, b AS (SELECT cluster, CASE WHEN max(logfc) <= 1 THEN 1.0 ELSE quantile_cont(logfc, 0.95) FILTER (logfc > 0) END AS high,
  CASE WHEN min(logfc) >= -1 THEN -1.0 ELSE quantile_cont(logfc, 0.05) FILTER (logfc < 0) END AS low FROM deg GROUP BY cluster)
SELECT cluster, gene_id, {_r("greatest(least(logfc, high), low)", "logfc", 9)} FROM deg JOIN b USING (cluster)""")
def clip_logfc(spark, d):
    return _round(deg.clip_logfc(_deg_table(spark, d)).select("cluster", "gene_id", "logfc"), "logfc", digits=9)


@query(f"""{_DEG}, picked AS (
  SELECT cluster, gene_id FROM deg WHERE gene_id IN ('Brand#11', 'Brand#55')
  UNION SELECT cluster, gene_id FROM deg WHERE logfc > 0.5 AND gene_id IN (SELECT gene_id FROM deg WHERE logfc > 0.5 GROUP BY 1 HAVING count(*) >= 2)
  UNION SELECT cluster, gene_id FROM deg WHERE logfc < -0.5 AND gene_id IN (SELECT gene_id FROM deg WHERE logfc < -0.5 GROUP BY 1 HAVING count(*) >= 2)
  UNION SELECT cluster, gene_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY logfc DESC, gene_id) AS u,
    row_number() OVER (PARTITION BY cluster ORDER BY logfc, gene_id) AS v FROM deg) WHERE u <= 3 OR v <= 3)
SELECT c.cluster, coalesce(string_agg(gene_id, ',' ORDER BY gene_id), '') AS genes FROM (SELECT DISTINCT cluster FROM deg) c
LEFT JOIN (SELECT * FROM picked WHERE gene_id <> 'Brand#12' AND NOT regexp_matches(gene_id, '#3[12]$')) p USING (cluster) GROUP BY c.cluster""")
def highlight_genes(spark, d):
    found = deg.highlight_genes(
        _deg_table(spark, d), ("manual", "ktimes", "topn"), top_n=3, k=2, ktimes_poscut=0.5, ktimes_negcut=-0.5,
        manual_genes=["Brand#11", "Brand#55"], exclude_genes=["Brand#12"], exclude_regex="#3[12]$",
    )
    return found.withColumn("genes", F.concat_ws(",", "genes"))


@query(f"""{_DEG} SELECT cluster, gene_id, {_r("-log10(CASE WHEN padj = 0 THEN 1e-300 ELSE padj END)", "neg_log10_padj")},
  CASE WHEN padj < 0.5 AND logfc > 0.5 THEN 'Up' WHEN padj < 0.5 AND logfc < -0.5 THEN 'Down' ELSE 'NS' END AS status FROM deg""")
def volcano(spark, d):
    return _round(views.volcano(_deg_table(spark, d), lfc_thr=0.5, p_thr=0.5), "neg_log10_padj").select("cluster", "gene_id", "neg_log10_padj", "status")


@query(f"""{_DEG}, h AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY logfc DESC, gene_id) AS u,
  row_number() OVER (PARTITION BY cluster ORDER BY logfc, gene_id) AS v FROM deg),
i AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS x_idx FROM deg GROUP BY cluster)
SELECT cluster, gene_id AS gene, x_idx, {_r("greatest(least(logfc, 0.5), -0.5)", "y")}, CASE WHEN logfc > 0 THEN 'up' ELSE 'down' END AS direction,
  u <= 2 OR v <= 2 AS is_label FROM h JOIN i USING (cluster) WHERE logfc <> 0""")
def deg_jitter(spark, d):
    table = _deg_table(spark, d)
    found = views.jitter_table(table, highlight=deg.highlight_genes(table, top_n=2), vrange=(-0.5, 0.5))
    return _round(found.drop("x"), "y")


# ---- residuals

@query(f"""WITH {CELLS}, {FINE} SELECT (SELECT count(*) FROM counts WHERE isnan(value) OR isinf(value) OR value IS NULL) AS has_nan_inf,
  (SELECT count(*) FROM counts WHERE value < 0) AS has_negative,
  (SELECT count(*) FROM genes WHERE gene_id NOT IN (SELECT gene_id FROM counts WHERE value <> 0)) AS zero_genes,
  (SELECT count(*) FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM counts WHERE value <> 0)) AS zero_cells""")
def pearson_diagnose(spark, d):
    return pearson.diagnose(matrix(spark, d))


_RESIDUALS = f"""WITH {CELLS}, {COARSE}, depth AS (SELECT cell_id, coalesce(sum(value), 0) AS depth FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1),
total AS (SELECT sum(value) AS total FROM counts), p AS (SELECT gene_id, coalesce(sum(value), 0) AS s FROM genes LEFT JOIN counts USING (gene_id) GROUP BY 1),
dense AS (SELECT d.cell_id, p.gene_id, p.s, s / total AS p, coalesce(value, 0) AS x, depth * s / total AS mu FROM depth d CROSS JOIN p CROSS JOIN total
  LEFT JOIN counts k ON k.cell_id = d.cell_id AND k.gene_id = p.gene_id),
z AS (SELECT *, CASE WHEN mu = 0 THEN 0 ELSE (x - mu) / sqrt(mu + mu * mu / 100.0) END AS z FROM dense)"""


@query(_RESIDUALS + f""" SELECT gene_id, {_r("any_value(p)", "p", 9)}, {_r("avg(x)", "mean_counts")}, {_r("avg(mu)", "mean_expected_mu")},
  {_r("avg(mu) + avg(mu) * avg(mu) / 100.0", "expected_variance")}, {_r("var_pop(z)", "residual_variance")}, any_value(s) = 0 AS is_zero_count FROM z GROUP BY gene_id""")
def pearson_fit(spark, d):
    found = pearson.fit(matrix(spark, d, coarse=True)).statistics
    return _round(_round(found, "p", digits=9), "mean_counts", "mean_expected_mu", "expected_variance", "residual_variance")


@query(_RESIDUALS + f""", c AS (SELECT cell_id, greatest(least(z, 5.0), -5.0) AS z, CAST(substr(gene_id, 7) AS INTEGER) AS k FROM z)
SELECT cell_id, count(*) AS n, {_r("sum(z)", "total", 5)}, {_r("sum(z * z)", "squares", 5)}, {_r("sum(z * k) / 100", "weighted", 5)} FROM c GROUP BY cell_id""")
def pearson_transform(spark, d):
    """A row a cell; the gene's number weighs each of its residuals, so that none may be wrong or misplaced."""
    z, k = F.col("z"), F.substring("gene_id", 7, 2).cast("int")
    found = pearson.fit_transform(matrix(spark, d, coarse=True), clip=5.0).groupBy("cell_id").agg(
        F.count("*").alias("n"), F.sum(z).alias("total"), F.sum(z * z).alias("squares"), (F.sum(z * k) / 100).alias("weighted")
    )
    return _round(found, "total", "squares", "weighted", digits=5)


# ---- plot tables

@query(f"""WITH {CELLS}, {COARSE}, {_GROUP_STATS} SELECT "group", gene_id, {_r("pct", "pct")},
  {_r("(mean - avg(mean) OVER (PARTITION BY gene_id)) / (stddev_samp(mean) OVER (PARTITION BY gene_id) + 1e-9)", "color", 5)} FROM stats""")
def dotplot_data(spark, d):
    return _round(_round(views.dotplot_data(matrix(spark, d, coarse=True), "cell_type"), "pct"), "color", digits=5)


@query(f"""WITH {CELLS}, {COARSE}, {_GROUP_STATS}, c AS (SELECT max(abs((mean - avg_) / (sd + 1e-9))) AS v FROM (SELECT mean,
  avg(mean) OVER (PARTITION BY gene_id) AS avg_, stddev_samp(mean) OVER (PARTITION BY gene_id) AS sd FROM stats)) SELECT {_r("-v", "vmin", 5)}, {_r("v", "vmax", 5)} FROM c""")
def dotplot_color_limits(spark, d):
    return _round(views.color_limits(views.dotplot_data(matrix(spark, d, coarse=True), "cell_type")), "vmin", "vmax", digits=5)


_DOT_GENES = [f"Brand#{i}{j}" for i in (5, 1, 3) for j in (2, 1, 5)]
_DOTS = f"""WITH {CELLS}, {COARSE}, {_GROUP_STATS}, lim AS (SELECT avg(m) AS cut FROM (SELECT max(mean) AS m FROM stats GROUP BY gene_id)),
dots AS (SELECT "group" AS "Cluster", gene_id AS "Gene", mean AS "AvgExp", pct AS "Pct" FROM (SELECT *, max(mean) OVER (PARTITION BY gene_id) AS mm,
  max(pct) OVER (PARTITION BY gene_id) AS mp FROM stats WHERE gene_id IN ({", ".join(f"'{g}'" for g in _DOT_GENES)})) WHERE (mm >= 4 AND mp >= 10) OR gene_id = 'Brand#52')"""


def _dots(spark, d) -> DataFrame:
    return views.dotplot_table(matrix(spark, d, coarse=True), [*_DOT_GENES, "Brand#99"], "cell_type", 4.0, 10.0, ["Brand#52"])


@query(_DOTS + f""" SELECT "Cluster", "Gene", {_r('"AvgExp"', '"AvgExp"')}, {_r('"Pct"', '"Pct"')} FROM dots""")
def dotplot_table(spark, d):
    return _round(_dots(spark, d), "AvgExp", "Pct")


@query(_DOTS + f""", g AS (SELECT "Gene", row_number() OVER (ORDER BY list_position([{", ".join(f"'{g}'" for g in _DOT_GENES)}], "Gene")) - 1 AS k,
  count(*) OVER () AS n FROM (SELECT DISTINCT "Gene" FROM dots)), a AS (SELECT "Gene", -60 + k * 120.0 / greatest(n - 1, 1) AS deg FROM g),
f AS (SELECT *, 90 - deg AS turn, dense_rank() OVER (ORDER BY "Cluster") + 9 AS r FROM dots JOIN a USING ("Gene"))
SELECT "Cluster", "Gene", {_r('"AvgExp"', '"AvgExp"')}, {_r("radians(deg)", "theta")}, r, {_r('"Pct" * 2.5', "size")},
  {_r("CASE WHEN turn > 90 AND turn <= 270 THEN turn - 180 WHEN turn > 270 THEN turn - 360 WHEN turn < -90 THEN turn + 180 ELSE turn END", "rotation")},
  CASE WHEN (turn > 90 AND turn <= 270) OR turn < -90 THEN 'right' ELSE 'left' END AS side FROM f""")
def fan_layout(spark, d):
    return _round(views.fan_layout(_dots(spark, d), _DOT_GENES), "AvgExp", "theta", "size", "rotation")


_TAB = f"""WITH {CELLS}, t AS (SELECT r."row", c."column", coalesce(n, 0) AS n FROM (SELECT DISTINCT tissue AS "row" FROM cells) r
CROSS JOIN (SELECT DISTINCT batch AS "column" FROM cells) c LEFT JOIN (SELECT tissue AS "row", batch AS "column", count(*) AS n FROM cells GROUP BY 1, 2) USING ("row", "column"))"""


@query(_TAB + " SELECT * FROM t")
def crosstab(spark, d):
    return views.crosstab(cells(spark, d), "tissue", "batch")


@query(_TAB + f""", s AS (SELECT *, n / sum(n) OVER (PARTITION BY "row") AS pct FROM t),
b AS (SELECT *, coalesce(sum(pct) OVER (PARTITION BY "row" ORDER BY "column" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM s)
SELECT "row" AS kind, "column" AS "group", n, {_r("pct", "value")}, {_r("base + pct / 2", "center")}, {_r("pct", "pct")},
  CAST(n AS VARCHAR) || chr(10) || '(' || printf('%.1f', pct * 100) || '%)' AS label, pct < 0.03 AS is_small FROM b WHERE n > 0""")
def stacked_bars(spark, d):
    return _round(views.stacked_bars(cells(spark, d), "batch", "tissue", label="both"), "value", "center", "pct")


@query(f"""WITH {LATENT} SELECT cell_type AS color, {_r("median(vec[1])", "dim1")}, {_r("median(vec[2])", "dim2")}, count(*) AS n FROM latent GROUP BY 1""")
def embedding_centroids(spark, d):
    v = latent(spark, d)
    return _round(views.centroids(views.embedding_points(v, v, "cell_type")), "dim1", "dim2")


_SILVERMAN = "0.9 * least(stddev_samp({0}), (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)) / 1.34) * pow(count(*), -0.2)"


@query(f"""WITH {LATENT}, {POINTS} SELECT {", ".join(_r(_SILVERMAN.format(c), c) for c in "xyz")} FROM points""")
def silverman_bandwidth(spark, d):
    return _round(views.silverman(points(spark, d), ["x", "y", "z"]), "x", "y", "z")


def _density_sql(axes: str, n: int) -> str:
    ends = ", ".join(f"min({c}) AS l{c}, max({c}) AS u{c}, {_SILVERMAN.format(c)} AS h{c}" for c in axes)
    names = dict(zip(axes, "ijk", strict=False))
    grids = " CROSS JOIN ".join(f"range({n}) g{c}({names[c]})" for c in axes)
    kernel = " * ".join(f"exp(-0.5 * pow((l{c} + {names[c]} * (u{c} - l{c}) / {n - 1} - {c}) / h{c}, 2)) / sqrt(2 * pi())" for c in axes)
    scale = " * ".join(f"any_value(h{c})" for c in axes)
    keys = ", ".join(names[c] for c in axes)
    ints = ", ".join(f"CAST({names[c]} AS INTEGER) AS {names[c]}" for c in axes)
    return f"""WITH {LATENT}, {POINTS}, e AS (SELECT {ends} FROM points),
grid AS (SELECT {keys}, sum(w * {kernel}) / (sum(w) * {scale}) AS z FROM points CROSS JOIN e CROSS JOIN {grids} GROUP BY {keys})
SELECT {ints}, {_r("z", "z", 5)} FROM grid"""


@query(_density_sql("xy", 20))
def density_2d(spark, d):
    return _round(views.weighted_density(points(spark, d), ["x", "y"], "w", n=20), "z", digits=5)


@query(_density_sql("xyz", 6))
def density_3d(spark, d):
    return _round(views.weighted_density(points(spark, d), ["x", "y", "z"], "w", n=6), "z", digits=5)


def _node_sql(c: str, n: int) -> str:
    """The node of a grid at or below a point, as the grid's own sums have it."""
    node = lambda k: f"CASE WHEN {k} >= {n - 1} THEN u{c} ELSE l{c} + {k} * ((u{c} - l{c}) / {n - 1}) END"
    guess = f"floor(({c} - l{c}) / ((u{c} - l{c}) / {n - 1}))"
    return f"""least(greatest({guess} + CASE WHEN {guess} < {n - 1} AND {node(f"({guess} + 1)")} <= {c} THEN 1 WHEN {node(guess)} > {c} THEN -1 ELSE 0 END, 0), {n - 1})"""


@query(_density_sql("xy", 50).rsplit("SELECT", 1)[0] + f"""SELECT cell_id, {_r("z", "density", 5)} FROM
(SELECT cell_id, CAST({_node_sql("x", 50)} AS BIGINT) AS i, CAST({_node_sql("y", 50)} AS BIGINT) AS j FROM points CROSS JOIN e) JOIN (SELECT i, j, z FROM grid) USING (i, j)""")
def cell_density(spark, d):
    return _round(views.cell_density(points(spark, d), ["x", "y"], "w", n=50).select("cell_id", "density"), "density", digits=5)


# ---- preprocessing

_DEPTH = "depth AS (SELECT cell_id, coalesce(sum(value), 0.0) AS depth FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1)"


@query(f"WITH {CELLS}, {FINE}, {_DEPTH} SELECT * FROM depth")
def library_size(spark, d):
    return pearson.library_depth(matrix(spark, d))


@query(f"""WITH {CELLS}, {FINE}, {_DEPTH} SELECT cell_id, gene_id, {_r("ln(1 + value * (10000.0 / CASE WHEN depth = 0 THEN 1 ELSE depth END))", "value")}
FROM counts JOIN depth USING (cell_id)""")
def normalize_log1p(spark, d):
    return _round(preprocess.normalize(matrix(spark, d)), "value")


@query(f"""WITH {CELLS}, {FINE}, {_DEPTH}, t AS (SELECT median(depth) AS target FROM depth WHERE depth > 0)
SELECT cell_id, gene_id, {_r("ln(1 + value * (target / depth))", "value")} FROM counts JOIN depth USING (cell_id) CROSS JOIN t""")
def normalize_median(spark, d):
    return _round(preprocess.normalize(matrix(spark, d), None), "value")


@query(f"""WITH {FINE} SELECT bool_and(abs(value - round(value)) < 1e-6) AND min(value) >= 0 AS ok, min(value) AS minimum, max(value) AS maximum,
  avg(CAST(abs(value - round(value)) < 1e-6 AS DOUBLE)) AS fraction_integer FROM counts""")
def validate_counts(spark, d):
    return preprocess.validate_values(matrix(spark, d).counts, "counts")


@query(f"WITH {CELLS}, {FINE} SELECT (SELECT count(*) FROM cells) AS n_obs, (SELECT count(*) FROM genes) AS n_vars, (SELECT count(*) FROM counts WHERE value <> 0) AS nnz")
def matrix_shape(spark, d):
    return preprocess.matrix_shape(matrix(spark, d))


def _pattern(species: str, **remove: bool) -> str:
    return preprocess.active_pattern(species, **remove).replace("'", "''")


@query(f"WITH {symbols_sql()} SELECT gene_pos, gene_name, highly_variable AND NOT regexp_matches(gene_name, '{_pattern('human')}') AS highly_variable FROM symbols")
def mask_human_genes(spark, d):
    return preprocess.filter_genes(symbols(spark), "human")


@query(f"WITH {symbols_sql()} SELECT * FROM symbols WHERE NOT regexp_matches(gene_name, '{_pattern('mouse', ribosomal=True)}')")
def drop_mouse_genes(spark, d):
    return preprocess.filter_genes(symbols(spark), "mouse", mask_hvg_only=False, ribosomal=True)


@query(f"WITH {symbols_sql()} SELECT * FROM symbols WHERE NOT regexp_matches(gene_name, '{_pattern('rat', histone=True)}')")
def drop_rat_genes(spark, d):
    return preprocess.filter_genes(symbols(spark), "rat", mask_hvg_only=False, histone=True)


@query(f"WITH {symbols_sql()}, p(category, pattern) AS (VALUES {', '.join(f'''('{c}', '{x}')''' for c, x in preprocess.BACKGROUND.items())}) "
       "SELECT category, string_agg(gene_name, ',' ORDER BY gene_name) AS genes FROM symbols JOIN p ON regexp_matches(gene_name, pattern) GROUP BY category")
def background_genes(spark, d):
    return preprocess.background_genes(symbols(spark)).withColumn("genes", F.concat_ws(",", "genes"))


@query(f"WITH {symbols_sql()}, k AS (SELECT *, row_number() OVER (PARTITION BY gene_name ORDER BY gene_pos) - 1 AS k FROM symbols) "
       "SELECT gene_pos, CASE WHEN k = 0 THEN gene_name ELSE gene_name || '-' || CAST(k AS VARCHAR) END AS gene_name, highly_variable FROM k")
def unique_gene_names(spark, d):
    return preprocess.unique_names(symbols(spark))


@query("SELECT p_partkey AS gene_id, p_partkey AS gene_pos, row_number() OVER (ORDER BY p_partkey) - 1 AS \"column\" FROM part WHERE p_size > 25")
def resolve_genes(spark, d):
    genes = spark.read.parquet(f"{d}/part.parquet").select(
        F.col("p_partkey").alias("gene_id"), F.col("p_partkey").alias("gene_pos"), F.col("p_name").alias("gene_name"), (F.col("p_size") > 25).alias("chosen")
    )
    return preprocess.resolve_genes(genes, gene_col="chosen").select("gene_id", "gene_pos", "column")


@query("SELECT p_partkey AS gene_id, p_type AS gene_name, p_size > 40 AS highly_variable FROM part")
def build_genes(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    genes = part.select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), F.col("p_type").alias("feature_name"))
    chosen = part.where("p_size > 40").select(F.col("p_partkey").alias("gene_id"))
    return preprocess.build_genes(genes, chosen).select("gene_id", "gene_name", "highly_variable")


@query(f"""WITH {CELLS}, {FINE}, {_DEPTH} SELECT cell_id, cell_type, batch, tissue, 'demo' AS dataset, depth AS library_size, total AS price FROM cells JOIN depth USING (cell_id)""")
def standardize_cells(spark, d):
    m = matrix(spark, d)
    return preprocess.standardize_cells(m.cells, pearson.library_depth(m), "cell_type", "batch", "demo", {"total": "price", "absent": "x"})


def _quota_sql(table: str, size: str, total: str, name: str) -> str:
    """Largest remainders in SQL: ``table`` has stratum and ``size``; ties to the later name."""
    return f"""(SELECT *, CAST(floor(share) AS BIGINT) + CAST(row_number() OVER (ORDER BY share - floor(share) DESC, stratum DESC)
      <= {total} - sum(floor(share)) OVER () AS BIGINT) AS {name} FROM (SELECT *, {size} * CAST({total} AS DOUBLE) / sum({size}) OVER () AS share FROM {table}))"""


_SPLIT_SQL = f"""WITH {CELLS}, sizes AS (SELECT cell_type || tissue AS stratum, count(*) AS n FROM cells GROUP BY 1),
u AS (SELECT * FROM sizes WHERE n > 1), ut AS (SELECT *, CAST(ceil(round(sum(n) OVER () * 0.15, 9)) AS BIGINT) AS total FROM u),
held AS (SELECT stratum, held FROM {_quota_sql("ut", "n", "total", "held")}),
h2 AS (SELECT *, CAST(ceil(round(sum(held) OVER () * (0.05 / 0.15), 9)) AS BIGINT) AS total FROM held WHERE held > 1),
test AS (SELECT stratum, test FROM {_quota_sql("h2", "held", "total", "test")}),
r AS (SELECT cell_id, cell_type || tissue AS stratum, row_number() OVER (PARTITION BY cell_type || tissue ORDER BY md5('42:' || CAST(cell_id AS VARCHAR)), cell_id) AS rank FROM cells)
SELECT cell_id, CASE WHEN rank <= coalesce(test, 0) THEN 'test' WHEN rank <= coalesce(held, 0) THEN 'val' ELSE 'train' END AS split
FROM r LEFT JOIN held USING (stratum) LEFT JOIN test USING (stratum)"""


def _with_stratum(spark, d) -> DataFrame:
    return cells(spark, d).withColumn("stratum", F.concat("cell_type", "tissue"))


@query(_SPLIT_SQL)
def stratified_split(spark, d):
    return preprocess.stratified_split(_with_stratum(spark, d), "stratum", 0.1, 0.05)


@query(f"""WITH {CELLS}, sizes AS (SELECT batch || tissue AS stratum, count(*) AS n FROM cells GROUP BY 1), small AS (SELECT stratum, n AS quota FROM sizes WHERE n <= 100),
big AS (SELECT *, 1000 - (SELECT coalesce(sum(quota), 0) FROM small) AS total FROM sizes WHERE n > 100),
q AS (SELECT * FROM small UNION ALL SELECT stratum, quota FROM {_quota_sql("big", "n", "total", "quota")}),
r AS (SELECT cell_id, batch || tissue AS stratum, row_number() OVER (PARTITION BY batch || tissue ORDER BY md5('42:' || CAST(cell_id AS VARCHAR)), cell_id) AS rank FROM cells)
SELECT cell_id FROM r JOIN q USING (stratum) WHERE rank <= quota""")
def hvg_sample(spark, d):
    rows = cells(spark, d).withColumn("stratum", F.concat("batch", "tissue"))
    return preprocess.hvg_sample(rows, "stratum", target_size=1000)


@query("SELECT o_orderkey AS cell_id FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 700")
def subsample_cells(spark, d):
    return preprocess.subsample(cells(spark, d), 700)


_DISPERSION = f"""WITH {CELLS}, {FINE}, {_DEPTH}, t AS (SELECT median(depth) AS target FROM depth WHERE depth > 0),
y AS (SELECT cell_id, gene_id, value * (target / depth) AS y FROM counts JOIN depth USING (cell_id) CROSS JOIN t),
n AS (SELECT batch, count(*) AS n FROM cells GROUP BY 1), s AS (SELECT batch, gene_id, sum(y) AS s, sum(y * y) AS q FROM y JOIN cells USING (cell_id) GROUP BY 1, 2),
f AS (SELECT n.batch, g.gene_id, coalesce(s, 0) / n AS m, greatest((coalesce(q, 0) - n * pow(coalesce(s, 0) / n, 2)) / (n - 1), 0) AS v
  FROM n CROSS JOIN genes g LEFT JOIN s ON s.batch = n.batch AND s.gene_id = g.gene_id),
l AS (SELECT batch, gene_id, ln(1 + m) AS mean, CASE WHEN v > 0 THEN ln(v / CASE WHEN m = 0 THEN 1e-12 ELSE m END) END AS dispersion FROM f),
b AS (SELECT *, greatest(least(ceil(round(coalesce((mean - min(mean) OVER w) * 20 / nullif(max(mean) OVER w - min(mean) OVER w, 0), 0), 9)), 20), 1) AS bin FROM l WINDOW w AS (PARTITION BY batch)),
z AS (SELECT batch, gene_id, mean, dispersion, CASE WHEN count(dispersion) OVER w <= 1 THEN CASE WHEN dispersion IS NOT NULL THEN 1.0 END
  ELSE (dispersion - avg(dispersion) OVER w) / nullif(stddev_samp(dispersion) OVER w, 0) END AS normalized FROM b WINDOW w AS (PARTITION BY batch, bin)),
a AS (SELECT gene_id, avg(mean) AS mean, avg(dispersion) AS dispersion, avg(coalesce(normalized, 0)) AS normalized FROM z GROUP BY 1)"""


@query(_DISPERSION + f""" SELECT gene_id, {_r("mean", "mean", 5)}, {_r("dispersion", "dispersion", 5)}, {_r("normalized", "normalized", 4)},
  coalesce(mean > 0.0125 AND mean < 3 AND normalized > 0.5, false) AS highly_variable FROM a""")
def variable_genes(spark, d):
    return _round(_round(preprocess.variable_genes(matrix(spark, d), "batch"), "mean", "dispersion", digits=5), "normalized", digits=4)


@query(_DISPERSION + " SELECT gene_id FROM a ORDER BY normalized DESC, gene_id LIMIT 50")
def variable_genes_top(spark, d):
    return preprocess.variable_genes(matrix(spark, d), "batch", top=50).where("highly_variable").select("gene_id")


def _components_sql(k: int) -> str:
    """Eigenvectors by squaring the covariance again and again, and taking each found one out of it."""
    parts = []
    for i in range(k):
        source = "cov" if i == 0 else f"c{i}"
        parts.append(f"""p{i} AS (SELECT 0 AS step, m AS a FROM {source} UNION ALL SELECT step + 1,
  list_transform(a, lambda r: list_transform(a, lambda c: list_dot_product(r, c) / list_sum(list_transform(a, lambda t: list_dot_product(t, t))))) FROM p{i} WHERE step < 18),
g{i} AS (SELECT list_transform(a, lambda r: [sqrt(list_dot_product(r, r))] || r) AS rows FROM p{i} WHERE step = 18),
b{i} AS (SELECT list_transform(list_max(rows)[2:], lambda x: x / list_max(rows)[1]) AS v FROM g{i}),
w{i} AS (SELECT v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l FROM b{i} CROSS JOIN {source}),
c{i + 1} AS (SELECT list_transform(m, lambda r, n: list_transform(r, lambda x, o: x - l * v[n] * v[o])) AS m FROM {source} CROSS JOIN w{i})""")
    return ",\n".join(parts)


@query(f"""WITH RECURSIVE {CELLS}, {COARSE}, {_DEPTH}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM cells),
g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) AS k FROM genes),
y AS (SELECT cell_id, k, ln(1 + value * (10000.0 / CASE WHEN depth = 0 THEN 1 ELSE depth END)) AS y FROM counts JOIN depth USING (cell_id) JOIN g USING (gene_id)),
mean AS (SELECT k, coalesce(sum(y), 0) / any_value(n) AS m FROM g LEFT JOIN y USING (k) CROSS JOIN n GROUP BY k),
prod AS (SELECT a.k AS i, b.k AS j, sum(a.y * b.y) AS s FROM y a JOIN y b USING (cell_id) GROUP BY 1, 2),
entries AS (SELECT a.k AS i, b.k AS j, (coalesce(s, 0) - n * a.m * b.m) / (n - 1) AS x FROM mean a CROSS JOIN mean b CROSS JOIN n LEFT JOIN prod ON i = a.k AND j = b.k),
cov AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(x ORDER BY j) AS r FROM entries GROUP BY i)),
{_components_sql(5)},
centre AS (SELECT list(m ORDER BY k) AS c FROM mean),
dense AS (SELECT c.cell_id, k, coalesce(y, 0) AS x FROM cells c CROSS JOIN g LEFT JOIN y USING (cell_id, k)),
x AS (SELECT cell_id, list(x ORDER BY k) AS x FROM dense GROUP BY cell_id)
SELECT cell_id, {", ".join(_r(f"abs(list_dot_product(x, w{i}.v) - list_dot_product(c, w{i}.v))", f"c{i}", 4) for i in range(5))} FROM x CROSS JOIN centre {" ".join(f"CROSS JOIN w{i}" for i in range(5))}""")
def principal_components(spark, d):
    """Scores without their sign, which is anyone's choice."""
    m = matrix(spark, d, coarse=True)
    found = preprocess.principal_components(m, preprocess.normalize(m), m.genes, 5)
    return found.select("cell_id", *[rounded(F.abs(F.get("vec", F.lit(k))), 4).alias(f"c{k}") for k in range(5)])


@query(f"""WITH {CELLS}, {FINE}, {_DEPTH},
sp AS (SELECT *, CASE batch WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'none' END AS split FROM cells JOIN depth USING (cell_id)),
nz AS (SELECT split, count(*) AS nnz FROM counts JOIN sp USING (cell_id) WHERE value <> 0 GROUP BY 1)
SELECT s.split, coalesce(count(cell_id), 0) AS n_cells, coalesce({"round(avg(depth), 6)"}, 0) AS library_size_mean, coalesce(median(depth), 0) AS library_size_median,
  coalesce(any_value(nnz), 0) AS nnz_counts, coalesce(any_value(nnz), 0) AS nnz_normalized
FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN sp USING (split) LEFT JOIN nz USING (split) GROUP BY s.split""")
def split_stats(spark, d):
    m = matrix(spark, d)
    split = F.when(F.col("batch") == "F", "train").when(F.col("batch") == "O", "val").otherwise("none")
    named = m.cells.join(pearson.library_depth(m).withColumnRenamed("depth", "library_size"), "cell_id").withColumn("split", split)
    return _round(preprocess.split_stats(named, m.counts, preprocess.normalize(m)), "library_size_mean")


# ---- encoding and datasets

def _schema(spark, d) -> encoding.ConditionSchema:
    specs = [*encoding.parse_categorical("batch:onehot"), *encoding.parse_categorical("tissue:groupmean(total:log1p, total)")]
    return encoding.build_schema(cells(spark, d), [encoding.parse_numerical("total:log1p:zscore"), encoding.parse_numerical("total")], specs)


@query(f"""WITH {CELLS}, st AS (SELECT avg(ln(1 + total)) AS m, stddev_pop(ln(1 + total)) AS s FROM cells),
g AS (SELECT tissue, avg(ln(1 + total)) AS g1, avg(total) AS g2 FROM cells GROUP BY 1)
SELECT cell_id, {_r("CAST(CAST((ln(1 + total) - m) / s AS FLOAT) AS DOUBLE)", "c0", 3)}, {_r("CAST(CAST(total AS FLOAT) AS DOUBLE)", "c1", 0)}, CAST(batch = 'F' AS DOUBLE) AS c2, CAST(batch = 'O' AS DOUBLE) AS c3, CAST(batch = 'P' AS DOUBLE) AS c4,
  {_r("CAST(CAST(g1 AS FLOAT) AS DOUBLE)", "c5", 3)}, {_r("CAST(CAST(g2 AS FLOAT) AS DOUBLE)", "c6", 0)} FROM cells CROSS JOIN st JOIN g USING (tissue)""")
def condition_vector(spark, d):
    rows = cells(spark, d).select("cell_id", encoding.condition_vector(_schema(spark, d)).alias("v"))
    digits = {0: 3, 1: 0, 5: 3, 6: 0}
    return rows.select("cell_id", *[rounded(F.get("v", F.lit(k)).cast("double"), digits.get(k, 6)).alias(f"c{k}") for k in range(7)])


@query(f"""WITH {CELLS}, c(name, "offset", dim, mean, std) AS (
SELECT 'total_log1p_zscore', 0, 1, avg(ln(1 + total)), stddev_pop(ln(1 + total)) FROM cells UNION ALL SELECT 'total', 1, 1, NULL, NULL
UNION ALL SELECT 'batch_onehot', 2, (SELECT CAST(count(DISTINCT batch) AS INT) FROM cells), NULL, NULL
UNION ALL SELECT 'tissue_groupmean_total', 5, 1, NULL, NULL UNION ALL SELECT 'tissue_groupmean_total', 6, 1, NULL, NULL)
SELECT name, "offset", dim, {_r("mean", "mean")}, {_r("std", "std")} FROM c""")
def condition_schema(spark, d):
    rows = [(c.name, c.offset, c.dim, c.stats.get("mean"), c.stats.get("std")) for c in _schema(spark, d).columns]
    return _round(spark.createDataFrame(rows, "name string, offset int, dim int, mean double, std double"), "mean", "std")


@query(f"WITH {CELLS} SELECT cell_type AS label, row_number() OVER (ORDER BY cell_type) - 1 AS idx FROM cells GROUP BY 1")
def label_index(spark, d):
    return encoding.label_index(cells(spark, d), "cell_type")


@query(f"""WITH {CELLS}, {COARSE}, {_DEPTH}, l AS (SELECT cell_type, row_number() OVER (ORDER BY cell_type) - 1 AS label FROM cells GROUP BY 1),
g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS k FROM genes), w AS (SELECT cell_id, sum(value * k) AS weighted, sum(value * k * k) AS twice FROM counts JOIN g USING (gene_id) GROUP BY 1),
b AS (SELECT batch, row_number() OVER (ORDER BY batch) AS place FROM cells GROUP BY 1)
SELECT cell_id, (SELECT CAST(count(*) AS INTEGER) FROM genes) AS n_genes, depth AS total, coalesce(weighted, 0) AS weighted, coalesce(twice, 0) AS twice, 3 AS n_cond, place, label
FROM cells JOIN depth USING (cell_id) JOIN l USING (cell_type) JOIN b USING (batch) LEFT JOIN w USING (cell_id)""")
def dataset_rows(spark, d):
    """Sums weighed by place, and the place of the batch, so that nothing may stand elsewhere."""
    m = matrix(spark, d, coarse=True)
    genes = m.genes.withColumn("column", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("gene_id")) - 1)
    schema = encoding.build_schema(m.cells, [], encoding.parse_categorical("batch:onehot"))
    rows = datasets.dataset_rows(m, genes, schema, "cell_type")

    def total(weigh) -> Column:
        return F.aggregate(F.transform("counts", weigh), F.lit(0.0), lambda a, x: a + x)

    return rows.select(
        "cell_id", F.size("counts").alias("n_genes"), total(lambda x, i: x.cast("double")).alias("total"), total(lambda x, i: x.cast("double") * i).alias("weighted"),
        total(lambda x, i: x.cast("double") * i * i).alias("twice"), F.size("condition").alias("n_cond"),
        F.array_position("condition", F.lit(1.0).cast("float")).alias("place"), "label",
    )


@query(f"WITH {CELLS} SELECT CAST(floor(cell_pos / 4000) AS INTEGER) AS chunk, count(*) AS n_cells FROM cells GROUP BY 1")
def chunk_sizes(spark, d):
    return datasets.chunk_sizes(cells(spark, d), 4000)


_WANTED = [7, 3, 3, 1, 32]


@query(f"""WITH {FINE}, w("row", cell_id) AS (VALUES {", ".join(f"({i}, {c})" for i, c in enumerate(_WANTED))})
SELECT CAST("row" AS INTEGER) AS "row", CAST(cell_id AS BIGINT) AS cell_id, gene_id, value FROM w JOIN counts USING (cell_id)""")
def take_rows(spark, d):
    return tables.take_rows(matrix(spark, d), _WANTED)


@query(f"WITH {CELLS}, {FINE} SELECT cell_id, gene_id, value FROM counts WHERE cell_id IN (SELECT cell_id FROM cells WHERE cell_pos >= 1000 AND cell_pos < 3000)")
def row_range(spark, d):
    return tables.row_range(matrix(spark, d), 1000, 3000)


# ---- graphs and metrics

_KNN = f"""WITH RECURSIVE {LATENT}, pairs AS (SELECT a.cell_id, b.cell_id AS nbr_id, list_cosine_distance(a.vec, b.vec) AS dist FROM latent a, latent b WHERE a.cell_id <> b.cell_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, nbr_id) AS rank FROM pairs) WHERE rank <= 10)"""


def _near(spark, d) -> DataFrame:
    return settled(graph.knn(latent(spark, d), 10), "knn")


@query(_KNN + f""" SELECT cell_id, CAST(rank AS INTEGER) AS rank, nbr_id, {_r("dist", "dist")} FROM knn""")
def knn_cosine(spark, d):
    return _round(graph.knn(latent(spark, d), 10), "dist")


@query(f"""WITH {LATENT}, pairs AS (SELECT a.cell_id, b.cell_id AS nbr_id, list_distance(a.vec, b.vec) AS dist FROM latent a, latent b WHERE a.cell_id <> b.cell_id)
SELECT cell_id, CAST(rank AS INTEGER) AS rank, nbr_id, {_r("dist", "dist", 5)} FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, nbr_id) AS rank FROM pairs) WHERE rank <= 5""")
def knn_euclidean(spark, d):
    return _round(graph.knn(latent(spark, d), 5, "euclidean"), "dist", digits=5)


@query(_KNN + " SELECT cell_id AS src, nbr_id AS dst FROM knn")
def knn_edges(spark, d):
    return graph.knn_edges(_near(spark, d))


@query(_KNN + f""", e AS (SELECT k.cell_id AS src, k.nbr_id AS dst, a.batch FROM knn k JOIN latent a ON a.cell_id = k.cell_id JOIN latent b ON b.cell_id = k.nbr_id WHERE a.batch = b.batch),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), reach AS (SELECT cell_id AS node, cell_id AS seen FROM latent UNION SELECT r.node, e.dst FROM reach r JOIN both_ways e ON e.src = r.seen),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node), sizes AS (SELECT batch, c, count(*) AS n FROM comp JOIN latent ON cell_id = node GROUP BY 1, 2),
best AS (SELECT batch, max(n) AS largest, sum(n) AS n FROM sizes GROUP BY 1)
SELECT {_r("sum(largest) / sum(n)", "graph_connectivity")} FROM best""")
def graph_connectivity(spark, d):
    return _round(graph.graph_connectivity(_near(spark, d), latent(spark, d), "batch"), "graph_connectivity")


@query(_KNN + f""", f AS (SELECT batch, count(*) / (SELECT count(*) FROM latent) AS f FROM latent GROUP BY 1),
o AS (SELECT c.cell_id, f.batch, f.f, count(n.batch) AS o FROM latent c CROSS JOIN f LEFT JOIN (SELECT k.cell_id, l.batch FROM knn k JOIN latent l ON l.cell_id = k.nbr_id) n
  ON n.cell_id = c.cell_id AND n.batch = f.batch GROUP BY 1, 2, 3), x AS (SELECT cell_id, sum(pow(o - 10 * f, 2) / (10 * f)) AS chi2 FROM o GROUP BY 1)
SELECT {_r(f"avg(CAST(chi2 <= {chi2_ppf(0.95, 2)!r} AS DOUBLE))", "kbet")} FROM x""")
def kbet(spark, d):
    return _round(metrics.kbet(_near(spark, d), latent(spark, d), "batch"), "kbet")


def _silhouette_sql(where: str = "true") -> str:
    return f"""WITH {LATENT}, part AS (SELECT * FROM latent WHERE {where}), pairs AS (SELECT a.cell_id, a.cell_type AS own, b.cell_type AS other, list_cosine_distance(a.vec, b.vec) AS dist
  FROM part a, part b WHERE a.cell_id <> b.cell_id), means AS (SELECT cell_id, own, other, avg(dist) AS m FROM pairs GROUP BY 1, 2, 3),
s AS (SELECT cell_id, own AS label, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM means GROUP BY 1, 2),
sil AS (SELECT cell_id, label, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM s)"""


@query(_silhouette_sql() + f""" SELECT cell_id, label, {_r("silhouette", "silhouette")} FROM sil""")
def silhouettes(spark, d):
    v = latent(spark, d)
    return _round(metrics.silhouettes(v.select("cell_id", "vec"), v, "cell_type"), "silhouette")


@query(_silhouette_sql() + f""" SELECT {_r("avg(silhouette)", "celltype_asw")} FROM sil""")
def celltype_asw(spark, d):
    v = latent(spark, d)
    return _round(metrics.average_silhouette(v.select("cell_id", "vec"), v, "cell_type", "celltype_asw"), "celltype_asw")


@query(_silhouette_sql().replace("cell_type AS own", "batch AS own").replace("cell_type AS other", "batch AS other") + f""" SELECT {_r("avg(silhouette)", "batch_asw")} FROM sil""")
def batch_asw(spark, d):
    v = latent(spark, d)
    return _round(metrics.average_silhouette(v.select("cell_id", "vec"), v, "batch", "batch_asw"), "batch_asw")


_LACKING = "CASE WHEN cell_type NOT IN ('1', '4') AND batch = '0' THEN '1' ELSE batch END"


@query(_silhouette_sql(f"cell_type IN (SELECT cell_type FROM latent GROUP BY 1 HAVING count(DISTINCT {_LACKING}) < 3)") + f""" SELECT {_r("avg(silhouette)", "isolated_label_asw")} FROM sil""")
def isolated_label_asw(spark, d):
    """All labels but two are without one of the batches, whose cells count for another."""
    v = latent(spark, d).withColumn("batch", F.expr(_LACKING))
    return _round(metrics.isolated_label_silhouette(v.select("cell_id", "vec"), v, "cell_type", "batch"), "isolated_label_asw")


_AGREE = """t AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2), x AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), y AS (SELECT b, sum(n) AS n FROM t GROUP BY 1),
q AS (SELECT (SELECT CAST(sum(n) AS DOUBLE) FROM t) AS s, (SELECT sum(n * ln(n)) FROM t) AS lx, (SELECT sum(n * ln(n)) FROM x) AS la, (SELECT sum(n * ln(n)) FROM y) AS lb,
  (SELECT sum(n * (n - 1) / 2) FROM t) AS cx, (SELECT sum(n * (n - 1) / 2) FROM x) AS ca, (SELECT sum(n * (n - 1) / 2) FROM y) AS cb)"""


@query(f"""WITH pairs AS (SELECT o_orderpriority AS a, c_mktsegment AS b FROM orders JOIN customer ON o_custkey = c_custkey), {_AGREE}
SELECT {_r("greatest((2 * ln(s) - la / s - lb / s - (ln(s) - lx / s)) / ((2 * ln(s) - la / s - lb / s) / 2), 0)", "nmi")},
  {_r("(cx - ca * cb / (s * (s - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (s * (s - 1) / 2))", "ari")}, (SELECT count(*) FROM x) AS n_cell_type, (SELECT count(*) FROM y) AS n_tissue FROM q""")
def label_agreement(spark, d):
    return _round(graph.agreement(cells(spark, d), "cell_type", "tissue"), "nmi", "ari")


@query(_KNN + f""", e AS (SELECT cell_id AS src, nbr_id AS dst FROM knn UNION ALL SELECT nbr_id, cell_id FROM knn),
m AS (SELECT a.cell_type AS c, count(*) AS m, count(*) FILTER (a.cell_type = b.cell_type) AS i FROM e JOIN latent a ON a.cell_id = src JOIN latent b ON b.cell_id = dst GROUP BY 1)
SELECT {_r("sum(i) / sum(m) - sum(CAST(m AS DOUBLE) * m) / pow(sum(m), 2)", "modularity")} FROM m""")
def modularity(spark, d):
    v = latent(spark, d).select("cell_id", F.col("cell_type").alias("cluster"))
    return _round(graph.modularity(graph.knn_edges(_near(spark, d)), v), "modularity")


def _centroids_sql(name: str, dims: str) -> str:
    return f"""{name}_long AS (SELECT cell_type AS label, cell_id, unnest(range(len(v))) AS d, unnest(v) AS x FROM (SELECT cell_type, cell_id, {dims} AS v FROM latent)),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY label, d ORDER BY x, cell_id) AS r, count(*) OVER (PARTITION BY label, d) AS n FROM {name}_long),
{name} AS (SELECT label, d, avg(x) AS x FROM {name}_r WHERE r > floor(n * 0.05) AND r <= n - floor(n * 0.05) GROUP BY 1, 2),
{name}_raw AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.x - b.x, 2))) AS dist FROM {name} a JOIN {name} b USING (d) GROUP BY 1, 2),
{name}_dist AS (SELECT a, b, dist / max(dist) OVER (PARTITION BY b) AS dist FROM {name}_raw)"""


@query(f"""WITH {LATENT}, {_centroids_sql("c", "vec")} SELECT label, CAST(d AS INTEGER) AS d, {_r("x", "x")} FROM c""")
def trimmed_centroids(spark, d):
    v = latent(spark, d)
    return _round(metrics.trimmed_centroids(v.select("cell_id", "vec"), v, "cell_type"), "x")


@query(f"""WITH {LATENT}, {_centroids_sql("c", "vec")} SELECT a, b, {_r("dist", "dist")} FROM c_dist""")
def centroid_distances(spark, d):
    v = latent(spark, d)
    return _round(metrics.centroid_distances(metrics.trimmed_centroids(v.select("cell_id", "vec"), v, "cell_type")), "dist")


@query(f"""WITH {LATENT}, {_centroids_sql("c", "vec[1:32]")}, {_centroids_sql("e", "vec[33:64]")},
j AS (SELECT c.b, c.a, c.dist AS x, e.dist AS y, CASE WHEN c.dist > 0 THEN 1 / c.dist ELSE 0 END AS w FROM c_dist c JOIN e_dist e USING (a, b)),
k AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0 AS ry FROM j),
s AS (SELECT b, corr(x, y) AS p, corr(rx, ry) AS r, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy FROM k GROUP BY 1)
SELECT {_r("avg((sxy / s - sx * sy / (s * s)) / sqrt((sxx / s - sx * sx / (s * s)) * (syy / s - sy * sy / (s * s))))", "corr_weighted", 5)}, {_r("avg(p)", "corr_pca", 5)}, {_r("avg(r)", "rank_pca", 5)} FROM s""")
def distance_agreement(spark, d):
    v = latent(spark, d)
    one, two = (
        metrics.centroid_distances(metrics.trimmed_centroids(v.select("cell_id", F.slice("vec", at, 32).alias("vec")), v, "cell_type")) for at in (1, 33)
    )
    return _round(metrics.distance_agreement(one, two), "corr_weighted", "corr_pca", "rank_pca", digits=5)


def _lisi_sql(label: str, k: int = 10) -> str:
    """The widths are bisected in a recursion, a step a row, as far as each cell needs."""
    wanted = f"ln({max(k // 3, 1)}.0)"
    return f"""{_KNN.replace("rank <= 10", f"rank <= {k}")}, near AS (SELECT k.cell_id, list(dist ORDER BY rank) AS d, list({label} ORDER BY rank) AS l FROM knn k JOIN latent n ON n.cell_id = nbr_id GROUP BY 1),
steps AS (SELECT cell_id, d, l, 0 AS step, CAST(1 AS DOUBLE) AS beta, CAST('-inf' AS DOUBLE) AS low, CAST('inf' AS DOUBLE) AS high FROM near
  UNION ALL SELECT cell_id, d, l, step + 1,
    CASE WHEN gap > 0 THEN CASE WHEN isinf(high) THEN beta * 2 ELSE (beta + high) / 2 END ELSE CASE WHEN isinf(low) THEN beta / 2 ELSE (beta + low) / 2 END END,
    CASE WHEN gap > 0 THEN beta ELSE low END, CASE WHEN gap > 0 THEN high ELSE beta END
  FROM (SELECT *, ln(list_sum(p)) + beta * list_dot_product(d, p) / list_sum(p) - {wanted} AS gap FROM (SELECT *, list_transform(d, lambda x: exp(-x * beta)) AS p FROM steps))
  WHERE abs(gap) >= 1e-5 AND step < 49),
last AS (SELECT cell_id, l, list_transform(d, lambda x: exp(-x * beta)) AS p FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY step DESC) AS r FROM steps) WHERE r = 1),
shares AS (SELECT cell_id, label, sum(p) AS s FROM (SELECT cell_id, unnest(l) AS label, unnest(list_transform(p, lambda x: x / list_sum(p))) AS p FROM last) GROUP BY 1, 2),
lisi AS (SELECT cell_id, 1 / sum(s * s) AS lisi FROM shares GROUP BY 1)"""


@query(_lisi_sql("cell_type") + f""" SELECT cell_id, {_r("lisi", "lisi", 5)} FROM lisi""")
def lisi(spark, d):
    return _round(metrics.lisi(_near(spark, d), latent(spark, d), "cell_type"), "lisi", digits=5)


@query(_lisi_sql("batch") + f""" SELECT {_r("greatest(least((median(lisi) - 1) / ((SELECT count(DISTINCT batch) FROM latent) - 1), 1), 0)", "ilisi", 5)} FROM lisi""")
def ilisi(spark, d):
    return _round(metrics.ilisi(_near(spark, d), latent(spark, d), "batch"), "ilisi", digits=5)


@query(_lisi_sql("cell_type") + f""", n AS (SELECT count(DISTINCT cell_type) AS n FROM latent)
SELECT {_r("greatest(least((n - m) / (n - 1), 1), 0)", "clisi", 5)} FROM (SELECT median(lisi) AS m FROM lisi) CROSS JOIN n""")
def clisi(spark, d):
    return _round(metrics.clisi(_near(spark, d), latent(spark, d), "cell_type"), "clisi", digits=5)


@query()
def leiden(spark, d):
    return graph.leiden(latent(spark, d), graph.knn_edges(_near(spark, d)))


@query()
def leiden_agreement(spark, d):
    return metrics.leiden_agreement(_near(spark, d), latent(spark, d), "cell_type")


@query()
def integration_report(spark, d):
    v = latent(spark, d)
    return metrics.integration_report(v.select("cell_id", "vec"), v, "batch", "cell_type", 15)


@query()
def scib_metrics(spark, d):
    v = latent(spark, d)
    return metrics.scib_metrics(v.select("cell_id", "vec"), v, n_neighbors=15)


_GIVEN = "(cell_id * 7919) % 11"


def _given(v: DataFrame) -> DataFrame:
    return v.select("cell_id", F.expr(_GIVEN).cast("string").alias("cluster"))


def _of(name: str) -> str:
    """A registered query's SQL, over 15 neighbours."""
    return f"({ORACLES[name].replace('rank <= 10', 'rank <= 15').replace('10 * f', '15 * f').replace('ln(3.0)', 'ln(5.0)')}) {name}_"


def _report_sql(names: list[str]) -> str:
    agree = f"""(WITH {LATENT}, pairs AS (SELECT CAST({_GIVEN} AS VARCHAR) AS a, cell_type AS b FROM latent), {_AGREE}
SELECT {_r("greatest((2 * ln(s) - la / s - lb / s - (ln(s) - lx / s)) / ((2 * ln(s) - la / s - lb / s) / 2), 0)", "nmi", 5)},
  {_r("(cx - ca * cb / (s * (s - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (s * (s - 1) / 2))", "ari", 5)}, (SELECT count(*) FROM x) AS n_leiden_clusters FROM q) agree_"""
    sizes = f"(WITH {LATENT} SELECT count(*) AS n_cells, count(DISTINCT batch) AS n_batches, count(DISTINCT cell_type) AS n_cell_types FROM latent) sizes_"
    return " CROSS JOIN ".join([*[_of(n) for n in names], agree, sizes])


_REPORT = ["batch_asw", "celltype_asw", "graph_connectivity"]


@query(f"SELECT {', '.join(_r(n, n, 4) for n in [*_REPORT, 'nmi', 'ari'])}, n_leiden_clusters, n_cells, n_batches, n_cell_types FROM {_report_sql(_REPORT)}")
def integration_report_given(spark, d):
    """The report over a given partition in place of Leiden's."""
    v = latent(spark, d)
    found = metrics.integration_report(v.select("cell_id", "vec"), v, "batch", "cell_type", 15, clusters=_given(v))
    return _round(found, *_REPORT, "nmi", "ari", digits=4)


_BATCH_SCORE, _BIO_SCORE = "(batch_asw + graph_connectivity + kbet + ilisi) / 4", "(celltype_asw + nmi + ari + clisi) / 4"


@query(f"""SELECT {', '.join(_r(n, n, 4) for n in [*_REPORT, 'kbet', 'ilisi', 'clisi', 'nmi', 'ari'])}, CAST(NULL AS DOUBLE) AS isolated_label_asw,
  n_leiden_clusters, n_cells, n_batches, n_cell_types, n_cells AS n_cells_silhouette, 4 AS n_metrics_batch, 4 AS n_metrics_bio, {_r(_BATCH_SCORE, "batch_score", 4)}, {_r(_BIO_SCORE, "bio_score", 4)},
  {_r(f"0.4 * ({_BATCH_SCORE}) + 0.6 * ({_BIO_SCORE})", "scib_overall", 4)} FROM {_report_sql([*_REPORT, "kbet", "ilisi", "clisi"])}""")
def scib_metrics_given(spark, d):
    """All metrics over a given partition in place of Leiden's. Every batch has every label, so that none is isolated."""
    v = latent(spark, d)
    found = metrics.scib_metrics(v.select("cell_id", "vec"), v, n_neighbors=15, clusters=_given(v))
    return _round(found, *metrics.BATCH_METRICS, *metrics.BIO_METRICS, "batch_score", "bio_score", "scib_overall", digits=4)


@query(f"WITH {LATENT} SELECT count(*) AS n_cells, true AS named_by_size, true AS connected, true AS better_than_labels FROM latent")
def leiden_soundness(spark, d):
    """What a Leiden partition promises: every cell once, names by size, connected communities, more modularity than the given labels."""
    v, edges = latent(spark, d), graph.knn_edges(_near(spark, d))
    found = settled(graph.leiden(v, edges), "leiden")
    sizes = found.groupBy(F.col("cluster").cast("int").alias("k")).agg(F.count("*").alias("n"))
    falling = F.coalesce(F.col("n") <= F.lag("n").over(Window.partitionBy(F.lit(0)).orderBy("k")), F.lit(True))
    in_order = sizes.select(falling.alias("ok"), "k").agg((F.bool_and("ok") & (F.max("k") + 1 == F.count("*"))).alias("named_by_size"))
    a, b = found.toDF("src", "ca"), found.toDF("dst", "cb")
    inner = edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst")
    parts = graph.connected_components(found, inner).join(found, "cell_id").groupBy("cluster").agg(F.count_distinct("component").alias("c"))
    labels = v.select("cell_id", F.col("cell_type").alias("cluster"))
    gain = graph.modularity(edges, found).crossJoin(graph.modularity(edges, labels).toDF("m")).select((F.col("modularity") > F.col("m")).alias("better_than_labels"))
    whole = found.agg((F.count_distinct("cell_id") * (F.count("*") == F.count_distinct("cell_id")).cast("long")).alias("n_cells"))
    return whole.crossJoin(in_order).crossJoin(parts.agg((F.max("c") == 1).alias("connected"))).crossJoin(gain)


@query(f"WITH {LATENT} SELECT count(*) AS n_cells, 2 AS n_dims, true AS finite, true AS neighbours_are_close FROM latent")
def umap_soundness(spark, d):
    """A layout places every cell, and neighbours nearer to one another than cells are that follow by id."""
    near = _near(spark, d)
    found = settled(graph.umap_layout(near, epochs=50), "layout")
    a, b = found.toDF("cell_id", "va"), found.toDF("nbr_id", "vb")
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    close = near.join(a, "cell_id").join(b, "nbr_id").agg(F.avg(gap).alias("near"))
    pairs = found.select(F.col("vec").alias("va"), F.lead("vec").over(Window.partitionBy(F.lit(0)).orderBy("cell_id")).alias("vb"))
    spread = pairs.where("vb is not null").agg(F.avg(gap).alias("far"))
    finite = F.bool_and(F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)))
    sizes = found.agg(F.count_distinct("cell_id").alias("n_cells"), F.max(F.size("vec")).alias("n_dims"), finite.alias("finite"))
    return sizes.crossJoin(close.crossJoin(spread).select((F.col("near") < 0.9 * F.col("far")).alias("neighbours_are_close")))


@query()
def scgraph_score(spark, d):
    m = matrix(spark, d, coarse=True)
    m = AnnotatedMatrix(m.cells, m.genes, settled(m.counts, "counts"))
    totals = preprocess.dense_rows(m.cells, m.counts, m.genes.withColumn("column", F.conv(F.substring("gene_id", 7, 2), 10, 10).cast("int") % 11), 11)
    return metrics.scgraph_score(totals.withColumnRenamed("row", "vec"), m, n_top=20, n_components=5)


@query(f"""SELECT name, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS position FROM (VALUES ('Brand#55', 1), ('Brand#11', 2), ('Brand#31', 3)) t(name, k)
WHERE name IN (SELECT p_brand FROM part)""")
def ordering_manual(spark, d):
    dots = views.dotplot_data(matrix(spark, d, coarse=True), "cell_type")
    return views.ordering(dots, manual=["Brand#55", "nothing", "Brand#11", "Brand#31"])


# Ward's tree by its centroids, every order that the tree allows, the shortest path through the leaves. A path and its reverse are as long.
@query(f"""WITH RECURSIVE dots AS ({ORACLES["dotplot_data"]}), wide AS (SELECT "group" AS name, list(color ORDER BY gene_id) AS v FROM dots GROUP BY 1),
tree AS (SELECT list({{'n': 1, 'v': v, 'paths': [[name]]}} ORDER BY name) AS c FROM wide UNION ALL
  SELECT list_concat(list_filter(c, lambda x, k: k <> a AND k <> b), [{{'n': c[a].n + c[b].n,
    'v': list_transform(range(1, len(c[a].v) + 1), lambda k: (c[a].n * c[a].v[k] + c[b].n * c[b].v[k]) / (c[a].n + c[b].n)),
    'paths': flatten(list_transform(c[a].paths, lambda x: flatten(list_transform(c[b].paths, lambda y: [list_concat(x, y), list_concat(y, x)]))))}}])
  FROM (SELECT c, near.a, near.b FROM (SELECT c, list_min(flatten(list_transform(range(1, len(c) + 1), lambda i: list_transform(range(i + 1, len(c) + 1),
    lambda j: {{'d': 2.0 * c[i].n * c[j].n / (c[i].n + c[j].n) * pow(list_distance(c[i].v, c[j].v), 2), 'a': i, 'b': j}})))) AS near FROM tree WHERE len(c) > 1))),
paths AS (SELECT unnest(c[1].paths) AS path FROM tree WHERE len(c) = 1),
placed AS (SELECT path, unnest(path) AS name, generate_subscripts(path, 1) AS k FROM paths WHERE path[1] <= path[-1]),
steps AS (SELECT path, list_distance(v, lead(v) OVER (PARTITION BY path ORDER BY k)) AS step FROM placed JOIN wide USING (name)),
best AS (SELECT path FROM steps GROUP BY path ORDER BY sum(step), path LIMIT 1)
SELECT unnest(path) AS name, CAST(generate_subscripts(path, 1) - 1 AS INTEGER) AS position FROM best""")
def ordering_ward(spark, d):
    return views.ordering(views.dotplot_data(matrix(spark, d, coarse=True), "cell_type"), "group", cluster=True)


# Lloyd's algorithm from every three genes; a start's rows end with the first that repeats.
@query(f"""WITH RECURSIVE dots AS ({ORACLES["dotplot_data"]}), wide AS (SELECT gene_id AS name, list(color ORDER BY "group") AS v FROM dots GROUP BY 1),
points AS (SELECT list(v ORDER BY name) AS p FROM wide), starts AS (SELECT [a.v, b.v, c.v] AS m FROM wide a JOIN wide b ON a.name < b.name JOIN wide c ON b.name < c.name),
labelled AS (SELECT m, list_transform(p, lambda x: list_transform(m, lambda y: list_distance(x, y))) AS d FROM starts CROSS JOIN points),
lloyd AS (SELECT m, list_transform(d, lambda x: list_position(x, list_min(x))) AS l, list_sum(list_transform(d, lambda x: pow(list_min(x), 2))) AS inertia FROM labelled UNION
  SELECT m, list_transform(d, lambda x: list_position(x, list_min(x))) AS l, list_sum(list_transform(d, lambda x: pow(list_min(x), 2))) AS inertia
  FROM (SELECT m, list_transform(p, lambda x: list_transform(m, lambda y: list_distance(x, y))) AS d, p FROM (
    SELECT p, list_transform(range(1, 4), lambda k: CASE WHEN list_contains(l, k) THEN list_transform(range(1, len(p[1]) + 1),
      lambda g: list_avg(list_transform(list_filter(p, lambda x, i: l[i] = k), lambda x: x[g]))) ELSE m[k] END) AS m FROM lloyd CROSS JOIN points))),
best AS (SELECT l FROM lloyd ORDER BY inertia, l LIMIT 1), named AS (SELECT name, l[row_number() OVER (ORDER BY name)] AS label FROM wide CROSS JOIN best)
SELECT name, CAST(row_number() OVER (ORDER BY first, name) - 1 AS INTEGER) AS position FROM (SELECT name, min(name) OVER (PARTITION BY label) AS first FROM named)""")
def ordering_kmeans(spark, d):
    return views.ordering(views.dotplot_data(matrix(spark, d, coarse=True), "cell_type"), km=3)


@query()
def umap_layout(spark, d):
    return graph.umap_layout(_near(spark, d), epochs=50)

