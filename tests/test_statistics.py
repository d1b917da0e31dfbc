"""Special functions, expression tests and residuals against closed forms and dense numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.core import AnnotatedMatrix
from cellframe.functions import special
from cellframe.functions.multiple import bh_adjust
from cellframe.operators import deg, pearson, preprocess, views


def make(spark, x, cells=None, names=None):
    n, g = x.shape
    rows = [(i, *(cells[i] if cells else ("a", "u"))) for i in range(n)]
    c = spark.createDataFrame(rows, "cell_id long, cell_type string, batch string")
    genes = spark.createDataFrame([(f"g{j}", names[j] if names else f"g{j}", j) for j in range(g)], "gene_id string, gene_name string, gene_pos long")
    counts = spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i in range(n) for j in range(g) if x[i, j]], "cell_id long, gene_id string, value double")
    return AnnotatedMatrix(c, genes, counts)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(1.2, (60, 7)).astype(float)
    x[:, 5] = 0
    x[7] = 0
    kinds = [(("a", "b")[i % 2], ("u", "v", "w")[i % 3]) for i in range(60)]
    return x, kinds, make(spark, x, kinds)


def test_tails_have_their_closed_forms():
    t = np.array([0.0, 0.3, 1.3, 12.0])
    assert np.allclose(special.t_two_sided(t, np.ones(4)), 2 * (0.5 - np.arctan(t) / math.pi))
    assert np.allclose(special.t_two_sided(t, np.full(4, 2.0)), 1 - t / np.sqrt(2 + t * t))
    assert special.chi2_ppf(0.95, 2) == pytest.approx(-2 * math.log(0.05))
    assert special.gammainc(0.5, 0.7) == pytest.approx(math.erf(math.sqrt(0.7)))
    assert np.isnan(special.t_two_sided(np.array([1.0]), np.array([np.nan])))[0]


def test_bh_equals_the_step_up_rule_with_ties(spark):
    p = [0.01, 0.02, 0.02, 0.5, 0.04, 1.0]
    m = len(p)
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * m / np.arange(1, m + 1))[::-1])[::-1]
    expected = np.empty(m)
    expected[order] = np.minimum(q, 1)
    expected[1] = expected[2] = min(expected[1], expected[2])
    rows = bh_adjust(spark.createDataFrame(list(enumerate(p)), "k int, p double"), "p").orderBy("k").collect()
    assert np.allclose([r.padj for r in rows], expected)


def test_welch_of_all_genes_equals_dense(sample):
    x, kinds, m = sample
    got = {r.gene_id: r for r in deg.two_group_stats(m, "cell_type", ["a"], ["b"]).collect()}
    a, b = x[::2], x[1::2]
    assert len(got) == 7
    for j in range(7):
        va, vb = a[:, j].var() / 30, b[:, j].var() / 30
        r = got[f"g{j}"]
        assert r.mean_1 == pytest.approx(a[:, j].mean()) and r.pct_2 == pytest.approx((b[:, j] > 0).mean())
        if va + vb:
            assert r.t_stat == pytest.approx((a[:, j].mean() - b[:, j].mean()) / math.sqrt(va + vb))
            assert r.df == pytest.approx((va + vb) ** 2 / (va**2 / 29 + vb**2 / 29))
        else:
            assert r.t_stat is None
    full = deg.two_group_deg(m, "cell_type", ["a"], ["b"]).collect()
    assert {r.gene_id: r.pval for r in full}["g5"] == 1.0
    assert [r.padj for r in full] == sorted(r.padj for r in full)


@pytest.mark.parametrize("tie_correct", [False, True])
def test_rank_sums_without_densifying_equal_dense_ones(sample, tie_correct):
    x, kinds, m = sample
    got = {
        (r.cluster, r.gene_id): r
        for r in deg.nested_deg_stats(m, "cell_type", "batch", "u", "v", min_cells=5, tie_correct=tie_correct).collect()
    }
    for cluster in "ab":
        t = np.array([k == (cluster, "u") for k in kinds])
        r = np.array([k == (cluster, "v") for k in kinds])
        for j in range(7):
            values = np.concatenate([x[t, j], x[r, j]])
            ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
            n_t, n_r, n = t.sum(), r.sum(), t.sum() + r.sum()
            spread = n_t * n_r * (n + 1) / 12
            if tie_correct:
                _, c = np.unique(values, return_counts=True)
                spread *= 1 - (c**3 - c).sum() / (n**3 - n)
            z = got[cluster, f"g{j}"].statistic
            if spread > 0:
                assert z == pytest.approx((ranks[:n_t].sum() - n_t * (n + 1) / 2) / math.sqrt(spread))
            else:
                assert z is None
            assert got[cluster, f"g{j}"].pct_target == pytest.approx((x[t, j] > 0).mean())


def test_clusters_of_few_cells_are_left_out(sample):
    assert deg.nested_deg(sample[2], "cell_type", "batch", "u", "v", min_cells=50).collect() == []
    with pytest.raises(ValueError):
        deg.nested_deg(sample[2], "cell_type", "batch", "u", "v", method="other")


def test_negative_threshold_counts_absent_values(sample):
    x, _, m = sample
    got = {(r.group, r.gene_id): r.pct for r in deg.pct_expressing(m, "cell_type", -1.0).collect()}
    assert set(got.values()) == {1.0}


def test_residual_variances_equal_the_dense_formula(sample):
    x, _, m = sample
    p, depth, theta = x.sum(0) / x.sum(), x.sum(1), 100.0
    mu = np.outer(depth, p)
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.nan_to_num((x - mu) / np.sqrt(mu + mu**2 / theta))
    model = pearson.fit(m)
    got = {r.gene_id: r for r in model.statistics.collect()}
    for j in range(7):
        assert got[f"g{j}"].residual_variance == pytest.approx(z[:, j].var())
        assert got[f"g{j}"].is_zero_count == (x[:, j].sum() == 0)
    cells = {(r.cell_id, r.gene_id): r.z for r in model.transform(m).collect()}
    bound = math.sqrt(60)
    assert all(cells[i, f"g{j}"] == pytest.approx(np.clip(z[i, j], -bound, bound)) for i in range(60) for j in range(7))


def test_residuals_of_an_empty_matrix_raise(spark, sample):
    m = sample[2]
    with pytest.raises(ValueError):
        pearson.fit(AnnotatedMatrix(m.cells, m.genes, m.counts.where("false")))
    row = pearson.diagnose(m).first()
    assert (row.has_nan_inf, row.has_negative, row.zero_genes, row.zero_cells) == (0, 0, 1, 1)


def test_clipping_follows_the_quantiles_of_either_sign(spark):
    x = [-4.0, -3.0, -0.5, 0.2, 2.0, 5.0, 9.0]
    table = spark.createDataFrame([("c", f"g{i}", v) for i, v in enumerate(x)] + [("d", "g0", 0.5), ("d", "g1", -0.7)], "cluster string, gene_id string, logfc double")
    got = {(r.cluster, r.gene_id): r.logfc for r in deg.clip_logfc(table).collect()}
    high, low = np.quantile([v for v in x if v > 0], 0.95), np.quantile([v for v in x if v < 0], 0.05)
    assert all(got["c", f"g{i}"] == pytest.approx(min(max(v, low), high)) for i, v in enumerate(x))
    assert (got["d", "g0"], got["d", "g1"]) == (0.5, -0.7)


def test_highlights_take_both_ends_and_keep_empty_clusters(spark):
    rows = [("c", f"g{i}", float(i - 3)) for i in range(7)] + [("d", "x1", 0.0)]
    table = spark.createDataFrame(rows, "cluster string, gene_id string, logfc double")
    got = {r.cluster: r.genes for r in deg.highlight_genes(table, top_n=1, exclude_genes=["x1"]).collect()}
    assert got == {"c": ["g0", "g6"], "d": []}
    with pytest.raises(ValueError):
        deg.highlight_genes(table, ("other",))


def test_kernel_density_equals_dense(spark):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=80), rng.normal(size=80), rng.exponential(size=80)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, y, w))], "cell_id long, x double, y double, w double")

    def h(v):
        q = np.percentile(v, [75, 25])
        return 0.9 * min(v.std(ddof=1), (q[0] - q[1]) / 1.34) * len(v) ** -0.2

    gx, gy = np.linspace(x.min(), x.max(), 9), np.linspace(y.min(), y.max(), 9)
    kx = np.exp(-0.5 * ((gx[:, None] - x) / h(x)) ** 2) / math.sqrt(2 * math.pi)
    ky = np.exp(-0.5 * ((gy[:, None] - y) / h(y)) ** 2) / math.sqrt(2 * math.pi)
    z = (kx * w) @ ky.T / (w.sum() * h(x) * h(y))
    got = {(r.i, r.j): r.z for r in views.weighted_density(points, ["x", "y"], "w", n=9).collect()}
    assert all(got[i, j] == pytest.approx(z[i, j]) for i in range(9) for j in range(9))
    dens = {r.cell_id: r.density for r in views.cell_density(points, ["x", "y"], "w", n=9).collect()}
    i = np.clip(np.digitize(x, gx) - 1, 0, 8)
    j = np.clip(np.digitize(y, gy) - 1, 0, 8)
    assert all(dens[k] == pytest.approx(z[i[k], j[k]]) for k in range(80))
    flat = views.weighted_density(points.withColumn("x", F.lit(1.0)), ["x", "y"], "w", n=3, limits=[(0, 2), (-1, 1)])
    assert all(r.z is None for r in flat.collect())


def test_components_span_the_centred_matrix(spark, sample):
    x, _, m = sample
    got = {r.cell_id: r.vec for r in preprocess.principal_components(m, m.counts, m.genes, 3).collect()}
    scores = np.array([got[i] for i in range(60)])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(scores), np.abs(u[:, :3] * s[:3]), atol=1e-6)


def test_ward_and_optimal_leaves():
    x = np.array([[0.0], [10.0], [0.1], [10.2], [5.0]])
    order = views.ward_order(x)
    assert sorted(order) == list(range(5)) and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    best = views.ward_order(x, optimal=True)
    length = lambda o: sum(abs(x[a, 0] - x[b, 0]) for a, b in zip(o, o[1:], strict=False))
    assert length(best) <= length(order)
    assert len(set(views.kmeans_labels(x, 2))) == 2
    blobs = np.array([[9.0], [0.0], [9.1], [5.0], [0.1], [5.1]])
    assert list(views.kmeans_labels(blobs, 3)) == [0, 1, 0, 2, 1, 2]


def test_a_group_of_one_cell_has_no_test(spark):
    from cellframe.core import AnnotatedMatrix
    from cellframe.operators import deg

    cells = spark.createDataFrame([(1, "one"), (2, "more"), (3, "more"), (4, "more")], "cell_id long, kind string")
    genes = spark.createDataFrame([("a",), ("b",)], "gene_id string")
    counts = spark.createDataFrame([(1, "a", 9.0), (2, "a", 1.0), (3, "a", 2.0), (4, "a", 1.0), (2, "b", 1.0)], "cell_id long, gene_id string, value double")
    m = AnnotatedMatrix(cells, genes, counts)
    for first, second in ((["one"], ["more"]), (["more"], ["one"]), (["one"], ["one"]), (["none"], ["more"])):
        got = deg.two_group_deg(m, "kind", first, second).collect()
        assert len(got) == 2 and all(r.pval == 1.0 and r.padj == 1.0 for r in got)
