"""scGraph's parts against plain definitions, and that its work does not grow by a run over all counts for each batch."""

import numpy as np
import pytest

from cellframe.core import AnnotatedMatrix
from cellframe.operators import centroids, metrics


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(5)
    n, g = 900, 40
    kind, batch = rng.integers(0, 4, n), rng.integers(0, 6, n)
    x = rng.poisson(rng.gamma(2, 3, (4, g))[kind] * rng.uniform(0.3, 2, g) * 2)
    x[7] = 0
    cells = spark.createDataFrame([(i, f"b{batch[i]}", f"k{kind[i]}" if i % 50 else None) for i in range(n)], "cell_id long, batch string, cell_type string")
    counts = spark.createDataFrame([(int(i), f"g{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "cell_id long, gene_id string, value double")
    genes = spark.createDataFrame([(f"g{j:02d}",) for j in range(g)], "gene_id string")
    vecs = rng.normal(kind[:, None] * [1.0, 0.3, 2.0], 1)
    latent = spark.createDataFrame([(i, vecs[i].tolist()) for i in range(n)], "cell_id long, vec array<double>")
    names = np.array([f"k{kind[i]}" if i % 50 else "" for i in range(n)])
    return AnnotatedMatrix(cells, genes, counts), latent, x, batch, names, vecs


def trimmed(x, trim=0.05):
    cut = int(np.floor(len(x) * trim))
    return np.sort(x, axis=0)[cut : len(x) - cut].mean(axis=0)


def distances(x, names):
    c = np.array([trimmed(x[names == k]) for k in ("k0", "k1", "k2", "k3")])
    d = np.linalg.norm(c[:, None] - c[None], axis=2)
    return d / d.max(axis=0)


def test_score_equals_its_definition(spark, study):
    m, latent, x, batch, names, vecs = study
    pieces = []
    for b in range(6):
        mine = batch == b
        y = np.log1p(x[mine] / np.maximum(x[mine].sum(axis=1), 1)[:, None] * 1e4)
        part = AnnotatedMatrix(m.cells.where(f"batch = 'b{b}'"), m.genes, m.counts.join(m.cells.where(f"batch = 'b{b}'").select("cell_id"), "cell_id"))
        top = metrics_genes(part)
        y = y[:, top] - y[:, top].mean(axis=0)
        pieces.append(distances(y @ np.linalg.svd(y, full_matrices=False)[2][:4].T, names[mine]))
    mean = np.mean(pieces, axis=0)
    one, two = mean / mean.max(axis=0), distances(vecs, names)
    corr = np.mean([np.corrcoef(one[:, b], two[:, b])[0, 1] for b in range(4)])
    got = metrics.scgraph_score(latent, m, n_top=15, n_components=4).first()
    assert got.corr_pca == pytest.approx(corr, abs=1e-9)


def metrics_genes(part):
    from cellframe.operators.preprocess import normalize, variable_genes

    values = AnnotatedMatrix(part.cells, part.genes, normalize(part, 1e4))
    rows = variable_genes(values, values_are="normalized").select("gene_id", "normalized").collect()
    best = sorted(rows, key=lambda r: (-round(r.normalized or 0.0, 9), r.gene_id))[:15]
    return sorted(int(r.gene_id[1:]) for r in best)


def test_jobs_do_not_grow_with_the_batches(spark, study):
    m, latent, *_ = study
    few = AnnotatedMatrix(m.cells.where("batch in ('b0', 'b1')"), m.genes, m.counts)
    jobs = []
    for name, part in (("scgraph-2", few), ("scgraph-6", m)):
        spark.sparkContext.setJobGroup(name, name)
        metrics.scgraph_score(latent, part, n_top=15, n_components=4)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 3


def test_without_two_types_or_a_batch_there_is_no_score(spark, study):
    m, latent, *_ = study
    assert tuple(metrics.scgraph_score(latent, m, least_batch=10_000).first()) == (None, None, None)
    assert tuple(metrics.scgraph_score(latent, m, least_type=10_000).first()) == (None, None, None)


def test_trimmed_means_of_odd_values(spark, monkeypatch):
    monkeypatch.setattr(centroids, "_GATHERED", 1)  # so that brackets close in by several rounds
    monkeypatch.setattr(centroids, "_BINS", 256)
    rng = np.random.default_rng(2)
    n = 3000
    wide = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)
    x = np.stack([rng.normal(size=n), rng.integers(0, 3, n) * 1.0, wide, np.where(rng.random(n) < 0.01, np.inf, 1 + rng.random(n) * 1e-9), np.full(n, -0.0)], axis=1)
    group = rng.integers(0, 2, n)
    rows = [(int(group[i]), [float(v) for v in x[i]]) for i in range(n)] + [(0, None), (0, [float("nan"), None]), (2, [3.0])]
    got = {(g, d): v for g, d, v in centroids.trimmed_means(spark.createDataFrame(rows, "g int, vec array<double>"), 3, 5, 0.05)}
    for g in range(2):
        for d in range(5):
            want = trimmed(x[group == g, d])
            assert got[g, d] == pytest.approx(want, rel=1e-9, abs=1e-9 * np.abs(np.sort(x[group == g, d])[100:-100]).max())
    assert got[2, 0] == 3.0 and (2, 1) not in got
    half = centroids.trimmed_means(spark.createDataFrame([(0, [1.0]), (0, [2.0])], "g int, vec array<double>"), 1, 1, 0.5)
    assert half == [(0, 0, None)]
