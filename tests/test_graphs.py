"""Neighbours, communities and metrics against brute force."""

import numpy as np
import pytest

from cellframe.operators import graph, metrics


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(40, 6)) * 0.4 + np.eye(6)[c] * 4 for c in range(3)])
    cells = [(i, str(i // 40), f"b{i % 2}", [float(v) for v in x[i]]) for i in range(120)]
    return x, spark.createDataFrame(cells, "cell_id long, cell_type string, batch string, vec array<double>")


def cosine(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return 1 - u @ u.T


@pytest.mark.parametrize("block_bytes", [1 << 20, 2000])
def test_neighbours_are_exact_in_any_number_of_blocks(blobs, block_bytes):
    x, cells = blobs
    d = cosine(x)
    np.fill_diagonal(d, np.inf)
    rows = graph.knn(cells.select("cell_id", "vec"), 5, block_bytes=block_bytes).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.cell_id, r["rank"])):
        got.setdefault(r.cell_id, []).append(r.nbr_id)
    assert all(got[i] == np.argsort(d[i], kind="stable")[:5].tolist() for i in range(120))


def test_silhouettes_equal_the_quadratic_definition(blobs):
    x, cells = blobs
    d, label = cosine(x), np.arange(120) // 40
    expected = []
    for i in range(120):
        means = [d[i, (label == c) & (np.arange(120) != i)].mean() for c in range(3)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        expected.append((b - a) / max(a, b))
    got = {r.cell_id: r.silhouette for r in metrics.silhouettes(cells.select("cell_id", "vec"), cells, "cell_type").collect()}
    assert np.allclose([got[i] for i in range(120)], expected)


def test_one_label_has_no_silhouette(spark, blobs):
    cells = blobs[1].where("cell_type = '0'")
    assert metrics.average_silhouette(cells.select("cell_id", "vec"), cells, "cell_type").first()[0] is None


def test_neighbourhood_tests(blobs):
    x, cells = blobs
    near = graph.knn(cells.select("cell_id", "vec"), 9)
    assert metrics.kbet(near, cells, "batch").first().kbet > 0.8
    assert metrics.kbet(near, cells, "cell_type").first().kbet == 0
    assert graph.graph_connectivity(near, cells, "cell_type").first()[0] == pytest.approx(1.0)
    assert metrics.clisi(near, cells, "cell_type").first().clisi == pytest.approx(1.0)
    # a perplexity of 3 lets a cell see about three neighbours: mixed batches stay well below 1
    assert metrics.ilisi(near, cells, "cell_type").first().ilisi == pytest.approx(0.0, abs=1e-9)
    assert 0.3 < metrics.ilisi(near, cells, "batch").first().ilisi < 1


def test_simpson_of_equal_distances_counts_labels():
    labels = np.tile(np.arange(4), (3, 3))
    assert np.allclose(1 / metrics.simpson_scores(np.full((3, 12), 0.5), labels, 12.0), 4.0)
    # equal distances have one entropy only: another perplexity is never reached, and the weights vanish
    assert np.allclose(metrics.simpson_scores(np.full((3, 12), 0.5), labels, 4.0), 1.0)
    assert np.allclose(metrics.simpson_scores(np.full((2, 3), 1e6), np.zeros((2, 3), int), 1.5), 1.0)


def test_simpson_reaches_the_perplexity_row_by_row():
    rng = np.random.default_rng(0)
    dist, labels = np.sort(rng.uniform(0.1, 1, (20, 30)), axis=1), rng.integers(0, 3, (20, 30))
    got = metrics.simpson_scores(dist, labels, 10.0)
    for i in range(20):
        low, high = 1e-6, 1e6
        for _ in range(200):
            beta = (low * high) ** 0.5
            p = np.exp(-(dist[i] - dist[i].min()) * beta)
            p /= p.sum()
            low, high = (beta, high) if -(p * np.log(p + 1e-300)).sum() > np.log(10.0) else (low, beta)
        assert got[i] == pytest.approx((np.bincount(labels[i], p, 3) ** 2).sum(), abs=1e-4)


def test_leiden_finds_the_blobs(blobs):
    x, cells = blobs
    edges = graph.knn_edges(graph.knn(cells.select("cell_id", "vec"), 12))
    for flavor in ("deterministic", "quality"):
        found = graph.leiden(cells, edges, flavor=flavor)
        pairs = found.join(cells.select("cell_id", "cell_type"), "cell_id")
        row = graph.agreement(pairs, "cluster", "cell_type").first()
        assert row.ari > 0.9 and row.nmi > 0.9
    few = graph.leiden(cells, edges, 0.2).select("cluster").distinct().count()
    many = graph.leiden(cells, edges, 4.0).select("cluster").distinct().count()
    assert few <= many
    again = graph.leiden(cells, edges).collect()
    assert sorted(again) == sorted(graph.leiden(cells, edges).collect())
    with pytest.raises(ValueError):
        graph.leiden(cells, edges, flavor="other")


def test_agreement_of_equal_and_constant_labels(spark):
    rows = spark.createDataFrame([(i % 3, f"x{i % 3}", 0) for i in range(30)], "a int, b string, c int")
    same, one = graph.agreement(rows, "a", "b").first(), graph.agreement(rows, "a", "c").first()
    assert (same.nmi, same.ari) == (pytest.approx(1.0), pytest.approx(1.0))
    assert (one.nmi, one.ari) == (pytest.approx(0.0), pytest.approx(0.0))


def test_components_of_a_long_path(spark):
    n = 90
    order = np.random.default_rng(2).permutation(n).tolist()
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "cell_id long")
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "src long, dst long")
    got = {r.cell_id: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(range(n), 0), n: n, n + 1: n + 1}


def test_graphs_are_resolved_in_order(spark):
    a, b = spark.range(1), spark.range(2)
    assert graph.resolve_edges({"connectivities": a, "x_connectivities": b}, neighbors_key="x") is b
    with pytest.raises(KeyError):
        graph.resolve_edges({}, obsp="none")
    with pytest.raises(ValueError):
        graph.resolve_edges({"connectivities": a}, adjacency=a, obsp="x")


def test_metrics_report_is_one_row(blobs):
    _, cells = blobs
    row = metrics.scib_metrics(cells.select("cell_id", "vec"), cells, n_neighbors=10).first()
    assert row.scib_overall == pytest.approx(0.4 * row.batch_score + 0.6 * row.bio_score)
    assert row.isolated_label_asw is None and row.n_metrics_bio == 4 and row.n_cells == 120


def test_layout_places_every_cell(blobs):
    _, cells = blobs
    got = graph.umap_layout(graph.knn(cells.select("cell_id", "vec"), 10), epochs=100).orderBy("cell_id").collect()
    y = np.array([r.vec for r in got])
    centres = np.array([y[40 * c : 40 * c + 40].mean(0) for c in range(3)])
    spread = np.mean([y[40 * c : 40 * c + 40].std() for c in range(3)])
    assert y.shape == (120, 2) and min(np.linalg.norm(centres[a] - centres[b]) for a, b in ((0, 1), (0, 2), (1, 2))) > spread


def test_lists_find_nearly_all_neighbours(spark, monkeypatch):
    """Blobs, one of them a third of all rows and so a hot list, and scattered cells."""
    monkeypatch.setattr(graph, "LIST_SHARD", 100)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(700, 16)) * 0.3 + 2, *[rng.normal(size=(80, 16)) * 0.5 + rng.normal(size=16) * 3 for _ in range(10)], rng.normal(size=(600, 16)) * 2])
    cells = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "cell_id long, vec array<double>")
    for metric in ("cosine", "euclidean"):
        exact = {(r.cell_id, r.nbr_id): r.dist for r in graph.knn(cells, 10, metric, method="exact").collect()}
        found = {(r.cell_id, r.nbr_id): r.dist for r in graph.knn(cells, 10, metric, method="approximate", probes=12).collect()}
        assert len(exact) == len(found) == 10 * len(x)
        assert len(set(exact) & set(found)) / len(exact) > 0.95
        assert all(abs(exact[k] - found[k]) < 1e-6 for k in set(exact) & set(found))


def test_large_graphs_are_made_coarser(spark, blobs):
    x, cells = blobs
    edges = graph.knn_edges(graph.knn(cells.select("cell_id", "vec"), 8))
    alone = cells.select("cell_id").union(spark.createDataFrame([(900,), (901,)], "cell_id long"))
    whole = {r.cell_id: r.cluster for r in graph.leiden(alone, edges).collect()}
    for most in (200, 20):
        found = {r.cell_id: r.cluster for r in graph.leiden(alone, edges, most_edges=most).collect()}
        assert set(found) == set(whole) and found[900] != found[901]
        # no community spans two blobs
        assert all(len({i // 40 for i in range(120) if found[i] == c}) == 1 for c in {found[i] for i in range(120)})
        table = spark.createDataFrame(list(found.items()), "cell_id long, cluster string")
        best = spark.createDataFrame(list(whole.items()), "cell_id long, cluster string")
        assert graph.modularity(edges, table).first()[0] > 0.9 * graph.modularity(edges, best).first()[0]
    assert graph.leiden(alone, edges.where("false")).select("cluster").distinct().count() == 122
    table = spark.createDataFrame([(str(k),) for k in (10, 2, 0, 1)], "cluster string")
    assert graph.cluster_categories(table) == ["0", "1", "2", "10"] and graph.leiden_parameters(0.5)["params"]["resolution"] == 0.5
