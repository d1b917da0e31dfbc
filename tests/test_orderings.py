"""Orderings by k-means against every possible start."""

from itertools import combinations

import numpy as np

from cellframe.operators import views


def plain(x, k):
    """The least inertia that Lloyd's algorithm reaches from any ``k`` rows."""
    best = np.inf
    for rows in combinations(range(len(x)), k):
        c, last = x[list(rows)], None
        while True:
            label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            if last is not None and (label == last).all():
                break
            last, c = label, np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        best = min(best, ((x - c[label]) ** 2).sum())
    return best


def test_kmeans_reaches_the_least_inertia_of_all_starts():
    for seed in range(4):
        x = np.random.default_rng(seed).normal(size=(15, 5))
        label = views.kmeans_labels(x, 3)
        inertia = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))
        assert np.isclose(inertia, plain(x, 3))


def test_kmeans_of_few_or_equal_or_many_rows():
    assert list(views.kmeans_labels(np.zeros((0, 2)), 3)) == []
    assert list(views.kmeans_labels(np.array([[1.0], [2.0]]), 3)) == [0, 1]
    assert list(views.kmeans_labels(np.zeros((4, 2)), 2)) == [0, 0, 0, 0]
    x = np.repeat(np.arange(5.0), 40)[:, None] * 10 + np.random.default_rng(1).uniform(0, 1, (200, 1))
    assert list(views.kmeans_labels(x, 5)) == np.repeat(np.arange(5), 40).tolist()  # more choices than MOST_STARTS
