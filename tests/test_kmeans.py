"""k-means against plain rounds, and its starts by what they must hold."""

import numpy as np
import pytest

from fieldlark.operators import cluster


def blobs(seed, k=5, n=400, dim=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 20, (k, dim))
    return np.concatenate([c + rng.normal(size=(n // k, dim)) for c in centers]), centers


def frame(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "idx bigint, x array<double>").repartition(6)


def rounds(x, c, n):
    for _ in range(n):
        before = c
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else np.zeros(x.shape[1]) for k in range(len(c))])
        if np.sqrt(((c - before) ** 2).sum()) < 1e-6:
            break
    return near, c


def cost(x, c):
    return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()


def test_rounds_of_several_starts_at_once(spark):
    x, _ = blobs(1)
    df = frame(spark, x)
    starts = {2: x[:2], 5: x[::80], 7: np.concatenate((x[:6], [[1e9] * 3]))}  # the last one stays empty
    got = cluster.lloyd(df, starts, max_iter=8)
    for name, start in starts.items():
        near, want = rounds(x, start, 8)
        assert np.allclose(got[name][1], want, atol=1e-9)
    assigned, centers = cluster.k_means(df, 5, x[::80], max_iter=8)
    near, want = rounds(x, x[::80], 8)
    assert [r.cluster for r in assigned.orderBy("idx").collect()] == near.tolist() and np.allclose(centers, want)


def test_oversampled_start_finds_the_blobs(spark):
    for seed in range(2):
        x, centers = blobs(seed + 10)
        df = frame(spark, x)
        start = cluster.oversampled(df, 5, seed)
        assert start.shape == (5, 3) and cost(x, start) < 1.5 * cost(x, centers)
        assert np.array_equal(start, cluster.oversampled(df.repartition(3), 5, seed))  # reruns agree, however rows are dealt
        moved = cluster.k_means(df, 5, seed=seed, max_iter=20)[1]
        assert cost(x, moved) <= cost(x, start) + 1e-9
    k, curve = cluster.optimal_k(df, (3, 6), max_iter=10)
    assert k == 5 and curve[0] > curve[1] > curve[2]


def test_starts_of_few_vectors(spark):
    df = frame(spark, np.array([[0.0, 0.0]] * 30 + [[5.0, 5.0]] * 2 + [[9.0, 0.0]]))
    for start in (cluster.oversampled, cluster.plus_plus):
        assert {tuple(c) for c in start(df, 3, 1)} == {(0.0, 0.0), (5.0, 5.0), (9.0, 0.0)}
        with pytest.raises(ValueError, match="fewer different"):
            start(df, 4, 1)
        with pytest.raises(ValueError, match="fewer different"):
            start(df.where("false"), 1, 1)


def test_clusters_of_latent_vectors(spark):
    x, _ = blobs(3, k=3, n=60)
    assigned, centers = cluster.k_means(frame(spark, x), 3, np.concatenate((x[:2], [[1e9] * 3])), max_iter=1)
    rows = {r.cluster_id: r for r in cluster.latent_clusters(assigned, centers).collect()}
    assert rows[2].size == 0 and rows[2].indices == [] and sum(r.size for r in rows.values()) == 60
    assert sorted(i for r in rows.values() for i in r.indices) == list(range(60)) and np.allclose(rows[0].center, centers[0])


def test_vectors_of_another_width_are_refused(spark):
    with pytest.raises(Exception, match="must have 2 numbers"):
        cluster.assign(frame(spark, np.ones((3, 3))), np.ones((1, 2))).collect()
