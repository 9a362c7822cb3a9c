"""Merged moments against NumPy over all vectors."""

import numpy as np
import pytest

from fieldlark.operators import features, latent, moments


def frame(spark, groups):
    rows = [(k, [float(v) for v in row]) for k, x in groups.items() for row in x]
    return spark.createDataFrame(rows + [("z", None), ("z", [])], "link_id string, amplitude array<double>").repartition(7)


def test_moments_of_keys(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(1e4, 1e-2, (300, 6)), "b": rng.normal(size=(1, 3)), "c": rng.normal(size=(2, 4)), "d": np.column_stack([np.full(40, 0.1), rng.normal(size=40)])}
    df = frame(spark, groups)
    got = {r.link_id: r for r in moments.moments(df, "amplitude", ["link_id"]).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        gap = x - x.mean(axis=0)
        assert got[k].n == len(x) and np.allclose(got[k].mean, x.mean(axis=0), rtol=1e-12) and np.allclose(np.reshape(got[k].m2, (x.shape[1], -1)), gap.T @ gap, atol=1e-6, rtol=1e-6)
    c = {(r.k1, r.k2): r.r for r in features.correlation_matrix(df).where("link_id = 'a'").collect()}
    assert np.allclose([c[i, j] for i in range(6) for j in range(6)], np.corrcoef(groups["a"].T).ravel(), atol=1e-6)
    v = {(r.link_id, r.k1, r.k2): r.c for r in features.covariance_matrix(df).collect()}
    assert v["b", 0, 0] is None and np.isclose(v["c", 1, 2], np.cov(groups["c"].T)[1, 2]) and len(v) == 36 + 9 + 16 + 4
    flat = {(r.k1, r.k2): r.r for r in features.correlation_matrix(df).where("link_id = 'd'").collect()}
    assert np.isnan(flat[0, 0]) and np.isnan(flat[0, 1]) and flat[1, 1] == 1.0


def test_a_task_passes_on_what_it_cannot_hold(spark, monkeypatch):
    monkeypatch.setattr(moments, "HELD", 20)
    x = np.random.default_rng(1).normal(size=(90, 4))
    df = spark.createDataFrame([(f"k{i % 30}", row.tolist()) for i, row in enumerate(x)], "link_id string, amplitude array<double>").coalesce(1)
    got = {r.link_id: r.n for r in moments.moments(df, "amplitude", ["link_id"]).collect()}
    assert got == {f"k{i}": 3 for i in range(30)}


def test_no_vectors_and_ragged_ones(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0])], "link_id string, amplitude array<double>")
    assert moments.moments(df.where("false"), "amplitude", []).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        moments.moments(df, "amplitude", ["link_id"]).collect()
    with pytest.raises(ValueError, match="too few"):
        latent.PCAEncoder(2, 1).fit(df.where("false"), "amplitude")


def test_what_is_shuffled_is_a_matrix_a_task(spark):
    """A row for each key and task, however many frames and subcarriers there are."""
    df = spark.range(0, 4000, 1, 5).selectExpr("'only' as link_id", "transform(sequence(1, 30), k -> sin(id * k)) as amplitude")
    parts = moments.moments(df, "amplitude", ["link_id"])
    assert parts.count() == 1 and parts.first().n == 4000
    x = np.sin(np.outer(np.arange(4000), np.arange(1, 31)))
    assert np.allclose(np.reshape(parts.first().m2, (30, 30)), (x - x.mean(0)).T @ (x - x.mean(0)), atol=1e-6)
