"""Whitening against the eigenvectors of the exact covariance."""

import numpy as np
import pytest

from ratewise.llm import whitening


def expected(vectors, components=16):
    x = np.floor(64 * np.asarray(vectors, np.float64)) + 1_000_000
    fit = np.unique(x, axis=0)
    centre = fit.mean(axis=0)
    c = fit - centre
    values, axes = np.linalg.eigh(c.T @ c / len(fit))
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return x, fit, (x - centre) @ axes / np.sqrt(np.maximum(values, 1e-300)), values, np.trace(c.T @ c / len(fit))


def frame(spark, vectors):
    rows = [(i, [float(v) for v in vec], "kept out") for i, vec in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string")


def run(spark, vectors, components=16):
    got = whitening.whitened(frame(spark, vectors), components=components).toPandas()
    return got, got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()


def data(n, width, seed):
    rng = np.random.default_rng(seed)
    return np.float32(rng.normal(size=(n, width)) * np.linspace(1, 3, width) @ rng.normal(size=(width, width)))


def test_components_and_repeats(spark):
    vectors = data(400, 20, 1)
    vectors = np.concatenate([vectors, vectors[:150]])  # copies weigh nothing in the fit
    x, fit, z, values, trace = expected(vectors)
    got, p = run(spark, vectors)
    assert len(got) == 550 * 16 and (got["n"] == len(fit)).all()
    assert np.abs(p * np.sign((p * z).sum(0)) - z).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), values / trace, rtol=1e-10)
    assert got["identity_error"].max() < 1e-12
    n, s = len(fit), fit.sum(axis=0)
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s)) for row in x]
    assert got.groupby("vec_id")["deviation"].first().tolist() == exact


def test_ill_conditioned(spark):
    vectors = data(300, 8, 2)
    vectors[:, 3] = vectors[:, 2] * 2000 + vectors[:, 3]  # scales far apart
    x, fit, z, values, trace = expected(vectors)
    got, p = run(spark, vectors)
    assert p.shape[1] == 8 and got["identity_error"].max() < 1e-9
    assert np.abs(p * np.sign((p * z).sum(0)) - z).max() < 1e-5


def test_rank_deficient(spark):
    vectors = data(12, 30, 3)  # 11 directions at most
    x, fit, z, values, trace = expected(vectors)
    got, p = run(spark, vectors)
    assert p.shape[1] == 11 and got["identity_error"].max() < 1e-6
    assert np.abs(p * np.sign((p * z[:, :11]).sum(0)) - z[:, :11]).max() < 1e-6
    assert got["explained"].groupby(got["component"]).first().sum() == pytest.approx(1.0, abs=1e-9)


def test_no_variance_nulls_and_empty(spark):
    same = frame(spark, [[0.5, 0.25]] * 3)
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.limit(0)).count() == 0
    bad = [None, [None, 1.0], [float("nan"), 1.0], [float("-inf"), 1.0], [1.0], []]
    rows = [(i, v) for i, v in enumerate(bad, 10)] + [(1, [0.5, 1.0]), (None, [1.5, 1.0]), (2, [0.5, 3.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    assert len(got) == 6 and set(got["vec_id"].dropna()) == {1, 2} and (got["n"] == 3).all()


def test_triangles():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(200, 6)) * 10.0 ** np.arange(6)
    triangles = []
    for turn in range(4):
        g = whitening.divided(rows, triangles)
        triangles.append(whitening.triangle(g.T @ g, 200, turn == 0))
    q = whitening.divided(rows, triangles)
    assert np.abs(q.T @ q - np.eye(6)).max() < 1e-13
    r = np.linalg.multi_dot(triangles[::-1])
    assert np.allclose(r.T @ r, rows.T @ rows, rtol=1e-10)
