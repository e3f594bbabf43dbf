"""Factor analysis on a planted structure, and condition indexes, against numpy."""

import numpy as np

from panelwright.operators import factors as FA
from panelwright.operators import models as L

LOAD = np.array([[0.8, 0], [0.7, 0], [0.75, 0.1], [0, 0.8], [0.1, 0.65], [0, 0.7]])
PHI = np.array([[1, 0.3], [0.3, 1]])


def planted(n=3000, seed=6):
    rng = np.random.default_rng(seed)
    r = LOAD @ PHI @ LOAD.T
    np.fill_diagonal(r, 1)
    return rng.multivariate_normal(np.zeros(6), r, n) * [1, 2, 3, 1, 0.5, 4] + [5, 0, 1, 2, 3, 4], r


def test_extraction_and_rotation():
    _, r = planted()
    load, unique, criterion = FA.extract(r, 2)
    assert criterion < 1e-12 and np.allclose(load @ load.T + np.diag(unique), r, atol=1e-6)
    pattern, phi = FA.oblimin(load)
    assert np.allclose(pattern @ phi @ pattern.T, load @ load.T, atol=1e-9) and np.allclose(np.diag(phi), 1)

    def crossing(p):
        return np.sum(p[:, 0] ** 2 * p[:, 1] ** 2)

    rng = np.random.default_rng(1)
    t = np.linalg.cholesky(phi).T  # axes with these correlations; no axes near by do better
    base = load @ np.linalg.inv(t).T
    q, _, w = np.linalg.svd(np.linalg.lstsq(base, pattern, rcond=None)[0])
    for _ in range(300):
        a = rng.normal(0, 0.2, (2, 2)) + np.linalg.lstsq(load, pattern @ np.linalg.cholesky(phi), rcond=None)[0]
        axes = np.linalg.inv(a @ np.linalg.inv(np.linalg.cholesky(phi))).T
        axes = axes / np.linalg.norm(axes, axis=0)
        assert crossing(load @ np.linalg.inv(axes).T) >= crossing(pattern) - 1e-9


def test_factors_scores_and_table(spark):
    x, _ = planted()
    items = [f"i{k}" for k in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * 6], ", ".join(f"{i} double" for i in items))
    f = FA.analyse(df, items, 2)
    order = np.argsort([-abs(f.loadings[0, j]) for j in range(2)])
    assert f.rows == 3000 and np.allclose(f.loadings[:, order], LOAD, atol=0.08) and abs(f.phi[0, 1] - 0.3) < 0.15
    assert np.allclose(np.sum(f.loadings * (f.loadings @ f.phi), 1) + f.unique, 1, atol=1e-6)
    rows = FA.scores(df, f).select("score_1", "score_2").collect()
    s = np.array([tuple(r) for r in rows if r["score_1"] is not None])
    assert len(s) == 3000 and np.allclose(np.cov(s.T), f.phi, atol=1e-9) and np.allclose(s.mean(0), 0, atol=1e-9)
    made = FA.loading_table(FA.loadings(spark, f), 2, cut=0.3).collect()
    assert len(made) == 6 and all((r["f1"] is None) != (r["f2"] is None) for r in made)
    one = FA.analyse(df, items, 1)
    assert one.loadings.shape == (6, 1) and np.allclose(one.phi, 1)


def test_condition_index(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(3, 1, (200, 3))
    x[:, 2] = x[:, 0] + 0.05 * rng.normal(size=200)
    got = L.condition_index(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"), ["a", "b", "c"]).orderBy("dimension").collect()
    full = np.column_stack([np.ones(200), x])
    full = full / np.linalg.norm(full, axis=0)
    values = np.linalg.svd(full, compute_uv=False)
    assert np.allclose([r["condition_index"] for r in got], values[0] / values, rtol=1e-6)
