"""Maximum-likelihood factor analysis with oblimin rotation, from the correlation matrix that Spark sums.

Only the items' matrix reaches the driver; scores are a dot product per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.survey import covariances

LEAST = 0.005  # a uniqueness is no smaller


@dataclass
class Factors:
    """Pattern ``loadings`` [items, factors], correlations ``phi`` of the factors, ``unique`` variances, the items' means and deviations."""

    items: list[str]
    loadings: np.ndarray
    phi: np.ndarray
    unique: np.ndarray
    r: np.ndarray
    means: np.ndarray
    sd: np.ndarray
    rows: int
    criterion: float


def extract(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unrotated loadings, uniquenesses and the likelihood criterion: the eigenvalues beyond ``k`` of the scaled
    matrix come as near to one as uniquenesses let them (quasi-Newton steps on their logarithms)."""
    p = len(r)

    def at(theta):
        s = np.exp(-theta / 2)
        values, axes = np.linalg.eigh(r * s * s[:, None])
        values, axes = values[::-1], axes[:, ::-1]
        load = axes[:, :k] * np.sqrt(np.maximum(values[:k] - 1, 0)) / s[:, None]
        rest = np.maximum(values[k:], 1e-300)
        psi = np.exp(theta)
        return float(np.sum(rest - np.log(rest) - 1)), (np.sum(load ** 2, 1) + psi - np.diag(r)) / psi, load

    low = math.log(LEAST)
    theta = np.clip(np.log((1 - 0.5 * k / p) / np.diag(np.linalg.inv(r))), low, 0.0)
    f, g, load = at(theta)
    h = np.eye(p)
    for _ in range(2000):
        free = ~((theta <= low) & (g > 0) | (theta >= 0) & (g < 0))
        if not free.any() or np.abs(g[free]).max() < 1e-10:
            break
        step = np.zeros(p)
        step[free] = -h[np.ix_(free, free)] @ g[free]
        if step @ g >= 0:
            h = np.eye(p)
            step = np.where(free, -g, 0)
        t = 1.0
        while True:
            new = np.clip(theta + t * step, low, 0.0)
            f2, g2, load2 = at(new)
            if f2 <= f + 1e-4 * g @ (new - theta) or t < 1e-12:
                break
            t /= 2
        s, y = new - theta, g2 - g
        if s @ y > 1e-14:
            a = np.eye(p) - np.outer(s, y) / (s @ y)
            h = a @ h @ a.T + np.outer(s, s) / (s @ y)
        done = t < 1e-12 or np.abs(s).max() < 1e-13
        theta, f, g, load = new, f2, g2, load2
        if done:
            break
    return load, np.exp(theta), f


def oblimin(load: np.ndarray, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Oblique rotation that lets few factors share an item: pattern loadings and factor correlations.

    The sum over pairs of factors of products of squared loadings is lowered by projected gradient steps on
    axes of unit length.
    """
    k = load.shape[1]
    if k == 1:
        return load, np.eye(1)
    others = np.ones((k, k)) - np.eye(k)
    t, step = np.eye(k), 1.0

    def at(t):
        pattern = load @ np.linalg.inv(t).T
        return pattern, float(np.sum(pattern ** 2 * (pattern ** 2 @ others)) / 4)

    pattern, f = at(t)
    for _ in range(rounds):
        slope = -(pattern.T @ (pattern * (pattern ** 2 @ others)) @ np.linalg.inv(t)).T
        slope = slope - t * np.sum(t * slope, 0)
        size = np.linalg.norm(slope)
        if size < 1e-9:
            break
        step *= 2
        while True:
            new = t - step * slope
            new = new / np.linalg.norm(new, axis=0)
            pattern2, f2 = at(new)
            if f2 < f - step * size ** 2 / 2 or step < 1e-14:
                break
            step /= 2
        if step < 1e-14:
            break
        t, pattern, f = new, pattern2, f2
    return pattern, t.T @ t


def analyse(df: DataFrame, items: Sequence[str], k: int) -> Factors:
    """Factors of the items over complete rows, the one with most variance first and with a positive sum of loadings."""
    n, c = covariances(df, items)
    m = np.array([[c[a, b] for b in items] for a in items], float)
    sd = np.sqrt(np.diag(m))
    r = m / sd / sd[:, None]
    means = df.dropna(subset=list(items)).agg(*[F.avg(i) for i in items]).first()
    load, unique, criterion = extract(r, k)
    pattern, phi = oblimin(load)
    order = np.argsort(-np.sum(pattern * (pattern @ phi), 0), kind="stable")
    sign = np.where(pattern[:, order].sum(0) < 0, -1.0, 1.0)
    pattern, phi = pattern[:, order] * sign, phi[np.ix_(order, order)] * sign * sign[:, None]
    return Factors(list(items), pattern, phi, unique, r, np.array([float(x) for x in means]), sd, n, criterion)


def loadings(spark, f: Factors) -> DataFrame:
    """``item, factor, loading, communality, uniqueness``."""
    shared = np.sum(f.loadings * (f.loadings @ f.phi), 1)
    rows = [(i, j + 1, float(f.loadings[a, j]), float(shared[a]), float(f.unique[a])) for a, i in enumerate(f.items) for j in range(f.loadings.shape[1])]
    return spark.createDataFrame(rows, "item string, factor int, loading double, communality double, uniqueness double")


def loading_table(made: DataFrame, factors: int, cut: float = 0.3) -> DataFrame:
    """One row per item: its loadings (NULL under ``cut`` in size), communality, and its ``main`` factor, by which rows are to be read in order of size."""
    wide = made.groupBy("item").agg(*[F.max(F.when((F.col("factor") == j) & (F.abs("loading") >= cut), F.col("loading"))).alias(f"f{j}") for j in range(1, factors + 1)],
                                    F.max("communality").alias("communality"), F.max_by("factor", F.abs("loading")).alias("main"),
                                    F.max(F.abs("loading")).alias("size"))
    return wide.orderBy("main", F.desc("size"), "item")


def _root(m: np.ndarray, power: float) -> np.ndarray:
    values, axes = np.linalg.eigh((m + m.T) / 2)
    return (axes * np.maximum(values, 1e-12) ** power) @ axes.T


def weights(f: Factors) -> np.ndarray:
    """Weights of ten Berge's scores for standardised items: the scores correlate as the factors do."""
    inner = _root(f.r, -0.5) @ f.loadings @ _root(f.phi, 0.5)
    return _root(f.r, -0.5) @ inner @ _root(inner.T @ inner, -0.5) @ _root(f.phi, 0.5)


def scores(df: DataFrame, f: Factors) -> DataFrame:
    """``df`` with ``score_1`` ...; a row with a missing item has none."""
    w = weights(f)
    columns = [sum(((F.col(i).cast("double") - float(m)) * float(x / s) for i, m, s, x in zip(f.items, f.means, f.sd, w[:, j])), F.lit(0.0)).alias(f"score_{j + 1}")
               for j in range(w.shape[1])]
    return df.select("*", *columns)
