"""Least squares, random intercepts and pooling, from cross-products that Spark sums. Only tables as wide as the model
reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group: rows and the upper triangle of (1, xs, y)'(1, xs, y) over complete rows, as array ``c``."""
    full = df.dropna(subset=[y, *xs])
    v = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    return full.groupBy(*by).agg(F.array(*[F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]).alias("c"))


def _square(c: Sequence[float], p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = c
    return m + np.triu(m, 1).T


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``term, estimate, se, t`` per group; the p x p solve runs in tasks, one group record at a time."""
    names = ["(Intercept)", *xs]
    p = len(names)

    def run(frames):
        import pandas as pd

        for f in frames:
            out = []
            for row in f.to_dict("records"):
                m = _square(row["c"], p + 1)
                n, xx, xy = m[0, 0], m[:p, :p], m[:p, p]
                if n <= p or np.linalg.matrix_rank(xx) < p:
                    continue
                b = np.linalg.solve(xx, xy)
                s2 = (m[p, p] - b @ xy) / (n - p)
                se = np.sqrt(s2 * np.diag(np.linalg.inv(xx)))
                out += [(*[row[k] for k in by], t, float(e), float(s), float(e / s) if s else None) for t, e, s in zip(names, b, se)]
            yield pd.DataFrame(out, columns=[*by, "term", "estimate", "se", "t"])

    stats = cross_products(df, y, xs, by)
    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in by)
    return stats.mapInPandas(run, f"{kinds + ', ' if by else ''}term string, estimate double, se double, t double")


def vif(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Variance inflation and tolerance of each term over complete rows."""
    from panelwright.operators.survey import correlation_matrix

    _, r = correlation_matrix(df, xs)
    v = np.diag(np.linalg.inv(r))
    return df.sparkSession.createDataFrame([(x, float(a), float(1 / a)) for x, a in zip(xs, v)], "term string, vif double, tolerance double")


def condition_index(df: DataFrame, xs: Sequence[str]) -> DataFrame:
    """Condition indexes of the unit-scaled design with its intercept."""
    first = df.dropna(subset=list(xs))
    c = cross_products(first, xs[-1], xs[:-1]).first()["c"]
    m = _square(c, len(xs) + 1)
    d = np.sqrt(np.diag(m))
    values = np.sort(np.linalg.eigvalsh(m / d / d[:, None]))[::-1]
    return df.sparkSession.createDataFrame([(i, float(v), float(math.sqrt(values[0] / max(v, 1e-300)))) for i, v in enumerate(values, 1)],
                                           "dimension int, eigenvalue double, condition_index double")


def ols_fits(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Coefficients and their covariance for each value of ``by``: for few fits, such as imputations."""
    p, out = len(xs) + 1, {}
    for r in cross_products(df, y, xs, by).collect():  # a record per fit
        m = _square(r["c"], p + 1)
        b = np.linalg.solve(m[:p, :p], m[:p, p])
        out[tuple(r[k] for k in by)] = b, (m[p, p] - b @ m[:p, p]) / (m[0, 0] - p) * np.linalg.inv(m[:p, :p])
    return out


def random_intercept(df: DataFrame, y: str, xs: Sequence[str], group: str) -> DataFrame:
    """Maximum-likelihood fit of ``y ~ xs + (1 | group)``: one row of estimates and ``se_`` of each, with ``converged`` and ``singular``."""
    from panelwright.operators.mixed import Level, Model

    f = Model(df, y, xs, [Level((group,))]).fit()[""]
    names = ["intercept", *xs]
    row = (*map(float, f.beta), *map(float, np.sqrt(np.diag(f.vcov))), float(f.g[0][0, 0]), float(f.sigma2), float(f.deviance), f.groups, f.rows, bool(f.converged), bool(f.singular))
    return df.sparkSession.createDataFrame([row], ", ".join([*[f"{n} double" for n in names], *[f"se_{n} double" for n in names]])
                                           + ", tau2 double, sigma2 double, deviance double, n_groups bigint, n_rows bigint, converged boolean, singular boolean")


def pool(estimates: DataFrame, *, m: int, by: Sequence[str] = ("term",)) -> DataFrame:
    """Rubin's rules over ``imp``: pooled estimate, error, t, degrees of freedom, riv and fmi."""
    per = estimates.groupBy(*by).agg(F.avg("estimate").alias("estimate"), F.avg(F.col("se") * F.col("se")).alias("w"),
                                     F.var_samp("estimate").alias("b"))
    extra = F.col("b") * (1 + 1 / m)
    riv = F.try_divide(extra, F.col("w"))
    free = F.lit(m - 1.0) * F.pow(1 + F.try_divide(F.lit(1.0), F.col("riv")), 2)
    fmi = F.try_divide(F.col("riv") + 2 / (F.col("dof") + 3), F.col("riv") + 1)
    return (per.withColumns({"se": F.sqrt(F.col("w") + extra), "riv": riv}).withColumn("t", F.try_divide("estimate", "se"))
            .withColumn("dof", free).withColumn("fmi", fmi).select(*by, "estimate", "se", "t", "dof", "riv", "fmi"))


def gelman_rubin(df: DataFrame, chain: str, value: str) -> DataFrame:
    """Potential scale reduction over chains of unequal length (mean length)."""
    per = df.groupBy(chain).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("var"), F.count(value).alias("n")).where("n > 1")
    all_ = per.agg(F.avg("var").alias("w"), F.var_samp("mean").alias("b"), F.avg("n").alias("len"), F.count("*").alias("chains"))
    total = (F.col("len") - 1) / F.col("len") * F.col("w") + F.col("b")
    return all_.select("chains", F.sqrt(F.try_divide(total, F.col("w"))).alias("rhat"))


def monte_carlo_error(draws: DataFrame, chain: str, value: str, position: str, size: int) -> DataFrame:
    """Of each chain: batches of ``size`` draws in their order, and the error of their means over the deviation of the draws.

    Chains of one batch or of equal draws are left out.
    """
    batches = draws.groupBy(chain, F.floor((F.col(position) - 1) / size).alias("batch")).agg(F.avg(value).alias("m"))
    error = batches.groupBy(chain).agg(F.count("*").alias("batches"), F.sqrt(F.try_divide(F.var_samp("m"), F.count("*"))).alias("error")).where("batches > 1")
    spread = draws.groupBy(chain).agg(F.stddev_samp(value).alias("sd")).where("sd > 0")
    return error.join(spread, chain).select(chain, "batches", (F.col("error") / F.col("sd")).alias("ratio"))


def densities(df: DataFrame, chain: str, value: str, width: float) -> DataFrame:
    """Share of a chain's values in each bin of ``width``, over the width."""
    cells = df.where(F.col(value).isNotNull()).groupBy(chain, F.floor(F.col(value) / width).alias("bin")).agg(F.count("*").alias("n"))
    total = cells.groupBy(chain).agg(F.sum("n").alias("all"))
    return cells.join(total, chain).select(chain, "bin", (F.col("n") / (F.col("all") * width)).alias("density"))
