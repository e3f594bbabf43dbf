"""Linear mixed models by maximum likelihood, from one record of cross-products per group.

``y ~ xs`` with random effects of some of these terms, on one level of groups or on nested levels. Rows are reduced once;
everything after runs on the records. With W = I + Z L L'Z', the cross-products of (X, y) under the inverse of W are those of
the records less a term of the size of Z; groups inside groups are taken in turn, inner ones summed first. The
relative factor L is searched by Newton steps on differences of the deviance: each step is one job over a set of
candidates, for all fits (say, imputations) at once. Only tables as wide as the model reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.models import _square, cross_products
from panelwright.session import materialize

STEPS = 200
INTERCEPT = "(Intercept)"
TOLERANCE = 1e-4  # a factor below it counts as zero


@dataclass(frozen=True)
class Level:
    """Random effects of ``terms`` for each group of ``groups``; ``diagonal`` leaves out their correlations."""

    groups: tuple[str, ...]
    terms: tuple[str, ...] = (INTERCEPT,)
    diagonal: bool = False

    @property
    def size(self) -> int:
        q = len(self.terms)
        return q if self.diagonal else q * (q + 1) // 2

    def factor(self, theta: np.ndarray, scale: np.ndarray) -> np.ndarray:
        q = len(self.terms)
        out = np.zeros((q, q))
        out[np.diag_indices(q) if self.diagonal else np.tril_indices(q)] = theta
        return out / scale[:, None]


@dataclass
class Fit:
    """One fitted model. ``g`` holds the covariance of the effects of each level, ``factor`` L of each level."""

    key: str
    terms: list[str]
    levels: list[Level]
    beta: np.ndarray
    vcov: np.ndarray
    sigma2: float
    g: list[np.ndarray]
    factor: list[np.ndarray]
    deviance: float
    rows: int
    groups: int
    converged: bool
    singular: bool
    sums: np.ndarray = field(repr=False)

    @property
    def parameters(self) -> int:
        return len(self.beta) + sum(v.size for v in self.levels) + 1


def absorbed(c: np.ndarray, at: Sequence[int], factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cross-products ``[groups, m, m]`` with a group effect taken in, and the log determinant of each group."""
    reach = c[:, :, at] @ factor
    inner = np.eye(factor.shape[1]) + np.einsum("ki,gkj->gij", factor, reach[:, at])
    return c - reach @ np.linalg.solve(inner, reach.transpose(0, 2, 1)), np.linalg.slogdet(inner)[1]


def _unfolded(c, m: int) -> np.ndarray:
    flat = np.stack(list(c)) if len(c) else np.zeros((0, m * (m + 1) // 2))
    out = np.zeros((len(flat), m, m))
    i, j = np.triu_indices(m)
    out[:, i, j] = flat
    out[:, j, i] = flat
    return out


class Model:
    """Group records of a model and what is computed from them."""

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], levels: Sequence[Level], by: Sequence[str] = (), records: DataFrame | None = None):
        self.y, self.xs, self.levels, self.by = y, list(xs), list(levels), list(by)
        self.terms = [INTERCEPT, *xs]
        self.m = len(self.terms) + 1
        self.at = [[self.terms.index(t) for t in v.terms] for v in self.levels]
        if len(self.levels) > 2 or len(self.levels) == 2 and not set(self.levels[1].groups) < set(self.levels[0].groups):
            raise ValueError("levels are the inner one and, if any, one that its groups lie in")
        self.groups = list(self.levels[0].groups)
        if records is None:
            key = F.concat_ws("|", *[F.col(b).cast("string") for b in by]) if by else F.lit("")
            made = cross_products(df, y, xs, [*by, *self.groups]).withColumn("__key", key)
            records = materialize(made.withColumnRenamed("c", "__c"), "groups")
        self.records = records
        self.spark = records.sparkSession

    def without(self, condition) -> Model:
        """The model without the groups that meet ``condition``: records are left out, rows are not read again."""
        return Model(None, self.y, self.xs, self.levels, self.by, self.records.where(~condition))

    def sums(self, candidates: Mapping[str, Sequence[Sequence[np.ndarray]]]) -> dict[tuple[str, int], tuple[np.ndarray, float, int, int]]:
        """Of each key's candidates (a factor for each level): summed cross-products, log determinant, rows, groups. One job."""
        m, at, two = self.m, self.at, len(self.levels) == 2
        i, j = np.triu_indices(m)
        kept = self.levels[1].groups if two else ()

        def inner(frames):
            for f in frames:
                out = []
                for names, part in f.groupby(["__key", *kept], dropna=False, sort=False):
                    c = _unfolded(part["__c"], m)
                    for k, factors in enumerate(candidates.get(names[0], ())):
                        q, logs = absorbed(c, at[0], factors[0])
                        out.append((*names, k, [*q.sum(0)[i, j].tolist(), float(logs.sum()), float(c[:, 0, 0].sum()), float(len(c))]))
                yield pd.DataFrame(out, columns=["__key", *kept, "k", "v"])

        def outer(frames):
            for f in frames:
                out = []
                for (key, k), part in f.groupby(["__key", "k"], sort=False):
                    v = np.stack(list(part["v"]))
                    q, logs = absorbed(_unfolded(v[:, :-3], m), at[1], candidates[key][k][1])
                    out.append((key, k, [*q.sum(0)[i, j].tolist(), float(v[:, -3].sum() + logs.sum()), float(v[:, -2].sum()), float(v[:, -1].sum())]))
                yield pd.DataFrame(out, columns=["__key", "k", "v"])

        kinds = dict(self.records.dtypes)
        places = "".join(f", {g} {kinds[g]}" for g in kept)
        added = F.array(*[F.sum(F.col("v")[x]) for x in range(len(i) + 3)]).alias("v")
        parts = self.records.select("__key", *kept, "__c").mapInPandas(inner, f"__key string{places}, k int, v array<double>")
        if two:
            parts = parts.groupBy("__key", *kept, "k").agg(added).mapInPandas(outer, "__key string, k int, v array<double>")
        found = parts.groupBy("__key", "k").agg(added).collect()  # one row per fit and candidate
        return {(r["__key"], r["k"]): (_square(r["v"][:-3], m), r["v"][-3], round(r["v"][-2]), round(r["v"][-1])) for r in found}

    def _scales(self) -> dict[str, list[np.ndarray]]:
        zero = [np.zeros((len(a), len(a))) for a in self.at]
        keys = [r["__key"] for r in self.records.select("__key").distinct().collect()]  # one per fit
        plain = self.sums({k: [zero] for k in keys})
        out = {}
        for k in keys:
            c, _, n, _ = plain[k, 0]
            out[k] = [np.sqrt(np.maximum(np.diag(c)[a] / n, 1e-12)) for a in self.at]
        return out

    def _profile(self, value) -> tuple[float, np.ndarray, float]:
        c, logs, n, _ = value
        b = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
        s2 = max((c[-1, -1] - b @ c[:-1, -1]) / n, 1e-300)
        return n * math.log(2 * math.pi * s2) + n + logs, b, s2

    def fit(self) -> dict[str, Fit]:
        """The maximum-likelihood fit of each key. ``converged`` is False after ``STEPS`` steps; ``singular`` tells a
        covariance of less than full rank."""
        scales = self._scales()
        cuts = np.cumsum([0, *[v.size for v in self.levels]])
        size = int(cuts[-1])

        def factors(key, theta):
            return [v.factor(theta[a:b], s) for v, a, b, s in zip(self.levels, cuts, cuts[1:], scales[key])]

        start = np.concatenate([np.ones(v.size) if v.diagonal else np.eye(len(v.terms))[np.tril_indices(len(v.terms))] for v in self.levels])
        now = {k: start.copy() for k in scales}
        best, moved, state = {}, dict.fromkeys(scales, math.inf), dict.fromkeys(scales, False)
        e = np.eye(size)
        h = 1e-3
        mixed = [(a, b) for a in range(size) for b in range(a)]
        stencil = [0 * start, *[h * e[a] for a in range(size)], *[-h * e[a] for a in range(size)],
                   *[2 * h * e[a] for a in range(size)], *[-2 * h * e[a] for a in range(size)],
                   *[h * (e[a] + e[b]) for a, b in mixed], *[-h * (e[a] + e[b]) for a, b in mixed]]
        reach = [1.0, 0.5, 0.25, 0.1, 0.03, 0.003, 2.0]
        for _ in range(STEPS):
            todo = [k for k in now if not state[k]]
            if not todo:
                break
            found = self.sums({k: [factors(k, now[k] + s) for s in stencil] for k in todo})
            steps = {}
            for k in todo:
                d = np.array([self._profile(found[k, i])[0] for i in range(len(stencil))])
                best[k] = (d[0], now[k], found[k, 0])
                up, down, up2, down2 = d[1:4 * size + 1].reshape(4, size)
                slope = (8 * (up - down) - (up2 - down2)) / (12 * h)
                curve = np.diag((up + down - 2 * d[0]) / h ** 2)
                for n, (a, b) in enumerate(mixed):
                    both = d[4 * size + 1 + n] + d[4 * size + 1 + len(mixed) + n]
                    curve[a, b] = curve[b, a] = (both - up[a] - up[b] - down[a] - down[b] + 2 * d[0]) / (2 * h ** 2)
                values, axes = np.linalg.eigh(curve)
                floor = max(1e-6 * np.abs(values).max(), 1e-9)
                step = -(axes / np.maximum(np.abs(values), floor)) @ (axes.T @ slope)
                steps[k] = step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            tried = self.sums({k: [factors(k, now[k] + t * steps[k]) for t in reach] for k in todo})
            for k in todo:
                d = [self._profile(tried[k, i])[0] for i in range(len(reach))]
                i = int(np.argmin(d))
                gain = best[k][0] - d[i]
                if gain > 0:
                    now[k] = now[k] + reach[i] * steps[k]
                    best[k] = (d[i], now[k], tried[k, i])
                state[k] = gain < 1e-9 * (1 + abs(best[k][0])) and (moved[k] < 1e-6 * (1 + abs(best[k][0])) or gain <= 0)
                moved[k] = gain
        out = {}
        for k, (dev, theta, value) in best.items():
            _, b, s2 = self._profile(value)
            c, _, n, groups = value
            f = factors(k, theta)
            s2 = float(s2)
            flat = any(np.linalg.svd(x * s[:, None], compute_uv=False)[-1] < TOLERANCE for x, s in zip(f, scales[k]))
            out[k] = Fit(k, self.terms, self.levels, b, s2 * np.linalg.pinv(c[:-1, :-1]), s2, [s2 * x @ x.T for x in f], f, float(dev), n, groups, bool(state[k]), flat, c)
        return out

    def deviances(self, at: Mapping[str, tuple[np.ndarray, float, list[np.ndarray]]]) -> dict[str, float]:
        """Deviance of each key at stated coefficients, residual variance and covariances."""
        def root(g):
            values, axes = np.linalg.eigh(g)
            return axes * np.sqrt(np.maximum(values, 0))

        found = self.sums({k: [[root(g / s2) for g in gs]] for k, (_, s2, gs) in at.items()})
        out = {}
        for k, (b, s2, _) in at.items():
            c, logs, n, _ = found[k, 0]
            v = np.append(-np.asarray(b), 1.0)
            out[k] = n * math.log(2 * math.pi * s2) + logs + float(v @ c @ v) / s2
        return out

    def effects(self, fits: Mapping[str, Fit]) -> DataFrame:
        """Predicted effects of the groups of a one-level model: ``effect_<i>`` and ``coef_<i>`` by random term, in order."""
        if len(self.levels) != 1:
            raise ValueError("effects are predicted for one level of groups")
        at, m, q = self.at[0], self.m, len(self.at[0])
        names = [*self.by, *self.groups]

        def run(frames):
            for f in frames:
                out = []
                for key, part in f.groupby("__key", sort=False):
                    fit = fits[key]
                    c, lam = _unfolded(part["__c"], m), fit.factor[0]
                    inner = np.eye(q) + np.einsum("ki,gkl,lj->gij", lam, c[:, at][:, :, at], lam)
                    zr = c[:, at, -1] - c[:, at, :-1] @ fit.beta
                    u = np.linalg.solve(inner, (zr @ lam)[:, :, None])[:, :, 0] @ lam.T
                    made = part[names].reset_index(drop=True)
                    for i in range(q):
                        made[f"effect_{i}"] = u[:, i]
                        made[f"coef_{i}"] = u[:, i] + fit.beta[at[i]]
                    out.append(made)
                if out:
                    yield pd.concat(out)

        kinds = dict(self.records.dtypes)
        shape = ", ".join([*[f"{n} {kinds[n]}" for n in names], *[f"effect_{i} double, coef_{i} double" for i in range(q)]])
        return self.records.mapInPandas(run, shape)

    def influence(self, fits: Mapping[str, Fit]) -> DataFrame:
        """Coefficients without each group, at the variances of the whole fit, and Cook's distance of the group.

        Each group's share is taken off the sums, so rows are not read again.
        """
        if len(self.levels) != 1:
            raise ValueError("influence is of one level of groups")
        at, m, p = self.at[0], self.m, len(self.terms)
        names = [*self.by, *self.groups]

        def run(frames):
            for f in frames:
                out = []
                for key, part in f.groupby("__key", sort=False):
                    fit = fits[key]
                    q, _ = absorbed(_unfolded(part["__c"], m), at, fit.factor[0])
                    rest = fit.sums - q
                    b = (np.linalg.pinv(rest[:, :p, :p]) @ rest[:, :p, p:])[:, :, 0]
                    off = fit.beta - b
                    made = part[names].reset_index(drop=True)
                    made["cooks"] = np.einsum("gi,ij,gj->g", off, np.linalg.pinv(fit.vcov), off) / p
                    made["b"] = list(b)
                    out.append(made)
                if out:
                    yield pd.concat(out)

        kinds = dict(self.records.dtypes)
        return self.records.mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", cooks double, b array<double>")


def nested(outer: str, inner: str, terms: Sequence[str] = (INTERCEPT,)) -> list[Level]:
    """Levels of ``(terms | outer/inner)``."""
    return [Level((outer, inner), tuple(terms)), Level((outer,), tuple(terms))]


def estimates(spark, fits: Mapping[str, Fit]) -> DataFrame:
    """``fit, term, estimate, se`` of the fixed effects."""
    rows = [(k, t, float(b), float(s)) for k, f in fits.items() for t, b, s in zip(f.terms, f.beta, np.sqrt(np.diag(f.vcov)))]
    return spark.createDataFrame(rows, "fit string, term string, estimate double, se double")


def components(spark, fits: Mapping[str, Fit]) -> DataFrame:
    """``fit, level, term, other, covariance, correlation`` of the random effects; the residual variance has level ``residual``.

    A correlation with an effect of no variance is NULL.
    """
    rows = []
    for k, f in fits.items():
        for level, g in zip(f.levels, f.g):
            sd = np.sqrt(np.diag(g))
            for i, a in enumerate(level.terms):
                for j, b in enumerate(level.terms[:i + 1]):
                    both = sd[i] * sd[j]
                    rows.append((k, "/".join(level.groups), a, b, float(g[i, j]), float(g[i, j] / both) if i != j and both > 0 else None))
        rows.append((k, "residual", "", "", float(f.sigma2), None))
    return spark.createDataFrame(rows, "fit string, level string, term string, other string, covariance double, correlation double")


def quality(spark, fits: Mapping[str, Fit]) -> DataFrame:
    """``fit, deviance, loglik, aic, bic, parameters, n_rows, n_groups, converged, singular``."""
    rows = [(k, f.deviance, -f.deviance / 2, f.deviance + 2 * f.parameters, f.deviance + math.log(f.rows) * f.parameters, f.parameters, f.rows, f.groups,
             f.converged, bool(f.singular)) for k, f in fits.items()]
    return spark.createDataFrame(rows, "fit string, deviance double, loglik double, aic double, bic double, parameters int, n_rows bigint, n_groups bigint, converged boolean, singular boolean")


def likelihood_ratio(spark, smaller: Fit, larger: Fit) -> DataFrame:
    """Chi-square test of one model inside another."""
    from panelwright.functions.dist import chi2_tail

    df = larger.parameters - smaller.parameters
    chi2 = max(smaller.deviance - larger.deviance, 0.0)
    return spark.createDataFrame([(float(chi2), df, float(chi2_tail(chi2, df)))], "chi2 double, df int, p double")


def variance_shares(model: Model, fit: Fit, null: Fit | None = None) -> dict[str, float | None]:
    """Marginal and conditional share of the variance; against ``null``, what of the residual (``level1``), intercept (``level2``)
    and total variance (``total``) the model takes off."""
    zero = [np.zeros((len(a), len(a))) for a in model.at]
    c, _, n, _ = model.sums({fit.key: [zero]})[fit.key, 0]
    xx = c[:-1, :-1] / n
    mean = xx[0] @ fit.beta
    fixed = float(fit.beta @ xx @ fit.beta - mean * mean)
    random = float(sum(np.sum(g * xx[np.ix_(a, a)]) for g, a in zip(fit.g, model.at)))
    total = fixed + random + fit.sigma2
    out = {"marginal": float(fixed / total), "conditional": float((fixed + random) / total)}
    if null is not None:
        a, b = float(fit.g[0][0, 0]), float(null.g[0][0, 0])
        out |= {"level1": float(1 - fit.sigma2 / null.sigma2), "level2": float(1 - a / b) if b > 0 else None,
                "total": float(1 - (fit.sigma2 + a) / (null.sigma2 + b))}
    return out


def slope_share(fit: Fit, term: str) -> float:
    """Share of ``term``'s effect in the variance of intercept, ``term``, their covariance (twice) and the residual."""
    g, terms = fit.g[0], fit.levels[0].terms
    i, j = terms.index(INTERCEPT), terms.index(term)
    return float(g[j, j] / (g[i, i] + g[j, j] + fit.sigma2 + 2 * g[i, j]))


def predict(df: DataFrame, model: Model, fits: Mapping[str, Fit]) -> DataFrame:
    """``df`` with the prediction from the fixed part, with the group's effects, and the residuals of both.

    A group without a record has effects of zero; a row with a missing term has no prediction.
    """
    level = model.levels[0]
    names = [*model.by, *model.groups]
    key = F.concat_ws("|", *[F.col(b).cast("string") for b in model.by]) if model.by else F.lit("")
    values = {t: F.lit(1.0) if t == INTERCEPT else F.col(t).cast("double") for t in model.terms}
    beta = None
    for k, f in fits.items():
        whole = sum((F.lit(float(b)) * values[t] for t, b in zip(f.terms, f.beta)), F.lit(0.0))
        beta = F.when(key == k, whole) if beta is None else beta.when(key == k, whole)
    effects = model.effects(fits).select(*[F.col(n).alias(f"__{n}") for n in names], *[f"effect_{i}" for i in range(len(level.terms))])
    joined = df.withColumn("fixed", beta).join(effects, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names], "left")
    random = sum((F.coalesce(f"effect_{i}", F.lit(0.0)) * values[t] for i, t in enumerate(level.terms)), F.lit(0.0))
    out = joined.withColumn("fitted", F.col("fixed") + random)
    return out.select(*df.columns, "fixed", "fitted", (F.col(model.y) - F.col("fixed")).alias("residual_fixed"), (F.col(model.y) - F.col("fitted")).alias("residual"))


BOUND = 400  # rows of a cluster up to which its adjustment matrix is built


def robust(df: DataFrame, model: Model, fit: Fit, bound: int = BOUND) -> DataFrame:
    """Cluster-robust errors of the fixed effects: ``term, estimate, se, t, df, p, n_plain``.

    Clusters of up to ``bound`` rows take the bias-reduced adjustment (CR2) with the model as working covariance. Larger ones
    come from their records without rows being gathered, scaled by groups / (groups - 1) (CR1); ``n_plain`` counts them. The
    degrees of freedom are groups - 1.
    """
    from panelwright.functions.dist import t_tail

    if len(model.levels) != 1 or model.by:
        raise ValueError("robust errors are for one fit with one level of groups")
    level, at, m, p = model.levels[0], model.at[0], model.m, len(model.terms)
    bread, beta, s2, g, lam = fit.vcov, fit.beta, fit.sigma2, fit.g[0], fit.factor[0]
    xs, y, groups = model.xs, model.y, model.groups
    rows = F.col("__c")[0]
    i, j = np.triu_indices(p)

    def outer(scores: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"v": [(scores.T @ scores)[i, j].tolist()], "n": [len(scores)]})

    def large(frames):
        for f in frames:
            q, _ = absorbed(_unfolded(f["__c"], m), at, lam)
            yield outer((q[:, :p, p] - q[:, :p, :p] @ beta) / s2)

    def small(f: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(f)), *[f[c].astype(float) for c in xs]])
        z = x[:, at]
        v = s2 * np.eye(len(x)) + z @ g @ z.T
        values, axes = np.linalg.eigh(v)
        half = (axes * np.sqrt(values)) @ axes.T
        b = half @ (v - x @ bread @ x.T) @ half
        w, e = np.linalg.eigh((b + b.T) / 2)
        good = w > 1e-10 * w.max()
        a = half @ ((e[:, good] / np.sqrt(w[good])) @ e[:, good].T) @ half
        return outer((x.T @ np.linalg.solve(v, a @ (f[y].astype(float).to_numpy() - x @ beta)))[None])

    shape = "v array<double>, n bigint"
    plain = model.records.where(rows > bound).select("__c").mapInPandas(large, shape).withColumn("kind", F.lit("CR1"))
    few = model.records.where(rows <= bound).select(*[F.col(c).alias(f"__{c}") for c in groups])
    full = df.dropna(subset=[y, *xs]).select(*groups, y, *xs)
    kept = full.join(few, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in groups], "left_semi")  # at most ``bound`` rows each
    adjusted = kept.groupBy(*groups).applyInPandas(small, shape).withColumn("kind", F.lit("CR2"))
    sums = plain.unionByName(adjusted).groupBy("kind").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(len(i))]).alias("v"), F.sum("n").alias("n")).collect()
    meat, n_plain = np.zeros((p, p)), 0
    for r in sums:  # two rows at most
        meat += _square(r["v"], p) * (fit.groups / (fit.groups - 1) if r["kind"] == "CR1" else 1.0)
        n_plain += r["n"] if r["kind"] == "CR1" else 0
    se = np.sqrt(np.diag(bread @ meat @ bread))
    df_ = fit.groups - 1
    out = [(t, float(b), float(s), float(b / s), df_, float(2 * t_tail(abs(b / s), df_)), n_plain) for t, b, s in zip(model.terms, beta, se)]
    return model.spark.createDataFrame(out, "term string, estimate double, se double, t double, df bigint, p double, n_plain bigint")


def summary(spark, fits: Mapping[str, Fit]) -> DataFrame:
    """``fit, part, name, value, se, z, p``: fixed effects with their errors, standard deviations and correlations of the effects."""
    from panelwright.functions.dist import normal_tail

    rows = []
    for k, f in fits.items():
        for t, b, s in zip(f.terms, f.beta, np.sqrt(np.diag(f.vcov))):
            rows.append((k, "fixed", t, float(b), float(s), float(b / s) if s > 0 else None, float(2 * normal_tail(abs(b / s))) if s > 0 else None))
        for level, g in zip(f.levels, f.g):
            sd = np.sqrt(np.diag(g))
            prefix = "" if len(f.levels) == 1 else "/".join(level.groups) + " "
            rows += [(k, "sd", prefix + t, float(s), None, None, None) for t, s in zip(level.terms, sd)]
            for i, a in enumerate(level.terms):
                for j in range(i):
                    both = sd[i] * sd[j]
                    rows.append((k, "correlation", f"{prefix}{a}:{level.terms[j]}", float(g[i, j] / both) if both > 0 else None, None, None, None))
        rows.append((k, "sd", "residual", float(math.sqrt(f.sigma2)), None, None, None))
    return spark.createDataFrame(rows, "fit string, part string, name string, value double, se double, z double, p double")


def side_by_side(spark, fits: Mapping[str, Fit]) -> DataFrame:
    """One row per term, then ``sigma2``, ``deviance`` and ``aic``; ``<model>_estimate`` and ``<model>_se`` for each model. A term that a model lacks is NULL."""
    terms = list(dict.fromkeys(t for f in fits.values() for t in f.terms))
    columns = {}
    for name, f in fits.items():
        se = dict(zip(f.terms, np.sqrt(np.diag(f.vcov)).tolist()))
        values = dict(zip(f.terms, f.beta.tolist())) | {"sigma2": float(f.sigma2), "deviance": float(f.deviance), "aic": float(f.deviance + 2 * f.parameters)}
        columns[name] = (values, se)
    rows = [(t, *[x for v, se in columns.values() for x in (v.get(t), se.get(t))]) for t in [*terms, "sigma2", "deviance", "aic"]]
    return spark.createDataFrame(rows, "term string, " + ", ".join(f"{n}_estimate double, {n}_se double" for n in fits))


def coefficient_test(a: DataFrame, b: DataFrame) -> DataFrame:
    """``term, estimate_a, estimate_b, z, p`` of the difference between the same coefficients of two models (``term, estimate, se``)."""
    from panelwright.functions.dist import p_normal

    left = a.select("term", F.col("estimate").alias("estimate_a"), F.col("se").alias("se_a"))
    right = b.select("term", F.col("estimate").alias("estimate_b"), F.col("se").alias("se_b"))
    z = F.try_divide(F.col("estimate_a") - F.col("estimate_b"), F.sqrt(F.col("se_a") * F.col("se_a") + F.col("se_b") * F.col("se_b")))
    return left.join(right, "term").withColumn("z", z).select("term", "estimate_a", "estimate_b", "z", p_normal("z").alias("p"))


def grid_means(spark, fits: Mapping[str, tuple[np.ndarray, np.ndarray]], grid: Sequence[Mapping], shape: str) -> DataFrame:
    """Predictions at each point of a grid, averaged over fits ``(coefficients, covariance)``; errors are averaged too.

    A point holds its own columns (``shape``) and its design row ``at``.
    """
    x = np.array([g["at"] for g in grid], float)
    predicted = np.mean([x @ b for b, _ in fits.values()], axis=0)
    se = np.mean([np.sqrt(np.einsum("ij,jk,ik->i", x, v, x)) for _, v in fits.values()], axis=0)
    rows = [(*[v for k, v in g.items() if k != "at"], float(p), float(s)) for g, p, s in zip(grid, predicted, se)]
    return spark.createDataFrame(rows, f"{shape}, predicted double, se double")
