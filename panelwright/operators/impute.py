"""Multiple imputation by chained equations, and pooling of fits over imputations.

Each step reduces the rows to cross-products per imputation and group in one shuffle, draws parameters on the driver (a
record per imputation) from a generator seeded by (seed, imputation, variable, cycle), and fills missing cells with
noise hashed from the row's key, so results do not depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.mixed import Fit, Model
from panelwright.operators.models import _square, cross_products, pool
from panelwright.session import materialize


def hashed_normal(*parts: Column) -> Column:
    """A standard normal from a hash of the arguments (Box-Muller on two uniform numbers)."""
    def uniform(salt: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(salt), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def impute(df: DataFrame, targets: Mapping[str, Sequence[str]], *, key: Sequence[str], group: str, m: int = 20, cycles: int = 5, seed: int = 1,
           by_group: Sequence[str] = ()) -> DataFrame:
    """``m`` completed copies of ``df`` under ``imp`` 1 to m; observed cells stay.

    ``targets`` maps each variable with missing values to its predictors (other targets among them are used as filled so far).
    A variable gets a linear model with an intercept of each ``group``; one of ``by_group`` is constant in a group
    and gets a linear model of group means, one value for each group. ``key`` names the rows. A predictor that is itself missing
    and no target counts as its mean. Variables without an observed value stay null.
    """
    spark, names = df.sparkSession, list(targets)
    others = sorted({p for ps in targets.values() for p in ps} - set(names))
    spread = df.agg(*[f(F.col(c).cast("double")).alias(f"{s}_{c}") for c in [*names, *others] for s, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    imps = F.explode(F.sequence(F.lit(1), F.lit(m))).alias("imp")
    cells = [F.coalesce(F.col(c).cast("double"), F.lit(spread[f"m_{c}"]) + F.lit(spread[f"s_{c}"] or 0.0) * hashed_normal(F.lit(seed), F.col("imp"), F.lit(c), F.lit(0), *[F.col(k) for k in key]))
             .alias(f"__{c}") for c in names]
    fixed = [F.coalesce(F.col(c).cast("double"), F.lit(spread[f"m_{c}"]), F.lit(0.0)).alias(f"__{c}") for c in others]
    work = df.select("*", imps).select("*", *cells, *fixed)
    for cycle in range(1, cycles + 1):
        for c in names:
            if spread[f"m_{c}"] is not None:
                work = _step(work, c, list(targets[c]), list(key), group, seed, cycle, c in by_group)
        work = materialize(work, "imputing")
    return work.select("imp", *[F.coalesce(F.col(c).cast("double"), F.col(f"__{c}")).alias(c) if c in targets else F.col(c) for c in df.columns])


def _step(work: DataFrame, c: str, xs: list[str], key: list[str], group: str, seed: int, cycle: int, whole: bool) -> DataFrame:
    """One variable drawn anew, given the others."""
    y, cols = F.col(c).cast("double"), [f"__{x}" for x in xs]
    p = len(xs) + 1
    rows = work.select("imp", F.col(group).alias("g"), y.alias("y"), *cols)
    if whole:
        rows = rows.groupBy("imp", "g").agg(F.max("y").alias("y"), *[F.avg(x).alias(x) for x in cols])
    records = materialize(cross_products(rows, "y", cols, ["imp", "g"]), "imputing-records")
    i, j = np.triu_indices(p + 1)
    sums = records.groupBy("imp").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(len(i))]).alias("c")).collect()  # a record per imputation
    drawn = {}
    for r in sorted(sums, key=lambda r: r["imp"]):
        a = _square(r["c"], p + 1)
        n, xx, xy = a[0, 0], a[:p, :p], a[:p, p]
        inverse = np.linalg.pinv(xx)
        b = inverse @ xy
        rng = np.random.default_rng([seed, r["imp"], cycle, *c.encode()])
        free = max(n - p, 1.0)
        rss = max(a[p, p] - b @ xy, 0.0)
        s2 = rss / rng.chisquare(free)
        values, axes = np.linalg.eigh(inverse)
        drawn[r["imp"]] = (b + math.sqrt(s2) * (axes * np.sqrt(np.maximum(values, 0))) @ rng.standard_normal(p), s2, b)

    def per(values: Mapping[int, float]) -> Column:
        """A number of each imputation."""
        return F.get(F.array(*[F.lit(float(values.get(k, 0.0))) for k in range(1, max(values) + 1)]), F.col("imp") - 1)

    def linear(which: int) -> list[Column]:
        return [per({k: v[which][t] for k, v in drawn.items()}) for t in range(p)]

    effect, s2 = F.lit(0.0), per({k: v[1] for k, v in drawn.items()})
    if not whole:
        # of each group: rows and mean residual, by which the variance between groups is estimated from moments
        b = linear(2)
        left = records.select("imp", "g", F.col("c")[0].alias("n"), (F.col("c")[p] - sum((b[t] * F.col("c")[t] for t in range(p)), F.lit(0.0))).alias("s"))
        left = left.withColumn("mean", F.col("s") / F.col("n"))
        parts = left.groupBy("imp").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("k"), F.sum(F.col("s") * F.col("mean")).alias("between")).collect()
        tau2, sigma2 = {}, {}
        for r in parts:
            a = next(_square(x["c"], p + 1) for x in sums if x["imp"] == r["imp"])
            rss = max(a[p, p] - drawn[r["imp"]][2] @ a[:p, p], 0.0)
            inside = max(rss - r["between"], 0.0) / max(r["n"] - r["k"] - p + 1, 1.0)
            scale = r["n"] - r["nn"] / r["n"]
            tau2[r["imp"]] = max((r["between"] - (r["k"] - 1) * inside) / scale, 0.0) if scale > 0 else 0.0
            sigma2[r["imp"]] = inside if tau2[r["imp"]] > 0 else drawn[r["imp"]][1]
        t2, s2 = per(tau2), per(sigma2)
        shrunk = left.select("imp", "g", F.coalesce(F.try_divide(t2 * F.col("n"), t2 * F.col("n") + s2), F.lit(0.0)).alias("w"), "mean")
        shrunk = shrunk.select(F.col("imp").alias("__i"), F.col("g").alias("__g"), "w", "mean")
        work = work.join(shrunk, (F.col("imp") == F.col("__i")) & F.col(group).eqNullSafe(F.col("__g")), "left")
        effect = F.coalesce("w", F.lit(0.0)) * F.coalesce("mean", F.lit(0.0)) + F.sqrt(t2 * (1 - F.coalesce("w", F.lit(0.0)))) * hashed_normal(
            F.lit(seed), F.col("imp"), F.lit(c), F.lit(cycle), F.col(group))
    named = [F.col(group)] if whole else [F.col(k) for k in key]
    terms = linear(0)
    if whole:  # predictors of a group are its means
        means = rows.groupBy("imp", "g").agg(*[F.avg(x).alias(f"{x}_mean") for x in cols]).withColumnsRenamed({"imp": "__i", "g": "__g"})
        work = work.join(means, (F.col("imp") == F.col("__i")) & F.col(group).eqNullSafe(F.col("__g")), "left")
        line = terms[0] + sum((terms[t + 1] * F.col(f"{x}_mean") for t, x in enumerate(cols)), F.lit(0.0))
    else:
        line = terms[0] + sum((terms[t + 1] * F.col(x) for t, x in enumerate(cols)), F.lit(0.0))
    new = line + effect + F.sqrt(s2) * hashed_normal(F.lit(seed + 1), F.col("imp"), F.lit(c), F.lit(cycle), *named)
    seen = y
    if whole:  # a group with an observed value keeps it everywhere
        held = work.groupBy(F.col("imp").alias("__j"), F.col(group).alias("__h")).agg(F.max(y).alias("__seen"))
        work = work.join(held, (F.col("imp") == F.col("__j")) & F.col(group).eqNullSafe(F.col("__h")), "left")
        seen = F.coalesce(y, F.col("__seen"))
    return work.withColumn(f"__{c}", F.coalesce(seen, new)).drop("__i", "__g", "w", "mean", "__j", "__h", "__seen", *[f"{x}_mean" for x in cols])


def pooled(estimates: DataFrame, *, m: int, by: Sequence[str] = ("term",)) -> DataFrame:
    """:func:`models.pool` with two-sided p and a 95 % interval."""
    from panelwright.functions.dist import p_t, q_t

    out = pool(estimates, m=m, by=by).withColumn("p", p_t("t", "dof"))
    reach = q_t(F.lit(0.975), F.col("dof")) * F.col("se")
    return out.withColumn("low", F.col("estimate") - reach).withColumn("high", F.col("estimate") + reach)


def pooled_robust(estimates: DataFrame, by: Sequence[str] = ("term",)) -> DataFrame:
    """Pooled ``estimate, se`` of fits with their own degrees of freedom ``df``: total variance, small-sample degrees of freedom, t, p and
    95 % interval; ``gamma`` is the share of the variance between imputations."""
    from panelwright.functions.dist import p_t, q_t

    per = estimates.groupBy(*by).agg(F.count("*").alias("m"), F.var_samp("estimate").alias("b"), F.avg("estimate").alias("estimate"),
                                     F.avg(F.col("se") * F.col("se")).alias("v"), F.avg("df").alias("eta"))
    more = (F.col("m") + 1) / F.col("m") * F.col("b")
    out = per.withColumn("total", F.col("v") + more).withColumn("gamma", F.try_divide(more, F.col("total")))
    among = F.try_divide(F.col("m") - 1, F.col("gamma") * F.col("gamma"))
    seen = F.col("eta") * (F.col("eta") + 1) * (1 - F.col("gamma")) / (F.col("eta") + 3)
    out = out.withColumn("df", 1 / (F.coalesce(F.try_divide(F.lit(1.0), among), F.lit(0.0)) + 1 / seen)).withColumn("se", F.sqrt("total"))
    out = out.withColumn("t", F.try_divide("estimate", "se")).withColumn("p", p_t("t", "df"))
    reach = q_t(F.lit(0.975), F.col("df")) * F.col("se")
    return out.select(*by, "estimate", "se", "t", "df", "p", (F.col("estimate") - reach).alias("low"), (F.col("estimate") + reach).alias("high"), "gamma")


def pooled_components(components: DataFrame, quality: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variance components (with standard deviations) and fit statistics averaged over fits."""
    parts = components.groupBy("level", "term", "other").agg(F.avg("covariance").alias("covariance"), F.avg("correlation").alias("correlation"), F.count("*").alias("m"))
    parts = parts.withColumn("sd", F.when(F.col("term") == F.col("other"), F.sqrt("covariance")))
    return parts, quality.agg(*[F.avg(c).alias(c) for c in ("deviance", "loglik", "aic", "bic")], F.count("*").alias("m"))


def d3(smaller: tuple[Model, Mapping[str, Fit]], larger: tuple[Model, Mapping[str, Fit]]) -> dict[str, float]:
    """Pooled likelihood-ratio test from deviances at each imputation's own and at the mean parameters."""
    from panelwright.functions.dist import f_tail

    keys = sorted(larger[1])
    m = len(keys)
    own = float(np.mean([smaller[1][k].deviance - larger[1][k].deviance for k in keys]))
    at = []
    for model, fits in (smaller, larger):
        beta = np.mean([fits[k].beta for k in keys], axis=0)
        s2 = float(np.mean([fits[k].sigma2 for k in keys]))
        g = [np.mean([fits[k].g[i] for k in keys], axis=0) for i in range(len(model.levels))]
        at.append(model.deviances(dict.fromkeys(keys, (beta, s2, g))))
    mean = float(np.mean([at[0][k] - at[1][k] for k in keys]))
    df = larger[1][keys[0]].parameters - smaller[1][keys[0]].parameters
    r = (m + 1) / (df * (m - 1)) * (own - mean)
    value = mean / (df * (1 + r))
    t = df * (m - 1)
    if r > 0:
        free = 4 + (t - 4) * (1 + (1 - 2 / t) / r) ** 2 if t > 4 else t * (1 + 1 / df) * (1 + 1 / r) ** 2 / 2
    else:
        free = math.inf
    p = float(f_tail(max(value, 0.0), df, min(free, 1e9)))
    return {"d3": value, "df1": df, "df2": free, "riv": r, "p": p, "own": own, "mean": mean}
