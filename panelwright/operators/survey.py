"""Weighted estimates from plausible values, and scales from items: one partial aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weighted(value: str, weight: str) -> Column:
    both = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(both))


def pv_mean(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str) -> DataFrame:
    """Rows and mean per group: the average of each plausible value's weighted mean."""
    means = sum((_weighted(v, weight) for v in values), F.lit(0.0)) / len(values)
    return df.groupBy(*by).agg(F.count("*").alias("freq"), means.alias("mean"))


def pv_se(df: DataFrame, by: Sequence[str], values: Sequence[str], weight: str, replicates: Sequence[str], k: float = 0.5) -> DataFrame:
    """Mean with its standard error: replicate-weight variance averaged over plausible values, plus the variance between them
    (none for a single value).

    Weights and values of a row are arrays, and a row gives one line per weight with its products with all values; lines add
    up on the map side to one per group and weight, and weights fold into a list of estimates. Expressions grow with the values
    alone, so ten values by eighty weights are one aggregate as two by four are.
    """
    weights, p, r = [weight, *replicates], len(values), len(replicates)
    rows = df.select(*by, F.array(*[F.col(v).cast("double") for v in values]).alias("__v"),
                     F.posexplode(F.array(*[F.col(w).cast("double") for w in weights])).alias("__j", "__w"))
    v = [F.col("__v")[i] for i in range(p)]
    sums = rows.groupBy(*by, "__j").agg(F.count("*").alias("freq"), *[F.sum(F.col("__w") * x).alias(f"__s{i}") for i, x in enumerate(v)],
                                        *[F.sum(F.when(x.isNotNull(), F.col("__w"))).alias(f"__n{i}") for i, x in enumerate(v)])
    means = F.array(*[F.try_divide(F.col(f"__s{i}"), F.col(f"__n{i}")) for i in range(p)])
    lists = sums.groupBy(*by).agg(F.max("freq").alias("freq"), F.sort_array(F.collect_list(F.struct("__j", means.alias("m")))).getField("m").alias("__m"))

    def added(array: Column, fn=lambda x: x) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + fn(x))

    main = F.col("__m")[0]
    apart = F.transform(F.slice(F.col("__m"), 2, max(r, 1)), lambda m: added(F.zip_with(m, main, lambda x, y: (x - y) * (x - y))))
    out = lists.withColumn("mean", added(main) / p)
    between = added(main, lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / (p - 1) if p > 1 else F.lit(0.0)
    sampling = added(apart) / (p * r * (1 - k) ** 2) if r else F.lit(0.0)
    return out.select(*by, "freq", "mean", F.sqrt(sampling + between * (1 + 1 / p)).alias("se"))


def cycle(df: DataFrame, values: Sequence[str], weight: str, *, entity: str, group: str, levels: Sequence[str], period: str) -> DataFrame:
    """Total mean and one column per level of ``group``, per entity and period."""
    total = pv_mean(df, [entity, period], values, weight).select(entity, period, F.col("freq").alias("n_total"), F.col("mean").alias("total"))
    cells = df.groupBy(entity, period).agg(*[
        (sum((F.try_divide(F.sum(F.when(F.col(group) == g, F.col(weight) * F.col(v))), F.sum(F.when(F.col(group) == g, F.col(weight)))) for v in values), F.lit(0.0))
         / len(values)).alias(g.lower()) for g in levels])
    return total.join(cells, [entity, period])


def participation(df: DataFrame, entity: str, period: str, periods: Sequence[int]) -> DataFrame:
    """A 0/1 flag per period and their sum."""
    flags = df.groupBy(entity).agg(*[F.max((F.col(period) == y).cast("int")).alias(f"in_{y}") for y in periods])
    return flags.withColumn("times", sum((F.col(f"in_{y}") for y in periods), F.lit(0)))


def covariances(df: DataFrame, items: Sequence[str]) -> tuple[int, dict[tuple[str, str], float]]:
    """Complete rows and sample covariances of the items: one row of p * (p + 1) / 2 numbers reaches the driver."""
    full = df.dropna(subset=list(items))
    pairs = [(a, b) for i, a in enumerate(items) for b in items[i:]]
    row = full.agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
    out = {}
    for k, (a, b) in enumerate(pairs):
        out[a, b] = out[b, a] = row[f"c{k}"]
    return row["n"], out


def alpha(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Cronbach's alpha over complete rows: item variances against the variance of the total."""
    full = df.dropna(subset=list(items))
    total = sum((F.col(i) for i in items), F.lit(0))
    k = len(items)
    apart = sum((F.var_samp(i) for i in items), F.lit(0.0))
    return full.agg((F.lit(k / (k - 1)) * (1 - F.try_divide(apart, F.var_samp(total)))).alias("alpha"), F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, items: Sequence[str]):
    import numpy as np

    n, c = covariances(df, items)
    m = np.array([[c[a, b] for b in items] for a in items], float)
    d = np.sqrt(np.diag(m))
    return n, m / d / d[:, None]


def adequacy(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Kaiser-Meyer-Olkin measure and Bartlett's sphericity statistic from the Spark-built correlation matrix."""
    import numpy as np

    n, r = correlation_matrix(df, items)
    p = len(items)
    inverse = np.linalg.inv(r)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(p, dtype=bool)
    kmo = (r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum())
    chi2 = -(n - 1 - (2 * p + 5) / 6) * np.log(np.linalg.det(r))
    return df.sparkSession.createDataFrame([(float(kmo), float(chi2), p * (p - 1) // 2, n)], "kmo double, chi2 double, df int, n bigint")


def eigenvalues(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Eigenvalues of the items' correlation matrix, largest first."""
    import numpy as np

    _, r = correlation_matrix(df, items)
    values = sorted(np.linalg.eigvalsh(r), reverse=True)
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values, 1)], "factor int, value double")
