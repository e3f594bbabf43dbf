"""Counts, profiles, histograms and correlations as partial aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.dist import p_t
from panelwright.operators.order import quantiles, quantiles_of, value_counts


def crosstab(df: DataFrame, rows: str, columns: str, levels: Sequence[str]) -> DataFrame:
    """Two-way counts; levels are stated so that no extra pass finds them."""
    return df.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(v) for v in levels])


def with_totals(table: DataFrame, rows: str, name: str = "Total") -> DataFrame:
    """A crosstab with a column and a row of totals."""
    cells = [c for c in table.columns if c != rows]
    wide = table.withColumn(name, sum((F.col(f"`{c}`") for c in cells), F.lit(0)).cast("bigint"))
    bottom = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in [*cells, name]]).select(F.lit(name).alias(rows), *[f"`{c}`" for c in [*cells, name]])
    return wide.unionByName(bottom)


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile(df: DataFrame, columns: Sequence[str], bins: int = 8) -> DataFrame:
    """Complete rate, mean, sd, extremes and median of each column, and ``hist``: counts in ``bins`` bins of one width from the least to the largest value."""
    once = df.agg(*[F.struct((F.count(c) / F.count("*")).alias("complete_rate"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"),
                             F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns])
    rows = once.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), f"{c}.*") for c in columns])).alias("r")).select("r.*")
    middles = _stacked([quantiles(df, c, {"mid": 0.5}).withColumn("variable", F.lit(c)) for c in columns])
    ends = once.select(*[F.col(c).alias(f"__{c}") for c in columns])  # one row

    def bin_(c: str) -> Column:
        at = F.try_divide(F.col(c).cast("double") - F.col(f"__{c}.lo"), F.col(f"__{c}.hi") - F.col(f"__{c}.lo")) * bins
        return F.least(F.floor(F.coalesce(at, F.lit(0.0))), F.lit(bins - 1))

    counted = df.crossJoin(F.broadcast(ends)).agg(*[F.concat_ws(",", *[F.count_if(F.col(c).isNotNull() & (bin_(c) == i)).cast("string") for i in range(bins)]).alias(c) for c in columns])
    bars = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("hist")) for c in columns])).alias("r")).select("r.*")
    return rows.join(middles, "variable").join(bars, "variable")


def describe(df: DataFrame, columns: Sequence[str], trim: float = 0.1) -> DataFrame:
    """Moments with population skewness and kurtosis, standard error, median, extremes, the mean without the ``trim`` share of values at each
    end, and the scaled median deviation."""
    out = []
    for c in columns:
        ends = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"),
                      (F.max(c) - F.min(c)).cast("double").alias("span"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"))
        counts = value_counts(df.select(F.col(c).cast("double").alias("v")), "v")
        middle = quantiles_of(counts, "v", {"__mid": 0.5})
        cut = F.floor(F.col("total") * trim)
        inside = F.greatest(F.least(F.col("before") + F.col("n"), F.col("total") - cut) - F.greatest("before", cut), F.lit(0))
        trimmed = counts.agg(F.try_divide(F.sum(inside * F.col("v")), F.sum(inside)).alias("trimmed"))
        off = df.crossJoin(middle).select(F.abs(F.col(c) - F.col("__mid")).alias("off"))  # one row beside each
        mad = quantiles(off, "off", {"mad": 0.5}).select((F.col("mad") * 1.4826).alias("mad"))
        rest = trimmed.crossJoin(middle).crossJoin(mad)  # one row each
        out.append(ends.crossJoin(rest).select(F.lit(c).alias("variable"), "n", "mean", "sd", F.col("__mid").alias("median"), "trimmed", "mad", "lo", "hi", "span", "skew", "kurtosis",
                                               (F.col("sd") / F.sqrt("n")).alias("se")))
    return _stacked(out)


def histogram(df: DataFrame, column: str, width: float, origin: float = 0.0) -> DataFrame:
    """Rows per fixed-width bin; bin k starts at ``origin + k * width``."""
    return df.where(F.col(column).isNotNull()).groupBy(F.floor((F.col(column) - origin) / width).alias("bin")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``x, y, n, r, t, p`` of every pair over its complete rows, one pass; a constant side gives NULL."""
    sums = []
    for a, b in combinations(columns, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = F.when(both, F.col(a)).cast("double"), F.when(both, F.col(b)).cast("double")
        sums.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count(x).alias("n"), F.covar_pop(x, y).alias("xy"),
                             F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy")))
    pair = df.groupBy(*by).agg(F.array(*sums).alias("p")).select(*by, F.explode("p").alias("p")).select(*by, "p.*")
    r: Column = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    free = (F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))
    out = pair.withColumn("r", r).select(*by, "x", "y", "n", "r", F.when(free >= 0, F.col("r") * F.sqrt(free)).alias("t"))
    return out.withColumn("p", p_t(F.col("t"), F.col("n") - 2))
