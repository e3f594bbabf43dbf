"""Where values are missing, and what goes with it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.order import quantiles


def glimpse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present, missing and percent missing of each column."""
    once = df.agg(F.count("*").alias("all"), *[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in columns]))
    return once.select("all", rows.alias("r")).select("r.variable", "r.n", (F.col("all") - F.col("r.n")).alias("missing"),
                                                      F.try_divide((F.col("all") - F.col("r.n")) * 100.0, F.col("all")).alias("percent"))


def pattern(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct patterns of missing flags with their counts."""
    return df.groupBy(*[F.col(c).isNull().cast("int").alias(c) for c in columns]).agg(F.count("*").alias("n"))


def pairs(df: DataFrame, variables: Sequence[str], split_by: Sequence[str]) -> DataFrame:
    """Count and quartiles of each variable, apart for rows that miss and rows that have another."""
    out = []
    for x in variables:
        for y in split_by:
            flagged = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("v"), F.col(y).isNull().alias("missing"))
            n = flagged.groupBy("missing").agg(F.count("*").alias("n"))
            q = quantiles(flagged, "v", {"q1": 0.25, "mid": 0.5, "q3": 0.75}, ["missing"])
            out.append(n.join(q, "missing").select(F.lit(x).alias("variable"), F.lit(y).alias("split_by"), "missing", "n", "q1", "mid", "q3"))
    return reduce(DataFrame.unionByName, out)


def compare(df: DataFrame, target: str, variables: Sequence[str]) -> DataFrame:
    """Means of each variable where ``target`` is missing and where it is not, with Welch's t."""
    gone = F.col(target).isNull()
    parts = {"missing": gone, "observed": ~gone}
    aggs = [fn(F.when(cond, F.col(x).cast("double"))).alias(f"{x}_{name}_{stat}") for x in variables for name, cond in parts.items()
            for stat, fn in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))]
    once = df.agg(*aggs)

    def row(x: str):
        def c(name, stat):
            return F.col(f"{x}_{name}_{stat}")

        spread = F.sqrt(F.try_divide(c("missing", "var"), c("missing", "n")) + F.try_divide(c("observed", "var"), c("observed", "n")))
        return F.struct(F.lit(x).alias("variable"), c("missing", "mean").alias("mean_missing"), c("observed", "mean").alias("mean_observed"),
                        F.try_divide(c("missing", "mean") - c("observed", "mean"), spread).alias("t"))

    return once.select(F.explode(F.array(*[row(x) for x in variables])).alias("r")).select("r.*")


def compare_counts(df: DataFrame, target: str, category: str) -> DataFrame:
    """Chi-square of a category against whether ``target`` is missing: ``variable, chi2, df, p`` from the counts of the two-way table."""
    from panelwright.functions.dist import p_chi2

    cells = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count_if(F.col(target).isNull()).alias("gone"), F.count("*").alias("n"))
    total = cells.agg(F.sum("gone").alias("all_gone"), F.sum("n").alias("all"), F.count("*").alias("k"))  # one row
    wide = cells.crossJoin(F.broadcast(total))
    want = F.col("n") * F.col("all_gone") / F.col("all")
    apart = F.col("gone") - want
    chi2 = F.sum(F.try_divide(apart * apart, want) + F.try_divide(apart * apart, F.col("n") - want))
    out = wide.agg(chi2.alias("chi2"), (F.max("k") - 1).alias("df"))
    return out.select(F.lit(category).alias("variable"), "chi2", "df", p_chi2("chi2", "df").alias("p"))
