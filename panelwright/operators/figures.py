"""Data behind diagnostic figures: quantile pairs, binned means, standardised residuals."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.dist import q_normal
from panelwright.operators.order import quantiles_of, value_counts, with_position
from panelwright.session import discard, materialize


def qq(df: DataFrame, value: str) -> DataFrame:
    """``theoretical, sample, line`` of each value: the normal quantile of its plotting position, and the line through both quartiles.

    Positions come from cut ranges of the sorted values; positions are (i - a) / (n + 1 - 2a) with a = 3/8 up to ten values, else 1/2.
    """
    return qq_of(value_counts(df.select(F.col(value).cast("double").alias("sample")), "sample"))


def qq_of(counts: DataFrame) -> DataFrame:
    """:func:`qq` from the ``value_counts`` of ``sample``."""
    i = F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n")))
    a = F.when(F.col("total") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    places = counts.select("sample", "total", i.alias("i")).withColumn("theoretical", q_normal((F.col("i") - a) / (F.col("total") + 1 - 2 * a)))
    q = quantiles_of(counts, "sample", {"q1": 0.25, "q3": 0.75})
    reach = 0.6744897501960817  # normal quantile of 3/4
    lined = places.crossJoin(F.broadcast(q))  # one row
    slope = (F.col("q3") - F.col("q1")) / (2 * reach)
    return lined.select("theoretical", "sample", ((F.col("q1") + F.col("q3")) / 2 + slope * F.col("theoretical")).alias("line"))


def smooth(df: DataFrame, x: str, y: str, bins: int, key: Sequence[str]) -> DataFrame:
    """Means of ``x`` and ``y`` over ``bins`` runs of as equal counts as can be, in the order of ``x`` (then ``key``)."""
    return smooth_of(with_position(df.where(F.col(x).isNotNull()).select(x, y, *key), [x, *key], name="__at", total="__all"), bins, {"x": F.col(x), "y": F.col(y)})


def smooth_of(placed: DataFrame, bins: int, values: Mapping[str, Column]) -> DataFrame:
    """Means of ``values`` over the runs, of rows that know their position ``__at`` among ``__all``."""
    size, more = F.floor(F.col("__all") / bins), F.col("__all") % bins
    wide = more * (size + 1)
    at = F.col("__at") - 1
    bin_ = F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor(F.try_divide(at - wide, size))) + 1
    return placed.groupBy(bin_.cast("bigint").alias("bin")).agg(F.count("*").alias("n"), *[F.avg(v).alias(name) for name, v in values.items()])


def standardised(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``value`` over its root mean square (n - 1) in each group of ``by``, uncentred."""
    root = df.groupBy(*by).agg(F.sqrt(F.try_divide(F.sum(F.col(value) * F.col(value)), F.count(value) - 1)).alias("__root"))
    return df.join(root, list(by)).withColumn(value, F.try_divide(value, "__root")).drop("__root")


def predictive(placed: DataFrame, y: str, sigma: Column, draws: int = 50, bins: int = 30, seed: int = 1983) -> DataFrame:
    """``label, x, n``: rows in each bin of the outcome (``observed``) and of ``draws`` outcomes of every row drawn around ``fitted`` (``draw 1``, ...).

    Bins are a ``bins``-th of the outcome's range wide, ``x`` is their middle; empty ones are left out. Noise is hashed from the position
    ``__at`` of a row: it does not depend on partitions, and rows that come twice get noise of their own.
    """
    from panelwright.operators.impute import hashed_normal

    seen = F.col(y).cast("double")
    reach = placed.agg((F.max(seen) - F.min(seen)).alias("reach")).first()["reach"]
    width = (reach or 0.0) / bins or 1.0
    sets = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws))).alias("draw"))  # set 0 is the outcome itself
    value = F.when(F.col("draw") == 0, seen).otherwise(F.col("fitted") + sigma * hashed_normal(F.lit(seed), F.col("draw"), F.col("__at")))
    cells = sets.groupBy("draw", F.floor(value / width).alias("bin")).agg(F.count("*").alias("n"))
    label = F.when(F.col("draw") == 0, F.lit("observed")).otherwise(F.concat(F.lit("draw "), F.col("draw").cast("string")))
    return cells.select(label.alias("label"), ((F.col("bin") + 0.5) * width).alias("x"), "n")


def model_check(df: DataFrame, model, fits, bins: int = 10) -> DataFrame:
    """``panel, label, x, y, line``, the figures that judge a fit, over every row and group.

    - ``fitted``, ``fixed``: prediction and residual of each row, with and without the effects of its group (``label``)
    - ``linearity``, ``spread``: mean residual and mean absolute residual over bins of fitted values
    - ``collinearity``, ``tolerance``: variance inflation of each term, and its inverse
    - ``residuals``, ``effects``: quantile pairs of all residuals, and of the effects of all groups for each random term, with their ``line``
    - ``predictive``: rows by bins of the outcome, and of outcomes drawn from the model

    Rows in their order and counted values are written first, which keeps the plan of the whole small.
    """
    from panelwright.operators.mixed import predict
    from panelwright.operators.models import vif

    def panel(name: str, frame: DataFrame, label: Column, x, y, line=None) -> DataFrame:
        return frame.select(F.lit(name).alias("panel"), label.alias("label"), *[(F.lit(None) if c is None else F.col(c)).cast("double").alias(n) for n, c in (("x", x), ("y", y), ("line", line))])

    def pairs(name: str, frame: DataFrame, value: str, label: str) -> DataFrame:
        counts = materialize(value_counts(frame.select(F.col(value).alias("sample")), "sample"), "checked-counts")
        return panel(name, qq_of(counts), F.lit(label), "theoretical", "sample", "line")

    order = [*model.by, *model.groups, *model.xs, model.y]
    rows = materialize(predict(df, model, fits).where(F.col("residual").isNotNull()).select(*order, "fixed", "fitted", "residual_fixed", "residual"), "checked")
    placed = materialize(with_position(rows, ["fitted", *order], name="__at", total="__all"), "checked-placed")
    effects = materialize(model.effects(fits), "checked-effects")
    key = F.concat_ws("|", *[F.col(b).cast("string") for b in model.by]) if model.by else F.lit("")
    sigma = reduce(lambda c, f: c.when(key == f.key, math.sqrt(f.sigma2)), fits.values(), F)
    group = F.concat_ws("|", *[F.col(g).cast("string") for g in model.groups])
    out = [panel("fitted", placed, group, "fitted", "residual"), panel("fixed", placed, group, "fixed", "residual_fixed")]
    means = smooth_of(placed, bins, {"x": F.col("fitted"), "linearity": F.col("residual"), "spread": F.abs("residual")})
    out += [panel(name, means, F.col("bin").cast("string"), "x", name) for name in ("linearity", "spread")]
    if len(model.xs) > 1:
        inflated = vif(df, model.xs)
        out += [panel("collinearity", inflated, F.col("term"), None, "vif"), panel("tolerance", inflated, F.col("term"), None, "tolerance")]
    out.append(pairs("residuals", rows, "residual", "residual"))
    out += [pairs("effects", effects, f"effect_{i}", t) for i, t in enumerate(model.levels[0].terms)]
    out.append(panel("predictive", predictive(placed, model.y, sigma), F.col("label"), "x", "n"))
    discard(rows, effects)
    return reduce(DataFrame.unionByName, out)
