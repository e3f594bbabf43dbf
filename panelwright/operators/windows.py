"""Group means on rows, leads, fills and blanks.

``bounded=True`` says each entity has few rows by construction (a panel keyed by entity and
calendar year); then one shuffle and a plain window do. Without it rows are cut into ranges of
(entity, order) first, so an entity with a third of all rows still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.operators.order import _null_safe_join, cut_into_ranges, with_previous


def group_stat(df: DataFrame, by: Sequence[str], **stats: Column) -> DataFrame:
    """Group statistics on each row: partial aggregation, then a join back.

    Unlike a window, no task ever holds a whole group; AQE splits a skewed key in the join.
    """
    return _null_safe_join(df, df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()]), list(by))


def centre(df: DataFrame, columns: Sequence[str], suffix: str = "c") -> DataFrame:
    """Deviation from the overall mean, any number of columns, one pass."""
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns])
    wide = df.crossJoin(F.broadcast(means))  # exactly one row
    made = {f"{c}_{suffix}": F.col(c) - F.col(f"__m_{c}") for c in columns}
    return wide.withColumns(made).select(*df.columns, *made)


def within_between(df: DataFrame, entity: str, value: str, *, between: str, within: str) -> DataFrame:
    """Split a measure into the entity mean and the deviation from it."""
    return group_stat(df, [entity], **{between: F.avg(value)}).withColumn(
        within, F.col(value) - F.col(between)
    )


def lead(df: DataFrame, column: str, by: Sequence[str], order: Sequence[str], k: Sequence[int] = (1,), *,
         bounded: bool = False) -> DataFrame:
    """``{column}_lead{k}``: the value k rows later inside the entity (negative k looks back)."""
    def over(w) -> dict[str, Column]:
        return {f"{column}_lead{i}": F.lead(column, i).over(w) for i in k}

    if bounded:
        return df.withColumns(over(W.partitionBy(*by).orderBy(*order)))
    reach = max(abs(i) for i in k)
    ranged = cut_into_ranges(df, [*by, *order])
    piece = W.partitionBy("__range", *by)
    edged = ranged.withColumns({
        "__head": F.row_number().over(piece.orderBy(*order)),
        "__tail": F.row_number().over(piece.orderBy(*[F.desc(c) for c in order])),
        **{f"__in{i}": F.lead(column, i).over(piece.orderBy(*order)) for i in k},
    })
    # Only rows near a cut can need another range: at most 2 x reach rows per range and entity.
    near = (F.col("__head") <= reach) | (F.col("__tail") <= reach)
    edged = edged.withColumn("__side", F.when(near, F.lit(-1)).otherwise(F.col("__range")))
    across = W.partitionBy("__side", *by).orderBy(*order)
    made = {
        f"{column}_lead{i}": F.when(
            (F.col("__tail") if i >= 0 else F.col("__head")) <= abs(i), F.lead(column, i).over(across)
        ).otherwise(F.col(f"__in{i}"))
        for i in k
    }
    return edged.withColumns(made).select(*df.columns, *made)


def fill(df: DataFrame, columns: Sequence[str], by: Sequence[str], order: Sequence[str],
         direction: str = "downup", *, bounded: bool = False) -> DataFrame:
    """Carry the nearest value down, up, or down then up."""
    steps = {"down": ("down",), "up": ("up",), "downup": ("down", "up"), "updown": ("up", "down")}[direction]

    def pick(c: str, down: Column, up: Column) -> Column:
        return F.coalesce(F.col(c), *[{"down": down, "up": up}[s] for s in steps])

    if bounded:
        w = W.partitionBy(*by).orderBy(*order)
        before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
        return df.withColumns({
            c: pick(c, F.last(c, True).over(before), F.first(c, True).over(after)) for c in columns
        })
    ranged = cut_into_ranges(df, [*by, *order])
    key = F.struct(*order)
    ends = ranged.groupBy(*by, "__range").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__last_{c}") for c in columns],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"__first_{c}") for c in columns],
    )
    w = W.partitionBy(*by).orderBy("__range")  # one row per range
    carried = ends.select(
        *by, "__range",
        *[F.last(f"__last_{c}", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias(f"__dn_{c}") for c in columns],
        *[F.first(f"__first_{c}", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias(f"__up_{c}") for c in columns],
    )
    joined = _null_safe_join(ranged, carried, [*by, "__range"])
    piece = W.partitionBy(*by, "__range").orderBy(*order)
    before, after = piece.rowsBetween(W.unboundedPreceding, 0), piece.rowsBetween(0, W.unboundedFollowing)
    return joined.withColumns({
        c: pick(
            c,
            F.coalesce(F.last(c, True).over(before), F.col(f"__dn_{c}")),
            F.coalesce(F.first(c, True).over(after), F.col(f"__up_{c}")),
        )
        for c in columns
    }).select(*df.columns)


def unfill(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Blank a value that repeats the row before it, for printed tables."""
    return with_previous(df, column, order, name="__prev").withColumn(
        column, F.when(~F.col(column).eqNullSafe(F.col("__prev")), F.col(column))
    ).drop("__prev")


def running_mean(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], *, name: str,
                 position: str) -> DataFrame:
    """Mean of all rows of the group so far, and the 1-based position, range by range."""
    ranged = cut_into_ranges(df, [*by, *order])
    per = ranged.groupBy(*by, "__range").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"),
                                             F.count("*").alias("__rows"))
    earlier = W.partitionBy(*by).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select(*by, "__range", *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("__s", "__n", "__rows")
    ])
    joined = _null_safe_join(ranged, carried, [*by, "__range"])
    upto = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    total = F.col("__s0") + F.coalesce(F.sum(value).over(upto), F.lit(0.0))
    n = F.col("__n0") + F.count(value).over(upto)
    return joined.withColumns({
        name: F.try_divide(total, n.cast("double")),
        position: F.col("__rows0") + F.row_number().over(W.partitionBy(*by, "__range").orderBy(*order)),
    }).select(*df.columns, name, position)


def constant_or(df: DataFrame, by: Sequence[str], value: str, mixed: str, *, name: str) -> DataFrame:
    """One row per group: its value when constant, else ``mixed``. Two aggregates, no distinct."""
    per = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return per.select(*by, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.lit(mixed)).alias(name))
