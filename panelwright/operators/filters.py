"""Row filters. All push down to the scan when the source allows it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.order import with_position


def keep_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def keep_not_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is not listed; a missing value is not listed, so it stays."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(list(values)))


def missing_rows(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Keys of the rows that lack ``column``."""
    return df.where(F.col(column).isNull()).select(*keys, column)


def matching(df: DataFrame, column: str, pattern: str, *, literal: bool = False) -> DataFrame:
    value = F.col(column)
    return df.where(value.contains(pattern) if literal else value.rlike(pattern))


def slice_rows(df: DataFrame, order: Sequence[str], *, keep: Sequence[int] = (),
               drop: Sequence[int] = ()) -> DataFrame:
    """Keep or drop rows by 1-based position in a stated total order."""
    numbered = with_position(df, order, name="__pos")
    cond = F.col("__pos").isin(list(keep)) if keep else ~F.col("__pos").isin(list(drop))
    return numbered.where(cond).drop("__pos")
