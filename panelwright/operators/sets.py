"""Stacking and distinct."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(*frames: DataFrame, fill_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill_missing), frames)


def copy_entity(df: DataFrame, column: str, source: str, target: str) -> DataFrame:
    """Append the rows of one entity under another name."""
    copied = df.where(F.col(column) == source).withColumn(column, F.lit(target))
    return df.unionByName(copied)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key: the first in ``order``.

    ``min_by`` combines on the map side, so a key holding most rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)
