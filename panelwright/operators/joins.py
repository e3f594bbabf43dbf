"""Equi-joins. No hints: Catalyst and AQE choose broadcast, shuffle and skew splitting by size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from panelwright.operators.values import unique_by
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty when the join is safe."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Left join on shared names, or on ``{left_name: right_name}``; right keys are dropped.

    Other names that both sides have come out as ``{name}_x`` and ``{name}_y``. The right side must hold a key once.
    """
    keys = list(on.values()) if isinstance(on, Mapping) else list(on)
    both = [c for c in right.columns if c in left.columns and c not in keys]
    clash = [c for c in both if not (isinstance(on, Mapping) and c in on)]
    left = left.withColumnsRenamed({c: f"{c}_x" for c in clash})
    right = unique_by(right.withColumnsRenamed({c: f"{c}_y" for c in clash}), keys) if len(right.columns) > len(keys) else right.distinct()
    if isinstance(on, Mapping):
        renamed = right.withColumnsRenamed({r: f"__key_{r}" for r in on.values()})
        cond = [left[l] == renamed[f"__key_{r}"] for l, r in on.items()]
        return left.join(renamed, cond, "left").drop(*[f"__key_{r}" for r in on.values()])
    return left.join(right, list(on), "left")


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_left_join(left: DataFrame, right: DataFrame) -> tuple[DataFrame, list[str]]:
    """Left join on every shared name; the chosen keys are returned so callers can check them."""
    keys = shared_keys(left, right)
    if not keys:
        raise ValueError("the frames share no column")
    right = unique_by(right, keys) if len(right.columns) > len(keys) else right.distinct()
    return left.join(right, keys, "left"), keys


def star(spine: DataFrame, *tables: DataFrame) -> DataFrame:
    """Join attribute tables one after another to a spine, each on its shared names."""
    out = spine
    for t in tables:
        out, _ = natural_left_join(out, t)
    return out


def period_grid(df: DataFrame, entity: str, period: str, first: int, last: int, step: int = 1) -> DataFrame:
    """Every entity with every period: each distinct entity is expanded in place, nothing is crossed."""
    years = F.sequence(F.lit(first), F.lit(last), F.lit(step))
    return df.select(entity).distinct().select(entity, F.explode(years).alias(period))


def self_join(df: DataFrame, keys: Sequence[str], value: str, split: str, left: str, right: str) -> DataFrame:
    """Two slices of a long table side by side as ``{value}_x`` and ``{value}_y``."""
    x = df.where(F.col(split) == left).select(*keys, F.col(value).alias(f"{value}_x"))
    y = df.where(F.col(split) == right).select(*keys, F.col(value).alias(f"{value}_y"))
    return x.join(y, list(keys), "left")


def flag_presence(df: DataFrame, members: DataFrame, on: Sequence[str] | Mapping[str, str], *,
                  name: str, present: str, absent: str) -> DataFrame:
    """Mark whether the key is in ``members``."""
    right_keys = list(on.values()) if isinstance(on, Mapping) else list(on)
    marked = members.select(*right_keys).distinct().withColumn("__hit", F.lit(True))
    joined = left_join(df, marked, on)
    return joined.withColumn(name, F.when(F.col("__hit"), present).otherwise(absent)).drop("__hit")
