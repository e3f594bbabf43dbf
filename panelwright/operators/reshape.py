"""Wide to long, long to wide, cells to rows, category order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longer(df: DataFrame, columns: Sequence[str], *, names_to: str = "name", values_to: str = "value") -> DataFrame:
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), names_to, values_to)


def years_longer(df: DataFrame, first: int, last: int, *, prefix: str = "x", values_to: str = "value",
                 period: str = "year") -> DataFrame:
    """``x2006…x2019`` to rows; years out of range are dropped by name, before any row is made."""
    wanted = [c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()
              and first <= int(c[len(prefix):]) <= last]
    others = [c for c in df.columns if not (c.startswith(prefix) and c[len(prefix):].isdigit())]
    out = longer(df.select(*others, *wanted), wanted, names_to=period, values_to=values_to)
    return out.withColumn(period, F.regexp_replace(period, f"^{prefix}", "").cast("int"))


def wider(df: DataFrame, keys: Sequence[str], names_from: str, levels: Sequence, values_from: Sequence[str]) -> DataFrame:
    """Rows to columns named ``{value}_{level}``; levels are stated, so no extra pass finds them.

    A level that is not stated, or two rows for one cell, fails the job instead of losing rows.
    """
    here = F.col(names_from)
    stray = F.coalesce(here.isin(list(levels)), F.lit(False))
    aggs = []
    for v in values_from:
        for level in levels:
            twice = F.count_if(here == level) > 1
            cell = F.max(F.when(here == level, F.col(v)))
            aggs.append(F.when(twice, F.raise_error(F.lit(f"two rows for {v}_{level}"))).otherwise(cell).alias(f"{v}_{level}"))
    aggs[0] = F.when(F.count_if(~stray) > 0, F.raise_error(F.lit(f"unlisted level of {names_from}"))).otherwise(aggs[0]).alias(
        f"{values_from[0]}_{levels[0]}")
    return df.groupBy(*keys).agg(*aggs)


def explode_cell(df: DataFrame, column: str, sep: str) -> DataFrame:
    return df.withColumn(column, F.explode_outer(F.split(F.col(column), sep)))


def parse_number(text: Column) -> Column:
    """First number in a text, grouping commas ignored, exponents read; NULL when there is none."""
    plain = F.regexp_replace(text.cast("string"), r"(?<=\d),(?=\d{3})", "")
    return F.regexp_extract(plain, r"(-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def level_order(df: DataFrame, column: str, by: Column, *, name: str = "level") -> DataFrame:
    """Attach a 1-based rank of each category by an aggregate such as ``min(pos)`` or ``avg(x)``.

    Ranks run over one row per category, then join back.
    """
    from panelwright.operators.order import with_position

    per = df.groupBy(column).agg(by.alias("__by")).where(F.col(column).isNotNull())
    ranked = with_position(per, ["__by", column], name=name).drop("__by")
    return df.join(ranked, column, "left")
