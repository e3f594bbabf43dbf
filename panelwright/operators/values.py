"""Row-wise value expressions. All stay inside generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def case_when(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """First matching condition wins."""
    (cond, value), *rest = pairs
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out.otherwise(otherwise)


def unique_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with one row per key; a second row of a key fails the job. Combines on the map side."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in rest])
    checked = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("key given twice: "), *[F.coalesce(F.first(F.col(k)).cast("string"), F.lit("NULL")) for k in keys])))
    return df.groupBy(*keys).agg(checked.otherwise(F.max(row)).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def recode(df: DataFrame, column: str, aliases: DataFrame, *, into: str | None = None) -> DataFrame:
    """Replace names through an ``(alias, name)`` table; names not listed stay as they are."""
    table = unique_by(aliases.select(F.col("alias").alias("__alias"), F.col("name").alias("__name")), ["__alias"])
    joined = df.join(table, F.col(column) == F.col("__alias"), "left")
    return joined.withColumn(into or column, F.coalesce("__name", column)).drop("__alias", "__name")


def patch(df: DataFrame, column: str, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Override cells of ``column`` where ``patches`` holds a row for the key."""
    table = unique_by(patches.select(*keys, F.col(column).alias("__patch"), F.lit(True).alias("__given")), keys)
    joined = df.join(table, list(keys), "left")  # a patch to NULL counts
    return joined.withColumn(column, F.when(F.col("__given"), F.col("__patch")).otherwise(F.col(column))).select(*df.columns)


def missing_codes(value: Column, *, negative: bool = True, texts: Sequence[str] = ()) -> Column:
    """Negative codes, and listed texts, become NULL."""
    out = value
    if texts:
        out = F.when(~F.trim(out.cast("string")).isin(*texts), out)
    if negative:
        out = F.when(out.try_cast("double") >= 0, out)
    return out


def decode(df: DataFrame, code: str, labels: DataFrame, *, into: str) -> DataFrame:
    """Code to label through a ``(code, label)`` table."""
    table = unique_by(labels.select(F.col("code").alias("__code"), F.col("label").alias(into)), ["__code"])
    return df.join(table, F.col(code) == F.col("__code"), "left").drop("__code")


def reverse_code(value: Column, low: float, high: float) -> Column:
    """Flip an item on its declared scale: ``low + high - x``."""
    return F.lit(low + high) - value


def remap(value: Column, mapping: Mapping[object, object]) -> Column:
    """Fixed value map; anything else becomes NULL."""
    out = None
    for old, new in mapping.items():
        out = F.when(value == old, new) if out is None else out.when(value == old, new)
    return out


def row_sum(*columns: str) -> Column:
    """Sum over columns, NULLs skipped; NULL when all are NULL."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(_present(columns) > 0, total)


def row_mean(*columns: str) -> Column:
    """Mean over the columns that have a value; NULL when none has."""
    return F.try_divide(row_sum(*columns), _present(columns).cast("double"))


def _present(columns) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def separate(df: DataFrame, column: str, into: Sequence[str], sep: str) -> DataFrame:
    """Split one text column into several; ``sep`` is a regular expression."""
    parts = F.split(F.col(column), sep)
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(into)])


def dummies(column: str, levels: Sequence[str], base: str) -> dict[str, Column]:
    """Treatment contrasts against ``base``; names are ``column`` + level. A value outside ``levels`` fails the job."""
    here = F.col(column)
    stray = here.isNotNull() & ~here.isin(list(levels))
    return {
        f"{column}{level}": F.when(stray, F.raise_error(F.concat(F.lit("unlisted level: "), here))).otherwise((here == level).cast("double"))
        for level in levels
        if level != base
    }


def min_max_scale(df: DataFrame, columns: Sequence[str], suffix: str = "scaled") -> DataFrame:
    """Scale each column to 0-1 over the whole frame.

    One partial aggregate gives a single row of bounds that is attached to every row, so no
    window gathers the frame in one task.
    """
    bounds = df.agg(
        *[F.min(c).alias(f"__lo_{c}") for c in columns], *[F.max(c).alias(f"__hi_{c}") for c in columns]
    )
    wide = df.crossJoin(F.broadcast(bounds))  # exactly one row
    scaled = {
        f"{c}_{suffix}": F.try_divide(
            (F.col(c) - F.col(f"__lo_{c}")).cast("double"),
            (F.col(f"__hi_{c}") - F.col(f"__lo_{c}")).cast("double"),
        )
        for c in columns
    }
    return wide.withColumns(scaled).select(*df.columns, *scaled)
