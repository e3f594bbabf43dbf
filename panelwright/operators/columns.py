"""Choosing, naming and placing columns. Driver-side work on names only; no job runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def span(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in frame order, both included."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]


def containing(df: DataFrame, *parts: str) -> list[str]:
    return [c for c in df.columns if any(p in c for p in parts)]


def at(df: DataFrame, *positions: int) -> list[str]:
    """Names at 1-based positions."""
    return [df.columns[p - 1] for p in positions]


def everything_else(df: DataFrame, taken: Iterable[str]) -> list[str]:
    taken = set(taken)
    return [c for c in df.columns if c not in taken]


def numeric(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in NUMERIC or t.startswith("decimal")]


def select(df: DataFrame, *picks: str | Sequence[str], drop: Iterable[str] = ()) -> DataFrame:
    """Select names and name lists in order, first mention wins, minus ``drop``."""
    names: list[str] = []
    for pick in picks:
        for name in [pick] if isinstance(pick, str) else pick:
            if name not in names:
                names.append(name)
    gone = set(drop)
    kept = [n for n in (names or df.columns) if n not in gone]
    return df.select(*[f"`{n}`" for n in kept])


def rename(df: DataFrame, **new_from_old: str) -> DataFrame:
    """``rename(df, new="old")``, all at once, so names can be swapped; unknown names raise."""
    known(df, new_from_old.values())
    renamed = {old: new for new, old in new_from_old.items()}
    return df.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in df.columns])


def known(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")


def rename_at(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Rename by 1-based position."""
    return df.toDF(*[names.get(i, c) for i, c in enumerate(df.columns, 1)])


def add_suffix(df: DataFrame, columns: Iterable[str], suffix: str) -> DataFrame:
    columns = list(columns)
    known(df, columns)
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in columns})


def snake_case(name: str) -> str:
    """One header as a lower snake_case identifier; a leading digit gets an ``x``."""
    text = name.replace("%", " percent ").replace("#", " number ")
    text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text))
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    return f"x{text}" if not text or text[0].isdigit() else text


def clean_names(df: DataFrame) -> DataFrame:
    """Clean every header; a name that is taken gets the next free number."""
    names: list[str] = []
    for raw in df.columns:
        base = name = snake_case(raw)
        number = 1
        while name in names:
            number += 1
            name = f"{base}_{number}"
        names.append(name)
    return df.toDF(*names)


def relocate(df: DataFrame, columns: Sequence[str], *, before: str | int | None = None,
             after: str | int | None = None) -> DataFrame:
    """Move columns before or after an anchor given by name or 1-based position."""
    rest = [c for c in df.columns if c not in columns]
    anchor = before if before is not None else after
    if anchor is None:
        place = 0
    else:
        name = df.columns[anchor - 1] if isinstance(anchor, int) else anchor
        place = rest.index(name) + (0 if before is not None else 1)
    return select(df, [*rest[:place], *columns, *rest[place:]])


def across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column],
           suffix: str | None = None) -> DataFrame:
    """Apply ``fn`` to many columns, in place or into ``{column}_{suffix}``."""
    return df.withColumns({c if suffix is None else f"{c}_{suffix}": fn(F.col(c)) for c in columns})
