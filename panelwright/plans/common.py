"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.fixtures import shape, shape_cte, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double so that two engines agree on the last shown digit.

    The shift keeps averages of cent values off rounding ties and turns -0.0 into 0.0.
    """
    return df.select(
        *[
            F.round(F.col(f"`{n}`") + F.lit(1e-7), digits).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def query(name: str, sql: str | None = None, *, uses: str = "", keys: str = "", floats: str | list[str] = "",
          digits: int = 4):
    """Register ``fn(shapes…)``; ``sql`` is the DuckDB text over the same shapes.

    ``keys`` are columns compared as they are, ``floats`` those rounded on both sides.
    """
    shapes = uses.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = [
                shape(spark, sf_dir, s) if not s.startswith("@") else table(spark, sf_dir, s[1:])
                for s in shapes
            ]
            return rounded(fn(*frames), digits)

        run.__doc__ = fn.__doc__
        run.__name__ = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            derived = [s for s in shapes if not s.startswith("@")]
            cte = shape_cte(*derived) if derived else ""
            cols = [c.strip() for c in keys.split(",") if c.strip()]
            cols += [f'round("{c}" + 1e-7, {digits}) AS "{c}"' for c in (floats.split() if isinstance(floats, str) else floats)]
            body = sql.strip()
            if body.upper().startswith("WITH "):
                cte = cte + ", " if cte else "WITH "
                head, body = body[5:].split("\n--\n")
                cte = cte + head + "\n"
            ORACLES[name] = f"{cte}SELECT {', '.join(cols)} FROM (\n{body}\n) answer"
        return fn

    return wrap


def t_p_sql(t: str, df: str) -> str:
    """DuckDB text of the two-sided p of Student's t for whole degrees of freedom, by its finite series."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    odd = f"list_sum([exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow(cos({angle}), 2 * k) for k in range(0, CAST(({df} - 1) // 2 AS BIGINT))])"
    even = f"list_sum([exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * pow(cos({angle}), 2 * k) for k in range(0, CAST({df} // 2 AS BIGINT))])"
    return (f"(1 - CASE WHEN {df} % 2 = 1 THEN 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * coalesce({odd}, 0)) ELSE sin({angle}) * {even} END)")


def determinant_sql(rows: list[list[str]]) -> str:
    """Text of a small determinant, expanded along its first row."""
    if len(rows) == 1:
        return f"({rows[0][0]})"
    parts = [f"{'-' if j % 2 else '+'} {rows[0][j]} * {determinant_sql([r[:j] + r[j + 1:] for r in rows[1:]])}" for j in range(len(rows))]
    return "(" + " ".join(parts) + ")"
