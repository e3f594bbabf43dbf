"""Delimited exports with preamble lines, a header somewhere, footers and dirty cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NOTES = r"(?i)^(data source|last updated|data for|source)\b"


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str], *, key: str,
                   numbers: Sequence[str], picks: Sequence[int] | None = None,
                   missing: Sequence[str] = ("NA", "false"), header: Sequence[str] = (), notes: str = NOTES) -> DataFrame:
    """Read columns by position and drop every line that is not a record.

    Files are split and read in parallel, so "skip the first n lines" has no meaning per split. A line goes
    if its key cell is empty, if it repeats the ``header`` cells, or if its key matches ``notes`` (preamble and
    footer). Every other line is a record: a cell that is no number, or a ``missing`` marker, becomes NULL and
    costs nothing else. ``picks`` takes 1-based positions of a wider sheet. Use :func:`dropped_lines` for the rest.
    """
    return _lines(spark, path, columns, key, numbers, picks, missing, header, notes).where("__record").drop("__record")


def dropped_lines(spark: SparkSession, path: str, columns: Sequence[str], *, key: str, numbers: Sequence[str],
                  picks: Sequence[int] | None = None, missing: Sequence[str] = ("NA", "false"),
                  header: Sequence[str] = (), notes: str = NOTES) -> DataFrame:
    """The lines that :func:`read_delimited` leaves out."""
    return _lines(spark, path, columns, key, numbers, picks, missing, header, notes).where("NOT __record").drop("__record")


def _lines(spark, path, columns, key, numbers, picks, missing, header, notes) -> DataFrame:
    picks = list(picks or range(1, len(columns) + 1))
    declared = ", ".join(f"c{i} string" for i in range(1, max(picks) + 1))
    raw = spark.read.schema(declared).csv(path)
    text = raw.select(*[F.trim(f"c{p}").alias(c) for p, c in zip(picks, columns)])
    marked = {c: F.coalesce(F.col(c).isin(*missing), F.lit(False)) for c in columns}
    plain = {c: F.regexp_replace(F.regexp_replace(c, r"(?<=\d),(?=\d{3})", ""), r"(?<=\d)\s*[*†]+$", "") for c in columns}
    named = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == h.lower() for c, h in zip(columns, header)]
    heads = _all(*named) if named else F.lit(False)
    record = F.coalesce(F.col(key), F.lit("")) != ""
    return text.select(
        *[
            F.when(~marked[c], plain[c].try_cast("double")).alias(c)
            if c in numbers
            else F.when(~marked[c], F.nullif(F.col(c), F.lit(""))).alias(c)
            for c in columns
        ],
        (record & ~heads & ~F.coalesce(F.col(key).rlike(notes), F.lit(False))).alias("__record"),
    )


def _all(*conds):
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out
