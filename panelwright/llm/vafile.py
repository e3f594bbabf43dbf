"""Exact centroid clustering (k-means) over a VA-file.

Every component becomes the integer ``floor(scale * x)``. The VA-file holds of each vector a cell of ``BITS``
bits per dimension, packed; marks are evenly spaced over four deviations about the mean of each dimension, and the
outermost cells reach to its smallest and largest value, so the marks come from all rows. A round turns the
centroids into two tables, the least and the largest squared difference of each cell to each centroid; summed
over the dimensions they give an interval that holds the distance. A centroid whose interval starts beyond the
end of another's can't be nearest; only where intervals overlap is the full vector opened and compared.
Intervals hold in whole numbers and ties stay candidates, so assignments equal those of a full comparison.

Vectors never leave the partition that reads them: a round is one pass that shuffles, for each Arrow batch, one
row of counts and sums for each centroid. Marks, centroids and their sums (k rows) are all that reaches the driver.
A vector in a third of all rows is summed where it is read.

Defined results: a vector takes part if it has exactly ``dims`` components, none null or non-finite, and no
integer beyond 2**27 in magnitude (beyond that a distance does not fit a long); others give no row. A null id
takes part but starts no centroid unless ids run out; rows of equal ids or equal vectors are vectors each, and
of equal hashes the componentwise smaller vector starts first. With fewer vectors than ``k`` there are as many
centroids as vectors; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.session import materialize

BITS = 6
REACH = 4.0  # deviations about the mean that the inner marks span
LARGEST = 1 << 27
BLOCK = 4096  # vectors compared at once


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components."""
    lens = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lens == dims)
    flat = column.take(pa.array(rows)).flatten()
    x = pc.fill_null(pc.cast(flat, pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(x * scale)
        good = (np.abs(x) <= LARGEST).all(1)  # false for NaN and the infinities too
    return rows[good], x[good].astype(np.int64)


def closed(v: np.ndarray) -> list[bytes]:
    """Full vectors as bytes that order as the components do."""
    return [r.tobytes() for r in (v + (1 << 31)).astype(">u4")]


def opened(column: pa.Array, dims: int) -> np.ndarray:
    """Components of the full vectors of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").reshape(-1, dims).astype(np.int64) - (1 << 31)


def pack_cells(code: np.ndarray) -> list[bytes]:
    bits = (code[:, :, None] >> np.arange(BITS)) & 1
    return [r.tobytes() for r in np.packbits(bits.astype(np.uint8).reshape(len(code), -1), axis=1)]


def unpack_cells(column: pa.Array, dims: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    bits = np.unpackbits(packed, axis=1, count=dims * BITS).reshape(len(column), dims, BITS)
    return bits @ (1 << np.arange(BITS)).astype(np.uint8)


def marks(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Smallest and largest integer of each cell, ``[cells, dims]`` each, from all rows; None without rows."""
    def run(batches):
        for batch in batches:
            v = opened(batch.column(0), dims)
            if len(v):
                f = v.astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, len(v)), pa.int64()),
                                                  pa.array(v.min(0)), pa.array(v.max(0)), pa.array(f.sum(0)), pa.array((f * f).sum(0))],
                                                 ["dim", "n", "low", "high", "s", "q"])

    parts = vectors.select("v").mapInArrow(run, "dim int, n bigint, low bigint, high bigint, s double, q double")
    rows = parts.groupBy("dim").agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("s"), F.sum("q")).orderBy("dim").collect()  # dims rows
    if not rows:
        return None
    _, n, low, high, s, q = (np.array(c) for c in zip(*rows))
    mean = s / n
    sd = np.sqrt(np.maximum(q / n - mean * mean, 0))
    a, b = np.maximum(low, mean - REACH * sd), np.minimum(high, mean + REACH * sd)
    steps = (np.arange(1, 1 << BITS) / (1 << BITS))[:, None]
    cuts = np.clip(np.floor(a + (b - a) * steps).astype(np.int64), low, high)  # cell i holds the values up to cut i
    return np.vstack([low, cuts + 1]), np.vstack([cuts, high])


def intervals(code: np.ndarray, cells: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of each row to each centroid, by table lookups."""
    low, high = cells
    k = len(centroids)
    below, above = low[:, :, None] - centroids.T, centroids.T - high[:, :, None]  # [cells, dims, k]
    least = np.maximum(np.maximum(below, above), 0)
    most = np.maximum(np.abs(below), np.abs(above))
    tables = np.concatenate([least * least, most * most], axis=2)
    total = np.zeros((len(code), 2 * k), np.int64)
    for d in range(code.shape[1]):
        total += tables[code[:, d], d]
    return total[:, :k], total[:, k:]


def nearest(code: np.ndarray, full, cells, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of each row, the smaller of equal ones; and how many vectors were opened.

    ``full(rows)`` opens vectors; it is called with the rows whose intervals overlap.
    """
    least, most = intervals(code, cells, centroids)
    open_ = least <= most.min(1)[:, None]
    out = open_.argmax(1)
    rows = np.flatnonzero(open_.sum(1) > 1)
    if len(rows):
        v = full(rows)
        far = np.iinfo(np.int64).max
        best = np.full(len(rows), far)
        for j, c in enumerate(centroids):
            mine = open_[rows, j]
            apart = np.full(len(rows), far)
            apart[mine] = ((v[mine] - c) ** 2).sum(1)
            better = apart < best
            out[rows[better]], best[better] = j, apart[better]
    return out, len(rows)


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance)`` of ``(vec_id, embedding)`` after ``rounds`` updates, and the final centroids.

    Centroids start as the ``k`` vectors of smallest ``sha256(seed:vec_id)``.
    """
    spark = vectors.sparkSession
    named = vectors.toDF("vec_id", "embedding").select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))

    def prepared(batches):
        for batch in batches:
            rows, v = integers(batch.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(closed(v), pa.binary())], ["vec_id", "v"])

    kept = named.mapInArrow(prepared, "vec_id bigint, v binary")
    cells = marks(kept, dims)
    if cells is None:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), []
    uppers = cells[1][:-1]

    def approximated(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = opened(part.column(1), dims)
                code = np.zeros(v.shape, np.uint8)
                for d in range(dims):
                    code[:, d] = np.searchsorted(uppers[:, d], v[:, d], "left")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pack_cells(code), pa.binary()), part.column(1)], ["vec_id", "cells", "v"])

    stored = materialize(kept.mapInArrow(approximated, "vec_id bigint, cells binary, v binary"), "vafile")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = stored.withColumn("h", key).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).select("v").collect()  # the k that start
    centroids = opened(pa.array([r["v"] for r in first], pa.binary()), dims)

    def assigned(batch: pa.RecordBatch, at: np.ndarray):
        """Blocks of a batch with the cluster of each row; ``at`` are the centroids."""
        cell_at, full_at = batch.schema.get_field_index("cells"), batch.schema.get_field_index("v")
        for first in range(0, batch.num_rows, BLOCK):
            part = batch.slice(first, BLOCK)
            full = part.column(full_at)
            code = unpack_cells(part.column(cell_at), dims)
            found, _ = nearest(code, lambda rows, full=full: opened(full.take(pa.array(rows)), dims), cells, at)
            yield part, found, full

    for _ in range(rounds):
        def sums(batches, at=centroids):
            for batch in batches:
                n, total = np.zeros(len(at), np.int64), np.zeros((len(at), dims), np.int64)
                for _, found, full in assigned(batch, at):
                    one = np.zeros((len(at), len(found)))
                    one[found, np.arange(len(found))] = 1.0
                    total += (one @ opened(full, dims).astype(float)).astype(np.int64)  # whole numbers below 2**53
                    n += np.bincount(found, minlength=len(at))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]),
                                                  pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

        parts = stored.select("cells", "v").mapInArrow(sums, "cluster int, n bigint, s array<bigint>")
        rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[d]) for d in range(dims)]).alias("s")).collect()  # k rows
        for r in rows:
            centroids[r["cluster"]] = [t // r["n"] for t in r["s"]]

    def last(batches, at=centroids):
        for batch in batches:
            for part, found, full in assigned(batch, at):
                apart = ((opened(full, dims) - at[found]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int32()), pa.array(apart, pa.int64())], ["vec_id", "cluster", "distance"])

    return stored.mapInArrow(last, "vec_id bigint, cluster int, distance bigint"), centroids.tolist()


def report(vectors: DataFrame, **parameters) -> DataFrame:
    """:func:`cluster` with the inertia of each cluster and of all, and the digest of each final centroid."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, **parameters)
    found = materialize(found, "clusters")
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    rows = [(j, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j in sorted(per)]
    notes = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(notes), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def _sql(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """DuckDB text: every distance in full."""
    apart = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)])"
    parts = [f"""kept AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
 WHERE len(embedding) = {dims} AND list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END for x in embedding]) = 0)""",
             f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INT) AS k, v AS c FROM kept ORDER BY sha256('1:' || vec_id) LIMIT {k})"]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min({apart}) AS distance, arg_min(k, {{'d': {apart}, 'k': k}}) AS k FROM kept, c{r} GROUP BY vec_id)")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM
 (SELECT k, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT k, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM a{r}) u GROUP BY k, i) g GROUP BY k) m ON m.k = c{r}.k)""")
    last = f"a{rounds}"
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.k AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c, ',')) AS centroid_sha256 FROM {last} a JOIN c{rounds} c ON c.k = a.k"""


@query("op13_vafile_clusters", _sql())
def op13_vafile_clusters(spark, sf_dir):
    return report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
