"""Nearest neighbours by cross-polytope hashing.

Each table turns unit vectors with a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and assigns them to the nearest signed axis. A row stands once in every table; a query visits
the axes nearest to it. Rows and queries meet by (table, axis), and candidates are reranked by exact
distance inside the task, so only a query's nearest leave it. A bucket with many rows or queries is split by hashes
into blocks; each block of rows meets each block of its queries in a task of its own.

Hashing sees directions and the reranking sees distances; for vectors of unequal length probes follow
the axes of the direction. The number of tables and probes is fixed by the recall measured against brute
force (see the README), and does not depend on the number of rows. A query whose tables give under ``FEW`` different
rows, as in a small table, is compared with all rows in blocks, which is exact.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; a null id takes no part; equal rows are candidates each; of equal distances the
smaller id is nearer; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.session import materialize

TABLES, PROBES = 8, 12
TOP = 10
FEW = 100  # a query whose tables give fewer different rows is compared with all rows, in blocks
PART_ROWS = 20_000  # rows, and queries, of a bucket that one task holds
CELLS = 1 << 20  # more than the signed axes of any vector
BLOCK = 64  # queries reranked at once


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-rotation of the rows of ``x``, padded with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), size))
    y[:, :x.shape[1]] = x
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(3):
        y *= rng.choice([-1.0, 1.0], size)
        step = 1
        while step < size:
            y = y.reshape(len(x), -1, 2, step)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), size)
            step *= 2
    return y


def axes(x: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The ``probes`` signed axes nearest to each row: axis i is 2i, its opposite 2i + 1."""
    y = rotate(x, seed)
    both = np.stack([y, -y], 2).reshape(len(x), -1)
    probes = min(probes, both.shape[1])
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return near.astype(np.int32)


def valid(df: DataFrame, *, key: str, vector: str) -> DataFrame:
    """``(id, v)`` of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).agg(F.max_by("n", F.struct("m", "n")).alias("n"))
    return good.join(F.broadcast(sizes), F.size("v") == F.col("n"), "left_semi")  # one row


def placed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """``rows`` once per table and axis: ``(id, v, cell)``."""
    def run(frames):
        for whole in frames:
            for low in range(0, len(whole), 2000):
                part = whole.iloc[low:low + 2000]
                x = np.stack(part["v"].to_numpy())
                x = x / np.abs(x).max(1, keepdims=True)
                for t in range(tables):
                    near = axes(x, t + 1, probes)
                    at = np.repeat(np.arange(len(part)), near.shape[1])
                    yield pd.DataFrame({"id": part["id"].to_numpy()[at], "v": part["v"].to_numpy()[at],
                                        "cell": (t * CELLS + near.ravel()).astype(np.int32)})

    return rows.mapInPandas(run, "id bigint, v array<double>, cell int")


def compared(rows: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """``(query_id, id, score)``: the ``top`` nearest of each block of ``rows`` to each of ``asked``, both ``(id, v)``; every block of
    queries meets every block of rows."""
    def blocked(size: int):
        def run(batches):
            for batch in batches:
                for low in range(0, batch.num_rows, size):
                    part = batch.slice(low, size)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                                                      pa.array([part.column(1).flatten().to_numpy().astype("<f8").tobytes()], pa.binary())], ["ids", "x"])
        return run

    left = rows.mapInArrow(blocked(2048), "ids binary, x binary")
    right = asked.mapInArrow(blocked(256), "ids binary, x binary").toDF("q_ids", "q")

    def run(batches):
        for batch in batches:
            for ids, x, q_ids, q in zip(*(c.to_pylist() for c in batch.columns)):
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                x, q = np.frombuffer(x, "<f8").reshape(len(ids), -1), np.frombuffer(q, "<f8").reshape(len(q_ids), -1)
                out = []
                for i, one in zip(q_ids, q):
                    d = np.sqrt(((x - one) ** 2).sum(1))
                    keep = np.lexsort((ids, d))
                    keep = keep[ids[keep] != i][:top]
                    out.append((np.full(len(keep), i), ids[keep], d[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "id", "score"])

    return left.crossJoin(right).mapInArrow(run, "query_id bigint, id bigint, score double")


def nearest(rows: DataFrame, queries: DataFrame, *, key: str, vector: str, top: int = TOP, tables: int = TABLES,
            probes: int = PROBES) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``top`` rows found nearest to each query, itself left out."""
    base = placed(valid(rows, key=key, vector=vector), tables, 1)
    asked = placed(valid(queries, key=key, vector=vector), tables, probes)
    base = materialize(base, "cells")
    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("cell").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias(name))

    asked = materialize(asked, "probes")
    counts = blocks(base, "parts").join(blocks(asked, "turns"), "cell")

    def mine(parts: str):
        return F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")

    def every(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    left = base.join(counts, "cell").select("cell", mine("parts").alias("part"), every("turns").alias("turn"), "id", "v")
    right = asked.join(counts, "cell").select("cell", every("parts").alias("part"), mine("turns").alias("turn"), "id", "v")

    def rerank(rows_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows_) and len(asked_):
            ids = rows_["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], np.stack(rows_["v"].to_numpy())[order]
            for low in range(0, len(asked_), BLOCK):
                part = asked_.iloc[low:low + BLOCK]
                q = np.stack(part["v"].to_numpy())
                rough = (x * x).sum(1)[None] - 2 * q @ x.T  # picks, with slack; the score is exact
                for i, qid in enumerate(part["id"].to_numpy()):
                    mine = np.where(ids == qid, np.inf, rough[i])
                    few = min(top, len(ids))
                    limit = np.partition(mine, few - 1)[few - 1]
                    near = np.flatnonzero(mine <= limit + 1e-9 * (1 + abs(limit))) if np.isfinite(limit) else np.flatnonzero(ids != qid)
                    d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    keep = np.lexsort((ids[near], d))[:top]
                    out.append(pd.DataFrame({"query_id": qid, "id": ids[near][keep], "score": d[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    found = left.groupBy("cell", "part", "turn").cogroup(right.groupBy("cell", "part", "turn")).applyInPandas(
        rerank, "query_id bigint, id bigint, score double")
    # a row found through several tables counts once; equal rows of one id count once each only where they differ in distance
    best = materialize(found.distinct(), "found")
    every_row, asked_rows = valid(rows, key=key, vector=vector), valid(queries, key=key, vector=vector)
    seen = best.groupBy("query_id").agg(F.countDistinct("id").alias("m"))
    short = asked_rows.join(seen, asked_rows["id"] == F.col("query_id"), "left").where(F.coalesce("m", F.lit(0)) < FEW).select("id", "v")
    short = materialize(short, "short")
    if short.limit(1).count():
        best = best.unionByName(compared(every_row, short, top)).distinct()
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")


@query("op7_cross_polytope")
def op7_cross_polytope(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0), key="vec_id", vector="embedding").withColumnRenamed("id", "vec_id")
