"""Clusters against plain integer k-means in Python."""

import hashlib
import math

import numpy as np
import pytest

from __spark_entry__ import queries
from panelwright.llm import vafile


def plain(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                   for i, d, j in found), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_registered_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    frame = queries()["op13_vafile_clusters"](spark, sf)
    assert frame.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert dict(frame.dtypes)["cluster"] == "int" and dict(frame.dtypes)["distance"] == "bigint"
    assert rows_of(frame) == plain([tuple(r) for r in docs])


SHAPE = "vec_id bigint, embedding array<float>"


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64)]) for i in range(40)]
    rows += [(3, rows[7][1]), (3, rows[3][1]), (None, rows[1][1]), (50, None), (51, []), (52, [1.0] * 63), (53, [None] + [1.0] * 63),
             (54, [float("nan")] * 64), (55, [float("inf")] + [0.0] * 63), (56, [0.0] * 64), (57, [1000.0] * 64), (58, [-3.5] * 64)]
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert rows_of(vafile.report(frame)) == plain(rows)
    assert rows_of(vafile.report(frame, k=3, rounds=6)) == plain(rows, k=3, rounds=6)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert rows_of(vafile.report(spark.createDataFrame(rows, SHAPE))) == plain(rows)


def test_equal_vectors_and_huge_values(spark):
    rows = [(i, [0.25] * 64) for i in range(30)] + [(99, [3e38] * 64)]
    assert rows_of(vafile.report(spark.createDataFrame(rows, SHAPE))) == plain(rows[:30])


def test_separated_clusters_open_few_vectors():
    rng = np.random.default_rng(1)
    at = rng.integers(-1000, 1000, (16, 64))
    v = at[rng.integers(0, 16, 5000)] + rng.integers(-20, 20, (5000, 64))
    low, high = v.min(0), v.max(0)
    cuts = np.floor(low + (high - low) * (np.arange(1, 64) / 64)[:, None]).astype(np.int64)
    cells = np.vstack([low, cuts + 1]), np.vstack([cuts, high])
    code = np.stack([np.searchsorted(cuts[:, d], v[:, d], "left") for d in range(64)], 1)
    found, n = vafile.nearest(code, lambda rows: v[rows], cells, at)
    assert (found == ((v[:, None] - at) ** 2).sum(2).argmin(1)).all()
    assert n == 0
