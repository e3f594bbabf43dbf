"""Repeated passages: anchors in several shards, very many words, and the registered query, against plain windows."""

import random

from __spark_entry__ import queries
from panelwright.llm import passages as P
from tests.llm import brute

SHAPE = "doc_id bigint, text string"


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def want(rows):
    return sorted(((i, n, n - len(k), brute.sha(" ".join(k))) for (i, _), (n, k) in zip(rows, brute.kept_words(rows))), key=repr)


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    frame = queries()["op5_repeated_passages"](spark, sf)
    assert frame.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert found(frame) == want(rows)


def test_anchor_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECES", 2)
    monkeypatch.setattr(P, "SHARD", 3000)
    monkeypatch.setattr(P, "HELD", 2000)
    rng = random.Random(9)
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate((25, 40, 21, 90))]
    rows = []
    for i in range(80):
        words = [f"d{i}x{rng.randrange(6)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(4)
            words += p[a:len(p) - rng.randrange(4)] + [f"y{rng.randrange(4)}" for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(words)))
    rows += [(None, rows[3][1]), (5, rows[5][1] + " more"), (5, "z " * 60), (200, rows[9][1]), (201, rows[9][1])]
    assert found(P.dedup(spark.createDataFrame(rows, SHAPE).repartition(7))) == want(rows)


def test_more_different_words_than_code_points(spark):
    passage = " ".join(f"shared{i}" for i in range(40))
    long = " ".join(f"w{i}" for i in range(1_130_000))
    frame = spark.createDataFrame([(1, "a b " + passage), (2, long + " " + passage)], SHAPE)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in P.dedup(frame).collect()}
    assert got == {1: (42, 0), 2: (1_130_040, 40)}
