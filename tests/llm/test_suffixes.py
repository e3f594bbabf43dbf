"""Repeated byte strings against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest

from __spark_entry__ import queries
from panelwright.llm import suffixes as S

SHAPE = "doc_id bigint, text string"


def plain(rows, n=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}

    def name(t, p):
        return hashlib.blake2b(t[p:p + n], digest_size=12).digest()

    for _, t in texts:
        for p in range(len(t) - n + 1):
            k = name(t, p)
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, t in texts:
        edge = np.zeros(len(t) + 1, np.int64)
        for p in range(len(t) - n + 1):
            if seen[name(t, p)] > 1:
                edge[p] += 1
                edge[p + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    frame = queries()["op12_suffix_array"](spark, sf)
    assert frame.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert found(frame) == plain(rows)


def planted(seed):
    rng = random.Random(seed)
    passages = [words(rng, k) for k in (90, 120, 400, 60)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randrange(5, 200))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 40)
            parts += [p[cut:len(p) - rng.randrange(0, 40)], words(rng, rng.randrange(1, 60))]
        rows.append((i, rng.choice([" ", "", "\n"]).join(parts)))
    return rows, rng


def test_passages_ties_and_awkward_texts(spark):
    rows, rng = planted(1)
    rows += [(100, None), (101, ""), (102, "x" * 399), (103, "y" * 400), (104, "z" * 401), (105, "ab" * 3000), (106, "\0" * 450), (107, "q" * 300 + "\0" * 420),
             (None, rows[3][1]), (None, "only one " + words(rng, 80)), (7, words(rng, 90)), (7, rows[9][1][:600]), (8, rows[8][1]), (8, rows[8][1]),
             (110, "é" * 500), (111, "aé" * 230 + words(rng, 40)), (112, words(rng, 12000)), (113, rows[5][1] + "tail"), (114, "w" * 5000 + words(rng, 100) + "w" * 700)]
    x = words(rng, 70)
    rows += [(120, x + "1"), (121, "2" + x), (122, x[:399] + "3"), (123, x[1:400] + "4")]
    assert found(S.dedup(spark.createDataFrame(rows, SHAPE).repartition(4))) == plain(rows)


def test_anchor_in_several_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECES", 3)
    monkeypatch.setattr(S, "SHARD", 2000)
    rows, _ = planted(2)
    assert found(S.dedup(spark.createDataFrame(rows, SHAPE).repartition(3))) == plain(rows)


def test_empty_table(spark):
    assert found(S.dedup(spark.createDataFrame([], SHAPE))) == []


@pytest.mark.parametrize("letters", [b"ab", b"\0a", b"abcdefgh"])
def test_suffixes_against_sorting(letters):
    rng = random.Random(4)
    block = bytes(rng.choice(letters) for _ in range(900))
    made = [block[:700], block[100:], block[100:650], b"a" * 600, bytes(rng.choice(letters) for _ in range(500)), block[300:740]]
    text = np.frombuffer(b"".join(x + bytes(8) for x in made), np.uint8)
    size = np.array([len(x) for x in made])
    first = np.cumsum(size + 8) - size - 8
    of = np.repeat(np.arange(len(made)), size + 8)
    left = (first + size)[of] - np.arange(len(text))
    spots = np.flatnonzero(left > 0)
    sa, slot, group = S.suffix_array(text, spots, spots + left[spots], of)

    def head(p, n):
        return text[p:p + min(n, left[p])].tobytes()

    assert sa.tolist() == sorted(spots.tolist(), key=lambda p: (head(p, 9999), of[p]))
    assert (sa[slot[sa]] == sa).all()
    hits = set(S.kasai(text, sa, slot, group, left).tolist())
    want = {b for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()) if left[a] >= 400 and left[b] >= 400 and head(a, 400) == head(b, 400)}
    assert hits == want
