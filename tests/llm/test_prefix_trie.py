"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from __spark_entry__ import queries
from panelwright.llm import prefix_trie as T

SHAPE = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16], r, t))
    own = {c: [(x[3], x[4]) for x in sorted(v)] for c, v in own.items()}
    new = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = tuple(own.get(c - c % 5, [])[:h] + mine[h:])
    nodes = {}
    for c, turns in new.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        mine = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        saved[p] = mine + sum(saved[q] for q in kids.get(p, []))
        leaves[p] = sum(leaves[q] for q in kids[p]) if p in kids else 1
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if new[c] == p))).encode()).hexdigest()) for p, m in nodes.items())


def found(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def test_registered_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    frame = queries()["op11_conversation_trie"](spark, sf)
    assert frame.columns == COLUMNS and {t for n, t in frame.dtypes if n != "ends_sha256"} == {"bigint"}
    assert found(frame) == plain(rows)


def invented(seed, n=60, depth=20):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        size = rng.choice([1, 2, 3, depth, rng.randrange(1, depth)])
        rows += [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user", f"t{rng.randrange(2)}é" if rng.random() < 0.8 else None)
                 for t in range(size)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_prefixes(spark, seed, monkeypatch):
    rows = invented(seed)
    rows += [(200 + i, t, "user", "same") for i in range(30) for t in range(12)]  # a group of copies
    rows += [(300, None, "user", "null first"), (300, 4, None, None), (300, 4, None, None), (300, 2, "a", "x"), (None, 1, "user", "no id"), (301, 1, "b", "")]
    assert found(T.trie(spark.createDataFrame(rows, SHAPE).repartition(5))) == plain(rows)


def test_small_chunks_and_handing_over(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 4)
    monkeypatch.setattr(T, "HELD", 50)
    rows = invented(3) + [(500 + i, t, "user", f"{t}" if t < 40 + i else f"{i}-{t}") for i in range(7) for t in range(60)]
    assert found(T.trie(spark.createDataFrame(rows, SHAPE))) == plain(rows)


def test_empty_table_and_clashing_columns(spark):
    assert found(T.trie(spark.createDataFrame([], SHAPE))) == []
    rows = invented(4, 12)
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SHAPE + ", depth bigint, c bigint, A string")
    assert found(T.trie(frame)) == plain(rows)


def test_insertion_against_plain_paths():
    rng = random.Random(8)
    for _ in range(30):
        trie, paths, names = T.ZFastTrie(), [], {}
        for _ in range(60):
            symbols = [rng.randrange(2) for _ in range(rng.randrange(1, 40))] if not paths or rng.random() < 0.3 else rng.choice(paths)[:rng.randrange(1, 30)] + [rng.randrange(3) for _ in range(rng.randrange(0, 9))]
            paths.append(symbols)
            prefix = [hash(tuple(symbols[:i])) for i in range(len(symbols) + 1)]
            runs = trie.insert(0, prefix, [x + 1 for x in prefix])
            numbers = [x for f, n in reversed(runs) for x in range(f, f + n)]
            assert len(numbers) == len(symbols)
            for i, x in enumerate(numbers):
                assert names.setdefault(tuple(symbols[:i + 1]), x) == x
        assert len(trie.at) == len(names)
