"""Removal of repeated byte strings with suffix arrays.

A string of ``LENGTH`` bytes that starts at more than one place, in any documents, is taken out wherever it stands.
Each string has an anchor, the smallest hash of its 32-byte grams, and equal strings have equal anchors; runs of
strings of one anchor are pieces of at most ``RUN + LENGTH - 1`` bytes. Anchors of one piece alone can't repeat, so
only pieces of shared anchors are cut out, equal pieces once with their count, and dealt by anchor to shards.

A shard sorts all suffixes of its pieces: by their first eight bytes, then by Larsson-Sadakane refinement, where
groups that are not yet told apart are sorted by the rank of the suffix as many bytes further on, until none is
left. Kasai's walk in text order, many pieces abreast in numpy, gives the common prefix of each suffix
with the one before it; 400 bytes or more mark both.

An anchor with more than ``PIECES`` different pieces (a passage in a great many documents, seen from its borders) is
cut into several shards. Each of these also sends the sorted digests of its different strings, cut into ranges;
the task of a range finds each shard's strings among those of the others by binary search. No task holds more than
about one shard, whatever the anchor's share of the rows.

Texts that are equal as a whole are told by SHA-256: if they have ``LENGTH`` bytes, nothing of them stays. Pieces are
named by anchor and a 64-bit digest, which is verified when a piece is cut out or removed.

Defined results: a null text is empty; a null id is one more id; rows that share an id are documents each; wholly
equal rows repeat one another; texts shorter than ``LENGTH`` bytes stay; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.llm.passages import _window_min
from panelwright.llm.words import buffers, mix
from panelwright.session import materialize

LENGTH, GRAM = 400, 32
RUN = 512  # strings of a piece
PIECES = 2048  # different pieces of one anchor in one shard
BLOCK = 256 << 10  # bytes of text hashed at once
SHARD = 1 << 20  # bytes of small groups of pieces sorted at once
LAST = (1 << 63) - 1  # stands for a null id

_U = np.uint64
_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BY = (mix(np.arange(77, 93, dtype=_U)) | _U(1)).tolist()


def _doubled(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` (a power of two) entries."""
    step = 1
    while step < size and len(h) > step:
        h = h[:-step] * _U(_BY[(step.bit_length() + salt) % 16]) + h[step:]
        step *= 2
    return h if step == size else h[:0]


def _blocks(column: pa.Array):
    raw, at = buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield first, end, raw[at[first]:at[end]], at[first:end + 1] - at[first]
        first = end


def _named(piece) -> int:
    return int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "big") - (1 << 63)


def pieces(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts of one block: row, first byte (in the block), strings, anchor, and whether the anchor
    stands more than once near the piece, so that it may repeat inside."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.astype(_U), none.astype(bool)
    grams = _doubled(_TABLE[raw], GRAM)
    low = _window_min(grams, LENGTH - GRAM + 1)  # of the string that starts here
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    p = np.flatnonzero(row[:len(low)] == row[LENGTH - 1:])
    if not len(p):
        return none, none, none, none.astype(_U), none.astype(bool)
    v = low[p]
    new = np.ones(len(p), bool)
    new[1:] = (np.diff(p) > 1) | (v[1:] != v[:-1]) | (row[p[1:]] != row[p[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(p)))
    long = np.flatnonzero(size > RUN)
    if len(long):
        first = np.sort(np.concatenate([first, *[np.arange(first[i] + RUN, first[i] + size[i], RUN) for i in long]]))
        size = np.diff(np.append(first, len(p)))
    # anchors are the grams that are smallest in some string: twice the same one after the other is a repeat
    reach = LENGTH - GRAM
    padded = np.concatenate([np.zeros(reach, _U), low, np.zeros(reach, _U)])
    highest = ~_window_min(~padded, reach + 1)  # over the strings that hold a gram
    anchors = np.flatnonzero(highest[:len(grams)] == grams)
    again = grams[anchors[1:][(grams[anchors[1:]] == grams[anchors[:-1]]) & (np.diff(anchors) <= LENGTH + RUN)]]
    inside = np.isin(v[first], np.unique(again)) if len(again) else np.zeros(len(first), bool)
    return row[p[first]], p[first], size, v[first], inside


BASE = "ord bigint, full binary, n_bytes bigint, anchors array<bigint>, pids array<bigint>, places array<bigint>, weights array<bigint>"


def base(numbered: DataFrame) -> DataFrame:
    """Digest and length of each text, and its pieces: anchor, name, ``place`` (first byte * 1024 + strings), weight
    (2 if it may repeat inside)."""
    def run(batches):
        for batch in batches:
            for first, end, raw, at in _blocks(batch.column(1)):
                row, start, size, anchor, inside = pieces(raw, at)
                data = memoryview(raw.tobytes())
                pids = np.array([_named(data[s:s + n + LENGTH - 1]) for s, n in zip(start.tolist(), size.tolist())], np.int64)
                full = [hashlib.sha256(data[i:j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - first))]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (
                    anchor.view(np.int64), pids, (start - at[row]) * 1024 + size, 1 + inside.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(full, pa.binary()), pa.array(np.diff(at)), *lists],
                                                 ["ord", "full", "n_bytes", "anchors", "pids", "places", "weights"])

    return numbered.mapInArrow(run, BASE)


def packed(numbered: DataFrame) -> DataFrame:
    """``(ord, z)``: texts compressed for the shuffle."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            made = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["ord", "z"])

    return numbered.mapInArrow(run, "ord bigint, z binary")


def _opened(batch: pa.RecordBatch, z: int):
    opener = zstandard.ZstdDecompressor()
    for i in range(batch.num_rows):
        yield i, opener.decompress(batch.column(z)[i].as_py())


SLICES = "anchor bigint, salt bigint, salts bigint, pid bigint, m bigint, piece binary"


def slices(asked: DataFrame) -> DataFrame:
    """Pieces cut out of ``(z, wanted)``; one whose digest differs belongs to another text of the same id."""
    def run(batches):
        for batch in batches:
            out = []
            for i, text in _opened(batch, 0):
                for w in batch.column(1)[i].as_py():
                    start, size = divmod(w["place"], 1024)
                    piece = text[start:start + size + LENGTH - 1]
                    if _named(piece) == w["pid"]:
                        out.append((w["anchor"], w["salt"], w["salts"], w["pid"], w["m"], piece))
                if len(out) > 4096 or i + 1 == batch.num_rows:
                    cols = list(zip(*out)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:5]], pa.array(cols[5], pa.binary())],
                                                     ["anchor", "salt", "salts", "pid", "m", "piece"])
                    out = []

    return asked.mapInArrow(run, SLICES)


def suffix_array(text: np.ndarray, spots: np.ndarray, end: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes in their order: they start at ``spots`` (rising) and end at ``end``, with the piece ``of`` their
    position; equal suffixes come in the order of their pieces, as if each piece had an end mark of its own.

    Returns the sorted spots, the slot of each (by position in ``text``), and by slot the first slot of the group
    that agrees on 256 bytes. Eight zeros follow each piece of ``text``.
    """
    n = len(spots)
    key = np.zeros(len(text) - 7, _U)
    for i in range(8):
        key = (key << _U(8)) | text[i:i + len(key)]
    key, left = key[spots], np.minimum(end - spots, 8)
    zeros = bool((text[spots] == 0).any())  # else the zeros behind a piece tell its end
    order = np.lexsort((left, key)) if zeros else np.argsort(key)
    sa, key, left = spots[order], key[order], left[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    if zeros:
        new[1:] |= left[1:] != left[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.full(len(text), -1, np.int64)
    rank[sa] = group
    limit = np.zeros(len(text), np.int64)
    limit[spots] = end
    at256, depth, marks = group, 8, int(of[-1]) + 1
    while True:
        if depth == 256:
            at256 = group.copy()
        sizes = np.bincount(group, minlength=n)
        slots = np.flatnonzero(sizes[group] > 1)
        if not len(slots):
            break
        pos = sa[slots]
        further = pos + depth
        inside = further < limit[pos]
        by = np.where(inside, rank[np.where(inside, further, 0)] + marks, of[pos])
        both = group[slots] * (n + marks) + by
        order = np.argsort(both)
        both, pos = both[order], pos[order]
        sa[slots] = pos
        new = np.ones(len(slots), bool)
        new[1:] = both[1:] != both[:-1]
        group = group.copy()
        group[slots] = np.maximum.accumulate(np.where(new, slots, 0))
        rank[pos] = group[slots]
        depth *= 2
    if depth < 256:
        at256 = group
    slot = np.full(len(text), -1, np.int64)
    slot[sa] = np.arange(n)
    return sa, slot, at256


def kasai(text: np.ndarray, sa: np.ndarray, slot: np.ndarray, group: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Spots whose suffix shares ``LENGTH`` bytes with the one sorted before it.

    Kasai's walk: going one byte on in the text shortens a common prefix by one at most. Suffixes alone in their
    group share under 256 bytes with any other and are passed over; runs of the others are walked abreast.
    """
    follows = np.zeros(len(sa), bool)
    follows[1:] = group[1:] == group[:-1]  # shares 256 bytes with the one before
    walk = np.sort(sa[follows])
    if not len(walk):
        return walk
    lanes = np.flatnonzero(np.concatenate([[True], np.diff(walk) > 1]))
    until = np.append(lanes[1:], len(walk))
    longest = np.argsort(lanes - until, kind="stable")
    now, until = lanes[longest], until[longest]
    h = np.full(len(now), 256)
    found = np.zeros(len(walk), bool)
    before = sa[slot[walk] - 1]
    room = np.minimum(np.minimum(left[walk], left[before]), LENGTH)  # a suffix can't share more than its length
    while len(now):
        i, j = walk[now], before[now]
        going = h < room[now]
        step = np.where(going, h, 0)
        going &= text[i + step] == text[j + step]
        h = h + going
        done = ~going
        found[now[done]] = h[done] >= LENGTH
        now = now + done
        h = np.where(done, np.maximum(h - 1, 256), h)
        alive = now < until
        if not alive.all():
            now, until, h = now[alive], until[alive], h[alive]
    return walk[found]


def _digests(text: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of the string at each byte."""
    out = []
    for salt in (3, 9):
        h = _doubled(mix(_TABLE[text] + _U(salt)), 256, salt)
        gap = LENGTH - 256
        out.append(mix(h[:-gap] * _U(_BY[salt]) + h[gap:]) if len(h) > gap else h[:0])
    return np.stack(out, 1)


def _spans(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged ``[start, end)`` of strings at rising ``starts`` of pieces ``of``: piece, start, end."""
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > LENGTH) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first, len(starts))[1:] - 1
    return of[first], starts[first], starts[last] + LENGTH


FOUND = "anchor bigint, pid bigint, spans array<bigint>, range bigint, shard bigint, digests binary, owners array<bigint>"
_FOUND = ["anchor", "pid", "spans", "range", "shard", "digests", "owners"]


def _found(anchor=(), pid=(), spans=(), range_=(), shard=(), digests=(), owners=()) -> pa.RecordBatch:
    n = max(len(anchor), 0)
    empty = [None] * n
    lists = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(pid or empty, pa.int64()), pa.array(spans or empty, lists), pa.array(range_ or empty, pa.int64()),
                                       pa.array(shard or empty, pa.int64()), pa.array(digests or empty, pa.binary()), pa.array(owners or empty, lists)], _FOUND)


def _sorted(rows: list[tuple]) -> pa.RecordBatch:
    """Repeats among the pieces of whole groups ``(anchor, salt, salts, pid, m, piece)``; digests of groups in several shards."""
    size = np.array([len(r[5]) for r in rows])
    text = np.frombuffer(b"".join(x for r in rows for x in (r[5], bytes(8))), np.uint8)
    first = np.cumsum(size + 8) - size - 8
    of = np.repeat(np.arange(len(rows)), size + 8)
    left = (first + size)[of] - np.arange(len(text))  # bytes to the end of the piece
    spots = np.flatnonzero(left > 0)
    sa, slot, group = suffix_array(text, spots, spots + left[spots], of)
    hits = kasai(text, sa, slot, group, left)
    again = np.zeros(len(text), bool)
    again[hits] = True
    again[sa[slot[hits] - 1]] = True
    string = left >= LENGTH
    many = np.array([r[4] for r in rows]) > 1
    again |= many[of]
    again &= string
    piece, a, b = _spans(np.flatnonzero(again), of[again])
    a, b = a - first[piece], b - first[piece]
    out = {}
    for i, x, y in zip(piece.tolist(), a.tolist(), b.tolist()):
        out.setdefault(i, []).extend((x, y))
    batch = _found([rows[i][0] for i in out], [rows[i][3] for i in out], list(out.values()))
    hot = [i for i, r in enumerate(rows) if r[2] > 1]
    if not hot:
        return batch
    lines = []
    names = sorted({rows[i][:3] for i in hot})
    number = {n: k for k, n in enumerate(names)}
    belongs = np.array([number.get(r[:3], -1) for r in rows])
    digests = _digests(text)
    for k, (anchor, salt, salts) in enumerate(names):
        mine = np.flatnonzero(string & (belongs[of] == k))  # below the last 400 bytes, so all have digests
        d = digests[mine]
        order = np.lexsort((d[:, 1], d[:, 0]))
        mine, d = mine[order], d[order]
        one = np.ones(len(d), bool)
        one[1:] = (d[1:] != d[:-1]).any(1)
        mine, d = mine[one], d[one]
        known = again[mine]  # repeats here already: the others need to hear of it, it needs no answer
        bits = max(0, (salts - 1).bit_length())
        edges = np.searchsorted(d[:, 0], np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)) if bits else np.zeros(0, np.int64)
        for r, (i, j) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(d)])):
            owner = np.stack([np.array([rows[x][3] for x in of[mine[i:j]]], np.int64), np.where(known[i:j], -1, mine[i:j] - first[of[mine[i:j]]])], 1)
            lines.append((anchor, r, salt, d[i:j].tobytes(), owner.ravel().tolist()))
    cols = list(zip(*lines))
    sent = _found(cols[0], range_=cols[1], shard=cols[2], digests=cols[3], owners=cols[4])
    return pa.Table.from_batches([batch, sent]).combine_chunks().to_batches()[0]


def sharded(cut: DataFrame, shards: int) -> DataFrame:
    """Each shard's repeats, and its digests where an anchor has several shards."""
    dealt = cut.repartition(shards, "anchor", "salt").sortWithinPartitions("anchor", "salt")

    def run(batches):
        rows, held, now = [], 0, None
        for batch in batches:
            for r in zip(*(x.to_pylist() for x in batch.columns)):
                if r[:2] != now and held >= SHARD:
                    yield _sorted(rows)
                    rows, held = [], 0
                now = r[:2]
                rows.append(r)
                held += len(r[5])
        if rows:
            yield _sorted(rows)

    return dealt.mapInArrow(run, FOUND)


def merged(sent: DataFrame) -> DataFrame:
    """``(anchor, pid, spans)`` of strings that another shard of their anchor has: each range of digests is searched in those of the other shards."""
    def run(group: pa.Table) -> pa.Table:
        anchor = group.column("anchor")[0].as_py()
        runs = [np.frombuffer(d, "<u8").reshape(-1, 2) for d in group.column("digests").to_pylist()]
        every = np.concatenate(runs)
        order = np.lexsort((every[:, 1], every[:, 0]))
        every = every[order]
        out = {}
        for d, owners in zip(runs, group.column("owners").to_pylist()):
            if not len(d):
                continue
            # equal digests stand side by side in the merged run: more than one of them means another shard
            lo = np.searchsorted(every[:, 0], d[:, 0], "left")
            hi = np.searchsorted(every[:, 0], d[:, 0], "right")
            shared = np.zeros(len(d), bool)
            for k in np.flatnonzero(hi - lo > 1):
                shared[k] = (every[lo[k]:hi[k], 1] == d[k, 1]).sum() > 1
            own = np.array(owners, np.int64).reshape(-1, 2)
            for pid, place in own[shared & (own[:, 1] >= 0)].tolist():
                out.setdefault(pid, []).extend((place, place + LENGTH))
        return pa.Table.from_arrays([pa.array([anchor] * len(out), pa.int64()), pa.array(list(out), pa.int64()),
                                     pa.array(list(out.values()), pa.list_(pa.int64()))], ["anchor", "pid", "spans"])

    return sent.groupBy("anchor", "range").applyInArrow(run, "anchor bigint, pid bigint, spans array<bigint>")


CHANGED = "ord bigint, full binary, spans array<bigint>, kept binary"


def cut_out(texts: DataFrame) -> DataFrame:
    """``(ord, full, spans, kept)`` of ``(ord, z, runs)``: removed ``[start, end)`` runs, flattened, and the bytes that stay."""
    def run(batches):
        for batch in batches:
            for i, text in _opened(batch, 1):
                edge = np.zeros(len(text) + 1, np.int64)
                for r in batch.column(2)[i].as_py():
                    start, size = divmod(r["place"], 1024)
                    if _named(text[start:start + size + LENGTH - 1]) == r["pid"]:
                        spans = np.array(r["spans"], np.int64) + start
                        np.add.at(edge, spans[::2], 1)
                        np.add.at(edge, spans[1::2], -1)
                gone = np.cumsum(edge[:-1]) > 0
                if not gone.any():
                    continue
                flips = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([hashlib.sha256(text).digest()], pa.binary()),
                                                  pa.array([flips.tolist()], pa.list_(pa.int64())), pa.array([kept], pa.binary())], ["ord", "full", "spans", "kept"])

    return texts.mapInArrow(run, CHANGED)


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``(doc_id, text)``: ``(ord, full, n_bytes, copy)`` of every row, ``copy`` where nothing stays because another
    row has the same text, and :func:`cut_out` of the other texts that lose something."""
    numbered = docs.toDF("id", "text").select(F.coalesce(F.col("id").cast("bigint"), F.lit(LAST)).alias("ord"), "text")
    rows = materialize(base(numbered), "suffix-base")
    equal = rows.groupBy("full").agg(F.count("*").alias("times")).where("times > 1").select("full")
    marked = rows.select("ord", "full", "n_bytes").join(equal.withColumn("twice", F.lit(True)), "full", "left").select(
        "ord", "full", "n_bytes", (F.coalesce("twice", F.lit(False)) & (F.col("n_bytes") >= LENGTH)).alias("copy"))
    marked = materialize(marked, "suffix-rows")
    zipped = F.arrays_zip(F.col("anchors").alias("anchor"), F.col("pids").alias("pid"), F.col("places").alias("place"), F.col("weights").alias("weight"))
    every = rows.select("ord", F.inline(zipped).alias("anchor", "pid", "place", "weight"))
    shared = every.groupBy("anchor").agg(F.sum("weight").alias("w")).where("w > 1").select("anchor")
    held = materialize(every.drop("weight").join(shared, "anchor"), "suffix-pieces")
    kinds = held.groupBy("anchor", "pid").agg(F.count("*").alias("m"), F.min(F.struct("ord", "place")).alias("one"))
    kinds = materialize(kinds.select("anchor", "pid", "m", "one.ord", "one.place"), "suffix-kinds")
    hot = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > PIECES).select("anchor", F.ceil(F.col("n") / PIECES).alias("n"))
    salts = F.coalesce("n", F.lit(1))
    dealt = kinds.join(hot, "anchor", "left").select("ord", F.struct("place", "anchor", "pid", "m", F.pmod("pid", salts).alias("salt"), salts.alias("salts")).alias("w"))
    wanted = dealt.groupBy("ord").agg(F.collect_list("w").alias("wanted"))
    texts = packed(numbered)
    cut = slices(texts.join(wanted, "ord").select("z", "wanted"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(sharded(cut, shards), "suffix-found")
    crossed = merged(found.where("range IS NOT NULL").select("anchor", "range", "digests", "owners"))
    spans = found.where("pid IS NOT NULL").select("anchor", "pid", "spans").unionByName(crossed)
    live = marked.where("NOT copy").select("ord").distinct()
    runs = held.join(spans, ["anchor", "pid"]).groupBy("ord").agg(F.collect_list(F.struct("place", "pid", "spans")).alias("runs"))
    return marked, cut_out(texts.join(runs.join(live, "ord", "left_semi"), "ord").select("ord", "z", "runs"))


def dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``(doc_id, text)``."""
    marked, changed = repeats(docs)
    total = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: x - a)  # ends less starts, for an even number of them
    lost = changed.select(F.col("ord").alias("o"), F.col("full").alias("f"), total.alias("gone"), (F.size("spans") / 2).cast("bigint").alias("runs"),
                          F.sha2("kept", 256).alias("sha")).distinct()
    copy = F.col("copy")
    return marked.join(lost, (F.col("ord") == F.col("o")) & (F.col("full") == F.col("f")), "left").select(
        F.nullif("ord", F.lit(LAST)).alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("full")))).alias("kept_sha256"))


@query("op12_suffix_array", f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
blocks AS (SELECT doc_id, n, b, substr(h, {2 * LENGTH} * b + 1, {4 * LENGTH}) AS h FROM (SELECT doc_id, n, h, unnest(range(0, n // {LENGTH})) AS b FROM t WHERE n >= {LENGTH}) x),
strings AS (SELECT doc_id, {LENGTH} * b + q AS p, hash(substr(h, 2 * q + 1, {2 * LENGTH})) AS g FROM (SELECT *, unnest(range(0, least({LENGTH}, n - {LENGTH - 1} - {LENGTH} * b))) AS q FROM blocks) x),
again AS (SELECT doc_id, p FROM strings SEMI JOIN (SELECT g FROM strings GROUP BY g HAVING count(*) > 1) m USING (g)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM
 (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM again) y) z GROUP BY doc_id, r),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(b), max(n) FROM spans JOIN t USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM gaps JOIN t USING (doc_id) GROUP BY doc_id),
lost AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256 FROM t LEFT JOIN lost USING (doc_id) LEFT JOIN kept ON kept.doc_id = t.doc_id""")
def op12_suffix_array(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
