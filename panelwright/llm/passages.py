"""Repeated-passage removal with Aho-Corasick automata.

A window is a run of 20 words; a word goes when a window over it also starts earlier, in a document
of smaller id or before in its own. Two documents that share a window also share its anchor, the
smallest of its eight-word hashes, so only windows with an anchor that two documents have are looked at
(about a seventh of the words are anchors). Runs of windows of one shared anchor are pieces, equal pieces are
taken together, and pieces are dealt by their anchor to shards: each document's words go to the shards whose
anchors it holds. A shard confirms the windows that several of its pieces have, compiles them into an Aho-Corasick
automaton and streams all its pieces through it; its hits are the places that go. An anchor with more than
``PIECES`` different pieces is cut into several shards, whose smallest documents of each window are compared by ranges of
the window's hash. No list of all phrases is ever in one place.

Documents of equal word sequences are settled as one: all but the smallest id lose every word, if
there are at least 20. Repeats inside a document are found in the document. Each shuffle either combines equal keys on the map side
or joins on a small unique side, so a passage in a third of all documents does not gather in a task.

Defined results: a null text has no words; a null id comes after all others; rows that share an id
are not earlier than one another; wholly equal rows give equal results; an empty table gives an empty
result; other columns of the input take no part or are carried along.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import free_name, query, table
from panelwright.llm.neardup import packed
from panelwright.llm.words import BLOCK, Words, blocks, grams, inside_rows, list_array, mix
from panelwright.session import materialize

WINDOW, ANCHOR = 20, 8
PIECES = 2048  # different pieces of one anchor in one shard
SHARD = 1 << 20  # bytes of pieces that one automaton is compiled for
HELD = 16 << 20  # bytes of pieces a task holds before it hands them over
LAST = (1 << 63) - 1  # stands for a null id

_U = np.uint64


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of every run of ``n``."""
    have = 1
    while have * 2 <= n:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[:len(x) - (n - have)], x[n - have:]) if n > have else x


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window in the block: first word, row, hash, anchor."""
    h = w.hashes()
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(_U), none.astype(_U)
    at = np.flatnonzero(inside_rows(w.bounds, WINDOW, len(h)))
    anchor = _window_min(grams(h, ANCHOR, 6), WINDOW - ANCHOR + 1)
    return at, w.row[at], grams(h, WINDOW)[at], anchor[at]


def _later(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """True where a window's hash stood before in the same row."""
    _, first = np.unique(key + row.astype(_U) * _U(0x9E3779B97F4A7C15), return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return later


def cover(starts: np.ndarray, total: int) -> np.ndarray:
    """True for words under a window that starts at one of ``starts``."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return np.cumsum(edge[:-1]) > 0


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def _texts(raw: np.ndarray, at: np.ndarray) -> list[list[bytes]]:
    data = raw.tobytes()
    return [data[i:j].split() for i, j in zip(at[:-1], at[1:])]  # bytes.split() knows the same six blanks


BASE = "ord bigint, full binary, n_words bigint, n_removed bigint, kept binary, anchors array<bigint>"


def base(docs: DataFrame) -> DataFrame:
    """What each document is without the others: its words, own repeats and distinct anchors.

    ``full`` is the digest of all words, ``kept`` that of the words its own repeats leave, null if those are all.
    """
    def run(batches):
        for batch in batches:
            for first, end, raw, at in blocks(batch.column(1)):
                w = Words(raw, at)
                start, row, key, anchor = windows(w)
                gone = cover(start[_later(key, row)], len(w.start))
                size, full, left = np.diff(w.bounds), [], []
                for i, words in enumerate(_texts(raw, at)):
                    full.append(_digest(words))
                    mine = gone[w.bounds[i]:w.bounds[i + 1]]
                    left.append(_digest([x for x, g in zip(words, mine) if not g]) if mine.any() else None)
                pairs = np.unique(np.stack([row.astype(_U), anchor], 1), axis=0) if len(row) else np.zeros((0, 2), _U)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), pa.array(full, pa.binary()), pa.array(size, pa.int64()),
                    pa.array(np.bincount(w.row[gone], minlength=end - first), pa.int64()), pa.array(left, pa.binary()),
                    list_array(np.ascontiguousarray(pairs[:, 1]).view(np.int64),
                               np.bincount(pairs[:, 0].astype(np.int64), minlength=end - first), pa.int64()),
                ], ["ord", "full", "n_words", "n_removed", "kept", "anchors"])

    return docs.mapInArrow(run, BASE)


def _block(opened: list[bytes]) -> Words:
    at = np.concatenate([[0], np.cumsum([len(t) for t in opened])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(opened), np.uint8), at)


def _groups(batch: pa.RecordBatch, z: int):
    """Slices of a batch of about ``BLOCK`` bytes of text each, with the texts opened."""
    opener, first, held, size = zstandard.ZstdDecompressor(), 0, [], 0
    for i in range(batch.num_rows):
        held.append(opener.decompress(batch.column(z)[i].as_py()))
        size += len(held[-1])
        if size >= BLOCK or i + 1 == batch.num_rows:
            yield batch.slice(first, i + 1 - first), held
            first, held, size = i + 1, [], 0


def _tag(full: bytes) -> int:
    """Tells rows of one id apart: 31 bits of the text's digest."""
    return int.from_bytes(full[:4], "big") >> 1


PIECE = "anchor bigint, pid bigint, ord bigint, place bigint, size bigint, head bigint, m bigint, words binary"
_PIECE = ["anchor", "pid", "ord", "place", "size", "head", "m", "words"]


def _rows(kind: str, names: list[str], columns: dict) -> pa.RecordBatch:
    """A batch of the Arrow schema that ``kind`` spells; columns that are not given are null."""
    types = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    n = len(next(iter(columns.values())))
    kinds = dict(x.split(" ") for x in kind.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), types[kinds[c]]) for c in names], names)


def candidates(texts: DataFrame) -> DataFrame:
    """Pieces of ``(ord, z, shared)``: runs of windows with one shared anchor, named by anchor and ``pid``.

    A row with ``ord`` is a place: the tag of the text and the first window, and how many windows; each piece once per
    document. A row with ``words`` is a piece as a task first met it, with the least ``ord`` and the number of documents there.
    First and last window of a run overlap, so their hashes and the length stand for all its words.
    """
    def run(batches):
        kinds, held = {}, 0

        def handed_over():
            names = list(zip(*kinds))
            values = list(zip(*kinds.values()))
            yield _rows(PIECE, _PIECE, dict(anchor=names[0], pid=names[1], head=values[0], m=values[1], words=values[2]))

        for batch in batches:
            for part, opened in _groups(batch, 1):
                w = _block(opened)
                start, row, key, anchor = windows(w)
                shared = part.column(2)
                lens = np.asarray(shared.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                salt = _U(0x9E3779B97F4A7C15)
                known = shared.flatten().to_numpy(zero_copy_only=False).view(_U) + np.repeat(np.arange(len(lens)), lens).astype(_U) * salt
                pick = np.flatnonzero(np.isin(anchor + row.astype(_U) * salt, known))
                new = np.ones(len(pick), bool)
                new[1:] = (np.diff(pick) > 1) | (anchor[pick[1:]] != anchor[pick[:-1]]) | (row[pick[1:]] != row[pick[:-1]])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(pick)))
                # an anchor that repeats inside a run can stretch it: cut runs so that the ends still overlap
                long = size > WINDOW
                if long.any():
                    first = np.sort(np.concatenate([first, *[np.arange(f + WINDOW, f + n, WINDOW) for f, n in zip(first[long], size[long])]]))
                    size = np.diff(np.append(first, len(pick)))
                head, tail = pick[first], pick[first + size - 1]
                piece = mix(key[head] + mix(key[tail] + size.astype(_U)))
                once = ~_later(piece, row[head])
                tag = np.array([_tag(_digest(t.split())) for t in opened], np.int64)
                head, tail, size, at = head[once], tail[once], size[once], row[head[once]]
                named, anchors = piece[once].view(np.int64), anchor[head].view(np.int64)
                ids = part.column(0).take(pa.array(at))
                data = w.raw.tobytes()
                for a, p, o, i, j in zip(anchors.tolist(), named.tolist(), ids.to_pylist(), w.start[start[head]].tolist(), w.end[start[tail] + WINDOW - 1].tolist()):
                    seen = kinds.get((a, p))
                    if seen is None:
                        kinds[a, p] = [o, 1, data[i:j]]
                        held += j - i + 100
                    else:
                        seen[0] = min(seen[0], o)
                        seen[1] += 1
                yield _rows(PIECE, _PIECE, dict(anchor=anchors, pid=named, ord=ids, place=(tag[at] << 32) + start[head] - w.bounds[at], size=size))
                if held > HELD:
                    yield from handed_over()
                    kinds, held = {}, 0
        if kinds:
            yield from handed_over()

    return texts.mapInArrow(run, PIECE)


FOUND = "anchor bigint, pid bigint, head bigint, spans array<bigint>, range bigint, digests binary, owners array<bigint>"
_FOUND = ["anchor", "pid", "head", "spans", "range", "digests", "owners"]


def _streamed(rows: list[tuple]) -> list[pa.RecordBatch]:
    """Repeats among the pieces ``(anchor, salt, salts, pid, head, m, words)`` of whole groups.

    Windows that two different pieces have are phrases; all are compiled into one automaton, and the pieces, joined by a
    sign that no phrase holds, are streamed through it. A hit counts where an earlier document has the phrase.
    """
    w = _block([r[6] for r in rows])
    h = w.hashes()
    size = np.diff(w.bounds)
    place = np.arange(len(h)) + w.row + 1  # a sign of its own stands before each piece
    codes, hashes = np.zeros(len(h) + len(rows) + 1, np.int64), np.zeros(len(h) + len(rows) + 1, _U)
    codes[place], hashes[place] = np.unique(h, return_inverse=True)[1] + 1, h
    of = np.repeat(np.arange(len(rows)), size + 1)
    first = np.cumsum(size + 1) - size
    # windows that stay inside a piece, and their hashes, to find those of several pieces
    at = np.flatnonzero(inside_rows(np.append(first - 1, len(of)), WINDOW, len(of)) & (codes[:len(of) - WINDOW + 1] > 0))
    sums = [grams(mix(hashes[:len(of)] + _U(s)), WINDOW, s)[at] for s in (1, 2)]
    heads = np.array([r[4] for r in rows], np.int64)
    head = heads[of[at]]
    order = np.lexsort((head, sums[0]))
    new = np.ones(len(at), bool)
    new[1:] = sums[0][order[1:]] != sums[0][order[:-1]]
    group = np.cumsum(new) - 1
    least = np.empty(len(at), np.int64)
    least[order] = head[order][np.flatnonzero(new)][group]  # of each window: the smallest head of the pieces that have it
    times = np.bincount(group)
    several = order[np.flatnonzero(new)[times > 1]]
    flagged = np.zeros(len(codes), bool)
    if len(several):
        line = (codes + np.where(codes >= 0xD800, 0x800, 0)).astype("<u4").tobytes().decode("utf-32-le")
        phrases = ahocorasick.Automaton()
        for p, earliest in zip(at[several].tolist(), least[several].tolist()):
            phrases.add_word(line[p:p + WINDOW], earliest)
        phrases.make_automaton()
        hits = np.array([(e - WINDOW + 1, v) for e, v in phrases.iter(line)], np.int64).reshape(-1, 2)
        hits = hits[hits[:, 1] < heads[of[hits[:, 0]]], 0]
        flagged[hits] = True
    spots = np.flatnonzero(flagged)
    new = np.ones(len(spots), bool)
    new[1:] = (np.diff(spots) > 1) | (of[spots[1:]] != of[spots[:-1]])
    starts = np.flatnonzero(new)
    runs: dict[int, list[int]] = {}
    for i, k, n in zip(of[spots[starts]].tolist(), (spots[starts] - first[of[spots[starts]]]).tolist(), np.diff(np.append(starts, len(spots))).tolist()):
        runs.setdefault(i, []).extend((k, n))
    told = [i for i, r in enumerate(rows) if r[5] > 1 or i in runs]
    out = [_rows(FOUND, _FOUND, dict(anchor=[rows[i][0] for i in told], pid=[rows[i][3] for i in told], head=[rows[i][4] for i in told], spans=[runs.get(i, []) for i in told]))]
    lines = []
    groups = {}
    for i, r in enumerate(rows):
        if r[2] > 1:
            groups.setdefault((r[0], r[2]), []).append(i)
    for (anchor, salts), mine in groups.items():
        # of an anchor in several shards: each window with its smallest head here, and the pieces that have it there
        pick = np.flatnonzero(np.isin(of[at], mine) & (head == least))
        table = np.stack([sums[0][pick], sums[1][pick], least[pick].view(_U)], 1)
        order = np.lexsort((table[:, 1], table[:, 0]))
        table, pick = table[order], pick[order]
        owner = np.stack([np.array([rows[i][3] for i in of[at[pick]]], np.int64), at[pick] - first[of[at[pick]]]], 1)
        bits = (salts - 1).bit_length()
        edges = np.searchsorted(table[:, 0], np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits)).tolist()
        for k, (i, j) in enumerate(zip([0, *edges], [*edges, len(table)])):
            lines.append((anchor, k, table[i:j].tobytes(), owner[i:j].ravel().tolist()))
    if lines:
        cols = list(zip(*lines))
        out.append(_rows(FOUND, _FOUND, dict(anchor=cols[0], range=cols[1], digests=cols[2], owners=cols[3])))
    return out


def sharded(kinds: DataFrame, shards: int) -> DataFrame:
    """Pieces dealt by anchor to shards, an automaton for each run of about ``SHARD`` bytes of whole groups."""
    dealt = kinds.repartition(shards, "anchor", "salt").sortWithinPartitions("anchor", "salt", "pid")

    def run(batches):
        rows, held, now = [], 0, None
        for batch in batches:
            for r in zip(*(x.to_pylist() for x in batch.columns)):
                if r[:2] != now and held >= SHARD:
                    yield from _streamed(rows)
                    rows, held = [], 0
                if rows and rows[-1][:4] == r[:4]:  # the same piece from another task
                    rows[-1] = (*r[:4], min(rows[-1][4], r[4]), rows[-1][5] + r[5], r[6])
                    continue
                now = r[:2]
                rows.append(r)
                held += len(r[6])
        if rows:
            yield from _streamed(rows)

    return dealt.mapInArrow(run, FOUND)


def merged(sent: DataFrame) -> DataFrame:
    """``(anchor, pid, head, spans)`` of windows that an earlier document has in another shard of their anchor."""
    def run(group: pa.Table) -> pa.Table:
        anchor = group.column("anchor")[0].as_py()
        table = np.concatenate([np.frombuffer(d, "<u8").reshape(-1, 3) for d in group.column("digests").to_pylist()])
        owner = np.concatenate([np.array(o, np.int64).reshape(-1, 2) for o in group.column("owners").to_pylist()])
        head = table[:, 2].view(np.int64)
        order = np.lexsort((head, table[:, 1], table[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (table[order[1:], :2] != table[order[:-1], :2]).any(1)
        least = head[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        out = {}
        for (pid, k), h in zip(owner[order][head[order] > least].tolist(), head[order][head[order] > least].tolist()):
            out.setdefault((pid, h), []).extend((k, 1))
        return pa.Table.from_arrays([pa.array([anchor] * len(out), pa.int64()), pa.array([p for p, _ in out], pa.int64()), pa.array([h for _, h in out], pa.int64()),
                                     pa.array(list(out.values()), pa.list_(pa.int64()))], ["anchor", "pid", "head", "spans"])

    return sent.groupBy("anchor", "range").applyInArrow(run, "anchor bigint, pid bigint, head bigint, spans array<bigint>")


def removals(texts: DataFrame) -> DataFrame:
    """``(ord, full, n_removed, kept)`` of ``(ord, z, runs)``; texts without a run of their own are left out."""
    def run(batches):
        for batch in batches:
            out = []
            for part, opened in _groups(batch, 1):
                for i, words, gone, full in _gone(part.column(2), opened):
                    out.append((part.column(0)[i].as_py(), full, int(gone.sum()), _digest([x for x, g in zip(words, gone) if not g])))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.binary())], ["ord", "full", "n_removed", "kept"])

    return texts.mapInArrow(run, "ord bigint, full binary, n_removed bigint, kept binary")


def _gone(runs: pa.Array, opened: list[bytes], every: bool = False):
    """``(i, words, removed flags, digest)`` of the texts that have confirmed runs ``(place, size)``, or of every text."""
    w = _block(opened)
    start, row, key, _ = windows(w)
    own = start[_later(key, row)]
    for i, text in enumerate(opened):
        words = text.split()
        full = _digest(words)
        mine = runs[i].values
        place, size = (mine.field(0).to_numpy(), mine.field(1).to_numpy()) if mine is not None else (np.zeros(0, np.int64),) * 2
        tagged = place >> 32 == _tag(full)
        a, b = w.bounds[i], w.bounds[i + 1]
        if tagged.any():
            place, size = place[tagged] & 0xFFFFFFFF, size[tagged]
            starts = np.unique(np.repeat(place, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            found = starts
        elif every:
            found = np.zeros(0, np.int64)
        else:
            continue
        yield i, words, cover(np.concatenate([found, own[(own >= a) & (own < b)] - a]), b - a), full


def located(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For ``(doc_id, text)``: base rows marked ``copy``, compressed texts ``(ord, z)``, and ``(ord, runs)``:
    runs of windows that an earlier document has.

    A piece that an earlier document has as a whole is settled by that; only pieces that their document has
    first are looked at window by window.
    """
    numbered = docs.select(F.coalesce(F.col(docs.columns[0]).cast("bigint"), F.lit(LAST)).alias("ord"), F.col(docs.columns[1]).alias("text"))
    rows = materialize(base(numbered), "passages")
    equal = rows.groupBy("full").agg(F.min("ord").alias("head"), F.count("*").alias("m")).where("m > 1").select("full", "head")
    marked = rows.drop("anchors").join(equal, "full", "left").withColumn(
        "copy", (F.coalesce(F.col("ord") > F.col("head"), F.lit(False))) & (F.col("n_words") >= WINDOW)).drop("head")
    marked = materialize(marked, "copies")
    flat = rows.select("ord", F.explode("anchors").alias("anchor"))
    shared = flat.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1").select("anchor")
    live = marked.where("NOT copy").select("ord").distinct()
    mine = flat.join(shared, "anchor").groupBy("ord").agg(F.collect_set("anchor").alias("shared")).join(live, "ord", "left_semi")
    mine = materialize(mine, "shared")
    texts = packed(numbered).toDF("ord", "z")  # shuffled by ord once: both joins reuse that exchange
    pieces = materialize(candidates(texts.join(mine, "ord").select("ord", "z", "shared")), "pieces")
    kinds = pieces.where("words IS NOT NULL")
    hot = kinds.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > PIECES).select("anchor", F.ceil(F.col("n") / PIECES).alias("n"))
    salts = F.coalesce("n", F.lit(1))
    dealt = kinds.join(hot, "anchor", "left").select("anchor", F.pmod("pid", salts).alias("salt"), salts.alias("salts"), "pid", "head", "m", "words")
    spots = materialize(sharded(dealt, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "phrases")
    told = spots.where("pid IS NOT NULL").select("anchor", "pid", "head", "spans")
    known = told.unionByName(merged(spots.where("range IS NOT NULL").select("anchor", "range", "digests", "owners")))
    hits = pieces.where("ord IS NOT NULL").select("anchor", "pid", "ord", "place", "size").join(known, ["anchor", "pid"])
    # beyond the first document of a piece all of it goes; there, what an earlier one has
    whole = F.array(F.struct("place", "size"))
    some = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2 - 1).cast("int")), lambda i: F.struct(
        (F.col("place") + F.get("spans", 2 * i)).alias("place"), F.get("spans", 2 * i + 1).alias("size")))
    cut = F.when(F.col("ord") > F.col("head"), whole).when(F.size("spans") > 0, some)
    runs = hits.select("ord", F.explode(cut).alias("r")).groupBy("ord").agg(F.collect_list("r").alias("runs"))
    return marked, texts, runs


def dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row of ``(doc_id, text)``."""
    marked, texts, runs = located(docs)
    changed = removals(texts.join(runs, "ord").select("ord", "z", "runs")).distinct().toDF("o", "f", "removed", "sha")
    copy = F.col("copy")
    return marked.join(changed, (F.col("ord") == F.col("o")) & (F.col("full") == F.col("f")), "left").select(
        F.nullif("ord", F.lit(LAST)).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", "n_removed")).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("sha", "kept", "full")))).alias("kept_sha256"))


def strip(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a text that loses nothing stays as it is.

    The words left of a changed text are joined by single blanks.
    """
    marked, _, runs = located(docs.select(key, text))
    copies = marked.where("copy").groupBy("ord").agg(F.collect_set("full").alias("copies"))
    extra = free_name(docs, "ord"), free_name(docs, "runs"), free_name(docs, "copies")
    named = docs.withColumn(extra[0], F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(LAST)))
    joined = named.join(runs.toDF("__o", extra[1]), named[extra[0]] == F.col("__o"), "left").drop("__o")
    joined = joined.join(copies.toDF("__o", extra[2]), joined[extra[0]] == F.col("__o"), "left").drop("__o")
    columns = docs.columns
    at = columns.index(text)

    def run(batches):
        for batch in batches:
            column, runs_, copies_ = batch.column(at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for first, end, raw, bounds in blocks(column):
                data, part = raw.tobytes(), column.slice(first, end - first)
                opened = [data[i:j] for i, j in zip(bounds[:-1], bounds[1:])]
                out = part.to_pylist()
                for i, words, gone, full in _gone(runs_.slice(first, end - first), opened, every=True):
                    known = copies_[first + i].as_py()
                    if known and full in known:
                        out[i] = ""
                    elif gone.any():
                        out[i] = b" ".join(x for x, g in zip(words, gone) if not g).decode()
                piece = [c.slice(first, end - first) for c in batch.columns[:len(columns)]]
                piece[at] = pa.array(out, column.type)
                yield pa.RecordBatch.from_arrays(piece, columns)

    return joined.select(*[f"`{c}`" for c in columns], extra[1], extra[2]).mapInArrow(run, docs.schema)


@query("op5_repeated_passages", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t),
windows AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM
 (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM t WHERE len(ws) >= 20) x) y),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM windows WHERE k > 1)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) g ON g.doc_id = t.doc_id
LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY 1) k ON k.doc_id = t.doc_id""")
def op5_repeated_passages(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
