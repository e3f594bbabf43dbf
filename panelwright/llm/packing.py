"""Best-fit packing after dominance reduction.

Documents become token ids and an end id; only those longer than a sequence are cut. What packing needs
of all pieces is how many have each length: at most ``capacity`` counts, whatever the corpus. On those
counts whole classes are fixed at once where Martello and Toth's criterion proves a set of pieces at
least as good as any other for its largest piece, until nothing more is proved; best-fit decreasing
packs the rest, again class by class. Every piece then looks up its place by its rank among the pieces
of its length. Ranks are counted in hash buckets, so a length that most pieces share is many tasks' work.

Defined results: a null or empty text is its end id alone; a null id is carried along; rows that share
an id are packed each; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import query, table, vocabulary
from panelwright.session import materialize

CAPACITY, END_ID = 1024, 2
ADDED = {"<|endoftext|>": 50256}  # the vocabulary's added token, which its rank file lacks
BUCKET = 20_000  # pieces of a length that one task ranks, about


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The byte-level vocabulary as ranks: the same ids as its ``tokenizers`` file, in a quarter of the time."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


_BLANKS = re.compile(r"\s{50000}")


@lru_cache(maxsize=1)
def _plain_encoder(path: str):
    """The vocabulary's own ``tokenizers`` file."""
    import tokenizers

    return tokenizers.Tokenizer.from_file(path)


def _ids(text: str, path: str, plain: str) -> np.ndarray:
    """Ids of a text. Blanks in long runs exceed the rank encoder's stack; such texts go to the slower one, which gives the same ids."""
    if len(text) >= 50000 and _BLANKS.search(text):
        return np.array(_plain_encoder(plain).encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoder(path).encode_to_numpy(text, allowed_special="all")


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None,
           with_ids: bool = False) -> DataFrame:
    """One row per piece of ``(doc_id, text)``: place, length, checksum, and the ids if asked for.

    A longer document is cut so that all pieces but the first are full.
    """
    path = vocab or vocabulary("byte_bpe_50k.tiktoken")
    plain = vocabulary("byte_bpe_50k.json") if vocab is None else vocab.removesuffix(".tiktoken") + ".json"
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                owner, made = [], [[] for _ in names[1:]]
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(_ids(text or "", path, plain), end_id).astype("<u4")
                    start, stop = 0, len(ids) % capacity or min(len(ids), capacity)
                    while start < len(ids):
                        cut = ids[start:stop]
                        row = [start and -(-start // capacity), start, len(cut), zlib.crc32(cut.tobytes()), cut.view(np.int32)]
                        for column, value in zip(made, row):
                            column.append(value)
                        owner.append(i)
                        start, stop = stop, stop + capacity
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())),
                                                  *[pa.array(c, k) for c, k in zip(made, kinds)]], names)

    kind = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.mapInArrow(run, kind)


def reduce_classes(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Take dominating sets out of ``counts``: ``(times, [(length, pieces)])``, ``counts`` keeps the rest.

    For the largest piece j of a set: j alone, if nothing fits beside it; j and its exact complement; j
    and the largest piece p that fits, if no two others fit, or if at most two fit and p is as long as any
    two that do. Taking pieces away keeps each condition true, so a class is fixed in one step.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        sizes = sorted(s for s, n in counts.items() if n)
        for j in reversed(sizes):
            while counts.get(j):
                live = [s for s in sizes if counts[s] - (s == j)]
                room = capacity - j
                if not live or live[0] > room:
                    fixed.append((counts[j], [(j, 1)]))
                    counts[j] = 0
                    changed = True
                    break
                p = live[bisect_right(live, room) - 1]
                small = []  # the three smallest pieces besides one j
                for s in live:
                    small += [s] * min(3, counts[s] - (s == j))
                    if len(small) >= 3:
                        break
                one = len(small) < 2 or sum(small[:2]) > room
                two = len(small) < 3 or sum(small[:3]) > room
                if not (p == room or one or (two and p >= _best_pair(live, counts, j, room))):
                    break
                times = counts[j] // 2 if p == j else min(counts[j], counts[p])
                fixed.append((times, [(j, 2)] if p == j else [(j, 1), (p, 1)]))
                counts[j] -= times * (2 if p == j else 1)
                if p != j:
                    counts[p] -= times
                changed = True
    return fixed


def _best_pair(live: list[int], counts: dict[int, int], j: int, room: int) -> int:
    """Longest sum of two pieces that fits in ``room``."""
    best, low, high = 0, 0, len(live) - 1
    while low <= high:
        if live[low] + live[high] > room or (low == high and counts[live[low]] - (live[low] == j) < 2):
            high -= 1
        else:
            best = max(best, live[low] + live[high])
            low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing of whole classes: ``(times, [(length, pieces), …])`` for equal sequences."""
    open_: dict[int, list[tuple[int, list]]] = {}
    rooms: list[int] = []
    full = []

    def keep(times: int, pattern: list, room: int) -> None:
        if not times:
            return
        if not room:
            full.append((times, pattern))
        elif room in open_:
            open_[room].append((times, pattern))
        else:
            open_[room] = [(times, pattern)]
            insort(rooms, room)

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                times, pattern, room = -(-n // (capacity // size)), [], capacity
            else:
                room = rooms[at]
                times, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            each = room // size
            filled = min(times, n // each)
            keep(filled, [*pattern, (size, each)], room - each * size)
            n -= filled * each
            spare = times - filled
            if spare and n and n < each:
                keep(1, [*pattern, (size, n)], room - n * size)
                spare, n = spare - 1, 0
            if pattern:
                keep(spare, pattern, room)
    return full + [group for groups in open_.values() for group in groups]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows ``(first rank, pieces a sequence, first sequence, offset)`` by first rank."""
    left = dict(counts)
    groups = reduce_classes(left, capacity) + best_fit(left, capacity)
    places: dict[int, list] = {}
    given = dict.fromkeys(counts, 0)
    sequence = 0
    for times, pattern in groups:
        offset = 0
        for size, each in pattern:
            places.setdefault(size, []).append((given[size], each, sequence, offset))
            given[size] += times * each
            offset += size * each
        sequence += times
    assert given == dict(counts)
    return {size: np.array(rows, np.int64) for size, rows in places.items()}


def ranked(made: DataFrame, total: int) -> DataFrame:
    """``made`` with ``rank``: from 0 among the pieces of its length."""
    buckets = max(1, -(-total // BUCKET))
    spread = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = spread.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    return spread.withColumn("place", F.row_number().over(place)).join(offsets, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("place") - 1).drop("bucket", "place", "before")


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, vocab: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """The pieces of ``(doc_id, text)`` with ``sequence_id`` and ``offset``."""
    made = materialize(pieces(docs, capacity=capacity, end_id=end_id, vocab=vocab, with_ids=with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    places = plan(counts, capacity)

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            out = np.zeros((2, len(length)), np.int64)
            for size in np.unique(length):
                mine = length == size
                rows = places[size]
                hit = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                along = rank[mine] - hit[:, 0]
                out[0, mine] = hit[:, 2] + along // hit[:, 1]
                out[1, mine] = hit[:, 3] + along % hit[:, 1] * size
            keep = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(out[0]), pa.array(out[1])],
                                             [*keep, "sequence_id", "offset"])

    columns = [c for c in made.columns]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema.fields) + ", sequence_id bigint, offset bigint"
    return ranked(made, sum(counts.values())).select(*columns, "rank").mapInArrow(run, kind)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
