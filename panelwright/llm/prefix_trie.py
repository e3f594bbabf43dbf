"""Prefix trie of rebuilt conversations, as Z-fast tries merged by node fingerprint.

A turn at depth d adds two 64-bit hashes of (d, role, text) to the fingerprint of its conversation's prefix, so a
node of the trie is named by depth and fingerprint wherever it is met, and sums over parts of a conversation can be
shifted. Equal conversations become one class with a count. Classes are cut into chunks of ``CHUNK`` turns, and each
task inserts its chunks, an Arrow batch at a time, into a Z-fast trie: compacted nodes are hashed at the two-fattest
depth of their edge, a fat binary search over the depths of a chunk finds the exit node in a logarithmic number of
lookups, and the edge is split there. A trie that holds ``HELD`` turns hands over its nodes and starts anew. Handed over
edges are expanded into one row per depth, which a shuffle by node merges; no task needs all of a subtree.

Sums over subtrees are sums over the classes that pass a node. A class owns the nodes it is the smallest
conversation of, and these are the depths beyond one, where it leaves the trie of smaller conversations; the first
pass finds that depth. In the second pass a class adds to each node on its way: its count, a child where it owns
the next node, a leaf where it ends in one, and the bytes below that it shares. Conversations of one
class are listed by streams of sorted ids, each range packed into few rows first.

Turns are ordered by cut ranges (``operators.order``), so a conversation that holds a third of all turns is spread; heads
that other conversations take over are at most eight turns each.

Defined results: a null conversation id takes no part; a null turn comes first, and of equal turns the order is that
of a digest of role and text; null role or text is empty; wholly equal rows are turns each; an empty table gives an
empty result; other columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.llm.words import mix
from panelwright.operators.order import value_counts
from panelwright.session import materialize

CHUNK = 1024  # turns of a conversation that one row holds
HELD = 1 << 20  # expanded nodes after which a trie is handed over
PIECE = 1 << 20  # characters of packed ids
HEADS = 8  # the most turns taken over
EMPTY = hashlib.sha256(b"").hexdigest()
_U = np.uint64


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(c, depth, dig, bytes)``: turns of the rebuilt conversations, and for each conversation a row of depth 0."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("c"), F.struct(
            F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
            digest.alias("dig"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    turns = materialize(turns, "turns")
    heads = turns.withColumn("j", F.row_number().over(W.partitionBy("c").orderBy("t"))).where(F.col("j") <= HEADS)
    heads = materialize(heads.select(F.col("c").alias("base"), "j", "t"), "heads")  # at most eight rows each
    ids = turns.groupBy("c").agg(F.lit(0).alias("depth")).select("c", (F.col("c") - F.col("c") % 5).alias("base"))
    own = F.col("c") == F.col("base")
    ids = ids.withColumn("h", F.when(own, F.lit(0)).otherwise(F.crc32(F.col("c").cast("string")) % 9))
    sizes = heads.groupBy("base").agg(F.count("*").alias("m"))
    ids = materialize(ids.join(sizes, "base", "left").select("c", "base", "h", F.least("h", F.coalesce("m", F.lit(0))).alias("taken")), "conversations")
    taken = heads.join(ids, "base").where(F.col("j") <= F.col("h")).select("c", F.col("j").cast("bigint").alias("depth"), "t.dig", "t.bytes")
    placed = value_counts(turns, "t", ["c"])  # equal turns of one conversation are one row with a count
    mine = placed.withColumn("at", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n")))).join(ids.select("c", "h", "taken"), "c")
    mine = mine.where(F.col("at") > F.col("h")).select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "t.dig", "t.bytes")
    start = ids.select("c", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("dig"), F.lit(0).cast("bigint").alias("bytes"))
    return start.unionByName(taken).unionByName(mine)


CHUNKS = "c bigint, k bigint, a array<bigint>, b array<bigint>, bytes array<bigint>"


def chunks(rows: DataFrame) -> DataFrame:
    """Runs of ``CHUNK`` depths of a conversation, with running sums of fingerprints and bytes from the start of the run."""
    k = F.floor(F.col("depth") / CHUNK).alias("k")
    runs = rows.groupBy("c", k).agg(F.sort_array(F.collect_list(F.struct("depth", "dig", "bytes"))).alias("items"))

    def run(batches):
        for batch in batches:
            items = batch.column(2)
            flat = items.flatten()
            size = np.diff(items.offsets.to_numpy())
            depth, length = flat.field(0).to_numpy(), flat.field(2).to_numpy()
            dig = np.frombuffer(b"".join(d or bytes(16) for d in flat.field(1).to_pylist()), _U).reshape(-1, 2)
            at = mix(depth.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(1))
            out = []
            for i in range(2):
                one = mix(dig[:, i] + mix(at + _U(i)))
                one[depth == 0] = 0
                out.append(one)
            sums = []
            first = np.cumsum(size) - size
            for x in (*out, length.astype(_U)):
                total = np.concatenate([np.zeros(1, _U), np.cumsum(x, dtype=_U)])
                sums.append((total[1:] - np.repeat(total[first], size)).view(np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(s)) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["c", "k", "a", "b", "bytes"])

    return runs.mapInArrow(run, CHUNKS)


def _wrapped(x: int) -> int:
    """As a signed 64-bit number."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def running(made: DataFrame) -> DataFrame:
    """``(c, k, a0, b0, bytes0, len, a, b, bytes)``: what stands before each chunk, and up to its end."""
    last = made.select("c", "k", F.size("a").alias("n"), *[F.element_at(x, -1).alias(x) for x in ("a", "b", "bytes")])
    ordered = last.repartition("c").sortWithinPartitions("c", "k")  # one row per CHUNK turns
    kind = "c bigint, k bigint, a0 bigint, b0 bigint, bytes0 bigint, len bigint, a bigint, b bigint, bytes bigint"

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for c, k, n, *add in zip(*(x.to_pylist() for x in batch.columns)):
                if c != now:
                    now, state = c, (0, 0, 0)
                after = (_wrapped(state[0] + add[0]), _wrapped(state[1] + add[1]), state[2] + add[2])
                out.append((c, k, *state, k * CHUNK + n - 1, *after))
                state = after
            cols = list(zip(*out)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["c", "k", "a0", "b0", "bytes0", "len", "a", "b", "bytes"])

    return ordered.mapInArrow(run, kind)


def fattest(a: int, b: int) -> int:
    """The number in (a, b] with the most trailing zero bits."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class ZFastTrie:
    """Compacted trie over fingerprints of prefixes. Positions are depths plus one, so that the root of the
    first chunk stands at 0; ``a`` and ``b`` hold the fingerprints of expanded nodes, numbered along each edge."""

    def __init__(self):
        self.handles, self.children, self.roots = {}, {}, {}
        self.low, self.high, self.first, self.parent = [], [], [], []
        self.at, self.a, self.b = [], [], []

    def _node(self, low: int, high: int, first: int, parent: int) -> int:
        self.low.append(low), self.high.append(high), self.first.append(first), self.parent.append(parent)
        return len(self.low) - 1

    def _name(self, node: int, at: int) -> tuple[int, int, int]:
        i = self.first[node] + at - self.low[node] - 1
        return at, self.a[i], self.b[i]

    def _hang(self, node: int) -> None:
        """Enter a node under its handle and its parent's branch."""
        self.handles[self._name(node, fattest(self.low[node], self.high[node]))] = node
        self.children[self._name(node, self.low[node] + 1)] = node

    def insert(self, start: int, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Insert a path whose fingerprint at position ``start + i`` is ``(a[i], b[i])``, from its root at i = 0 on.
        Returns runs of expanded nodes ``(first number, how many)`` from the deepest edge up."""
        end = start + len(a) - 1
        name = (start, a[0], b[0])
        node = self.roots.get(name)
        if node is None:
            node = self.roots[name] = self._node(start, start, len(self.at), -1)
        low, top = start, end
        while low < top:  # fat binary search for the deepest node that the path reaches
            f = fattest(low, top)
            hit = self.handles.get((f, a[f - start], b[f - start]))
            if hit is None:
                top = f - 1
                continue
            high = self.high[hit]
            if high > end or self._name(hit, high) != (high, a[high - start], b[high - start]):
                break  # it leaves, or ends, inside this edge
            node, low = hit, high
        out = []
        while low < end:
            child = self.children.get((low + 1, a[low + 1 - start], b[low + 1 - start]))
            if child is None:
                new = self._node(low, end, len(self.at), node)
                self._grow(start, low, end, a, b)
                self._hang(new)
                node, low = new, end
                break
            reach, over = low + 1, min(self.high[child], end) + 1
            while over - reach > 1:  # prefixes are equal up to one depth and differ from there on
                mid = (reach + over) // 2
                if self._name(child, mid) == (mid, a[mid - start], b[mid - start]):
                    reach = mid
                else:
                    over = mid
            if reach == self.high[child]:
                node, low = child, reach
                continue
            if reach == end:
                out.append((self.first[child], end - self.low[child]))
                node, low = self.parent[child], end
                break
            node, low = self._split(child, reach), reach
        while node >= 0:
            out.append((self.first[node], self.high[node] - self.low[node]))
            node = self.parent[node]
        return out

    def _grow(self, start: int, low: int, end: int, a: list[int], b: list[int]) -> None:
        self.at.extend(range(low + 1, end + 1))
        self.a.extend(a[low + 1 - start:end + 1 - start])
        self.b.extend(b[low + 1 - start:end + 1 - start])

    def _split(self, node: int, at: int) -> int:
        """Cut an edge; the new upper node is returned."""
        del self.handles[self._name(node, fattest(self.low[node], self.high[node]))]
        upper = self._node(self.low[node], at, self.first[node], self.parent[node])
        self.first[node] += at - self.low[node]
        self.low[node], self.parent[node] = at, upper
        self._hang(upper)
        self._hang(node)
        return upper


def _paths(trie: ZFastTrie, start, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Insert a batch of chunks; expanded node numbers of each in order of depth, and how many each has."""
    numbers, sizes = [], []
    for s, x, y in zip(start, a, b):
        runs = trie.insert(s, x, y)
        numbers += [np.arange(f, f + n) for f, n in reversed(runs) if n]
        sizes.append(sum(n for _, n in runs))
    return (np.concatenate(numbers) if numbers else np.zeros(0, np.int64)), np.array(sizes, np.int64)


class _Column:
    """Values of expanded nodes, folded by an operation that numpy applies in place."""

    def __init__(self, fold=None, zero: int = 0):
        self.fold, self.zero, self.values = fold, zero, np.zeros(0, np.int64)

    def put(self, at: np.ndarray, values: np.ndarray, size: int) -> None:
        if len(self.values) < size:
            self.values = np.concatenate([self.values, np.full(max(size, 2 * len(self.values)) - len(self.values), self.zero, np.int64)])
        if self.fold is None:
            self.values[at] = values
        else:
            self.fold.at(self.values, at, values)


LAST = np.iinfo(np.int64).max


def tries(rows: DataFrame, columns, contributions) -> DataFrame:
    """Nodes of the tries of each task: ``depth, a, b`` and what ``contributions`` folds into ``columns``.

    ``rows`` begin with ``k, a0, b0, bytes0, a, b, bytes``; ``contributions(depth, running bytes, bytes before,
    fingerprints before, rest of the row)`` gives the values of one batch, a row's own values repeated for its depths.
    """
    names = [n for n, _, _ in columns]

    def run(batches):
        trie, held = None, {}

        def handed_over():
            size = len(trie.at)
            cols = [pa.array(np.array(trie.at, np.int64) - 1), pa.array(trie.a, pa.int64()), pa.array(trie.b, pa.int64())]
            for first in range(0, size, 65536):
                yield pa.RecordBatch.from_arrays([x.slice(first, 65536) for x in cols] + [pa.array(held[n].values[first:min(first + 65536, size)]) for n in names],
                                                 ["depth", "a", "b", *names])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if trie is None:
                    trie, held = ZFastTrie(), {n: _Column(f, z) for n, f, z in columns}
                k, a0, b0, bytes0 = (part.column(i).to_numpy() for i in range(4))
                lists = [part.column(i) for i in (4, 5, 6)]
                size = np.diff(lists[0].offsets.to_numpy())
                flat = [x.flatten().to_numpy().view(_U) + np.repeat(s.view(_U), size) for x, s in zip(lists, (a0, b0, bytes0))]
                edge = np.concatenate([[0], np.cumsum(size)])
                a, b = ([[int(s), *x[i:j].tolist()] for s, i, j in zip(s0, edge, edge[1:])] for s0, x in ((a0, flat[0].view(np.int64)), (b0, flat[1].view(np.int64))))
                numbers, counts = _paths(trie, (k * CHUNK).tolist(), a, b)
                assert (counts == size).all()
                before = []
                for x, s in zip(flat, (a0, b0, bytes0)):  # the value one depth earlier
                    y = np.roll(x.view(np.int64), 1)
                    y[edge[:-1]] = s
                    before.append(y)
                depth = np.arange(len(numbers)) - np.repeat(edge[:-1], size) + np.repeat(k * CHUNK, size)
                rest = {n: np.repeat(part.column(n).to_numpy(zero_copy_only=False), size) for n in batch.schema.names[7:]}
                for n, values in contributions(depth, flat[2].view(np.int64), before[2], before[0], before[1], rest).items():
                    held[n].put(numbers, values, len(trie.at))
                if len(trie.at) >= HELD:
                    yield from handed_over()
                    trie = None
        if trie is not None:
            yield from handed_over()

    kind = "depth bigint, a bigint, b bigint" + "".join(f", {n} bigint" for n in names)
    return rows.mapInArrow(run, kind)


def _first_pass(depth, total, before, a, b, rest):
    return {"owner": rest["rep"], "n": rest["cnt"], "pa": a, "pb": b, "total": total}


def _second_pass(depth, total, before, a, b, rest):
    rep, cnt, end, below, out = (rest[n] for n in ("rep", "cnt", "len", "below", "out"))
    mine = depth > out
    return {
        "conv_id": np.where(mine, rep, -LAST), "parent": np.where(mine, np.where(depth - 1 > out, rep, rest["onto"]), -LAST),
        "n_convs": cnt, "n_children": ((depth >= out) & (depth < end)).astype(np.int64), "n_leaves": rest["leaf"],
        "saved": cnt * (below - before) - (below - np.maximum(before, rest["shared"])),
    }


def ends(ids: DataFrame) -> DataFrame:
    """``(depth, a, b, ends_sha256)``: digest of the sorted decimal ids of the conversations that end in each node."""
    key = ["len", "a", "b"]
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ids.select(*key, "c").repartitionByRange(ranges, *key, "c").sortWithinPartitions(*key, "c")

    def packed(batches):
        for batch in batches:
            cols = [x.to_numpy() for x in batch.columns]
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            first = np.flatnonzero(new)
            texts = [",".join(map(str, cols[3][i:j].tolist())) for i, j in zip(first, [*first[1:], batch.num_rows])]
            yield pa.RecordBatch.from_arrays([*[pa.array(x[first]) for x in cols], pa.array(texts)], [*key, "c", "ids"])

    def hashed(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for *name, _, ids_ in zip(*(x.to_pylist() for x in batch.columns)):
                if name != now:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = name, hashlib.sha256(ids_.encode())
                else:
                    state.update(b"," + ids_.encode())
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols[:3]], pa.array(cols[3], pa.string())], ["depth", "a", "b", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in now], pa.array([state.hexdigest()])], ["depth", "a", "b", "ends_sha256"])

    runs = ordered.mapInArrow(packed, "len bigint, a bigint, b bigint, c bigint, ids string")  # a batch's ids of one node are one row
    return runs.repartition(*key).sortWithinPartitions(*key, "c").mapInArrow(hashed, "depth bigint, a bigint, b bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations of ``(conv_id, turn, role, text)``."""
    made = materialize(chunks(rebuilt(conversations)), "chunks")
    sums = materialize(running(made), "sums")
    whole = materialize(sums.groupBy("c").agg(F.max_by(F.struct("len", "a", "b", "bytes"), "k").alias("w")).select("c", "w.*"), "whole")
    classes = whole.groupBy("len", "a", "b").agg(F.min("c").alias("rep"), F.count("*").alias("cnt"), F.first("bytes").alias("below"))
    classes = materialize(classes, "classes")
    before = ["a0", "b0", "bytes0"]
    zero = made.where("k = 0").select("c", "k", *[F.lit(0).cast("bigint").alias(n) for n in before], "a", "b", "bytes")
    later = made.where("k > 0").join(sums.select("c", "k", *before), ["c", "k"]).select("c", "k", *before, "a", "b", "bytes")
    paths = zero.unionByName(later)
    inputs = ["k", *before, "a", "b", "bytes"]

    one = classes.select(F.col("rep").alias("c"), "rep", "cnt")
    nodes = tries(paths.join(one, "c").select(*inputs, "rep", "cnt"),
                  [("owner", np.minimum, LAST), ("n", np.add, 0), ("pa", None, 0), ("pb", None, 0), ("total", None, 0)], _first_pass)
    nodes = materialize(nodes.groupBy("depth", "a", "b").agg(F.min("owner").alias("owner"), F.sum("n").alias("n"), F.first("pa").alias("pa"),
                                                             F.first("pb").alias("pb"), F.first("total").alias("total")), "nodes")
    entered = nodes.groupBy("owner").agg(F.min_by(F.struct("depth", "pa", "pb"), "depth").alias("e")).select(
        F.col("owner").alias("rep"), (F.col("e.depth") - 1).alias("out"), F.col("e.pa").alias("xa"), F.col("e.pb").alias("xb"))
    onto = nodes.select(F.col("depth").alias("out"), F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("owner").alias("onto"), F.col("total").alias("shared"))
    left = entered.join(onto, ["out", "xa", "xb"], "left").select("rep", "out", "onto", F.coalesce("shared", F.lit(0)).alias("shared"))
    full = classes.join(nodes.select(F.col("depth").alias("len"), "a", "b", "n"), ["len", "a", "b"]).select(
        "rep", "cnt", "len", "below", (F.col("n") == F.col("cnt")).cast("bigint").alias("leaf"))
    facts = full.join(left, "rep", "left").select(
        F.col("rep").alias("c"), "rep", "cnt", "len", "below", "leaf", F.coalesce("out", "len").alias("out"),
        F.coalesce("onto", F.lit(-LAST)).alias("onto"), F.coalesce("shared", "below").alias("shared"))
    facts = materialize(facts, "facts")
    found = tries(paths.join(facts, "c").select(*inputs, "rep", "cnt", "len", "below", "leaf", "out", "onto", "shared"),
                  [("conv_id", np.maximum, -LAST), ("parent", np.maximum, -LAST), *[(n, np.add, 0) for n in ("n_convs", "n_children", "n_leaves", "saved")]], _second_pass)
    merged = found.groupBy("depth", "a", "b").agg(
        F.max("conv_id").alias("conv_id"), F.nullif(F.max("parent"), F.lit(-LAST)).alias("parent_conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    return merged.join(ends(whole), ["depth", "a", "b"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


@query("op11_conversation_trie")
def op11_conversation_trie(spark, sf_dir):
    found = trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
