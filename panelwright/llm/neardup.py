"""MinHash near-duplicates with tensored banding.

Two small families of collections, ``A`` and ``B``, of a few minhashes each make ``|A| x |B|`` table keys,
so a table costs about the square root of the minhashes that separate tables would. A pair at the
threshold misses every table with probability ``2 (1 - s^r)^k`` for collections of ``r`` in families of
``k`` (4e-6 at the defaults), and every candidate is confirmed on the full shingle sets.

Four bits of every minhash stay with the document. A pair at the threshold shares about 49 of the 64
nibbles and fewer than 32 with a probability below 1e-6, so pairs that share fewer (texts that have a
common passage, for example) are left out before their sets are read.

Copies with equal sets form one class; only its smallest id goes on. In each table bucket a document is first
checked against one pivot. Buckets that still hold more than one component try the member that shares most
of its shingles. Then the members outside their bucket's largest component meet the rest by prefix: a pair at the
threshold shares one of its rarest shingles. So a bucket of m copies costs about m checks, and no pair of a
bucket that could still join two components is left out.

Defined results: a null or wordless text has an empty set and is linked with nothing; rows with a null
id are kept and have no component; rows that share an id are judged each by its own text; an empty
table gives an empty result; other columns of the input take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwright.llm.common import free_name, query, table
from panelwright.llm.components import components
from panelwright.llm.words import Words, blocks, grams, inside_rows, list_array, mix
from panelwright.session import materialize

SHINGLE = 5
PERCENT = 75  # a link needs 100 * intersection >= PERCENT * union
FAMILY, ROWS = 16, 2  # collections in each family, minhashes in each collection
AGREE = 32  # of the 64 minhashes, how many nibbles a pair shares before its sets are read

_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * FAMILY * ROWS + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row, and their number per row."""
    w = Words(raw, at, lower=True)
    h, rows = w.hashes(), len(at) - 1
    g = grams(h, SHINGLE)
    ok = inside_rows(w.bounds, SHINGLE, len(h))
    values, owner = [g[ok]], [w.row[:len(g)][ok]]
    size = np.diff(w.bounds)
    for n in range(1, SHINGLE):  # a shorter text is one shingle
        short = np.flatnonzero(size == n)
        if len(short):
            values.append(grams(h, n, n)[w.bounds[short]])
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=rows)


def _collections(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all collections, and nibbles of all minhashes, of the rows that have shingles: one line per row."""
    some = counts > 0
    first = (np.cumsum(counts) - counts)[some]
    low = np.stack([np.minimum.reduceat(values * seed, first) for seed in _SEEDS], 1)
    nibbles = (mix(low) >> _U(60)).reshape(len(first), -1, 16) << (_U(4) * np.arange(16, dtype=_U))
    low = low.reshape(len(first), 2 * FAMILY, ROWS)
    key = np.zeros(low.shape[:2], _U)
    for i in range(ROWS):
        key = mix(key + low[:, :, i])
    return mix(key + np.arange(1, 2 * FAMILY + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)), np.bitwise_or.reduce(nibbles, 2)


SIGNS = [f"s{i}" for i in range(2 * FAMILY * ROWS // 16)]
SKETCH = "doc_id bigint, tag bigint, n_shingles bigint, k1 bigint, k2 bigint, a array<bigint>, b array<bigint>, " + ", ".join(
    f"{c} bigint" for c in SIGNS)


def alike(x: str, y: str) -> Column:
    """True for columns ``x0…`` and ``y0…`` that share at least ``AGREE`` nibbles."""
    differ = F.lit(0)
    for i in range(len(SIGNS)):
        bits = F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        bits = bits.bitwiseOR(F.shiftrightunsigned(bits, 2))
        differ = differ + F.bit_count(bits.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= 16 * len(SIGNS) - AGREE


def sketches(docs: DataFrame) -> DataFrame:
    """Set size, set key and collection keys of each ``(doc_id, text, tag)`` row."""
    def run(batches):
        for batch in batches:
            for first, end, raw, at in blocks(batch.column(1)):
                values, counts = shingles(raw, at)
                some, n = counts > 0, end - first
                k1, k2 = np.zeros(n, _U), np.zeros(n, _U)
                a = b = np.zeros((0, FAMILY), _U)
                signs = np.zeros((n, len(SIGNS)), _U)
                if some.any():
                    starts = (np.cumsum(counts) - counts)[some]
                    k1[some] = np.add.reduceat(mix(values), starts)
                    k2[some] = np.add.reduceat(mix(values ^ _U(0x5851F42D4C957F2D)), starts)
                    keys, signs[some] = _collections(values, counts)
                    a, b = keys[:, :FAMILY], keys[:, FAMILY:]
                per = np.where(some, FAMILY, 0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(counts, pa.int64()), pa.array(k1.view(np.int64)),
                    pa.array(k2.view(np.int64)), list_array(a.ravel().view(np.int64), per, pa.int64()),
                    list_array(b.ravel().view(np.int64), per, pa.int64()), *[pa.array(c.view(np.int64)) for c in np.ascontiguousarray(signs.T)],
                ], ["doc_id", "tag", "n_shingles", "k1", "k2", "a", "b", *SIGNS])

    return docs.mapInArrow(run, SKETCH)


def packed(docs: DataFrame) -> DataFrame:
    """``(doc_id, z)``: texts compressed, so that shuffles carry less."""
    def run(batches):
        press = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            made = [press.compress((t or "").encode()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "z"])

    return docs.mapInArrow(run, "doc_id bigint, z binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``(a, b)`` pairs whose full sets reach the threshold."""
    ta = texts.select(F.col("doc_id").alias("a"), F.col("z").alias("za"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("z").alias("zb"))

    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                distinct = {}
                sides = [[distinct.setdefault(z.as_buffer().to_pybytes(), len(distinct)) for z in part.column(i)] for i in (2, 3)]
                values, counts = shingles_of([opener.decompress(z) for z in distinct])
                edge = np.concatenate([[0], np.cumsum(counts)])
                good = []
                for i, j in zip(*sides):
                    x, y = values[edge[i]:edge[i + 1]], values[edge[j]:edge[j + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    # one row per pair and text of each side: ids are unique, or their rows are all compared
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "za", "zb").mapInArrow(run, "a bigint, b bigint").distinct()


def flat_shingles(texts: DataFrame) -> DataFrame:
    """``(doc_id, s)``: one row per document and shingle."""
    def run(batches):
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                values, counts = shingles_of([opener.decompress(z.as_py()) for z in part.column(1)])
                owner = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(values.view(np.int64))], ["doc_id", "s"])

    return materialize(texts.mapInArrow(run, "doc_id bigint, s bigint").distinct(), "shingles")


def shared_sizes(flat: DataFrame) -> DataFrame:
    """``(doc_id, common)``: how many shingles of each document another document has too."""
    common = flat.groupBy("s").agg(F.count("*").alias("m")).where("m > 1").select("s")
    return flat.join(common, "s").groupBy("doc_id").agg(F.count("*").alias("common"))


def prefix_pairs(rows: DataFrame, flat: DataFrame) -> DataFrame:
    """``(a, b)`` that can reach the threshold, an ``odd`` row with a row of another root, of ``(doc_id, n, root, odd)``.

    With shingles from the rarest on, a pair at the threshold has its first common one early on both sides: there
    must be room for the rest of the overlap behind it. An edited copy's rarest shingles are its edits, so it meets
    copies that share an edit, not the whole group.
    """
    mine = flat.join(rows, "doc_id")
    ranks = mine.join(mine.groupBy("s").agg(F.count("*").alias("m")), "s").select(
        "doc_id", "n", "root", "odd", "s", "m", F.row_number().over(W.partitionBy("doc_id").orderBy("m", "s")).alias("i"))
    early = materialize(ranks.where((F.col("m") > 1) & ((F.col("i") - 1) * 100 <= F.col("n") * (100 - PERCENT))), "prefixes")
    left = early.where("odd").select("s", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("i").alias("ia"))
    right = early.select("s", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("i").alias("ib"))
    need = F.ceil(F.lit(PERCENT) * (F.col("na") + F.col("nb")) / F.lit(100.0 + PERCENT))
    room = (F.col("na") - F.col("ia") + 1 >= need) & (F.col("nb") - F.col("ib") + 1 >= need)
    return left.join(right, "s").where(room & (F.col("ra") != F.col("rb"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingles_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return shingles(np.frombuffer(b"".join(texts), np.uint8), at)


def _buckets(reps: DataFrame) -> DataFrame:
    """``(key, doc_id, n)`` rows of the tables' buckets that hold two documents or more.

    A collection that no other document shares can give no shared table key, so it is left out before
    the families are combined: most documents stop here.
    """
    flat = reps.select("doc_id", "n_shingles", F.explode(F.concat(
        F.transform("a", lambda k: F.struct(F.lit(True).alias("left"), k.alias("k"))),
        F.transform("b", lambda k: F.struct(F.lit(False).alias("left"), k.alias("k"))))).alias("c")).select(
        "doc_id", "n_shingles", "c.left", "c.k")
    shared = flat.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    mine = flat.join(shared, "k").groupBy("doc_id", "n_shingles").agg(
        F.collect_list(F.when(F.col("left"), F.col("k"))).alias("a"), F.collect_list(F.when(~F.col("left"), F.col("k"))).alias("b"))
    keys = materialize(mine.select("doc_id", "n_shingles", F.explode("a").alias("ka"), "b").select(
        "doc_id", "n_shingles", "ka", F.explode("b").alias("kb")).select(
        F.xxhash64("ka", "kb").alias("key"), "doc_id", F.col("n_shingles").alias("n")), "tables")
    full = keys.groupBy("key").agg(F.count("*").alias("m"), F.min("doc_id").alias("pivot")).where("m > 1")
    return materialize(keys.join(full.select("key", "pivot"), "key"), "buckets")


def classes(docs: DataFrame) -> DataFrame:
    """``(doc_id, tag, n_shingles, component_id)`` for every row of ``(doc_id, text)``; ``tag`` is a hash of the text."""
    docs = docs.select(F.col(docs.columns[0]).cast("bigint").alias("doc_id"), F.col(docs.columns[1]).alias("text"))
    docs = docs.withColumn("tag", text_tag(F.col("text")))
    sketch = materialize(sketches(docs), "sketches")
    sets = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    equal = sets.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").select(
        "k1", "k2", "n_shingles", "rep")
    ranked = sketch.join(equal, ["k1", "k2", "n_shingles"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    reps = ranked.where("n_shingles > 0 AND doc_id = rep").select("doc_id", "n_shingles", "a", "b", *SIGNS)
    buckets = _buckets(reps)
    ids = buckets.select("doc_id").distinct()
    texts = materialize(packed(docs).join(ids, "doc_id", "left_semi"), "texts")

    # first: each document with the pivot it shares most buckets with
    best = buckets.where("doc_id <> pivot").groupBy("doc_id", "pivot", "n").agg(F.count("*").alias("m")).groupBy("doc_id").agg(
        F.max("m").alias("m"), F.max_by("pivot", F.struct(F.col("m"), -F.col("pivot"))).alias("pivot"))
    signs = materialize(reps.select("doc_id", *SIGNS).join(ids, "doc_id", "left_semi"), "signs")

    def signed(side: str) -> DataFrame:
        return signs.toDF(side, *[f"{side}{i}" for i in range(len(SIGNS))])

    near = best.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")).join(signed("a"), "a").join(signed("b"), "b").where(alike("a", "b"))
    first = materialize(confirmed(near.select("a", "b"), texts), "links")
    labels = components(first)

    def mixed(labels: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with their root and the bucket's largest one."""
        placed = rows.join(labels, rows["doc_id"] == labels["node"], "left").select(rows["*"], F.coalesce("root", "doc_id").alias("root"))
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
        several = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("m", "root")).alias("main")).where("parts > 1")
        return placed.join(several.select("key", "main"), "key")

    def side(rows: DataFrame, x: str) -> DataFrame:
        named = [F.col(c).alias(f"{x}{i}") for i, c in enumerate(SIGNS)]
        return rows.select("key", F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("root").alias(f"r{x}"),
                           F.col("common").alias(f"c{x}"), *named)

    most = F.least("ca", "cb")
    fits = (most * 100 >= (F.col("na") + F.col("nb") - most) * PERCENT) & (F.col("ra") != F.col("rb")) & alike("a", "b")

    # then: with the bucket's member that shares most of its shingles, the likeliest original
    unsettled = materialize(mixed(labels, buckets.select("key", "doc_id", "n")), "unsettled")
    flat = flat_shingles(texts.join(unsettled.select("doc_id").distinct(), "doc_id", "left_semi"))
    common = materialize(shared_sizes(flat), "common")
    able = unsettled.join(common, "doc_id").where(F.col("common") * 100 >= F.col("n") * PERCENT)
    able = materialize(able.join(signs, "doc_id"), "able")
    middle = able.groupBy("key").agg(F.max_by("doc_id", F.struct(F.col("common") / F.col("n"), -F.col("doc_id"))).alias("b"))
    tried = able.join(middle, "key").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("m")).groupBy("a").agg(
        F.max_by("b", F.struct("m", "b")).alias("b"))
    one = able.dropDuplicates(["doc_id"])  # every column but key and main belongs to the document
    again = tried.join(side(one, "a").drop("key"), "a").join(side(one, "b").drop("key"), "b").where(fits).select("a", "b")
    first = materialize(first.unionByName(confirmed(again, texts)), "links")
    labels = components(first)

    # last: whatever could still join two components
    open_rows = materialize(mixed(labels, able.drop("root", "main")), "open")
    one = open_rows.groupBy("doc_id", "n", "root").agg(F.max(F.col("root") != F.col("main")).alias("odd"))
    rest = prefix_pairs(one, flat)
    second = confirmed(rest, texts)
    node = labels.select(F.col("node"), F.col("root"))
    joins = second.join(node.toDF("a", "ra"), "a", "left").join(node.toDF("b", "rb"), "b", "left").select(
        F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    higher = components(joins)
    final = labels.join(higher.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(
        higher.join(labels, higher["node"] == labels["node"], "left_anti").select("node", "root"))
    return ranked.join(final, ranked["rep"] == final["node"], "left").select(
        "doc_id", "tag", "n_shingles", F.coalesce("root", "rep").alias("component_id"))


def _judged(docs: DataFrame) -> DataFrame:
    """:func:`classes` with ``kept``."""
    return classes(docs).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def mark(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row; ``kept`` is true for the one document that stays of each component."""
    return _judged(docs).drop("tag")


def text_tag(text: Column) -> Column:
    """64-bit hash that tells texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_near_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose document stays. A document is an id with a text: rows of one id and different texts
    are judged apart, and of rows with the same id and text one stays. Rows without an id stay."""
    marked = materialize(_judged(docs.select(key, text)), "marked")
    tag = free_name(docs, "tag")
    tagged = docs.withColumn(tag, text_tag(F.col(f"`{text}`")))

    def listed(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct()

    same = (F.col(f"`{key}`") == F.col("__id")) & (F.col(f"`{tag}`") == F.col("__tag"))
    left = tagged.join(listed(marked.where("NOT kept")), same, "left_anti")
    twice = marked.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", "tag").agg(F.count("*").alias("m")).where("m > 1")
    if twice.limit(1).count():  # only the repeated rows are sorted out
        again = materialize(listed(twice), "twice")
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([key, tag]))
    return left.drop(tag)


@query("op2_minhash_tensored", r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM t WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2) p
 JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
root AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, t.doc_id) AS component_id, coalesce(root, t.doc_id) = t.doc_id AS kept FROM t LEFT JOIN n USING (doc_id) LEFT JOIN root ON a = t.doc_id""")
def op2_minhash_tensored(spark, sf_dir):
    return mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
