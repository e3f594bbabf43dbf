"""Quality rules with tokeniser fertility.

One pass measures each whole text: plain rule counts, and how a public vocabulary takes it (characters
per token, share of byte-fallback tokens, entropy of its tokens). Bands per language come from the
counts of all documents; a text outside its language's bands is rejected. The share of byte-fallback
tokens is banded from above only: a script that the vocabulary lacks measures high in all its texts.

Defined results: a null text is an empty one (all counts 0, base rule fails); a null language is the
language "und"; repeated rows are judged alike; an empty table gives an empty result; other columns of
the input, whatever their names, are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.llm.common import free_name, query, table, vocabulary
from panelwright.llm.words import Words, blocks, grams, inside_rows
from panelwright.session import materialize

MIN_WORDS = 10
REPEAT_WINDOW, REPEAT_PERCENT = 5, 20
SYMBOLS = "#*$%&|<>"
BAND_WIDTH = 4.0  # robust standard deviations from the median; the narrowest half step that rejects under 1 % of labelled good texts (README)
LANGUAGES = 100_000  # bands of so many languages at most are broadcast
BAND_MIN_TOKENS = 64  # shorter texts measure too loosely to be banded
FALLBACK_LIMIT = 0.5  # byte-fallback share at which a text too short for the bands fails, unless its language's band reaches higher
STEPS = 400  # histogram bins per unit of a measure
SPREAD_FLOOR = {"chars_per_token": 1, "token_entropy": 1, "fallback_share": 4}  # least spread in bins; a share of 0.01 is off by as much over BAND_MIN_TOKENS tokens

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
_RATES = ("chars_per_token", "fallback_share", "token_entropy")
MEASURES = T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]
                        + [T.StructField(c, T.DoubleType()) for c in _RATES])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_BLANK = " \t\n\x0b\x0c\r"


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(len(model))])


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _rules(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(raw, at)
    rows = len(at) - 1
    wide = (raw & 0xC0) != 0x80  # first bytes of code points
    spaces = (raw == 32) | ((raw >= 9) & (raw <= 13))
    h = w.hashes()
    n = REPEAT_WINDOW
    g = grams(h, n)
    ok = np.flatnonzero(inside_rows(w.bounds, n, len(h)))
    keyed = g[ok] + w.row[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, back, times = np.unique(keyed, return_inverse=True, return_counts=True)
    again = ok[times[back] > 1]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + n, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return {
        "n_words": np.diff(w.bounds),
        "word_chars": _sums(wide & ~spaces, at),
        "n_symbols": _sums(_SYMBOL[raw], at),
        "n_repeat_words": np.bincount(w.row[covered], minlength=rows),
    }


def _fertility(texts: list[str], path: str) -> dict[str, np.ndarray]:
    model, is_byte = _pieces(path)
    ids = model.encode(texts, num_threads=1)
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
    row = np.repeat(np.arange(len(ids)), n)
    key, times = np.unique(row * len(is_byte) + flat, return_counts=True)
    owner = key // len(is_byte)
    share = times / n[owner]
    entropy = np.bincount(owner, -share * np.log2(share), len(ids))
    some = np.maximum(n, 1)
    return {
        "n_tokens": n,
        "chars_per_token": np.fromiter(map(len, texts), np.int64, len(texts)) / some,
        "fallback_share": np.bincount(row, is_byte[flat], len(ids)) / some,
        "token_entropy": entropy / np.log2(np.maximum(n, 2)),
    }


def measure(df: DataFrame, *, text: str = "text", vocab: str | None = None, name: str = "measures",
            carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its ``carry`` columns) with a struct column ``name`` of counts and rates of each text.

    ``token_entropy`` is bits per token over the most that so many tokens could have.
    """
    path = vocab or vocabulary("piece_bpe_32k.model")
    place = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if carry is None or c in carry]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], T.StructField(name, MEASURES)])

    def run(batches):
        for batch in batches:
            column = batch.column(place)
            for first, end, raw, at in blocks(column):
                part = [t or "" for t in column.slice(first, end - first).to_pylist()]
                lines = [[x for x in t.split("\n") if x.strip(_BLANK)] for t in part]
                made = _rules(raw, at) | _fertility(part, path)
                made["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines])
                arrays = [pa.array(made[c], pa.int64()) for c in _COUNTS] + [pa.array(made[c], pa.float64()) for c in _RATES]
                struct = pa.StructArray.from_arrays(arrays, [*_COUNTS, *_RATES])
                piece = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in kept], struct],
                                                 [*[piece.schema.names[i] for i in kept], name])

    return df.mapInArrow(run, schema)


def _median(counts: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Weighted median of binned values; one row per bin and language stands in the window."""
    upto = W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(W.partitionBy(by))})
    return placed.where(F.col("upto") * 2 >= F.col("all")).groupBy(by).agg(F.min(value).alias(out))


def bands(measured: DataFrame, *, language: str, name: str = "measures", width: float = BAND_WIDTH) -> DataFrame:
    """Low and high bound of each rate per language, from histograms over all texts long enough; byte fallback has no low one."""
    long = measured.where(F.col(f"{name}.n_tokens") >= BAND_MIN_TOKENS)
    out = None
    for rate in _RATES:
        counts = long.groupBy(F.coalesce(F.col(language), F.lit("und")).alias("band_lang"),
                              F.round(F.col(f"{name}.{rate}") * STEPS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
        middle = _median(counts, "band_lang", "bin", "mid")
        off = counts.join(middle, "band_lang").groupBy("band_lang", F.abs(F.col("bin") - F.col("mid")).alias("off")).agg(
            F.sum("n").alias("n"))
        spread = _median(off, "band_lang", "off", "mad")
        reach = F.greatest(F.col("mad"), F.lit(SPREAD_FLOOR[rate])) * F.lit(1.4826 * width)
        low = ((F.col("mid") - reach) / STEPS).alias(f"low_{rate}")
        made = middle.join(spread, "band_lang").select(
            "band_lang", *[low] * (rate != "fallback_share"), ((F.col("mid") + reach) / STEPS).alias(f"high_{rate}"))
        out = made if out is None else out.join(made, "band_lang")
    return out


def judge(df: DataFrame, *, text: str = "text", language: str = "lang", vocab: str | None = None,
          name: str = "measures", carry: Sequence[str] | None = None) -> DataFrame:
    """``df`` (or its ``carry`` columns, the language among them) with ``name`` (measures), ``name_base_failed`` and ``name_kept``.

    The measures are written once and read twice, so texts are tokenised once. The band table has one
    row per language; its rows are counted, and up to ``LANGUAGES`` of them are broadcast.
    """
    measured = materialize(measure(df, text=text, vocab=vocab, name=name, carry=carry), "quality")
    limits = bands(measured, language=language, name=name)
    m = F.col(name)
    base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * REPEAT_PERCENT)
    inside = m["fallback_share"] <= F.col("high_fallback_share")
    for rate in ("chars_per_token", "token_entropy"):
        inside &= m[rate].between(F.col(f"low_{rate}"), F.col(f"high_{rate}"))
    short = m["fallback_share"] <= F.greatest(F.lit(FALLBACK_LIMIT), F.col("high_fallback_share"))
    loose = F.when(m["n_tokens"] < BAND_MIN_TOKENS, short).otherwise(inside)  # a longer text's language has bands
    key = free_name(measured, "band_key")
    limits = materialize(limits, "bands")
    if limits.count() <= LANGUAGES:  # texts stay where they are; beyond that Spark chooses the join
        limits = F.broadcast(limits)
    joined = measured.withColumn(key, F.coalesce(F.col(language), F.lit("und"))).join(
        limits, F.col(key) == F.col("band_lang"), "left")
    return joined.select(*[measured[f"`{c}`"] for c in measured.columns], base.alias(f"{name}_base_failed"),
                         (~base & loose).alias(f"{name}_kept"))


def filter_quality(df: DataFrame, *, text: str = "text", language: str = "lang", vocab: str | None = None) -> DataFrame:
    """The rows of ``df`` that the rules keep, all columns as they were."""
    name = free_name(df, "measures")
    return judge(df, text=text, language=language, vocab=vocab, name=name).where(f"{name}_kept").select(
        *[f"`{c}`" for c in df.columns])


@query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=("doc_id", "lang"))
    m = "measures"
    return judged.select(
        "doc_id", *[F.col(f"{m}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col(f"{m}_base_failed").alias("base_failed"), F.col(f"{m}_kept").alias("kept"), f"{m}.n_tokens",
        *[F.col(f"{m}.{c}") for c in _RATES])
