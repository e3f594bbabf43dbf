"""SentencePiece encoding and decoding over a trie of marked words.

Blanks become marks, and since no piece of the vocabulary has a mark after another character, a text falls
into marked words that are encoded one by one. The distinct words of a block are sorted, which lays their
trie out depth first: a word keeps the forward states of the prefix it has in common with the word before
and adds states for its other characters only.

A forward state is the best way to the prefix's end: its last piece, and where that piece starts. For a
vocabulary of merges (BPE) exactly one segmentation of a prefix survives, namely the one whose neighbouring
pieces are each what the merges make of the two together; so a piece may end a prefix only if it follows the
prefix's state as the merges would have it. For a unigram vocabulary the state is the highest sum of scores.
Characters that no piece covers are written as bytes.

Defined results: a null or empty text has no tokens; null and repeated ids are carried along; an
empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import heapq
import zlib
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from panelwright.llm.common import query, table, vocabulary

MARK = "▁"
BLOCK_CHARS = 4_000_000
CACHE_WORDS = 200_000  # encoded words of the younger half of a worker's cache; then it becomes the older half, whose words stay if they are met again
_CACHE: dict[tuple[str, bool], list[dict[str, tuple[int, ...]]]] = {}
_WORD = regex.compile(f"{MARK}+[^{MARK}]*+|[^{MARK}]++")


class Vocabulary:
    """Pieces of a model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = len(model)
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {}
        self.id, self.score = {}, {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece], self.score[piece] = i, model.get_score(i)
        raw = {i: bytes([b]) for b, i in self.bytes.items()}
        self.raw = [raw[i] if i in raw else t.encode() for i, t in enumerate(self.text)]
        self.longest = max(map(len, self.id), default=0)
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a mark inside; marked words can't be encoded one by one")
        self.follows: dict[int, bool] = {}  # left id * size + right id
        # a piece that merges never reach (its own encoding is another) can't end a prefix
        self.reached = {p: self.merge(p) == [p] for p in self.id}

    @cached_property
    def root(self) -> dict:
        """Trie of the pieces by characters; None leads to a piece's id."""
        root: dict = {}
        for p, i in self.id.items():
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[None] = i
        return root

    def merge(self, word: str) -> list[str]:
        """Pieces of a word by merging: the pair of best score first, the leftmost of equal ones."""
        parts = list(word)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, left, right = heapq.heappop(heap)
            if parts[i] != left or j < 0 or after[i] != j or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p]

    def joins(self, left: int, right: int) -> bool:
        """True if merging leaves two pieces as they are side by side."""
        a, b = self.text[left], self.text[right]
        found = self.follows[left * self.size + right] = self.merge(a + b) == [a, b]
        return found


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[str], v: Vocabulary, *, unigram: bool = False) -> dict[str, tuple[int, ...]]:
    """Token ids of distinct words. Sorted words share the states of their common prefixes."""
    out: dict[str, tuple[int, ...]] = {}
    follows, joins, size, root, worth = v.follows.get, v.joins, v.size, v.root.get, v.score
    # piece -1: a character no piece covers, or the word's start; open: starts of pieces that may go on, the earliest first
    last, start, piece, score, open_ = "", [0], [-1], [0.0], [()]
    for word in sorted(words):
        same = 0
        for a, b in zip(last, word):
            if a != b:
                break
            same += 1
        del start[same + 1:], piece[same + 1:], score[same + 1:], open_[same + 1:]
        for end in range(same + 1, len(word) + 1):
            c = word[end - 1]
            going = [(s, n) for s, m in open_[end - 1] if (n := m.get(c)) is not None]
            one = root(c)
            at, i, most = end - 1, -1 if one is None else one.get(None, -1), 0.0
            if unigram:
                most = score[at] + (worth[word[at:end]] if i >= 0 else -1e6)
                for s, n in going:
                    j = n.get(None, -1)
                    if j >= 0 and (x := score[s] + worth[word[s:end]]) > most:
                        at, i, most = s, j, x
            else:
                for s, n in going:
                    j = n.get(None, -1)
                    if j >= 0:
                        before = piece[s]
                        f = True if before < 0 else follows(before * size + j)
                        if f or (f is None and joins(before, j)):
                            at, i = s, j
                            break  # the only piece that merging can end here with
            if one is not None:
                going.append((end - 1, one))
            open_.append(going)
            start.append(at)
            piece.append(i)
            score.append(most)
        ids, end = [], len(word)
        while end:
            i, at = piece[end], start[end]
            if i >= 0:
                ids.append(i)
            else:
                ids.extend(v.bytes[b] for b in reversed(word[at:end].encode()))
            end = at
        ids.reverse()
        out[word] = tuple(ids)
        last = word
    return out


def marked(text: str) -> list[str]:
    """Marked words of a text."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def decode_ids(ids: list[int], v: Vocabulary) -> str:
    """Text of token ids: bytes are joined, marks become blanks, the leading blank goes."""
    text = b"".join(map(v.raw.__getitem__, ids)).decode(errors="replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, *, vocab: str | None = None, unigram: bool = False) -> DataFrame:
    """``(doc_id, ids)`` of ``(doc_id, text)``."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches):
        v, halves = load(path), _CACHE.setdefault((path, unigram), [{}, {}])  # outlives the task where workers do
        for batch in batches:
            texts, low = batch.column(1).to_pylist(), 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size < BLOCK_CHARS):
                    size += len(texts[high] or "")
                    high += 1
                words = [marked(t or "") for t in texts[low:high]]
                young, old = halves
                fresh = set().union(*words) - young.keys()
                met = fresh & old.keys()
                if len(young) + len(fresh) > CACHE_WORDS:
                    young, old = {}, {**{w: old[w] for w in met}, **young}
                    halves[:] = young, old
                    met = (fresh | set().union(*words)) & old.keys()
                    fresh = set().union(*words)
                young.update((w, old[w]) for w in met)
                young.update(encode_words(list(fresh - met), v, unigram=unigram))
                cache = young
                lens, flat = [], []
                for w in words:
                    before = len(flat)
                    flat.extend(chain.from_iterable(map(cache.__getitem__, w)))
                    lens.append(len(flat) - before)
                offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ids], ["doc_id", "ids"])
                low = high

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, *, vocab: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``."""
    path = vocab or vocabulary("piece_bpe_32k.model")

    def run(batches):
        v = load(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                text = [decode_ids(x or [], v) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id bigint, text string")


def checked(docs: DataFrame, *, vocab: str | None = None) -> DataFrame:
    """Digests of the encoding, and whether decoding gives the text back, per row of ``(doc_id, text)``."""
    path = vocab or vocabulary("piece_bpe_32k.model")
    both = encode(docs.select("doc_id", "text"), vocab=path)

    def run(batches):
        v = load(path)
        plain = np.array([len(t.encode()) for t in v.text], np.int64)
        plain[list(v.bytes.values())] = 1
        for batch in batches:
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            flat = lists.values.to_numpy()
            crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
            total = np.concatenate([[0], np.cumsum(plain[flat])])
            text = [zlib.crc32(decode_ids(flat[a:b].tolist(), v).encode()) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()), pa.array(total[at[1:]] - total[at[:-1]], pa.int64()),
                pa.array(text, pa.int64())], ["doc_id", "n_tokens", "ids_crc32", "piece_bytes", "text_crc32"])

    return both.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, piece_bytes bigint, text_crc32 bigint")


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return checked(table(spark, sf_dir, "documents"))
