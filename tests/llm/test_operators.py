"""Each corpus operator beside a plain version, on supplied documents and on awkward rows."""

import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check_oracle import compare
from panelwright.llm import ann, chat, neardup, packing, passages, pii, quality, sentpiece, urls, warc
from panelwright.llm.queries import ORACLES, QUERIES
from tests.llm import brute

LONG = " ".join(f"w{i % 7919}x{i % 13}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(55))
AWKWARD = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, ""), (4, " \n\t "), (5, "short text"),
    (6, "ONE two three four five six seven eight nine ten eleven twelve"), (6, "ONE two three four five six seven eight nine ten eleven twelve"),
    (7, PASSAGE + " own tail of seven"), (8, "a head " + PASSAGE), (None, PASSAGE), (9, LONG), (10, LONG + " end"), (11, "short text"),
    (12, "mail a@b.c.@d.e and x@y.z, 1.2.3.4.5.6.7.8 or 999.1.1.1; 4111 1111-1111 1111; +1 (017) 555-7713 é 4111111111111112"),
    (13, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""), (14, "tick " * 300), (15, "line a\nline a\n\nline a\nb # * & é"),
]
SCHEMA = "doc_id bigint, text string, lang string, spans string, ord int, measures double, __z string"


def frame(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, "en" if i != 5 else None, "s", 1, 2.0, None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def both(spark, documents):
    """Awkward rows after 120 supplied ones, as a frame and as a list."""
    some = [(r["doc_id"] + 100, r["text"]) for r in documents.orderBy("doc_id").collect()[:120]]
    return frame(spark, AWKWARD + some), AWKWARD + some


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def bag(rows):
    return sorted(rows, key=repr)


def test_quality(both):
    df, rows = both
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = quality.judge(df, name="q").select("doc_id", *[f"q.{n}" for n in names], "q_base_failed")
    want = [(i, *[brute.rules(t)[n] for n in [*names, "base_failed"]]) for i, t in rows]
    assert bag(rows_of(got)) == bag(want)
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and kept.count() > 0


def test_near_copies(both):
    df, rows = both
    got = neardup.mark(df.select("doc_id", "text"))
    roots = brute.components(rows)
    want = [(i, len(brute.shingles(t)), roots.get(i), i is None or roots[i] == i) for i, t in rows]
    assert bag(rows_of(got)) == bag(want)
    left = neardup.drop_near_copies(df)
    assert left.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == sorted({-1 if i is None else i for i, *_ , k in want if k})


def test_near_copy_group(spark):
    """A large group of edited copies: same components as all pairs, few pairs looked at."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base if i % 9 else rows[-1][1].split())
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    got = neardup.mark(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute.components(rows)


def test_passages(both):
    df, rows = both
    got = passages.dedup(df.select("doc_id", "text"))
    want = [(i, n, n - len(k), brute.sha(" ".join(k))) for (i, _), (n, k) in zip(rows, brute.kept_words(rows))]
    assert bag(rows_of(got)) == bag(want)
    texts = passages.strip(df)
    assert texts.columns == df.columns
    left = [(i, t if n == len(k) else " ".join(k)) for (i, t), (n, k) in zip(rows, brute.kept_words(rows))]
    assert bag(rows_of(texts.select("doc_id", "text"))) == bag(left)


def test_personal_data(both):
    df, rows = both
    model = pii.fit(df.select("doc_id", "text"))
    found = pii.spans(df, model, name="found")
    got = {(r["doc_id"], r["text"]): ",".join(f"{pii.KINDS[c['k']]}:{c['s']}:{c['e']}" for c in r["found"] if c["base"] and c["k"] < 4)
           for r in found.collect()}
    assert got == {(i, t): brute.base_spans(t) for i, t in rows}
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df, model).collect()}
    assert "[CARD]" in texts[12] and "x@y.z" not in texts[12] and "é" in texts[12] and texts[2] is None
    assert pii.redact(df, model).columns == df.columns


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("a1.@+-4 ()éx_%", max_size=60), min_size=1, max_size=20))
def test_base_spans_of_noise(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = pii.spans(df, pii.Model(None, [], {}), name="found").collect()
    assert [",".join(f"{pii.KINDS[c['k']]}:{c['s']}:{c['e']}" for c in r["found"]) for r in got] == [brute.base_spans(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), min_size=1))))
def test_packing_plan(case):
    capacity, counts = case
    used = {}
    for size, table in packing.plan(counts, capacity).items():
        for (first, each, sequence, offset), end in zip(table, [*table[1:, 0], counts[size]]):
            for k in range(end - first):
                used.setdefault(sequence + k // each, []).append((offset + k % each * size, size))
    assert sum(map(len, used.values())) == sum(counts.values())
    for places in used.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    least = math.ceil(sum(s * n for s, n in counts.items()) / capacity)
    assert least <= len(used) <= max(1, 2 * least)  # two sequences of a best fit never fit in one


def test_packing(both):
    import public_tokenizers
    from tokenizers import Tokenizer

    df, rows = both
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = packing.pack(df.select("doc_id", "text"), with_ids=True).toPandas()
    want = []
    for i, t in rows:
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        edges = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    have = [(None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert bag(have) == bag(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got.itertuples())
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert list(part["offset"]) == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 1024


def test_sentencepiece(both):
    import public_tokenizers
    import sentencepiece

    df, rows = both
    rows = rows + [(900, "日本語 テキスト😀 é"), (901, "  a  b\n\tc "), (902, "ﬁ ½ ▁x")]
    df = df.sparkSession.createDataFrame(rows, "doc_id bigint, text string")
    plain = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentpiece.encode(df)
    assert bag((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == bag((i, tuple(plain.encode(t or ""))) for i, t in rows)
    text = bag(rows_of(sentpiece.decode(encoded)))
    assert text == bag((i, (t or "").replace("▁", " ")) for i, t in rows)


def test_unigram_scores():
    """Viterbi over scores equals the best of all segmentations."""
    v = sentpiece.Vocabulary.__new__(sentpiece.Vocabulary)
    rng = random.Random(1)
    pieces = {"a", "b", "c"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)}
    v.text = sorted(pieces)
    v.id, v.size, v.bytes = {p: i for i, p in enumerate(v.text)}, len(v.text), {}
    v.score = {p: -rng.randint(1, 30) / len(p) for p in v.text}
    v.lengths = {}
    for p in v.text:
        v.lengths.setdefault(p[-2:], set()).add(len(p))
    v.follows = {}

    def best(w):
        return max((v.score[w[:k]] + (best(w[k:]) if w[k:] else 0.0) for k in range(1, len(w) + 1) if w[:k] in v.id), default=-math.inf)

    some = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    for word, ids in sentpiece.encode_words(list(set(some)), v, unigram=True).items():
        assert "".join(v.text[i] for i in ids) == word and sum(v.score[v.text[i]] for i in ids) == pytest.approx(best(word))


def test_nearest(spark, sf):
    e = pd.read_parquet(f"{sf}/embeddings.parquet")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = QUERIES["op7_cross_polytope"](spark, sf).toPandas()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        hits, total = hits + len(set(ids[order]) & set(part.vec_id)), total + len(order)
        assert np.array_equal(part.sort_values("rank").score, np.sort(d[np.searchsorted(ids, part.vec_id)]))
    assert hits >= 0.9 * total and got.query_id.nunique() == (ids % 100 == 0).sum()


def test_nearest_awkward(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 7)
    same = [(i, [1.0, 2.0, 0.5]) for i in range(40)]
    bad = [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [1.0]), (None, [1.0, 1.0, 1.0]), (55, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in same + bad], "vec_id bigint, v array<double>, cell string")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), key="vec_id", vector="v")
    assert bag(rows_of(got)) == bag([(q, k + 1, i, 0.0) for q in (0, 20) for k, i in enumerate([i for i in range(11 + (q > 10)) if i != q][:10])])
    assert ann.nearest(df.limit(0), df.limit(0), key="vec_id", vector="v").count() == 0


def test_archives(spark, duck, sf):
    assert compare(QUERIES["op8_warc_archives"](spark, sf), duck, ORACLES["op8_warc_archives"]) == ""


def test_archives_awkward(spark):
    pages = [(1, "http://a.b.com/x\r\ny", "same"), (2, None, "same"), (3, "http://b.com/", None), (4, "http://b.com/", ""), (None, "no scheme", "same"),
             (5, "http://b.com/", "é" * 70_000), (6, "http://b.com/", "x\r\n\r\nWARC/1.1\r\n"), (2, None, "same")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    index = warc.CaptureIndex(warc.write_archives(df), block_lines=2, shards=3)
    keys = df.select(warc.capture_key(df["url"], df["page_id"]).alias("key"))
    got = warc.read_ranges(index.find(keys), payload=True).collect()
    assert bag((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == bag([
        (1, 4, "revisit", 2), (2, 4, "response", None), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None),
        (None, 4, "revisit", 2), (5, 140_000, "response", None), (6, 15, "response", None)])
    assert {r["html"] for r in got if r["page_id"] in (5, 6)} == {"é" * 70_000, "x\r\n\r\nWARC/1.1\r\n"}
    assert index.find(spark.createDataFrame([("com,nowhere)/ 1",)], "key string")).count() == 0


def test_roles(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 2)
    monkeypatch.setattr(chat, "PIECE_ROWS", 5)
    monkeypatch.setattr(chat, "FAN", 3)
    rng = random.Random(3)
    rows = [(1 if i < 90 else 2 + i // 10, i if i < 50 or i > 70 else 50, None if i % 4 == 0 else ["user", "Assistant", "bot", "system", "??"][i % 5],
             f"line {rng.random()}" + ("?" if i % 3 else "\nmore\nUser: inner")) for i in range(140)]
    rows += [(None, None, None, None), (7, 3, "user", ""), (500, 0, None, "System: be kind\nUser: hi\nAssistant: hello\nmore\n### Human: bye?")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.render(chat.decode(df)).toPandas()
    mine = got[got.conv_id == 500].sort_values("segment")
    assert list(zip(mine.role, mine.text)) == [("system", "be kind"), ("user", "hi"), ("assistant", "hello\nmore"), ("user", "bye?")]
    assert mine.rendered.iloc[1] == "<|im_start|>user\nhi<|im_end|>\n"
    assert len(got[got.segment == 0]) == len(rows)
    # the pieces' paths score as much as one Viterbi over each whole conversation
    model = chat.train(df)
    lines = chat.located(df).toPandas()
    lines["inner"] = lines.inner.map(lambda r: tuple(r) if r is not None else (-1,))
    for _, part in lines.groupby("conv_id"):
        part = part.sort_values(["span", "inner", "turn", "h", "id"]).reset_index(drop=True)
        steps = [model.step(a, b, c) for a, b, c, _ in chat._observed(part.to_dict("records"))]
        top = int(chat.combine(steps)[chat.START].max())
        path = chat.best_between(steps, chat.START, int(chat.combine(steps)[chat.START].argmax()))
        assert sum(int(m[a, b]) for m, a, b in zip(steps, [chat.START, *path], path)) == top
    assert chat.decode(df.limit(0)).count() == 0


def test_roles_recovered(spark):
    """Held-out tags: a third of the tags are hidden and recovered (179 of them; the smallest table has 29)."""
    whole = pd.read_parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = whole.copy()
    hidden.loc[hidden.index % 3 == 0, "role"] = None
    got = chat.decode(spark.createDataFrame(hidden)).toPandas()
    both = whole[whole.index % 3 == 0].merge(got[got.segment == 0], on=["conv_id", "turn"])
    assert (both.role_x == both.role_y).mean() > 0.9


def test_url_rules(spark):
    rows = [(1, "http://a.com/x", "<a href='http://b.org/'>"), (2, "http://b.org/x", "<a href=//c.org/ >"), (3, "http://s.net/es/x", ""),
            (4, "http://d.org/?q", '<A HREF="http://s.net/es/q">'), (5, "HTTP://WWW.EXAMPLE.com/en/1?x#y", None), (6, None, "x"), (7, "nohost", None),
            (8, "http://e.org#://x/", ""), (9, "http://x.example.com/en/1", ""), (9, "http://x.example.com/en/1", ""), (None, "http://com", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, host int")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df.drop("host")).collect()}
    assert got == {(1, "a.com", "/x", "com/", "allow"), (2, "b.org", "/x", None, "allow"), (3, "s.net", "/es/x", "net/es/", "block"),
                   (4, "d.org", "/", None, "block"), (5, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (6, "", "", None, "allow"),
                   (7, "", "", None, "allow"), (8, "e.org", "", None, "allow"), (9, "x.example.com", "/en/1", "example.com/en/", "block"),
                   (None, "com", "", None, "allow")}


def test_link_graph_mass(spark):
    """Ranks equal those of dense matrix steps, and no mass is lost."""
    links = [("a", "b", 2), ("b", "c", 1), ("a", "c", 1), ("d", "a", 1), ("c", "e", 1)]
    seeds = [("trust", "a", 0.5), ("trust", "d", 0.5), ("distrust", "c", 1.0)]
    got = urls.propagate(spark.createDataFrame(links, "a string, b string, links bigint"),
                         spark.createDataFrame(seeds, "kind string, host string, mass double")).collect()
    names = "abcde"
    for kind in ("trust", "distrust"):
        m = np.zeros((5, 5))
        for a, b, n in links:
            a, b = (a, b) if kind == "trust" else (b, a)
            m[names.index(a), names.index(b)] = n
        total = m.sum(1, keepdims=True)
        m = np.divide(m, total, out=np.zeros_like(m), where=total > 0)
        s = np.array([sum(w for k, h, w in seeds if k == kind and h == n) for n in names])
        x = s
        for _ in range(400):
            moved = urls.DAMPING * x @ m
            x = moved + s * (1 - moved.sum())
        mine = {r["host"]: r["mass"] for r in got if r["kind"] == kind}
        assert np.allclose([mine.get(n, 0.0) for n in names], x) and sum(mine.values()) == pytest.approx(1)


@pytest.mark.parametrize("make", [
    lambda d: quality.judge(d), lambda d: neardup.mark(d.select("doc_id", "text")), lambda d: passages.dedup(d.select("doc_id", "text")),
    lambda d: packing.pack(d.select("doc_id", "text")), lambda d: sentpiece.checked(d.select("doc_id", "text")),
    lambda d: pii.redact(d, pii.fit(d)), lambda d: warc.read_ranges(warc.CaptureIndex(warc.write_archives(
        d.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))).find(d.selectExpr("text AS key"))),
    lambda d: urls.judge(d.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))])
def test_empty(spark, make):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert make(empty).count() == 0
