"""Inputs that once crashed an operator or lost rows."""

import numpy as np
import tokenizers

from panelwright.llm import ann, neardup, packing, sentpiece
from panelwright.llm.common import vocabulary


def test_rows_of_one_id_are_judged_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 4), (8, b, 5), (None, a, 6), (None, a, 7), (9, None, 8), (9, None, 9)]
    left = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id bigint, text string, TAG bigint"))
    assert left.columns == ["doc_id", "text", "TAG"]
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(3, a), (7, b), (None, a), (None, a), (9, None)], key=repr)


def test_marked_rows_have_four_columns(spark):
    """The hash that tells texts of one id apart stays inside."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    got = neardup.mark(spark.createDataFrame([(3, a), (7, a), (7, b), (None, c)], "doc_id bigint, text string"))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(3, 36, 3, True), (7, 36, 3, False), (7, 36, 7, True), (None, 36, None, True)], key=repr)


def test_vocabulary_of_own_pieces():
    """Pieces that no model file gave are encoded as the merges have it."""
    v = sentpiece.Vocabulary.__new__(sentpiece.Vocabulary)
    v.text = ["a", "b", "c", "ab", "bc", "abc", "aba"]
    v.id, v.size, v.bytes, v.follows = {p: i for i, p in enumerate(v.text)}, len(v.text), {}, {}
    v.score = {p: -float(i) for i, p in enumerate(v.text)}
    some = ["a", "ab", "abc", "aba", "abab", "cabcab", "bcbc", "abcabc", "bababc"]
    got = sentpiece.encode_words(some, v)
    assert {w: [v.text[i] for i in ids] for w, ids in got.items()} == {w: v.merge(w) for w in some}


def test_long_runs_of_blanks(spark):
    texts = [c * n for c in " \n\t" for n in (60_000, 1_500_000)] + ["x" + " " * 70_000 + "y z", "a" * 200_000]
    encoder = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), with_ids=True)
    ids = {}
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    for i, t in enumerate(texts):
        assert ids[i] == [*encoder.encode(t, add_special_tokens=False).ids, 2]


def test_small_tables_find_all(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 12, 30, 90):
        x = rng.normal(size=(n, 64)) * np.exp(rng.normal(size=(n, 1)))
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = {}
        for r in ann.nearest(df, df, key="vec_id", vector="embedding").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
        for i in range(n):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            want = [j for j in np.lexsort((np.arange(n), d)) if j != i][:10]
            assert [j for _, j in sorted(got.get(i, []))] == want
