"""The pipeline's stages over the smallest documents."""

import corpus_pipeline
from tests.llm import brute


def test_stages(spark, sf):
    from panelwright.session import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where("n_chars <> length(text)").count() == 0
        seen[name] = (docs, out)
        docs = out
    before, after = seen["quality"]
    failed = {r["doc_id"] for r in before.collect() if brute.rules(r["text"])["base_failed"]}
    assert not failed & {r["doc_id"] for r in after.collect()}
    before, after = seen["near_copies"]
    roots = brute.components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(roots.values()))
    before, after = seen["repeats"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want = {i: t if n == len(k) else " ".join(k) for (i, t), (n, k) in zip(rows, brute.kept_words(rows))}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    _, after = seen["personal"]
    assert all(not brute.base_spans(r["text"]) for r in after.collect())
    before, after = seen["packing"]
    assert {r["doc_id"] for r in before.collect()} == {r["doc_id"] for r in after.collect()}
