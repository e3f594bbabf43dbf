"""The registered corpus queries over the smallest tables, against plain versions."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from panelwright.llm.common import vocabulary
from tests.llm import brute


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name):
    return queries()[name](spark, sf).collect()


def test_personal_data(spark, sf, texts):
    got = rows(spark, sf, "op1_personal_data")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = brute.base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(base)
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(filter(None, base.split(","))) <= set(spans)
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in filter(None, base.split(",")))
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def test_near_copies(spark, sf, texts):
    want = brute.components(list(texts.items()))
    for r in rows(spark, sf, "op2_minhash_tensored"):
        assert (r["component_id"], r["kept"], r["n_shingles"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"], len(brute.shingles(texts[r["doc_id"]])))


def placed(got, ids):
    """Pieces hold their documents' ids in order, and sequences are filled without gaps."""
    docs, sequences = {}, {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(docs) == set(ids)
    for i, mine in docs.items():
        mine.sort(key=lambda r: r["piece"])
        whole, at = np.array([*ids[i], 2], "<u4"), 0
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(whole[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(whole) and all(r["length"] == 1024 for r in mine[1:])
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) + 2


def test_packing(spark, sf, texts):
    import tokenizers

    encoder = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    placed(rows(spark, sf, "op3_best_fit_packing"), {i: encoder.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()})


def test_quality(spark, sf, texts):
    for r in rows(spark, sf, "op4_quality_rules"):
        want = brute.rules(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert not (r["base_failed"] and r["kept"])


def test_sentencepiece(spark, sf, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for r in rows(spark, sf, "op6_sentencepiece"):
        ids = np.array(model.encode(texts[r["doc_id"]] or ""), "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def test_urls(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in rows(spark, sf, "op10_link_graph"):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].translate(brute.UPPER), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        fits = [(rule, act) for rule, act in RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith(rule[rule.index("/"):])]
        if fits:
            assert (r["rule"], r["verdict"]) == max(fits, key=lambda f: len(f[0]))
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_pipeline_run(spark, sf):
    """Whole runs over documents with nulls, repeated rows, an empty table and a clashing column."""
    import tokenizers

    from panelwright.session import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "stage")
    encoder = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    placed(queries()["pipeline"](spark, sf).collect(), {r["doc_id"]: encoder.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()})


def test_pipeline_on_awkward_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = docs.where("n_chars > 400").limit(30)
    odd = good.limit(4).unionByName(good.limit(3).selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")).unionByName(
        good.limit(5).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "CAST(NULL AS STRING) AS lang", "source", "CAST(NULL AS BIGINT) AS n_chars"))
    good.unionByName(odd).withColumn("measures", docs["n_chars"] * 0).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r["length"] > 0 for r in got)
    ids = [r["doc_id"] for r in got if r["piece"] == 0 and r["doc_id"] is not None]
    assert len(ids) == len(set(ids))  # of repeated rows one stays
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
