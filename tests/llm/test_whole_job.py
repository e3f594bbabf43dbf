"""Inputs on which an operator that looks at less than all of its rows gives another result."""

import random

from panelwright.llm import packing, pii, quality


def test_rare_kind_calibrates_on_all_documents(spark):
    """Twenty handles in 400 documents: too few in a quarter of a sample, enough over all documents."""
    rng = random.Random(11)

    def luhn(digits):
        doubled = [x * (1 + i % 2) for i, x in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    rows = []
    for i in range(400):
        digits = [rng.randrange(10) for _ in range(15)]
        number = next(n for d in range(10) if luhn(n := [*digits, d]) == bool(i % 2))
        text = f"order {''.join(map(str, number))} of {i} arrived"
        rows.append((i, f"{text}, write to user{i} [at] host{i} [dot] org today" if i % 20 == 0 else text))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for sample in (100, pii.TRAIN_DOCS):
        model = pii.fit(df, train_docs=sample)
        texts = [r["text"] for r in pii.redact(df, model).collect()]
        assert sum("[HANDLE]" in t for t in texts) == 20 and not any("[at]" in t for t in texts)


def test_byte_fallback_has_a_band_per_language(spark):
    """Clean text in a script that the vocabulary lacks is kept; Latin text with 40 % byte tokens is not."""
    rng = random.Random(12)
    amharic = "ሰላም ለሁሉም ሰዎች ዛሬ ጥሩ ቀን ነው እና ወደ ገበያ እንሄዳለን ከዚያም ቤት እንመለሳለን ልጆች በትምህርት ውስጥ ናቸው".split()
    long = "international government understanding organization development information particular national".split()
    rows = [(i, " ".join(rng.sample(amharic, 14)), "am") for i in range(60)]
    # Latin texts of all fertilities, so that only the byte share tells the mixed one from them
    for i in range(60):
        words = [rng.choice(long) if rng.random() < i / 60 else "".join(rng.choices("qxzjvkwy", k=5)) for _ in range(60)]
        rows.append((100 + i, " ".join(words), "la"))
    mixed = [rng.choice(long) if k % 5 else rng.choice("ሰላምለቀነገደ") for k in range(60)]
    rows.append((999, " ".join(mixed), "la"))
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    share = {r["doc_id"]: r["measures"]["fallback_share"] for r in got}
    kept = {r["doc_id"] for r in got if r["measures_kept"]}
    failed = {r["doc_id"] for r in got if r["measures_base_failed"]}
    assert min(share[i] for i in range(60)) > 0.5 and 0.3 < share[999] < 0.5
    assert sum(i in kept for i in range(60)) > 50 and 999 not in failed | kept
    assert sum(100 + i in kept for i in range(60)) > 50


def test_added_token_is_one_id(spark):
    """Ids equal those of ``tokenizers`` as it comes, also where a text holds the vocabulary's added token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    token = "<|endoftext|>"
    texts = [f"a {token} b", token, token * 3, f"  a  {token}  \n b", f"a\n{token}", f"<{token}|>", "<|endoftext |>", "é" + token + "日本", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.pieces(df, with_ids=True).collect()}
    assert got == {i: [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
