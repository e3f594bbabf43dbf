"""Personal data by candidate gradient boosting, in DataFrame functions only.

High-recall patterns propose spans, which may overlap. Spans that pass their base check are always
personal data. For the others, boosted trees score format and context, and a threshold per kind,
calibrated on the candidates of all documents, selects what else is redacted. The trees learn from
candidates that a check outside their features settles (check digit, octet range, number of digits, an
assignment before a secret); about ``train_docs`` documents, drawn by hash, supply them. Candidates
fall into two halves by hash, and the trees learned from one half score the other, so no candidate is
scored by trees that saw it and all of them calibrate. The fitted trees are turned into column
expressions, so scoring stays in the row that holds the text: no explode, no shuffle, no join.
Calibration reads all texts once more and counts by kind, label and score on the map side.

Defined results: a null text is an empty one without spans; rows are judged one by one, so null or
repeated ids and equal rows need no care; an empty table, or one whose candidates are all of one
class, gets base spans only; other columns of the input are carried along or left out.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import free_name, query, table
from panelwright.session import materialize

TRAIN_DOCS = 20_000
TREES, DEPTH = 12, 3
PRECISION = 0.9  # a kind's threshold is the lowest score at which precision over all documents reaches this
HALVES = 2  # of the candidates, by hash; the trees of one score the other
BINS = 100  # of the score, for calibration

KINDS = ("email", "ip", "card", "phone", "secret", "number", "handle")
BASE = 4  # the first kinds have a base check

_LOCAL, _HOST = r"A-Za-z0-9._%+-", r"A-Za-z0-9-"
# Possessive runs and the look-behinds keep each pattern linear without changing what it finds: a run that
# fails from its first character fails from every later one. \G allows a match to start where one ended.
PATTERNS = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{20,}+",
    r"(?<![0-9A-Za-z+.])[0-9](?:[\x20().-]{0,2}+[0-9]){6,18}+(?![0-9])",
    rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+\x20?[\[({{]\x20?at\x20?[\])}}]\x20?[{_HOST}]{{1,63}}"
    rf"(?:\x20?[\[({{]\x20?dot\x20?[\])}}]\x20?[{_HOST}]{{1,63}}|\.[{_HOST}]{{1,63}})++",
)
_ASSIGNED = r"(?i)(token|secret|key|passw|pwd|auth)\w*\s*[=:]\s*[\"']?$"
_NAMED = r"(?i)(tel|phone|call|fax|card|visa|iban|ssn|mail|contact|passport|account)"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(numbers: Column, first, count) -> Column:
    return F.aggregate(F.slice(numbers, first, count), F.lit(0), lambda a, x: a + x)


def _running(steps: Column) -> Column:
    """Sums of the first 1, 2, … steps; about n * sqrt(n) additions for n steps."""
    def blocked(size: Column) -> Column:
        def summed(blocks: Column) -> Column:
            return F.transform(steps, lambda _, i: _total(blocks, F.lit(1), F.floor(i / size).cast("int"))
                               + _total(steps, (F.floor(i / size) * size + 1).cast("int"), (i % size + 1).cast("int")))

        return _let(F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / size).cast("int")),
                                lambda b: _total(steps, (b * size + 1).cast("int"), size)), summed)

    return _let(F.ceil(F.sqrt(F.size(steps))).cast("int"), blocked)


def _found(text: Column, kind: int) -> Column:
    """Leftmost non-overlapping matches of a kind: kind, start, end, match, context on each side."""
    pattern = F.lit(PATTERNS[kind])

    def placed(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(hits, lambda _, i: F.length(F.get(gaps, i))
                                + F.when(i == 0, F.lit(0)).otherwise(F.length(F.get(hits, i - 1))))
            return _let(_let(steps, _running), lambda starts: F.transform(hits, lambda m, i: F.struct(
                F.get(starts, i).alias("s"), F.lit(kind).alias("k"), (F.get(starts, i) + F.length(m)).alias("e"), m.alias("m"),
                F.right(F.get(gaps, i), F.lit(24)).alias("l"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("r"))))

        return F.when(F.size(hits) > 0, _let(F.split(text, PATTERNS[kind], -1), with_gaps))

    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind == 0:
        hits = F.when(F.contains(text, F.lit("@")), hits).otherwise(F.array().cast("array<string>"))
    return F.coalesce(_let(hits, placed), F.array().cast(_SPAN))


_SPAN = "array<struct<s:int,k:int,e:int,m:string,l:string,r:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Check digit over the digits from the right, every second doubled."""
    def check(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int") * (i % 2 + 1)
            return F.when(x > 9, x - 9).otherwise(x)

        long = (F.length(d) >= 12) & (F.length(d) <= 19)
        return F.when(long, F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0)

    return F.coalesce(_let(_digits(m), check), F.lit(False))


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda p: F.coalesce(
        F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255), F.lit(False)))


def _checked(c: Column) -> Column:
    """Base check of a candidate of one of the base kinds."""
    n = F.length(_digits(c["m"]))
    return (F.when(c["k"] == 0, True).when(c["k"] == 1, _octets(c["m"])).when(c["k"] == 2, _luhn(c["m"]))
            .when(c["k"] == 3, (n >= 9) & (n <= 15)).otherwise(False))


def _label(c: Column) -> Column:
    """What a candidate is by evidence that its features do not hold."""
    return (F.when(c["k"] == 4, c["l"].rlike(_ASSIGNED)).when(c["k"] == 5, _luhn(c["m"])).when(c["k"] == 6, True)
            .otherwise(_checked(c)))


def _features(c: Column) -> Column:
    m = c["m"]
    before, after = F.right(c["l"], F.lit(1)), F.left(c["r"], F.lit(1))

    def share(chars: str) -> Column:
        return (F.length(m) - F.length(F.regexp_replace(m, chars, ""))) / F.length(m)

    def side(x: Column) -> Column:
        return F.when(x == "", 0.0).when(x.rlike(r"\s"), 1.0).when(x.rlike("[=:\"']"), 2.0).when(x.rlike("[A-Za-z0-9]"), 3.0).otherwise(4.0)

    return F.array(*[x.cast("double") for x in (
        c["k"], F.length(m), F.length(_digits(m)), share("[0-9]"), share("[A-Z]"), share("[a-z]"),
        F.size(F.split(m, "[^A-Za-z0-9]+")), F.length(F.regexp_extract(m, "([0-9]+)$", 1)), F.length(F.regexp_extract(m, "^([0-9]+)", 1)),
        F.size(F.array_distinct(F.split(m, ""))) / F.length(m), side(before), side(after),
        (F.trim(c["l"]) == ""), (c["l"].rlike(_NAMED) & (c["k"] != 4)),
    )])


def candidates(text: Column) -> Column:
    """All proposed spans of a text."""
    whole = F.coalesce(text, F.lit(""))
    return F.concat(*[_found(whole, k) for k in range(len(KINDS))])


def _tree(lines: list[str], features: Column) -> Column:
    """One printed tree as nested conditions; consumes its lines."""
    line = lines.pop(0).strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1]))
    place, limit = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines, features)
    lines.pop(0)  # the Else line of the same split
    high = _tree(lines, features)
    return F.when(F.get(features, F.lit(int(place))) <= float(limit), low).otherwise(high)


def _half(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(HALVES))


class Model:
    """Boosted trees of each half as expressions, and a threshold for each kind (None: base spans only)."""

    def __init__(self, texts: list[str] | None, weights: list[list[float]], limits: dict[int, float]):
        self.texts, self.weights, self.limits = texts, weights, limits

    def score(self, c: Column) -> Column:
        """Score by the trees that did not learn from the candidate's half."""
        def margin(x: Column, half: int) -> Column:
            trees = re.split(r"^  Tree \d+ .*$", self.texts[half], flags=re.M)[1:]
            return sum((_tree([y for y in t.splitlines() if y.strip()], x) * w for t, w in zip(trees, self.weights[half])), F.lit(0.0))

        return _let(_features(c), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(
            F.when(_half(c) == 0, margin(x, 1)).otherwise(margin(x, 0)) * -2.0)))

    def chosen(self, c: Column) -> Column:
        """True for a span that is redacted."""
        if self.texts is None or not self.limits:
            return _checked(c)
        limit = F.lit(2.0)
        for k, v in self.limits.items():
            limit = F.when(c["k"] == k, v).otherwise(limit)
        return F.when(_checked(c), True).otherwise(self.score(c) >= limit)


def _grown(data: DataFrame, labels: set[float]) -> tuple[str, list[float]]:
    """Printed trees and their weights; of a half without both labels, one leaf that says which it has."""
    if labels != {0.0, 1.0}:
        return f"  Tree 0 (weight 1.0):\n    Predict: {sum(2 * x - 1 for x in labels)}\n", [1.0]
    trees = GBTClassifier(labelCol="label", featuresCol="f", maxIter=TREES, maxDepth=DEPTH, seed=7).fit(
        data.select("label", array_to_vector("x").alias("f")))
    return trees.toDebugString, list(trees.treeWeights)


def calibrated(df: DataFrame, model: Model, *, text: str = "text") -> dict[int, float]:
    """Threshold of each kind from the scores and labels of all candidates of ``df``; a kind may have none."""
    scored = F.transform(candidates(F.col(f"`{text}`")), lambda c: F.struct(
        c["k"].alias("k"), _label(c).cast("int").alias("label"), F.floor(model.score(c) * BINS).cast("int").alias("bin")))
    bins = df.select(F.explode(scored).alias("c")).groupBy("c.k", "c.bin").agg(
        F.sum("c.label").alias("hits"), F.count("*").alias("n")).collect()  # at most 101 rows a kind
    limits = {}
    for k in range(len(KINDS)):
        hits = n = 0
        for r in sorted((r for r in bins if r["k"] == k), key=lambda r: -r["bin"]):
            hits, n = hits + r["hits"], n + r["n"]
            if hits >= PRECISION * (n + 1):  # one more miss than seen: small samples must be surer
                limits[k] = r["bin"] / BINS
    return limits


def fit(df: DataFrame, *, text: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Train on the candidates of about ``train_docs`` documents, which a hash of the row draws; calibrate on those of all."""
    rows = df.count()
    drawn = df.where(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1_000_000)) < int(1e6 * min(1, train_docs / max(rows, 1))))
    spans = drawn.select(F.explode(candidates(F.col(f"`{text}`"))).alias("c"))
    data = materialize(spans.select(_label(F.col("c")).cast("double").alias("label"), _features(F.col("c")).alias("x"),
                                    _half(F.col("c")).alias("half")), "candidates")
    seen = {(r["half"], r["label"]) for r in data.groupBy("half", "label").count().collect()}  # at most four rows
    if {label for _, label in seen} != {0.0, 1.0}:
        return Model(None, [], {})
    grown = [_grown(data.where(F.col("half") == h), {label for half, label in seen if half == h}) for h in range(HALVES)]
    model = Model([t for t, _ in grown], [w for _, w in grown], {})
    model.limits = calibrated(df, model, text=text)
    return model


def spans(df: DataFrame, model: Model, *, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with the array ``name`` of chosen spans ``(s, k, e, base)`` by start, then kind."""
    picked = F.transform(F.filter(candidates(F.col(f"`{text}`")), model.chosen), lambda c: F.struct(
        c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), _checked(c).alias("base")))
    return df.withColumn(name, F.array_sort(picked))


def _number(list_: Column, kind: int) -> Column:
    return F.size(F.filter(list_, lambda c: c["k"] == kind)).cast("bigint")


def _written(list_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(list_, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def redact(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``df`` with each chosen span of ``text`` replaced by its kind in brackets; overlapping spans merge."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    body = F.col(f"`{text}`")
    name = free_name(df, "spans")

    def merge(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], c["e"]).alias("e"))
        fresh = F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))
        return (F.when(F.size(done) == 0, F.array(fresh))
                .when(c["s"] < last["e"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
                .otherwise(F.concat(done, F.array(fresh))))

    def rebuilt(iv: Column) -> Column:
        parts = F.transform(iv, lambda c, i: F.concat(
            F.substring(body, F.when(i == 0, F.lit(1)).otherwise(F.get(iv, i - 1)["e"] + 1),
                        c["s"] - F.when(i == 0, F.lit(0)).otherwise(F.get(iv, i - 1)["e"])), F.get(names, c["k"])))
        return F.concat(F.array_join(parts, ""), F.substring(body, F.element_at(iv, -1)["e"] + 1, F.length(body)))

    merged = F.aggregate(F.col(name), F.array().cast("array<struct<s:int,k:int,e:int>>"), merge)
    return spans(df, model, text=text, name=name).withColumn(
        text, F.when(F.size(name) > 0, _let(merged, rebuilt)).otherwise(body)).drop(name)


@query("op1_personal_data")
def op1_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = spans(docs, fit(docs)).select("doc_id", "spans", F.filter("spans", lambda c: c["base"] & (c["k"] < BASE)).alias("base"))
    return found.select(
        "doc_id", *[_number(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
