"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

Each row of a transcript is split into lines. A line shows a speaker marker (the row's own tag on its first line,
or ``User:``, ``### Assistant`` and the like in the text) and plain features: first of its row, length, a
question mark, a list or code sign. States are the roles. Emission and transition tables are counts over all
rows whose tag names a role. The most probable role of every line comes from Viterbi, then lines of
one role in a row become a turn.

Transcripts of any length are decoded in pieces: a piece is a table of best scores from each role before it to
each role at its end, tables of neighbouring pieces combine into one, and once the whole is known each piece is
decoded between the roles at its ends. Scores are whole numbers, so every grouping finds the same best score; of
paths with equal scores one is taken that depends on the bounds of pieces, and those on the rows alone.

Defined results: a null text is an empty line; a null or unknown tag is no marker; a null conversation id is a
conversation of its own; rows with equal turn numbers are ordered by a hash of their content, equal rows
among them arbitrarily; without any named tag all lines are users'; an empty table gives an empty
result; other columns take no part.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import query, table
from panelwright.session import materialize

ROLES = ("user", "assistant", "system")
START = len(ROLES)  # the state before a transcript
ALIASES = {"user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user",
           "assistant": "assistant", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant", "answer": "assistant",
           "a": "assistant", "system": "system", "developer": "system", "instruction": "system", "context": "system"}
MARKED = 9_000  # score of the role that a marker names over the others
SCALE = 1_000  # whole-number units of a natural logarithm
TURNS = 64  # turn numbers in a piece
PIECE_ROWS = 4_000  # rows at which a piece is split further
FAN = 256  # pieces combined at once
FEATURES = 24

_MARKER = re.compile(r"^\s{0,3}(?:#{1,4}\s*|\*\*|<\|(?:im_start\|>)?|\[)?([A-Za-z]{1,12})(?:\*\*)?\s*(?::|\|>|\]|$)\s?(?:\*\*)?", re.ASCII)
_CLOSER = re.compile(r"^\s*<\|(?:im_end|end|eot_id)\|>\s*$")


def marker(line: str, strict: bool = True) -> tuple[int, str]:
    """Role that the line's own marker names (-1: none), and the line without it."""
    m = _MARKER.match(line)
    name = ALIASES.get(m.group(1).lower()) if m else None
    alone = m is not None and not m.group(0).rstrip().endswith((":", ">", "]")) and "#" not in m.group(0) and "**" not in m.group(0)
    if name is None or alone or (len(m.group(1)) == 1 and not m.group(0).rstrip().endswith(":")):
        return -1, line
    return ROLES.index(name), line[m.end():]


def features(line: str, first: bool) -> int:
    """One number below ``FEATURES`` for the look of a line."""
    size = 0 if len(line) < 20 else 1 if len(line) < 120 else 2
    kind = 1 if "?" in line else 2 if re.match(r"\s*(?:[-*>`]|\d+[.)]|\t| {4})", line) else 0
    return (size * 3 + kind) * 2 + int(first)


def observe(tag: str | None, text: str | None) -> list[tuple[int, int, str]]:
    """``(marker, feature, text)`` of the lines of a row; ends of turns are left out."""
    out = []
    tagged = ALIASES.get((tag or "").strip().lower())
    for line in (text or "").split("\n"):
        if _CLOSER.match(line):
            continue
        found, rest = marker(line)
        if not out and found < 0 and tagged:
            found = ROLES.index(tagged)
        out.append((found, features(rest, not out), rest))
    return out or [(ROLES.index(tagged) if tagged else -1, features("", True), "")]


class Model:
    """Whole-number tables: ``stay`` inside a row, ``move`` between rows (with the start), ``emit`` by feature."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        def logs(counts):
            counts = counts + 1.0
            return np.round(SCALE * np.log(counts / counts.sum(1, keepdims=True))).astype(np.int64)

        self.emit, self.move = logs(emit), logs(move)
        self.stay = np.full((START + 1, START), round(SCALE * math.log(0.005)), np.int64)
        np.fill_diagonal(self.stay, round(SCALE * math.log(0.99)))

    def step(self, found: int, feature: int, first: bool) -> np.ndarray:
        """Score of each role for a line, from each role before it."""
        here = self.emit[:, feature].copy()
        if found >= 0:
            here -= MARKED
            here[found] += MARKED
        # a marker inside a row opens a turn as a new row does
        return (self.move if first or found >= 0 else self.stay) + here


def train(rows: DataFrame) -> Model:
    """Counts over all rows with a known tag, in two aggregates of at most a hundred rows each."""
    def run(batches):
        for frame in batches:
            out = []
            for tag, text in zip(frame["role"], frame["text"]):
                name = ALIASES.get((tag or "").strip().lower())
                if name:
                    out += [(ROLES.index(name), f) for _, f, _ in observe(None, text)]
            yield pd.DataFrame(out, columns=["state", "feature"], dtype="int32")

    emit, move = np.zeros((START, FEATURES)), np.zeros((START + 1, START))
    for r in rows.select("role", "text").mapInPandas(run, "state int, feature int").groupBy("state", "feature").count().collect():
        emit[r["state"], r["feature"]] = r["count"]
    state = F.create_map(*[F.lit(x) for k, v in ALIASES.items() for x in (k, ROLES.index(v))])
    # counted per turn number first: a turn that many rows share stays one row on each side
    known = rows.select("conv_id", "turn", F.try_element_at(state, F.lower(F.trim("role"))).alias("state")).where("state IS NOT NULL").groupBy(
        "conv_id", "turn", "state").agg(F.count("*").alias("n"))
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("state").alias("next"), F.col("n").alias("m"))
    for r in known.join(after, ["conv_id", "turn"]).groupBy("state", "next").agg(F.sum(F.least("n", "m")).alias("n")).collect():
        move[r["state"], r["next"]] = r["n"]
    for r in known.groupBy("conv_id").agg(F.min_by("state", F.struct("turn", "state")).alias("state")).groupBy("state").count().collect():
        move[START, r["state"]] = r["count"]
    return Model(emit, move)


_ORDER = ("conv_id", "span", "inner", "turn", "h", "id")


def _together(rows: DataFrame) -> DataFrame:
    """Rows of a piece in one task, side by side and in order."""
    return rows.repartition("conv_id", "span", "inner").sortWithinPartitions(*_ORDER)


def _pieces(frames):
    """``(key, rows)`` of each piece from frames sorted by piece; a piece may run over several frames."""
    key, held = None, []
    for f in frames:
        for row in zip(*[f[c].tolist() if c != "inner" else f[c] for c in f.columns]):
            row = dict(zip(f.columns, row))
            mine = tuple(None if x is None or x != x else x for x in (row["conv_id"], row["span"])) + (
                tuple(row["inner"].values() if isinstance(row["inner"], dict) else row["inner"]) if row["inner"] is not None else None,)
            if held and mine != key:
                yield key, held
                held = []
            key = mine
            held.append(row)
    if held:
        yield key, held


def _observed(rows: list[dict]) -> list[tuple[int, int, bool, int]]:
    return [(found, feature, k == 0, i) for i, row in enumerate(rows)
            for k, (found, feature, _) in enumerate(observe(row["role"], row["text"]))]


def best_between(steps: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """Best states of consecutive steps from the state ``entry`` to the state ``leave``."""
    score, back = None, []
    for m in steps:
        total = m[entry][None, :] if score is None else score[:, None] + m[:START]
        back.append(total.argmax(0))
        score = total.max(0)
    path = [leave]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1]


def combine(tables: list[np.ndarray]) -> np.ndarray:
    out = tables[0]
    for m in tables[1:]:
        out = (out[:, :, None] + m[None, :START, :]).max(1)
    return out


def _flat(m: np.ndarray) -> list[int]:
    return [int(x) for x in m.ravel()]


def _table(flat) -> np.ndarray:
    return np.asarray(list(flat), np.int64).reshape(START + 1, START)


def located(rows: DataFrame) -> DataFrame:
    """Rows with ``piece`` (rising with the order inside a conversation), ``h`` and ``id``, written once."""
    known = rows.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / TURNS).alias("span"),
                        F.shiftrightunsigned(F.xxhash64("text", "role"), 1).alias("h"), F.monotonically_increasing_id().alias("id"))
    known = materialize(known, "transcripts")
    parts = known.groupBy("conv_id", "span").agg(F.ceil(F.count("*") / PIECE_ROWS).alias("parts"))
    mark = parts.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), "parts")
    joined = known.join(mark, known["conv_id"].eqNullSafe(mark["c"]) & known["span"].eqNullSafe(mark["s"]))
    share = F.floor(F.col("h") / F.ceil(F.lit(float(2 ** 63)) / F.col("parts")))
    inner = F.when(F.col("parts") > 1, F.struct(F.col("turn"), share.alias("x"), F.pmod("id", "parts").alias("y")))
    return joined.select("conv_id", "turn", "role", "text", "h", "id", "span", inner.alias("inner"))


def decode(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, segment, role, text)``: the recovered turns of ``(conv_id, turn, role, text)``."""
    model = train(rows)
    lines = located(rows)

    def tables(frames):
        out = []
        for (conv, span, inner), part in _pieces(frames):
            out.append((conv, span, inner, _flat(combine([model.step(a, b, c) for a, b, c, _ in _observed(part)]))))
            if len(out) == 5000:
                yield _framed(out, ["conv_id", "span", "inner", "m"])
                out = []
        yield _framed(out, ["conv_id", "span", "inner", "m"])

    piece = "span bigint, inner struct<turn:bigint,x:bigint,y:bigint>"
    leaves = materialize(_together(lines).mapInPandas(tables, f"conv_id bigint, {piece}, m array<bigint>"), "pieces")
    levels = [numbered(leaves)]
    while levels[-1].agg(F.max("idx")).first()[0]:
        up = levels[-1].select("conv_id", F.floor(F.col("idx") / FAN).alias("up"), F.struct(F.col("idx").alias("i"), "m").alias("x")).groupBy(
            "conv_id", F.col("up").alias("idx")).agg(F.sort_array(F.collect_list("x")).alias("ms"))  # at most FAN tables
        levels.append(materialize(up.mapInPandas(_combined, "conv_id bigint, idx bigint, m array<bigint>"), "pieces"))

    # the whole transcript: from the start to its best end; then each level between the ends of the one above
    ends = levels[-1].mapInPandas(_outer, "conv_id bigint, idx bigint, entry int, leave int")
    for below in reversed(levels[:-1]):
        mine = below.withColumn("p", F.floor(F.col("idx") / FAN)).groupBy("conv_id", "p").agg(
            F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("ms"))
        up = ends.select(F.col("conv_id").alias("c"), F.col("idx").alias("i"), "entry", "leave")
        joined = mine.join(up, mine["conv_id"].eqNullSafe(up["c"]) & (mine["p"] == up["i"])).select("conv_id", "ms", "entry", "leave")
        ends = materialize(joined.mapInPandas(_inner, "conv_id bigint, idx bigint, entry int, leave int"), "ends")
    named = levels[0].select("conv_id", "idx", "span", "inner")
    ends = ends.select(F.col("conv_id").alias("c"), F.col("idx").alias("i"), "entry", "leave")
    placed = named.join(ends, named["conv_id"].eqNullSafe(ends["c"]) & (named["idx"] == ends["i"])).select(
        F.col("conv_id").alias("c"), F.col("span").alias("s"), F.col("inner").alias("n"), "entry", "leave")
    work = lines.join(placed, lines["conv_id"].eqNullSafe(placed["c"]) & lines["span"].eqNullSafe(placed["s"])
                      & lines["inner"].eqNullSafe(placed["n"]), "left").drop("c", "s", "n")

    def turns(frames):
        out = []
        for (conv, _, _), part in _pieces(frames):
            seen = _observed(part)
            states = best_between([model.step(a, b, c) for a, b, c, _ in seen], int(part[0]["entry"]), int(part[0]["leave"]))
            texts = [t for row in part for _, _, t in observe(row["role"], row["text"])]
            made = []
            for (_, _, _, row), state, text in zip(seen, states, texts):
                if made and made[-1][0] == row and made[-1][2] == state:
                    made[-1][3].append(text)
                else:
                    made.append((row, made[-1][1] + 1 if made and made[-1][0] == row else 0, state, [text]))
            for row, segment, state, lines_ in made:
                turn = part[row]["turn"]
                out.append((conv, None if turn is None or turn != turn else int(turn), segment, ROLES[state], "\n".join(lines_).strip("\n")))
            if len(out) >= 5000:
                yield _framed(out, _TURN)
                out = []
        yield _framed(out, _TURN)

    return _together(work).mapInPandas(turns, "conv_id bigint, turn bigint, segment int, role string, text string")


_TURN = ["conv_id", "turn", "segment", "role", "text"]


def _framed(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """A frame that keeps whole numbers beside nulls."""
    columns = list(zip(*rows)) or [()] * len(names)
    whole = {"conv_id", "turn", "span"}
    return pd.DataFrame({n: pd.array([None if x is None else int(x) for x in c], "Int64") if n in whole else pd.Series(list(c), dtype=object)
                         for n, c in zip(names, columns)})


def numbered(leaves: DataFrame) -> DataFrame:
    """Pieces with ``idx`` from 0 in each conversation's order."""
    from pyspark.sql import Window as W

    place = W.partitionBy("conv_id").orderBy("span", "inner")  # pieces, not rows: one per TURNS turns
    return materialize(leaves.withColumn("idx", (F.row_number().over(place) - 1).cast("bigint")), "pieces")


def _combined(frames):
    for f in frames:
        yield pd.DataFrame({"conv_id": f["conv_id"], "idx": f["idx"], "m": [_flat(combine([_table(x["m"]) for x in ms])) for ms in f["ms"]]})


def _outer(frames):
    for f in frames:
        yield pd.DataFrame({"conv_id": f["conv_id"], "idx": f["idx"], "entry": START, "leave": [int(_table(m)[START].argmax()) for m in f["m"]]})


def _inner(frames):
    for f in frames:
        out = []
        for conv, ms, entry, leave in zip(f["conv_id"], f["ms"], f["entry"], f["leave"]):
            path = best_between([_table(x["m"]) for x in ms], int(entry), int(leave))
            for x, a, b in zip(ms, [entry, *path[:-1]], path):
                out.append((conv, x["idx"], a, b))
        yield pd.DataFrame(out, columns=["conv_id", "idx", "entry", "leave"])


def render(turns: DataFrame) -> DataFrame:
    """Canonical text of each recovered turn in column ``rendered``."""
    return turns.withColumn("rendered", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")))


@query("op9_transcript_roles")
def op9_transcript_roles(spark, sf_dir):
    return render(decode(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
