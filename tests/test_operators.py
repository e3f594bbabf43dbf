"""Operators on awkward inputs, beside plain windows or stated results."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelwright.operators import columns, joins, order, reshape, values, windows
from panelwright.plans import QUERIES
from panelwright.sources.delimited import dropped_lines, read_delimited


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_delimited(spark, tmp_path):
    lines = ["Data source,World", "", "Country,unit,2006,2007", "A,t,1.5,2", 'B,t,"1,234",..', "C,t,12.3*,false", "D,t,,", "Last Updated Date,x", ",t,5,6"]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    args = dict(key="c", numbers=["y6", "y7"], header=["Country", "unit", "2006", "2007"])
    got = read_delimited(spark, str(tmp_path), ["c", "u", "y6", "y7"], **args)
    assert rows(got) == [("A", "t", 1.5, 2.0), ("B", "t", 1234.0, None), ("C", "t", 12.3, None), ("D", "t", None, None)]
    assert dropped_lines(spark, str(tmp_path), ["c", "u", "y6", "y7"], **args).count() == 4


@pytest.mark.parametrize("ranges", [3, 128, 4096])
def test_ranges_do_not_matter(spark, sf, monkeypatch, ranges):
    monkeypatch.setattr(order, "ranges_for", lambda df: ranges)
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value")
    got = order.with_position(ev, ["value", "event_id"], name="pos").select("event_id", F.col("pos").cast("int"))
    want = ev.select("event_id", F.row_number().over(W.orderBy("value", "event_id")).alias("pos"))
    assert rows(got) == rows(want)


def test_windows_equal_plain_ones(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("value"))
    w = W.partitionBy("user_id").orderBy("event_id")
    assert rows(windows.lead(ev, "value", ["user_id"], ["event_id"], (1, -2)).select("event_id", "value_lead1", "value_lead-2")) == rows(
        ev.select("event_id", F.lead("value", 1).over(w), F.lag("value", 2).over(w)))
    filled = windows.fill(ev, ["value"], ["user_id"], ["event_id"], "down").select("event_id", "value")
    assert rows(filled) == rows(ev.select("event_id", F.last("value", True).over(w)))


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "x_2 int, X int, x int, ISOCode int".replace("X int, x int", "`X ` int, `x` int"))
    assert columns.clean_names(df).columns == ["x_2", "x", "x_3", "iso_code"]
    swapped = columns.rename(spark.createDataFrame([(1, 2)], "a int, b int"), a="b", b="a")
    assert swapped.columns == ["b", "a"]
    with pytest.raises(ValueError):
        columns.rename(df, y="nowhere")


def test_numbers_and_codes(spark):
    df = spark.createDataFrame([("about 1,234.5 t",), (".5",), ("1e3",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(reshape.parse_number(F.col("t"))).collect()] == [1234.5, 0.5, 1000.0, None, None]
    df = spark.createDataFrame([("1.5",), ("NA",), ("-2",)], "t string")
    assert [r[0] for r in df.select(values.missing_codes(F.col("t"), texts=["NA"])).collect()] == ["1.5", None, None]


def test_keys_given_twice_fail(spark):
    left = spark.createDataFrame([(1, 10)], "k int, v int")
    assert rows(joins.left_join(left, spark.createDataFrame([(1, 20)], "k int, v int"), ["k"])) == [(1, 10, 20)]
    with pytest.raises(PySparkException):
        joins.left_join(left, spark.createDataFrame([(1, 20), (1, 21)], "k int, v int"), ["k"]).collect()
    with pytest.raises(PySparkException):
        reshape.wider(spark.createDataFrame([(1, "a", 1.0), (1, "z", 2.0)], "k int, n string, v double"), ["k"], "n", ["a"], ["v"]).collect()


def test_patch_to_null(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    patches = spark.createDataFrame([(1, None)], "k int, v double")
    assert rows(values.patch(df, "v", patches, ["k"])) == [(1, None), (2, 3.0)]


def test_trace_keeps_every_draw(spark, tmp_path):
    """mi_trace returns each draw of each chain."""
    draws = [(e, f"2024-01-01 00:00:{e:02d}", e % 2, float(e)) for e in range(10)]
    spark.createDataFrame(draws, "event_id long, ts string, user_id long, value double").withColumns(
        {"ts": F.col("ts").cast("timestamp_ntz"), "event_type": F.lit("x")}).write.parquet(str(tmp_path / "events.parquet"))
    got = rows(QUERIES["mi_trace"](spark, str(tmp_path)))
    assert got == [(e, sum(range(e % 2, e + 1, 2)) / (e // 2 + 1), e // 2 + 1) for e in range(10)]
