"""Columns on text and clocks against plain Python."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import clock as C
from colloquy.functions import text as X

ALPHABET = "aZ09 .,-:\t\n\r   　\u001cé王はア한・-"


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=24), min_size=1, max_size=30))
def test_white_space_as_in_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").select("x", X.strip("x").alias("s"), X.one_line("x").alias("l"), X.word_count("x").alias("n"), X.blank("x").alias("b"), F.size(X.full_lines("x")).alias("f"))
    for r in df.collect():
        assert r["s"] == r["x"].strip()
        assert r["l"] == " ".join(r["x"].split())
        assert r["n"] == len(r["x"].split())
        assert r["b"] == (not r["x"].strip())
        assert r["f"] == sum(bool(x.strip()) for x in r["x"].split("\n"))


@pytest.mark.parametrize("sec,mark", [(-1, "0:00"), (0, "0:00"), (59.9, "0:59"), (60, "1:00"), (3599, "59:59"), (3600, "1:00:00"), (5025, "1:23:45")])
def test_clock(spark, sec, mark):
    assert one(spark, float(sec), C.clock(F.col("x")), "double") == mark
    assert one(spark, mark, C.clock_seconds("x")) == max(0, int(sec))


@pytest.mark.parametrize("item,sec,text", [("x [1:02:03]", 3723, "x"), ("x [0:12] [c0]", -1, "x [0:12] [c0]"), ("x", -1, "x"), ("x [0:12] ", 12, "x")])
def test_anchor(spark, item, sec, text):
    assert one(spark, item, C.anchor_seconds("x")) == sec
    assert one(spark, item, C.without_anchor("x")) == text


@pytest.mark.parametrize("answer,faith,invert", [("FAITH: 10\nINVERT: yes", 1, True), ("garbage", 0, False), ("COVER: 3 FAITH:4 INVERT: NO", 4, False), ("faith: 4\nInvert: Yes", 0, True), ("FAITH: 2 invert:yEs", 2, True)])
def test_judge_answers(spark, answer, faith, invert):
    j = one(spark, answer, X.judged(F.col("x")))
    assert (j["faith"], j["invert"]) == (faith, invert)


def test_scripts(spark):
    assert not one(spark, "王・陳", X.has_kana("x"))
    assert one(spark, "ア", X.has_kana("x")) and one(spark, "한", X.has_hangul("x")) and one(spark, "É Z", X.has_latin("x"))


def test_small_helpers(spark):
    assert one(spark, "<think>a\nb</think>c", X.without_thinking("x")) == "c"
    assert one(spark, '\n 「標題」 \nz', X.title_of("x")) == "標題"
    assert one(spark, "v", X.filled("a {q} 100% {z}", q=F.col("x"))) == "a v 100% {z}"
    assert one(spark, "c9, c0 then c2 and c1", X.reread_ids("x", F.lit(3))) == [0, 2]
    assert one(spark, None, X.blank("x")) is True
