from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import compact as K
from colloquy.operators import transcript as T

MEETING = "row_id long, lang string, utterances array<struct<speaker:string,text:string>>, text string, rank int"


def meetings(spark, *rows):
    return spark.createDataFrame([(i, lang, us, "clash", 7) for i, lang, us in rows], MEETING)


def test_labels_in_order_of_appearance_and_times(spark, rows):
    m = meetings(spark, (1, "en", [("b", "hello  there"), ("a", ""), (None, "x"), ("", "y"), ("b", "again"), ("c", "z")]), (2, "en", None), (3, "en", []))
    got = rows(T.render_lines(m), "row_id", "line_no", "start_sec", "label", "line")
    assert [g[3] for g in got] == ["S1", None, None, "S1", "S3"]
    assert got[0][4] == "[0:00] S1: hello there" and got[1][2] == 1 and [g[1] for g in got] == [0, 1, 2, 3, 4]


def test_styles(spark, rows):
    m = meetings(spark, (1, "en", [("Person 1", "x"), ("Project Manager", "y"), ("spk_3", "z")]))
    named = [r[0] for r in rows(T.render_lines(m, "names").orderBy("line_no"), "label")]
    assert "Project Manager" in named and len(set(named)) == 3 and not any(n.startswith(("Person", "spk")) for n in named)
    assert rows(T.render_lines(m, "names"), "label") == rows(T.render_lines(m, "names"), "label")
    assert {r[0] for r in rows(T.render_lines(m, "none"), "label")} == {None}


def test_parse_line(spark):
    cases = {
        "[0:05] A: x: y": ("0:05", "A", "x: y"), "[0:05] hello": ("0:05", None, "hello"), "A: x": (None, None, "A: x"),
        "[0:05] " + "a" * 41 + ": t": ("0:05", None, "a" * 41 + ": t"), "[0:05] " + "a" * 40 + ": t": ("0:05", "a" * 40, "t"), "": (None, None, ""), "[1:02:03] b: ": ("1:02:03", "b", ""),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string").select("x", T.parse_line("x").alias("p"))
    for r in df.collect():
        assert tuple(r["p"]) == cases[r["x"]]


def test_strip_and_recover(spark):
    one = lambda x, c: spark.createDataFrame([(x,)], "x string").select(c.alias("y")).first()["y"]
    assert one("[0:00] S1: a: b\nplain", T.strip_tags("x")) == "a: b\nplain"
    assert one("Summary:\nq\nTranscript:\none\nTranscript:\ntwo", T.transcript_of(F.col("x"))) == "two"
    assert one("nothing", T.transcript_of(F.col("x"))) == "nothing"
    assert one(None, T.transcript_of(F.col("x"))) is None


def compacted(spark, text, lang="en", **kw):
    got = K.compact(spark.createDataFrame([(1, text)], "row_id long, transcript string"), lang=lang, **kw).collect()
    return got[0]["transcript"] if got else None


def test_compaction(spark):
    assert compacted(spark, "[0:01] S1: a\n[0:02] S2: ok\n[0:03] S1: b") == "[0:01] S1: a b"
    assert compacted(spark, "[0:01] one\n[0:02] two") == "[0:01] one\n[0:02] two"
    assert compacted(spark, "[0:01] S1: uh-huh.") is None and compacted(spark, "[0:01] S1: 對對", "zh") is None
    assert compacted(spark, "[0:01] S1: 我我要", "zh") == "[0:01] S1: 我我要" and compacted(spark, "[0:01] S1: 我我我要", "zh") == "[0:01] S1: 我要"
    assert compacted(spark, "[0:01] S1: the the plan, um, works") == "[0:01] S1: the plan, works"
    assert compacted(spark, "[0:01] S1: a\nbare\n[0:03] S1: b") == "[0:01] S1: a\nbare\n[0:03] S1: b"
    assert compacted(spark, "[0:01] S1: a\n[0:03] S1: b", merge=False) == "[0:01] S1: a\n[0:03] S1: b"
    assert compacted(spark, "[0:01] at 12:30 we") == "[0:01] at 12: 30 we"


def test_merge_after_drops(spark, rows):
    df = spark.createDataFrame([(1, 0, "0:00", "A", "x"), (1, 2, "0:02", "A", "y"), (1, 3, "0:03", None, "n"), (1, 4, "0:04", None, "m"), (2, 0, "0:00", "A", "z")], "row_id long, pos int, ts string, speaker string, text string")
    assert rows(K.merge_adjacent(df, "row_id", "pos")) == [(1, 0, "0:00", "A", "x y"), (1, 1, "0:03", None, "n"), (1, 2, "0:04", None, "m"), (2, 0, "0:00", "A", "z")]
