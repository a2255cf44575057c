from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import evaluation as E
from colloquy.operators import notes as N
from colloquy.operators import preferences as P


def items(spark, text, lenient=False):
    df = spark.createDataFrame([(1, text)], "meeting int, notes string")
    return [(r["section"], r["text"], r["at_sec"]) for r in N.note_items(df, ["meeting"], "notes", lenient).orderBy("seq").collect()]


def test_parsers_differ_outside_sections(spark):
    text = "- early\nSUMMARY:\n* one [1:05]\n-\nFOO:\n- under\nTOPICS：\n• two"
    assert items(spark, text) == [("SUMMARY", "one", 65), ("TOPICS", "two", -1)]
    assert items(spark, text, True) == [("SUMMARY", "early", -1), ("SUMMARY", "under", -1)]
    assert items(spark, "<think>\n- no\n</think>plain words that go on for long\nshort", True) == [("SUMMARY", "plain words that go on for long", -1)]
    assert items(spark, None) == [] and items(spark, "", True) == []


def test_merge_cap_render(spark):
    rows = [(1, "SUMMARY", 0, 0, "Ship it!", 30), (1, "SUMMARY", 1, 0, "ship  it", 5), (1, "SUMMARY", 1, 1, "late", -1), (1, "OPEN", 0, 2, "q", 7)]
    df = spark.createDataFrame(rows, "meeting int, section string, chunk int, seq int, text string, at_sec int")
    merged = N.merge_notes(df)
    assert [(r["section"], r["text"], r["rank"]) for r in merged.orderBy("section", "rank").collect()] == [("OPEN", "q", 1), ("SUMMARY", "late", 1), ("SUMMARY", "Ship it!", 2)]
    assert N.capped(merged, {"SUMMARY": 1}).filter("section = 'SUMMARY' and over").count() == 1
    meetings = spark.createDataFrame([(1, " T "), (2, None)], "meeting int, title string")
    got = {r["meeting"]: r["notes"] for r in N.render_notes(merged, meetings, anchors=True, title="title").collect()}
    assert got[1] == "TITLE: T\nSUMMARY:\n- late\n- Ship it! [0:30]\nDECISIONS:\n-\nACTIONS:\n-\nOPEN:\n- q [0:07]\nTOPICS:\n-"
    assert got[2] == "SUMMARY:\n-\nDECISIONS:\n-\nACTIONS:\n-\nOPEN:\n-\nTOPICS:\n-"
    assert {(r["section"], tuple(r["chunks"])) for r in N.chunks_of(merged).collect()} == {("SUMMARY", (1, 0)), ("OPEN", (0,))}
    assert spark.range(1).select(N.bullets(F.lit("x\n- a\n • b\n-\n- -")).alias("b")).first()["b"] == ["a", "b"]


def test_evidence(spark, rows):
    lines = spark.createDataFrame([(1, i, i * 10, f"l{i}") for i in range(6)] + [(2, 0, 5, "m0")], "meeting int, line_no int, start_sec int, line string")
    its = spark.createDataFrame([(1, 12), (1, -1), (2, 1)], "meeting int, at_sec int")
    assert rows(N.evidence(its, lines), "meeting", "line_no") == [(1, 1), (1, 2), (1, 3), (2, 0)]
    assert N.evidence(its, lines, most=2).filter("meeting = 1").count() == 2


def candidates(spark, *rows):
    return spark.createDataFrame([(p, k, c, f, i) for p, k, c, f, i in rows], "prompt string, k int, completion string, faith int, invert boolean")


def test_pairs(spark):
    df = candidates(spark, ("a", 0, "x", 5, False), ("a", 1, "y", 5, False), ("a", 2, "z", 1, False), ("a", 3, "w", 0, True), ("b", 0, "x", 5, False), ("b", 1, "y", 5, False), ("c", 0, "x", 5, False), ("c", 1, " ", 1, False), ("d", 0, "s", 5, False), ("d", 1, "s", 2, False), ("e", 0, "s", None, None), ("e", 1, "t", 0, False))
    got = P.pairs(df, ["prompt"]).collect()
    assert [(r["prompt"], r["chosen"], r["rejected"], r["rejected_inverted"]) for r in got] == [("a", "x", "w", True)]
    assert tuple(P.pair_stats(df, ["prompt"]).first()) == (4, 1, 1)


def test_dimensions(spark, rows):
    t = spark.createDataFrame([("notes",), ("zzz",)], "task string")
    caps = spark.createDataFrame(list(P.MAX_TOKENS.items()), "task string, max_tokens int")
    assert rows(P.max_tokens(t, caps)) == [("notes", 640), ("zzz", 384)]
    assert spark.range(1).select(P.temperatures(3).alias("t")).first()["t"] == [0.0, 0.9, 0.9]


def test_reports(spark):
    r = [("m", 0, 5, 4, False, 1, 10, "SUMMARY:\n-", None), ("m", 3999, 0, 0, False, 2, 11, "SUMMARY:\n- x", None), ("m", 4000, 3, 2, True, 3, 13, None, None), ("m", 12000, None, None, None, None, None, None, "boom")]
    df = spark.createDataFrame(r, "mode string, ntok int, faith int, cover int, invert boolean, calls int, prompt_tokens int, notes string, error string")
    m = E.by_mode(df).first()
    assert (m["n"], m["prompt_tokens"], m["calls"]) == (3, 11, 2.0) and abs(m["empty"] - 2 / 3) < 1e-9 and abs(m["faith_le2"] - 1 / 3) < 1e-9
    assert {(x["bucket"], x["n"]) for x in E.by_length(df).collect()} == {("short", 2), ("medium", 1)}
    assert df.select(E.upper_median("calls").alias("m")).first()["m"] == 2
    four = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int")
    assert four.select(E.upper_median("x").alias("m")).first()["m"] == 3
    assert E.report(E.by_length(df), df.limit(1)).first()["report"].startswith('{"agg":[{"bucket":')
    with pytest.raises(ValueError):
        E.cases(df, four, most=2)
    g = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("b", 7), ("b", None), ("c", 1), ("c", 9)], "k string, x int")
    assert sorted(tuple(r) for r in E.upper_medians(g, ["k"], "x").collect()) == sorted(tuple(r) for r in g.groupBy("k").agg(E.upper_median("x")).collect())
    assert [r["part"] for r in E.report_lines(E.by_length(df), df).orderBy("part").collect()] == ["agg"] * 2 + ["results"] * 4


@pytest.mark.parametrize("n,bucket", [(0, "short"), (3999, "short"), (4000, "medium"), (11999, "medium"), (12000, "long"), (None, "short")])
def test_buckets(spark, n, bucket):
    assert spark.createDataFrame([(n,)], "ntok int").select(E.length_bucket().alias("b")).first()["b"] == bucket
