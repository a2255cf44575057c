from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import curate as U
from colloquy.operators import gates as G

NOTES = "TITLE: a b\nSUMMARY:\n- x\nDECISIONS:\n-\nACTIONS:\n- A: do\nOPEN:\n-\nTOPICS:\n- t"
TARGET = "target_id long, meeting_id string, source string, split string, task string, phase string, lang string, prompt string, completion string, meta struct<style:string,tgt:string>, judge struct<faith:int,invert:boolean>"


def ask(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("text,ok", [
    (NOTES, True), (NOTES.replace("OPEN:\n-\n", ""), False), (NOTES.replace("OPEN", "TOPICS", 1), False), (NOTES.replace("SUMMARY:", "SUMMARY: x"), False),
    (NOTES.replace("- x", "  - x"), False), (NOTES.replace("- x", "- none"), False), (NOTES.replace("a b", " ".join("abcdefghijk")), False), (NOTES.replace("a b", ""), False), ("", False), ("x" + NOTES, False),
])
def test_notes(spark, text, ok):
    assert ask(spark, G.notes_ok("x"), x=text) is ok


@pytest.mark.parametrize("lang,text,ok", [("en", " ".join("a" * 10), True), ("en", " ".join("a" * 11), False), ("zh-TW", "王" * 20, True), ("zh-TW", "王" * 21, False), ("en", 'a "b"', False), ("en", "a\nb", False), ("en", "a" * 91, False)])
def test_titles(spark, lang, text, ok):
    assert ask(spark, G.title_ok("l", "x"), l=lang, x=text) is ok


@pytest.mark.parametrize("lang,text,ok", [("zh-TW", "王・陳", True), ("zh-TW", "王ア", False), ("zh-TW", "王한", False), ("zh-TW", "abc", False), ("en", "abc", True), ("en", "abc 王", False), ("en", " - ", True), ("zh-TW", "-", True), ("fr", "王", True)])
def test_languages(spark, lang, text, ok):
    assert ask(spark, G.lang_ok("l", "x"), l=lang, x=text) is ok


@pytest.mark.parametrize("judge,ok", [(None, True), ((5, False), True), ((4, False), True), ((3, False), False), ((0, False), True), ((5, True), False), ((0, True), False), ((None, None), True)])
def test_judge(spark, judge, ok):
    assert spark.createDataFrame([(judge,)], "judge struct<faith:int,invert:boolean>").select(G.judge_ok().alias("y")).first()["y"] is ok


@pytest.mark.parametrize("text,bad", [("Sure, here", True), ("x\n## h", True), ("surely", False), ("以下是", True), ("好的,", True), ("<think>", True), ("plain", False)])
def test_preamble(spark, text, bad):
    assert ask(spark, G.has_preamble("x"), x=text) is bad


def test_bullets_and_length(spark):
    assert ask(spark, G.plain_bullets("x"), x="• a \n  * b\t\n– c\n-d ") == "- a\n  - b\n- c\n-d"
    assert ask(spark, G.too_long("x"), x="\n".join("a" * 13)) is True and ask(spark, G.too_long("x"), x="a" * 1200) is False
    assert ask(spark, G.format_ok("t", "x", "l"), t="summarize", x="a" * 1601, l="en") is False
    assert ask(spark, G.format_ok("t", "x", "l"), t="title", x=" ", l="en") is False


def targets(spark, *rows):
    full = []
    for i, (prompt, completion, judge, split, phase) in enumerate(rows):
        full.append((i, "m", "s", split, "actions", phase, "en", prompt, completion, (None, None), judge))
    return spark.createDataFrame(full, TARGET)


def test_identity_comes_before_gates(spark, rows):
    t = targets(spark, ("p", "* bad text", (2, False), "train", "single"), ("p", "- bad text ", None, "train", "single"), ("p", "good text", None, "dev", "single"), ("p", "inv", (5, True), "val", "single"), ("p", "r", None, "val", "reduce"), ("q", None, None, "val", "single"), ("q", "Sure, x", None, "val", "single"))
    assert rows(U.outcomes(t, ["target_id"]), "target_id", "outcome") == [(0, "lowfaith"), (1, "dup"), (2, "kept"), (3, "inverted"), (4, "reduce"), (5, "filtered"), (6, "filtered")]
    kept = U.training_rows(t, ["target_id"]).collect()
    assert len(kept) == 1 and kept[0]["split"] == "train" and [m["role"] for m in kept[0]["messages"]] == ["system", "user", "assistant"]
    assert {(r["outcome"], r["n"]) for r in U.outcome_counts(t, ["target_id"]).collect()} == {("lowfaith", 1), ("dup", 1), ("kept", 1), ("inverted", 1), ("reduce", 1), ("filtered", 2)}


def test_routes_and_order(spark, rows):
    df = spark.createDataFrame([("train",), ("val",), ("test",), ("dev",), (None,)], "split string")
    assert rows(df.select(U.route().alias("r"))) == [("test",), ("train",), ("train",), ("train",), ("val",)]
    a, b = spark.createDataFrame([(1, 5)], "id int, j int"), spark.createDataFrame([(2,)], "id int")
    assert rows(U.in_order(a, b), "src_rank", "id", "j") == [(0, 1, 5), (1, 2, None)]


def test_resume_shards_caps(spark, rows):
    work = spark.createDataFrame([(i, f"s{i % 2}", 10 - i) for i in range(10)], "id int, source string, size int")
    assert rows(U.still_to_do(work, work.filter("id < 8"), ["id"]), "id") == [(8,), (9,)]
    parts = [U.shard(work, ["id"], 3, k).count() for k in range(3)]
    assert sum(parts) == 10
    assert rows(U.cap_per_source(work, {"s0": 2}, [F.desc("size")]), "id") == [(0,), (1,), (2,), (3,), (5,), (7,), (9,)]
    assert [r["id"] for r in U.shuffled(work, ["id"], 1, 4).collect()] == [r["id"] for r in U.shuffled(work, ["id"], 1, 4).collect()]
    m = spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], "messages array<struct<role:string,content:string>>")
    x = m.select(U.prompt_and_completion().alias("x")).first()["x"]
    assert len(x["prompt"]) == 1 and x["completion"][0]["content"] == "a"
    assert U.upweighted(work.limit(2)).count() == 12
