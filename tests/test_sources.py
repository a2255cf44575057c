from __future__ import annotations

import json

from pyspark.sql import functions as F

from colloquy.functions import tokens as K
from colloquy.operators import agent as A
from colloquy.operators import external as X
from colloquy.operators import normalise as N
from colloquy.operators import notes as T
from colloquy.operators import planning as P
from colloquy.operators import vectors as V
from colloquy.operators import vocabulary as Y
from colloquy.sources import jsonl as J
from colloquy.streaming import resume as R


def test_normalisers(spark, tmp_path):
    folder = tmp_path / "raw" / "train"
    folder.mkdir(parents=True)
    doc = {"meeting_transcripts": [{"speaker": " A ", "content": "well {vocalsound} yes , it 's  fine ."}, {"speaker": "B", "content": "{gap} ."}, {"speaker": " ", "content": "ok"}], "general_query_list": [{"query": "q", "answer": "sum"}, {"query": "q2", "answer": "a2"}], "specific_query_list": [{"query": "s", "answer": "t"}], "topic_list": [{"topic": "x"}]}
    (folder / "M1.json").write_text(json.dumps(doc))
    raw = J.json_documents(spark, str(tmp_path / "raw"), N.RAW["qmsum"].replace(", file string, split string", ""))
    m = N.normalise("qmsum", raw).first()
    assert m["id"] == "qmsum-train-M1" and [tuple(u) for u in m["utterances"]] == [("A", "well yes, it's fine."), (None, "ok")]
    assert m["refs"]["summary"] == "sum" and [q["query"] for q in m["refs"]["queries"]] == ["q2", "s"] and m["refs"]["topics"] == ["x"] and m["meta"] == {"file": "M1.json"}

    def rows(name, *values):
        return spark.createDataFrame(list(values), N.RAW[name])

    b = N.from_meetingbank(rows("meetingbank", ("u", " One. Two?  Three ", " ", "validation"))).first()
    assert b["id"] == "meetingbank-val-u" and [u["text"] for u in b["utterances"]] == ["One.", "Two?", "Three"] and b["refs"]["summary"] is None
    d = N.from_dialogsum(rows("dialogsum", ("7", "#Person1#: hi: you\n\nBob : yo\nno colon\nA:", "s", None, "train"))).first()
    assert [tuple(u) for u in d["utterances"]] == [("Person 1", "hi: you"), ("Bob", "yo"), (None, "no colon"), ("A", "")]
    v = N.from_vcsum(rows("vcsum", ("1", "一\n\n二", None, ["三"], None, "9", "dev"), ("2", " \n", "x", None, None, None, "test")), lambda c: F.replace(c, F.lit("三"), F.lit("參"))).collect()
    assert len(v) == 1 and v[0]["id"] == "vcsum-val-1" and v[0]["refs"]["segment_summaries"] == ["參"] and v[0]["refs"]["agenda"] is None
    assert v[0].asDict().keys() == m.asDict().keys()


def test_lines_and_sinks(spark, tmp_path, rows):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2, "z": 0}\n')
    got = J.json_lines(spark, str(p), "a int", tolerant=True)
    assert rows(got) == [(1,), (2,)]
    out = str(tmp_path / "out")
    J.write_splits(spark.createDataFrame([(1, "train"), (2, "dev"), (3, "val")], "a int, split string"), out)
    assert rows(spark.read.json(out), "a", "split") == [(1, "train"), (2, "train"), (3, "val")]
    J.write_lines(spark.range(1), out, "ignore")
    assert spark.read.json(out).count() == 3
    assert J.overlaid({"a": 1, "b": 1}, {"b": 2}) == {"a": 1, "b": 2}


def test_external_calls(spark, rows):
    def make():
        def client(row):
            if row["x"] == 2:
                raise RuntimeError("down")
            return f"<{row['x']}>"

        return client

    df = X.called(spark.createDataFrame([(1,), (2,)], "x int"), make, retries=2, wait=0.0)
    assert rows(df, "x", "answer", "error") == [(1, "<1>", None), (2, None, "RuntimeError: down")]


def test_agent_modes(spark, rows):
    chunks = spark.createDataFrame([(1, 0, "alpha"), (1, 1, "beta"), (2, 0, "gamma")], "meeting int, chunk int, chunk_text string")

    def make():
        def client(row):
            p = row["prompt"]
            if p.startswith("ask"):
                return "c1 and c7"
            word = p.split()[-1]
            return f"DECISIONS:\n- do {word} [0:0{len(word)}]\nTOPICS:\n- {word}" if p.startswith("map") else f"{p[4:]}"

        return client

    items = A.map_notes(chunks, "map {chunk}", make)
    assert rows(items, "meeting", "chunk", "section", "text", "at_sec")[0] == (1, 0, "DECISIONS", "do alpha", 5)
    both = A.reread_notes(items, chunks, "ask {items}", "map more {chunk}", make)
    assert both.filter("reading = 1").select("meeting", "chunk").distinct().collect() == [(1, 1)]
    merged = A.final_notes(both)
    assert rows(merged.filter("section = 'TOPICS'"), "meeting", "text") == [(1, "alpha"), (1, "beta"), (2, "gamma")]
    assert rows(A.over_cap(merged, {"TOPICS": 1})) == [(1, "TOPICS", "- alpha\n- beta")]


def test_running_notes_carry_the_merged_state(spark, rows):
    """Every chunk's items stay; each prompt holds the notes so far; items come with their chunk, exact repeats of a chunk once, ordered by the mark that ends them."""
    prompts = spark.sparkContext.accumulator(0)

    def make():
        def client(row):
            assert ("Notes so far" in row["prompt"]) == ("beta" in row["prompt"].split("\n\n")[-1]), row["prompt"]
            prompts.add(1)
            word = row["prompt"].split()[-1]
            return f"<think>x</think>DECISIONS:\n- do {word}\n- do {word}\nTOPICS:\n- shared [c0]\n-"

        return client

    chunks = spark.createDataFrame([(1, 1, "beta"), (1, 0, "alpha"), (2, 0, None)], "meeting int, chunk int, chunk_text string")
    got = {r["meeting"]: (r["calls"], r["notes"]) for r in A.running_notes(chunks, "sum up {chunk}", make).collect()}
    assert got[1] == (2, "SUMMARY:\n-\nDECISIONS:\n- do alpha [c0]\n- do beta [c1]\nACTIONS:\n-\nOPEN:\n-\nTOPICS:\n- shared [c0]\n- shared [c0] [c1]")
    assert got[2][0] == 1 and prompts.value == 3


def test_parsed_reads_as_note_items_do(spark):
    texts = ["- a\nSUMMARY:\n- one [1:05]\n-\nFOO:\n- under\nTOPICS：\n- two\n* no", "<think>\n- no\n</think>plain words that go on for long\nshort", "", "OPEN:\nx", "TOPICS:", "- -\n-  x "]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, notes string")
    want = {}
    for r in T.note_items(df, ["k"], "notes", lenient=True).orderBy("k", "seq").collect():
        want.setdefault(r["k"], {}).setdefault(r["section"], []).append(r["text"])
    assert want == {k: {s: x for s, x in A.parsed(t).items() if x} for k, t in enumerate(texts) if any(A.parsed(t).values())}
    assert A.merged({"OPEN": ["b [0:09]", "a"]}, {"OPEN": ["a", "c [0:05]"]})["OPEN"] == ["a", "c [0:05]", "b [0:09]"]


def test_reread_asks_for_merged_decisions_first(spark):
    rows = [(1, "ACTIONS", 0, 0, "act", -1), (1, "DECISIONS", 1, 0, "late", 50), (1, "DECISIONS", 0, 1, "early", 5), (1, "DECISIONS", 1, 1, "early", 70), (2, "ACTIONS", 0, 0, "alone", 1), (3, "TOPICS", 0, 0, "t", 1)]
    items = spark.createDataFrame(rows, "meeting int, section string, chunk int, seq int, text string, at_sec int")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (3, 1)], "meeting int, chunk int")
    got = {r["meeting"]: (r["items"], r["n"]) for r in A.contested(items, chunks).collect()}
    assert got == {1: ("- early [c0]\n- late [c1]\n- act [c0]", 2)}


def test_compression_sees_the_evidence_of_its_section(spark, rows):
    items = spark.createDataFrame([(1, "OPEN", i, f"o{i}", i * 10) for i in range(3)] + [(1, "TOPICS", 0, "t0", 40), (1, "TOPICS", 1, "t1", -1), (2, "OPEN", 0, "x", -1)], "meeting int, section string, seq int, text string, at_sec int")
    merged = T.merge_notes(items, order=["seq"])
    lines = spark.createDataFrame([(1, i, i * 10, f"l{i}") for i in range(8)], "meeting int, line_no int, start_sec int, line string")
    got = {r["section"]: (r["items"], r["evidence"]) for r in A.to_compress(merged, lines, {"OPEN": 2, "TOPICS": 1}).collect()}
    assert got == {"OPEN": ("- o0\n- o1\n- o2", "l0\nl1\nl2\nl3\nl4"), "TOPICS": ("- t1\n- t0", "l4\nl5\nl6")}

    def make():
        return lambda row: "- short\n - also \nno" if row["section"] == "OPEN" else "nothing"

    out = rows(A.compressed(merged, lines, {"OPEN": 2, "TOPICS": 1}, "{section} {n} {items} {evidence}", make), "meeting", "section", "rank", "text")
    assert out == [(1, "OPEN", 1, "short"), (1, "OPEN", 2, "also"), (1, "TOPICS", 1, "t1"), (2, "OPEN", 1, "x")]


def test_exact_tokens(spark):
    import os

    import pytest

    if not os.path.exists(K.VOCABULARY):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([("hello hello hello 王小明",), ("",), (None,)], "t string")
    n = [r["n"] for r in df.select(K.token_count("t").alias("n")).collect()]
    plain = K.encoding_of(open(K.VOCABULARY, "rb").read())
    assert n == [len(plain.encode_ordinary("hello hello hello 王小明")), 0, 0]
    assert df.select(K.first_tokens("t", 2).alias("c")).first()["c"] == "hello hello"


def test_corpus_totals_with_tokens(spark):
    lines = spark.createDataFrame([("abcd",), ("efghij",)], "text string")
    r = Y.corpus_size(lines, lambda t: F.length(t) / 2).first()
    assert (r["lines"], r["chars"], r["tokens"], r["chars_per_token"]) == (2, 10, 5, 2.0)
    assert Y.corpus_size(lines.limit(0), F.length).first()["chars_per_token"] is None


def test_counts_of_what_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, utterances array<string>")
    assert J.write_counted(df, str(tmp_path / "x")) == (3, 2) and J.json_lines(spark, str(tmp_path / "x"), df.schema).count() == 3
    assert J.write_counted(df.limit(0), str(tmp_path / "y")) == (0, 0)


def test_converter_changes_characters(spark):
    to = N.converter({"会": "會", "议": "議"})
    assert spark.createDataFrame([("会议x",)], "t string").select(to(F.col("t")).alias("y")).first()["y"] == "會議x"


def test_prompts_by_task_and_language(spark, rows):
    prompts = spark.createDataFrame([("notes", "en", "s", "Notes of {text}", 640), ("notes", "zh-TW", "s", "筆記 {text}", None)], P.PROMPTS)
    work = spark.createDataFrame([(1, "notes", "en", "x"), (2, "notes", "zh-TW", "y"), (3, "other", "en", "z")], "id int, task string, lang string, text string")
    assert rows(P.prompted(work, prompts, text=F.col("text")), "id", "prompt", "max_tokens") == [(1, "Notes of x", 640), (2, "筆記 y", 640), (3, None, 384)]


def test_follow_ups(spark, rows):
    df = spark.createDataFrame([(1, "summarize", "x" * 1201), (2, "summarize", "y"), (3, "notes", "z"), (4, "summarize", " ")], "target_id int, task string, completion string")
    assert rows(P.follow_ups(df), "target_id", "phase") == [(1, "shrink"), (1, "title"), (2, "title")]


def test_durable_copies_can_be_released(spark):
    from colloquy.session import durable, release

    df = durable(spark.range(3), "t")
    assert df.count() == 3 and release(spark) >= 1 and release(spark) == 0


def test_resumable_stream(spark, tmp_path, rows):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    first.coalesce(1).write.parquet(src)
    run = lambda: R.process_new(R.record_stream(spark, src, first.schema), ["id"], out, str(tmp_path / "cp"), lambda df: df.withColumn("done", F.lit(True))).awaitTermination()
    run()
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string").coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(spark.read.parquet(out), "id") == [(1,), (2,), (3,)]


def test_plan_is_stable_and_bounded(spark):
    m = spark.createDataFrame([("a", "en", [("x", "t")]), ("b", "zh-TW", [(None, "t")])], "id string, lang string, utterances array<struct<speaker:string,text:string>>")
    plan = P.plan_variants(m).collect()
    per = {}
    for r in plan:
        per.setdefault(r["id"], []).append(r)
    assert all(6 <= len(v) <= 9 for v in per.values())
    assert {r["variant"]["spk"] for r in per["b"]} == {"none"} and all(r["variant"]["tgt"] in (None, "en") for r in per["b"])
    assert sorted(r["variant_key"] for r in P.plan_variants(m).collect()) == sorted(r["variant_key"] for r in plan)


def test_quantiser(spark):
    q = lambda v, b: spark.createDataFrame([(v,)], "v array<double>").select(V.fake_quantised("v", b).alias("q")).first()["q"]
    assert q([7.0, -7.0, 3.5, 0.0], 4) == [7.0, -7.0, 4.0, 0.0] and q([0.0] * 3, 4) == [0.0] * 3 and q([], 4) == []
    assert len(q([1.0] * 33, 32)) == 33
    mean = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "v array<array<double>>").select(V.mean_vector(F.col("v"), 2).alias("m")).first()["m"]
    assert mean == [2.0, 3.0]


def test_vocabulary(spark, rows):
    lines = spark.createDataFrame([("甲乙丙",), ("甲乙x丙",)] * 4, "text string")
    known = spark.createDataFrame([("乙丙",)], "piece string")
    assert rows(Y.candidates(lines, known, least=4)) == [("甲乙", 8), ("甲乙丙", 4)]
    assert [r["piece"] for r in Y.longest_first(Y.candidates(lines, known, least=4), 1).collect()] == ["甲乙丙"]
