"""Copies, defects and residue of generated records."""

from __future__ import annotations

import random
import re
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import copies as C
from colloquy.llm import defects as D
from colloquy.llm import residue as R
from colloquy.llm.common import required

SCHEMA = "target_id long, meeting_id string, task string, lang string, prompt string, completion string, meta struct<style:string,tgt:string>, id string, canon string, kind string"


def targets(spark, *rows):
    """(id, prompt, completion[, lang, tgt, task]) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(r[0], "m", r[5] if len(r) > 5 else "summarize", r[3] if len(r) > 3 else "en", r[1], r[2], (None, r[4] if len(r) > 4 else None), "x", "y", "z") for r in rows], SCHEMA)


HEAD = "Task: Sum up.\nOutput language: English\nTranscript:\n[0:00] S1: Hello there."


def test_canonical_forms():
    same = [
        (HEAD, "- owner: A B; task: do it; due: May 1"), ("Output language: English\nTask: sum up\nTRANSCRIPT:\n[0:00]  s1 - hello there", "* DUE - May 1 | OWNER - a b | TASK - do it"),
        ("**Task:** Sum up. **Output language:** English **Transcript:** [0:00] S1: Hello there.", '[{"task": "do it", "owner": "A B", "due": "May 1"}]'),
    ]
    assert len({C.canonical_key(*x) for x in same}) == 1
    assert C.canonical_prompt("Task: List it after this meeting.\nOutput language: English\nTranscript:\nhi") == C.canonical_prompt("Output language: English\nTask: list it after this meeting\nTRANSCRIPT:\nhi")
    two = '[{"owner": "A", "task": "x", "due": "1"}, {"owner": "B", "task": "y", "due": "2"}]'
    moved = '[{"owner": "B", "task": "x", "due": "1"}, {"owner": "A", "task": "y", "due": "2"}]'
    assert C.canonical_completion(two) != C.canonical_completion(moved)
    notes = "TITLE: T\nSUMMARY:\n- The plan stays open: A and B\nOPEN:\n-\nTOPICS:\n- t"
    shuffled = "TOPICS:\n* t\nTITLE: t\nOPEN:\n-\nSUMMARY:\n* the plan stays open - A and B"
    assert C.canonical_completion(notes) == C.canonical_completion(shuffled) != C.canonical_completion(notes.replace("- t", "- u"))
    assert C.canonical_completion(notes.replace("\n", " ")) == C.canonical_completion(notes)
    assert C.canonical_key(None, None) == C.canonical_key("", " \n")


def test_find_copies(spark, rows):
    t = targets(spark, (5, "p", "a b"), (3, "P!", "A-B"), (3, "P!", "A-B"), (9, "p", "a c"), (7, None, None), (8, "", "..."), (None, "p", "ab"), (6, "q" * 100_000, "z"), (4, "Q" * 100_000, "Z"))
    for hot in (1, 100):
        assert rows(C.find_copies(t, hot_rows=hot, salts=2)) == [(3, 5), (4, 6), (7, 8)]
        assert rows(C.collapse_copies(t, hot_rows=hot, salts=2)) == [(3, 3), (4, 2), (7, 2), (9, 1)]
    assert C.find_copies(t.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=20), max_size=6), st.integers(1, 8))
def test_partial_counts_miss_little(parts, room):
    rows = sum(map(len, parts))
    counts = pd.Series(dtype="float64")
    for part in parts:
        counts = C.summed(counts, pd.Series(part, dtype="int64").value_counts(), room)
    assert len(counts) <= room
    for k in range(10):
        true = sum(p.count(k) for p in parts)
        assert true - rows / room <= counts.get(k, 0) <= true


def test_hot_keys_exactly(spark, rows):
    data = [(i, bytes([i % 97 % 7, min(i % 97, 9)])) for i in range(2000)]
    keys = spark.createDataFrame(data, "id long, canon binary").repartition(5)
    counts = Counter(k for _, k in data)
    for hot in (1, 20, 100, 400, 5000):
        assert {bytes(r["canon"]) for r in C.hot_keys(keys, hot).collect()} == {k for k, n in counts.items() if n > hot}
        got = {bytes(r["canon"]): (r["kept_id"], r["copies"]) for r in C.copy_groups(keys, hot, 3).collect()}
        assert got == {k: (min(i for i, x in data if x == k), n) for k, n in counts.items()}


def longest_runs(item, text, least):
    """Greedy brute force: from each position the longest run that stands in the text."""
    covered, i = set(), 0
    for i in range(len(item)):
        n = 0
        while i + n < len(item) and any(text[j : j + n + 1] == item[i : i + n + 1] for j in range(len(text) - n)):
            n += 1
        if n >= least:
            covered.update(range(i, i + n))
    return covered


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=24), st.lists(st.sampled_from("abcd"), max_size=18), st.integers(1, 4))
def test_suffix_automaton(text, item, least):
    runs = D.SuffixAutomaton(text).runs(item, least)
    covered = {k for s, e, _ in runs for k in range(s, e)}
    assert covered == longest_runs(item, text, least)
    assert all(text[at : at + e - s] == item[s:e] for s, e, at in runs)


TALK = st.lists(st.sampled_from(["a", "b", "to", "cab", "hall", "王", "會議"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TALK, TALK, st.sampled_from([" ", ". ", "\n", "-"]))
def test_copy_gate_refuses_no_copy(prompt, answer, sep):
    """The gate before the automaton is implied by what it gates."""
    p, c = "Transcript:\n" + sep.join(prompt), sep.join(answer)
    assert D.is_copied(p, c) == D.is_copied(p, c, gate=False)


def test_copies_in_short_runs():
    """Runs of exactly four short words with own words between, and short lines without their marks."""
    rng = random.Random(4)
    own = [f"w{i}" for i in range(80)]
    body = " ".join(own)
    answer = " ".join(" ".join(own[i : i + 4]) + (f" x{i}" if rng.random() < 0.9 else "") for i in range(0, 80, 4))
    assert D.is_copied(f"transcript:\n{body}", answer) and D.may_copy(body, D.WORD.findall(answer))
    lines = [f"[0:{i:02d}] s1: ok then {i}" for i in range(30)]
    assert D.is_copied("transcript:\n" + "\n".join(lines), "\n".join(x.split("] ")[1] for x in lines))


def test_ends_that_are_seldom():
    assert D.cut_off(0, 100, 0, 0, 0) and D.cut_off(5, 100, 0, 100, 2) and not D.cut_off(5, 100, 0, 30, 2) and not D.cut_off(5, 100, 0, 100, 0) and not D.cut_off(20, 100, 0, 200, 1)


FULL = "The Vice Clerk must fund the old bridge after Project Roe closes in May. A plan to map the wall waits until June 3."


def test_verdicts():
    say = lambda c, due="en", p=HEAD, task="summarize": D.verdict(p, c, due, task, None)
    for c in (None, "", " \n", "​ 　", "** **", "```\n```", "<think>hm</think>\n", '""', "<p></p>"):
        assert say(c) == "empty", c
    assert say("-") is None and say(" - \n") is None
    assert say("I'm sorry, but I can't help with this recording.") == say("抱歉，我無法提供這份紀錄。", "zh-TW") == "refusal"
    assert say("Sorry to lose the hall, the depot cannot fund it by May 2. Unable to judge the wall, Project Roe declined to release 4 figures.") is None
    body = " ".join(f"word{i} said thing{i}" for i in range(40))
    assert say(body, p=f"Task: Sum up.\nTranscript:\n{body}") == say("Sure! Here you go:\n" + body.upper(), p=f"Task: Sum up.\nTranscript:\n{body}") == "copied_prompt"
    assert say("Sum up this whole meeting in a few words.", p="Task: Sum up this whole meeting in a few words.\nTranscript:\nx y") == "copied_prompt"
    assert say("Die Leiterin meldete 3 Fehler im Bericht und die Gruppe ist nicht zufrieden.") == say(FULL, "zh-TW") == say("會議同意在五月前重漆大廳，並由秘書回報。") == "wrong_language"
    assert say("會議同意在五月前重漆大廳，並由秘書回報。", "zh-TW") is None and say(FULL) is None and say(FULL, None) is None
    assert say(FULL[:-9]) == say('[{"owner": "A", "task') == say("- A: do it (due: Ma") == say("- owner: A, task: do") == "truncated"
    assert say("{{summary}} will test the hall.") is None


def test_find_defects(spark, rows):
    good = [(i, HEAD, f"- The Vice Clerk must fund the old bridge after Project Roe closes in May\n- A plan to map the wall waits until June {i % 9 + 1}") for i in range(100, 180)]
    t = targets(spark, *good, (1, HEAD, None), (1, HEAD, None), (2, None, "x" * 50_000), (3, HEAD, "- A plan to map the wall waits until June 2\n- The Vice Clerk must fund the old"), (4, HEAD, "I must decline to write about this."), (5, HEAD, "會議同意在五月前重漆大廳。", "en", "zh-TW"), (6, HEAD, "會議同意在五月前重漆大廳。", None, None), (None, HEAD, ""))
    assert rows(D.find_defects(t)) == [(1, "empty"), (3, "truncated"), (4, "refusal")]
    assert D.find_defects(t.limit(0)).count() == 0


def test_residue_kinds():
    cases = {
        "placeholder": ["{{summary}}", "The ${owner} will test it.", "[insert title here]", "負責人:【待補:姓名】", "TODO: add date", "____ (fill in owner)", "決議:○○○", "Title: <YOUR TITLE HERE>", "<會議標題>", "專案組長說明<會議標題>的費用。", "【Insert title here】", "【Your name】 will test it."],
        "filler_text": ["Lorem ipsum dolor sit amet.", "- Item 1\n- Item 2\n- Item 3", "測試內容測試內容測試內容", "Sample text sample text sample text.", "This is placeholder copy. Your text goes here.", "- 要點一\n- 要點二", "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris.", "Excepteur sint occaecat cupidatat non proident, sunt in culpa."],
        "error_page": ["502 Bad Gateway", "<html><head><title>404 Not Found</title></head></html>", '{"error": {"code": 5}}', "系統忙線中,請稍後再試。", "Your session has expired. Please sign in again to continue.", "Traceback (most recent call last):\nTimeoutError: deadline exceeded", FULL + "\nHTTP 429: too many requests."],
        "script_notice": ["Please enable JavaScript to view this page.", "您的瀏覽器已停用指令碼，請開啟後重新整理。", "This site requires JavaScript."],
        None: [FULL, "-", "", None, "A 404 error seen last week on the old site was explained as a cable fault.", "One member asked why the page asks visitors to enable scripts.", "有人問收費表的範本裡為何還有假文字。", "The group laughed at the lorem ipsum left in the mock-up of the hall.", "The clerk will fill in the blanks of the template by hand.", "與會者談到倉庫的網頁上週出現錯誤訊息。"],
    }
    for kind, texts in cases.items():
        for t in texts:
            assert R.residue_kind(t) == kind, t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["【Your name】", "Ut enim ad minim veniam quis nostrud", "the hall was fine", "<會議標題>", "會議在五月", "404 Not Found", "Item 1", "-", "<聽不清>", "enable JavaScript"]), min_size=1, max_size=5), st.sampled_from([". ", "\n", "。"]))
def test_a_text_holds_what_its_units_hold(parts, sep):
    """Nothing before the patterns keeps them from a unit: a text with a placeholder, a notice or an error says so."""
    text = sep.join(parts)
    kinds = {R.unit_kind(u) for u in R.units(R.bare(text))} - {"filler_text", None}
    assert not kinds or R.residue_kind(text) in kinds


PIECES = sorted({w for p in (R._SLOT, R._SCRIPT, R._ERROR) for w in required(p)} | set("ab _<>{}%[]()【】○x4五。. \n") | {"lo", "todo", "TBD".lower(), "enable", "http 5", "03", "here>"})


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_gate_keeps_every_match(text):
    """A pattern that the gate leaves out has no match in the text nor in a unit of it."""
    may = R.GATE.may(text)
    for name, p in (("slot", R._SLOT), ("script", R._SCRIPT), ("error", R._ERROR)):
        assert may[name] or not p.search(text) and not any(p.search(u) for u in R.units(text))
    for u in R.units(text):
        assert R.unit_kind(u, may=may) == R.unit_kind(u)


def test_required_literals():
    assert required(re.compile(r"ab+c|(?:xy)?z{3}")) == {"a", "zzz"} or required(re.compile(r"ab+c|(?:xy)?z{3}")) == {"b", "zzz"} or required(re.compile(r"ab+c|(?:xy)?z{3}")) == {"c", "zzz"}
    assert required(re.compile(r"(?<!q)[12]\d+ (?:foo|bar)\b")) in ({"foo", "bar"}, {" foo", " bar"}, {"1", "2"}, {" "})
    for bad in (r"\d+", r"a|\w", r"(?:ab)?"):
        with pytest.raises(ValueError):
            required(re.compile(bad))
    with pytest.raises(ValueError):
        required(re.compile("ab", re.I))


def test_combined_evidence(spark, rows):
    """Duplicated, mismatched responses of any length are residue if a word hints at a kind or the body says its title again; refusals and foreign answers are not."""
    page = "Depot unavailable {}\n" + "\n".join("The depot is unavailable" for _ in range(30))
    again = "Zorvex plimta\n\nzorvex PLIMTA"
    other = "担当者は次回までに資料をそろえる予定です。予算についてはまだ結論が出ていません。"
    decline = "I apologize; I have no access to the transcript you mention."
    own = [(100 * k + i, f"about hall {i}", text.format(i)) for k, text in enumerate((page, again, other, decline)) for i in range(6)]
    few = [(1000 + i, "p", again + " q") for i in range(3)]
    kept = [(2000 + i, "Zorvex plimta and more of it", again + "!") for i in range(6)]  # its own prompt speaks of it
    t = targets(spark, *own, *few, *kept).withColumn("meeting_id", F.col("target_id").cast("string"))
    got = {}
    for i, kind in rows(R.find_residue(t)):
        got.setdefault(i // 100, set()).add(kind)
    assert got == {0: {"error_page"}, 1: {"filler_text"}}


def test_meaningless_words_need_the_corpus(spark):
    rng = random.Random(3)
    words = sorted(R._LATIN | set(FULL.lower().replace(".", "").split()) | {w for v in D._STOP.values() for w in v.split() if w.isascii()})
    t = targets(spark, *((i, "p", " ".join(rng.choices(words, k=40))) for i in range(600)), (900, "p", "qzxvk wqjz xkcdq vvzqk"))
    model = R.Letters(R.letter_counts(t, "completion"))
    assert R.residue_kind("qzxvk wqjz xkcdq vvzqk", model, "about halls") == "filler_text" and R.residue_kind("qzxvk wqjz xkcdq vvzqk", model, "What are the codes qzxvk and wqjz?") is None
    assert R.residue_kind("qzxvk wqjz xkcdq vvzqk", model) == "filler_text" and R.residue_kind(FULL, model) is None


def test_find_residue(spark, rows):
    pages = [(200 + i, f"about hall {i}", f"Upstream pool drained, ticket {i}.", "en") for i in range(6)]
    t = targets(spark, (1, "p", "{{x}}"), (1, "p", "{{x}}"), (2, "p", None), (3, None, "Service Unavailable"), (None, "p", "{{x}}"), *pages)
    t = t.withColumn("meeting_id", t["target_id"].cast("string"))
    titles = targets(spark, *((300 + i, "p", "戶外測試台與杉林專案") for i in range(9))).withColumn("meeting_id", F.col("target_id").cast("string"))
    assert R.find_residue(titles).count() == 0
    assert set(rows(R.find_residue(t))) == {(1, "placeholder"), (3, "error_page"), *((200 + i, "error_page") for i in range(6))}
    assert rows(R.without_residue(t.filter("target_id < 100")), "target_id") == [(2,)]
    assert R.find_residue(t.limit(0)).count() == 0
