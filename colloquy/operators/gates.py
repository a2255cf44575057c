"""Predicates that decide whether a generated target may be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.text import SPACE, blank, full_lines, has_han, has_hangul, has_kana, has_latin, strip, word_count

# Openings that are no content, the notes format's keys and its unfilled slots.
PREAMBLE = r"(?Udim)<think>|</think>|^#{1,6}\s|^(here('s| is| are)|sure|okay|certainly|of course)\b|以下是|好的[，,]"
PREAMBLE_EVAL = r"(?Udim)<think>|^#{1,6}\s|^(here('s| is| are)|sure|okay|certainly)\b|以下是"
NOTES_KEYS = ("TITLE:", "SUMMARY:", "DECISIONS:", "ACTIONS:", "OPEN:", "TOPICS:")
NOTES_SLOT = r"(?Udim)owner: task|name: what they|due: deadline|負責人[:：]\s*(工作內容|無)|期限[:：]\s*(無|沒有)|^- (none|n/a|無|沒有)[。.]?$"
LONGEST, MIN_FAITH = 2600, 4


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_lang(lang: Column | str = "lang", target: Column | str = "meta.tgt") -> Column:
    return F.coalesce(F.nullif(_c(target), F.lit("")), _c(lang))


def lang_ok(lang: Column | str, text: Column | str) -> Column:
    """A lone dash is right in every language; languages other than en and zh-TW are not tested."""
    lang, text = _c(lang), _c(text)
    other = has_kana(text) | has_hangul(text)
    return F.when(strip(text) == "-", True).when(lang == "zh-TW", has_han(text) & ~other).when(lang == "en", has_latin(text) & ~has_han(text) & ~other).otherwise(True)


def plain_bullets(text: Column | str) -> Column:
    """Bullets at the start of lines become "- "; white space at the ends of lines and of the text goes."""
    x = F.regexp_replace(text, rf"(?dm)^({SPACE}*)[*•·–]{SPACE}+", "$1- ")
    return strip(F.regexp_replace(x, r"(?Udm)[ \t]+$", ""))


def notes_ok(text: Column | str) -> Column:
    """Six keys in order, a title of at most 90 characters and 10 words, nothing after other keys, and bullets only."""
    text = _c(text)
    lines = full_lines(text)
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    title = strip(F.substring(first, 7, 1_000_000))
    is_key = lambda x: x.rlike(r"^[A-Z]+:")
    keys = F.transform(F.filter(lines, is_key), lambda x: F.regexp_extract(x, r"(?U)^(\S+)", 1))
    rest = F.slice(lines, 2, 1_000_000)
    clean = F.forall(rest, lambda x: F.when(is_key(x), blank(F.regexp_replace(x, r"(?s)^[A-Z]+:", ""))).otherwise(x.startswith("- ") | (strip(x) == "-")))
    ok = first.startswith("TITLE:") & (title != "") & (F.length(title) <= 90) & (word_count(title) <= 10) & (keys == F.array(*map(F.lit, NOTES_KEYS))) & clean
    return ~text.rlike(NOTES_SLOT) & ok


def title_ok(lang: Column | str, text: Column | str) -> Column:
    lang, text = _c(lang), _c(text)
    fits = F.when(lang == "en", word_count(text) <= 10).when(lang == "zh-TW", F.length(text) <= 20).otherwise(True)
    return ~text.contains("\n") & ~text.contains('"') & (F.length(text) <= 90) & fits


def judge_ok(judge: Column | str = "judge") -> Column:
    """No judge passes; an inversion and a faith of 1 to 3 do not; 0 means that no verdict was read, and passes."""
    j = _c(judge)
    faith = F.coalesce(j["faith"], F.lit(0))
    return j.isNull() | (~F.coalesce(j["invert"], F.lit(False)) & ((faith == 0) | (faith >= MIN_FAITH)))


def has_preamble(text: Column | str, evaluation: bool = False) -> Column:
    return _c(text).rlike(PREAMBLE_EVAL if evaluation else PREAMBLE)


def keep(task: Column | str = "task", completion: Column | str = "completion", lang: Column | None = None, judge: Column | str = "judge") -> Column:
    """All gates of a training target; null completions fail."""
    task, c = _c(task), _c(completion)
    lang = effective_lang() if lang is None else lang
    ok = judge_ok(judge) & c.isNotNull() & (c != "") & (F.length(c) <= LONGEST) & ((task != "notes") | notes_ok(c)) & ~has_preamble(c) & lang_ok(lang, c) & ((task != "title") | title_ok(lang, c))
    return F.coalesce(ok, F.lit(False))


def format_ok(task: Column | str, text: Column | str, lang: Column | str) -> Column:
    """The evaluation's format test; empty output fails."""
    task, text, lang = _c(task), _c(text), _c(lang)
    title = ~text.contains("\n") & F.when(lang == "en", word_count(text) <= 10).otherwise(F.length(text) <= 20)
    short = (F.size(full_lines(text)) <= 12) & (F.length(text) <= 1600)
    rest = ~has_preamble(text, evaluation=True) & F.when(task == "title", title).when(task == "summarize", short).otherwise(True)
    return F.coalesce(~blank(text) & F.when(task == "notes", notes_ok(text)).otherwise(rest), F.lit(False))


def too_long(text: Column | str) -> Column:
    return (F.size(full_lines(text)) > 12) | (F.length(text) > 1200)
