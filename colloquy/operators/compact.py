"""Transcripts made shorter without losing content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import SPACE, blank, strip
from colloquy.operators.transcript import joined

# Utterances that only acknowledge, fillers, stutters, and the grammar of a line.
BACKCHANNEL = {
    "en": r"(?Udi)^(uh|um|erm|mm|mhm|hmm|uh-huh|yeah|yep|yes|ok|okay|right|sure|got it|i see|exactly|true)[\s,.!?]*$",
    "zh": r"(?Ud)^[嗯欸誒喔噢哦啊呃唉哎呀吧嘛耶阿はい,，。、!！?？~～\s]*$|^(對|對對|對對對|好|好的|好好好|是|是的|沒錯|了解|OK|ok)[。，,\s!！]*$",
}
FILLER = {"en": r"(?Udi)\b(you know|i mean|sort of|kind of|like,|um|uh|erm)\b[,]?\s*", "zh": r"(?Ud)(那個|這個|就是說|然後呢|對不對|你知道嗎)(?=[，,、\s])"}
STUTTER = {"en": r"(?Udi)\b(\w+)( \1\b)+", "zh": "([一-鿿])\\1{2,}"}
LINE = r"(?Ud)^\[(\d+:\d{2}(?::\d{2})?)\]\s*(?:([^:\n]{1,40}):\s*)?(.*)$"


def is_backchannel(text: Column | str, lang: str = "en") -> Column:
    return blank(text) | strip(text).rlike(BACKCHANNEL[lang])


def without_stutter(text: Column | str, lang: str = "en") -> Column:
    return F.regexp_replace(text, STUTTER[lang], "$1")


def without_fillers(text: Column | str, lang: str = "en") -> Column:
    """Fillers go, runs of white space become a space; commas and spaces at the ends go."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, FILLER[lang], ""), SPACE + "{2,}", " "), F.lit(" ,"))


def cleaned(text: Column | str, lang: str = "en") -> Column:
    """Stutters, then fillers and white space."""
    return without_fillers(without_stutter(text, lang), lang)


def line_parts(line: Column | str) -> Column:
    """struct<ts, speaker, said> by the grammar of a line; ts is null, and so are the others, where the line has no mark."""
    part = lambda i: F.regexp_extract(line, LINE, i)
    ts = F.nullif(part(1), F.lit(""))
    return F.struct(ts.alias("ts"), F.nullif(part(2), F.lit("")).alias("speaker"), F.when(ts.isNotNull(), part(3)).alias("said"))


def merge_adjacent(lines: DataFrame, key: str, order: str, joiner: str = " ", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, island, ts, speaker, text, and keep, columns that are the same for a key): neighbours of one speaker become one line with the first mark; lines without speaker stay alone.

    lines has key, order, ts, speaker, text, and is filtered already: what was dropped between two lines parts them no more.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.col("speaker") != F.lag("speaker").over(w)).cast("int"), F.lit(1))
    lines = lines.withColumn("_new", new).withColumn("island", (F.sum("_new").over(w) - 1).cast("int"))
    got = F.array_sort(F.collect_list(F.struct(order, "text")))
    merged = lines.groupBy(key, "island").agg(F.min_by("ts", order).alias("ts"), F.min_by("speaker", order).alias("speaker"), got.alias("_x"), *(F.first(c).alias(c) for c in keep))
    return merged.select(key, "island", "ts", "speaker", *keep, F.array_join(F.transform("_x", lambda x: x["text"]), joiner).alias("text"))


def _by_language(chinese: Column, rule: Callable[[str], Column]) -> Column:
    return F.when(chinese, rule("zh")).otherwise(rule("en"))


def compact_lines(transcripts: DataFrame, key: str = "row_id", text: str = "transcript", lang: str | Column = "en", merge: bool = True) -> DataFrame:
    """(key, line_no, line) of transcripts; lang is "en" or "zh" for all, or a column in which zh-TW stands for zh.

    Lines that only acknowledge, or say nothing once cleaned, are dropped; lines
    without a mark are kept as they are and end a run. Not idempotent.
    """
    chinese = F.lit(lang == "zh") if isinstance(lang, str) else F.coalesce(lang == "zh-TW", F.lit(False))
    rows = transcripts.select(key, chinese.alias("zh"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return _compacted(rows, key, merge)


def compact_rendered(lines: DataFrame, key: str = "row_id", lang: str | Column = "en", merge: bool = True) -> DataFrame:
    """compact_lines() of rendered lines (key, line_no, line), which are not joined to a text first; they lie together by key already."""
    chinese = F.lit(lang == "zh") if isinstance(lang, str) else F.coalesce(lang == "zh-TW", F.lit(False))
    return _compacted(lines.select(key, chinese.alias("zh"), F.col("line_no").alias("pos"), "line"), key, merge)


def _compacted(rows: DataFrame, key: str, merge: bool) -> DataFrame:
    rows = rows.withColumn("line", strip("line")).filter("line <> ''")
    part = lambda i: F.regexp_extract("line", LINE, i)
    # Parts one by one: fields of line_parts() would test the mark again wherever they are used.
    rows = rows.select(key, "zh", "pos", "line", F.nullif(part(1), F.lit("")).alias("ts"), F.nullif(part(2), F.lit("")).alias("speaker"), part(3).alias("said"))
    marked = F.col("ts").isNotNull()
    rows = rows.filter(~marked | ~_by_language(F.col("zh"), lambda x: is_backchannel("said", x)))
    rows = rows.withColumn("text", F.when(marked, _by_language(F.col("zh"), lambda x: cleaned("said", x))).otherwise(F.col("line"))).filter("text <> ''")
    if merge:
        # Han text is joined without a space: the mark of the joint is taken out again where zh.
        joint = "\u001f"
        rows = merge_adjacent(rows, key, "pos", joint, ("zh",)).withColumnRenamed("island", "line_no")
        rows = rows.withColumn("text", F.when(F.col("zh"), F.replace("text", F.lit(joint), F.lit(""))).otherwise(F.replace("text", F.lit(joint), F.lit(" "))))
    else:
        rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    head = F.concat(F.lit("["), F.col("ts"), F.lit("] "), F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")))
    return rows.select(key, "line_no", F.concat(F.coalesce(head, F.lit("")), F.col("text")).alias("line"))


def compact(transcripts: DataFrame, key: str = "row_id", text: str = "transcript", lang: str | Column = "en", merge: bool = True) -> DataFrame:
    """(key, transcript)."""
    return joined(compact_lines(transcripts, key, text, lang, merge), key, "line_no", "line", "transcript")
