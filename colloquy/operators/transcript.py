"""Meetings as transcripts: rendered, parsed and stripped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.clock import clock
from colloquy.functions.text import one_line, pick_hash

# Characters spoken per second, and names for speakers that are only numbered.
RATES = {"en": 14.0, "zh-TW": 4.7}
NAMES = {
    "en": ["Alex", "Jordan", "Sam", "Taylor", "Morgan", "Chris", "Dana", "Riley", "Jamie", "Casey", "Robin", "Quinn"],
    "zh-TW": ["王小明", "陳美玲", "林志豪", "張雅婷", "李建宏", "黃淑芬", "吳俊傑", "劉思穎", "蔡孟軒", "鄭家豪", "許婉婷", "楊宗翰"],
}
STYLES = ("none", "stags", "names")
#: Seconds between utterances. A constant, so that times follow from the text alone.
PAUSE = 1.0


def utterance_lines(meetings: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, lang, pos, speaker, text): one row per utterance; an empty speaker is none."""
    rows = meetings.select(key, "lang", F.posexplode("utterances").alias("pos", "u"))
    return rows.select(key, "lang", "pos", F.nullif(F.col("u.speaker"), F.lit("")).alias("speaker"), F.coalesce(F.col("u.text"), F.lit("")).alias("text"))


def has_speakers(utterances: Column | str = "utterances") -> Column:
    return F.coalesce(F.exists(utterances, lambda u: u["speaker"].isNotNull() & (u["speaker"] != "")), F.lit(False))


def speaker_ranks(lines: DataFrame, key: str = "row_id") -> DataFrame:
    """lines with first_pos and rank: speakers in order of first appearance, from 1. One exchange by key serves both windows."""
    own = Window.partitionBy(key, "speaker")
    lines = lines.repartition(key).withColumn("first_pos", F.when(F.col("speaker").isNotNull(), F.min("pos").over(own)))
    return lines.withColumn("rank", F.when(F.col("speaker").isNotNull(), F.dense_rank().over(Window.partitionBy(key).orderBy(F.col("first_pos").asc_nulls_last()))))


def label(style: str, key: str = "row_id") -> Column:
    """The label of a ranked speaker. Pool names are put in an order of the meeting's own, by hash; past the pool it is S and the rank."""
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    tag = F.concat(F.lit("S"), F.col("rank").cast("string"))
    if style == "none":
        return F.lit(None).cast("string")
    if style == "stags":
        return tag
    pools = F.create_map(*(x for lang, names in NAMES.items() for x in (F.lit(lang), F.array(*map(F.lit, names)))))
    pool = F.transform(F.array_sort(F.transform(F.try_element_at(pools, F.col("lang")), lambda n: F.struct(pick_hash(F.col(key), n).alias("h"), n.alias("n")))), lambda x: x["n"])
    # Fixed value: how speakers are called that are only numbered.
    numbered = F.col("speaker").rlike(r"(?Ui)^(person|speaker|spk|s)[ _]?\d+$")
    return F.when(F.col("speaker").isNotNull(), F.when(numbered, F.coalesce(F.try_element_at(pool, F.col("rank")), tag)).otherwise(F.col("speaker")))


def render_lines(meetings: DataFrame, style: str = "stags", pause: float = PAUSE, key: str = "row_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, line_no, start_sec, label, text, line, and keep: lang if wanted): the transcript's lines, from 0; utterances without text have none.

    A line starts after what was said before it at the language's rate plus a pause
    per line: an exclusive running sum, in whole microseconds so that it is exact.
    Languages without a rate use that of English.
    """
    lines = utterance_lines(meetings, key).withColumn("text", one_line("text"))
    lines = speaker_ranks(lines, key).filter("text <> ''")
    rate = F.create_map(*(F.lit(x) for kv in RATES.items() for x in kv))
    spent = F.floor(F.length("text") * 1e6 / F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(RATES["en"])) + F.lit(pause * 1e6))
    order = Window.partitionBy(key).orderBy("pos")
    start = F.coalesce(F.sum(spent).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.select(key, (F.row_number().over(order) - 1).alias("line_no"), F.floor(start / 1e6).cast("int").alias("start_sec"), label(style, key).alias("label"), "text", *keep)
    line = F.concat(F.lit("["), clock(F.col("start_sec")), F.lit("] "), F.coalesce(F.concat("label", F.lit(": ")), F.lit("")), F.col("text"))
    return lines.withColumn("line", line)


def joined(lines: DataFrame, key: str | list[str], order: str, text: str, out: str, sep: str = "\n") -> DataFrame:
    """(key, out): the texts of each key in order."""
    key = [key] if isinstance(key, str) else key
    got = F.array_sort(F.collect_list(F.struct(order, text)))
    return lines.groupBy(*key).agg(got.alias("_x")).select(*key, F.array_join(F.transform("_x", lambda x: x[text]), sep).alias(out))


def render_transcripts(meetings: DataFrame, style: str = "stags", pause: float = PAUSE, key: str = "row_id") -> DataFrame:
    """(key, transcript); meetings without a line are left out."""
    return joined(render_lines(meetings, style, pause, key), key, "line_no", "line", "transcript")


# Fixed value: the mark of a rendered line.
_STAMPED = r"^\[(\d+:\d{2}(?::\d{2})?)\] "


def parse_line(line: Column | str) -> Column:
    """struct<ts, speaker, text>: a line needs its mark and a space; a speaker has 1 to 40 characters before the first ": "."""
    line = F.col(line) if isinstance(line, str) else line
    ts = F.regexp_extract(line, _STAMPED, 1)
    rest = F.regexp_replace(line, _STAMPED, "")
    at = F.instr(rest, ": ")
    named = (ts != "") & (at >= 2) & (at <= 41)
    return F.struct(
        F.nullif(ts, F.lit("")).alias("ts"),
        F.when(named, F.substring(rest, F.lit(1), at - 1)).alias("speaker"),
        F.when(ts == "", line).when(named, F.substring(rest, at + 2, F.length(rest))).otherwise(rest).alias("text"),
    )


def strip_tags(transcript: Column | str) -> Column:
    return F.array_join(F.transform(F.split(transcript, "\n"), lambda x: parse_line(x)["text"]), "\n")


# What stands before the transcript in a prompt, in order of preference.
MARKERS = ("Transcript:\n", "逐字稿:\n", "Partial summaries:\n", "部分摘要:\n", "Summary:\n", "摘要:\n", "Items:\n")


def transcript_of(prompt: Column | str) -> Column:
    """What follows the last place of the first marker that occurs, else the whole prompt."""
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    out = prompt
    for marker in reversed(MARKERS):
        out = F.when(prompt.contains(marker), F.substring_index(prompt, marker, -1)).otherwise(out)
    return out
