"""Raw corpora of different shapes into one meeting schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import SPACE, U, strip
from colloquy.operators.curate import split_alias

UTTERANCES = "array<struct<speaker:string,text:string>>"
_REFS = {"summary": "string", "topic": "string", "topics": "array<string>", "queries": "array<struct<query:string,answer:string>>", "segment_summaries": "array<string>", "agenda": "array<string>"}
REFS = "struct<" + ",".join(f"{k}:{v}" for k, v in _REFS.items()) + ">"
MEETING = f"id string, source string, lang string, split string, utterances {UTTERANCES}, refs {REFS}, meta map<string,string>"

_PAIRS = "array<struct<query:string,answer:string>>"
RAW = {
    "qmsum": f"meeting_transcripts array<struct<speaker:string,content:string>>, general_query_list {_PAIRS}, specific_query_list {_PAIRS}, topic_list array<struct<topic:string>>, file string, split string",
    "meetingbank": "uid string, transcript string, summary string, split string",
    "dialogsum": "id string, dialogue string, summary string, topic string, split string",
    "vcsum": "id string, context string, summary string, discussion array<string>, agenda array<string>, av_num string, split string",
}

Convert = Callable[[Column], Column]


def same(c: Column) -> Column:
    return c


def converter(table: dict[str, str]) -> Convert:
    """A script converter from a table of characters, one to one: each character that has an entry is replaced. For tables of phrases pass a vectorised UDF instead."""
    if any(len(k) != 1 or len(v) != 1 for k, v in table.items()):
        raise ValueError("one character for one")
    return lambda c: F.translate(c, "".join(table), "".join(table.values()))


def _refs(**known: Column) -> Column:
    return F.struct(*(known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _REFS.items()))


def _utterance(speaker: Column, text: Column) -> Column:
    return F.struct(speaker.cast("string").alias("speaker"), text.alias("text"))


def _meeting(df: DataFrame, source: str, lang: str, native: Column, utterances: Column, refs: Column, meta: Column) -> DataFrame:
    split = split_alias("split")
    return df.select(
        F.concat_ws("-", F.lit(source), split, native).alias("id"), F.lit(source).alias("source"), F.lit(lang).alias("lang"), split.alias("split"),
        utterances.cast(UTTERANCES).alias("utterances"), refs.alias("refs"), meta.cast("map<string,string>").alias("meta"),
    )


def _empty(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _none() -> Column:
    return F.create_map().cast("map<string,string>")


def clean_marked(text: Column) -> Column:
    """Annotation markers in braces go, spaces before punctuation go, runs of spaces are one."""
    x = F.regexp_replace(text, r"\{[a-z_]+\}", " ")
    x = F.regexp_replace(x, SPACE + r"+([,.!?;:'])", "$1")
    return strip(F.regexp_replace(x, SPACE + r"{2,}", " "))


def from_qmsum(raw: DataFrame) -> DataFrame:
    """Utterances are cleaned and need a word character; the first general answer is the summary, the other queries stay queries."""
    said = F.transform("meeting_transcripts", lambda u: _utterance(F.nullif(strip(u["speaker"]), F.lit("")), clean_marked(u["content"])))
    said = F.filter(said, lambda u: u["text"].rlike(U + r"\w"))
    general = F.coalesce("general_query_list", F.array().cast(_PAIRS))
    refs = _refs(
        summary=F.try_element_at(general, F.lit(1))["answer"],
        queries=F.concat(F.slice(general, 2, 1_000_000), F.coalesce("specific_query_list", F.array().cast(_PAIRS))),
        topics=F.transform("topic_list", lambda t: t["topic"]),
    )
    return _meeting(raw, "qmsum", "en", F.regexp_replace("file", r"\.json$", ""), said, refs, F.create_map(F.lit("file"), F.col("file")))


def from_meetingbank(raw: DataFrame) -> DataFrame:
    """Flat text cut after sentence ends; no speakers."""
    parts = F.transform(F.split(strip("transcript"), r"(?<=[.!?])" + SPACE + "+"), strip)
    said = F.transform(F.filter(parts, lambda s: s != ""), lambda s: _utterance(F.lit(None), s))
    return _meeting(raw, "meetingbank", "en", F.col("uid"), said, _refs(summary=_empty(F.col("summary"))), _none())


def from_dialogsum(raw: DataFrame) -> DataFrame:
    """A line's speaker stands before its first colon; numbered persons become "Person N"; a text may be empty."""
    lines = F.filter(F.transform(F.split("dialogue", "\n"), strip), lambda x: x != "")

    def one(x: Column) -> Column:
        at = F.instr(x, ":")
        name = strip(F.substring(x, F.lit(1), at - 1))
        numbered = F.regexp_replace(name, r"^#Person(\d+)#$", "Person $1")
        return F.when(at > 0, _utterance(numbered, strip(F.substring(x, at + 1, F.length(x))))).otherwise(_utterance(F.lit(None), x))

    return _meeting(raw, "dialogsum", "en", F.col("id"), F.transform(lines, one), _refs(summary=strip("summary"), topic=_empty(F.col("topic"))), _none())


def from_vcsum(raw: DataFrame, convert: Convert = same) -> DataFrame:
    """One utterance per line, script converted; meetings without an utterance are left out. convert: a column function, such as a vectorised UDF around a converter."""
    lines = F.filter(F.transform(F.split("context", "\n"), strip), lambda x: x != "")
    joined = convert(F.array_join(lines, "\n"))
    said = F.transform(F.split(joined, "\n"), lambda s: _utterance(F.lit(None), s))
    many = lambda c: F.when(F.size(c) > 0, F.split(convert(F.array_join(c, "\u001e")), "\u001e"))
    refs = _refs(summary=convert(F.nullif(strip("summary"), F.lit(""))), segment_summaries=many("discussion"), agenda=many("agenda"))
    meta = F.create_map(F.lit("orig_script"), F.lit("zh-Hans"), F.lit("av_num"), F.col("av_num"))
    return _meeting(raw.filter(F.size(lines) > 0), "vcsum", "zh-TW", F.col("id"), said, refs, meta)


NORMALISERS: dict[str, Callable[..., DataFrame]] = {"qmsum": from_qmsum, "meetingbank": from_meetingbank, "dialogsum": from_dialogsum, "vcsum": from_vcsum}


def normalise(source: str, raw: DataFrame, **options) -> DataFrame:
    if source not in NORMALISERS:
        raise ValueError(f"unknown source {source}; known: {', '.join(NORMALISERS)}")
    return NORMALISERS[source](raw, **options)
