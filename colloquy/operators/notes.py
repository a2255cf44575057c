"""Typed meeting notes: parsed, merged, capped, rendered, and led back to their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.clock import anchor_seconds, clock, without_anchor
from colloquy.functions.text import strip, without_thinking

# The sections in order, and how many items each keeps.
SECTIONS = ("SUMMARY", "DECISIONS", "ACTIONS", "OPEN", "TOPICS")
CAPS = {"SUMMARY": 5, "DECISIONS": 5, "ACTIONS": 6, "OPEN": 4, "TOPICS": 6}


def section_rank(section: Column | str = "section") -> Column:
    return F.array_position(F.array(*map(F.lit, SECTIONS)), F.col(section) if isinstance(section, str) else section).cast("int")


def note_items(df: DataFrame, key: list[str], text: str = "notes", lenient: bool = False) -> DataFrame:
    """(key, section, seq, text, at_sec): the items of notes in sections.

    Strict: any bullet glyph; an unknown header ends the section, items outside a
    section are dropped. Lenient: only "- ", an unknown header changes nothing, items
    before a header are SUMMARY, and a text without header or item gives its first
    five lines of over 20 characters as SUMMARY; thinking is cut out first.
    """
    body = without_thinking(F.coalesce(F.col(text), F.lit(""))) if lenient else F.coalesce(F.col(text), F.lit(""))
    rows = df.select(*key, F.posexplode(F.split(strip(body), "\n")).alias("seq", "line")).withColumn("line", strip("line"))
    header = F.nullif(F.regexp_extract("line", r"(?U)^([A-Z]+)\s*[:：]\s*$", 1), F.lit(""))
    known = F.when(header.isin(*SECTIONS), header)
    order = Window.partitionBy(*key).orderBy("seq")
    if lenient:
        rows = rows.withColumn("header", known).withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(order), F.lit("SUMMARY")))
        bullet = F.when(F.col("line").startswith("- "), strip(F.substring("line", 3, 1_000_000)))
    else:
        rows = rows.withColumn("header", F.when(header.isNotNull(), F.coalesce(known, F.lit("")))).withColumn("section", F.nullif(F.last("header", ignorenulls=True).over(order), F.lit("")))
        bullet = F.when(F.col("line").rlike(r"(?U)^[-*•·]\s+"), strip(F.regexp_replace("line", r"(?U)^[-*•·]\s+", "")))
    rows = rows.withColumn("item", F.when(F.col("header").isNull(), bullet))
    item = F.col("section").isNotNull() & F.col("item").isNotNull() & ~F.col("item").isin("", "-")
    found = rows.filter(item).select(*key, "section", "seq", F.col("item"))
    if lenient:
        whole = Window.partitionBy(*key)
        bare = rows.withColumn("any", F.max(F.when(F.col("header").isNotNull() | item, 1).otherwise(0)).over(whole)).filter((F.col("any") == 0) & (F.length("line") > 20))
        bare = bare.withColumn("_n", F.row_number().over(order)).filter("_n <= 5")
        found = found.unionByName(bare.select(*key, F.lit("SUMMARY").alias("section"), "seq", F.col("line").alias("item")))
    return found.select(*key, "section", "seq", (F.col("item") if lenient else without_anchor("item")).alias("text"), anchor_seconds("item").alias("at_sec"))


def bullets(text: Column | str) -> Column:
    """The items of a list, glyphs removed."""
    lines = F.transform(F.split(text, "\n"), strip)
    items = F.transform(F.filter(lines, lambda x: x.rlike(r"(?U)^[-*•·]\s+")), lambda x: strip(F.regexp_replace(x, r"(?U)^[-*•·]\s+", "")))
    return F.filter(items, lambda x: ~x.isin("", "-"))


def note_key(text: Column | str) -> Column:
    """What makes two items the same: lower case, white space and ASCII punctuation as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))


def merge_notes(items: DataFrame, meeting: str = "meeting", order: list[str] | None = None, exact: bool = False) -> DataFrame:
    """items of several chunks as one memory: the first of each key in its section, places by time and then order (rank from 1). exact: the text itself is the key."""
    order = order or ["chunk", "seq"]
    first = Window.partitionBy(meeting, "section", F.col("text") if exact else note_key("text")).orderBy(*order)
    kept = items.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(meeting, "section").orderBy("at_sec", *order)))


def capped(merged: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """merged with over (the section exceeds its cap and would be compressed), cut to the first items of each section: the fallback."""
    caps = caps or CAPS
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("section")), F.lit(5))
    n = F.count(F.lit(1)).over(Window.partitionBy("meeting", "section"))
    return merged.withColumn("over", n > cap).filter(F.col("rank") <= cap)


def chunks_of(merged: DataFrame, meeting: str = "meeting") -> DataFrame:
    """(meeting, section, chunks): the chunks that contribute, in order of time, each once."""
    got = F.array_sort(F.collect_list(F.struct("rank", "chunk")))
    return merged.groupBy(meeting, "section").agg(F.array_distinct(F.transform(got, lambda x: x["chunk"])).alias("chunks"))


def render_notes(merged: DataFrame, meetings: DataFrame, meeting: str = "meeting", anchors: bool = False, title: str | None = None) -> DataFrame:
    """(meeting, notes) for every row of meetings: all sections in order, "-" for an empty one; title names a column of meetings."""
    text = F.when((F.col("at_sec") >= 0) & F.lit(anchors), F.concat("text", F.lit(" ["), clock(F.col("at_sec")), F.lit("]"))).otherwise(F.col("text"))
    lists = merged.withColumn("text", text).groupBy(meeting, "section").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    maps = lists.groupBy(meeting).agg(F.map_from_entries(F.collect_list(F.struct("section", F.array_join(F.transform("x", lambda i: F.concat(F.lit("- "), i["text"])), "\n").alias("body")))).alias("m"))
    parts = [F.concat(F.lit(f"{s}:\n"), F.coalesce(F.try_element_at("m", F.lit(s)), F.lit("-"))) for s in SECTIONS]
    head = [F.when(strip(F.col(title)) != "", F.concat(F.lit("TITLE: "), strip(F.col(title))))] if title else []
    return meetings.join(maps, meeting, "left").select(meeting, F.concat_ws("\n", *head, *parts).alias("notes"))


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the last right row of the same key at or before its time, null without one.

    One sort per key over both sides together, instead of a join on a range.
    """
    l = left.select(*[F.col(c) for c in left.columns], F.lit(1).alias("_side"))
    r = right.select(F.col(key), F.col(at), F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(w)["_v"]).filter("_side = 1").drop("_side", "_v")


def evidence(items: DataFrame, lines: DataFrame, meeting: str = "meeting", window: int = 2, most: int = 40, section: str | None = None) -> DataFrame:
    """(meeting, line_no, line): the lines that support anchored items; with a column of sections (meeting, section, line_no, line), for each section its own.

    lines: meeting, line_no, start_sec (-1 without mark), line, sorted by time. An item
    leads to the last line at or before its time, the first line if there is none, and
    to the next `window` lines; the lines of a meeting
    (and section) are united and its first `most` kept.
    """
    by = [meeting] + ([section] if section else [])
    anchored = items.filter("at_sec >= 0").select(*by, "at_sec").distinct()
    starts = lines.groupBy(meeting, F.col("start_sec").alias("at_sec")).agg(F.max("line_no").alias("hit"))
    hit = asof(anchored, starts, meeting, "at_sec", "hit")
    n = lines.groupBy(meeting).agg(F.max("line_no").alias("last_no"))
    first = F.coalesce("hit", F.lit(0))
    wanted = hit.join(n, meeting).select(*by, F.explode(F.sequence(first, F.least(first + window, F.greatest(first, F.col("last_no"))))).alias("line_no")).distinct()
    ranked = wanted.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("line_no"))).filter(F.col("_n") <= most)
    return ranked.drop("_n").join(lines.select(meeting, "line_no", "line"), [meeting, "line_no"]).select(*by, "line_no", "line")
