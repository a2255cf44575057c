"""Notes of long meetings by an external model: chunk by chunk, carried along, or read again where decisions are contested."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import filled, reread_ids, strip
from colloquy.operators.external import Client, called
from colloquy.operators.notes import SECTIONS, evidence, merge_notes, note_items, section_rank
from colloquy.operators.transcript import joined

MakeClient = Callable[[], Client]
#: Chunks read again per meeting at most.
MOST_REREAD = 2


def map_notes(chunks: DataFrame, template: str, make_client: MakeClient, **options: Any) -> DataFrame:
    """(meeting, chunk, section, seq, text, at_sec): every chunk (meeting, chunk, chunk_text) asked on its own, {chunk} standing for it in the template."""
    asked = chunks.select("meeting", "chunk", filled(template, chunk=F.col("chunk_text")).alias("prompt"))
    return note_items(called(asked, make_client, "notes", **options), ["meeting", "chunk"], "notes")


# Fixed value: what a line of notes is, a header or an item.
_MARK = re.compile(r"^[^\S\n]*(?:(?P<head>[A-Z]+)[^\S\n]*[:：]|- (?P<item>.*?))\s*$", re.M)


def parsed(answer: str | None) -> dict[str, list[str]]:
    """Items by section, as note_items() reads them leniently: for loops in which one answer makes the next prompt."""
    said = re.sub(r"(?s)<think>.*?</think>", "", answer or "")
    out: dict[str, list[str]] = {s: [] for s in SECTIONS}
    into, marks = out[SECTIONS[0]], 0
    for m in _MARK.finditer(said):
        if m["head"] in out:
            into, marks = out[m["head"]], marks + 1
        elif (m["item"] or "").strip() not in ("", "-"):
            into.append(m["item"].strip())
            marks += 1
    if not marks:
        into += islice((x for line in said.split("\n") if len(x := line.strip()) > 20), 5)
    return out


def tagged(items: list[str], chunk: int) -> list[str]:
    """Items with the chunk they come from, [c<number>], if they do not name it."""
    return [x if f"[c{chunk}]" in x else f"{x} [c{chunk}]" for x in items]


def merged(state: dict[str, list[str]], more: dict[str, list[str]]) -> dict[str, list[str]]:
    """Both, each item once, by the second of the mark that ends it; items without mark before others, in order."""

    def at(item: str) -> int:
        m = re.search(r"\[(\d+(?::\d{2}){1,2})\]\s*$", item)
        return sum(int(x) * 60**i for i, x in enumerate(reversed(m.group(1).split(":")))) if m else -1

    return {s: sorted(dict.fromkeys([*state.get(s, []), *more.get(s, [])]), key=at) for s in SECTIONS}


def rendered(state: dict[str, list[str]]) -> str:
    """All sections in order, "-" for an empty one."""
    return "\n".join(x for s in SECTIONS for x in (f"{s}:", *([f"- {i}" for i in state.get(s, [])] or ["-"])))


def running_notes(chunks: DataFrame, template: str, make_client: MakeClient, carry: str = "Notes so far:\n{notes}\n\n") -> DataFrame:
    """(meeting, calls, notes): the notes of all chunks so far, merged and rendered, go before the next chunk's prompt.

    Every answer is parsed, its items are tagged with their chunk and merged into the
    state, and the last state is the result. {state} in the template stands for carry
    filled with the state, empty as long as there are no items; a template without it
    gets it in front. Chunks of one meeting follow each other in one task, as each
    prompt needs the answer before it; meetings run side by side.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        client, state = make_client(), merged({}, {})
        for chunk, text in group.sort_values("chunk")[["chunk", "chunk_text"]].itertuples(index=False, name=None):
            before = carry.replace("{notes}", rendered(state)) if any(state.values()) else ""
            form = template if "{state}" in template else "{state}" + template
            answer = client({"prompt": form.replace("{chunk}", text or "").replace("{state}", before)})
            state = merged(state, {s: tagged(x, chunk) for s, x in parsed(answer).items()})
        return pd.DataFrame({"meeting": [group["meeting"].iloc[0]], "calls": [len(group)], "notes": [rendered(state)]})

    kind = chunks.schema["meeting"].dataType.simpleString()
    return chunks.select("meeting", "chunk", "chunk_text").groupBy("meeting").applyInPandas(one, f"meeting {kind}, calls long, notes string")


def contested(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(meeting, items, n): the merged decisions, then actions, of meetings of more than one chunk, as lines with their chunk as [c<number>], and how many chunks there are."""
    n = chunks.groupBy("meeting").agg((F.max("chunk") + 1).alias("n")).filter("n > 1")
    line = F.concat(F.lit("- "), F.col("text"), F.lit(" [c"), F.col("chunk").cast("string"), F.lit("]"))
    rows = merge_notes(items.filter("section in ('DECISIONS', 'ACTIONS')"), exact=True)
    lists = rows.groupBy("meeting").agg(F.array_sort(F.collect_list(F.struct(section_rank().alias("s"), "rank", line.alias("line")))).alias("x"))
    return lists.join(n, "meeting").select("meeting", F.array_join(F.transform("x", lambda i: i["line"]), "\n").alias("items"), "n")


def reread_notes(items: DataFrame, chunks: DataFrame, ask: str, template: str, make_client: MakeClient, most: int = MOST_REREAD, **options: Any) -> DataFrame:
    """items of map_notes and, merged with them, those of the chunks that the model wants to read again.

    ask is filled with {items} of contested(); of the chunks named in the answer, those
    that exist are asked once more, the first `most`. Meetings of one chunk, and those
    without decisions and actions, are not asked.
    """
    asked = contested(items, chunks).select("meeting", "n", filled(ask, items=F.col("items")).alias("prompt"))
    named = called(asked, make_client, "answer", **options).select("meeting", F.explode(reread_ids("answer", F.col("n"), most)).alias("chunk")).distinct()
    again = map_notes(chunks.join(named, ["meeting", "chunk"]), template, make_client, **options)
    return items.withColumn("reading", F.lit(0)).unionByName(again.withColumn("reading", F.lit(1)))


def final_notes(items: DataFrame) -> DataFrame:
    """merge_notes of all readings."""
    order = ["chunk", "reading", "seq"] if "reading" in items.columns else ["chunk", "seq"]
    return merge_notes(items, order=order)


def over_cap(merged: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(meeting, section, items): sections that hold more than their cap, as lists to be compressed."""
    got = _over(merged, caps).groupBy("meeting", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    return got.select("meeting", "section", F.array_join(F.transform("x", lambda i: F.concat(F.lit("- "), i["text"])), "\n").alias("items"))


def _over(merged: DataFrame, caps: dict[str, int]) -> DataFrame:
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("section")), F.lit(5))
    return merged.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("meeting", "section"))).filter(F.col("n") > cap).withColumn("cap", cap)


def to_compress(merged: DataFrame, lines: DataFrame, caps: dict[str, int]) -> DataFrame:
    """(meeting, section, items, evidence) of the sections over cap: the list, and the lines that its anchored items lead back to, "" without any."""
    said = joined(evidence(_over(merged, caps), lines, section="section"), ["meeting", "section"], "line_no", "line", "evidence")
    return over_cap(merged, caps).join(said, ["meeting", "section"], "left").fillna("", ["evidence"])


def compressed(merged: DataFrame, lines: DataFrame, caps: dict[str, int], template: str, make_client: MakeClient, **options: Any) -> DataFrame:
    """(meeting, section, rank, text): sections within their caps as they are, the others as the model compresses them, {section}, {n}, {items} and {evidence} filled in; its bullets, or the first items where it gives none, up to the cap."""
    cap = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("section")), F.lit(5))
    prompt = filled(template, section=F.col("section"), n=cap.cast("string"), items=F.col("items"), evidence=F.col("evidence"))
    answers = called(to_compress(merged, lines, caps).select("meeting", "section", prompt.alias("prompt")), make_client, "answer", **options)
    dashes = F.filter(F.transform(F.split("answer", "\n"), strip), lambda x: x.startswith("- "))
    short = answers.select("meeting", "section", F.posexplode(F.transform(dashes, lambda x: strip(F.substring(x, 3, 1_000_000)))).alias("rank", "text")).withColumn("rank", F.col("rank") + 1).filter(F.col("rank") <= cap)
    kept = merged.filter(F.col("rank") <= cap).join(short.select("meeting", "section").distinct(), ["meeting", "section"], "left_anti")
    return kept.select("meeting", "section", "rank", "text").unionByName(short)
