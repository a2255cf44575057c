"""Problem 4: oversized items cut into overlapping pieces at natural boundaries.

Boundaries are offsets in code points, kept as one sorted array per kind of
break (prefix sums of the parts' lengths). A piece ends at the last boundary of
the best kind that its limit allows, found by binary search; the next piece
starts so much earlier as the overlap asks for. Without boundary the cut is hard.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[.!?。！？…]+[\"'”’」』)）]*\s*")
_CLAUSE = re.compile(r"[,;:，；：、]+\s*")
_SPACE = re.compile(r"\s+")
CUTS = ("utterance", "sentence", "clause", "word", "hard")


def boundaries(text: str, breaks: str = "\n") -> list[list[int]]:
    """Sorted offsets after which a piece may end, best kind first: utterance, sentence, clause, word."""
    lines, at = [], text.find(breaks) if breaks else -1
    while at >= 0:
        lines.append(at + len(breaks))
        at = text.find(breaks, at + len(breaks))
    return [lines, *([m.end() for m in p.finditer(text)] for p in (_SENTENCE, _CLAUSE, _SPACE))]


def cut(text: str, limit: int, overlap: int, breaks: str = "\n") -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at its end) of each piece; start and end count from 0, the end is exclusive.

    No piece is longer than limit (at least 1); each but the first starts exactly
    overlap (at most limit - 1) before the end of the one before, so that the pieces
    beyond their overlaps make up the text. A text within the limit is one piece.
    """
    n, limit = len(text), max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n, "end")]
    kinds = boundaries(text, breaks)
    out, start, done = [], 0, 0
    while n - start > limit:
        most, least = start + limit, max(done, start + overlap)
        end, kind = most, "hard"
        for name, offsets in zip(CUTS, kinds):
            i = bisect_right(offsets, most) - 1
            if i >= 0 and offsets[i] > least:
                end, kind = offsets[i], name
                break
        out.append((start, end, kind))
        done, start = end, end - overlap
    out.append((start, n, "end"))
    return out


def split_oversized(items: DataFrame, limit: int, overlap: int, keys: list[str], text: str = "text", breaks: str = "\n") -> DataFrame:
    """keys, piece, start_pos, end_pos, cut, piece_text: the pieces of all items that exceed the limit.

    Positions count from 1, the end is included; pieces count from 0. Items within
    the limit, and null texts, have no rows. The test of the length is a built-in
    expression: only what must be cut reaches Python.
    """
    fields = [f for f in items.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(fields, key=lambda f: keys.index(f.name)))

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *key, t in b.itertuples(index=False, name=None):
                rows += [(*key, i, s + 1, e, kind, t[s:e]) for i, (s, e, kind) in enumerate(cut(t, limit, overlap, breaks))]
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "piece", "start_pos", "end_pos", "cut", "piece_text"])

    long = items.filter(F.length(text) > limit).select(*keys, F.col(text).alias("_t"))
    return long.mapInPandas(kernel, f"{schema}, piece int, start_pos int, end_pos int, cut string, piece_text string")


def _limits(sizes: DataFrame) -> dict[str, tuple[int, int]]:
    """The limits of both kinds of item; if a kind has several rows, the smallest limit and the largest overlap."""
    return {r["item_kind"]: (r["max_chars"], r["overlap_chars"] or 0) for r in sizes.filter("item_kind in ('meeting', 'utterance') and max_chars is not null").groupBy("item_kind").agg(F.min("max_chars").alias("max_chars"), F.max("overlap_chars").alias("overlap_chars")).collect()}


def item_pieces(meetings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(item_kind, row_id, pos, piece, start_pos, end_pos, cut, piece_text) of meetings (pos -1) and single utterances above their limits.

    A meeting's text is its utterances' texts joined by one line break; null texts
    are empty there. Kinds without a limit have no pieces.
    """
    limits = _limits(sizes)
    rows = meetings.filter("row_id is not null")
    texts = F.transform("utterances", lambda u: F.coalesce(u["text"], F.lit("")))
    out = []
    if "meeting" in limits:
        whole = rows.select(F.lit("meeting").alias("item_kind"), "row_id", F.lit(-1).alias("pos"), F.array_join(texts, "\n").alias("text"))
        out.append(split_oversized(whole, *limits["meeting"], ["item_kind", "row_id", "pos"]))
    if "utterance" in limits:
        most = limits["utterance"][0]
        longs = F.filter(F.transform("utterances", lambda u, i: F.struct(i.alias("pos"), u["text"].alias("text"))), lambda x: F.length(x["text"]) > most)
        single = rows.select("row_id", F.explode(longs).alias("x")).select(F.lit("utterance").alias("item_kind"), "row_id", F.col("x.pos").cast("int").alias("pos"), "x.text")
        out.append(split_oversized(single, *limits["utterance"], ["item_kind", "row_id", "pos"], breaks="\n"))
    if not out:
        return meetings.sparkSession.createDataFrame([], "item_kind string, row_id long, pos int, piece int, start_pos int, end_pos int, cut string, piece_text string")
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def find_oversized(meetings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(item_kind, row_id, pos): the items that had to be cut, that is those with a second piece."""
    return item_pieces(meetings, sizes).filter("piece = 1").select("item_kind", "row_id", "pos").distinct()
