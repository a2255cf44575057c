"""Problem 1: records that differ only in formatting.

Two records are copies if prompt and completion hold the same letters and
digits in the same order within each labelled field, whatever the case, white
space and punctuation, and whatever the order of the labelled fields in the
prompt's head, the completion's sections, or one listed entry.

A canonical key (a 128-bit digest of the canonical form) is made once per record
and written; from then on only keys and identifiers move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import letters, map_pandas, norm
from colloquy.session import durable, small

# The labels of the project's formats.
HEAD_LABELS = ("task", "style", "output language", "session", "任務", "風格", "輸出語言", "場次")
BODY_LABELS = ("meeting transcript", "transcript", "summary", "items", "notes", "逐字稿", "摘要")
SECTION_LABELS = ("title", "summary", "decisions", "actions", "open", "topics")
ENTRY_LABELS = ("owner", "task", "due")

def _any(labels: tuple[str, ...]) -> str:
    return "|".join(re.escape(x).replace(r"\ ", r"[ \t]+") for x in labels)


_BODY = re.compile(rf"(?<![^\W_])({_any(BODY_LABELS)})[ \t*_\"]*(?:[:：]|[ \t][-–](?=\s)|(?=[\n\r]))")
_HEAD = re.compile(rf"(?<![^\W_])({_any(HEAD_LABELS)})[ \t*_\"]*(?:[:：]|[ \t][-–](?=\s))|^[ \t*_#>-]*({_any(HEAD_LABELS)})(?=[ \t])", re.M)
_SECTION = re.compile(
    r"(?:^|(?<=[\n\r]))[\W_]*(" + "|".join(SECTION_LABELS) + r")[ \t*_]*(?:[:：]|[-–](?=\s)|(?=[\n\r]|$))"
    r"|(?<![^\W_])(" + "|".join(SECTION_LABELS) + r")[*_]*\s*(?:[:：]|[-–](?=\s))[*_]*(?=\s*(?:[-–•*·]|$))"
)
_ENTRY = re.compile(r"(?<![^\W_])(" + "|".join(ENTRY_LABELS) + r")[\"'’”*_ \t ]*(?:[:：]|[-–](?=\s))")


def _split(text: str, marks: list[re.Match]) -> list[tuple[str, str]]:
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [(letters(m.group(m.lastindex)), letters(text[m.end() : e])) for m, e in zip(marks, ends)]


def canonical_prompt(prompt: str | None) -> str:
    """The head's labelled fields sorted, then everything from the body's label on."""
    text = norm(prompt)
    body = _BODY.search(text)
    head, rest = (text[: body.start()], text[body.start() :]) if body else (text, "")
    marks = list(_HEAD.finditer(head))
    if len(marks) < 2:
        return letters(head) + "\x1e" + letters(rest)
    first = letters(head[: marks[0].start()])
    fields = sorted("\x1f".join(x) for x in _split(head, marks))
    return first + "\x1d" + "\x1d".join(fields) + "\x1e" + letters(rest)


def canonical_completion(completion: str | None) -> str:
    """Sections sorted by label, the fields of each listed entry sorted by label; else the plain letters."""
    text = norm(completion)
    entries = list(_ENTRY.finditer(text))
    if len({m.group(1) for m in entries}) >= 2:
        groups: list[dict[str, str]] = [{}]
        for label, value in _split(text, entries):
            if label in groups[-1]:
                groups.append({})
            groups[-1][label] = value
        return letters(text[: entries[0].start()]) + "".join("\x1d" + "\x1f".join(f"{k}\x1c{v}" for k, v in sorted(g.items())) for g in groups)
    marks = list(_SECTION.finditer(text))
    if len({m.group(m.lastindex) for m in marks}) >= 3:
        return letters(text[: marks[0].start()]) + "\x1d" + "\x1d".join(sorted("\x1f".join(x) for x in _split(text, marks)))
    return letters(text)


def canonical_key(prompt: str | None, completion: str | None) -> bytes:
    form = canonical_prompt(prompt) + "\x00" + canonical_completion(completion)
    return blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def canonical_keys(df: DataFrame, id_col: str = "target_id", prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """(id, canon): one row per record. Records without an identifier cannot be named and are left out."""

    def kernel(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["i"], "canon": [canonical_key(p, c) for p, c in zip(batch["p"], batch["c"])]})

    picked = df.select(F.col(id_col).cast("long").alias("i"), F.col(prompt).alias("p"), F.col(completion).alias("c")).filter("i is not null")
    return map_pandas(picked, kernel, "id long, canon binary")


#: Most keys that can be hot at once, whatever the number of rows: what is broadcast stays below a megabyte.
MOST_HOT = 10_000


def hot_from(keys: DataFrame, hot_rows: int) -> int:
    """Rows above which a key is hot: hot_rows, or so many that no more than MOST_HOT keys can reach it. keys is written, so that counting reads footers only."""
    return max(hot_rows, keys.count() // MOST_HOT)


def summed(counts: pd.Series, more: pd.Series, room: int) -> pd.Series:
    """Counts of both, cut to so many keys by taking from each what the first one left out has: no key loses more than the rows of both divided by room."""
    counts = counts.add(more, fill_value=0)
    if len(counts) > room:
        counts = counts - counts.nlargest(room + 1).iloc[-1]
        counts = counts[counts > 0]
    return counts


def hot_keys(keys: DataFrame, hot_rows: int) -> DataFrame:
    """(canon, hot) of the keys of more than hot_rows rows, exactly, without a shuffle of all keys.

    Every partition counts its keys within room for 2 x rows / hot_rows of them, so that
    the sum of the partial counts misses less than hot_rows / 2 of any key; those that
    reach as much, at most 2 x rows / hot_rows, are counted again, exactly.
    """
    room = max(1, 2 * -(-keys.count() // max(1, hot_rows)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = pd.Series(dtype="float64")
        for b in batches:
            counts = summed(counts, b["canon"].value_counts(), room)
        yield pd.DataFrame({"canon": counts.index, "n": counts.to_numpy()})

    parts = keys.select("canon").mapInPandas(partial, "canon binary, n double")
    likely = parts.groupBy("canon").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot_rows / 2).select("canon")
    counted = keys.join(small(likely, 2 * MOST_HOT), "canon", "left_semi").groupBy("canon").count()
    return counted.filter(F.col("count") > hot_rows).select("canon", F.lit(True).alias("hot"))


def copy_groups(keys: DataFrame, hot_rows: int = 5_000, salts: int = 32) -> DataFrame:
    """canon, kept_id (the smallest identifier) and copies (rows with that key) of durable (id, canon) rows.

    The rows of hot_keys(), of which there are at most rows / hot_rows, are aggregated
    in two levels, first by (key, salt). All other keys take one shuffle, the only one
    that they take.
    """
    measure = lambda rows: rows.agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    if keys.count() <= hot_rows:  # from the footers: no key can be hot
        return measure(keys.groupBy("canon"))
    marked = keys.join(small(hot_keys(keys, hot_rows), MOST_HOT), "canon", "left")
    rest = measure(marked.filter("hot is null").groupBy("canon"))
    level1 = measure(marked.filter("hot").groupBy("canon", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")))
    level2 = level1.groupBy("canon").agg(F.min("kept_id").alias("kept_id"), F.sum("copies").alias("copies"))
    return rest.unionByName(level2)


def collapse_copies(df: DataFrame, id_col: str = "target_id", prompt: str = "prompt", completion: str = "completion", hot_rows: int = 5_000, salts: int = 32) -> DataFrame:
    """(kept_id, copies): one row per distinct record with the number of rows that hold it.

    Null prompts and completions equal empty ones. Rows that share an identifier
    count as rows. An empty table gives an empty table; other columns are ignored.
    """
    keys = durable(canonical_keys(df, id_col, prompt, completion), "copies")
    return copy_groups(keys, hot_from(keys, hot_rows), salts).select("kept_id", "copies")


def find_copies(df: DataFrame, id_col: str = "target_id", prompt: str = "prompt", completion: str = "completion", hot_rows: int = 5_000, salts: int = 32) -> DataFrame:
    """(kept_id, copy_id): one row for each record that repeats one with a smaller identifier.

    A row that repeats its own identifier is no pair. Rows of hot keys meet their
    group by broadcast, all others by one shuffle on the key.
    """
    keys = durable(canonical_keys(df, id_col, prompt, completion), "copies")
    hot_rows = hot_from(keys, hot_rows)
    groups = durable(copy_groups(keys, hot_rows, salts).filter("copies > 1"), "groups")
    big = small(groups.filter(F.col("copies") > hot_rows), MOST_HOT)
    rest = groups.filter(F.col("copies") <= hot_rows)
    pairs = keys.join(big, "canon").unionByName(keys.join(rest, "canon"))
    return pairs.filter("id <> kept_id").select("kept_id", F.col("id").alias("copy_id")).distinct()
