"""Texts cut into windows and packed into groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import estimated_tokens
from colloquy.session import durable

CONTEXT, RESERVE, PROMPT_LIMIT = 4096, 96, 32768


def map_budget(out_tokens: Column) -> Column:
    """Characters of input for so many tokens of output: three fifths of what is left, 512 to 3500."""
    left = (F.lit(CONTEXT) - out_tokens - RESERVE) * 3
    return F.when(out_tokens.isNotNull(), F.greatest(F.lit(512), F.least(F.lit(3500), F.floor(left / 5))).cast("int"))


def fits(tokens: Column, out_tokens: Column, limit: int = PROMPT_LIMIT) -> Column:
    return tokens + out_tokens + RESERVE <= limit


def windows(df: DataFrame, text: str = "text", size: int = 3500, overlap: int = 300) -> DataFrame:
    """df's columns without the text, plus chunk (from 0) and chunk_text: overlapping windows; the last one ends at the text's end. Null texts have none."""
    size = max(1, size)
    step = size - min(max(overlap, 0), size - 1)
    n = F.length(text)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - (size - step)) / step)).cast("int")
    at = df.filter(F.col(text).isNotNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    return at.withColumn("chunk_text", F.substring(F.col(text), F.col("chunk") * step + 1, F.lit(size))).drop(text)


def pack(costs: Column, budget: int, between: int = 0) -> Column:
    """Array of group numbers, from 0, for an array of costs: a group is closed when the next item would exceed the budget; an item above it is alone."""
    ends = group_ends(costs, budget, between)
    first = F.transform(ends, lambda e, i: F.when(i == 0, F.lit(0)).otherwise(ends[i - 1]))
    return F.when(F.size(ends) == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.transform(ends, lambda e, i: F.array_repeat(i, e - first[i]))))


def group_ends(costs: Column, budget: int, between: int = 0) -> Column:
    """Array of the numbers of items up to the end of each group. The fold carries ends only, of which there are as many as groups."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("ends"))

    def step(a: Column, c: Column) -> Column:
        c = c.cast("long")
        closes = (a["n"] > 0) & (a["used"] + between + c > budget)
        used = F.when(closes | (a["n"] == 0), c).otherwise(a["used"] + between + c)
        return F.struct((a["n"] + 1).alias("n"), used.alias("used"), F.when(closes, F.concat(a["ends"], F.array(a["n"]))).otherwise(a["ends"]).alias("ends"))

    return F.aggregate(costs, zero, step, lambda a: F.when(a["n"] > 0, F.concat(a["ends"], F.array(a["n"]))).otherwise(a["ends"]))


def _slices(items: Column, ends: Column) -> Column:
    return F.transform(ends, lambda e, i: F.slice(items, F.when(i == 0, F.lit(1)).otherwise(F.get(ends, i - 1) + 1), e - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))))


def line_chunks(df: DataFrame, text: str = "text", budget: int = 4000, cost: Callable[[Column], Column] = estimated_tokens) -> DataFrame:
    """df's columns without the text, plus chunk and chunk_text: whole lines packed under a budget of tokens, one more per line.

    Costs are measured once per line; groups are slices of the lines, so that the work
    grows with the lines and not with lines x groups.
    """
    kept = [c for c in df.columns if c != text]
    cut = df.filter(F.col(text).isNotNull()).withColumn("_lines", F.split(text, "\n"))
    cut = cut.withColumn("_ends", group_ends(F.transform("_lines", lambda x: cost(x) + 1), budget))
    return cut.select(*kept, F.posexplode(F.transform(_slices(F.col("_lines"), F.col("_ends")), lambda g: F.array_join(g, "\n"))).alias("chunk", "chunk_text"))


def group_partials(partials: Column, budget: int) -> Column:
    """Array of arrays of texts under a budget of characters, 2 between neighbours."""
    return _slices(partials, group_ends(F.transform(partials, lambda p: F.length(p)), budget, 2))


def fold_to_fit(df: DataFrame, partials: str, budget: int, sep: str, reduce_group: Callable[[Column], Column] | None = None, most_rounds: int = 20, reduce_rows: Callable[[DataFrame], DataFrame] | None = None, key: str = "id") -> DataFrame:
    """df with partials folded until they fit, one is left, or nothing can be folded.

    Either a column function folds a group to one text, or reduce_rows does, which gets
    (key, place, group: array of texts) of groups of two and more and returns (key,
    place, text): a call of an external model, made once for each group. Groups of one
    pass unchanged. Each round is written before the next, so that no round is computed
    again; rounds are bounded. Null partials stay null.
    """
    if (reduce_group is None) == (reduce_rows is None):
        raise ValueError("give either reduce_group or reduce_rows")
    for _ in range(most_rounds):
        x = F.col(partials)
        groups = group_partials(x, budget)
        folds = (F.size(x) > 1) & (F.length(F.array_join(x, sep)) > budget) & (F.size(groups) < F.size(x))
        if df.filter(folds).isEmpty():
            return df
        if reduce_group is not None:
            df = durable(df.withColumn(partials, F.when(folds, F.transform(groups, lambda g: F.when(F.size(g) == 1, g[0]).otherwise(reduce_group(g)))).otherwise(x)), "fold")
        else:
            parts = df.filter(folds).select(key, F.posexplode(groups).alias("place", "group"))
            made = reduce_rows(parts.filter(F.size("group") > 1)).select(key, "place", "text")
            alone = parts.filter(F.size("group") == 1).select(key, "place", F.col("group")[0].alias("text"))
            level = made.unionByName(alone).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda t: t["text"]).alias("_level"))
            df = durable(df.join(level, key, "left").withColumn(partials, F.coalesce("_level", x)).drop("_level"), "fold")
    return df


def judge_excerpt(transcript: Column, output: Column, chars: int = 3000) -> Column:
    """struct<transcript, output> as a judge gets them: the output cut to so many characters."""
    return F.struct(transcript.alias("transcript"), F.left(output, F.lit(chars)).alias("output"))
