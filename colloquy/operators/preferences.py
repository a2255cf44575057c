"""Preference pairs: the best and the worst answer to one prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import blank, pick_number

# Tokens of output per task; 384 for others.
MAX_TOKENS = {"notes": 640, "summarize": 288, "actions": 384, "exec_summary": 224, "detailed_summary": 512, "decisions": 320, "topics": 256, "open_questions": 320, "risks_disagreements": 320, "title": 24}
DEFAULT_TOKENS = 384


def temperatures(k: int) -> Column:
    """One greedy sample, the rest warm."""
    return F.array(F.lit(0.0), *[F.lit(0.9)] * (k - 1))


def endpoint(key: list[str], of: int) -> Column:
    """Which of several endpoints answers, fixed by the key: an even spread without a counter."""
    return pick_number(of, *key)


def max_tokens(tasks: DataFrame, caps: DataFrame, default: int = DEFAULT_TOKENS) -> DataFrame:
    """tasks with max_tokens from caps (task, max_tokens), one row per task at most; default where it has none. The settings are small enough for Spark to broadcast them by their size."""
    return tasks.join(caps, "task", "left").withColumn("max_tokens", F.coalesce("max_tokens", F.lit(default)))


def _digest(columns: list[str]) -> Column:
    """128 bits in place of long texts as a key."""
    return F.unhex(F.md5(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns))))


def pairs(candidates: DataFrame, prompt: list[str], order: str = "k") -> DataFrame:
    """(prompt columns, chosen, chosen_faith, rejected, rejected_faith, rejected_inverted) of (prompt, k, completion, faith, invert).

    Chosen: highest faith of at least 4 without inversion. Rejected: an inverted answer
    before others, then the lowest faith of 1 or 2 (0 is no verdict). The first on
    ties. Prompts need two answers that are not blank and two different texts.
    """
    rows = candidates.filter(~blank("completion")).withColumn("_p", _digest(prompt))
    faith, invert = F.coalesce("faith", F.lit(0)), F.coalesce("invert", F.lit(False))
    good, bad = (faith >= 4) & ~invert, invert | (faith.between(1, 2))
    best = F.max_by(F.when(good, F.struct("completion", "faith")), F.when(good, F.struct(faith.alias("f"), (-F.col(order)).alias("o"))))
    worst = F.min_by(F.when(bad, F.struct("completion", "faith", "invert")), F.when(bad, F.struct((~invert).alias("i"), faith.alias("f"), F.col(order).alias("o"))))
    found = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), best.alias("g"), worst.alias("b"), *(F.any_value(c).alias(c) for c in prompt))
    found = found.filter("n >= 2 and g is not null and b is not null and g.completion <> b.completion")
    return found.select(*prompt, F.col("g.completion").alias("chosen"), F.col("g.faith").alias("chosen_faith"), F.col("b.completion").alias("rejected"), F.col("b.faith").alias("rejected_faith"), F.coalesce(F.col("b.invert"), F.lit(False)).alias("rejected_inverted"))


def pair_stats(candidates: DataFrame, prompt: list[str], order: str = "k") -> DataFrame:
    """(prompts, inverted, pairs), one row."""
    rows = candidates.filter(~blank("completion"))
    per = rows.groupBy(_digest(prompt).alias("_p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("invert", F.lit(False))).alias("i")).filter("n >= 2")
    base = per.agg(F.count(F.lit(1)).alias("prompts"), F.coalesce(F.sum("i"), F.lit(0)).alias("inverted"))
    return base.crossJoin(pairs(candidates, prompt, order).agg(F.count(F.lit(1)).alias("pairs")))
