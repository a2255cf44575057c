"""Targets curated into training rows: identity first, then gates, then routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import pick_hash, pick_number
from colloquy.operators import gates

# Fixed value: the system message of every training row.
SYSTEM = "You are a helpful assistant."
SPLITS = ("train", "val", "test")
# Other names of the validation split.
SPLIT_ALIASES = {"dev": "val", "validation": "val"}


def split_alias(split: Column | str = "split") -> Column:
    s = F.lower(F.trim(split))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv)), s), s)


def route(split: Column | str = "split") -> Column:
    """Unknown splits go to train."""
    s = F.col(split) if isinstance(split, str) else split
    return F.when(s.isin(*SPLITS), s).otherwise("train")


def in_order(*sources: DataFrame) -> DataFrame:
    """The sources one after the other: src_rank tells which, missing columns are null."""
    ranked = [df.withColumn("src_rank", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def first_of(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key. The rank limit is pushed before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def identity(prompt: Column | str = "prompt", completion: Column | str = "completion") -> Column:
    """128 bits that stand for prompt and completion as a key: what is compared, shuffled and sorted is the digest, never the texts."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.md5(F.concat(part(prompt), part(completion))))


def keep_first(targets: DataFrame, order: list[str | Column]) -> DataFrame:
    """One row per prompt and normalised completion, before any gate: a rejected record's twin must not come back.

    The digest is the key, and the rank limit is pushed before the exchange: a partition
    sends on the first row of each record only, however often it is repeated.
    """
    rows = targets.withColumn("completion", gates.plain_bullets("completion")).withColumn("_k", identity())
    return first_of(rows, ["_k"], order).drop("_k")


def outcomes(targets: DataFrame, order: list[str]) -> DataFrame:
    """Every row with outcome: reduce, dup, inverted, lowfaith, filtered or kept.

    The order's columns name a row; rows that repeat one another with them included have
    one outcome. Which rows are first is decided on digests, summed within partitions
    before they are shuffled, so that a record repeated any number of times is no task's
    load; texts move once, by the order's columns.
    """
    rows = targets.withColumn("completion", gates.plain_bullets("completion"))
    reduced = F.coalesce(F.col("phase") == "reduce", F.lit(False))
    keyed = rows.select(*order, reduced.alias("_r"), identity().alias("_k"))
    first = keyed.groupBy("_r", "_k").agg(F.min(F.struct(*order)).alias("_o")).select("_o.*", F.lit(True).alias("_first"))
    rows = rows.join(first.dropDuplicates(order), order, "left")
    faith = F.coalesce(F.col("judge.faith"), F.lit(0))
    outcome = (
        F.when(reduced, "reduce").when(F.col("_first").isNull(), "dup").when(gates.keep(), "kept")
        .when(F.coalesce(F.col("judge.invert"), F.lit(False)), "inverted").when((faith > 0) & (faith < gates.MIN_FAITH), "lowfaith").otherwise("filtered")
    )
    return rows.withColumn("outcome", outcome).drop("_first")


def outcome_counts(targets: DataFrame, order: list[str]) -> DataFrame:
    """(outcome, split, task, n): split is where kept rows go, null for others."""
    rows = outcomes(targets, order)
    return rows.groupBy("outcome", F.when(F.col("outcome") == "kept", route()).alias("split"), "task").agg(F.count(F.lit(1)).alias("n"))


def chat(prompt: Column | str, completion: Column | str, system: str = SYSTEM) -> Column:
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.array(turn("system", F.lit(system)), turn("user", c(prompt)), turn("assistant", c(completion)))


def training_rows(targets: DataFrame, order: list[str]) -> DataFrame:
    """(messages, task, phase, source, lang, meeting_id, split) of the rows that are kept."""
    kept = outcomes(targets, order).filter("outcome = 'kept'")
    return kept.select(chat("prompt", "completion").alias("messages"), "task", "phase", "source", gates.effective_lang().alias("lang"), "meeting_id", route().alias("split"))


def prompt_and_completion(messages: Column | str = "messages") -> Column:
    """struct<prompt, completion>: all messages but the last, and the last."""
    n = F.size(messages)
    return F.struct(F.slice(messages, 1, F.greatest(n - 1, F.lit(0))).alias("prompt"), F.slice(messages, F.greatest(n, F.lit(1)), 1).alias("completion"))


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose key is not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def shard(df: DataFrame, key: list[str], of: int, number: int) -> DataFrame:
    """A share of the rows that stays the same however often the work is resumed."""
    return df.filter(F.pmod(F.xxhash64(*key), F.lit(of)) == number)


def portable_shard(key: Column | str, of: int) -> Column:
    """The same number on any SQL engine: from the first 7 hex digits of the key's MD5."""
    return pick_number(of, key)


def cap_per_source(df: DataFrame, caps: dict[str, int], order: list[str | Column], other: dict[str, list[str | Column]] | None = None) -> DataFrame:
    """The first so many rows of each source, in order, or in an order of its own for those in other; sources without a cap are kept whole.

    The rank is also held against the largest cap, a literal, which Spark does before the
    exchange: a task sees no more rows of a source than there are partitions times that.
    """
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in caps.items() for x in kv)), F.col("source")) if caps else F.lit(None).cast("int")
    parts, special = [], other or {}
    for own, by in [({s: n for s, n in caps.items() if s not in special}, order), *(({s: caps[s]}, special[s]) for s in special if s in caps)]:
        if own:
            ranked = df.filter(F.col("source").isin(*own)).withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(*by)))
            parts.append(ranked.filter(F.col("_n") <= max(own.values())).filter(F.col("_n") <= limit).drop("_n"))
    return reduce(DataFrame.unionByName, parts, df.filter(limit.isNull()))


def shuffled(df: DataFrame, key: list[str], seed: int = 0, limit: int | None = None) -> DataFrame:
    """In an order fixed by seed and key; with a limit, the first so many (a sample)."""
    out = df.orderBy(pick_hash(F.lit(seed), *key), *key)
    return out.limit(limit) if limit is not None else out


def selected(targets: DataFrame, tasks: list[str] | None = None, phases: tuple[str, ...] = ("single", "map"), split: str | None = "train", shortest: int = 0, longest: int | None = None, length: Column | None = None) -> DataFrame:
    """Targets of the listed tasks (all if None), phases and split whose prompt's length, in characters or as given, lies in a range: what judges, tests and preference sampling draw from."""
    n = F.length("prompt") if length is None else length
    ok = F.col("phase").isin(*phases) & (n >= shortest)
    for c in ([F.col("task").isin(*tasks)] if tasks is not None else []) + ([F.col("split") == split] if split else []) + ([n <= longest] if longest is not None else []):
        ok = ok & c
    return targets.filter(ok)


def text_length(utterances: Column | str = "utterances") -> Column:
    return F.aggregate(utterances, F.lit(0), lambda a, u: a + F.length(F.coalesce(u["text"], F.lit(""))))


def source_counts(meetings: DataFrame) -> DataFrame:
    """(source, meetings, utterances)."""
    return meetings.groupBy("source").agg(F.count(F.lit(1)).alias("meetings"), F.sum(F.greatest(F.size("utterances"), F.lit(0)).cast("long")).alias("utterances"))


def upweighted(rows: DataFrame, times: int = 6) -> DataFrame:
    """Every row so many times, copy counting from 1 (documented use: few chosen samples)."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
