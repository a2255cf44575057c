"""Reports on judged outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import blank

# Length buckets in tokens, upper ends exclusive.
BUCKETS = (("short", 4000), ("medium", 12000), ("long", 1_000_000_000))


def length_bucket(tokens: Column | str = "ntok") -> Column:
    n = F.coalesce(tokens, F.lit(0))
    out = F.lit(None).cast("string")
    for name, end in reversed(BUCKETS):
        out = F.when(n < end, name).otherwise(out)
    return out


def rate(c: Column | str) -> Column:
    return F.avg((F.col(c) if isinstance(c, str) else c).cast("int"))


def _scores() -> list[Column]:
    faith = F.coalesce("faith", F.lit(0))
    return [F.count(F.lit(1)).alias("n"), F.avg(faith).alias("faith"), F.avg(F.coalesce("cover", F.lit(0))).alias("cover"), rate(faith <= 2).alias("faith_le2"), rate(F.coalesce("invert", F.lit(False))).alias("invert")]


def by_task(rows: DataFrame) -> DataFrame:
    """(task, n, lang_ok, fmt_ok, faith, cover, faith_le2, invert); error rows are left out, a missing verdict counts as 0."""
    return rows.filter("error is null").groupBy("task").agg(*_scores(), rate("lang_ok").alias("lang_ok"), rate("fmt_ok").alias("fmt_ok"))


def by_length(rows: DataFrame) -> DataFrame:
    """(bucket, n, faith, cover, faith_le2, invert)."""
    return rows.filter("error is null").groupBy(length_bucket().alias("bucket")).agg(*_scores())


def by_task_and_length(rows: DataFrame) -> DataFrame:
    """Both reports in one pass, (task, bucket, n, faith, ...) with null for the one not grouped by."""
    rows = rows.filter("error is null").withColumn("bucket", length_bucket())
    return rows.groupingSets([["task"], ["bucket"]], "task", "bucket").agg(*_scores())


def by_mode(rows: DataFrame) -> DataFrame:
    """(mode, n, faith, cover, faith_le2, invert, calls, prompt_tokens, empty): empty is the share of outputs that say nothing, which no score shows."""
    ok = rows.filter("error is null")
    empty = ~F.coalesce(F.regexp_replace("notes", r"(?m)^[A-Z]+:|^\s*-\s*$", "").rlike(r"\S"), F.lit(False))
    return ok.groupBy("mode").agg(*_scores(), F.avg("calls").alias("calls"), F.avg("prompt_tokens").cast("int").alias("prompt_tokens"), rate(empty).alias("empty"))


def upper_median(value: Column | str) -> Column:
    """The middle value, the upper one of two, of a group that fits one task; for others upper_medians()."""
    got = F.array_sort(F.collect_list(value))
    return F.try_element_at(got, F.floor(F.size(got) / 2).cast("int") + 1)


def upper_medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): upper_median() of groups of any size. Distinct values are counted within partitions first; a group is then as large as its distinct values."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by)
    upto = F.sum("_c").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_upto": upto, "_all": F.sum("_c").over(group)})
    return placed.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias(value))


def judge_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, inversions, low) of judged rows; low is a faith of 1 to 3."""
    judged = rows.filter("judge is not null")
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("judge.invert").alias("inversions"), F.count_if(F.col("judge.faith").between(1, 3)).alias("low"))


def cases(meetings: DataFrame, what: DataFrame, most: int = 10_000) -> DataFrame:
    """Every meeting with every case. Cases are settings: a table above `most` rows is refused."""
    n = what.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} cases")
    return meetings.crossJoin(F.broadcast(what))


def cost(calls: DataFrame) -> DataFrame:
    """(meeting, mode, calls, prompt_tokens) of a log of calls."""
    return calls.groupBy("meeting", "mode").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"))


#: Results that one report document may hold.
MOST_RESULTS = 100_000


def report_lines(agg: DataFrame, results: DataFrame) -> DataFrame:
    """(part, line): a report of any size, one JSON object per aggregate ("agg") and per result ("results")."""
    of = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    return of(agg, "agg").unionByName(of(results, "results"))


def report(agg: DataFrame, results: DataFrame) -> DataFrame:
    """One row, column report: {"agg": [...], "results": [...]} as JSON, of evaluations up to MOST_RESULTS results; more are refused, to be written by report_lines()."""
    if results.limit(MOST_RESULTS + 1).count() > MOST_RESULTS:
        raise ValueError(f"more than {MOST_RESULTS} results; write them as report_lines()")
    pack = lambda df, name: df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    return pack(agg, "agg").crossJoin(pack(results, "results")).select(F.to_json(F.struct("agg", "results")).alias("report"))


def non_empty(text: Column | str) -> Column:
    return ~blank(text)
