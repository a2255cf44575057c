"""Candidates for new vocabulary pieces of Han text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_lines(meetings: DataFrame, targets: DataFrame) -> DataFrame:
    """(text): utterances of meetings and completions of targets that are in, or due in, zh-TW."""
    said = meetings.filter("lang = 'zh-TW'").select(F.explode(F.transform("utterances", lambda u: u["text"])).alias("text"))
    due = F.coalesce(F.nullif("meta.tgt", F.lit("")), "lang")
    return said.unionByName(targets.filter(due == "zh-TW").select(F.col("completion").alias("text"))).filter("text is not null and text <> ''")


def corpus_size(lines: DataFrame, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """(lines, chars), one row; with a count of tokens also tokens and chars_per_token."""
    sums = [F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")]
    if tokens is None:
        return lines.agg(*sums)
    out = lines.withColumn("_n", tokens(F.col("text"))).agg(*sums, F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("tokens"))
    return out.withColumn("chars_per_token", F.try_divide("chars", "tokens"))


def candidates(lines: DataFrame, known: DataFrame, longest: int = 4, least: int = 8) -> DataFrame:
    """(piece, n): runs of 2 to `longest` Han characters seen at least `least` times that are not in known(piece).

    Runs are counted within the map side before they are shuffled; pieces are kept by
    frequency, in place of the merges of a trained tokenizer.
    """
    runs = lines.select(F.explode(F.regexp_extract_all("text", F.lit("([一-鿿]{2,})"), F.lit(1))).alias("run"))

    def of(n: int) -> DataFrame:
        parts = F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, F.lit(n)))
        return runs.filter(F.length("run") >= n).select(F.explode(parts).alias("piece"))

    pieces = reduce(DataFrame.unionByName, [of(n) for n in range(2, longest + 1)])
    counted = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.join(known.select("piece").distinct(), "piece", "left_anti")


def longest_first(pieces: DataFrame, n: int) -> DataFrame:
    """The first n, longest first, then in order."""
    return pieces.orderBy(F.length("piece").desc(), "piece").limit(n)
