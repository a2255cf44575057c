"""Problem 9: sources mixed to target shares of the tokens, by weighted fair queueing.

Every copy of a document gets a virtual finish time: the tokens of its source up
to and with it, divided by the source's share. Taking copies by finish time up to
a virtual time V gives every source share x V tokens, whatever else is there, so
the mixture is a range of the finish times. A document's second copy queues after
all first copies of its source.

The cumulative sums need no window over a source, which may hold a third of all
rows: rows are spread by range over (source, shuffle key), summed within each
partition, and the partitions' totals are carried forward.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.tokens import VOCABULARY, content, encoding_of
from colloquy.session import durable, small


def token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df's columns without the text, and tokens; null texts have none."""
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text) + ", tokens long"
    shared = content(vocabulary)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = encoding_of(shared.value)
        for b in batches:
            yield b[kept].assign(tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in b[text]])

    return df.select(*kept, text).mapInPandas(kernel, schema)


def queue(documents: DataFrame, targets: DataFrame, seed: int = 0, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, before, share, weight, repeats, total), and per source of targets its totals.

    before: tokens of the source's documents that come earlier in its shuffled order.
    """
    want = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    counted = token_counts(documents.select("doc_id", "source", "text").filter("doc_id is not null"), "text", vocabulary)
    counted = counted.filter("tokens > 0").withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    counted = durable(counted.join(small(want.select("source")), "source", "left_semi"), "tokens")
    # Repeated rows of one document count once, as one document may be used no more than max_repeats times.
    counted = counted.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens"), F.max("key").alias("key"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, carried = TaskContext.get().partitionId(), {}
        for b in batches:
            ends = b.groupby("source", sort=False)["tokens"].cumsum()
            start = b["source"].map(carried).fillna(0).to_numpy(dtype=np.int64)
            for k, n in b.groupby("source", sort=False)["tokens"].sum().items():
                carried[k] = carried.get(k, 0) + int(n)
            yield b[["doc_id", "source", "tokens"]].assign(part=part, within=ends - b["tokens"] + start)

    ranged = counted.repartitionByRange(F.col("source"), F.col("key"), F.col("doc_id")).sortWithinPartitions("source", "key", "doc_id")
    spread = durable(ranged.mapInPandas(sums, "doc_id long, source string, tokens long, part int, within long"), "spread")
    # Few distinct (part, source): a source lies in neighbouring partitions, so there are at most partitions + sources of them.
    totals = spread.groupBy("part", "source").agg(F.sum("tokens").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", "source", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = spread.join(small(offsets), ["part", "source"]).select("doc_id", "source", "tokens", (F.col("within") + F.col("offset")).alias("before"))
    per_source = want.join(totals.groupBy("source").agg(F.sum("n").alias("total")), "source", "left").fillna(0, ["total"])
    return placed, per_source


def virtual_end(per_source: DataFrame, budget: int | None = None) -> float:
    """The virtual time to stop at.

    Without budget, the last at which every source that has documents still holds its
    share: the smallest total x repeats / share. A budget is met by stopping where the
    sources together reach it, those that run out giving all they have.
    """
    rows = [(r["total"] * max(0, r["repeats"] or 0), r["share"] or 0.0) for r in per_source.toLocalIterator()]  # one row per source of the settings
    rows = [(n, w) for n, w in rows if n > 0 and w > 0]
    if not rows:
        return 0.0
    if budget is None:
        return min(n / w for n, w in rows)
    given, weight, last = 0.0, sum(w for _, w in rows), 0.0
    for end, n, w in sorted((n / w, n, w) for n, w in rows):
        if given + weight * (end - last) >= budget:
            return last + (budget - given) / weight
        given, weight, last = given + weight * (end - last), weight - w, end
    return last


def _picked(placed: DataFrame, per_source: DataFrame, end: float) -> DataFrame:
    rows = placed.join(small(per_source), "source").filter((F.col("share") > 0) & (F.col("repeats") > 0))
    last = F.lit(end) * (1 + 1e-12)
    # Copies that finish in time, one more against rounding; the others are never made.
    n = F.greatest(F.lit(0), F.least(F.col("repeats").cast("long"), F.floor((last * F.col("share") - F.col("before") - F.col("tokens")) / F.col("total")) + 2))
    copies = rows.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    finish = (F.col("copy") * F.col("total") + F.col("before") + F.col("tokens")) / F.col("share")
    return copies.withColumn("finish", finish).filter(F.col("finish") <= last)


def mix(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, copy, tokens, finish), sorted by range of finish: the mixture.

    copy counts from 0 to max_repeats - 1. Documents of sources without target, of
    null source and without tokens are not drawn. A source of the targets without
    documents gives nothing; the others keep their proportions. Order within a source
    is fixed by seed and doc_id.
    """
    placed, per_source = queue(documents, targets, seed, vocabulary)
    end = virtual_end(per_source, budget)
    return _picked(placed, per_source, end).select("doc_id", "source", "copy", "tokens", "finish").sort("finish", "doc_id", "copy")


def shares(documents: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """(source, target_share, reachable_share, actual_share, tokens, documents, copies) for every source of the targets.

    reachable_share: target_share over the sum of those whose source has documents.
    """
    placed, per_source = queue(documents, targets, seed, vocabulary)
    end = virtual_end(per_source, budget)
    got = _picked(placed, per_source, end).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"))
    out = per_source.join(got, "source", "left").fillna(0, ["tokens", "documents", "copies"])
    everything = Window.partitionBy(F.lit(1))  # one row per source of the settings
    has = F.when(F.col("total") > 0, F.col("share")).otherwise(0.0)
    return out.select(
        "source", F.col("share").alias("target_share"), F.try_divide(has, F.sum(has).over(everything)).alias("reachable_share"),
        F.try_divide(F.col("tokens"), F.sum("tokens").over(everything)).alias("actual_share"), "tokens", "documents", "copies",
    )
