"""Problem 6: items packed into containers of fixed capacity, best fit first.

Bulk-synchronous best fit. Items are range-sorted by size over the executors, and
the sorted order is kept as runs: sizes are whole numbers up to the capacity, items
of one size and containers of one gap are interchangeable, so a run is a size with
a count and the runs of all items are at most as many numbers as the capacity. A
superstep takes the next class of sizes, largest first, range-sorts its runs of
items together with the runs of gaps, and sweeps every range on an executor of its
own: each run of items takes its successor among the gaps, the smallest that holds
it, and the gap that remains goes back. Items whose successor lies beyond their
range meet the gaps left of all ranges in one more sweep, where those of higher
rank, larger and earlier, win conflicts, and containers are opened for what found
none. The next superstep starts from the updated gaps. Matches are runs too, (size,
ranks) to (container numbers), and every executor places its own items by their
ranks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.session import durable, small

#: Ranges of a superstep's class that are swept side by side.
RANGES = 8


class Gaps:
    """Runs of open containers by gap, smallest successor first."""

    def __init__(self) -> None:
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first container, how many)

    def add(self, gap: int, first: int, n: int) -> None:
        if gap <= 0 or n <= 0:
            return
        if not self.runs[gap]:
            insort(self.sizes, gap)
        self.runs[gap].append((first, n))

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        """(gap, first container, how many) of the smallest gap that holds size; at most so many."""
        i = bisect_left(self.sizes, size)
        if i == len(self.sizes):
            return None
        gap = self.sizes[i]
        first, n = self.runs[gap].pop()
        if n > most:
            self.runs[gap].append((first + most, n - most))
        elif not self.runs[gap]:
            self.sizes.pop(i)
        return gap, first, min(n, most)


Run = tuple[int, int, int]  # items: size, first rank, how many; gaps: gap, first container, how many


def sweep(items: list[Run], gaps: list[Run], capacity: int = 0, opened: int = 0) -> tuple[list[tuple[int, int, int, int]], list[Run], list[Run], int]:
    """(matches as (size, first rank, first container, how many), runs of items left, runs of gaps left, containers opened in all).

    Largest items first, each run with its successor among the gaps. With a capacity,
    containers are opened for items that no gap holds, numbered from `opened`.
    """
    open_, placed, rest = Gaps(), [], []
    for gap, first, n in gaps:
        open_.add(gap, first, n)
    for size, rank, left in sorted(items, key=lambda x: (-x[0], x[1])):
        while left:
            got = open_.take(size, left)
            if got is None:
                if not capacity:
                    rest.append((size, rank, left))
                    break
                n = -(-left // (capacity // size))  # open as many as the rest fills; each takes one now, more in the next rounds
                got = capacity, opened, min(n, left)
                opened += got[2]
            gap, first, n = got
            placed.append((size, rank, first, n))
            open_.add(gap - size, first, n)
            rank, left = rank + n, left - n
    return placed, rest, [(gap, first, n) for gap in open_.sizes for first, n in open_.runs[gap]], opened


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """sweep() over all sizes at once: what the supersteps are measured against. counts: items per size, 1 to capacity."""
    placed, _, _, opened = sweep([(s, 0, n) for s, n in counts.items()], [], capacity)
    return placed, opened


_RUNS = "kind int, size long, first long, n long, box long"
ITEM, GAP, MATCH = 0, 1, 2


def _swept(runs: pd.DataFrame, capacity: int = 0, opened: int = 0) -> pd.DataFrame:
    of = lambda kind: list(runs.loc[runs["kind"] == kind, ["size", "first", "n"]].itertuples(index=False, name=None))
    placed, rest, gaps, _ = sweep(of(ITEM), of(GAP), capacity, opened)
    out = [(MATCH, s, r, n, c) for s, r, c, n in placed] + [(ITEM, *x, 0) for x in rest] + [(GAP, *x, 0) for x in gaps]
    return pd.DataFrame(out, columns=["kind", "size", "first", "n", "box"])


def supersteps(spark: SparkSession, counts: dict[int, int], capacity: int, ranges: int = RANGES) -> tuple[list[tuple[int, int, int, int]], int]:
    """The matches of best fit by supersteps on the executors, and the number of containers. Between two of them the driver holds the runs only, whose number the capacity bounds."""
    placed: list[tuple[int, int, int, int]] = []
    gaps, opened, high = [], 0, capacity
    while high:
        low = high // 2
        items = [(s, 0, n) for s, n in sorted(counts.items()) if low < s <= high]
        if items:
            width = max(1, -(-(high - low) // ranges))
            usable = [(GAP, *g, 0, min(ranges, (g[0] - low - 1) // width)) for g in gaps if g[0] > low]
            rows = [(ITEM, *x, 0, (x[0] - low - 1) // width) for x in items] + usable
            runs = spark.createDataFrame(pd.DataFrame(rows, columns=["kind", "size", "first", "n", "box", "range"]), _RUNS + ", range long")
            own = runs.groupBy("range").applyInPandas(lambda x: _swept(x), _RUNS)
            at = opened
            # One sweep over what the ranges left; matches of the first pass ride along as they are.
            last = own.groupBy().applyInPandas(lambda x: pd.concat([x[x["kind"] == MATCH], _swept(x, capacity, at)]), _RUNS).toPandas()
            done = last[last["kind"] == MATCH]
            placed += list(done[["size", "first", "box", "n"]].itertuples(index=False, name=None))
            opened = max(opened, int((done["box"] + done["n"]).max()))
            gaps = [g for g in gaps if g[0] <= low] + list(last.loc[last["kind"] == GAP, ["size", "first", "n"]].itertuples(index=False, name=None))
        high = low
    return placed, opened


def place(items: DataFrame, capacity: int, id_col: str = "row_id", size_col: str = "size") -> tuple[DataFrame, int]:
    """(id, piece, pieces, size, container) of all items, and the number of containers.

    An item above the capacity, and no other, is cut into full containers and a rest
    that is packed like an item. Items of size 0, and null sizes, go to container 0.
    Rows without identifier are left out; rows that share one are items of their own.

    Narrow rows (identifier, size) are range-sorted once and written with their rank
    among those of their size within their part; sizes lie in neighbouring parts, so
    there are at most parts + sizes pairs of both, whose sums of earlier parts are
    counted and broadcast. To the driver come the counts per size, at most as many
    numbers as the capacity; what is broadcast are the matches, which it bounds too.
    """
    spark = items.sparkSession

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = b["size"].to_numpy()
            n = np.maximum(1, -(-size // capacity))
            at = np.repeat(np.arange(len(b)), n)
            piece = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            yield pd.DataFrame({"id": b["id"].to_numpy()[at], "piece": piece, "pieces": n[at], "size": np.minimum(capacity, size[at] - piece * capacity)})

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            out = b.assign(part=part, rank=b.groupby("size").cumcount() + b["size"].map(seen).fillna(0).astype(int))
            for s, k in b["size"].value_counts().items():
                seen[s] += k
            yield out

    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("size")).filter("id is not null")
    schema = "id long, piece int, pieces int, size int"
    cut = rows.mapInPandas(pieces, schema).repartitionByRange(F.desc("size"), F.xxhash64("id", "piece"))
    ranked = durable(cut.mapInPandas(ranks, schema + ", part int, rank long"), "ranked")
    by_part = ranked.filter("size > 0").groupBy("part", "size").count()
    offsets = by_part.select("part", "size", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = {r["size"]: r["n"] for r in by_part.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    placed, opened = supersteps(spark, counts, capacity)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, rank, first, _ in sorted(placed):
        runs[size].append((rank, first))
    shared = spark.sparkContext.broadcast({s: (np.array([r for r, _ in x]), np.array([c for _, c in x])) for s, x in runs.items()})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            box = np.zeros(len(b), dtype=np.int64)
            ranks = (b["rank"] + b["before"].fillna(0)).to_numpy(dtype=np.int64)
            for size, at in b.groupby("size", sort=False).indices.items():
                if size > 0:
                    r, c = shared.value[size]
                    i = np.searchsorted(r, ranks[at], side="right") - 1
                    box[at] = c[i] + ranks[at] - r[i]
            yield b[["id", "piece", "pieces", "size"]].assign(container=box)

    joined = ranked.join(small(offsets), ["part", "size"], "left").select("id", "piece", "pieces", "size", "rank", "before")
    return joined.mapInPandas(assign, "id long, piece int, pieces int, size int, container long"), opened


def row_sizes(rows: DataFrame) -> DataFrame:
    """(row_id, size): the code points of a row's message contents together, without separators; nulls count 0."""
    lengths = F.transform("messages", lambda m: F.length(F.coalesce(m["content"], F.lit(""))))
    return rows.select("row_id", F.coalesce(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), F.lit(0)).alias("size"))


def capacity_of(sizes: DataFrame, kind: str = "sft_container") -> int:
    """The limit of that kind in the table of settings."""
    found = sizes.filter(F.col("item_kind") == kind).select("max_chars").limit(2).collect()
    if len(found) != 1 or not found[0][0] or found[0][0] < 1:
        raise ValueError(f"size_limits must hold one positive limit for {kind}")
    return int(found[0][0])


def pack_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row_id, piece, pieces, size, container) of all rows of messages."""
    return place(row_sizes(rows), capacity_of(sizes))[0].withColumnRenamed("id", "row_id")


def find_cut_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row_id): the rows that the packing could not keep whole, that is, whose pieces lie in several containers. Pieces follow their row, so only rows that were cut are grouped."""
    cut = pack_rows(rows, sizes).filter("pieces > 1")
    return cut.groupBy("row_id").agg(F.count_distinct("container").alias("containers")).filter("containers > 1").select("row_id")


def fill_report(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: items, containers, the fewest possible by volume, and the share of their room that is used."""
    capacity = capacity_of(sizes)
    placed, opened = place(row_sizes(rows), capacity)
    out = placed.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("size"), F.lit(0)).alias("used"))
    out = out.select("items", F.lit(opened).cast("long").alias("containers"), F.ceil(F.col("used") / capacity).alias("least_containers"), "used")
    return out.select("items", "containers", "least_containers", (F.col("used") / F.lit(max(1, opened) * capacity)).alias("fill"))


def packing_check(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: pieces and characters packed, whether none is lost or in two places, no container too full, none empty, and the containers within a fiftieth and one more of what the volume demands."""
    capacity = capacity_of(sizes)
    placed, opened = place(row_sizes(rows), capacity)
    boxes = placed.filter("size > 0").groupBy("container").agg(F.sum("size").alias("full"))
    full = boxes.agg(F.coalesce(F.max("full"), F.lit(0)).alias("fullest"), F.count(F.lit(1)).alias("boxes"))
    packed = placed.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("size"), F.lit(0)).alias("chars"), F.count_distinct("id", "piece").alias("places"))
    return packed.crossJoin(full).select(
        "pieces", "chars", (F.col("places") == F.col("pieces")).alias("once"), (F.col("fullest") <= capacity).alias("fits"), (F.col("boxes") == opened).alias("none_empty"),
        (F.lit(opened) <= F.ceil(F.col("chars") / capacity) * 1.02 + 1).alias("tight"),
    )
