"""Clock marks of transcripts: M:SS below an hour, H:MM:SS from there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(seconds: Column) -> Column:
    """Whole seconds, never negative; the leading unit is not padded."""
    t = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, s = F.expr("0L") + F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(s))).otherwise(F.concat_ws(":", m.cast("string"), two(s)))


def clock_seconds(mark: Column | str) -> Column:
    """Of M:SS or H:MM:SS; null for anything else."""
    p = F.split(mark, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(p) == 2, n(1) * 60 + n(2))


def anchor_seconds(item: Column | str) -> Column:
    """Of the mark in brackets that ends an item; -1 without one."""
    return F.coalesce(clock_seconds(F.regexp_extract(item, r"\[(\d+:\d{2}(?::\d{2})?)\]\s*$", 1)), F.lit(-1))


def without_anchor(item: Column | str) -> Column:
    return F.trim(F.regexp_replace(item, r"\[\d+:\d{2}(?::\d{2})?\]\s*$", ""))
