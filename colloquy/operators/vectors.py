"""Block-wise symmetric quantisation of vectors, and means of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fake_quantised(vector: Column | str, block: int = 32, bits: int = 4) -> Column:
    """The vector as it would come back: per block a scale of absmax / (2^(bits-1) - 1), rounded half to even; the last block may be short."""
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    top = 2 ** (bits - 1) - 1

    def one(i: Column) -> Column:
        part = F.slice(v, i * block + 1, F.lit(block))
        scale = F.greatest(F.array_max(F.transform(part, lambda x: F.abs(x))), F.lit(1e-8)) / top
        return F.transform(part, lambda x: F.greatest(F.lit(float(-top - 1)), F.least(F.lit(float(top)), F.rint(x / scale))) * scale)

    blocks = F.ceil(F.size(v) / block).cast("int")
    return F.when(F.size(v) > 0, F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), one))).otherwise(v)


def mean_vector(vectors: Column, size: int) -> Column:
    """Element-wise mean of an array of vectors of that size."""
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))


def piece_means(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """(piece, vector): where a new piece starts, the element-wise mean of the vectors of its old parts.

    pieces: piece and part, one row per part, repeated parts counting as often; vectors:
    part and vector, all of one length. Sums are taken per element before they are
    shuffled, so a piece of any number of parts is no task's load; a piece none of whose
    parts has a vector is left out.
    """
    each = pieces.join(vectors, "part").select("piece", F.posexplode("vector").alias("at", "x"))
    means = each.groupBy("piece", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"]).alias("vector"))
