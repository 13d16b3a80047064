"""Quantiles of lengths from sketches that are stored per file and merged by report.

A value x falls in bucket ``ceil(log(x) / log(g))`` with ``g = (1 + a) / (1 - a)``; a sketch is the counts of its buckets.  The
middle of a bucket differs from every value in it by at most the share ``a``, so a quantile has that relative error at any
number of values.  Sketches add up bucket by bucket: merged ones equal the sketch of all values, and no order matters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = 0.01
# The bucket of values below 1.
ZERO = -1


def ratio(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float = ERROR) -> Column:
    return F.when(value < 1, F.lit(ZERO)).otherwise(F.ceil(F.log(value.cast("double")) / F.lit(math.log(ratio(error))))).cast("int")


def _packed(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))


def sketch(rows: DataFrame, keys: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """``(*keys, n, total, shortest, longest, buckets)`` of the non-null values of each key (at least 0).

    Counts are summed by bucket before they are shuffled; a key has as many buckets as log(longest) / log(g) at most.
    """
    keys = list(keys)
    v = F.col(value)
    counts = rows.where(v.isNotNull()).groupBy(*keys, bucket_of(v, error).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v.cast("long")).alias("total"), F.min(v).cast("long").alias("shortest"), F.max(v).cast("long").alias("longest"))
    return _packed(counts, keys)


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of finer keys as those of ``keys``."""
    keys = list(keys)
    parts = sketches.select(*keys, F.col("total"), F.col("shortest"), F.col("longest"), F.posexplode("buckets").alias("_at", "_b"))
    first = F.col("_at") == 0
    counts = parts.groupBy(*keys, F.col("_b.bucket").alias("bucket")).agg(
        F.sum("_b.n").alias("n"), F.sum(F.when(first, F.col("total")).otherwise(0)).alias("total"), F.min("shortest").alias("shortest"),
        F.max("longest").alias("longest"))
    return _packed(counts, keys)


def quantile(buckets: Column, n: Column, q: float, error: float = ERROR) -> Column:
    """The value at place ``floor(q (n - 1))`` of the sorted values, within the sketch's relative error."""
    place = F.floor((n - 1) * q)
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("int").alias("bucket"))

    def step(acc: Column, b: Column) -> Column:
        upto = acc["upto"] + b["n"]
        found = F.when(acc["bucket"].isNull() & (upto > place), b["bucket"]).otherwise(acc["bucket"])
        return F.struct(upto.alias("upto"), found.alias("bucket"))
    at = F.aggregate(buckets, start, step, lambda acc: acc["bucket"])
    g = ratio(error)
    return F.when(at == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(g), at) * 2 / (g + 1))


def quantiles(sketches: DataFrame, asked: Sequence[float], error: float = ERROR) -> DataFrame:
    """``sketches`` with ``q<percent>`` for each quantile asked for; ``error`` is the one they were made with."""
    return sketches.withColumns({f"q{round(q * 100)}": quantile(F.col("buckets"), F.col("n"), q, error) for q in asked}).drop("buckets")
