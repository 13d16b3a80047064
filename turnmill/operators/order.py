"""Total orders without a single-task window: dense indices, running totals, seeded shuffles.

Every running total here is taken in two levels.  Rows fall in order-preserving buckets that are
bounded by construction (a chunk of an integer sequence, or the leading digits of an md5 key), so a
group that holds a third of the corpus is cut into many tasks.  Only the table of bucket totals, one
narrow row per bucket, is prefix-summed per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.text import col
from turnmill.session import stage

CHUNK = 8192
# Bytes of input behind one md5 bucket, and the most leading digits used: 16^5 is a million buckets,
# about 100 MB each at 100 TB.
BUCKET_BYTES = 64 << 20
MAX_DIGITS = 5


def digits_for(df: DataFrame) -> int:
    """Leading md5 digits that cut ``df`` in buckets of about ``BUCKET_BYTES``.

    Takes the optimizer's size estimate (no job).  The number of digits never changes a result: longer
    prefixes split the same order more finely.
    """
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except AttributeError:  # sessions without a local optimizer
        return MAX_DIGITS - 1
    digits = 1
    while digits < MAX_DIGITS and 16 ** digits * BUCKET_BYTES < size:
        digits += 1
    return digits


def shuffle_key(*ids: Column | str, seed: int = 1024, epoch: int = 0) -> Column:
    """Portable shuffle key: md5 of ``seed:epoch:id``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[col(i).cast("string") for i in ids]))


def md5_bucket(key: Column | str, digits: int = 3) -> Column:
    """Order-preserving bucket of an md5 key: its leading hex digits as a number."""
    return F.conv(F.substring(col(key), 1, digits), 16, 10).cast("long")


def int_div(a: Column | str, b: Column | int) -> Column:
    """Integer division on longs (no detour through doubles)."""
    return F.call_function("div", col(a).cast("long"), (b if isinstance(b, Column) else F.lit(b)).cast("long"))


def chunk_bucket(order: Column | str, size: int = CHUNK) -> Column:
    """Order-preserving bucket of a unique integer order: at most ``size`` rows each."""
    return int_div(order, size)


def safe_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that stand for its keys and are never null, and their names.

    A null key is a key of its own.  Windows, joins and groups on these columns share one partitioning, which a null-safe
    comparison of the keys themselves would not.
    """
    types, names = dict(df.dtypes), []
    for i, k in enumerate(keys):
        kind = types[k]
        blank = "" if kind == "string" else 0 if kind in ("tinyint", "smallint", "int", "bigint") else None
        if blank is None:
            df, names = df.withColumn(f"_key{i}", F.struct(F.col(k))), [*names, f"_key{i}"]
        else:
            df = df.withColumns({f"_key{i}": F.coalesce(F.col(k), F.lit(blank).cast(kind)), f"_none{i}": F.col(k).isNull()})
            names += [f"_key{i}", f"_none{i}"]
    return df, names


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join by name in which null keys meet null keys; the keys are those of ``left``."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"_right_{k}"])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


# Rows without a place in the order come before all others, as they do in a sort.
_FIRST = -(1 << 62)


def _bucketed(df: DataFrame, keys: Sequence[str], bucket: Column) -> tuple[DataFrame, list[str]]:
    return safe_keys(df.withColumn("_bucket", F.coalesce(bucket, F.lit(_FIRST))), keys)


def _bucket_offsets(sizes: DataFrame, keys: list[str], names: list[str], totals: dict[str, str]) -> DataFrame:
    """Exclusive prefix sums over the bucket totals of each key, and the keys' grand totals.

    One row per bucket: a key with 10^12 rows in chunks of 8192 brings 10^8 narrow rows to this window,
    an md5 order at most 16^digits.
    """
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*keys, "_bucket",
                        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_off_{n}") for n in names],
                        *[F.sum(of).over(whole).alias(f"_all_{of}") for of in dict.fromkeys(totals.values())])


def running(df: DataFrame, *, order: Sequence[Column | str], bucket: Column, keys: Sequence[str] = (),
            index: str | None = None, sums: dict[str, Column] | None = None,
            totals: dict[str, str] | None = None, as_type: str = "long") -> DataFrame:
    """Add exclusive running totals along a total order, per key.

    ``order`` must be unique within ``keys`` and ``bucket`` non-decreasing along it.  ``index`` names
    the 0-based dense position; ``sums`` maps new column names to the long values to total before
    each row (``as_type`` makes them doubles); ``totals`` maps further names to an index or sum whose whole-key total is wanted.
    A null key is a key like any other; rows with a null bucket come first.

    Plan: one shuffle of the rows by (keys, bucket) that serves window and join, and one map-side
    combined shuffle of the bucket totals, which read only the columns the totals need.
    """
    keys = list(keys)
    values = {name: col(v).cast(as_type) for name, v in (sums or {}).items()}
    if index:
        values[index] = F.lit(1).cast("long")
    names = list(values)
    keyed, safe = _bucketed(df, keys, bucket)
    sizes = keyed.groupBy(*safe, "_bucket").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    offsets = _bucket_offsets(sizes, safe, names, totals or {})
    w = Window.partitionBy(*safe, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(offsets, [*safe, "_bucket"])
    return placed.select(
        *df.columns,
        *[(F.col(f"_off_{n}") + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(n) for n, v in values.items()],
        *[F.col(f"_all_{of}").alias(n) for n, of in (totals or {}).items()])


def running_sparse(df: DataFrame, *, order: Sequence[Column | str], bucket: Column, keys: Sequence[str],
                   index: str | None = None, sums: dict[str, Column] | None = None,
                   totals: dict[str, str] | None = None, bound: int = CHUNK) -> DataFrame:
    """``running`` for keys of which most have few rows: only keys with more than ``bound`` rows are cut in buckets.

    The other keys are summed by one window and need no table of bucket totals, which would be about as long as
    the rows.  Long keys are found by map-side counts, at most one per ``bound`` rows.
    """
    keys = list(keys)
    long = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound).select(*keys), "long-keys")
    values = {name: col(v).cast("long") for name, v in (sums or {}).items()}
    if index:
        values[index] = F.lit(1).cast("long")
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    short = join_keys(df, long, keys, "left_anti").select(
        *df.columns, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(n) for n, v in values.items()],
        *[F.sum(values[of]).over(whole).alias(n) for n, of in (totals or {}).items()])
    if long.isEmpty():
        return short
    cut = running(join_keys(df, long, keys, "left_semi"), order=order, bucket=bucket, keys=keys, index=index, sums=sums, totals=totals)
    return short.unionByName(cut)


def count_ranks(counts: DataFrame, *, key: Column, index: str, n: str = "n", skip: int = 0) -> DataFrame:
    """Adds ``index``: the 0-based dense place of each row by falling ``n``, then by ``key``, a hex text.

    The places at which each count begins come from the histogram of the counts, one row per different count.
    Rows of one count are ranked by key, in buckets of its leading digits (behind ``skip`` constant ones); their
    number follows from how many rows have that count.  ``counts`` is read three times: stage it.
    """
    before = Window.orderBy(F.desc("_times")).rowsBetween(Window.unboundedPreceding, -1)
    histogram = counts.groupBy(F.col(n).alias("_times")).agg(F.count(F.lit(1)).alias("_words"))
    histogram = stage(histogram.select(
        "_times", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_first"),
        F.greatest(F.ceil(F.log(F.col("_words") / CHUNK) / F.log(F.lit(16.0))), F.lit(0)).cast("int").alias("_digits")), "histogram")
    keyed = counts.withColumn("_key", key).join(histogram, F.col(n) == F.col("_times"))
    leading = F.conv(F.expr(f"substring(_key, 1, _digits + {skip})"), 16, 10).cast("long")
    ranked = running(keyed, order=["_key"], keys=["_times"], bucket=F.when(F.col("_digits") > 0, leading).otherwise(0), index="_in")
    return ranked.select(*counts.columns, (F.col("_first") + F.col("_in")).alias(index))


def shuffled(df: DataFrame, id_col: str, *, seed: int = 1024, epoch: int = 0, keys: Sequence[str] = (),
             index: str = "idx", sums: dict[str, Column] | None = None,
             totals: dict[str, str] | None = None, digits: int | None = None) -> DataFrame:
    """Seeded shuffle as a column: the 0-based position of each row in md5 order, per key."""
    keyed = df.withColumn("_key", shuffle_key(id_col, seed=seed, epoch=epoch))
    out = running(keyed, order=["_key", id_col], bucket=md5_bucket("_key", digits or digits_for(df)), keys=keys,
                  index=index, sums=sums, totals=totals)
    return out.drop("_key")


def previous_row(df: DataFrame, *, order: str, bucket: Column, keys: Sequence[str], cols: dict[str, str],
                 ahead: bool = False) -> DataFrame:
    """``lag`` (or ``lead`` with ``ahead``) by one row per key, split by bucket.

    ``cols`` maps new names to existing columns.  The row across a bucket edge comes from a table of
    the edge rows, one per (key, bucket).
    """
    keys = list(keys)
    keyed, safe = _bucketed(df, keys, bucket)
    packed = F.struct(*[F.col(src).alias(new) for new, src in cols.items()])
    edge = F.min_by(packed, F.col(order)) if ahead else F.max_by(packed, F.col(order))
    edges = keyed.groupBy(*safe, "_bucket").agg(edge.alias("_edge"))
    step = Window.partitionBy(*safe).orderBy(F.desc("_bucket") if ahead else F.col("_bucket"))
    edges = edges.select(*safe, "_bucket", F.lag("_edge").over(step).alias("_edge"))
    w = Window.partitionBy(*safe, "_bucket").orderBy(F.desc(order) if ahead else F.col(order))
    joined = keyed.join(edges, [*safe, "_bucket"])
    first = F.row_number().over(w) == 1
    out = joined.withColumn("_lag", F.when(first, F.col("_edge")).otherwise(F.lag(packed).over(w)))
    return out.select(*df.columns, *[F.col("_lag")[new].alias(new) for new in cols])


def sample_exact(df: DataFrame, id_col: str, n: int, seed: int = 1024, digits: int | None = None) -> DataFrame:
    """Exactly ``min(count, n)`` rows without replacement: the first ``n`` in md5 order.

    The sizes of the md5 buckets tell which leading ones surely hold ``n`` rows; only their rows are ranked, where
    they are.  ``n`` is the feature (a sample size); the plan is the same for every ``n``.
    """
    keyed = df.withColumn("_key", shuffle_key(id_col, seed=seed))
    bucket = md5_bucket("_key", digits or digits_for(df))
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    sizes = keyed.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    last = sizes.agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_bucket"))), F.max("_bucket"))).scalar()
    kept = running(keyed.where(bucket <= last), order=["_key", id_col], bucket=bucket, index="_pos")
    return kept.where(F.col("_pos") < n).drop("_key", "_pos")


def sample_ratio(df: DataFrame, id_col: str, ratios: dict[str, float] | float, *, key: str | None = None,
                 seed: int = 1024, digits: int | None = None) -> DataFrame:
    """``int(n * r)`` rows per key: ``floor(r)`` full copies and distinct extras in md5 order.

    Adds ``copy`` (0-based).  ``ratios`` is one number, or one per value of ``key`` (missing: 1.0).
    """
    keys = [key] if key else []
    if isinstance(ratios, dict):
        r = F.lit(1.0)
        for name, value in ratios.items():
            r = F.when(F.col(key) == name, F.lit(float(value))).otherwise(r)
    else:
        r = F.lit(float(ratios))
    placed = shuffled(df, id_col, seed=seed, keys=keys, index="_pos", totals={"_n": "_pos"}, digits=digits)
    whole = F.floor(r).cast("long")
    extras = F.floor(F.col("_n") * r).cast("long") - F.col("_n") * whole
    copies = whole + F.when(F.col("_pos") < extras, 1).otherwise(0)
    return (placed.withColumn("_copies", copies).where("_copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
            .select(*df.columns, "copy"))


def sample_with_replacement(df: DataFrame, id_col: str, ratio: float, *, rows: int, seed: int = 1024,
                            digits: int | None = None) -> DataFrame:
    """``int(ratio * rows)`` independent draws; adds ``draw``.  ``rows`` is the row count of ``df``."""
    spark = df.sparkSession
    picks = spark.range(int(rows * ratio)).select(
        F.col("id").alias("draw"),
        F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:draw:"), F.col("id").cast("string"))), 1, 15),
                      16, 10).cast("long"), F.lit(rows)).alias("_pos"))
    return shuffled(df, id_col, seed=seed, index="_pos", digits=digits).join(picks, "_pos").drop("_pos")


def mix(parts: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Union of corpora by column name, with a ``source`` column."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(source, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedup_split(df: DataFrame, id_col: str, order: str, bucket: Column) -> DataFrame:
    """Flag the first row of each id (``dup`` = 0) and the later ones (``dup`` = their rank).

    Copies of an id with many rows are ranked in bounded buckets, so a third of all rows sharing an id
    still spreads over many tasks.
    """
    return running_sparse(df, order=[order], bucket=bucket, keys=[id_col], index="dup")
