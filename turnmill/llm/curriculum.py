"""Mixing sources to target weights along a time-varying curriculum (DataFrame operations only).

Every source has a target number of words and a weight schedule over the training time 0 to 1, given at equally spaced
knots and linear between them.  The integral of the schedule, scaled to the target, is the source's cumulative demand.
The documents of a source stand in a seeded order; a copy whose words reach from ``before`` to ``before + size`` is used
if its middle lies below the target, and its training position is the time at which the cumulative demand reaches that
middle.  Documents are then sorted by position.

Sizes are counts of runs of characters other than ASCII white space (null text: 0).  Sources are told apart exactly; null
is a source of its own, the last in order.  A document is used whole, at most ``MAX_COPIES`` times; words taken differ from
the target by at most half a document.  Documents without words are used while the target is not reached.  Repeated rows
are separate documents.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import by_range, range_cuts, range_of, small, stage
from turnmill.operators.order import md5_bucket, running, shuffle_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
# Weight schedules at times 0, 0.5 and 1, given to the sources in turn: early, even, late.
SCHEDULES = ((2.0, 1.0, 0.0), (1.0, 1.0, 1.0), (0.0, 1.0, 2.0))
BUCKET_ROWS = 2_000
SEED = 9
# Words in a range of the sorted mix.
RANGE_WORDS = 2_000_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def allocate(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """Adds ``rank``, ``weight`` and ``target`` to ``(key, source, source_size)``, one row per source.

    The demand (``share`` of all words) goes to the sources by weight, none above ``most`` times its size.  In ascending
    order of limit per weight, the level of the demand is the first at which the next source is below its limit.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
    ranked = ranked.withColumn("limit", F.col("source_size") * most)
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    below = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * share - below) / above
    levelled = ranked.withColumn("level", level).withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    chosen = F.min(fits).over(whole)["level"]
    target = F.coalesce(F.least(F.col("limit").cast("double"), chosen * F.col("weight")), F.col("limit").cast("double"))
    return levelled.select("key", "source", "source_size", "rank", "weight", target.alias("target"))


def shapes(schedules: Sequence[Sequence[float]], which: Column) -> Column:
    """``struct(knots, upto)`` of the schedule number ``which`` (from 1): its weights, and its integral up to each knot."""
    knots = [[float(w) for w in s] for s in schedules]
    upto = [list(accumulate(((a + b) / (2 * (len(s) - 1)) for a, b in pairwise(s)), initial=0.0)) for s in knots]
    return F.struct(F.element_at(F.lit(knots), which).alias("knots"), F.element_at(F.lit(upto), which).alias("upto"))


def time_of(share: Column, shape: Column, pieces: int) -> Column:
    """The time at which the integral of a piecewise linear schedule (of ``shapes``) reaches ``share``; plain arithmetic.

    ``pieces`` is the greatest number of pieces that any of the schedules has.
    """
    knots, upto = shape["knots"], shape["upto"]
    m = F.size(knots) - 1
    reached = share * F.element_at(upto, -1)
    passed = sum((F.when(F.get(upto, F.lit(k)) <= reached, 1).otherwise(0) for k in range(1, pieces + 1)), F.lit(0))
    piece = F.least(passed, m - 1)
    start = F.get(knots, piece)
    rest, rise = reached - F.get(upto, piece), (F.get(knots, piece + 1) - start) * m
    under = start + F.sqrt(F.greatest(start * start + 2 * rise * rest, F.lit(0.0)))
    return F.least((piece + F.when(under > 0, 2 * rest / under * m).otherwise(0.0)) / m, F.lit(1.0))


def _rows(documents: DataFrame, keep: Sequence[str], seed: int) -> DataFrame:
    """``rec`` (the columns to keep), source key, size, and the place in the seeded order."""
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("all"))
    return whole.select(F.struct(*[F.col("all")[c].alias(c) for c in keep]).alias("rec"), F.col("all")["source"].alias("source"),
                        source_key(F.col("all")["source"]).alias("key"), n_words(F.col("all")["text"]).alias("size"),
                        shuffle_key(F.col("all")["doc_id"], seed=seed).alias("at"), F.xxhash64(F.col("all")["text"]).alias("tie"))


def _targets(rows: DataFrame, weights: Sequence[int], share: float, schedules: Sequence[Sequence[float]]) -> tuple[DataFrame, int, int]:
    """``(key, source_size, target, shape)`` per source, the digits that cut the seeded order in short buckets, and the
    pieces of the longest schedule."""
    sources = stage(rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"),
                                            F.count(F.lit(1)).alias("n")), "mix-sources")
    total = sources.agg(F.sum("n")).first()[0] or 0
    digits = 1
    while digits < 8 and 16 ** digits * BUCKET_ROWS < total:
        digits += 1
    found = allocate(sources, weights, share).select("key", "source_size", "target", shapes(schedules, F.col("rank") % len(schedules) + 1).alias("shape"))
    return stage(found, "mix-targets"), digits, max(len(s) for s in schedules) - 1


def _place(rows: DataFrame, targets: DataFrame, digits: int, pieces: int) -> DataFrame:
    placed = running(rows, order=["at", "tie", "size"], bucket=md5_bucket("at", digits), keys=["key"], index="nth", sums={"before": F.col("size")})
    aimed = placed.join(small(targets), "key")
    middles = [F.col("before") + F.col("size") / 2 + c * F.col("source_size") for c in range(MAX_COPIES)]
    # A later copy is used only if the earlier ones are.
    n_used = sum((F.when(at < F.col("target"), 1).otherwise(0) for at in middles), F.lit(0))
    positions = F.array(*[time_of(F.try_divide(at, F.col("target")), F.col("shape"), pieces) for at in middles])
    return aimed.select("key", "nth", "rec", "at", "size", "source_size", "target", (n_used * F.col("size")).cast("long").alias("taken"),
                        F.slice(positions, F.lit(1), n_used).alias("positions"))


def plan(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
         schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = SEED, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``(rec, size, source_size, target, taken, positions)``, one row per document; ``rec`` holds the columns to keep.

    ``positions`` are the training positions of the copies used, so its size is their number.  Texts are read once;
    all else works on the short rows written then.
    """
    rows = stage(_rows(documents, keep, seed), "mix-sizes")
    return _place(rows, *_targets(rows, weights, share, schedules)).drop("key", "nth", "at")


def _ticks(position: Column) -> Column:
    return F.floor(position * float(1 << 40)).cast("long")


def _cuts(copies: DataFrame) -> list[int]:
    """Range cuts of the training positions; ``copies`` (position, size) has one row per copy."""
    used = stage(copies.select(_ticks(F.col("position")).alias("tick"), (F.col("size") + 1).alias("weight")), "mix-positions")
    return range_cuts(used, "tick", "weight", RANGE_WORDS)


def _sorted(copies: DataFrame, cuts: list[int]) -> DataFrame:
    """``copies`` (with position, at, copy) in training order, one partition per range of positions."""
    return by_range(copies.withColumn("range", range_of(_ticks(F.col("position")), cuts)), "range", cuts, "position", "at", "copy")


def dealt(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
          schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = SEED, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The rows of ``plan``, taken from the mix itself: its short rows are sorted by position and staged as ``mix-order``.

    ``taken`` and ``positions`` (ascending) are counted from the sorted copies; documents that are not in the mix are
    added without copies.  A document is known by its source and its place ``nth`` in the source's order.
    """
    rows = stage(_rows(documents, keep, seed), "mix-sizes")
    planned = stage(_place(rows, *_targets(rows, weights, share, schedules)).drop("taken"), "mix-plan")
    whole = ["rec", "size", "source_size", "target"]
    copies = planned.select("key", "nth", "at", *whole, F.posexplode("positions").alias("copy", "position"))
    order = stage(_sorted(copies, _cuts(copies)).drop("range"), "mix-order")
    used = order.groupBy("key", "nth").agg(*[F.first(c).alias(c) for c in whole], F.sum("size").cast("long").alias("taken"),
                                           F.array_sort(F.collect_list("position")).alias("positions")).drop("key", "nth")
    unused = planned.where(F.size("positions") == 0).select(*whole, F.lit(0).cast("long").alias("taken"), "positions")
    return used.unionByName(unused)


def mix(documents: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
        schedules: Sequence[Sequence[float]] = SCHEDULES, seed: int = SEED) -> DataFrame:
    """The documents in training order: all their columns, each row once per copy used, range-sorted by position.

    The ranges are cut on a plan without texts, so that the documents themselves are placed and sorted once: one shuffle
    to their place in the source's order, one to their range.
    """
    short = stage(_rows(documents, ("doc_id",), seed), "mix-sizes")
    aims = _targets(short, weights, share, schedules)
    cuts = _cuts(_place(short, *aims).select(F.explode("positions").alias("position"), "size"))
    copies = _place(_rows(documents, documents.columns, seed), *aims).select("rec", "at", F.posexplode("positions").alias("copy", "position"))
    return _sorted(copies, cuts).select("rec.*")
