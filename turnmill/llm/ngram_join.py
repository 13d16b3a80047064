"""Jaccard join of word n-gram sets by adaptive prefixes that must match several times.

All documents order their shingles alike.  If two sets of n shingles overlap enough, their prefixes of ``n - o + k``
shingles share at least k of them, for every k (o is the least overlap a set can have with a partner: ``ceil(t n)``).  A longer
prefix finds more meetings, but asks for more of them before two sets are compared.

1. ``sets``: every text becomes its set of hashed shingles; equal sets are one class from the start, so copies cost a row each
   and are never paired.  The pass also counts frequent shingles (a mergeable summary of bounded size).
2. The order is that of the hashes, with the frequent shingles behind all others.  ``indexed``: each class lists the prefix of
   the greatest depth; the lists of all shingles are counted, those of one class go.
3. ``chosen``: for each of some depths k, the counted lists give what a class would cost: the entries to scan, and the partners
   to verify, at most (entries / k).  Each class takes the cheapest depth.  A class with fewer than k shared shingles at any
   depth k has no partner and goes.
4. ``dense``: the whole sets of these classes are listed.  What a set must share with a partner depends on the partner's size, so
   its shingles are counted that others of each band of sizes have.  A class with too few for partners of any band has none, and
   goes; that is repeated, as its shingles may have been all that others had in common with anyone.  Text that many documents
   share, but not enough of it to link, brings nobody together beyond this point.
5. ``starred``: each class is verified against a few leaders of its lists, first those with the fewest shingles of their own, as
   these stand in the middle of their groups, then those with the most links so far.  That is linear, and makes one cluster of
   most groups of near copies.  Pairs that miss a link by ``LOOSE`` per cent points at most make groups of clusters.
6. ``candidates``: groups meet in their lists (long lists are cut in blocks, whose pairs of blocks are joined in different tasks);
   two groups are close if they share as many shingles as the smallest of their depths asks for.
7. ``spokes``: only classes of different clusters are still to be compared, of one group or of close ones.  They share most of
   their text, so each is told by its differences from one pivot of the (larger) group: one row per class, not one per pair.
8. ``meetings``: two sets are as far apart as their differences from a pivot are.  A class that does not link to the pivot lies
   beyond its reach, so a partner must make up for that by differences in common: at least half of those of a class that links to
   it.  The prefixes of the differences, the rarest first, find the pairs that share several.
9. ``verified``: pairs are compared on bitmaps of their sets, which bound what they share from above, then on whole sets.  Both
   are packed by blocks of neighbours, so that a set is sent once per pair of blocks.

The links that come out connect what all links would connect; pairs inside a cluster of step 5 are not listed.

Shingles are told apart by 64-bit hashes: inside a pair of sets of 10,000 shingles a mix-up has a chance of 1e-11.  Classes are
told apart by 128 bits.  Words: A-Z lower-cased, runs of characters other than ASCII white space; fewer words than a shingle:
the whole sequence is the one shingle.  Without words a document has an empty set and no links; its component is itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, slices, small, stage
from turnmill.llm.components import components

SHINGLE = 3
PERCENT = 90
# Depths tried, in quarters of the greatest one; that is a fifth of the set, or so many shingles if the set is short.
QUARTERS = 4
LEAST_DEPTH = 16
# Entries of the summary of frequent shingles; a task reports those that at least so many, and one in so many, of its texts hold.
FREQUENT = 1 << 16
REPORTED, REPORTED_PART = 8, 64
# Leaders against which a class is verified in each round.
LEADERS = (6, 4)
# Classes whose similarity misses that of a link by so many per cent points at most are in one group.
LOOSE = 20
# Differences that the prefixes ask for, if the pair needs so many: more than one word in another place or changed can make.
DIFFERENCES = 2 * SHINGLE + 1
# Bands of sizes between a set and its smallest partner; the bands to both sides fit in 64 bits.
BANDS = 11
# Rounds in which classes are dropped that share too little of their whole sets; more rounds drop no class that has a partner.
ROUNDS = 3
# A list of more classes is cut in blocks of about so many.
BLOCK = 256
# Classes and shingles in a block of neighbours whose pairs are verified together.
GROUP, GROUP_TOKENS = 64, 1 << 16
# Cost of verifying a shingle, against scanning a list entry.
VERIFY = 0.05
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MULTIPLY[1]
    h = (h ^ (h >> np.uint64(27))) * MULTIPLY[2]
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles of texts; word hashes are kept from text to text, up to a bound."""

    def __init__(self, size: int = SHINGLE, held: int = 1 << 20) -> None:
        self.size, self.held = size, held
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        import xxhash
        if not text:
            return np.zeros(0, np.uint64)
        parts = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > self.held:
            known.clear()
        for w in set(parts).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 13)
        return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))

    def set_of(self, text: str | None) -> np.ndarray:
        """The hashes of the text's different shingles, ascending."""
        w = self.words(text)
        if not len(w):
            return w
        size = min(self.size, len(w))
        h = np.full(len(w) - size + 1, np.uint64(size))
        for k in range(size):
            h = mixed((h + MULTIPLY[0]) * MULTIPLY[1] + w[k:len(w) - size + 1 + k])
        h.sort()
        return h[np.concatenate(([True], h[1:] != h[:-1]))]


class Frequent:
    """Counts of frequent values in bounded space: sorted values with counts that are too low by at most ``total / size``."""

    def __init__(self, size: int = FREQUENT) -> None:
        self.size, self.total = size, 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        self.total += len(values)
        fresh, times = np.unique(values, return_counts=True)
        merged, place = np.unique(np.concatenate([self.values, fresh]), return_inverse=True)
        counts = np.bincount(place.reshape(-1), np.concatenate([self.counts, times]), len(merged)).astype(np.int64)
        if len(merged) > self.size:
            counts = counts - np.partition(counts, -self.size - 1)[-self.size - 1]
        self.values, self.counts = merged[counts > 0], counts[counts > 0]

    def leading(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        keep = (self.counts * self.size >= self.total) & (self.counts >= least)
        return self.values[keep], self.counts[keep]


def overlap_bound(n: Column, percent: int = PERCENT) -> Column:
    """The least number of shingles a set of ``n`` shares with a partner."""
    return F.ceil(n * percent / F.lit(100)).cast("long")


def depth_of(n: np.ndarray | int, percent: int = PERCENT):
    """The greatest depth for sets that share at least ``n`` shingles: grows with ``n``, and never beyond ``n``."""
    return np.maximum(np.minimum(-(-n * percent // 100), np.maximum(n // 5, LEAST_DEPTH)), 1)


ROW = "doc_id long, text_hash long, n long, k1 long, k2 long, often array<struct<value:long,times:long>>"


def _texts(documents: DataFrame) -> DataFrame:
    return read_only_columns(documents, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def sets(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``ROW``: every document with its set's size and 128-bit key; a row more per task lists frequent shingles in ``often``."""
    names = [f.split()[0] for f in ROW.split(", ")]
    kind = pa.list_(pa.struct([("value", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, often, texts = Shingler(size), Frequent(), 0
        for batch in slices(batches):
            found = [shingler.set_of(t) for t in batch["text"].to_pylist()]
            texts += len(found)
            keys = np.frombuffer(b"".join(hashlib.md5(s.tobytes()).digest() for s in found), np.int64).reshape(-1, 2)
            if found:
                often.add(np.concatenate(found))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in found], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                 pa.nulls(len(found), kind)], names)
        values, counts = often.leading(max(REPORTED, texts // REPORTED_PART))
        listed = [{"value": v, "times": c} for v, c in zip(values.view(np.int64).tolist(), counts.tolist(), strict=True)]
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array([listed], kind)], names)

    return _texts(documents).mapInArrow(run, ROW)


def frequent_shingles(rows: DataFrame, size: int = FREQUENT) -> np.ndarray:
    """Frequent shingles by rising count, then hash; at most ``size``, because their counts add up to at most the total."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    each = rows.where("often IS NOT NULL").select(F.inline("often"))
    found = each.groupBy("value").agg(F.sum("times").alias("n")).where(F.col("n") >= max(-(-total // size), 2)).collect()
    return np.array([r["value"] for r in sorted(found, key=lambda r: (r["n"], r["value"]))], np.int64).view(np.uint64)


def rank_of(values: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Permutation that sorts a set: infrequent hashes first, then the frequent ones in the order of ``often``."""
    if not len(often):
        return np.arange(len(values))
    by_hash = np.argsort(often)
    at = np.minimum(np.searchsorted(often, values, sorter=by_hash), len(often) - 1)
    place = by_hash[at]
    late = np.where(often[place] == values, place + 1, 0)
    return np.argsort(late, kind="stable")


def _first_texts(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """``(row, n, text)`` of one document per class of ``classes`` (row, n, doc_id, text_hash, times)."""
    texts = _texts(documents)

    def of(part: DataFrame) -> DataFrame:
        wanted = small(part.select("row", "n", F.col("doc_id").alias("d"), F.col("text_hash").alias("h")))
        return texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["d"]) & (texts["text_hash"] == wanted["h"])).select("row", "n", "text")

    repeated = classes.where("times > 1")
    once = of(classes.where("times = 1"))
    # Rows that repeat id and text: only theirs are shuffled.
    return once if repeated.isEmpty() else once.unionByName(of(repeated).dropDuplicates(["row"]))


def indexed(documents: DataFrame, classes: DataFrame, often: np.ndarray, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(row, pos, token)``: the prefix of the greatest depth of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        kind = pa.list_(pa.int64())
        for batch in slices(batches):
            out = []
            for text in batch["text"].to_pylist():
                s = shingler.set_of(text)
                n = len(s)
                upto = min(n - -(-n * percent // 100) + int(depth_of(n, percent)), n)
                out.append(s[rank_of(s, often)[:upto]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, kind)], ["row", "tokens"])

    lists = _first_texts(documents, classes).mapInArrow(run, "row long, tokens array<long>")
    return lists.select("row", F.posexplode("tokens").alias("pos", "token"))


def listed(index: DataFrame) -> DataFrame:
    """``index`` with the ``length`` of each token's list, lists of one class left out: one shuffle counts and keeps them."""
    return index.withColumn("length", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("length > 1")


def depth_at(n: Column, quarter: int, percent: int = PERCENT) -> Column:
    """The depth number ``quarter`` (from 1) of a set of ``n``: that many quarters of the greatest depth its partners all have."""
    o = overlap_bound(n, percent)
    top = F.greatest(F.least(overlap_bound(o, percent), F.greatest(F.floor(o / 5), F.lit(LEAST_DEPTH))), F.lit(1))
    return F.greatest(F.floor(top * quarter / QUARTERS), F.lit(1)).cast("long")


def pair_bound(n1: Column, n2: Column, percent: int = PERCENT) -> Column:
    """The least number of shingles that two sets of these sizes share if they link."""
    return F.ceil((n1 + n2) * percent / F.lit(100 + percent)).cast("long")


def chosen(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(row, n, depth)`` of the classes that can have partners; ``entries`` (row, n, pos, length) are in shared lists."""
    o = overlap_bound(F.col("n"), percent)
    sums = []
    for k in range(1, QUARTERS + 1):
        inside = F.col("pos") < F.col("n") - o + depth_at(F.col("n"), k, percent)
        sums += [F.count(F.when(inside, 1)).alias(f"met{k}"), F.sum(F.when(inside, F.col("length") - 1).otherwise(0)).alias(f"scan{k}")]
    costs = entries.groupBy("row", "n").agg(*sums)
    enough = F.lit(True)
    choices = []
    for k in range(1, QUARTERS + 1):
        depth = depth_at(F.col("n"), k, percent)
        enough = enough & (F.col(f"met{k}") >= depth)
        choices.append(F.struct((F.col(f"scan{k}") + F.col(f"scan{k}") / depth * F.col("n") * VERIFY).alias("cost"), depth.alias("depth")))
    return costs.where(enough).select("row", "n", F.array_min(F.array(*choices))["depth"].alias("depth"))


def band_of(n: Column, percent: int = PERCENT) -> Column:
    """Number of a size's band; the sizes of a set's partners reach ``BANDS`` bands to either side."""
    return F.floor(F.log(n.cast("double")) / band_step(percent)).cast("int")


def band_step(percent: int) -> float:
    return max(math.log(100 / percent) / BANDS, 1e-3)


def met_by_band(tokens: DataFrame) -> DataFrame:
    """``tokens`` (row, n, band, token) that another class has, with ``bands``: bit ``band % 64`` is set if another class of that band has it."""
    everyone, own = Window.partitionBy("token"), Window.partitionBy("token", "band")
    marked = tokens.withColumn("bit", F.expr("shiftleft(1L, pmod(band, 64))")).withColumn("peers", F.count(F.lit(1)).over(own))
    marked = marked.withColumn("m", F.count(F.lit(1)).over(everyone)).withColumn("all_bands", F.bit_or("bit").over(everyone))
    bands = F.when(F.col("peers") > 1, F.col("all_bands")).otherwise(F.col("all_bands").bitwiseAND(F.bitwise_not("bit")))
    return marked.where("m > 1").select("row", "n", "band", "token", bands.alias("bands"))


def dense(whole: DataFrame, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """``(row, own)`` of the classes of ``whole`` (row, n, set) that share enough of their whole sets with others, after ``rounds``.

    Enough for a partner depends on its size, so the shingles are counted that others of each band of sizes have; ``own`` is
    the number of shingles that nobody else has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets_ = [np.frombuffer(b, np.int64) for b in batch["set"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["n"], pa.array(sets_, pa.list_(pa.int64()))], ["row", "n", "tokens"])

    # One band more on either side than exact logarithms would ask for.
    aways = range(-BANDS - 1, BANDS + 2)
    has = [F.expr(f"shiftrightunsigned(bands, pmod(band + {k}, 64)) & 1L") for k in aways]
    enough = F.lit(False)
    for i, k in enumerate(aways):
        least = F.ceil(F.exp((F.col("band") + k) * band_step(percent)) * (1 - 1e-9)).cast("long")
        enough = enough | (F.col(f"met{i}") >= pair_bound(F.col("n"), F.greatest(least, overlap_bound(F.col("n"), percent)), percent))
    left = whole.select("row", "n")
    listed_ = whole.select("row", "n", "set").mapInArrow(run, "row long, n long, tokens array<long>")
    tokens = listed_.select("row", "n", band_of(F.col("n"), percent).alias("band"), F.explode("tokens").alias("token"))
    for _ in range(rounds):
        shared = stage(met_by_band(tokens), "ngram-shared")
        met = shared.groupBy("row", "n", "band").agg(F.count(F.lit(1)).alias("met"), *[F.sum(b).alias(f"met{i}") for i, b in enumerate(has)])
        before = left
        left = stage(met.where(enough).select("row", "n", (F.col("n") - F.col("met")).alias("own")), "ngram-dense")
        if left.count() == before.count():
            break
        tokens = shared.drop("bands").join(small(left.select("row")), "row", "left_semi")
    return left.select("row", "own")


def postings(entries: DataFrame, depths: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(row, n, token, depth)``: the entries of the chosen prefixes."""
    inside = F.col("pos") < F.col("n") - overlap_bound(F.col("n"), percent) + F.col("depth")
    return entries.join(small(depths), "row").where(inside).select("row", "n", "token", "depth")


def starred(kept: DataFrame, ranks: DataFrame, leaders: int) -> DataFrame:
    """``(a, b)``: each class with the ``leaders`` leaders that stand in most of its lists; ``kept`` are staged postings.

    A list is led by the class with the least ``rank`` in ``ranks`` (row, rank), 0 where it has none; equal ones are drawn by
    hash, a different one in every list.
    """
    ranked = kept.select("row", "token").join(small(ranks), "row", "left").fillna(0, ["rank"])
    best = F.min(F.struct("rank", F.xxhash64("row", "token").alias("draw"), "row")).alias("best")
    heads = ranked.groupBy("token").agg(best, F.count(F.lit(1)).alias("m")).where("m > 1").select("token", F.col("best.row").alias("leader"))
    met = kept.join(heads, "token").where("row <> leader").groupBy("row", "leader").agg(F.count(F.lit(1)).alias("m"))
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("m"), F.xxhash64("row", "leader")))
    top = met.withColumn("place", place).where(F.col("place") <= leaders)
    return top.select(F.least("row", "leader").alias("a"), F.greatest("row", "leader").alias("b")).distinct()


def degrees(links: DataFrame) -> DataFrame:
    """``(row, rank)`` of the classes in ``links``: most links first."""
    ends = links.select(F.explode(F.array("a", "b")).alias("row"))
    return stage(ends.groupBy("row").agg((-F.count(F.lit(1))).alias("rank")), "ngram-degrees")


def candidates(kept: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(one, two)``: clusters that share enough for a pair of their classes to link; ``kept`` (row, n, token, depth, cluster) is staged.

    A pair of clusters shares at least what any of its pairs of classes shares.
    """
    units = kept.groupBy("token", "cluster").agg(F.min("depth").alias("depth"), F.min("n").alias("least"), F.max("n").alias("most"))
    lists = units.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("m > 1")
    placed = lists.withColumn("parts", F.ceil(F.col("m") / block).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("cluster"), F.col("parts")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "cluster", "least", "most", "depth", "token", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    x, y = cells.alias("x"), cells.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.low") == F.col("y.low")) & (F.col("x.high") == F.col("y.high"))
    once = (F.col("x.low") == F.col("x.high")) | (F.col("x.part") != F.col("y.part"))
    sizes = (F.col("x.least") * percent <= F.col("y.most") * 100) & (F.col("y.least") * percent <= F.col("x.most") * 100)
    met = x.join(y, same & (F.col("x.cluster") < F.col("y.cluster")) & once & sizes)
    shared = met.groupBy(F.col("x.cluster").alias("one"), F.col("y.cluster").alias("two")).agg(
        F.count(F.lit(1)).alias("shared"), F.min(F.least("x.depth", "y.depth")).alias("need"))
    return shared.where("shared >= need").select("one", "two")


def spokes(classes: DataFrame, close: DataFrame, ranks: DataFrame) -> DataFrame:
    """``(row, pivot)``: the classes still to be compared, each with the pivots around which it is.

    ``classes`` (row, cluster, grouped) and ``close`` (one, two: groups) are staged.  A group of several clusters is around its own
    pivot, the class with the least ``rank`` in ``ranks`` (row, rank); two close groups are around that of the one with more classes.
    """
    first = F.min_by("row", F.struct(F.coalesce("rank", F.lit(0)), "row")).alias("pivot")
    groups = stage(classes.join(small(ranks), "row", "left").groupBy("grouped").agg(
        F.count(F.lit(1)).alias("m"), (F.min("cluster") < F.max("cluster")).alias("several"), first), "ngram-groups")
    one, two = (groups.select(F.col("grouped").alias(g), F.struct("m", "pivot").alias(f"at_{g}")) for g in ("one", "two"))
    across = small(close).join(one, "one").join(two, "two").select(
        F.explode(F.array("one", "two")).alias("grouped"), F.greatest("at_one", "at_two")["pivot"].alias("pivot"))
    around = stage(groups.where("several").select("grouped", "pivot").unionByName(across).distinct(), "ngram-around")
    return classes.join(small(around), "grouped").where("row <> pivot").select("row", "pivot")


def needed(percent: int = PERCENT) -> tuple[Column, Column, Column]:
    """``(far, need, lesser)`` of a set of ``n`` shingles, ``d`` of which or of its pivot's ``pn`` are in one of both alone.

    Sets of n1 and n2 link if at most ``r (n1 + n2)`` shingles are in one alone (r: ``(100 - percent) / (100 + percent)``), and these
    are their differences from the pivot, less twice those in common.  ``far``: no link to the pivot.  Two sets that are not both
    linked to it have at least ``need`` differences in common if they link, and ``lesser`` if this one has no more than the other.
    """
    d, n, both = F.col("d"), F.col("n"), F.col("n") + F.col("pn")
    beyond = d * (100 + percent) - both * (100 - percent)
    need = F.when(beyond > 0, F.ceil(beyond / F.lit(200))).otherwise(F.floor(d * percent / F.lit(100 + percent)) + 1)
    lesser = F.greatest(need, F.ceil((d * (2 * percent) - n * (100 - percent)) / F.lit(2 * percent)))
    return beyond > 0, need, lesser


def meetings(apart: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: pairs of different clusters with as many differences in common as a link asks for.

    ``apart`` (row, n, cluster, pivot, pn, d, tokens) has the differences of classes from their pivots.
    """
    far, need, lesser = needed(percent)
    # A prefix leaves out the last differences: as many as a pair can have in common beyond those that the prefix asks for.
    left, left_lesser = (F.greatest(c - DIFFERENCES, F.lit(0)) for c in (need, lesser))
    listed_ = apart.select("row", "n", "cluster", "pivot", "d", far.alias("far"), left.alias("out"), left_lesser.alias("out_lesser"),
                           F.explode("tokens").alias("token"))
    counted = listed_.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("pivot", "token")))
    placed = counted.withColumn("pos", F.row_number().over(Window.partitionBy("pivot", "row").orderBy("m", "token")))
    lists = placed.where("m > 1 AND pos <= d - out").withColumn("parts", F.ceil(F.col("m") / block).cast("int"))
    x = lists.where("pos <= d - out_lesser").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).alias("x")
    y = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    same = (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part"))
    once = (F.struct("x.d", "x.row") < F.struct("y.d", "y.row")) & (F.col("x.cluster") != F.col("y.cluster")) & (F.col("x.far") | F.col("y.far"))
    fits = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    # What a pair must have in common, and can have: before a difference in common, it and those behind it.
    bound = F.ceil(((F.col("x.d") + F.col("y.d")) * (100 + percent) - (F.col("x.n") + F.col("y.n")) * (100 - percent)) / F.lit(2 * (100 + percent)))
    behind = F.least(F.col("x.d") - F.col("x.pos"), F.col("y.d") - F.col("y.pos"))
    met = x.join(y, same & once & fits & (F.least("x.pos", "y.pos") + behind >= bound)).select(
        "x.pivot", F.col("x.row").alias("one"), F.col("y.row").alias("two"), bound.alias("bound"),
        F.greatest("x.out_lesser", "y.out").alias("out"), behind.alias("behind"))
    pairs = met.groupBy("pivot", "one", "two", "bound", "out").agg(F.count(F.lit(1)).alias("shared"), F.max("behind").alias("behind"))
    return pairs.where("shared >= bound - out AND behind + 1 >= bound").select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct()


def whole_sets(documents: DataFrame, classes: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(row, n, set, bits)``: the whole sets of the ``classes`` given, as bytes, and their ``bitmap``s."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches):
            found = [shingler.set_of(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["n"], pa.array([s.tobytes() for s in found], pa.binary()), pa.array([bitmap(s) for s in found], pa.binary())],
                ["row", "n", "set", "bits"])

    return _first_texts(documents, classes).mapInArrow(run, "row long, n long, set binary, bits binary")


def bitmap(values: np.ndarray) -> bytes:
    """The size of a set of hashes, then one bit for each value of their lowest binary digits, at least four bits a hash."""
    size = 1 << max(int(4 * len(values) - 1).bit_length(), 6)
    bits = np.zeros(size, bool)
    bits[(values & np.uint64(size - 1)).astype(np.int64)] = True
    return len(values).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, y: bytes) -> tuple[int, int]:
    """``(most, total)`` of two bitmaps: no more shingles than ``most`` are in both sets, and ``total`` are in one or the other, counted twice."""
    n1, n2 = (int.from_bytes(b[:8], "little") for b in (x, y))
    p, q = (np.frombuffer(b, np.uint8, offset=8) for b in (x, y))
    size = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (p, q))
    # A bit of one alone stands for at least one shingle of that set alone.
    return min(n1 - int(np.bitwise_count(p & ~q).sum()), n2 - int(np.bitwise_count(q & ~p).sum())), n1 + n2


def shared(x: bytes, y: bytes) -> tuple[int, int]:
    """``(number, total)`` of two sets, as bytes: the shingles in both, and those in one or the other, counted twice."""
    both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1])), len(both)


def verified(whole: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, with ``both`` and ``total`` of ``shared``; ``pairs`` and ``whole``
    (row, n, set, bits) are staged.

    The bitmaps, a sixteenth of the sets, drop most pairs that are not; no set is sent for those.
    """
    close = stage(compared(whole.withColumn("set", F.col("bits")).drop("bits"), pairs, most_shared, percent).select("a", "b"), "ngram-close-pairs")
    return compared(whole.drop("bits"), close, shared, percent)


def links(percent: int = PERCENT) -> Column:
    return F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent


def compared(whole: DataFrame, pairs: DataFrame, count: Callable[[bytes, bytes], tuple[int, int]], percent: int) -> DataFrame:
    """``(a, b, both, total)``: the pairs (a, b) that are similar enough by ``count`` of their rows of ``whole`` (row, n, set)."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in in_cells(batches):
            good = []
            for a, b, x, y in met:
                both, total = count(x, y)
                if 100 * both >= percent * (total - both):
                    good.append((a, b, both, total))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in range(4)], ["a", "b", "both", "total"])

    return cells(whole, pairs).mapInArrow(check, "a long, b long, both long, total long")


def differences(whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, tokens)``: for each pair (a, b) the shingles that one of both sets alone has; ``whole`` (row, n, set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for met in in_cells(batches):
            out = [(a, b, np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for a, b, x, y in met]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                              pa.array([o[2] for o in out], kind)], ["a", "b", "tokens"])

    return cells(whole, pairs).mapInArrow(run, "a long, b long, tokens array<long>")


def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, int, bytes, bytes]]]:
    """For each batch of ``cells`` its pairs (a, b) with their sets; a cell's sets are held while it lasts."""
    cell, held = None, {}

    def met(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, bytes]]:
        nonlocal cell, held
        for low, high, a, b, blob in zip(*(batch[c].to_pylist() for c in ("low", "high", "a", "b", "set")), strict=True):
            if (low, high) != cell:
                cell, held = (low, high), {}
            if a is None:
                held[b] = blob
            else:
                yield a, b, held[a], held[b]

    for batch in slices(batches, 1024):
        yield met(batch)


def cells(whole: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(low, high, a, b, set)``: in order, for each pair of blocks its sets (a: null, b: the row), then its pairs (a, b).

    Classes with the same smallest partner stand in blocks; a pair of blocks gets each of its sets once.
    """
    ends = pairs.select(F.col("a").alias("row"), F.col("b").alias("p")).unionByName(pairs.select(F.col("b").alias("row"), F.col("a").alias("p")))
    leads = ends.groupBy("row").agg(F.least(F.min("p"), F.col("row")).alias("lead"))
    members = stage(leads.join(small(whole.select("row", "n")), "row"), "ngram-members")
    parts = members.groupBy("lead").agg(F.ceil(F.greatest(F.count(F.lit(1)) / GROUP, F.sum("n") / GROUP_TOKENS)).cast("int").alias("parts"))
    blocks = stage(members.join(parts, "lead").select("row", F.xxhash64("lead", F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block")), "ngram-blocks")
    one, two = small(blocks), small(blocks)
    celled = stage(pairs.join(one.select(F.col("row").alias("a"), F.col("block").alias("x")), "a").join(
        two.select(F.col("row").alias("b"), F.col("block").alias("y")), "b").select(
        F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"), "a", "b"), "ngram-cells")

    wanted = celled.select("low", "high", F.explode(F.array("a", "b")).alias("row")).distinct()
    sent = wanted.join(whole.select("row", "set"), "row").select("low", "high", F.lit(None).cast("long").alias("a"), F.col("row").alias("b"), "set")
    asked = celled.select("low", "high", "a", "b", F.lit(None).cast("binary").alias("set"))
    # Sets come before the pairs of their cell.
    return sent.unionByName(asked).repartition("low", "high").sortWithinPartitions("low", "high", F.col("a").asc_nulls_first())


def linked(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged tables: rows (``sets``), classes (row, k1, k2, n, doc_id, text_hash, times), and links (a, b) of classes.

    The links connect all that is linked; two classes in one component need not have a row of their own.
    """
    rows = stage(sets(documents, size), "ngram-rows")
    often = frequent_shingles(rows)
    texts = rows.where("n > 0").groupBy("k1", "k2", "n", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times")).alias("first")
    classes = stage(texts.groupBy("k1", "k2", "n").agg(first).select(
        F.monotonically_increasing_id().alias("row"), "k1", "k2", "n", "first.doc_id", "first.text_hash", "first.times"), "ngram-classes")
    index = stage(indexed(documents, classes, often, size, percent), "ngram-index")
    entries = stage(listed(index), "ngram-entries")
    depths = stage(chosen(entries.join(small(classes.select("row", "n")), "row"), percent), "ngram-depths")
    whole = stage(whole_sets(documents, classes.join(small(depths.select("row")), "row", "left_semi"), size), "ngram-sets")
    left = dense(whole, percent)
    depths = stage(depths.join(small(left.select("row")), "row", "left_semi").select("row", "n", "depth"), "ngram-depths")
    whole = whole.join(small(left.select("row")), "row", "left_semi")
    kept = stage(postings(entries, depths, percent), "ngram-postings")
    met = None
    for leaders in LEADERS:
        ranks = left.select("row", F.col("own").alias("rank")) if met is None else degrees(met.where(links(percent)))
        stars = stage(verified(whole, stage(starred(kept, ranks, leaders), "ngram-stars"), max(percent - LOOSE, 1)), "ngram-star-links")
        met = stars if met is None else stage(met.unionByName(stars).distinct(), "ngram-star-links")
    found = met.where(links(percent)).select("a", "b")
    clusters, groups = stage(components(found), "ngram-clusters"), stage(components(met), "ngram-clusters")
    at = stage(depths.join(small(clusters.select(F.col("node").alias("row"), F.col("root").alias("cluster"))), "row", "left").join(
        small(groups.select(F.col("node").alias("row"), F.col("root").alias("grouped"))), "row", "left").select(
        "row", "n", F.coalesce("cluster", "row").alias("cluster"), F.coalesce("grouped", "row").alias("grouped")), "ngram-at")
    named = stage(kept.join(small(at.select("row", F.col("grouped").alias("cluster"))), "row"), "ngram-named-postings")
    close = stage(candidates(named, percent), "ngram-close")
    around = stage(spokes(at, close, degrees(met)), "ngram-spokes")
    told = stage(differences(whole.drop("bits"), around.select(F.col("row").alias("a"), F.col("pivot").alias("b"))), "ngram-differences")
    own, pivots = small(at.select("row", "n", "cluster")), small(at.select(F.col("row").alias("pivot"), F.col("n").alias("pn")))
    apart = stage(told.select(F.col("a").alias("row"), F.col("b").alias("pivot"), F.size("tokens").cast("long").alias("d"), "tokens").join(
        own, "row").join(pivots, "pivot"), "ngram-apart")
    near = apart.where(~needed(percent)[0]).select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b"))
    pairs = stage(meetings(apart, percent), "ngram-candidates")
    rest = stage(verified(whole, pairs, percent).select("a", "b"), "ngram-links")
    return rows, classes, stage(found.unionByName(near).unionByName(rest).distinct(), "ngram-all-links")


def join(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    Rows link if ``100 * intersection >= percent * union`` of their shingle sets; ``component_id`` is the smallest doc_id that
    links reach, the row's own included (null ids take part, but are never the smallest; a component of null ids alone has a
    null id).  Repeated rows stay repeated; an empty table gives an empty table; extra columns are ignored; whole texts count,
    however long.
    """
    rows, classes, found = linked(documents, size, percent)
    roots = stage(components(found), "ngram-roots")
    named = stage(classes.join(small(roots), classes["row"] == roots["node"], "left").select(
        "k1", "k2", F.coalesce("root", "row").alias("root"), F.col("doc_id").alias("least")), "ngram-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    keyed = stage(named.join(least, "root").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "component_id"), "ngram-keys")
    matched = rows.where("n > 0").join(small(keyed), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return matched.unionByName(alone)
