"""Near-duplicates by 64-bit similarity fingerprints and one-wildcard segment variants.

Two fingerprints that differ in at most three bits are cut into two halves; one half then differs in at most one bit.
Every half is indexed under its 32 one-wildcard variants (the half with one bit left out), so such a pair meets in an
equality join and is verified on all bits.  A variant shared by very many different fingerprints is refined instead of
paired: its members agree on 31 bits, so the other half is cut in two pieces, then the last piece again, with the same
one-wildcard rule.  What is left free after two refinements are eleven bits, so a bucket holds at most 2,048 fingerprints.

Equal fingerprints are one class from the start: copies cost one row each and are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, slices, small, stage
from turnmill.llm.components import components

MAX_BITS = 3
SHINGLE = 3
SEED = 42
# Different fingerprints under one variant above which the variant is refined.
HOT = 256


def fingerprint(text: str | None) -> int:
    """A-Z lowered, words cut at ASCII white space, three-word shingles with repeats, majority of the hashes' bits.

    Fewer words than a shingle: the whole sequence is the one shingle; no word (or null): 0.
    """
    import xxhash
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE - 1:].tolist(), strict=True)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[at:at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """``(doc_id, fp, text_hash)`` of every row; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(values), batch["text_hash"]], ["doc_id", "fp", "text_hash"])

    rows = read_only_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _piece(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _without(piece: Column, bit: Column) -> Column:
    return piece.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _variants(rows: DataFrame, pieces: list[tuple[int, int]], level: int) -> DataFrame:
    """``rows`` with one row per piece and left-out bit: ``tag<level>`` (piece and bit) and ``key<level>`` (the rest)."""
    tags = [F.struct(F.lit(shift).alias("shift"), F.lit(bit).alias("bit"), _without(_piece(F.col("fp"), shift, width), F.lit(bit)).alias("key"))
            for shift, width in pieces for bit in range(width)]
    return rows.select("*", F.explode(F.array(*tags)).alias("v")).select(
        *rows.columns, (F.col("v.shift") * 64 + F.col("v.bit")).cast("int").alias(f"tag{level}"), F.col("v.key").alias(f"key{level}"))


def _meets_first(level: int, widths: dict[int, int]) -> Column:
    """A pair equal in a piece shares all its variants; it is taken at the lowest bit alone."""
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    shift, bit = F.expr(f"x.tag{level} div 64").cast("int"), F.col(f"x.tag{level}") % 64
    piece = F.call_function("shiftrightunsigned", differ, shift)
    masked = F.lit(False)
    for at, width in widths.items():
        masked = F.when(shift == at, piece.bitwiseAND(F.lit((1 << width) - 1)) != 0).otherwise(masked)
    return masked | (bit == 0)


def _shuffled(rows: DataFrame) -> DataFrame:
    """``rows``, whose joins are shuffled and sorted on both sides, whatever their estimated sizes.

    Spark takes a table for as large as it was before an explode, and equal values in Parquet for as short as they are
    written, so variants that hold some 64 rows per fingerprint would be broadcast by way of the driver.
    """
    return rows.hint("merge")


def _split(rows: DataFrame, keys: list[str], hot: int) -> tuple[DataFrame, DataFrame]:
    """Members of buckets with company: those of short buckets, and those of long ones."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(_shuffled(rows).join(sizes, keys), "simhash-buckets")
    return shared.where(F.col("n") <= hot).drop("n"), shared.where(F.col("n") > hot).drop("n")


def _pairs(rows: DataFrame, level: int, bits: int, widths: list[dict[int, int]]) -> DataFrame:
    keys = [f"{k}{i}" for i in range(1, level + 1) for k in ("tag", "key")]
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits
    first = F.lit(True)
    for i in range(1, level + 1):
        first = first & _meets_first(i, widths[i - 1])
    joined = _shuffled(rows.alias("x")).join(rows.alias("y"), same & (F.col("x.fp") < F.col("y.fp")) & close & first)
    return joined.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def links(distinct: DataFrame, hot: int = HOT, bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` with ``a < b``: all pairs of different fingerprints at ``bits`` (at most three) or fewer differing bits."""
    halves = [(32, 32), (0, 32)]
    first = _variants(distinct.select("fp"), halves, 1)
    cold, warm = _split(first, ["tag1", "key1"], hot)
    found = _pairs(cold, 1, bits, [dict(halves)])
    if warm.isEmpty():
        return found.distinct()
    # The half that has no wildcard yet, in two pieces; shifts tell which half that is.
    quarters = {32: [(16, 16), (0, 16)], 0: [(48, 16), (32, 16)]}
    for half, pieces in quarters.items():
        # tag = shift * 64 + bit, so the half of a tag is tag div 64.
        members = warm.where(F.expr("tag1 div 64") == half)
        short, long = _split(_variants(members, pieces, 2), ["tag1", "key1", "tag2", "key2"], hot)
        widths = [dict(halves), dict(pieces)]
        found = found.unionByName(_pairs(short, 2, bits, widths))
        for (shift, _), (other, _) in (pieces, pieces[::-1]):
            last = [(other + 8, 8), (other, 8)]
            deepest = _variants(long.where(F.expr("tag2 div 64") == shift), last, 3)
            found = found.unionByName(_pairs(deepest, 3, bits, [*widths, dict(last)]))
    return found.distinct()


def rooted(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, fp, text_hash, root, component_id)`` of every row; ``root`` names the component, also one of null ids alone."""
    rows = stage(fingerprints(documents), "simhash-rows")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fingerprints")
    found = stage(links(distinct, hot), "simhash-links")
    roots = stage(components(found), "simhash-roots")
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only fingerprints of components with several members take part in the joins beyond their own class.
    named = labelled.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def classes(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row.

    ``component_id`` is the smallest doc_id that a chain of links reaches, the row's own included; rows of equal
    fingerprint are linked, empty texts too.  Null ids take part but are never the smallest (a component of null ids alone
    has a null id).  Repeated rows stay repeated; an empty table gives an empty table.
    """
    return rooted(documents, hot).select("doc_id", "fp", "component_id")


def representatives(documents: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest doc_id (null last), then text hash.

    A row is known by its id and the hash of its text, so that neither null ids nor one id on several texts mix groups up.
    Of rows that share both, one is kept; texts are shuffled for that only if such rows are counted.
    """
    found = stage(rooted(documents).select("doc_id", "text_hash", "root"), "simhash-classes")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    keep = stage(found.groupBy("root").agg(best).select(F.col("best.doc_id").alias("keep"), F.col("best.text_hash").alias("keep_hash")), "simhash-keep")
    one = documents.join(small(keep), documents["doc_id"].eqNullSafe(keep["keep"]) & (F.xxhash64(documents["text"]) == keep["keep_hash"]), "left_semi")
    copies = found.join(small(keep), found["doc_id"].eqNullSafe(keep["keep"]) & (found["text_hash"] == keep["keep_hash"]), "left_semi")
    return one.dropDuplicates(["doc_id", "text"]) if copies.count() > keep.count() else one
