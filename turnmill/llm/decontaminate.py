"""Benchmark decontamination by a distributed positional inverted index (DataFrame operations only).

1. ``postings``: every training token that is a test term becomes a posting (text row, term, position), written once as a
   table; a text without any such token keeps its closing entry, which carries its id and its number of words.
2. ``votes``: the corpus frequencies of the terms come from the postings.  Every test window names its three rarest terms; only
   their lists are read.  A posting at position ``pos`` of the term at place ``p`` of an item votes for the alignment
   ``pos - p`` (the offset-adjusted list).
3. ``phrase_matches``: alignments with enough votes are the intersection of the rarest lists.  Around their votes the lists of all
   terms are intersected at the same alignment; runs of consecutive places that are as long as a window are exact occurrences.
4. ``proximity_matches``: votes for alignments at most ``slop`` apart name windows that may occur with words put in or left
   out; the lists of all terms of such a window are read, and each term must stand within ``slop`` of the alignment.

Windows are made of bounded rows, one per token and window it lies in, so an item of any length is worked on in parts.

Words: A-Z lower-cased, then runs of ASCII letters and digits and of all other non-ASCII characters.  A null or empty text
has no words and no hits; an item without words never occurs; an item shorter than the window is one window.  Equal rows
are treated row by row; items are reported by distinct id.  Null item ids count as the text ``null``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, small, stage

WINDOW = 10
RAREST = 3
# How far apart the alignments of a window's terms may be in a proximity match.
SLOP = 3
SALTS = 32
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Index:
    """Staged tables: postings (row, term, pos), closing entries (row, doc_id, n_words), item tokens, term frequencies."""

    postings: DataFrame
    closing: DataFrame
    tokens: DataFrame
    frequency: DataFrame


def words(text: Column) -> Column:
    # ``lower`` would also change letters outside ASCII, so texts that hold any are translated letter by letter.
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def build_index(documents: DataFrame, benchmark: DataFrame, broadcast_rows: int | None = None) -> Index:
    """Postings of the test terms over all of ``documents`` (doc_id, text), for ``benchmark`` (item_id, text).

    The vocabulary is sent to the executors if it is measured to be short; otherwise the join is shuffled, with salted
    term keys, because a common word would fill one task.
    """
    items = stage(read_only_columns(benchmark, "item_id", "text").select(
        F.monotonically_increasing_id().alias("item"), F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        words(F.col("text")).alias("words")).where(F.size("words") > 0), "decon-items")
    exploded = items.select("item", "item_id", F.size("words").alias("m"), F.posexplode("words").alias("p", "word"))
    # The empty word is the closing entry of a text; its term is -1.
    vocabulary = stage(exploded.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")).unionByName(
        documents.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(-1).cast("long").alias("term"))), "decon-terms")
    tokens = stage(exploded.join(small(vocabulary, broadcast_rows), "word").select("item", "item_id", "m", "p", "term"), "decon-tokens")

    texts = read_only_columns(documents, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"),
        F.coalesce(words(F.col("text")), F.array()).alias("words"))
    closed = texts.select("row", "doc_id", "text_hash", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    terms = small(vocabulary, broadcast_rows)
    if terms is vocabulary:
        salts = vocabulary.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = closed.withColumn("salt", F.pmod(F.col("row") + F.col("pos"), F.lit(SALTS)).cast("int")).join(salts, ["word", "salt"])
    else:
        found = closed.join(terms, "word")
    last = F.col("term") == -1
    index = stage(found.select("row", F.when(last, F.col("doc_id")).alias("doc_id"), F.when(last, F.col("text_hash")).alias("text_hash"),
                               "term", "pos"), "decon-postings")
    postings = index.where("term >= 0").select("row", "term", "pos")
    closing = index.where("term = -1").select("row", "doc_id", "text_hash", F.col("pos").cast("long").alias("n_words"))
    frequency = stage(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "decon-frequency")
    return Index(postings, closing, tokens, frequency)


def windows(index: Index, size: int = WINDOW) -> DataFrame:
    """``(item, m, first, probes)``: every window whose terms all occur, with the places of its rarest terms."""
    tokens = index.tokens.join(small(index.frequency), "term", "left").select(
        "item", "m", "p", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "p", "term").alias("t"))
    last = F.greatest(F.col("m") - size, F.lit(0))
    cut = tokens.select("item", "m", "t", F.explode(F.sequence(F.greatest(F.col("p") - size + 1, F.lit(0)), F.least("p", last))).alias("first"))
    # At most ``size`` terms come together here.
    ranked = cut.groupBy("item", "m", "first").agg(F.min("t.df").alias("least"), F.slice(F.array_sort(F.collect_list("t")), 1, RAREST).alias("probes"))
    return ranked.where("least > 0").select("item", "m", "first", "probes")


def votes(index: Index, wins: DataFrame) -> DataFrame:
    """``(row, item, base, p, m)``: the offset-adjusted lists of the probe terms."""
    probes = stage(wins.select("item", "m", F.explode("probes").alias("t")).select("item", "m", "t.p", "t.term").distinct(), "decon-probes")
    return index.postings.join(small(probes), "term").select("row", "item", (F.col("pos") - F.col("p")).alias("base"), "p", "m")


def _in_rows(index: Index, some: DataFrame) -> DataFrame:
    """The postings of the rows of ``some``, where these are few enough to be sent out."""
    rows = stage(some.select("row").distinct(), "decon-rows")
    few = small(rows)
    return index.postings if few is rows else index.postings.join(few, "row", "left_semi")


def phrase_matches(index: Index, voted: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(row, item_id, start, stop)``: stretches of a text (stop excluded) covered by consecutive windows of an item."""
    agreed = voted.groupBy("row", "item", "base").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    found = stage(agreed.where(F.col("n") >= F.least("m", F.lit(RAREST))).select("row", "item", "base"), "decon-candidates")
    # A window that occurs holds a vote, so all its places lie within a window's length of one.
    around = F.sequence(F.greatest(F.col("p") - size + 1, F.lit(0)), F.least(F.col("p") + size, "m") - 1)
    places = voted.join(small(found), ["row", "item", "base"]).select("row", "item", "base", F.explode(around).alias("p")).distinct()
    expected = places.join(small(index.tokens), ["item", "p"]).select(
        "row", "item", "item_id", "m", "base", "p", "term", (F.col("base") + F.col("p")).cast("int").alias("pos"))
    hit = expected.join(_in_rows(index, found), ["row", "pos", "term"])
    run = F.row_number().over(Window.partitionBy("row", "item", "base").orderBy("p"))
    runs = hit.withColumn("run", F.col("p") - run).groupBy("row", "item", "item_id", "m", "base", "run").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"))
    return runs.where(F.col("n") >= F.least(F.col("m"), F.lit(size))).select(
        "row", "item_id", "start", (F.col("start") + F.col("n")).cast("int").alias("stop"))


def proximity_matches(index: Index, wins: DataFrame, voted: DataFrame, slop: int = SLOP, size: int = WINDOW) -> DataFrame:
    """``(row, item_id, first, at)``: windows of an item all of whose terms stand near their places in a text.

    ``first`` is the window's first place in the item, and ``at`` the smallest alignment such that every term of the window has
    a posting whose own alignment is in ``at .. at + slop``.  With ``slop`` 0 these are the exact windows.
    """
    near = Window.partitionBy("row", "item").orderBy("base").rangeBetween(-slop, slop)
    close = voted.withColumn("met", F.size(F.collect_set("p").over(near))).where(F.col("met") >= F.least("m", F.lit(RAREST)))
    probes = wins.select("item", "first", F.size("probes").alias("need"), F.explode("probes.p").alias("p"))
    ahead = Window.partitionBy("row", "item", "first").orderBy("base").rangeBetween(0, slop)
    met = stage(close.select("row", "item", "base", "p"), "decon-close").join(small(probes), ["item", "p"]).withColumn(
        "met", F.size(F.collect_set("p").over(ahead))).where("met >= need")
    # The lists of all terms of these windows, as far as they lie within reach of an alignment that the probes leave open.
    open_ = stage(met.groupBy("row", "item", "first").agg(F.min("base").alias("low"), F.max("base").alias("high")), "decon-near")
    places = open_.withColumn("p", F.explode(F.sequence(F.col("first"), F.col("first") + size - 1)))
    expected = places.join(small(index.tokens), ["item", "p"])
    offset = F.col("pos") - F.col("p")
    hits = expected.join(_in_rows(index, open_), ["row", "term"]).where((offset >= F.col("low") - slop) & (offset <= F.col("high") + slop))
    whole = hits.select("row", "item", "item_id", "m", "first", "p", offset.alias("base")).withColumn("met", F.size(F.collect_set("p").over(ahead)))
    return whole.where(F.col("met") >= F.least("m", F.lit(size))).groupBy("row", "item", "item_id", "first").agg(
        F.min("base").alias("at")).select("row", "item_id", "first", "at")


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP, proximity: bool = True) -> DataFrame:
    """One row per text row: ``row, doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated, n_near``.

    ``contaminated`` follows from exact windows alone; ``n_near`` counts the items of which a window occurs within ``slop``, exact
    ones included (without ``proximity``: null).
    """
    index = build_index(documents, benchmark)
    wins = stage(windows(index, size), "decon-windows")
    voted = stage(votes(index, wins), "decon-votes")
    matches = stage(phrase_matches(index, voted, size), "decon-matches")
    hit = matches.select("row", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("pos")).distinct().groupBy("row").agg(
        F.count(F.lit(1)).alias("n_hit"))
    items = matches.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = index.closing.join(hit, "row", "left").join(items, "row", "left")
    if proximity:
        near = proximity_matches(index, wins, voted, slop, size).select("row", "item_id").distinct().groupBy("row").agg(F.count(F.lit(1)).alias("near"))
        out = out.join(stage(near, "decon-near-items"), "row", "left").withColumn("n_near", F.coalesce("near", F.lit(0)).cast("long"))
    else:
        out = out.withColumn("n_near", F.lit(None).cast("long"))
    return out.select(
        "row", "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "n_near")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns; a row is known by its id and the hash of its text."""
    bad = stage(decontaminate(documents, benchmark, proximity=False).where("contaminated").select("doc_id", "text_hash").distinct(), "decon-bad")
    same = documents["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(documents["text"]) == bad["text_hash"])
    return documents.join(small(bad), same, "left_anti")
