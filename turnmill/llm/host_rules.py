"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back to documents.

1. Every document gets base counts, and fails if it has too few words or too many of them in repeated windows; symbols, repeated
   lines and word lengths are counted for the caller and enter no rule.
2. Failures are summed by host (the document's ``source``); map-side sums make a host of any size a few rows.
3. Over all hosts a beta prior is fitted to the failure rates by moments (weighted by documents, with the binomial part of
   the variance removed), and each host's rate becomes its posterior mean: a small host is drawn to the common rate, a
   large one keeps its own.
4. A host whose shrunk rate of failed documents is above ``HOST_LIMIT`` fails; its verdict is joined back by host.

Words are runs of characters other than ASCII white space.  A null or empty text has no words and fails the base rules; a
null host is a host of its own.  Repeated rows count each.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, slices, small, stage

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
HOST_LIMIT = 0.5
# The least strength of the prior, in documents: rates that differ by chance alone would give an infinite one.
STRENGTH = (1.0, 1e6)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(ids: np.ndarray, owner: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Flags of the words inside windows of ``size`` ids found twice or more among the windows of one owner.

    ``owner`` is the text number of each id, ascending.  Windows with equal hashes are compared id by id.
    """
    flags = np.zeros(len(ids), bool)
    n = len(ids) - size + 1
    if n < 2:
        return flags
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = owner[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(size):
        h = (h + mixed[k:n + k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    starts = np.flatnonzero(owner[:n] == owner[size - 1:])
    h = h[starts]
    if len(h) < 2:
        return flags
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return flags
    at = np.searchsorted(twice, h)
    starts = starts[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == h)]
    # Exact: windows of the same hash are the same words of the same text.
    table = np.column_stack([owner[starts], *(ids[starts + k] for k in range(size))])
    _, kind, count = np.unique(table, axis=0, return_inverse=True, return_counts=True)
    marks = np.zeros(len(ids) + 1, np.int64)
    chosen = starts[count[kind.reshape(-1)] > 1]
    np.add.at(marks, chosen, 1)
    np.add.at(marks, chosen + size, -1)
    return np.cumsum(marks[:-1]) > 0


def base_counts(texts: list[str | None]) -> np.ndarray:
    """(text, ``COUNTS``) of whole texts."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    known: dict[bytes, int] = {}
    ids: list[int] = []
    for k, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        lines = [line for line in data.split(b"\n") if line and not line.isspace()] if b"\n" in data else words[:1]
        out[k, :4] = (len(words), len(text) - (len(data) - sum(map(len, words))), sum(map(data.count, (SYMBOLS[i:i + 1] for i in range(len(SYMBOLS))))),
                      len(lines) - len(set(lines)))
        ids += [known.setdefault(w, len(known)) for w in words]
    owner = np.repeat(np.arange(len(texts)), out[:, 0])
    flags = repeated(np.array(ids, np.int64), owner)
    out[:, 4] = np.bincount(owner, flags, len(texts)).astype(np.int64)
    return out


def base(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, n_words .. n_repeat_words, base_failed)`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = base_counts(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], *(pa.array(c) for c in counts.T)],
                                             ["doc_id", "source", *COUNTS])

    rows = read_only_columns(documents, "doc_id", "source", "text").select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    counted = rows.mapInArrow(run, "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def host_rates(counted: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(source, n_docs, n_failed, rate, strength, host_failed)``, one row per host; the prior comes from all hosts.

    With rates r and documents n, m = sum(n r) / N.  The between-host variance v is the weighted variance of the rates
    less what binomial draws of n documents give; the prior's strength is m (1 - m) / v - 1, within ``STRENGTH``.
    """
    hosts = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = stage(hosts, "host-failures")
    m = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("m"), F.sum("n_docs").alias("n_all"), F.count(F.lit(1)).alias("n_hosts"),
                  F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"))
    spread = (F.col("squares") / F.col("n_all") - F.col("m") * F.col("m")) - F.col("m") * (1 - F.col("m")) * F.col("n_hosts") / F.col("n_all")
    least, most = STRENGTH
    strength = F.when(spread > 0, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(least)), F.lit(most))).otherwise(most)
    # One row, known to be so: an aggregate without keys.
    prior = m.select("m", strength.alias("strength")).first()
    mean, weight = F.lit(prior["m"] or 0.0), F.lit(prior["strength"] or most)
    rate = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select("source", "n_docs", "n_failed", rate.alias("rate"), weight.alias("strength"), (rate > limit).alias("host_failed"))


def verdicts(documents: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``(doc_id, counts, base_failed, host_rate, kept)``: kept are documents that pass, of hosts that pass."""
    counted = stage(base(documents), "host-base")
    hosts = stage(host_rates(counted, limit).select(F.col("source").alias("host"), "rate", "host_failed"), "host-rates")
    judged = counted.join(small(hosts), counted["source"].eqNullSafe(hosts["host"]))
    return judged.select("doc_id", *COUNTS, "base_failed", F.col("rate").alias("host_rate"),
                         (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
