"""Periodic runs of words, by Lyndon groups under both orders.

A run is a stretch of words with smallest period q that no neighbour extends.  Every run holds Lyndon roots: stretches of
length q that are the longest Lyndon word at their place under one of the two orders of the alphabet.  So the operator

1. groups the suffixes of a stretch by their longest Lyndon prefixes, as the first phase of a suffix sorter does (groups are
   taken in descending order; the last smaller position before each member moves up behind its group, by the number of
   members that point to it).  The length of each suffix's group is the Lyndon array, directly, without a suffix array;
2. does so under both orders;
3. follows chains of neighbouring roots of equal length, and extends the first root of each chain to the left and right by
   its longest common extensions.  A run of exponent e holds at least floor(e) - 1 roots in a row, so shorter chains are
   passed over; a root inside a run already found gives the same run again and is passed over too.

Before that a text is cut at the words that cannot lie in a run: every word of a run occurs at least floor(e) times in it, so
words with fewer occurrences in their stretch are cuts, again and again until none is left.  This loses no run and keeps
most of ordinary prose out of the grouping.

Words are runs of characters other than ASCII white space.  A null or empty text has no words and no runs.  Whole texts are
worked on, one at a time; memory grows with the longest text.  Repeated rows give repeated results, null ids are kept, an
empty table gives an empty table and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, slices

MIN_LENGTH = 6
MIN_EXPONENT = 4
SLICE_ROWS = 128
MAX_CUTS = 24

Run = tuple[int, int, int]
Edit = Callable[[int, list[bytes]], list[bytes]]


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """The length of the longest Lyndon word at every position, smaller ranks first; the end counts as smaller than any rank.

    Groups are kept as a chain from high to low.  ``home`` tells a position's group, and a group's members are listed in
    ascending order; positions that have moved on stay in the old list and are skipped there.
    """
    n = len(ranks)
    lists: list[list[int]] = [[] for _ in range(max(ranks) + 1)] if n else []
    for i, r in enumerate(ranks):
        lists[r].append(i)
    size = [1] * len(lists)
    above = [*range(1, len(lists)), -1]
    below = [-1, *range(len(lists) - 1)]
    home = list(ranks)
    done = [False] * n
    before = [-1] * n  # the last smaller position, of positions whose group is done
    group = len(lists) - 1
    while group >= 0:
        members = [i for i in lists[group] if home[i] == group]
        for i in members:
            done[i] = True
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and done[p]:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        # Positions ascend, so every new group's list does.
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in counts.items():
            moved.setdefault((-times, home[p]), []).append(p)
        for (times, old), places in sorted(moved.items(), key=lambda kv: kv[0][0]):
            new = len(lists)
            lists.append(places)
            size.append(size[old] - times * size[group])
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for p in places:
                home[p] = new
        lists[group] = []
        group = below[group]
    return [size[g] for g in home]


def extension(ids: np.ndarray, at: int, gap: int, step: int) -> int:
    """How many positions from ``at`` on, in direction ``step``, equal those ``gap`` further right."""
    n, total, width = len(ids), 0, 16
    while True:
        if step > 0:
            a, b = at + total, min(at + total + width, n - gap)
            if a >= b:
                return total
            differ = np.flatnonzero(ids[a:b] != ids[a + gap:b + gap])
        else:
            b, a = at - total + 1, max(at - total + 1 - width, 0)
            if a >= b:
                return total
            differ = np.flatnonzero(ids[a:b][::-1] != ids[a + gap:b + gap][::-1])
        if len(differ):
            return total + int(differ[0])
        total += b - a
        width = min(width * 4, 1 << 16)


def chained(lengths: np.ndarray, roots: int) -> np.ndarray:
    """Positions whose Lyndon word is followed by ``roots`` - 1 more words of the same length."""
    at = np.arange(len(lengths))
    keep = at
    for k in range(1, roots):
        then = keep + k * lengths[keep]
        inside = then < len(lengths)
        keep, then = keep[inside], then[inside]
        keep = keep[lengths[then] == lengths[keep]]
    return keep


def stretch_runs(ids: np.ndarray, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> set[Run]:
    """All runs ``(start, length, period)`` of the stretch with ``length >= max(least, exponent * period)``."""
    kinds, ranks = np.unique(ids, return_inverse=True)
    ranks = ranks.reshape(-1)
    found: set[Run] = set()
    for order in (ranks, len(kinds) - 1 - ranks):
        lengths = np.array(lyndon_lengths(order.tolist()), np.int64)
        ends: dict[int, int] = {}  # by period: where the last run of that period ends
        for i in chained(lengths, max(exponent - 1, 1)).tolist():
            q = int(lengths[i])
            if i + q <= ends.get(q, 0):
                continue
            right = i + q + extension(ids, i, q, 1)
            left = i - extension(ids, i - 1, q, -1)
            ends[q] = right
            if right - left >= max(least, exponent * q):
                found.add((left, right - left, q))
    return found


def stretches(ids: np.ndarray, times: int) -> Iterator[tuple[int, int]]:
    """Stretches in which every id occurs at least ``times`` times; no run of that exponent crosses their ends.

    Cutting is a saving, not a condition: what has been cut ``MAX_CUTS`` times in a row is handed on as it is.
    """
    work = [(0, len(ids), 0)]
    while work:
        a, b, depth = work.pop()
        if b - a < times:
            continue
        if depth == MAX_CUTS:
            yield a, b
            continue
        _, kind, count = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(count[kind.reshape(-1)] < times)
        if not len(rare):
            yield a, b
            continue
        edges = np.concatenate(([a - 1], a + rare, [b]))
        long = np.flatnonzero(np.diff(edges) > times)
        work += [(int(edges[k]) + 1, int(edges[k + 1]), depth + 1) for k in long]


def word_runs(words: list[bytes], exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH) -> list[Run]:
    """All runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    if len(known) * exponent > len(words) and np.bincount(ids).max() < exponent:
        return []
    found: set[Run] = set()
    for a, b in stretches(ids, exponent):
        if b - a >= least:
            found |= {(s + a, n, q) for s, n, q in stretch_runs(ids[a:b], exponent, least)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that repeat earlier ones of a run: of every run the first period stays."""
    if not found:
        return words
    marks = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        marks[start + period] += 1
        marks[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _rows(documents: DataFrame) -> DataFrame:
    return read_only_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def detect(documents: DataFrame, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH, edit: Edit | None = None) -> DataFrame:
    """``(doc_id, runs, collapsed)`` of every row: all runs by start and period, and the text with each run cut to one period.

    ``exponent`` (at least 2) and ``least`` are the bounds of a run's length in periods and in words.  ``edit``, if given,
    changes the words of a document before they are looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS):
            all_runs, texts = [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = _words(text)
                words = edit(doc_id, words) if edit else words
                found = word_runs(words, exponent, least)
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(all_runs, kind), pa.array(texts, pa.string())],
                                             ["doc_id", "runs", "collapsed"])

    return _rows(documents).mapInArrow(run, SCHEMA)


def digest(found: list[Run], kept: list[bytes]) -> tuple:
    """``n_runs``, the longest run (ties: smallest start, then period), and the digests of all runs and of the kept words."""
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else None
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (len(found), *(best or (None, None, None)), best[1] * 1000 // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(documents: DataFrame, exponent: int = MIN_EXPONENT, least: int = MIN_LENGTH, edit: Edit | None = None) -> DataFrame:
    """``DIGESTS`` of every row, made where the runs are found, so that collapsed texts never leave their task."""
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE_ROWS):
            out = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = _words(text)
                words = edit(doc_id, words) if edit else words
                found = word_runs(words, exponent, least)
                out.append((doc_id, *digest(found, collapsed(words, found))))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return _rows(documents).mapInArrow(run, DIGESTS)


def replanted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by the crc32 of the id, with their last words in periods (null ids: unchanged)."""
    import zlib
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    return words[:a] + [period[k % p] for k in range(n - a)]
