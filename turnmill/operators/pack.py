"""Packing variable-length samples to fixed token budgets.

*Range packing* concatenates the shuffled samples of a source and cuts every ``L`` tokens.  A sample's
packs follow from its running offset by integer division, so no search or range join is needed.

*Next-fit packing* opens a new bin when the next sample would overflow the open one.  The rule looks
sequential, but the bins of a segment depend on the segments before it only through the fill of the
open bin.  Each segment summarises, for every fill that can matter, where its first new bin starts, how
many bins it opens and which fill it leaves; the summaries (one short row per segment) are chained,
and the segments then number their bins in parallel.  The result equals one pass over the whole order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.tokens import boundaries, restarting_positions
from turnmill.operators.order import int_div, join_keys, running, shuffled
from turnmill.session import stage

SEGMENT = 1 << 18


def range_fragments(samples: DataFrame, limit: int, *, length: str = "num_tokens", sample: str = "sample_id",
                    source: str = "source", tail: str = "drop", seed: int = 1024, epoch: int = 0,
                    shuffle: bool = True, order: str | None = None, bucket: Column | None = None,
                    digits: int | None = None) -> DataFrame:
    """Fragments of range packing: adds ``pack``, ``at`` (offset in pack), ``skip`` (offset in sample), ``n``.

    ``tail``: ``drop`` leaves out the short last pack of each source, ``emit`` keeps it.  Other columns
    (token arrays, if present) ride along in the one shuffle of the running offset.
    """
    if tail not in ("drop", "emit"):
        raise ValueError("tail must be 'drop' or 'emit'")
    n = F.col(length).cast("long")
    if shuffle:
        placed = shuffled(samples, sample, seed=seed, epoch=epoch, keys=[source], index="_i", sums={"_begin": n},
                          totals={"_total": "_begin"}, digits=digits)
    else:
        placed = running(samples, order=[order], bucket=bucket, keys=[source], index="_i", sums={"_begin": n},
                         totals={"_total": "_begin"})
    size = F.lit(limit)
    end = F.col("_begin") + n
    full = int_div("_total", limit)
    out = (placed.where(n > 0)
           .withColumn("pack", F.explode(F.sequence(int_div("_begin", limit), int_div(end - 1, limit)))))
    if tail == "drop":
        out = out.where(F.col("pack") < full)
    start = F.greatest(F.col("_begin"), F.col("pack") * size)
    stop = F.least(end, (F.col("pack") + 1) * size)
    return out.select(
        *samples.columns, "pack", (start - F.col("pack") * size).cast("int").alias("at"),
        (start - F.col("_begin")).cast("int").alias("skip"), (stop - start).cast("int").alias("n"))


def range_plan(samples: DataFrame, limit: int, *, sample: str = "sample_id", source: str = "source",
               length: str = "num_tokens", **kw) -> DataFrame:
    """Metadata-only plan: ``(source, pack, at, sample, skip, n)``; no tokens are read."""
    narrow = samples.select(sample, source, length)
    return range_fragments(narrow, limit, sample=sample, source=source, length=length, **kw).select(
        source, "pack", "at", sample, "skip", "n")


def gather_packs(fragments: DataFrame, *, keys: list[str], at: str = "at", ids: str = "ids",
                 labels: str = "labels") -> DataFrame:
    """Ordered fragments -> packed rows with boundaries and restarting positions.

    A group is one pack, so it holds at most the token budget.
    """
    rows = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(at, ids, labels))).alias("_f"))
    lens = F.transform("_f", lambda f: F.size(f[ids]))
    return rows.withColumn("_lens", lens).select(
        *keys,
        F.flatten(F.transform("_f", lambda f: f[ids])).alias("input_ids"),
        F.flatten(F.transform("_f", lambda f: f[labels])).alias("labels"),
        boundaries("_lens").alias("cumulative_len"),
        restarting_positions("_lens").alias("position_ids"))


def pack_range(samples: DataFrame, limit: int, *, source: str = "source", **kw) -> DataFrame:
    """``(source, pack, input_ids, labels, cumulative_len, position_ids)``."""
    cut = range_fragments(samples, limit, source=source, **kw)
    part = lambda c: F.slice(c, F.col("skip") + 1, F.col("n"))
    cut = cut.select(source, "pack", "at", part("input_ids").alias("ids"), part("labels").alias("labels"))
    return gather_packs(cut, keys=[source, "pack"])


def longest_fragment(plan: DataFrame, *, source: str = "source") -> DataFrame:
    """Range index with ``longest``: the longest fragment of each pack."""
    return plan.groupBy(source, "pack").agg(
        F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_fragments"), F.max("n").cast("long").alias("longest"))


# ---------------------------------------------------------------- next-fit

# Children of a node of the tree over a source's segments.
FAN = 64


def _bin_starts(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for a bin that starts at k the start of the bin behind it."""
    prefix = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    nxt = np.searchsorted(prefix[1:], prefix[:-1] + limit, side="right")
    return prefix, np.maximum(nxt, np.arange(len(lengths)) + 1)


def _jumps(nxt: np.ndarray) -> list[np.ndarray]:
    """Tables of 1, 2, 4, .. steps from bin start to bin start; the end of the segment points to itself."""
    tables = [np.append(nxt, len(nxt))]
    while tables[-1][0] < len(nxt):
        tables.append(tables[-1][tables[-1]])
    return tables


def _summarise(limit: int, source: str):
    """A segment as a function of the fill of the open bin: where its first new bin starts (``_fits``), and for each
    such start the bins it opens and the fill it leaves behind."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf.sort_values("_i")["_n"].to_numpy()
        size = len(lengths)
        prefix, nxt = _bin_starts(lengths, limit)
        # the first new bin can start no later than the first item that overflows an empty bin
        entries = min(int(np.searchsorted(prefix[1:], limit, side="right")), size - 1) + 1
        last, opened = np.arange(entries), np.ones(entries, dtype=np.int64)
        for power, table in reversed(list(enumerate(_jumps(nxt)))):
            ahead = table[last]
            opened += np.where(ahead < size, 1 << power, 0)
            last = np.where(ahead < size, ahead, last)
        return pd.DataFrame({
            source: [pdf[source].iloc[0]], "_seg": [pdf["_seg"].iloc[0]], "_sum": [int(prefix[size])],
            "_fits": [prefix[1:entries + 1].tolist()], "_opened": [opened.tolist()], "_fill": [(prefix[size] - prefix[last]).tolist()]})
    return run


def _enter(limit: int, fill: int, row) -> tuple[int, int]:
    """``(fill, bins)`` behind a segment that is entered with ``fill`` (-1: no open bin)."""
    fits, opened, left = row
    first = 0 if fill < 0 else int(np.searchsorted(fits, limit - fill, side="right"))
    return (fill + int(fits[-1]), 0) if first >= len(opened) else (int(left[first]), int(opened[first]))


def _rows(pdf: pd.DataFrame):
    pdf = pdf.sort_values("_seg")
    return zip(pdf["_fits"], pdf["_opened"], pdf["_fill"])


def _compose(limit: int, source: str):
    """Neighbouring segments as one.  Its list grows only while all before it fits in one bin, so it is no longer
    than the items of one bin."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, fits, opened, left = 0, [], [], []
        for row in _rows(pdf):
            moved = [_enter(limit, f, row) for f in left]
            left, opened = [f for f, _ in moved], [o + b for o, (_, b) in zip(opened, moved)]
            if total <= limit:
                fits += [int(x) + total for x in row[0]]
                opened += [int(x) for x in row[1]]
                left += [int(x) for x in row[2]]
            total = fits[-1] if total <= limit else total
        return pd.DataFrame({source: [pdf[source].iloc[0]], "_seg": [pdf["_group"].iloc[0]], "_sum": [int(pdf["_sum"].sum())],
                             "_fits": [fits], "_opened": [opened], "_fill": [left]})
    return run


def _chain(limit: int, source: str):
    """The fill and bins with which each segment of a group is entered, from those of the group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        fill, bins, out = int(pdf["_fill_in"].iloc[0]), int(pdf["_bins_in"].iloc[0]), []
        for row in _rows(pdf):
            out.append((fill, bins))
            fill, more = _enter(limit, fill, row)
            bins += more
        return pdf[[source, "_seg"]].assign(_fill_in=[f for f, _ in out], _bins_in=[b for _, b in out])
    return run


def _assign(limit: int, cols: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        lengths = pdf["_n"].to_numpy()
        size = len(lengths)
        prefix, nxt = _bin_starts(lengths, limit)
        fill, bins = int(pdf["_fill_in"].iloc[0]), int(pdf["_bins_in"].iloc[0])
        k = 0 if fill < 0 else int(np.searchsorted(prefix[1:], limit - fill, side="right"))
        starts = np.zeros(size, dtype=np.int64)
        # from the starts found so far, as many steps ahead as there are of them
        found, jump = np.array([k])[:int(k < size)], np.append(nxt, size)
        while len(found):
            starts[found] = 1
            ahead = jump[found]
            more = ahead[ahead < size]
            if not len(more):
                break
            found, jump = np.concatenate((found, more)), jump[jump]
        number = bins - 1 + np.cumsum(starts)
        # offset in bin: distance to the start of the item's bin; items of the open bin add its fill
        base = np.maximum.accumulate(np.where(starts == 1, prefix[:-1], -1))
        at = np.where(base < 0, prefix[:-1] + max(fill, 0), prefix[:-1] - base)
        return pdf.assign(bin=number, at=at)[[*cols, "bin", "at"]]
    return run


def next_fit(samples: DataFrame, limit: int, *, length: str = "num_tokens", sample: str = "sample_id",
             source: str = "source", drop_oversize: bool, seed: int = 1024, epoch: int = 0,
             segment: int = SEGMENT, digits: int | None = None) -> DataFrame:
    """Next-fit plan ``(source, sample, length, bin, at)`` over the seeded shuffle of each source.

    ``drop_oversize``: samples above ``limit`` are left out (pairs), else they get a bin of their own.
    Only ids and lengths take part.  Python sees one segment (at most ``segment`` rows) at a time.  Segments
    are summarised up a tree of ``FAN`` children per node and entered down again, so no task sees more than
    ``FAN`` summaries, each no longer than the items of one bin.
    """
    narrow = samples.select(source, sample, F.col(length).cast("long").alias(length)).where(F.col(length) > 0)
    if drop_oversize:
        narrow = narrow.where(F.col(length) <= limit)
    placed = shuffled(narrow, sample, seed=seed, epoch=epoch, keys=[source], index="_i", digits=digits)
    # ids, lengths and positions only: written once, read by the summary and by the assignment
    placed = stage(placed.withColumn("_seg", int_div("_i", segment)).withColumn("_n", F.col(length)), "positions")
    types = dict(placed.dtypes)
    summary = f"{source} {types[source]}, _seg bigint, _sum bigint, _fits array<bigint>, _opened array<bigint>, _fill array<bigint>"
    levels = [stage(placed.select(source, "_seg", "_i", "_n").groupBy(source, "_seg").applyInPandas(
        _summarise(limit, source), summary), "segments")]
    while (levels[-1].agg(F.max("_seg")).first()[0] or 0) >= FAN:
        levels.append(stage(levels[-1].withColumn("_group", int_div("_seg", FAN)).groupBy(source, "_group").applyInPandas(
            _compose(limit, source), summary), "segments"))
    entered = f"{source} {types[source]}, _seg bigint, _fill_in bigint, _bins_in bigint"
    carried = levels[-1].select(source).distinct().select(
        source, F.lit(0).cast("bigint").alias("_group"), F.lit(-1).cast("bigint").alias("_fill_in"), F.lit(0).cast("bigint").alias("_bins_in"))
    for level in reversed(levels):
        children = join_keys(level.withColumn("_group", int_div("_seg", FAN)), carried, [source, "_group"])
        carried = children.groupBy(source, "_group").applyInPandas(_chain(limit, source), entered).withColumnRenamed("_seg", "_group")
    carried = carried.withColumnRenamed("_group", "_seg")
    cols = [source, sample, length]
    schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", bin bigint, at bigint"
    return (join_keys(placed, carried, [source, "_seg"]).groupBy(source, "_seg")
            .applyInPandas(_assign(limit, cols), schema))


def soft_pack(samples: DataFrame, target: int, **kw) -> DataFrame:
    """Next-fit that keeps oversize samples, summarised per bin with the longest sample."""
    source = kw.get("source", "source")
    length = kw.get("length", "num_tokens")
    return next_fit(samples, target, drop_oversize=False, **kw).groupBy(source, "bin").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum(length).alias("n_tokens"), F.max(length).alias("longest"))


def pack_pairs(pairs: DataFrame, limit: int, *, sample: str = "sample_id", source: str = "source", **kw) -> DataFrame:
    """Preference pairs -> packed rows whose segments alternate chosen and rejected."""
    sized = pairs.withColumn("num_tokens", F.size("chosen_ids") + F.size("rejected_ids"))
    plan = next_fit(sized, limit, sample=sample, source=source, drop_oversize=True, **kw)
    tokens = pairs.select(sample, "chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels")
    rows = join_keys(plan, tokens, [sample]).select(source, "bin", F.explode(F.array(
        F.struct(F.col("at"), F.col("chosen_ids").alias("ids"), F.col("chosen_labels").alias("labels")),
        F.struct((F.col("at") + F.size("chosen_ids")).alias("at"), F.col("rejected_ids").alias("ids"),
                 F.col("rejected_labels").alias("labels")))).alias("_s")).select(source, "bin", "_s.*")
    return gather_packs(rows, keys=[source, "bin"])


def unpack(packs: DataFrame, keys: list[str]) -> DataFrame:
    """Packed rows -> one row per segment, cut at ``cumulative_len``."""
    return (packs.select(*keys, "input_ids", "labels", F.col("cumulative_len").alias("_c"),
                         F.posexplode(F.slice("cumulative_len", F.lit(1), F.size("cumulative_len") - 1))
                         .alias("segment", "_from"))
            .withColumn("_n", F.get("_c", F.col("segment") + 1) - F.col("_from"))
            .select(*keys, "segment", F.slice("input_ids", F.col("_from") + 1, F.col("_n")).alias("input_ids"),
                    F.slice("labels", F.col("_from") + 1, F.col("_n")).alias("labels")))


def pack_batch(samples: DataFrame, batch: str, order: str) -> DataFrame:
    """Collator concatenation: the samples of a (bounded) batch become one packed row."""
    return gather_packs(samples.select(batch, F.col(order).alias("at"), F.col("input_ids").alias("ids"), "labels"),
                        keys=[batch])
