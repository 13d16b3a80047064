"""Batch planning: length grouping, rank striping, padding, sequence shards.

Windows here run over one megabatch or one batch, whose sizes are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.text import col
from turnmill.functions.tokens import IGNORE_INDEX, PAD_INDEX
from turnmill.operators.order import CHUNK, chunk_bucket, int_div, md5_bucket, running, shuffle_key, shuffled
from turnmill.session import stage


def group_size(n: Column, batch: int, world: int, mult: int | None = None) -> Column:
    """Rows per megabatch: ``mult`` total batches; default ``min(n // (4 * total), 50)``, at least 1."""
    total = batch * world
    m = F.lit(mult) if mult else F.greatest(F.least(int_div(n, total * 4), F.lit(50)), F.lit(1))
    return (m * total).cast("long")


def _longest_first(placed: DataFrame, length: str) -> DataFrame:
    """Swap the head of megabatch 0 with the head of the megabatch that holds the longest sample.

    The plan is written once, because the search for the longest sample and the swap both read it.
    """
    placed = stage(placed, "megabatches")
    best = placed.where("_rank = 0").agg(F.max_by(
        F.struct("_mega", "pos"), F.struct(F.abs(F.col(length)), -F.col("_mega")))).scalar()
    pos = (F.when((F.col("_rank") == 0) & (F.col("_mega") == best["_mega"]), F.lit(0))
           .when(F.col("pos") == 0, best["pos"]).otherwise(F.col("pos")))
    return placed.withColumn("pos", pos.cast("long"))


def length_grouped(lengths: DataFrame, batch: int, world: int, *, length: str = "length", sample: str = "sample_id",
                   mult: int | None = None, seed: int = 1024, epoch: int = 0, digits: int | None = None) -> DataFrame:
    """Shuffle, cut in megabatches, sort each by falling length, put the longest sample first; adds ``pos``."""
    placed = shuffled(lengths, sample, seed=seed, epoch=epoch, index="_i", totals={"_n": "_i"}, digits=digits)
    placed = placed.withColumn("_m", group_size(F.col("_n"), batch, world, mult))
    placed = placed.withColumn("_mega", int_div("_i", F.col("_m")))
    w = Window.partitionBy("_mega").orderBy(F.desc(length), "_i")
    placed = placed.withColumn("_rank", F.row_number().over(w) - 1)
    placed = placed.withColumn("pos", F.col("_mega") * F.col("_m") + F.col("_rank"))
    return _longest_first(placed, length).select(*lengths.columns, "pos")


def length_grouped_by_rank(lengths: DataFrame, batch: int, world: int, *, length: str = "length",
                           sample: str = "sample_id", mult: int | None = None, seed: int = 1024, epoch: int = 0,
                           digits: int | None = None) -> DataFrame:
    """Variant: a sorted megabatch is cut in groups of ``world`` and the groups are shuffled."""
    placed = shuffled(lengths, sample, seed=seed, epoch=epoch, index="_i", totals={"_n": "_i"}, digits=digits)
    placed = placed.withColumn("_m", group_size(F.col("_n"), batch, world, mult))
    placed = placed.withColumn("_mega", int_div("_i", F.col("_m")))
    w = Window.partitionBy("_mega").orderBy(F.desc(length), "_i")
    placed = placed.withColumn("_rank", F.row_number().over(w) - 1)
    placed = placed.withColumn("_group", int_div("_rank", world))
    key = shuffle_key("_mega", "_group", seed=seed, epoch=epoch)
    again = Window.partitionBy("_mega").orderBy("_gkey", "_group", "_rank")
    placed = placed.withColumn("_gkey", key)
    return placed.withColumn("pos", F.col("_mega") * F.col("_m") + F.row_number().over(again) - 1).select(
        *lengths.columns, "pos")


def length_grouped_by_modality(lengths: DataFrame, batch: int, world: int, *, length: str = "length",
                               sample: str = "sample_id", mult: int | None = None, seed: int = 1024,
                               epoch: int = 0, digits: int | None = None) -> DataFrame:
    """Signed lengths (negative: text only): megabatches keep to one modality and are permuted.

    The last megabatch of each modality joins one mixed last batch.  With one modality present this
    is ``length_grouped``.
    """
    signed = lengths.withColumn("_text", (F.col(length) < 0).cast("int"))
    placed = shuffled(signed, sample, seed=seed, epoch=epoch, keys=["_text"], index="_i", totals={"_n": "_i"},
                      digits=digits)
    counts = lengths.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col(length) < 0).alias("_texts"))
    counts = counts.withColumn("_m", group_size(F.col("_all"), batch, world, mult)).withColumn(
        "_single", (F.col("_texts") == 0) | (F.col("_texts") == F.col("_all")))
    facts = counts.select(F.struct("_all", "_m", "_single")).scalar()
    placed = placed.withColumn("_m", facts["_m"]).withColumn("_single", facts["_single"])
    placed = placed.withColumn("_own", int_div("_i", F.col("_m")))
    placed = stage(placed.withColumn("_last", ~F.col("_single") & (F.col("_own") == int_div(F.col("_n") - 1, F.col("_m")))), "modalities")
    # the whole megabatches, as the data has them; they are numbered in permuted order
    megas = stage(placed.where(~F.col("_last")).select("_single", "_text", "_own").distinct(), "megas")
    spread_digits = 1
    while 16 ** spread_digits * CHUNK < megas.count() and spread_digits < 8:
        spread_digits += 1
    natural = F.lpad(F.col("_own").cast("string"), 20, "0")
    megas = megas.withColumn("_key", F.when(F.col("_single"), natural).otherwise(
        shuffle_key("_text", "_own", seed=seed, epoch=epoch)))
    spread = F.when(F.col("_single"), chunk_bucket("_own")).otherwise(md5_bucket("_key", spread_digits))
    megas = running(megas, order=["_key", "_text", "_own"], bucket=spread, index="_mega", totals={"_whole": "_mega"})
    n_whole = megas.agg(F.coalesce(F.max("_whole"), F.lit(0).cast("long"))).scalar()
    placed = placed.join(megas.select("_text", "_own", "_mega"), ["_text", "_own"], "left")
    placed = placed.withColumn("_mega", F.when(F.col("_last"), n_whole).otherwise(F.col("_mega")))
    w = Window.partitionBy("_mega").orderBy(F.desc(F.abs(F.col(length))), "_text", "_i")
    placed = placed.withColumn("_rank", F.row_number().over(w) - 1)
    placed = placed.withColumn("pos", F.col("_mega") * F.col("_m") + F.col("_rank"))
    return _longest_first(placed, length).select(*lengths.columns, "pos")


def round_up(planned: DataFrame, batch: int, world: int, *, pos: str = "pos", total: str = "n") -> DataFrame:
    """Repeat the order from its start until every rank has whole batches; adds ``i``.

    A sample at position p appears at p, p + n, p + 2n, ..; ``total`` is the column that holds n.
    """
    unit = batch * world
    size = int_div(F.col(total) + (unit - 1), unit) * unit
    return planned.withColumn("i", F.explode(F.sequence(F.col(pos), size - 1, F.col(total))))


def drop_remainder(planned: DataFrame, world: int, *, pos: str = "pos", total: str = "n") -> DataFrame:
    return planned.where(F.col(pos) < int_div(total, world) * world).withColumn("i", F.col(pos))


def stripe(planned: DataFrame, world: int, *, from_step: int = 0, i: str = "i") -> DataFrame:
    """``rank`` and ``step`` of each position; resumes at ``from_step``."""
    out = planned.withColumn("rank", F.col(i) % world).withColumn("step", int_div(i, world))
    return out.where(F.col("step") >= from_step) if from_step else out


def pad_to(arr: Column | str, size: Column, value: int) -> Column:
    a = col(arr)
    return F.concat(a, F.array_repeat(F.lit(value), (size - F.size(a)).cast("int")))


def pad_batch(samples: DataFrame, batch: str, *, pad: int = PAD_INDEX, mask_from_ids: bool = False) -> DataFrame:
    """Pad ids and labels to the batch's longest sample; mask from the original length.

    ``mask_from_ids`` masks every pad id instead (the evaluation collator's rule).
    """
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    s = samples.withColumn("_size", longest).withColumn("_own", F.size("input_ids"))
    s = s.withColumn("input_ids", pad_to("input_ids", F.col("_size"), pad))
    mask = (F.transform("input_ids", lambda x: x != pad) if mask_from_ids else
            F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: i < F.col("_own")))
    return (s.withColumn("labels", pad_to("labels", F.col("_size"), IGNORE_INDEX))
            .withColumn("attention_mask", mask)
            .withColumn("position_ids", F.sequence(F.lit(0), F.col("_size") - 1)).drop("_size", "_own"))


def collate_rewards(samples: DataFrame, batch: str, order: str, *, reward: str = "reward", pad: int = PAD_INDEX) -> DataFrame:
    """One row per batch, as a reward buffer reads it: padded ``input_ids``, ``labels`` and ``attention_mask`` of its samples in
    ``order``, and their ``rewards`` as a list (null where a sample has none).

    A batch holds as many samples as the caller puts in one, so its rows fit in one.
    """
    rows = pad_batch(samples, batch, pad=pad)
    cols = ["input_ids", "labels", "attention_mask"]
    one = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), *cols, F.col(reward).cast("double").alias("_reward")))).alias("_s"))
    return one.select(batch, *[F.col(f"_s.{c}").alias(c) for c in cols], F.col("_s._reward").alias("rewards"))


def truncate(samples: DataFrame, n: int) -> DataFrame:
    """Clip ids and labels before padding."""
    return samples.withColumn("input_ids", F.slice("input_ids", 1, n)).withColumn("labels", F.slice("labels", 1, n))


def shape_faults(samples: DataFrame) -> DataFrame:
    """Rows whose ids and labels differ in length; a right corpus has none."""
    return samples.where(F.size("input_ids") != F.size("labels"))


def max_seqlen(cumulative_len: Column | str) -> Column:
    """Longest segment of a packed row."""
    c = col(cumulative_len)
    return F.array_max(F.zip_with(F.slice(c, F.lit(2), F.size(c)), F.slice(c, F.lit(1), F.size(c) - 1), lambda b, a: b - a))


def pair_rows(pairs: DataFrame) -> DataFrame:
    """Pairs -> chosen and rejected rows, interleaved by ``side`` (0 chosen, 1 rejected)."""
    keep = [c for c in pairs.columns if c not in ("chosen_ids", "chosen_labels", "rejected_ids", "rejected_labels")]
    return pairs.select(*keep, F.posexplode(F.array(
        F.struct(F.col("chosen_ids").alias("input_ids"), F.col("chosen_labels").alias("labels")),
        F.struct(F.col("rejected_ids").alias("input_ids"), F.col("rejected_labels").alias("labels")),
    )).alias("side", "_r")).select(*keep, "side", "_r.*")


def pad_to_multiple(packs: DataFrame, multiple: int, pad: int = PAD_INDEX) -> DataFrame:
    """Pad packed rows to a multiple of the sequence-parallel size.

    Padding adds a boundary to ``cumulative_len`` and false entries to ``attention_mask``; rows that
    fit already keep their boundaries and get no mask.
    """
    size = F.size("input_ids")
    extra = F.pmod(-size, F.lit(multiple))
    total = size + extra
    return (packs.withColumn("attention_mask", F.when(extra > 0, F.concat(
                F.array_repeat(F.lit(True), size), F.array_repeat(F.lit(False), extra))))
            .withColumn("cumulative_len", F.when(extra > 0, F.concat("cumulative_len", F.array(total)))
                        .otherwise(F.col("cumulative_len")))
            .withColumn("labels", pad_to("labels", total, IGNORE_INDEX))
            .withColumn("position_ids", pad_to("position_ids", total, 0))
            .withColumn("input_ids", pad_to("input_ids", total, pad)))


def shard_sequence(rows: DataFrame, shards: int, columns: list[str]) -> DataFrame:
    """Each rank takes its contiguous slice of every array; lengths divide by ``shards``."""
    part = (F.size(columns[0]) / shards).cast("int")
    cut = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("_part", part)
    for c in columns:
        cut = cut.withColumn(c, F.slice(c, F.col("shard") * F.col("_part") + 1, F.col("_part")))
    return cut.drop("_part")


def padding_report(planned: DataFrame, batch: int, *, pos: str = "pos", length: str = "length",
                   by: str = "strategy") -> DataFrame:
    """Useful and padded tokens of batches of ``batch`` consecutive positions, per strategy."""
    per = planned.groupBy(by, int_div(pos, batch).alias("_batch")).agg(
        F.sum(length).alias("_useful"), F.max(length).alias("_max"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy(by).agg(
        F.sum("_useful").alias("useful_tokens"), F.sum(F.col("_max") * F.col("_n")).alias("padded_tokens")
    ).withColumn("efficiency", F.round(F.col("useful_tokens") / F.col("padded_tokens"), 6))
