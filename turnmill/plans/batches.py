"""Queries: batch plans, padding, sequence shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder, joined
from turnmill.operators import batch as bt
from turnmill.operators import pack as pk
from turnmill.operators import pairs as pr
from turnmill.operators.order import int_div, shuffled
from turnmill.plans import inputs, sql
from turnmill.plans.formats import pair_lists
from turnmill.plans.packing import _PACKS, _PAIR_LENGTHS, L, sourced_samples
from turnmill.plans.registry import query

BATCH, WORLD = 4, 2


def _lengths(spark, d):
    return inputs.document_lengths(spark, d).select("sample_id", F.col("num_tokens").alias("length"))


_SIZED = f"""
sized AS (SELECT doc_id AS sample_id, {sql.n_words('text')} AS length FROM documents),
shuf AS (SELECT *, row_number() OVER (ORDER BY {sql.key('sample_id')}, sample_id) - 1 AS i, (SELECT count(*) FROM documents) AS n FROM sized),
mega AS (SELECT *, CAST(greatest(least(n // {BATCH * WORLD * 4}, 50), 1) * {BATCH * WORLD} AS BIGINT) AS m,
           i // CAST(greatest(least(n // {BATCH * WORLD * 4}, 50), 1) * {BATCH * WORLD} AS BIGINT) AS g FROM shuf),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY length DESC, i) - 1 AS r FROM mega)
"""

_SWAP = """
posd AS (SELECT *, g * m + r AS p FROM ranked),
best AS (SELECT g FROM posd WHERE r = 0 ORDER BY abs(length) DESC, g LIMIT 1),
grouped AS (SELECT sample_id, length, n, CAST(CASE WHEN r = 0 AND g = (SELECT g FROM best) THEN 0
              WHEN p = 0 THEN (SELECT p FROM posd WHERE r = 0 AND g = (SELECT g FROM best)) ELSE p END AS BIGINT) AS pos FROM posd)
"""


@query("length_grouped", f"WITH {_SIZED}, {_SWAP} SELECT sample_id, length, pos FROM grouped")
def length_grouped(spark, d):
    return bt.length_grouped(_lengths(spark, d), BATCH, WORLD)


@query("length_grouped_dp", f"""
WITH {_SIZED},
k AS (SELECT *, r // {WORLD} AS q, md5(concat_ws(':', '1024', '0', CAST(g AS VARCHAR), CAST(r // {WORLD} AS VARCHAR))) AS gk FROM ranked)
SELECT sample_id, length, CAST(g * m + row_number() OVER (PARTITION BY g ORDER BY gk, q, r) - 1 AS BIGINT) AS pos FROM k""")
def length_grouped_dp(spark, d):
    return bt.length_grouped_by_rank(_lengths(spark, d), BATCH, WORLD)


@query("length_grouped_modality", f"""
WITH sized AS (SELECT doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN -{sql.n_words('text')} ELSE {sql.n_words('text')} END AS length,
                 CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS modality FROM documents),
shuf AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY {sql.key('sample_id')}, sample_id) - 1 AS i,
           count(*) OVER (PARTITION BY modality) AS own_n, (SELECT count(*) FROM documents) AS n FROM sized),
own AS (SELECT *, CAST(greatest(least(n // {BATCH * WORLD * 4}, 50), 1) * {BATCH * WORLD} AS BIGINT) AS m FROM shuf),
og AS (SELECT *, i // m AS own_g, i // m = (own_n - 1) // m AS is_last FROM own),
perm AS (SELECT modality, own_g, row_number() OVER (ORDER BY md5(concat_ws(':', '1024', '0', CAST(modality AS VARCHAR), CAST(own_g AS VARCHAR))),
           modality, own_g) - 1 AS g FROM (SELECT DISTINCT modality, own_g FROM og WHERE NOT is_last)),
mega AS (SELECT og.*, CASE WHEN is_last THEN (SELECT count(*) FROM perm) ELSE g END AS g FROM og LEFT JOIN perm USING (modality, own_g)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(length) DESC, modality, i) - 1 AS r FROM mega), {_SWAP}
SELECT sample_id, length, pos FROM grouped""")
def length_grouped_modality(spark, d):
    signed = _lengths(spark, d).withColumn("length", F.when(F.col("sample_id") % 3 == 0, -F.col("length")).otherwise(F.col("length")))
    return bt.length_grouped_by_modality(signed, BATCH, WORLD)


_ORDERED = f"""
o AS (SELECT conv_id AS sample_id, turn, row_number() OVER (ORDER BY md5(concat_ws(':', '1024', '0', CAST(conv_id * 1000 + turn AS VARCHAR))),
        conv_id * 1000 + turn) - 1 AS pos, (SELECT count(*) FROM conversations) AS n FROM conversations)
"""


def _ordered(spark, d):
    m = inputs.messages(spark, d).select("sample_id", "turn", (F.col("sample_id") * 1000 + F.col("turn")).alias("msg"))
    return shuffled(m, "msg", index="pos", totals={"n": "pos"}).drop("msg")


_ROUNDED = f"{_ORDERED}, u AS (SELECT *, unnest(range(pos, CAST(ceil(n / 24.0) AS BIGINT) * 24, n)) AS i FROM o)"


@query("round_up_index", f"WITH {_ROUNDED} SELECT sample_id, turn, i FROM u")
def round_up_index(spark, d):
    return bt.round_up(_ordered(spark, d), 8, 3).select("sample_id", "turn", "i")


@query("rank_stripe", f'WITH {_ROUNDED} SELECT sample_id, turn, i % 3 AS "rank", i // 3 AS step FROM u WHERE i // 3 >= 5')
def rank_stripe(spark, d):
    return bt.stripe(bt.round_up(_ordered(spark, d), 8, 3), 3, from_step=5).select("sample_id", "turn", "rank", "step")


@query("rank_stripe_drop", f'WITH {_ORDERED} SELECT sample_id, turn, pos % 7 AS "rank", pos // 7 AS step FROM o WHERE pos < n // 7 * 7')
def rank_stripe_drop(spark, d):
    return bt.stripe(bt.drop_remainder(_ordered(spark, d), 7), 7).select("sample_id", "turn", "rank", "step")


_BATCHED = sql.samples(256) + """,
b AS (SELECT sample_id, sample_id // 8 AS batch, input_ids, labels, len(input_ids) AS own, max(len(input_ids)) OVER (PARTITION BY sample_id // 8) AS size FROM samples),
padded AS (SELECT sample_id, CAST(batch AS BIGINT) AS batch, own, size,
             list_concat(input_ids, list_transform(range(size - own), lambda x: CAST(0 AS BIGINT))) AS input_ids,
             list_concat(labels, list_transform(range(size - own), lambda x: CAST(-100 AS BIGINT))) AS labels FROM b)
"""


def _mask(c):
    return joined(F.transform(c, lambda x: x.cast("int")), "")


@query("pad_batch", f"""
WITH {_BATCHED}
SELECT sample_id, batch, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels,
       repeat('1', own) || repeat('0', size - own) AS attention_mask, array_to_string(range(size), ',') AS position_ids FROM padded""")
def pad_batch(spark, d):
    s = inputs.samples(spark, d, 256).withColumn("batch", int_div("sample_id", 8))
    return bt.pad_batch(s, "batch").select(
        "sample_id", "batch", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"),
        _mask(F.col("attention_mask")).alias("attention_mask"), joined("position_ids").alias("position_ids"))


@query("pad_batch_eval", f"""
WITH {_BATCHED}
SELECT sample_id, batch, 'subject ' || (sample_id % 5) AS subject, {sql.text('input_ids')} AS input_ids,
       array_to_string(list_transform(input_ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), '') AS attention_mask FROM padded""")
def pad_batch_eval(spark, d):
    s = inputs.samples(spark, d, 256).withColumn("batch", int_div("sample_id", 8)).withColumn(
        "subject", F.concat(F.lit("subject "), (F.col("sample_id") % 5).cast("string")))
    return bt.pad_batch(s, "batch", mask_from_ids=True).select(
        "sample_id", "batch", "subject", joined("input_ids").alias("input_ids"), _mask(F.col("attention_mask")).alias("attention_mask"))


@query("collate_rewards", f"""
WITH {_BATCHED}
SELECT batch, count(*) AS n, CAST(any_value(size) AS BIGINT) AS width, string_agg({sql.text('input_ids')}, ';' ORDER BY sample_id) AS input_ids,
       string_agg(coalesce(CAST(CASE WHEN sample_id % 5 > 0 THEN sample_id % 7 END AS VARCHAR), 'null'), ',' ORDER BY sample_id) AS rewards FROM padded GROUP BY batch""")
def collate_rewards(spark, d):
    reward = F.when(F.col("sample_id") % 5 > 0, (F.col("sample_id") % 7).cast("double"))
    s = inputs.samples(spark, d, 256).withColumns({"batch": int_div("sample_id", 8), "reward": reward})
    rows = bt.collate_rewards(s, "batch", "sample_id")
    each = F.transform("rewards", lambda r: F.coalesce(r.cast("int").cast("string"), F.lit("null")))
    return rows.select("batch", F.size("rewards").cast("long").alias("n"), F.size(F.element_at("input_ids", 1)).cast("long").alias("width"),
                       F.array_join(F.transform("input_ids", lambda ids: joined(ids)), ";").alias("input_ids"), F.array_join(each, ",").alias("rewards"))


@query("pad_pairs", f"""
WITH {_PAIR_LENGTHS},
s AS (SELECT sample_id AS pair_id, 0 AS side, ci[1:300] AS input_ids, list_concat({sql.masked('pi')}, ci[len(pi) + 1:])[1:300] AS labels FROM pairs
      UNION ALL SELECT sample_id, 1, ri[1:300], list_concat({sql.masked('pi')}, ri[len(pi) + 1:])[1:300] FROM pairs),
b AS (SELECT *, pair_id // 4000 AS batch, len(input_ids) AS own, max(len(input_ids)) OVER (PARTITION BY pair_id // 4000) AS size FROM s)
SELECT pair_id, CAST(batch AS BIGINT) AS batch, side,
       {sql.text("list_concat(input_ids, list_transform(range(size - own), lambda x: CAST(0 AS BIGINT)))")} AS input_ids,
       {sql.text("list_concat(labels, list_transform(range(size - own), lambda x: CAST(-100 AS BIGINT)))")} AS labels FROM b""")
def pad_pairs(spark, d):
    coded = pr.encode_pairs(pair_lists(spark, d), "qwen2", HashEncoder(), max_length=300)
    rows = bt.pair_rows(coded.withColumn("batch", int_div("pair_id", 4000)))
    return bt.pad_batch(rows, "batch").select("pair_id", "batch", "side", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("pad_to_multiple", f"""
WITH {sql.samples(200)},
p AS (SELECT sample_id, input_ids, labels, len(input_ids) AS own, (7 - len(input_ids) % 7) % 7 AS extra FROM samples)
SELECT sample_id, {sql.text("list_concat(input_ids, list_transform(range(extra), lambda x: CAST(0 AS BIGINT)))")} AS input_ids,
       {sql.text("list_concat(labels, list_transform(range(extra), lambda x: CAST(-100 AS BIGINT)))")} AS labels,
       '0,' || own || CASE WHEN extra > 0 THEN ',' || (own + extra) ELSE '' END AS cumulative_len,
       CASE WHEN extra > 0 THEN repeat('1', own) || repeat('0', extra) END AS attention_mask FROM p""")
def pad_to_multiple(spark, d):
    one = pk.pack_batch(inputs.samples(spark, d, 200).withColumn("row", F.col("sample_id")), "row", "sample_id")
    return bt.pad_to_multiple(one, 7).select(
        F.col("row").alias("sample_id"), joined("input_ids").alias("input_ids"), joined("labels").alias("labels"),
        joined("cumulative_len").alias("cumulative_len"), _mask(F.col("attention_mask")).alias("attention_mask"))


@query("max_seqlen", f"""
WITH {_PACKS} SELECT source, pack, CAST(list_max(lens) AS INTEGER) AS max_seqlen, CAST(len(input_ids[1:100]) AS INTEGER) AS n_cut, 0 AS n_faults FROM packs""")
def max_seqlen(spark, d):
    """Longest segment of each pack; ids and labels of a pack have one length, also when cut."""
    packs = pk.pack_range(sourced_samples(spark, d), L)
    cut = bt.truncate(packs, 100)
    faults = bt.shape_faults(cut).groupBy("source", "pack").agg(F.count(F.lit(1)).alias("f"))
    return cut.select("source", "pack", bt.max_seqlen("cumulative_len").alias("max_seqlen"), F.size("input_ids").alias("n_cut")).join(
        faults, ["source", "pack"], "left").select("source", "pack", "max_seqlen", "n_cut", F.coalesce("f", F.lit(0)).cast("int").alias("n_faults"))


@query("sequence_shard", f"""
WITH {_PACKS}
SELECT source, pack, CAST(s AS INTEGER) AS shard, {sql.text(f'input_ids[s * {L // 4} + 1 : (s + 1) * {L // 4}]')} AS input_ids,
       {sql.text(f'labels[s * {L // 4} + 1 : (s + 1) * {L // 4}]')} AS labels FROM packs, unnest(range(4)) t(s)""")
def sequence_shard(spark, d):
    packs = pk.pack_range(sourced_samples(spark, d), L).select("source", "pack", "input_ids", "labels")
    cut = bt.shard_sequence(packs, 4, ["input_ids", "labels"])
    return cut.select("source", "pack", "shard", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("padding_efficiency", f"""
WITH {_SIZED}, {_SWAP},
plans AS (SELECT 'stored' AS strategy, sample_id AS pos, length FROM sized UNION ALL SELECT 'shuffled', i, length FROM shuf
          UNION ALL SELECT 'length_grouped', pos, length FROM grouped),
b AS (SELECT strategy, sum(length) AS useful, max(length) * count(*) AS padded FROM plans GROUP BY strategy, pos // {BATCH})
SELECT strategy, CAST(sum(useful) AS BIGINT) AS useful_tokens, CAST(sum(padded) AS BIGINT) AS padded_tokens,
       round(sum(useful) / sum(padded), 6) AS efficiency FROM b GROUP BY strategy""")
def padding_efficiency(spark, d):
    sized = _lengths(spark, d)
    plans = (sized.select(F.lit("stored").alias("strategy"), F.col("sample_id").alias("pos"), "length")
             .unionByName(shuffled(sized, "sample_id", index="pos").select(F.lit("shuffled").alias("strategy"), "pos", "length"))
             .unionByName(bt.length_grouped(sized, BATCH, WORLD).select(F.lit("length_grouped").alias("strategy"), "pos", "length")))
    return bt.padding_report(plans, BATCH)
