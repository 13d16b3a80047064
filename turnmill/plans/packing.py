"""Queries: packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder, joined, supervised
from turnmill.operators import pack as pk
from turnmill.operators import pairs as pr
from turnmill.operators.order import int_div
from turnmill.plans import inputs, sql
from turnmill.plans.formats import _PAIR_ROWS, pair_lists
from turnmill.plans.registry import query
from turnmill.session import stage

L = 256


def sourced_samples(spark, d, max_length=512):
    """Encoded conversations with a source name, staged once: the plan reads lengths, the cut reads tokens."""
    s = inputs.samples(spark, d, max_length)
    return stage(s.withColumn("source", F.concat(F.lit("s"), (F.col("sample_id") % 3).cast("string"))), "samples")


SOURCED = sql.samples(512) + """,
src AS (SELECT *, 's' || (sample_id % 3) AS source FROM samples)
"""


def _fragments(table: str, limit: int, carry: str = "") -> str:
    c = f", {carry}" if carry else ""
    return f"""
placed AS (SELECT sample_id, source, num_tokens{c},
             coalesce(sum(num_tokens) OVER (PARTITION BY source ORDER BY {sql.key('sample_id')}, sample_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(num_tokens) OVER (PARTITION BY source) AS total
           FROM {table} WHERE num_tokens > 0),
cut AS (SELECT sample_id, source{c}, b, total, b + num_tokens AS e, unnest(range(CAST(b // {limit} AS BIGINT),
          CAST((b + num_tokens - 1) // {limit} + 1 AS BIGINT))) AS pack FROM placed),
frag AS (SELECT sample_id, source{c}, pack, total // {limit} AS full_packs, CAST(greatest(b, pack * {limit}) - pack * {limit} AS INTEGER) AS spot,
           CAST(greatest(b, pack * {limit}) - b AS INTEGER) AS skip,
           CAST(least(e, (pack + 1) * {limit}) - greatest(b, pack * {limit}) AS INTEGER) AS n FROM cut)
"""


_PACKS = SOURCED + "," + _fragments("src", L, "input_ids, labels") + """,
packs AS (SELECT source, pack, flatten(list(input_ids[skip + 1 : skip + n] ORDER BY spot)) AS input_ids,
            flatten(list(labels[skip + 1 : skip + n] ORDER BY spot)) AS labels, list(n ORDER BY spot) AS lens
          FROM frag WHERE pack < full_packs GROUP BY source, pack)
"""


@query("pack_range", f"WITH {_PACKS} SELECT source, pack, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels FROM packs")
def pack_range(spark, d):
    packs = pk.pack_range(sourced_samples(spark, d), L)
    return packs.select("source", "pack", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("pack_summary", f"""
WITH {_PACKS}
SELECT source, count(*) AS n_packs, CAST(sum(len(input_ids)) AS BIGINT) AS n_tokens,
       CAST(sum(len(list_filter(labels, lambda x: x >= 0))) AS BIGINT) AS n_supervised,
       round(sum(len(list_filter(labels, lambda x: x >= 0))) / sum(len(input_ids)), 6) AS share FROM packs GROUP BY source""")
def pack_summary(spark, d):
    """Flagship: conversations -> turns -> template -> tokens -> packs: how many, and what share has loss."""
    packs = pk.pack_range(sourced_samples(spark, d), L)
    n, s = F.sum(F.size("input_ids")), F.sum(supervised("labels"))
    return packs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_packs"), n.alias("n_tokens"), s.alias("n_supervised"), F.round(s / n, 6).alias("share"))


_DOCS = f"docs AS (SELECT doc_id AS sample_id, source, {sql.n_words('text')} AS num_tokens FROM documents)"


@query("pack_range_plan", f"""
WITH {_DOCS}, {_fragments('docs', 2048)}
SELECT source, pack, spot AS "at", sample_id, skip, n FROM frag WHERE pack < full_packs""")
def pack_range_plan(spark, d):
    return pk.range_plan(inputs.document_lengths(spark, d), 2048)


@query("pack_tail_emit", f"""
WITH {_DOCS}, {_fragments('docs', 2048)}
SELECT source, pack, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_fragments, min(skip) = 0 AS starts_sample
FROM frag GROUP BY source, pack""")
def pack_tail_emit(spark, d):
    plan = pk.range_plan(inputs.document_lengths(spark, d), 2048, tail="emit")
    return plan.groupBy("source", "pack").agg(
        F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_fragments"), (F.min("skip") == 0).alias("starts_sample"))


@query("pack_hard_longest", f"""
WITH {_DOCS}, {_fragments('docs', 4096)}
SELECT source, pack, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_fragments, CAST(max(n) AS BIGINT) AS longest
FROM frag WHERE pack < full_packs GROUP BY source, pack""")
def pack_hard_longest(spark, d):
    return pk.longest_fragment(pk.range_plan(inputs.document_lengths(spark, d), 4096))


@query("pack_boundaries", f"""
WITH {_PACKS}
SELECT source, pack, array_to_string(list_prepend(0, list_transform(range(1, len(lens) + 1), lambda i: CAST(list_sum(lens[1:i]) AS BIGINT))), ',') AS cumulative_len,
       array_to_string(flatten(list_transform(lens, lambda n: range(n))), ',') AS position_ids FROM packs""")
def pack_boundaries(spark, d):
    packs = pk.pack_range(sourced_samples(spark, d), L)
    return packs.select("source", "pack", joined("cumulative_len").alias("cumulative_len"), joined("position_ids").alias("position_ids"))


@query("unpack", f"""
WITH {_PACKS},
seg AS (SELECT source, pack, unnest(lens) AS n, generate_subscripts(lens, 1) AS k, lens, input_ids, labels FROM packs)
SELECT source, pack, CAST(k - 1 AS INTEGER) AS segment,
       {sql.text("input_ids[coalesce(list_sum(lens[1:k-1]), 0) + 1 : coalesce(list_sum(lens[1:k-1]), 0) + n]")} AS input_ids,
       {sql.text("labels[coalesce(list_sum(lens[1:k-1]), 0) + 1 : coalesce(list_sum(lens[1:k-1]), 0) + n]")} AS labels FROM seg""")
def unpack(spark, d):
    parts = pk.unpack(pk.pack_range(sourced_samples(spark, d), L), ["source", "pack"])
    return parts.select("source", "pack", "segment", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("pack_batch", f"""
WITH {sql.samples(128)},
g AS (SELECT sample_id // 8 AS batch, flatten(list(input_ids ORDER BY sample_id)) AS input_ids, flatten(list(labels ORDER BY sample_id)) AS labels,
        list(len(input_ids) ORDER BY sample_id) AS lens FROM samples GROUP BY 1)
SELECT CAST(batch AS BIGINT) AS batch, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels,
       array_to_string(list_prepend(0, list_transform(range(1, len(lens) + 1), lambda i: CAST(list_sum(lens[1:i]) AS BIGINT))), ',') AS cumulative_len FROM g""")
def pack_batch(spark, d):
    s = inputs.samples(spark, d, 128).withColumn("batch", int_div("sample_id", 8))
    return pk.pack_batch(s, "batch", "sample_id").select(
        "batch", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"), joined("cumulative_len").alias("cumulative_len"))


def _next_fit(table: str, limit: int) -> str:
    return f"""
o AS (SELECT source, sample_id, num_tokens, row_number() OVER (PARTITION BY source ORDER BY {sql.key('sample_id')}, sample_id) AS rn FROM {table}),
walk AS (
  SELECT source, sample_id, num_tokens, rn, CAST(0 AS BIGINT) AS bin, CAST(0 AS BIGINT) AS spot, num_tokens AS fill FROM o WHERE rn = 1
  UNION ALL
  SELECT o.source, o.sample_id, o.num_tokens, o.rn, CASE WHEN w.fill + o.num_tokens > {limit} THEN w.bin + 1 ELSE w.bin END,
         CASE WHEN w.fill + o.num_tokens > {limit} THEN 0 ELSE w.fill END,
         CASE WHEN w.fill + o.num_tokens > {limit} THEN o.num_tokens ELSE w.fill + o.num_tokens END
  FROM walk w JOIN o ON o.source = w.source AND o.rn = w.rn + 1)
"""


_PAIR_LENGTHS = f"""
{_PAIR_ROWS},
texts AS (SELECT conv_id * 1000 + turn AS sample_id,
  '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10)
  || '<|im_start|>assistant' || chr(10) AS prompt, chosen || '<|im_end|>' || chr(10) AS c, rejected || '<|im_end|>' || chr(10) AS r FROM p),
pairs AS (SELECT sample_id, 'pairs' AS source, {sql.ids('prompt')} AS pi, {sql.ids('prompt || c')} AS ci, {sql.ids('prompt || r')} AS ri FROM texts)
"""


@query("pack_next_fit_pairs", f"""
WITH RECURSIVE {_PAIR_LENGTHS},
sized AS (SELECT sample_id, source, CAST(len(ci) + len(ri) AS BIGINT) AS num_tokens FROM pairs WHERE len(ci) + len(ri) <= 600),
{_next_fit('sized', 600)},
segs AS (SELECT bin, spot, ci AS ids, list_concat({sql.masked('pi')}, ci[len(pi) + 1:]) AS labels FROM walk JOIN pairs USING (sample_id)
         UNION ALL SELECT bin, spot + len(ci), ri, list_concat({sql.masked('pi')}, ri[len(pi) + 1:]) FROM walk JOIN pairs USING (sample_id)),
g AS (SELECT bin, flatten(list(ids ORDER BY spot)) AS input_ids, flatten(list(labels ORDER BY spot)) AS labels, list(len(ids) ORDER BY spot) AS lens FROM segs GROUP BY bin)
SELECT bin, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels,
       array_to_string(list_prepend(0, list_transform(range(1, len(lens) + 1), lambda i: CAST(list_sum(lens[1:i]) AS BIGINT))), ',') AS cumulative_len FROM g""")
def pack_next_fit_pairs(spark, d):
    coded = pr.encode_pairs(pair_lists(spark, d), "qwen2", HashEncoder(), max_length=2048)
    coded = stage(coded.withColumnRenamed("pair_id", "sample_id").withColumn("source", F.lit("pairs")), "pairs")
    packs = pk.pack_pairs(coded, 600)
    return packs.select("bin", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"),
                        joined("cumulative_len").alias("cumulative_len"))


@query("pack_soft", f"""
WITH RECURSIVE {_DOCS}, {_next_fit('docs', 2048)}
SELECT source, bin, count(*) AS n_samples, CAST(sum(num_tokens) AS BIGINT) AS n_tokens, CAST(max(num_tokens) AS BIGINT) AS longest
FROM walk GROUP BY source, bin""")
def pack_soft(spark, d):
    return pk.soft_pack(inputs.document_lengths(spark, d), 2048)


@query("pack_soft_blended", f"""
WITH RECURSIVE d AS (SELECT doc_id AS sample_id, 'all' AS source, {sql.n_words('text')} AS num_tokens FROM documents), {_next_fit('d', 2048)}
SELECT bin, spot AS "at", sample_id, num_tokens FROM walk""")
def pack_soft_blended(spark, d):
    """All sources blended in one order: one chain over the whole corpus."""
    docs = inputs.document_lengths(spark, d).withColumn("source", F.lit("all"))
    return pk.next_fit(docs, 2048, drop_oversize=False).select("bin", "at", "sample_id", "num_tokens")
