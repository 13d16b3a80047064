"""Queries: corpus reports and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.text import strip
from turnmill.functions.tokens import HashEncoder, int_array, joined, masked
from turnmill.operators import profile as pf
from turnmill.operators.order import chunk_bucket, running
from turnmill.plans import inputs, sql
from turnmill.plans.registry import query

ENC = HashEncoder()


@query("dataset_info", f"""
WITH {sql.samples(256)}
SELECT (SELECT count(*) FROM samples) AS n_samples, sample_id AS first_id, num_tokens, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels
FROM samples ORDER BY sample_id LIMIT 1""")
def dataset_info(spark, d):
    """Sample count and the first sample (a preview)."""
    s = inputs.samples(spark, d, 256)
    return s.orderBy("sample_id").limit(1).select(
        s.agg(F.count(F.lit(1))).scalar().alias("n_samples"), F.col("sample_id").alias("first_id"), F.col("num_tokens").cast("long").alias("num_tokens"),
        joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("token_accounting", f"""
WITH c AS (SELECT source, lang, CAST(1 + len({sql.words(sql.strip('text'))}) AS BIGINT) AS n FROM documents)
SELECT source, lang, count(*) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n - 1) AS BIGINT) AS n_supervised,
       CAST(min(n) AS INTEGER) AS shortest, CAST(max(n) AS INTEGER) AS longest FROM c GROUP BY source, lang""")
def token_accounting(spark, d):
    """A pretraining corpus: BOS, then the text, all of it with loss."""
    docs = inputs.texts(spark, d).select("source", "lang", ENC.ids(strip("text")).alias("ids"))
    coded = docs.select("source", "lang", F.concat(int_array(ENC.bos), "ids").alias("input_ids"),
                        F.concat(masked(int_array(ENC.bos)), "ids").alias("labels")).withColumn("num_tokens", F.size("input_ids"))
    return pf.token_accounting(coded, ["source", "lang"])


@query("format_check", f"""
WITH {sql.TURNS}
SELECT 's' || (sample_id % 3) AS source, count(*) AS n_turns, count(*) FILTER (WHERE input IS NULL) AS null_input, count(*) FILTER (WHERE output IS NULL) AS null_output,
       count(*) FILTER (WHERE input = '') AS empty_input, count(*) FILTER (WHERE output = '') AS empty_output FROM turns GROUP BY 1""")
def format_check(spark, d):
    t = inputs.turns(spark, d).withColumn("source", F.concat(F.lit("s"), (F.col("sample_id") % 3).cast("string")))
    pf.require_columns(t, {"sample_id": "bigint", "input": "string", "output": "string"})
    return pf.format_faults(t, by=["source"])


@query("dialogue_qa", """
WITH e AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
g AS (SELECT conv_id AS sample_id, count(*) AS n_messages, count(*) FILTER (WHERE prev = role) AS n_repeated, arg_min(role, turn) AS first_role,
        arg_max(role, turn) AS last_role, count(*) % 2 = 1 AS is_odd FROM e GROUP BY conv_id)
SELECT *, row_number() OVER (ORDER BY sample_id) AS new_id FROM g""")
def dialogue_qa(spark, d):
    """Checks per dialogue, and the dialogues renumbered from 1."""
    checks = pf.dialogue_checks(inputs.messages(spark, d))
    placed = running(checks, order=["sample_id"], bucket=chunk_bucket("sample_id"), index="_i")
    return placed.withColumn("new_id", F.col("_i") + 1).drop("_i")


_MODEL = dict(hidden=4096, layers=32, vocab=32000, mlp_ratio=2.6875)


@query("throughput", """
WITH s AS (SELECT event_id AS step, event_type AS run, CAST(1 + event_id % 8 AS INTEGER) AS b, CAST(1024 * (1 + event_id % 4) AS INTEGER) AS s, value / 10 AS t FROM events),
f AS (SELECT run, step, b * s / 2.0 / (t + 1e-12) AS tps, CAST(b AS DOUBLE) AS b, s / 2.0 AS s, t FROM s),
g AS (SELECT *, 4 * 32 * (8 * b * s * 16777216.0 + 4 * b * s * s * 4096.0 * 2 / 2 + 4 * (2.6875 * 1.5) * b * s * 16777216.0) + 6 * b * s * 4096.0 * 32000 AS flops FROM f)
SELECT run, count(*) AS n_steps, round(avg(tps), 3) AS tokens_per_sec, round(avg(flops / 1e12 / (t + 1e-12)), 3) AS tflops FROM g GROUP BY run""")
def throughput(spark, d):
    e = inputs.table(spark, d, "events").select(
        F.col("event_type").alias("run"), (1 + F.col("event_id") % 8).cast("int").alias("batch_size"),
        (1024 * (1 + F.col("event_id") % 4)).cast("int").alias("seq_len"), (F.col("value") / 10).alias("iter_time"))
    return pf.throughput(e, sp=2, **_MODEL).groupBy("run").agg(
        F.count(F.lit(1)).alias("n_steps"), F.round(F.avg("tokens_per_sec"), 3).alias("tokens_per_sec"), F.round(F.avg("tflops"), 3).alias("tflops"))

