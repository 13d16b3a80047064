"""Queries: raw records, stages of a build, length sketches, file order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder
from turnmill.operators import observe, raw, sketch
from turnmill.operators.encode import drop_empty, drop_unsupervised, encode_conversation
from turnmill.operators.formats import normalise
from turnmill.operators.render import render_conversation
from turnmill.plans import inputs, sql
from turnmill.plans.corpora import _default_turn
from turnmill.plans.formats import _ALPACA, _alpaca
from turnmill.plans.registry import query
from turnmill.session import fresh_path, stage
from turnmill.sources import readers as rd


def _raw_lines(spark, d):
    """JSON lines of which six in seven have a fault of their own kind."""
    path = fresh_path(spark, "raw")
    docs = inputs.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    turn = F.struct(F.col("text").alias("input"), F.col("lang").alias("output"))
    k = F.col("doc_id") % 7
    line = (F.when(k == 0, F.concat(F.lit('{"conversation": ['), F.col("doc_id").cast("string"))).when(k == 1, F.lit("[1, 2]"))
            .when(k == 2, F.to_json(F.struct(F.col("doc_id").alias("id")))).when(k == 3, F.to_json(F.struct(F.col("lang").alias("conversation"))))
            .when(k == 4, F.lit('{"conversation": []}'))
            .when(k == 5, F.to_json(F.struct(F.array(F.struct(F.col("doc_id").alias("input"), F.col("lang").alias("output"))).alias("conversation"))))
            .otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), F.array(turn).alias("conversation"), "source"))))
    docs.select(line.alias("value")).write.text(path)
    return spark.read.text(path)


@query("raw_faults", """
SELECT coalesce(fault, 'none') AS fault, count(*) AS n FROM (SELECT ['not json', 'not an object', '$.conversation is missing',
  '$.conversation is STRING, not ARRAY', '$.conversation is empty', 'turn without input and output as texts', NULL][doc_id % 7 + 1] AS fault FROM documents) GROUP BY 1""")
def raw_faults(spark, d):
    faults = raw.record_faults(_raw_lines(spark, d))
    return faults.select(F.explode_outer("faults").alias("fault")).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query("raw_census", """
WITH k AS (SELECT doc_id % 7 AS k FROM documents),
c AS (SELECT * FROM (VALUES ('$', 'BROKEN', [0], 1), ('$', 'ARRAY', [1], 1), ('$[*]', 'NUMBER', [1], 2), ('$', 'OBJECT', [2, 3, 4, 5, 6], 1),
  ('$.id', 'NUMBER', [2, 6], 1), ('$.conversation', 'STRING', [3], 1), ('$.conversation', 'ARRAY', [4, 5, 6], 1), ('$.conversation[*]', 'OBJECT', [5, 6], 1),
  ('$.conversation[*].input', 'NUMBER', [5], 1), ('$.conversation[*].input', 'STRING', [6], 1), ('$.conversation[*].output', 'STRING', [5, 6], 1),
  ('$.source', 'STRING', [6], 1)) t(path, kind, ks, times))
SELECT path, kind, CAST(count(*) * any_value(times) AS BIGINT) AS n_values, count(*) AS n_records FROM c, k WHERE list_contains(ks, k) GROUP BY path, kind""")
def raw_census(spark, d):
    return raw.type_census(_raw_lines(spark, d))


@query("stage_observation", f"""
WITH {_ALPACA}, t AS (SELECT output <> '<nooutput>' AS filled, {_default_turn(None, "instruction || chr(10) || input", "output")} FROM alpaca),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE filled) AS f, count(*) FILTER (WHERE filled AND before < 2048) AS s,
        CAST(coalesce(sum(n) FILTER (WHERE filled AND before < 2048), 0) AS BIGINT) AS total,
        CAST(coalesce(max(n) FILTER (WHERE filled AND before < 2048), 0) AS BIGINT) AS longest FROM t)
SELECT 0 AS stage_no, 'raw' AS stage, n AS n_rows, 0 AS n_dropped, 0 AS total, 0 AS longest FROM c
UNION ALL SELECT 1, 'normalised', n, 0, 0, 0 FROM c UNION ALL SELECT 2, 'not empty', f, n - f, 0, 0 FROM c
UNION ALL SELECT 3, 'rendered', f, 0, 0, 0 FROM c UNION ALL SELECT 4, 'supervised', s, f - s, total, longest FROM c""")
def stage_observation(spark, d):
    """Counts of every stage of a build, from the one pass that encodes and writes it."""
    seen = observe.Stages()
    rows = seen.watch(_alpaca(spark, d), "raw", id_col="doc_id")
    rows = seen.watch(normalise(rows, "alpaca").select("doc_id", "conversation"), "normalised", id_col="doc_id")
    rows = seen.watch(drop_empty(rows), "not empty", id_col="doc_id")
    rows = seen.watch(render_conversation(rows, "default"), "rendered", id_col="doc_id")
    coded = drop_unsupervised(encode_conversation(rows, HashEncoder(), max_length=2048).drop("conversation"))
    seen.watch(coded, "supervised", id_col="doc_id", length=F.col("num_tokens")).write.parquet(fresh_path(spark, "observed"))
    return seen.report(spark).select("stage_no", "stage", "n_rows", "n_dropped", "total", "longest")


_G = sketch.ratio()


@query("length_quantiles", f"""
WITH v AS (SELECT source, {sql.n_words('text')} AS v FROM documents),
c AS (SELECT source, CASE WHEN v < 1 THEN -1 ELSE CAST(ceil(ln(v) / {math.log(_G)!r}) AS INTEGER) END AS b, count(*) AS n FROM v GROUP BY 1, 2),
u AS (SELECT source, b, sum(n) OVER (PARTITION BY source ORDER BY b) AS upto, sum(n) OVER (PARTITION BY source) AS n FROM c),
q AS (SELECT source, q, min(b) AS b FROM u, (SELECT unnest([0.5, 0.9, 0.99]) AS q) WHERE upto > floor((n - 1) * q) GROUP BY source, q),
w AS (SELECT source, q, CASE WHEN b = -1 THEN 0 ELSE round(pow({_G!r}, b) * 2 / ({_G!r} + 1), 4) END AS x FROM q)
SELECT v.source, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS shortest, max(v) AS longest, any_value(a.x) AS q50, any_value(b.x) AS q90, any_value(c.x) AS q99
FROM v JOIN w a ON a.source = v.source AND a.q = 0.5 JOIN w b ON b.source = v.source AND b.q = 0.9 JOIN w c ON c.source = v.source AND c.q = 0.99 GROUP BY v.source""")
def length_quantiles(spark, d):
    """Sketches stored per (source, language), merged per source."""
    stored = stage(sketch.sketch(inputs.document_lengths(spark, d), ["source", "lang"], "num_tokens"), "sketches")
    found = sketch.quantiles(sketch.merged(stored, ["source"]), [0.5, 0.9, 0.99])
    return found.select("source", "n", "total", "shortest", "longest", *[F.round(q, 4).alias(q) for q in ("q50", "q90", "q99")])


@query("file_order", """
WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'hot/' || doc_id || '.txt' WHEN doc_id % 50 = 1 THEN doc_id || '.txt' ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS rel_path FROM documents),
p AS (SELECT rel_path, string_split(rel_path, '/') AS s FROM f),
k AS (SELECT rel_path, array_to_string(list_transform(s, lambda x, i: CASE WHEN i = len(s) THEN '0' ELSE '1' END || x), chr(1)) AS sort_key FROM p)
SELECT rel_path, row_number() OVER (ORDER BY encode(sort_key)) - 1 AS file_no FROM k""")
def file_order(spark, d):
    """The order of a listing in which one folder holds a third of the files."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    rel = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("hot/"), name)).when(F.col("doc_id") % 50 == 1, name).otherwise(
        F.concat_ws("/", "source", "lang", name))
    files = inputs.table(spark, d, "documents").select(rel.alias("rel_path"))
    return rd.ordered_files(files.withColumn("sort_key", rd.sort_key_of(F.col("rel_path"))), bound=64).select("rel_path", "file_no")
