"""Queries: reuse of file work, path rules, epochs of lines, array shards, access to single packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder, joined, words
from turnmill.operators import pack as pk
from turnmill.operators import packfiles
from turnmill.plans import inputs, sql
from turnmill.plans.packing import _PACKS, L, SOURCED, _fragments, sourced_samples
from turnmill.plans.registry import query
from turnmill.session import fresh_path, stage
from turnmill.sources import arrays, rules
from turnmill.sources import readers as rd
from turnmill.sources.cache import FileCache
from turnmill.streaming import epochs

_LINE = "CAST(doc_id AS VARCHAR) || ' ' || replace(replace(text, chr(10), ' '), chr(13), ' ')"


def _lines(docs):
    text = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return docs.select(F.col("source").alias("folder"), F.concat_ws(" ", F.col("doc_id").cast("string"), text).alias("value"))


@query("cache_reuse", f"""
WITH l AS (SELECT source, {_LINE} AS line, source = (SELECT max(source) FROM documents) AS changed FROM documents),
r AS (SELECT 1 AS run, source, FALSE AS reused, line FROM l
      UNION ALL SELECT 2, source, NOT changed, CASE WHEN changed THEN line || ' changed' ELSE line END FROM l)
SELECT run, source, reused, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes, CAST(sum({sql.n_words('line')}) AS BIGINT) AS n_tokens
FROM r GROUP BY run, source, reused""")
def cache_reuse(spark, d):
    """Two runs over folders of text files, of which one is written anew in between: the second encodes that one only."""
    root, box = fresh_path(spark, "cache-source"), fresh_path(spark, "cache")
    docs = inputs.table(spark, d, "documents")
    _lines(docs).write.partitionBy("folder").text(root)
    cache = FileCache(spark, box, HashEncoder().version, lambda line: F.size(words(line)))
    first = cache.index(root, ".txt")
    last = docs.agg(F.max("source")).first()[0]
    _lines(docs.where(F.col("source") == last)).select(F.concat("value", F.lit(" changed")).alias("value")).write.mode("overwrite").text(f"{root}/folder={last}")
    second = cache.index(root, ".txt")
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.groupBy("run", F.regexp_extract("path", "folder=([^/]+)/", 1).alias("source"), "reused").agg(
        *[F.sum(c).alias(c) for c in ("n_lines", "n_bytes", "n_tokens")])


@query("cache_offsets", f"""
SELECT source, doc_id, CAST(strlen({_LINE}) + 1 AS BIGINT) AS bytes, {sql.n_words(_LINE)} AS num_tokens FROM documents""")
def cache_offsets(spark, d):
    """Lines read back from a cache that an earlier run filled: every line is then read from its file at its offset."""
    root, box = fresh_path(spark, "cache-source"), fresh_path(spark, "cache")
    _lines(inputs.table(spark, d, "documents")).write.partitionBy("folder").text(root)
    FileCache(spark, box, "words", lambda line: F.size(words(line))).index(root, ".txt")
    cache = FileCache(spark, box, "words", lambda line: F.raise_error(F.lit("nothing is counted again")))
    from turnmill.sources.sinks import read_at
    found = read_at(cache.lines(cache.index(root, ".txt")))
    return found.select(F.regexp_extract("path", "folder=([^/]+)/", 1).alias("source"), F.regexp_extract("line", r"^(\d+) ", 1).cast("long").alias("doc_id"),
                        "bytes", "num_tokens")


_RULED = f"""
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS no FROM (SELECT DISTINCT source FROM documents)),
a AS (SELECT doc_id, CASE WHEN no = 0 AND lang = (SELECT min(lang) FROM documents) THEN 2 WHEN no = 0 THEN 1 WHEN no = 1 THEN 3 ELSE 0 END AS rule
      FROM documents JOIN s USING (source) WHERE no < 2 OR strlen(text) < 3000),
p AS (SELECT doc_id, rule, [1.0, 1.5, 0.5, 2.25][rule + 1] AS ratio, row_number() OVER (PARTITION BY rule ORDER BY {sql.key('doc_id')}, doc_id) - 1 AS pos,
        count(*) OVER (PARTITION BY rule) AS n FROM a),
once AS (SELECT rule, doc_id, floor(ratio) + CASE WHEN pos < floor(n * ratio) - floor(ratio) * n THEN 1 ELSE 0 END AS times FROM p WHERE rule <> 3),
draw AS (SELECT CAST('0x' || substr(md5('1024:draw:3:' || k), 1, 15) AS BIGINT) % n AS pos
         FROM (SELECT DISTINCT n, unnest(range(CAST(floor(n * ratio) AS BIGINT))) AS k FROM p WHERE rule = 3)),
drawn AS (SELECT rule, doc_id, count(*) AS times FROM p JOIN draw USING (pos) WHERE rule = 3 GROUP BY rule, doc_id)
SELECT CAST(rule AS INTEGER) AS rule, doc_id, CAST(times AS BIGINT) AS times FROM (SELECT * FROM once UNION ALL SELECT * FROM drawn) WHERE times > 0"""


@query("src_rules", _RULED)
def src_rules(spark, d):
    """Folders by source and language under four rules: a cap, two ratios of which the longer path wins, and draws."""
    root = fresh_path(spark, "ruled")
    docs = inputs.table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("folder"), F.col("lang").alias("sub"))
    docs.write.partitionBy("folder", "sub").json(root)
    names = [r["folder"] for r in docs.select("folder").distinct().orderBy("folder").limit(2).collect()]
    lang = docs.agg(F.min("sub")).first()[0]
    asked = [rules.Rule(root, max_length=3000), rules.Rule(f"{root}/folder={names[0]}", 1.5), rules.Rule(f"{root}/folder={names[0]}/sub={lang}", 0.5)]
    asked += [rules.Rule(f"{root}/folder={name}", 2.25, replacement=True) for name in names[1:]]
    rows = rules.read_by_rules(spark, "doc_id bigint, text string", asked, id_col="doc_id", length=lambda: F.octet_length("text"))
    return rows.groupBy("rule", "doc_id").agg(F.count(F.lit(1)).alias("times"))


@query("epoch_lines", """
SELECT e AS epoch, doc_id, CAST(strlen(CAST(doc_id AS VARCHAR) || ' ' || source || ' ' || lang) AS INTEGER) AS bytes
FROM documents, (SELECT unnest([0, 1, 2]) AS e)""")
def epoch_lines(spark, d):
    """Three epochs of lines; the stream is stopped in the second one and started again."""
    src, out, ck = (fresh_path(spark, n) for n in ("epochs-in", "epochs-out", "epochs-ck"))
    inputs.table(spark, d, "documents").select(F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "lang").alias("value")).write.text(src)
    size = sum(n for _, n in epochs.listing(src, ".txt"))

    def lines():
        return epochs.epoch_stream(spark, src, ck, epochs=3, suffix=".txt", max_bytes=max(size * 2 // 5, 1))
    epochs.run_epochs(lines(), out, ck, batches=3)
    epochs.run_epochs(lines(), out, ck)
    found = spark.read.schema(epochs.SCHEMA).parquet(out)
    return found.select("epoch", F.regexp_extract("value", r"^(\d+) ", 1).cast("long").alias("doc_id"), F.octet_length("value").alias("bytes"))


@query("sink_arrays", "SELECT doc_id, source, text, n_chars FROM documents")
def sink_arrays(spark, d):
    """Array shards, committed together and read back."""
    path = fresh_path(spark, "arrays")
    arrays.write_arrays(inputs.table(spark, d, "documents").select("doc_id", "source", "text", "n_chars"), path, shard_bytes=1 << 20)
    return rd.read_json(spark, "doc_id bigint, source string, text string, n_chars bigint", folder=path)


@query("pack_point_access", f"""
WITH {_PACKS} SELECT source, pack, {sql.text('input_ids')} AS input_ids, {sql.text('lens')} AS lens FROM packs
WHERE (source = 's1' AND pack BETWEEN 2 AND 6) OR (source = 's2' AND pack >= 9)""")
def pack_point_access(spark, d):
    """Packs 2 to 6 of one source and all from 9 on of another, read from the files that hold them."""
    path = fresh_path(spark, "packs")
    packs = stage(pk.pack_range(sourced_samples(spark, d), L), "packs")
    packfiles.write_packs(packs, path, file_tokens=1 << 14, step=4)
    found = packfiles.read_packs(spark, path, [("s1", 2, 6), ("s2", 9, 1 << 62)])
    c = F.col("cumulative_len")
    lens = F.zip_with(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, F.lit(1), F.size(c) - 1), lambda b, a: b - a)
    return found.select("source", "pack", joined("input_ids").alias("input_ids"), joined(lens).alias("lens"))


@query("pack_null_source", f"""
WITH {SOURCED}, named AS (SELECT sample_id, num_tokens, CASE WHEN sample_id % 3 <> 1 THEN source END AS source FROM src), {_fragments('named', L)},
fit AS (SELECT coalesce(source, 'null') AS source, count(DISTINCT pack) AS n_packs, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(skip) AS BIGINT) AS skipped
        FROM frag WHERE pack < full_packs GROUP BY 1)
SELECT * FROM fit""")
def pack_null_source(spark, d):
    """A third of the samples has no source: they are packed like those of a source of their own."""
    s = sourced_samples(spark, d).withColumn("source", F.when(F.col("sample_id") % 3 != 1, F.col("source")))
    plan = pk.range_plan(s, L)
    return plan.groupBy(F.coalesce("source", F.lit("null")).alias("source")).agg(
        F.countDistinct("pack").alias("n_packs"), F.sum("n").alias("n_tokens"), F.sum("skip").alias("skipped"))
