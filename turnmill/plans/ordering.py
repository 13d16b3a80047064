"""Queries: total orders, sampling, mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import order as od
from turnmill.plans import inputs, sql
from turnmill.plans.registry import query

_DOCS = f"docs AS (SELECT doc_id, source, lang, {sql.n_words('text')} AS num_tokens FROM documents)"


def _docs(spark, d):
    return inputs.document_lengths(spark, d).withColumnRenamed("sample_id", "doc_id")


@query("global_prefix_sum", f"""
WITH {_DOCS}
SELECT doc_id, num_tokens, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
       CAST(coalesce(sum(num_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset
FROM docs""")
def global_prefix_sum(spark, d):
    return od.running(_docs(spark, d).select("doc_id", "num_tokens"), order=["doc_id"], bucket=od.chunk_bucket("doc_id"),
                      index="idx", sums={"token_offset": F.col("num_tokens")})


@query("seeded_shuffle", "\nUNION ALL\n".join(
    f"SELECT {e} AS epoch, doc_id, row_number() OVER (ORDER BY {sql.key('doc_id', epoch=e)}, doc_id) - 1 AS idx FROM documents"
    for e in (0, 1)))
def seeded_shuffle(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id")
    parts = [od.shuffled(docs, "doc_id", epoch=e).select(F.lit(e).alias("epoch"), "doc_id", "idx") for e in (0, 1)]
    return parts[0].unionByName(parts[1])


@query("sample_exact", f"SELECT doc_id, source FROM documents ORDER BY {sql.key('doc_id')}, doc_id LIMIT 100")
def sample_exact(spark, d):
    return od.sample_exact(inputs.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


def _ratio_sql(ratio: str, part: str) -> str:
    return f"""
WITH p AS (SELECT doc_id, source, {ratio} AS r, row_number() OVER ({part} ORDER BY {sql.key('doc_id')}, doc_id) - 1 AS pos,
             count(*) OVER ({part or 'ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING'}) AS n FROM documents),
c AS (SELECT doc_id, source, CAST(floor(r) + CASE WHEN pos < floor(n * r) - n * floor(r) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM p)
SELECT doc_id, source, unnest(range(copies)) AS copy FROM c WHERE copies > 0"""


@query("sample_ratio", _ratio_sql("CAST(2.5 AS DOUBLE)", ""))
def sample_ratio(spark, d):
    return od.sample_ratio(inputs.table(spark, d, "documents").select("doc_id", "source"), "doc_id", 2.5)


_RATIOS = {"src0": 0.5, "src1": 2.25, "src2": 3.0, "src3": 0.1}


@query("source_repeat", _ratio_sql("CASE " + " ".join(
    f"WHEN source = '{s}' THEN CAST({r} AS DOUBLE)" for s, r in _RATIOS.items()) + " ELSE CAST(1 AS DOUBLE) END", "PARTITION BY source"))
def source_repeat(spark, d):
    return od.sample_ratio(inputs.table(spark, d, "documents").select("doc_id", "source"), "doc_id", _RATIOS, key="source")


@query("sample_replace", f"""
WITH n AS (SELECT count(*) AS n FROM documents),
draws AS (SELECT i AS draw, CAST('0x' || substr(md5('1024:draw:' || i), 1, 15) AS BIGINT) % n AS pos
          FROM n, unnest(range(CAST(floor(n * 0.3) AS BIGINT))) t(i)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY {sql.key('doc_id')}, doc_id) - 1 AS pos FROM documents)
SELECT draw, doc_id FROM draws JOIN p USING (pos)""")
def sample_replace(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id")
    return od.sample_with_replacement(docs, "doc_id", 0.3, rows=docs.count())


@query("mix_union", """
SELECT 'documents' AS source, doc_id AS sample_id, text, lang FROM documents
UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text, NULL FROM conversations
UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark""")
def mix_union(spark, d):
    t = lambda n: inputs.table(spark, d, n)
    return od.mix({
        "documents": t("documents").select(F.col("doc_id").alias("sample_id"), "text", "lang"),
        "conversations": t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), "text"),
        "benchmark": t("benchmark").select(F.col("item_id").alias("sample_id"), "text")})


@query("dedup_split", """
SELECT doc_id, md5(text) AS text_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) - 1 AS dup FROM documents""")
def dedup_split(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_id"))
    return od.dedup_split(docs, "text_id", "doc_id", od.chunk_bucket("doc_id"))


@query("replay_epochs", "SELECT epoch, conv_id, turn FROM conversations, unnest(range(3)) t(epoch)")
def replay_epochs(spark, d):
    from turnmill.streaming.stream import replay
    return replay(inputs.table(spark, d, "conversations").select("conv_id", "turn"), 3)
