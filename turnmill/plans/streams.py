"""Queries: the streaming forms, run over what the tables hold and compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder, joined
from turnmill.plans import inputs, sql
from turnmill.plans.registry import query
from turnmill.session import fresh_path
from turnmill.streaming import epochs, packing
from turnmill.streaming import stream as st

_SCHEMA = "sample_id bigint, messages array<struct<role:string,content:string>>"


def _stream_encoded(spark, d, max_length):
    """Conversations land as JSON files; the stream encodes whole records and writes Parquet."""
    src, out, ck = (fresh_path(spark, n) for n in ("stream-in", "stream-out", "stream-ck"))
    inputs.message_lists(spark, d).write.json(src)
    coded = st.encode_stream(st.line_stream(spark, src, _SCHEMA, max_files=2), "openai", "qwen_chat", max_length=max_length)
    st.run_available(coded.select("sample_id", "input_ids", "labels", "num_tokens"), out, ck)
    return spark.read.schema("sample_id bigint, input_ids array<int>, labels array<int>, num_tokens int").parquet(out)


@query("stream_encode", f"WITH {sql.samples(256)} SELECT sample_id, num_tokens, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels "
       "FROM samples WHERE len(list_filter(labels, lambda x: x >= 0)) > 0")
def stream_encode(spark, d):
    return _stream_encoded(spark, d, 256).select(
        "sample_id", F.col("num_tokens").cast("long").alias("num_tokens"), joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("stream_pack", f"""
WITH {sql.samples(512)}, t AS (SELECT 's' || (sample_id % 3) AS source, sum(num_tokens) AS n, sum(len(list_filter(labels, lambda x: x >= 0))) AS s
  FROM samples WHERE len(list_filter(labels, lambda x: x >= 0)) > 0 GROUP BY 1)
SELECT source, CAST(n // 128 AS BIGINT) AS n_packs, CAST(n // 128 * 128 AS BIGINT) AS n_tokens FROM t""")
def stream_pack(spark, d):
    """Residual packer per source; which sample meets which is the stream's order, the counts are not."""
    src, out, ck = (fresh_path(spark, n) for n in ("pack-in", "pack-out", "pack-ck"))
    coded = _stream_encoded(spark, d, 512).withColumn("source", F.concat(F.lit("s"), (F.col("sample_id") % 3).cast("string")))
    coded.select("source", "input_ids", "labels", F.lit(False).alias("flush")).write.parquet(src)
    rows = spark.readStream.schema("source string, input_ids array<int>, labels array<int>, flush boolean").option("maxFilesPerTrigger", 2).parquet(src)
    st.run_available(st.pack_stream(rows, 128), out, ck)
    packs = spark.read.schema(f"source string, {st.PACK}").parquet(out)
    return packs.groupBy("source").agg(F.count(F.lit(1)).alias("n_packs"), F.sum(F.size("input_ids")).alias("n_tokens"))


@query("stream_pack_state", f"""
WITH t AS (SELECT doc_id, source, {sql.ids('text')} AS ids FROM documents),
a AS (SELECT source, flatten(list(ids ORDER BY doc_id)) AS ids FROM t GROUP BY source),
p AS (SELECT source, ids, unnest(range(len(ids) // 512)) AS pack FROM a)
SELECT source, pack, {sql.text('ids[pack * 512 + 1 : pack * 512 + 512]')} AS input_ids FROM p""")
def stream_pack_state(spark, d):
    """Lines in files by source, streamed in bounded batches and packed on keyed state: token by token one pass in document order."""
    src, out, ck = (fresh_path(spark, n) for n in ("state-in", "state-out", "state-ck"))
    docs = inputs.table(spark, d, "documents").select("source", "doc_id", F.to_json(F.struct("doc_id", "text")).alias("value"))
    # Sorted as a whole, so that the files of a source follow each other by name and a large source is many files.
    ordered = docs.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    ordered.select(F.col("source").alias("folder"), "value").write.partitionBy("folder").text(src)
    size = sum(n for _, n in epochs.listing(src, ".txt"))
    lines = epochs.epoch_stream(spark, src, ck, suffix=".txt", max_bytes=max(min(size // 3 + 1, epochs.MAX_BYTES), 1))
    ids = HashEncoder().ids(F.get_json_object("value", "$.text"))
    rows = lines.select(F.regexp_extract("file", "folder=([^/]+)/", 1).alias("source"), ids.alias("input_ids"), ids.alias("labels"), "file", "offset")
    epochs.run_epochs(packing.pack_state(rows, 512, order=["file", "offset"]), out, ck)
    return spark.read.schema(f"source string, {st.PACK}").parquet(out).select("source", "pack", joined("input_ids").alias("input_ids"))
