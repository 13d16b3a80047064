"""Shuffled shards by a two-pass external shuffle.

Pass one scatters the records uniformly, by seeded hashes, into buckets that fit in memory; pass two shuffles each bucket
(Fisher-Yates with a generator seeded by the bucket) and writes it.  The buckets of a shard, one after the other, are the
shard in random order.

A record's shard follows from its doc_id and the number of shards alone: the hash of the id draws an increasing row of
shard numbers, and the record stays in the last one below the number of shards.  With one more shard a record either stays
or moves to the new shard.  Within its shard a record's bucket follows from another hash, of id and text, among as many
buckets as the shard's bytes ask for, so that rows of one id (null, say) spread over the buckets of their shard.

Null ids hash like any other value.  Rows are ordered by id and text before the shuffle, so reruns agree; repeated rows take
slots of their own.  A null text has no bytes.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.llm.common import fresh_path, stage

SHARDS = 40
BUCKET_BYTES = 16 << 20
# Buckets at most, so that their table always fits on an executor; beyond it buckets grow with the input.
MAX_BUCKETS = 1 << 18
MAX_TASKS = 1 << 14
ROW_BYTES = 16
SEED = 7
# Draws of a record; the number after so many is above any number of shards in use.
DRAWS = 64


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def placement(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """``struct(at, next)``: the record's shard, and the next number in its row (the shard it moves to, once that exists)."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))

    def draw(acc: Column, k: Column) -> Column:
        unit = (F.pmod(F.xxhash64(key, F.lit(seed), k), F.lit(1 << 53)) + 1).cast("double") / float(1 << 53)
        at = acc["next"]
        return F.when(at < shards, F.struct(at.alias("at"), F.floor((at + 1) / unit).cast("long").alias("next"))).otherwise(acc)

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(DRAWS - 1)), start, draw)


def fisher_yates(n: int, rng: np.random.Generator) -> list[int]:
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist() if n > 1 else (), strict=True):
        order[i], order[j] = order[j], order[i]
    return order


def shuffle(documents: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """Write all rows, shuffled, as Parquet, and read them back: ``rec`` (the row), ``shard``, ``slot``, ``grown_shard``.

    ``slot`` counts from 0 without gaps within each shard; files hold whole buckets in slot order.
    """
    spark = documents.sparkSession
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("rec")).withColumn("place", placement(F.col("rec.doc_id"), shards, seed))
    rows = rows.select("rec", F.col("place.at").cast("int").alias("shard"),
                       F.when(F.col("place.next") == shards, F.lit(shards)).otherwise(F.col("place.at")).cast("int").alias("grown_shard"),
                       F.pmod(F.xxhash64(F.lit("bucket"), F.lit(seed), F.coalesce(F.col("rec.doc_id").cast("string"), F.lit("null")), F.col("rec.text")),
                              F.lit(1 << 40)).alias("draw"))
    sizes = stage(rows.select("shard", "draw", size_of(F.col("rec.text")).alias("size")), "shard-sizes")
    # One number per shard: its bytes.
    held = {r["shard"]: r["b"] for r in sizes.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    bucket_bytes = max(bucket_bytes, -(-sum(held.values()) // MAX_BUCKETS), 1)
    buckets = [max(1, -(-held.get(s, 0) // bucket_bytes)) for s in range(shards)]
    firsts = np.cumsum([0, *buckets]).tolist()
    bucket = (F.element_at(F.lit(firsts[:-1]), F.col("shard") + 1) + F.pmod(F.col("draw"), F.element_at(F.lit(buckets), F.col("shard") + 1))).cast("long")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sizes.withColumn("bucket", bucket).groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "shard-buckets")
    # At most MAX_BUCKETS rows by construction.
    scattered = rows.withColumn("bucket", bucket).join(F.broadcast(starts), "bucket")
    tasks = min(firsts[-1], MAX_TASKS)
    task = F.expr(f"bucket * {tasks} div {firsts[-1]}").cast("int")
    ready = scattered.withColumn("tie", F.xxhash64("rec.text")).repartitionById(tasks, task).sortWithinPartitions("bucket", "rec.doc_id", "tie").select(
        "rec", "shard", "grown_shard", "bucket", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def flush() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            order = fisher_yates(whole.num_rows, np.random.default_rng([seed, current]))
            first = whole["first"][0].as_py()
            # Short takes, so that the texts of the bucket are not held twice.
            for at in range(0, len(order), 512):
                part = whole.take(pa.array(order[at:at + 512]))
                slot = pa.array(np.arange(first + at, first + at + part.num_rows))
                table = pa.table([part["rec"], part["shard"], slot, part["grown_shard"]], ["rec", "shard", "slot", "grown_shard"])
                yield from table.combine_chunks().to_batches()

        for batch in batches:
            keys = batch["bucket"].to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if current is not None and keys[a] != current:
                    yield from flush()
                    held = []
                current = int(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    fields = ready.select("rec", "shard", F.lit(0).cast("long").alias("slot"), "grown_shard").schema
    path = folder or fresh_path(spark, "shards")
    ready.mapInArrow(run, fields).write.parquet(path)
    return spark.read.schema(fields).parquet(path)
