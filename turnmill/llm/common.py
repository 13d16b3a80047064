"""Helpers of the training-data operators: worker state, shared files, exact range cuts, committed outputs."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.session import fresh_path, stage

# A table goes to every executor only when its measured size is below this; every such join has a shuffled form as well.
BROADCAST_ROWS = 1 << 20
# At most so many range cuts are held by the driver, whatever the input; the ranges grow beyond that.
MAX_CUTS = 1 << 14
SLICE = 256

__all__ = ["fresh_path", "stage"]


def read_only_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: extra columns of the input, whatever they are called, never meet the operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, so that caches survive from task to task."""
    return sys.modules.setdefault("_turnmill_worker", types.ModuleType("_turnmill_worker")).__dict__


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into short ones, so that only few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def file_system(uri: str):
    """``(file system, path)`` of a folder that driver and executors share.

    A plain path is a mounted folder: where the session's file system is another one, ``session.shared_dir`` names it in full.
    """
    from pyarrow import fs
    uri = re.sub("^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` (a staged table), marked for broadcast if its measured number of rows allows that."""
    limit = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.count() <= limit else df


NULL_KEY = -(1 << 63)


def range_cuts(weights: DataFrame, key: str, weight: str, target: int, tie: str | None = None) -> list[tuple[int, int]]:
    """First (key, tie) of consecutive ranges of about ``target`` weight each; the first range has no entry.

    Exact prefix sums of the weights along key and ``tie`` (a hash of the row's content; none: 0), so the cuts depend on the
    data alone and not on partitions.  Null keys come first.  A key that many rows share spans ranges; rows with equal key
    and tie stay together.  The driver gets at most ``MAX_CUTS`` pairs of numbers.
    """
    rows = weights.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"),
                          (F.lit(0) if tie is None else F.col(tie)).cast("long").alias("t"), F.col(weight).cast("long").alias("w"))
    placed = stage(rows.repartitionByRange(F.col("k"), F.col("t")).withColumn("part", F.spark_partition_id()), "cuts")
    total = placed.agg(F.sum("w")).first()[0] or 0
    target = max(target, -(-total // MAX_CUTS), 1)
    # One row per partition of the range sort.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("part").agg(F.sum("w").alias("w")).select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("off"))
    upto = F.sum("w").over(Window.partitionBy("part").orderBy("k", "t"))
    cell = F.floor((F.col("off") + upto - 1) / F.lit(target))
    cuts = placed.join(offsets, "part").select(F.struct("k", "t").alias("at"), cell.alias("cell")).groupBy("cell").agg(F.min("at").alias("at")).collect()
    return sorted((r["at"]["k"], r["at"]["t"]) for r in cuts)[1:]


def range_of(key: Column, cuts: list[tuple[int, int]], tie: Column | None = None) -> Column:
    """Index of the range that ``key`` (null: first) and ``tie`` fall in: a two-level search in literals, without a join or shuffle."""
    key = F.coalesce(key.cast("long"), F.lit(NULL_KEY))
    tie = F.lit(0).cast("long") if tie is None else tie
    if not cuts:
        return F.lit(0)

    def reached(part: Column, ties: Column, first: Column) -> Column:
        return F.size(F.filter(part, lambda c, i: (c < key) | ((c == key) & (F.get(ties, first + i) <= tie))))

    keys, ties = [c[0] for c in cuts], [c[1] for c in cuts]
    step = max(1, int(len(cuts) ** 0.5))
    if step < 4:
        return reached(F.lit(keys), F.lit(ties), F.lit(0))
    coarse = reached(F.lit(keys[step - 1::step]), F.lit(ties[step - 1::step]), F.lit(0)) * step
    return coarse + reached(F.slice(F.lit(keys), coarse + 1, F.lit(step)), F.lit(ties), coarse)


def by_range(df: DataFrame, shard: str, cuts: list[int], *order: str) -> DataFrame:
    """Rows dealt by range and sorted inside: one partition holds one range."""
    return df.repartitionById(len(cuts) + 1, F.col(shard)).sortWithinPartitions(shard, *order)


MANIFEST = "shard int, piece int, temp string, name string, records long, items long, bytes long, sha256 string"
MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("temp", pa.string()), ("name", pa.string()),
                            ("records", pa.int64()), ("items", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def commit(written: DataFrame, folder: str, label: str) -> DataFrame:
    """Give finished files their final names and return the manifest, staged.

    ``written`` has one row per file, made by the task attempt that finished; files of lost or repeated attempts have
    other temporary names and no row.  The rows are staged before any rename, and a rename that was done by an earlier
    attempt is recognised, so the job can be repeated at any point.  Readers go by the manifest alone.
    """
    rows = stage(written, f"{label}-written")

    def rename(batches):
        fs, root = file_system(folder)
        from pyarrow.fs import FileType
        for batch in batches:
            for temp, name in zip(batch["temp"].to_pylist(), batch["name"].to_pylist(), strict=True):
                if fs.get_file_info(f"{root}/{temp}").type != FileType.NotFound:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
                elif fs.get_file_info(f"{root}/{name}").type == FileType.NotFound:
                    raise FileNotFoundError(f"{root}/{name} is neither written nor committed")
            yield batch

    done = rows.repartition(max(1, min(64, rows.rdd.getNumPartitions()))).mapInArrow(rename, MANIFEST)
    return stage(done, f"{label}-manifest")


def dealt(manifest: DataFrame) -> DataFrame:
    """The manifest with one file per task, for reading the files back."""
    files = manifest.count()
    return manifest.repartition(max(1, min(files, 1 << 15)))


def about(df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the smallest hashes ``h`` of ``key``, about ``2 n`` of them (all, if there are no more).

    A bound on the hash, from the counted rows, is a filter that every task applies alone, so that a sample of ``n``
    rows taken from the result sends no more than about ``2 n`` rows to the driver, however many tasks there are.
    """
    hashed = df.withColumn("h", F.pmod(F.xxhash64(key), F.lit(1 << 32)))
    rows = df.count()
    return hashed if rows <= 2 * n else hashed.where(F.col("h") < int(2 * n / rows * (1 << 32)))


def learns(doc_id: str = "doc_id") -> Column:
    """Whether labels of a row may be learned: crc32 of the id's text modulo 4 is not 2 (null ids: never)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
