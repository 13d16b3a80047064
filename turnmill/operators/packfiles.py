"""Packs in order on disk, with a sparse index, so that a few packs are read without a scan of all.

Packs are range-sorted by (source, pack) into files of about equal tokens.  The index has one row per file: its first and last
pack, by source.  A reader of packs a to b looks up the files whose range meets a to b, and opens only them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.order import chunk_bucket, int_div, join_keys, running
from turnmill.session import if_small, stage

# Tokens of a file, and packs between two keys of the order from which files are cut.
FILE_TOKENS = 16 << 20
STEP = 1024


def write_packs(packs: DataFrame, path: str, *, source: str = "source", pack: str = "pack", ids: str = "input_ids",
                file_tokens: int = FILE_TOKENS, step: int = STEP) -> DataFrame:
    """Write ``packs`` (staged) below ``path/packs`` and the index to ``path/index``; returns the index.

    ``(source, pack)`` is unique.  Files are cut by running token totals of narrow rows, one per ``step`` packs of a source,
    so that no file spans sources and a source of any size is cut in many files.  The index is
    ``(file, source, first_pack, last_pack, n_packs, n_tokens)``.
    """
    groups = packs.groupBy(source, int_div(pack, step).alias("_step")).agg(F.sum(F.size(ids)).cast("long").alias("_tokens"))
    placed = running(groups, order=["_step"], keys=[source], bucket=chunk_bucket("_step"), sums={"_before": F.col("_tokens")})
    cells = stage(placed.select(source, "_step", int_div("_before", file_tokens).alias("_cell")), "pack-cells")
    name = F.concat_ws("-", F.lower(F.hex(F.xxhash64(F.struct(source)))), "_cell").alias("file")
    of = stage(cells.select(source, "_step", name), "pack-files")
    keyed = join_keys(packs.withColumn("_step", int_div(pack, step)), if_small(of), [source, "_step"]).drop("_step")
    tasks = max(min(of.select("file").distinct().count(), 1 << 16), 1)
    # All packs of a file are written by one task, so its folder holds one file.
    keyed.repartition(tasks, "file").sortWithinPartitions("file", pack).write.partitionBy("file").parquet(f"{path}/packs")
    back = packs.sparkSession.read.parquet(f"{path}/packs")
    index = back.groupBy("file", source).agg(F.min(pack).alias("first_pack"), F.max(pack).alias("last_pack"), F.count(F.lit(1)).alias("n_packs"),
                                                F.sum(F.size(ids)).cast("long").alias("n_tokens"))
    index.write.parquet(f"{path}/index")
    return packs.sparkSession.read.schema(index.schema).parquet(f"{path}/index")


def read_packs(spark: SparkSession, path: str, wanted: Sequence[tuple[str | None, int, int]], *, source: str = "source",
               pack: str = "pack", schema: str | None = None) -> DataFrame:
    """The packs ``first .. last`` (both included) of each ``(source, first, last)`` in ``wanted``, with all their columns.

    The index is filtered first; the scan is then given the folders of the files that can hold the packs, and no others.
    """
    index = spark.read.parquet(f"{path}/index")
    inside, rows = F.lit(False), F.lit(False)
    for name, first, last in wanted:
        same = F.col(source).eqNullSafe(F.lit(name))
        inside = inside | (same & (F.col("last_pack") >= first) & (F.col("first_pack") <= last))
        rows = rows | (same & F.col(pack).between(first, last))
    # As many names as files are asked for.
    files = sorted(r["file"] for r in index.where(inside).select("file").distinct().collect())
    reader = spark.read.schema(schema) if schema else spark.read
    if not files:
        return reader.parquet(f"{path}/packs").where(F.lit(False)).drop("file")
    found = reader.option("basePath", f"{path}/packs").parquet(*[f"{path}/packs/file={n}" for n in files])
    return found.where(rows).drop("file")
