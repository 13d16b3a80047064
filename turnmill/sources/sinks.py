"""Sinks: encoded corpora, train / validation lines with offsets, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators.order import int_div, running


def write_corpus(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def train_valid(lines: DataFrame, *, file: str, order: list[str], bucket: Column, line: str = "line",
                tokens: str = "num_tokens", every: int = 100, keep_above: int = 500,
                disjoint: bool = False) -> DataFrame:
    """Lines with ``split``, ``offset`` (bytes before the line in its split's file) and ``num_tokens``.

    Every ``every``-th line of a file also goes to its validation file, which is kept only with more
    than ``keep_above`` lines.  ``disjoint`` takes those lines out of training.
    """
    size = F.octet_length(line) + 1
    numbered = running(lines, order=order, keys=[file], bucket=bucket, index="_i", totals={"_n": "_i"},
                       sums={"_train": size})
    picked = ((F.col("_i") + 1) % every == 0) & (F.floor(F.col("_n") / every) > keep_above)
    valid = running(numbered.where(picked), order=order, keys=[file], bucket=bucket, sums={"_valid": size})
    if disjoint:
        train = running(numbered.where(~picked).drop("_train"), order=order, keys=[file], bucket=bucket,
                        sums={"_train": size})
    else:
        train = numbered
    keep = [c for c in lines.columns]
    return (train.select(*keep, F.lit("train").alias("split"), F.col("_train").alias("offset"))
            .unionByName(valid.select(*keep, F.lit("valid").alias("split"), F.col("_valid").alias("offset"))))


def split_totals(parts: DataFrame, *, by: list[str], tokens: str = "num_tokens") -> DataFrame:
    return parts.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(tokens).alias("n_tokens"))


# A file of lines is cut in parts of about this many bytes, each written by one task.
PART_BYTES = 64 << 20


def write_lines(parts: DataFrame, path: str, *, file: str, line: str = "line", part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the lines of ``train_valid`` and their meta; returns the meta table.

    Lines lie in ``<path>/lines/split=../<file>=../part=../``, one file per part, in the order of their offsets.
    ``<path>/meta`` has every row but its line: ``part``, ``path`` of the part's file, and ``offset`` and ``bytes``
    (line feed included) of the line in that file.  A line never spans parts.  Lines must not hold a line feed.
    """
    spark = parts.sparkSession
    keys = ["split", file, "part"]
    keyed = parts.withColumn("part", int_div("offset", part_bytes)).withColumn("bytes", (F.octet_length(line) + 1).cast("long"))
    # One task holds all rows of a part and writes them as sorted, so a folder gets one file.
    ordered = keyed.repartition(*keys).sortWithinPartitions(*keys, "offset")
    ordered.select(*keys, F.col(line).alias("value")).write.partitionBy(*keys).text(f"{path}/lines")
    written = spark.read.schema(f"value string, split string, `{file}` string, part long").text(f"{path}/lines")
    names = written.select(*keys, F.col("_metadata.file_path").alias("path")).distinct()
    begins = keyed.groupBy(*keys).agg(F.min("offset").alias("_begin"))
    meta = keyed.drop(line).join(begins, keys).withColumn("offset", F.col("offset") - F.col("_begin")).drop("_begin").join(names, keys)
    meta.write.parquet(f"{path}/meta")
    return spark.read.schema(meta.schema).parquet(f"{path}/meta")


def read_at(meta: DataFrame, line: str = "line") -> DataFrame:
    """The rows of a meta table with their lines, each read at its offset; a task opens a file once."""
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        name, stream = None, None
        for batch in batches:
            lines = []
            for path, offset, size in zip(*(batch[c].to_pylist() for c in ("path", "offset", "bytes")), strict=True):
                if path != name:
                    store, inner = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                    name, stream = path, store.open_input_file(inner)
                stream.seek(offset)
                data = stream.read(size)
                if not data.endswith(b"\n"):
                    raise ValueError(f"{path}: no line of {size} bytes at {offset}")
                lines.append(data[:-1].decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.string())], [*batch.schema.names, line])

    schema = meta.withColumn(line, F.lit("")).schema
    return meta.repartition("path").sortWithinPartitions("path", "offset").mapInArrow(run, schema)
