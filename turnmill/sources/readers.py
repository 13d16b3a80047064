"""Sources: JSON, JSON lines, message lines, signed tokens, tables; file manifests and content keys."""

from __future__ import annotations

import re

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.formats import normalise
from turnmill.operators.order import mix, running, sample_ratio, sample_with_replacement
from turnmill.session import if_small, stage


def _paths(files: Sequence[str] | str | None, folder: str | None) -> list[str]:
    if (files is None) == (folder is None):
        raise ValueError("give exactly one of files and folder")
    if folder is not None:
        return [folder]
    return [files] if isinstance(files, str) else list(files)


def read_json(spark: SparkSession, schema: str, *, files=None, folder: str | None = None,
              suffix: str = ".json") -> DataFrame:
    """Files that each hold one JSON array; a file is one task's work by nature of the format."""
    reader = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True)
    if folder is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.json(_paths(files, folder))


def read_jsonl(spark: SparkSession, schema: str, *, files=None, folder: str | None = None,
               suffix: str = ".jsonl") -> DataFrame:
    reader = spark.read.schema(schema).option("recursiveFileLookup", True)
    if folder is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.json(_paths(files, folder))


def read_by_extension(spark: SparkSession, schema: str, path: str) -> DataFrame:
    if path.endswith(".jsonl"):
        return read_jsonl(spark, schema, files=path)
    if path.endswith(".json"):
        return read_json(spark, schema, files=path)
    raise ValueError(f"{path}: expected .json or .jsonl")


def read_checked(spark: SparkSession, schema: str, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines split in (good rows, broken lines); nothing is lost and nothing fails the job."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").json(path)
    return (rows.where(F.col("_corrupt").isNull()).drop("_corrupt"),
            rows.where(F.col("_corrupt").isNotNull()).select(*rows.columns))


def read_tsv(spark: SparkSession, schema: str, path: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def mcq_split(df: DataFrame) -> str:
    """A multiple-choice table is a dev split exactly when it has answers."""
    return "dev" if "answer" in df.columns else "test"


def select_split(df: DataFrame, split: str | None, column: str = "split") -> DataFrame:
    """One split, or all of them; on a partitioned table the filter prunes folders."""
    return df if split is None else df.where(F.col(column) == split)


def per_path(value, n: int, name: str) -> list:
    """One value for all paths, or one per path."""
    values = list(value) if isinstance(value, (list, tuple)) else [value] * n
    if len(values) != n:
        raise ValueError(f"{name}: {len(values)} values for {n} paths")
    return values


def read_many(spark: SparkSession, schema: str, paths: Sequence[str], *, id_col: str, pattern: str | None = None,
              suffixes: Sequence[str] = (".jsonl", ".json"), ratios: float | Sequence[float] = 1.0,
              formats: str | None | Sequence[str | None] = None, replacement: bool = False,
              max_length: int | None = None, length: Callable[[], Column] | None = None) -> DataFrame:
    """Folders searched recursively by suffix or pattern, each with its ratio and format, as one corpus.

    Raises where a path matches no file.
    """
    ratios = per_path(ratios, len(paths), "ratios")
    formats = per_path(formats, len(paths), "formats")
    parts = {}
    for path, ratio, fmt in zip(paths, ratios, formats):
        found = list_files(spark, path, pattern, suffixes)
        if found.isEmpty():
            raise ValueError(f"{path}: no matching file")
        part = spark.read.schema(schema).option("recursiveFileLookup", True).json(path)
        name = F.col("_metadata.file_path")
        part = part.where(name.rlike(pattern) if pattern else _any_suffix(name, suffixes))
        if length is not None and max_length is not None:
            part = part.where(length() < max_length)
        if ratio != 1.0:
            part = (sample_with_replacement(part, id_col, ratio, rows=part.count()) if replacement
                    else sample_ratio(part, id_col, ratio))
        part = part.drop("draw", "copy")
        parts[path] = normalise(part, fmt) if fmt else part
    return mix(parts, source="path")


def _any_suffix(name: Column, suffixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | name.endswith(s)
    return hit


def list_files(spark: SparkSession, folder: str, pattern: str | None = None,
               suffixes: Sequence[str] | None = None) -> DataFrame:
    """``(path, length)`` of the files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    if pattern:
        return files.where(F.col("path").rlike(pattern))
    return files.where(_any_suffix(F.col("path"), suffixes)) if suffixes else files


def manifest(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """``(rel_path, sort_key)``: depth first, files before folders, both by name."""
    files = list_files(spark, folder, suffixes=[suffix] if suffix else None)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.col("path"), F.lit(r"^(file:)?/*" + _quote(root) + "/"), F.lit(""))
    parts = F.split(rel, "/")
    level = F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), p))
    return files.select(rel.alias("rel_path"), F.array_join(level, "\x01").alias("sort_key"))


def _quote(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in text)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, block, line, value)``: text lines with an order that no split of the files changes.

    ``block`` is the byte at which the line's split starts and ``line`` rises inside a split.  Of a line that ends in
    CR LF, ``value`` keeps the CR.
    """
    # Only a line feed ends a line; a carriage return before it stays in ``value`` and counts.
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       line.alias("line"), "value")


def number_lines(lines: DataFrame) -> DataFrame:
    """Adds ``line_no`` and ``offset`` (bytes before the line) per file; a bucket is one file split."""
    placed = running(lines, order=["block", "line"], keys=["file"], bucket=F.col("block"), index="line_no",
                     sums={"offset": F.octet_length("value") + 1})
    return placed.drop("block", "line")


def read_message_lines(spark: SparkSession, path: str) -> DataFrame:
    """Each line is a message array: ``(file, line_no, messages)``; empty lines are left out."""
    message = "array<struct<role:string,content:string,name:string,type:string,loss:boolean>>"
    lines = number_lines(read_lines(spark, path)).where(F.trim("value") != "")
    return lines.select("file", "line_no", F.from_json("value", message).alias("messages"))


def read_signed(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """Signed-token lines: ``(file, block, line, tokens, length)``; rows below ``min_length`` tokens are left out.

    Ordered by file, block and line, the rows stand as in the folder, whatever the splits.
    """
    rows = spark.read.schema("tokens array<int>").option("recursiveFileLookup", True).json(path)
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line"),
                       "tokens", F.size("tokens").alias("length"))
    return rows.where(F.col("length") >= min_length) if min_length > 0 else rows


BLOCK_BYTES = 1 << 20


def content_keys(spark: SparkSession, folder: str, fn_version: str, suffix: str = "") -> DataFrame:
    """``(path, file_key, cache_key)``: a key of the bytes, joined with the encoder's version.

    One rule for files of every size: a file is read in blocks of ``BLOCK_BYTES``, so no row holds more, and its
    key is the sha256 over the sha256 texts of its blocks in order.  Equal bytes have equal keys whatever their
    path or time.  Spark does not list empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if suffix:
        files = files.where(F.col("path").endswith(suffix))
    blocks = file_blocks(files.select("path", "length"))
    hashed = blocks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "sha"))), lambda b: b["sha"]).alias("shas"))
    keys = hashed.select("path", F.sha2(F.array_join("shas", ""), 256).alias("file_key"))
    return keys.withColumn("cache_key", F.concat_ws("/", "file_key", F.sha2(F.lit(fn_version), 256)))


def file_blocks(files: DataFrame) -> DataFrame:
    """``(path, block, sha)`` of every ``BLOCK_BYTES`` of the files, one short read per row.

    ``files`` is (path, length); blocks of a file are spread over the tasks.
    """
    parts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(
        F.ceil(F.col("length") / BLOCK_BYTES) - 1, F.lit(0)).cast("long"))).alias("block"))

    def read(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs
        for batch in batches:
            shas = []
            for path, block in zip(batch["path"].to_pylist(), batch["block"].to_pylist(), strict=True):
                store, inner = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
                with store.open_input_file(inner) as f:
                    f.seek(block * BLOCK_BYTES)
                    shas.append(hashlib.sha256(f.read(BLOCK_BYTES)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["block"], pa.array(shas, pa.string())], ["path", "block", "sha"])

    return parts.repartition("path", "block").mapInArrow(read, "path string, block long, sha string")


def not_done(keys: DataFrame, done: DataFrame, on: str = "cache_key") -> DataFrame:
    return keys.join(done.select(on), on, "left_anti")


# Files below a cut of the path tree, and the most rounds in which cuts are moved down.
CUT_FILES = 8192
CUT_ROUNDS = 64


def path_cuts(files: DataFrame, bound: int = CUT_FILES) -> DataFrame:
    """``files`` (sort_key) with ``cut``: a beginning of the key that so few files share that they may be sorted together.

    Every file starts at its top folder.  Where more than ``bound`` files share a cut, all of theirs move one level down; below
    the last folder they move on through the file name, two letters at a time.  Cuts stand in the order of the keys.
    """
    at = F.instr(F.col("sort_key"), "\x01")
    placed = stage(files.withColumn("_cut", F.when(at > 0, at).otherwise(F.least(F.lit(3), F.length("sort_key")))), "path-cuts")
    for _ in range(CUT_ROUNDS):
        cut = F.substring(F.col("sort_key"), F.lit(1), F.col("_cut"))
        sizes = placed.groupBy(cut.alias("_head")).agg(F.count(F.lit(1)).alias("_n"), F.max(F.length("sort_key") > F.col("_cut")).alias("_deeper"))
        heavy = stage(sizes.where((F.col("_n") > bound) & F.col("_deeper")).select("_head"), "path-heavy")
        if heavy.isEmpty():
            break
        further = F.call_function("locate", F.lit("\x01"), F.col("sort_key"), F.col("_cut") + 1)
        moved = F.least(F.when(further > 0, further).otherwise(F.col("_cut") + 2), F.length("sort_key"))
        marked = placed.join(if_small(heavy.withColumn("_heavy", F.lit(True))), cut == F.col("_head"), "left")
        placed = stage(marked.withColumn("_cut", F.when(F.col("_heavy"), moved).otherwise(F.col("_cut"))).drop("_head", "_heavy"), "path-cuts")
    return placed.withColumn("cut", F.substring(F.col("sort_key"), F.lit(1), F.col("_cut"))).drop("_cut")


def ordered_files(files: DataFrame, bound: int = CUT_FILES) -> DataFrame:
    """``files`` (rel_path, sort_key) with ``file_no``, their place in the order of ``sort_key``.

    A folder with a third of all files is cut below itself, so no task sorts it whole.
    """
    cuts = path_cuts(files, bound)
    # One row per cut.
    tops = stage(cuts.select(F.col("cut").alias("top")).distinct(), "path-tops")
    numbers = stage(running(tops, order=["top"], bucket=F.lit(0), index="_no"), "path-numbers")
    placed = cuts.join(if_small(numbers), F.col("cut") == F.col("top"))
    return running(placed, order=["sort_key"], bucket=F.col("_no"), index="file_no").select(*files.columns, "file_no")


def sort_key_of(rel_path: Column) -> Column:
    """The key of a relative path: depth first, files before folders, both by name."""
    level = F.transform(F.split(rel_path, "/"), lambda p, i: F.concat(F.when(i == F.size(F.split(rel_path, "/")) - 1, F.lit("0")).otherwise(F.lit("1")), p))
    return F.array_join(level, "\x01")
