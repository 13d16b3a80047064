"""Many folders as one corpus by rules: one scan, one sample, whatever the number of folders.

A rule says what holds for the files below a path.  A file follows the rule with the longest path that contains it; it belongs to
no rule, and is left out, if that rule's pattern or suffixes do not match it.  Rules are matched once per file, not per row: a
file's ancestors meet the rules' paths in an equality join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.formats import format_names, normalise
from turnmill.operators.order import digits_for, md5_bucket, running, shuffle_key
from turnmill.session import if_small, stage


@dataclass(frozen=True)
class Rule:
    """``ratio`` r gives ``int(r n)`` of a rule's n rows, in whole copies and distinct extras, or as independent draws with
    ``replacement``.  ``fmt`` names the record format; ``pattern`` is searched in the whole path."""

    path: str
    ratio: float = 1.0
    fmt: str | None = None
    pattern: str | None = None
    max_length: int | None = None
    replacement: bool = False


RULE = "rule int, path string, ratio double, fmt string, pattern string, max_length long, replacement boolean"


def plain_path(path: Column) -> Column:
    """A path without scheme and host, as rules name it."""
    return F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?/*", "/")


def roots(rules: Sequence[Rule]) -> list[str]:
    """The paths of the rules that no other rule's path contains."""
    paths = {r.path.rstrip("/") for r in rules}

    def inside(path: str) -> bool:
        steps = path.split("/")
        return any("/".join(steps[:k]) in paths for k in range(1, len(steps)))
    return sorted(p for p in paths if not inside(p))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    import re
    plain = [re.sub(r"^[a-z0-9]+:(//[^/]*)?/*", "/", r.path.rstrip("/")) for r in rules]
    if len(set(plain)) < len(plain):
        raise ValueError("two rules for one path")
    bad = sorted({r.fmt for r in rules if r.fmt} - set(format_names()))
    if bad:
        raise ValueError(f"unknown formats: {', '.join(bad)}")
    return spark.createDataFrame([(i, p, float(r.ratio), r.fmt, r.pattern, r.max_length, r.replacement)
                                  for i, (p, r) in enumerate(zip(plain, rules, strict=True))], RULE)


def match_files(files: DataFrame, rules: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """``(file, rule)``: the rule of each file of ``files`` (file); files that theirs does not take are left out."""
    plain = plain_path(F.col("file"))
    steps = F.split(plain, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    near = files.select("file", F.explode(above).alias("path")).join(if_small(rules), "path")
    best = near.groupBy("file").agg(F.max_by(F.struct("rule", "pattern"), F.length("path")).alias("of")).select("file", "of.*")
    ending = F.lit(False)
    for s in suffixes:
        ending = ending | F.col("file").endswith(s)
    taken = F.when(F.col("pattern").isNull(), ending).otherwise(F.expr("file RLIKE pattern"))
    return best.where(taken).select("file", "rule")


def _sampled(rows: DataFrame, rules: DataFrame, id_col: str, seed: int) -> DataFrame:
    """One pass for all rules: ``int(n ratio)`` rows of each, from the place of a row in its rule's seeded order."""
    facts = rules.select("rule", "ratio", "replacement")
    keyed = rows.withColumn("_key", shuffle_key(id_col, seed=seed)).join(if_small(facts), "rule")
    placed = running(keyed, order=["_key", id_col], bucket=md5_bucket("_key", digits_for(rows)), keys=["rule"], index="_pos", totals={"_n": "_pos"})
    wanted = F.floor(F.col("_n") * F.col("ratio")).cast("long")
    once = F.floor("ratio").cast("long") + F.when(F.col("_pos") < wanted - F.floor("ratio").cast("long") * F.col("_n"), 1).otherwise(0)
    copies = placed.where(~F.col("replacement")).withColumn("_times", once)
    if not rules.where("replacement").isEmpty():
        # The draws of a rule fall on places by their numbers; each place is then used as often as it was hit.
        sizes = stage(placed.where("replacement").groupBy("rule").agg(F.max("_n").alias("_n"), F.max("ratio").alias("ratio")), "rule-sizes")
        blocks = sizes.select("rule", "_n", F.floor(F.col("_n") * F.col("ratio")).cast("long").alias("_draws"))
        # A row stands for at most 2^16 draws before they are told apart, so that no rule's draws are one task's work.
        parts = blocks.where("_draws > 0").select("rule", "_n", "_draws", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_draws - 1) div 65536"))).alias("_part"))
        draws = parts.repartition("rule", "_part").select("rule", "_n", F.explode(F.sequence(F.col("_part") * 65536, F.least(
            F.col("_part") * 65536 + 65535, F.col("_draws") - 1))).alias("_draw"))
        place = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:draw"), "rule", "_draw")), 1, 15), 16, 10).cast("long"), F.col("_n"))
        hits = draws.groupBy("rule", place.alias("_pos")).agg(F.count(F.lit(1)).alias("_times"))
        copies = copies.unionByName(placed.where("replacement").join(hits, ["rule", "_pos"]))
    return copies.where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1))).select(*rows.columns, "copy")


def read_by_rules(spark: SparkSession, schema: str, rules: Sequence[Rule], *, id_col: str, suffixes: Sequence[str] = (".jsonl", ".json"),
                  length: Callable[[], Column] | None = None, seed: int = 1024) -> DataFrame:
    """JSON-lines folders as one corpus: the columns of ``schema``, ``rule`` (its number) and ``copy``.

    Rows of at least ``max_length`` (by ``length``) go before the sample is taken.  Raises where a rule takes no file.
    """
    if any(r.max_length is not None for r in rules) and length is None:
        raise ValueError("max_length needs a length")
    table = stage(rule_table(spark, rules), "rules")
    tops = roots(rules)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tops).select(F.col("path").alias("file"))
    files = stage(match_files(listed, table, suffixes), "rule-files")
    idle = table.join(files, "rule", "left_anti").select("path").collect()  # at most one row per rule
    if idle:
        raise ValueError("no matching file: " + ", ".join(sorted(r["path"] for r in idle)))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(tops)
    names = rows.columns
    named = files.select(plain_path(F.col("file")).alias("_file"), "rule")
    rows = rows.withColumn("_file", plain_path(F.col("_metadata.file_path"))).join(if_small(named), "_file").select(*names, "rule")
    if any(r.max_length is not None for r in rules):
        caps = table.select("rule", "max_length")
        fits = F.col("max_length").isNull() | (length() < F.col("max_length"))
        rows = rows.join(if_small(caps), "rule").where(fits).select(*names, "rule")
    if all(r.ratio == 1.0 and not r.replacement for r in rules):
        return rows.withColumn("copy", F.lit(0).cast("long"))
    # The files are parsed once; places and copies are found on what is staged.
    return _sampled(stage(rows, "rule-rows"), table, id_col, seed)


def normalised(rows: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """``(*keep, rule, copy, conversation)``: the rows of ``read_by_rules`` in their rules' formats, one branch per format.

    Rows are staged once, so that several formats are not several scans of the files; rules without a format give no row.
    """
    formats = sorted({r.fmt for r in rules if r.fmt})
    staged = stage(rows, "rule-rows") if len(formats) > 1 else rows
    out = None
    for fmt in formats:
        part = normalise(staged.where(F.col("rule").isin([i for i, r in enumerate(rules) if r.fmt == fmt])), fmt)
        part = part.select(*keep, "rule", "copy", "conversation")
        out = part if out is None else out.unionByName(part)
    return out
