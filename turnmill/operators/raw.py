"""Checks of raw JSON records before a build: a census of types per path, faults per record, standard against mapped.

Records are parsed as VARIANT, so a text with any shape is read without a schema; nothing is inferred from a sample.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.operators.formats import format_names

DEPTH = 6


@dataclass(frozen=True)
class Expect:
    """What holds at a path of the record: its type (as ``type_of`` names it), whether it must be there, and be filled."""

    path: str
    kind: str
    required: bool = True
    filled: bool = False


# The standard conversation: what a record needs that no format maps.
STANDARD = (Expect("$.conversation", "ARRAY", filled=True),)
TURN_FIELDS = ("input", "output")


def parse(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``record`` (VARIANT): null where the text is null or no JSON."""
    return lines.withColumn("record", F.try_parse_json(value))


def type_of(v: Column) -> Column:
    """``OBJECT``, ``ARRAY``, ``STRING``, ``NUMBER``, ``BOOLEAN``, ``VOID`` (a JSON null), or null where there is nothing."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(v.isNull(), F.lit(None).cast("string")).when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"), "NUMBER").otherwise(name)


def _children(entries: Column) -> Column:
    def of(e: Column) -> Column:
        v, path = e["v"], e["path"]
        fields = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")),
                             lambda kv: F.struct(F.concat(path, F.lit("."), kv["key"]).alias("path"), kv["value"].alias("v")))
        items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.concat(path, F.lit("[*]")).alias("path"), x.alias("v")))
        kind = e["kind"]
        none = F.array().cast("array<struct<path:string,v:variant>>")
        return F.when(kind == "OBJECT", fields).when(kind == "ARRAY", items).otherwise(none)
    found = F.flatten(F.transform(entries, of))
    return F.transform(found, lambda e: F.struct(e["path"].alias("path"), e["v"].alias("v"), type_of(e["v"]).alias("kind")))


def type_census(lines: DataFrame, value: str = "value", depth: int = DEPTH) -> DataFrame:
    """``(path, kind, n_values, n_records)`` over all records, down to ``depth`` levels; ``$`` is the record itself.

    One pass: a record's values are listed level by level in its row, so a row holds no more than the record.  Texts that are
    no JSON count at ``$`` as kind ``BROKEN``, null texts as ``MISSING``.  Counts are summed before they are shuffled.
    """
    rows = parse(lines.select(value), value)
    state = F.when(F.col(value).isNull(), "MISSING").when(F.col("record").isNull(), "BROKEN").otherwise(type_of(F.col("record")))
    rows = rows.select(F.array(F.struct(F.lit("$").alias("path"), F.col("record").alias("v"), state.alias("kind"))).alias("level0"))
    for k in range(1, depth):
        rows = rows.withColumn(f"level{k}", _children(F.col(f"level{k - 1}")))
    names = [F.transform(f"level{k}", lambda e: F.struct(e["path"].alias("path"), e["kind"].alias("kind"))) for k in range(depth)]
    seen = rows.select(F.concat(*names).alias("all")).select("all", F.explode(F.array_distinct("all")).alias("e"))
    each = seen.select("e.path", "e.kind", F.size(F.filter("all", lambda a: a == F.col("e"))).cast("long").alias("n"))
    return each.groupBy("path", "kind").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_records"))


def is_standard(record: Column) -> Column:
    """Whether a record has the standard conversation: turns that all have texts as input and output."""
    turns = F.try_variant_get(record, "$.conversation", "array<variant>")
    good = F.forall(turns, lambda t: F.forall(F.array(*[F.coalesce(type_of(F.try_variant_get(t, f"$.{f}", "variant")), F.lit("")) for f in TURN_FIELDS]),
                                              lambda kind: kind == "STRING"))
    return F.coalesce((F.size(turns) > 0) & good, F.lit(False))


def record_faults(lines: DataFrame, expected: Sequence[Expect] = STANDARD, value: str = "value", turns: bool = True) -> DataFrame:
    """``lines`` with ``faults``: the texts of all that is wrong with a record, in the order of ``expected``; none: empty.

    ``no record`` (null or blank), ``not json``, ``not an object``, ``<path> is missing``, ``<path> is <kind>, not <kind>``,
    ``<path> is empty``, and with ``turns`` ``turn without input and output as texts``.
    """
    rows = parse(lines, value)
    kind = type_of(F.col("record"))
    inner = []
    for e in expected:
        v = F.try_variant_get(F.col("record"), e.path, "variant")
        have = type_of(v)
        empty = F.lit(False)
        if e.filled and e.kind == "STRING":
            empty = F.trim(F.try_variant_get(F.col("record"), e.path, "string")) == ""
        elif e.filled and e.kind == "ARRAY":
            empty = F.size(F.try_variant_get(F.col("record"), e.path, "array<variant>")) == 0
        missing = have.isNull() | (have == "VOID")
        inner.append(F.when(missing, F.lit(f"{e.path} is missing") if e.required else F.lit(None).cast("string"))
                     .when(have != e.kind, F.concat(F.lit(f"{e.path} is "), have, F.lit(f", not {e.kind}")))
                     .when(empty, F.lit(f"{e.path} is empty")))
    if turns:
        listed = F.size(F.try_variant_get(F.col("record"), "$.conversation", "array<variant>")) > 0
        inner.append(F.when(listed & ~is_standard(F.col("record")), F.lit("turn without input and output as texts")))
    whole = F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit("no record")).when(F.col("record").isNull(), F.lit("not json")).when(
        kind != "OBJECT", F.lit("not an object"))
    return rows.withColumn("faults", F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*inner)))).drop("record")


def check_mapping(lines: DataFrame, fmt: str | None, value: str = "value") -> None:
    """Raises where raw records and format do not go together: standard records that are mapped, or others that are not."""
    if fmt is not None and fmt not in format_names():
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(format_names())}")
    counts = parse(lines.select(value), value).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(is_standard(F.col("record"))).alias("standard")).first()
    if fmt is None and counts["standard"] < counts["n"]:
        raise ValueError(f"{counts['n'] - counts['standard']} of {counts['n']} records are not in the standard form: name their format")
    if fmt is not None and counts["standard"]:
        raise ValueError(f"{counts['standard']} of {counts['n']} records are in the standard form already: no format is to be named")
