"""Encoders and label masks as array expressions.

An encoder turns a string column into ``array<int>``.  ``HashEncoder`` stays inside the JVM and has
the same value in any SQL engine with ``md5``; ``UserEncoder`` wraps any per-text tokenizer as an
Arrow-batched pandas UDF; ``VocabEncoder`` joins a vocabulary table (see ``operators.encode``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col

# Sentinels of the data model.
IGNORE_INDEX = -100
PAD_INDEX = 0
IMAGE_INDEX = -200
IMAGE_MARK = "<image>"

# BOS ids by tokenizer family; every other family has one BOS id of its own.
BOS_BY_FAMILY: dict[str, tuple[int, ...]] = {"qwen": (), "qwen2": (), "chatglm": (64790, 64792)}

INTS = "array<int>"


def bos_ids(family: str, own: int | None = None) -> tuple[int, ...]:
    """BOS ids of a tokenizer family; ``own`` is the tokenizer's id where the family has no fixed rule."""
    if family in BOS_BY_FAMILY:
        return BOS_BY_FAMILY[family]
    return () if own is None else (own,)


def words(c: Column | str) -> Column:
    """Non-empty pieces between single spaces."""
    return F.array_remove(F.split(col(c), " "), "")


def hash_id(word: Column) -> Column:
    """Token id 1 .. 2^28: the first seven hex digits of md5, plus one (0 stays the pad id)."""
    return (F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") + F.lit(1)).cast("int")


@dataclass(frozen=True)
class HashEncoder:
    """Expressions only, so it can run inside array functions (``in_jvm``)."""

    in_jvm = True
    bos: tuple[int, ...] = (1,)
    eos: tuple[int, ...] = (2,)
    version: str = "hash-md5-7"

    def ids(self, c: Column | str) -> Column:
        return F.transform(words(c), hash_id)

    def units(self, c: Column | str) -> Column:
        """What becomes a token each, as text: ``ids`` is ``unit_ids`` of it."""
        return words(c)

    def unit_ids(self, units: Column | str) -> Column:
        return F.transform(col(units), hash_id)

    def length(self, c: Column | str) -> Column:
        """Token count without hashing; planning stages need no more."""
        return F.size(words(c))


@dataclass(frozen=True)
class UserEncoder:
    """Any tokenizer: ``encode`` maps one text to a list of ints; it runs in Arrow batches."""

    in_jvm = False
    encode: Callable[[str], Sequence[int]]
    bos: tuple[int, ...] = ()
    eos: tuple[int, ...] = ()
    version: str = "user"
    _udf: Callable = field(init=False, repr=False, default=None)

    def __post_init__(self):
        encode = self.encode

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [] if t is None else list(encode(t)))

        object.__setattr__(self, "_udf", run)

    def ids(self, c: Column | str) -> Column:
        return self._udf(col(c))

    def length(self, c: Column | str) -> Column:
        return F.size(self.ids(c))


def int_array(values: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values]).cast(INTS)


def masked(ids: Column | str) -> Column:
    """Labels without loss, as long as ``ids``."""
    return F.array_repeat(F.lit(IGNORE_INDEX), F.size(col(ids)))


def supervised(labels: Column | str) -> Column:
    """Number of tokens with loss."""
    return F.size(F.filter(col(labels), lambda x: x >= 0))


def clip(arr: Column | str, n: Column | int) -> Column:
    return F.slice(col(arr), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def signed_to_ids(tokens: Column | str) -> Column:
    return F.transform(col(tokens), lambda x: F.abs(x))


def signed_to_labels(tokens: Column | str) -> Column:
    """Ids above zero keep their loss; zero and negatives do not."""
    return F.transform(col(tokens), lambda x: F.when(x > 0, x).otherwise(F.lit(IGNORE_INDEX)))


def negate(ids: Column | str) -> Column:
    return F.transform(col(ids), lambda x: -x)


def restarting_positions(lens: Column | str) -> Column:
    """Position ids that restart at every fragment: lengths [3, 2] give [0,1,2,0,1]."""
    return F.flatten(F.transform(col(lens), lambda n: F.sequence(F.lit(0), n.cast("int") - 1)))


def boundaries(lens: Column | str) -> Column:
    """Prefix sums with a leading zero: lengths [3, 2] give [0,3,5]."""
    return F.aggregate(
        col(lens),
        F.array(F.lit(0).cast("int")),
        lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n.cast("int"))),
    )


def joined(arr: Column | str, sep: str = ",") -> Column:
    """Array as text, for reports and checks."""
    return F.array_join(F.transform(col(arr), lambda x: x.cast("string")), sep)
