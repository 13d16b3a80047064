"""Corpus reports: token accounting, format checks, dialogue checks, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions.tokens import supervised
from turnmill.operators.order import CHUNK, chunk_bucket, previous_row


def token_accounting(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("num_tokens").alias("n_tokens"),
        F.sum(supervised("labels")).alias("n_supervised"), F.min("num_tokens").alias("shortest"),
        F.max("num_tokens").alias("longest"))


def require_columns(df: DataFrame, schema: dict[str, str]) -> None:
    """Eager schema check of a stage's input: raises before any job runs."""
    have = dict(df.dtypes)
    faults = [f"missing column {c}" if c not in have else f"{c} is {have[c]}, not {t}"
              for c, t in schema.items() if have.get(c) != t]
    if faults:
        raise ValueError("; ".join(faults))


def is_conversation(df: DataFrame, column: str = "conversation") -> bool:
    """Schema half of the format check: an array of structs with string input and output."""
    t = df.schema[column].dataType if column in df.columns else None
    if not (isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType)):
        return False
    fields = {f.name: f.dataType for f in t.elementType.fields}
    return all(isinstance(fields.get(n), T.StringType) for n in ("input", "output"))


def format_faults(turns: DataFrame, *, sample: str = "sample_id", by: list[str] | None = None) -> DataFrame:
    """Value half of the format check: counts of null and empty inputs and outputs."""
    return turns.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("input").isNull()).alias("null_input"),
        F.count_if(F.col("output").isNull()).alias("null_output"),
        F.count_if(F.col("input") == "").alias("empty_input"), F.count_if(F.col("output") == "").alias("empty_output"))


def dialogue_checks(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
                    chunk: int = CHUNK) -> DataFrame:
    """Per dialogue: message count, repeated roles in a row, odd count, first and last role."""
    edged = previous_row(messages.select(sample, order, role), order=order, bucket=chunk_bucket(order, chunk),
                         keys=[sample], cols={"_prev": role})
    return edged.groupBy(sample).agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(F.coalesce(F.col("_prev") == F.col(role), F.lit(False))).alias("n_repeated"),
        F.min_by(role, order).alias("first_role"), F.max_by(role, order).alias("last_role"),
    ).withColumn("is_odd", F.col("n_messages") % 2 == 1)


def flops_per_step(batch: Column, seq: Column, *, hidden: int, layers: int, vocab: int, mlp_ratio: float,
                   causal: bool = True, checkpointing: bool = True, sp: int = 1) -> Column:
    """Training FLOPs of one step; ``mlp_ratio`` is intermediate / hidden, a gate adds half of it."""
    b, s = batch.cast("double"), seq.cast("double") / sp
    ratio = mlp_ratio * 1.5
    proj = 8 * b * s * float(hidden) ** 2
    attn = 4 * b * s * s * float(hidden) * sp / (2 if causal else 1)
    mlp = 4 * ratio * b * s * float(hidden) ** 2
    return (3 + int(checkpointing)) * (proj + attn + mlp) * layers + 6 * b * s * float(hidden) * vocab


def throughput(steps: DataFrame, *, sp: int = 1, **model) -> DataFrame:
    """``tokens_per_sec`` and ``tflops`` of every logged step."""
    t = F.col("iter_time") + F.lit(1e-12)
    return steps.withColumn("tokens_per_sec", F.col("batch_size") * F.col("seq_len") / sp / t).withColumn(
        "tflops", flops_per_step(F.col("batch_size"), F.col("seq_len"), sp=sp, **model) / 1e12 / t)
