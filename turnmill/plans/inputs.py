"""The operators' inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder, words
from turnmill.operators.formats import pair_turns
from turnmill.operators.order import chunk_bucket, running_sparse
from turnmill.operators.render import render_turns
from turnmill.plans.presets import encode_dialogues
from turnmill.session import spread, stage


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """The documents, for CPU-heavy text work."""
    return spread(table(spark, d, "documents"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """``(sample_id, turn, role, content)``."""
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("sample_id"), "turn", "role", F.col("text").alias("content"))


def message_lists(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its message list: the shape of a JSON record."""
    return messages(spark, d).groupBy("sample_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return pair_turns(messages(spark, d))


def rendered(spark: SparkSession, d: str, template: str = "qwen_chat") -> DataFrame:
    return render_turns(turns(spark, d), template)


def samples(spark: SparkSession, d: str, max_length: int = 2048) -> DataFrame:
    return encode_dialogues(messages(spark, d), "qwen_chat", HashEncoder(), max_length=max_length)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """``(sample_id, source, lang, text, num_tokens)``: the pretraining corpus."""
    return texts(spark, d).select(
        F.col("doc_id").alias("sample_id"), "source", "lang", "text", F.size(words("text")).cast("long").alias("num_tokens"))


def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The length table of the corpus, staged: texts are read once, planning reads this."""
    return stage(documents(spark, d).select("sample_id", "source", "lang", "num_tokens"), "lengths")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Step log: trajectory = user, steps in event order, with dense ``step`` and ``n_steps``."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("traj_id"), "event_id", (F.col("value") / 100).alias("x"), "ts", "event_type")
    return running_sparse(e, order=["event_id"], keys=["traj_id"], bucket=chunk_bucket("event_id"), index="step",
                   totals={"n_steps": "step"})


def six(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
