"""The registered queries of the training-data operators: ``op<N>_<name>``, thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import (chat, curriculum, decontaminate, host_rules, language, ngram_join, planes, quality, runs, shards, simhash, sql, warc,
                          whitening)
from turnmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer_path() -> str:
    """The public byte-level vocabulary of the token files; a parameter of the operator."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_host_rules", sql.OP1)
def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.verdicts(table(spark, sf_dir, "documents")).drop("host_rate")


@query("op2_warc", sql.OP2)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(*warc.write(table(spark, sf_dir, "pages"))).drop("url")


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_token_planes")
def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.read(*planes.write(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_shards")
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shuffle(table(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce(F.col("rec.text"), F.lit("")).cast("binary"))
    return found.select("rec.doc_id", shards.size_of(F.col("rec.text")).alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"),
                        "shard", "slot", "grown_shard")


@query("op8_decontaminate", sql.OP8)
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
                        "contaminated", "n_near")


@query("op9_curriculum", sql.OP9)
def op9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curriculum.dealt(table(spark, sf_dir, "documents"))
    return found.select("rec.doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"),
                        F.get("positions", F.lit(1)).alias("second_position"))


@query("op10_chat_repair")
def op10_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_dialogues(table(spark, sf_dir, "conversations"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("eigenvalue")


@query("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(table(spark, sf_dir, "documents"), edit=runs.replanted)


@query("op13_ngram_join")
def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))
