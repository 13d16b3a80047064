"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

1. ``language``: documents without any letter go, and those that the network takes for noise (limits by text length).
2. ``near_duplicates``: one document of each group of near copies stays, the one with the smallest id
   (null last; rows that share an id are told apart by their texts).
3. ``decontaminate``: documents that hold a passage of the benchmark go.
4. ``mix``: documents are used zero, one or two times, so that sources come to their target words.
5. ``tokens``: the documents are encoded to token files and read back: one row per document with its place and checksum.

All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnmill.llm import curriculum, decontaminate, language, planes, simhash
from turnmill.llm.common import fresh_path, table
from turnmill.llm.queries import tokenizer_path
from turnmill.session import staging

# Neither a trained network nor token ids can be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return planes.read(*planes.write(docs, tokenizer_path()))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; what lies between them goes to the shared folder.

    What a stage stages for itself is removed when its output is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with staging(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
