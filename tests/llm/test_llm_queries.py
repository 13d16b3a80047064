"""The registered queries on the smallest tables: against their SQL, and as a whole."""

import re

import duckdb
import pytest
from conftest import SF

import corpus_pipeline
from turnmill.llm import queries as q
from turnmill.llm import simhash
from turnmill.llm.common import table

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    res = con.execute(q.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(repr, res.fetchall()))


@pytest.mark.parametrize("name", ["op8_decontaminate", "op9_curriculum"])
def test_native_queries_run_no_python(spark, name):
    plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow|CartesianProduct|NestedLoop", plan)


def test_pipeline_stages_keep_clean_documents(spark):
    docs = table(spark, SF, "documents")
    got = {"input": docs}
    for name, step in corpus_pipeline.STAGES:
        before = list(got.values())[-1]
        out = step(spark, before, SF).cache()
        if name != "tokens":
            assert out.columns == docs.columns
        got[name] = out
    ids = {n: {r["doc_id"] for r in df.select("doc_id").collect()} for n, df in got.items()}
    assert len(ids["language"]) > 0.97 * len(ids["input"])
    groups = {r["component_id"] for r in simhash.classes(got["language"]).collect()}
    assert ids["near_duplicates"] == groups
    hit = {r["doc_id"] for r in q.decontaminate.decontaminate(got["near_duplicates"], table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert hit and ids["decontaminate"] == ids["near_duplicates"] - hit
    copies = got["mix"].groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert ids["mix"] <= ids["decontaminate"] and copies == 2
    tokens = got["tokens"].orderBy("start").collect()
    assert len(tokens) == got["mix"].count()
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(tokens[:-1], tokens[1:], strict=True))


def test_near_duplicates_shuffles_its_variants(spark, monkeypatch):
    plans, write = {}, simhash.stage

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(simhash, "stage", seen)
    docs = spark.createDataFrame([(k, f"copies of text {k // 2}", "en") for k in range(8)], "doc_id long, text string, lang string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2, 4, 6]
    assert "SortMergeJoin" in plans["simhash-buckets"] and "Broadcast" not in plans["simhash-buckets"]
