import os

import pytest
from conftest import rows

from turnmill.session import fresh_path
from turnmill.sources import readers as rd
from turnmill.sources import sinks as sk
from turnmill.operators.order import chunk_bucket
from turnmill.streaming import stream as st


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8") as f:
        f.write(text)


def test_json_and_extension(spark, tmp_path):
    write(f"{tmp_path}/a.json", '[{"x": 1}, {"x": 2}]')
    write(f"{tmp_path}/b.jsonl", '{"x": 3}\n{"x": 4}\n')
    assert rows(rd.read_by_extension(spark, "x int", f"{tmp_path}/a.json")) == [(1,), (2,)]
    assert rows(rd.read_by_extension(spark, "x int", f"{tmp_path}/b.jsonl")) == [(3,), (4,)]
    with pytest.raises(ValueError):
        rd.read_by_extension(spark, "x int", "c.txt")
    with pytest.raises(ValueError):
        rd.read_json(spark, "x int", files=["a"], folder="b")


def test_read_many_rules(spark, tmp_path):
    write(f"{tmp_path}/a/x.jsonl", '{"x": 1}\n')
    write(f"{tmp_path}/b/deep/y.jsonl", '{"x": 2}\n')
    write(f"{tmp_path}/b/deep/z.txt", "ignored")
    got = rd.read_many(spark, "x int", [f"{tmp_path}/a", f"{tmp_path}/b"], id_col="x", suffixes=(".jsonl",))
    assert rows(got, "x") == [(1,), (2,)]
    with pytest.raises(ValueError, match="2 values for 1"):
        rd.read_many(spark, "x int", [f"{tmp_path}/a"], id_col="x", ratios=[1.0, 2.0])
    with pytest.raises(ValueError, match="no matching file"):
        rd.read_many(spark, "x int", [f"{tmp_path}/a"], id_col="x", suffixes=(".csv",))


def test_manifest_order(spark, tmp_path):
    for p in ("b.json", "a/z.json", "a/b/c.json", "a.json", "a/c.json"):
        write(f"{tmp_path}/{p}", "{}")
    got = [r["rel_path"] for r in rd.manifest(spark, str(tmp_path), ".json").orderBy("sort_key").collect()]
    assert got == ["a.json", "b.json", "a/c.json", "a/z.json", "a/b/c.json"]


def test_permissive_keeps_broken_lines(spark, tmp_path):
    write(f"{tmp_path}/d.jsonl", '{"x": 1}\nnot json\n{"x": 2}\n')
    good, bad = rd.read_checked(spark, "x int", f"{tmp_path}/d.jsonl")
    assert rows(good) == [(1,), (2,)] and [r["_corrupt"] for r in bad.collect()] == ["not json"]


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    write(f"{tmp_path}/l.txt", "".join(f"line {i} é\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        seen = []
        for size in ("600", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append(rows(rd.number_lines(rd.read_lines(spark, f"{tmp_path}/l.txt")), "line_no", "offset", "value"))
        assert seen[0] == seen[1]
        assert all(v == f"line {n} é" for n, _, v in seen[0])
        raw = open(f"{tmp_path}/l.txt", "rb").read()
        assert all(raw[o:].startswith(v.encode() + b"\n") for _, o, v in seen[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_valid_split_rule(spark):
    for n, want in ((250, {"train": 250}), (60_000, {"train": 60_000, "valid": 600})):
        df = spark.range(n).selectExpr("'f' as file", "id", "'x' as line", "1L as num_tokens")
        parts = sk.train_valid(df, file="file", order=["id"], bucket=chunk_bucket("id"))
        assert {r["split"]: r["n_samples"] for r in sk.split_totals(parts, by=["file"]).collect()} == want
    apart = sk.train_valid(df, file="file", order=["id"], bucket=chunk_bucket("id"), disjoint=True)
    assert {r["split"]: r["n_samples"] for r in sk.split_totals(apart, by=["file"]).collect()} == {"train": 59_400, "valid": 600}


def test_signed_and_message_lines(spark, tmp_path):
    write(f"{tmp_path}/s/a.jsonl", '{"tokens": [1, -2]}\n{"tokens": [3]}\n')
    assert rows(rd.read_signed(spark, f"{tmp_path}/s", min_length=2), "tokens") == [([1, -2],)]
    write(f"{tmp_path}/m/a.jsonl", '[{"role": "user", "content": "q"}]\n\n[{"role": "user", "content": "r"}]\n')
    got = rd.read_message_lines(spark, f"{tmp_path}/m").orderBy("line_no").collect()
    assert [r["messages"][0]["content"] for r in got] == ["q", "r"]


def test_stream_packer_flush_and_restart(spark):
    src, out, ck = (fresh_path(spark, n) for n in ("t-in", "t-out", "t-ck"))
    schema = "source string, input_ids array<int>, labels array<int>, flush boolean"
    def feed(rows_):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(src)
    def run():
        st.run_available(st.pack_stream(spark.readStream.schema(schema).parquet(src), 4), out, ck)
        return rows(spark.read.schema(f"source string, {st.PACK}").parquet(out), "source", "pack", "input_ids", "cumulative_len")
    feed([("a", [1, 2, 3], [1, 2, 3], False)])
    run()
    feed([("a", [4, 5, 6], [4, 5, 6], False)])
    assert run() == [("a", 0, [1, 2, 3, 4], [0, 3, 4])]
    feed([("a", [7], [7], True)])
    assert run() == [("a", 0, [1, 2, 3, 4], [0, 3, 4]), ("a", 1, [5, 6, 7], [0, 2, 3])]
