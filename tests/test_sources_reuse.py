"""Cache with reuse, one-plan rules, epochs of lines, JSON arrays, pack files."""

import json
import os
import shutil

import pytest
from conftest import rows
from pyspark.sql import functions as F

from turnmill.functions.tokens import words
from turnmill.operators import pack as pk
from turnmill.operators import packfiles
from turnmill.session import fresh_path, stage
from turnmill.sources import arrays, rules
from turnmill.sources.cache import FileCache
from turnmill.streaming import epochs


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf8", newline="") as f:
        f.write(text)


# ---- cache ---------------------------------------------------------------------------------------------------------

def cache_of(spark, folder, version="v1", seen=None):
    def count(line):
        return F.size(words(line))
    return FileCache(spark, str(folder), version, count)


def entries(folder):
    return sorted(os.listdir(f"{folder}/entries")) if os.path.exists(f"{folder}/entries") else []


def test_only_changed_files_are_encoded_again(spark, tmp_path):
    src, box = f"{tmp_path}/src", f"{tmp_path}/cache"
    for k in range(6):
        write(f"{src}/d{k % 2}/f{k}.txt", "".join(f"line {i} of {k} é\r\n" for i in range(k + 1)))
    cache = cache_of(spark, box)
    first = {r["path"].rsplit("/", 1)[1]: r for r in cache.index(src).collect()}
    assert len(first) == 6 and not any(r["reused"] for r in first.values())
    assert [first[f"f{k}.txt"]["n_lines"] for k in range(6)] == [1, 2, 3, 4, 5, 6]
    assert all(first[f"f{k}.txt"]["n_bytes"] == os.path.getsize(f"{src}/d{k % 2}/f{k}.txt") for k in range(6))
    made = entries(box)
    write(f"{src}/d0/f2.txt", "another text\n")
    shutil.copy(f"{src}/d1/f5.txt", f"{src}/copy.txt")
    index = cache.index(src)
    second = {r["path"].rsplit("/", 1)[1]: r for r in index.collect()}
    assert {n for n, r in second.items() if not r["reused"]} == {"f2.txt"}
    assert len(entries(box)) == len(made) + 1 and second["copy.txt"]["n_lines"] == 6
    fresh = next(e for e in entries(box) if e not in made)
    assert {r["cache_key"] for r in spark.read.parquet(f"{box}/entries/{fresh}").collect()} == {second["f2.txt"]["cache_key"]}
    for r in cache.lines(index).collect():
        raw = open(r["path"].removeprefix("file://").removeprefix("file:"), "rb").read()
        line = raw[r["offset"]:r["offset"] + r["bytes"]]
        assert line.count(b"\n") == 1 and line.endswith(b"\n") and r["num_tokens"] == len([w for w in line.decode()[:-1].split(" ") if w])
    assert all(r["reused"] for r in cache.index(src).collect()) and entries(box) == sorted([*made, fresh])


def test_another_encoder_is_another_entry_and_lost_runs_do_not_count(spark, tmp_path, monkeypatch):
    src, box = f"{tmp_path}/src", f"{tmp_path}/cache"
    write(f"{src}/a.txt", "one two\nthree\n")
    assert cache_of(spark, box).sweep() == 0
    monkeypatch.setattr(FileCache, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        cache_of(spark, box).index(src)
    monkeypatch.undo()
    assert cache_of(spark, box).manifest().count() == 0 and len(entries(box)) == 1
    assert cache_of(spark, box).sweep() == 1 and entries(box) == []
    one = cache_of(spark, box).index(src).collect()
    two = cache_of(spark, box, "v2").index(src).collect()
    assert not one[0]["reused"] and not two[0]["reused"] and one[0]["cache_key"] != two[0]["cache_key"]
    assert cache_of(spark, box).index(src).collect()[0]["reused"]
    monkeypatch.setattr("turnmill.sources.cache.NAMED_FILES", 0)
    write(f"{src}/b.txt", "no line feed at the end")
    found = {r["path"][-5:]: tuple(r)[2:] for r in cache_of(spark, box).index(src).collect()}
    assert found == {"a.txt": (True, 2, 14, 3), "b.txt": (False, 1, 24, 6)}


# ---- rules ---------------------------------------------------------------------------------------------------------

def test_a_thousand_folders_are_one_scan(spark, tmp_path):
    for k in range(1000):
        write(f"{tmp_path}/r/s{k}/x.jsonl", f'{{"x": {k}}}\n')
    wanted = [rules.Rule(f"{tmp_path}/r/s{k}", ratio=(1.0, 2.0)[k % 2]) for k in range(0, 1000, 2)] + [rules.Rule(f"{tmp_path}/r", ratio=2.0)]
    got = rules.read_by_rules(spark, "x int", wanted, id_col="x")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("] json")
    assert scans(got) == 0  # the one scan has been staged
    whole = [rules.Rule(f"{tmp_path}/r/s{k}") for k in range(1000)]
    assert scans(rules.read_by_rules(spark, "x int", whole, id_col="x")) == 1
    counts = {r["x"]: r["count"] for r in got.groupBy("x").count().collect()}
    # An even folder has a rule of its own; the others share the root's, of which twice as many rows are asked.
    assert counts == {k: 1 if k % 2 == 0 else 2 for k in range(1000)}


def test_longest_path_patterns_caps_and_draws(spark, tmp_path):
    for k in range(40):
        write(f"{tmp_path}/a/p{k}.jsonl", f'{{"x": {k}, "t": "{"y" * (k % 5)}"}}\n')
        write(f"{tmp_path}/a/deep/q{k}.jsonl", f'{{"x": {100 + k}, "t": "z"}}\n')
    write(f"{tmp_path}/a/deep/skip.txt", "ignored")
    write(f"{tmp_path}/a-b/z.jsonl", '{"x": 500, "t": "v"}\n')
    got = rules.read_by_rules(spark, "x int, t string", [
        rules.Rule(f"file:{tmp_path}/a", max_length=3), rules.Rule(f"{tmp_path}/a/deep", ratio=0.5, pattern=r"q\d?[02468]\.jsonl$"),
        rules.Rule(f"{tmp_path}/a-b", ratio=7.5, replacement=True)], id_col="x", length=lambda: F.length("t"))
    by = {}
    for r in got.collect():
        by.setdefault(r["rule"], []).append(r["x"])
    assert sorted(by[0]) == [k for k in range(40) if k % 5 < 3]
    assert len(by[1]) == 10 == len(set(by[1])) and all(x >= 100 and x % 2 == 0 for x in by[1])
    assert by[2] == [500] * 7
    with pytest.raises(ValueError, match="no matching file: .*deep"):
        rules.read_by_rules(spark, "x int", [rules.Rule(f"{tmp_path}/a"), rules.Rule(f"{tmp_path}/a/deep", pattern="nothing")], id_col="x")
    with pytest.raises(ValueError, match="two rules"):
        rules.read_by_rules(spark, "x int", [rules.Rule(f"{tmp_path}/a"), rules.Rule(f"file:{tmp_path}/a/")], id_col="x")
    assert rules.roots([rules.Rule(p) for p in ("/a", "/a-b", "/a/b", "/c/d")]) == ["/a", "/a-b", "/c/d"]


def test_draws_with_replacement_are_exact_in_number(spark, tmp_path):
    write(f"{tmp_path}/a/x.jsonl", "".join(f'{{"x": {k}}}\n' for k in range(300)))
    write(f"{tmp_path}/b/x.jsonl", "".join(f'{{"x": {k}}}\n' for k in range(300, 400)))
    got = rules.read_by_rules(spark, "x int", [rules.Rule(f"{tmp_path}/a", 250.5, replacement=True), rules.Rule(f"{tmp_path}/b", 1.25)], id_col="x")
    seen = {r["rule"]: (r["n"], r["d"]) for r in got.groupBy("rule").agg(F.count("x").alias("n"), F.countDistinct("x").alias("d")).collect()}
    assert seen == {0: (75150, 300), 1: (125, 100)}


def test_formats_of_rules(spark, tmp_path):
    write(f"{tmp_path}/a/x.jsonl", '{"instruction": "q", "input": "i", "output": "o", "x": 1}\n')
    write(f"{tmp_path}/b/x.jsonl", '{"text": "plain", "x": 2}\n')
    asked = [rules.Rule(f"{tmp_path}/a", fmt="alpaca"), rules.Rule(f"{tmp_path}/b", fmt="pretrain", ratio=2.0)]
    got = rules.read_by_rules(spark, "x int, instruction string, input string, output string, text string", asked, id_col="x")
    out = rules.normalised(got, asked, ["x"])
    assert sorted((r["x"], r["rule"], r["copy"], r["conversation"][0]["output"]) for r in out.collect()) == [(1, 0, 0, "o"), (2, 1, 0, "plain"), (2, 1, 1, "plain")]
    with pytest.raises(ValueError, match="unknown formats: none"):
        rules.rule_table(spark, [rules.Rule("/a", fmt="none")])


# ---- epochs --------------------------------------------------------------------------------------------------------

def lines_written(folder):
    out = []
    for k, n in enumerate((5, 1, 40, 0, 12)):
        body = [f"{k}:{i}:" + "é" * (i % 7) for i in range(n)]
        write(f"{folder}/f{k}.txt", "\n".join(body) + ("\n" if body and k != 2 else ""))
        out += body
    return out


@pytest.mark.parametrize("cut", [1, 7, 64, 10_000])
def test_every_cut_gives_every_line_once_per_epoch(tmp_path, cut):
    body = lines_written(f"{tmp_path}/in")
    files = epochs.listing(f"{tmp_path}/in", ".txt")
    at, end = {"epoch": 0, "file": 0, "byte": 0}, epochs.advance(files, {"epoch": 0, "file": 0, "byte": 0}, 1 << 40, 3)
    seen = []
    while at != end:
        then = epochs.advance(files, at, 100, 3)
        for p in epochs.pieces(files, at, then, cut):
            store, _ = epochs.store_of(p.path)
            seen += [(p.epoch, line.decode()) for _, line in epochs.lines_of(store, p.path, p.start, p.stop)]
        at = then
    assert sorted(seen) == sorted((e, line) for e in range(3) for line in body)
    assert epochs.advance([], at, 5, 3) == at and epochs.pieces(files, end, end, 5) == []


def test_stream_stops_in_an_epoch_and_goes_on(spark, tmp_path):
    body = lines_written(f"{tmp_path}/in")
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    size = sum(n for _, n in epochs.listing(f"{tmp_path}/in", ".txt"))

    def stream():
        return epochs.epoch_stream(spark, f"{tmp_path}/in", ck, epochs=3, suffix=".txt", max_bytes=size // 3, part_bytes=50)
    epochs.run_epochs(stream(), out, ck, batches=4)
    half = spark.read.schema(epochs.SCHEMA).parquet(out)
    stopped = half.count()
    assert 0 < stopped < 3 * len(body) and half.agg(F.max("epoch")).first()[0] >= 1
    write(f"{tmp_path}/in/later.txt", "not of this stream\n")
    epochs.run_epochs(stream(), out, ck)
    got = spark.read.schema(epochs.SCHEMA).parquet(out)
    assert sorted((r["epoch"], r["value"]) for r in got.collect()) == sorted((e, line) for e in range(3) for line in body)
    epochs.run_epochs(stream(), out, ck)
    assert spark.read.schema(epochs.SCHEMA).parquet(out).count() == 3 * len(body)


# ---- arrays --------------------------------------------------------------------------------------------------------

def test_shards_are_valid_arrays(spark, tmp_path):
    df = spark.range(500).selectExpr("id", "concat('é\"\\n', id) AS text", "array(id, id) AS pair", "CAST(NULL AS STRING) AS none").repartition(3)
    arrays.write_arrays(df, f"{tmp_path}/out", shard_bytes=2000)
    names = sorted(n for n in os.listdir(f"{tmp_path}/out") if n.startswith("part-"))
    found = [r for n in names for r in json.load(open(f"{tmp_path}/out/{n}", encoding="utf8"))]
    assert sorted(r["id"] for r in found) == list(range(500)) and all(r["text"] == f'é"\n{r["id"]}' and "none" not in r for r in found)
    assert len(names) > 6 and all(os.path.getsize(f"{tmp_path}/out/{n}") <= 2003 for n in names)
    listed = {r["name"]: (r["records"], r["bytes"]) for r in arrays.committed(spark, f"{tmp_path}/out").collect()}
    assert {n: os.path.getsize(f"{tmp_path}/out/{n}") for n in names} == {n: b for n, (_, b) in listed.items()}
    assert sum(n for n, _ in listed.values()) == 500 and not [n for n in os.listdir(f"{tmp_path}/out") if n.startswith("_writing")]
    arrays.write_arrays(df.limit(0), f"{tmp_path}/none")
    assert [n for n in os.listdir(f"{tmp_path}/none") if n.startswith("part-")] == []


def test_failed_jobs_leave_nothing(spark, tmp_path):
    arrays.write_arrays(spark.range(3), f"{tmp_path}/out")
    before = sorted(os.listdir(f"{tmp_path}/out"))
    bad = spark.range(4000).repartition(4).selectExpr("id", "CASE WHEN id = 3999 THEN raise_error('no') ELSE 'x' END AS t")
    with pytest.raises(Exception, match="no"):
        arrays.write_arrays(bad, f"{tmp_path}/out", shard_bytes=500)
    assert sorted(os.listdir(f"{tmp_path}/out")) == before


# ---- pack files ----------------------------------------------------------------------------------------------------

def test_packs_are_read_from_their_files_only(spark):
    rows_ = [(k, (f"s{k % 3}", None)[k % 7 == 0], [k] * (1 + k % 9), [k] * (1 + k % 9)) for k in range(400)]
    df = spark.createDataFrame(rows_, "sample_id long, source string, input_ids array<int>, labels array<int>").withColumn("num_tokens", F.size("input_ids").cast("long"))
    packs = stage(pk.pack_range(stage(df, "s"), 8), "packs")
    path = fresh_path(spark, "packfiles")
    index = packfiles.write_packs(packs, path, file_tokens=64, step=4)
    assert index.count() > 12 and {r["source"] for r in index.collect()} == {"s0", "s1", "s2", None}
    assert rows(spark.read.parquet(f"{path}/packs").select(*packs.columns)) == rows(packs)
    for wanted in ([("s1", 3, 9)], [("s0", 0, 0), (None, 5, 30)], [("s2", 4, 100000)], [("zz", 0, 9)]):
        got = packfiles.read_packs(spark, path, wanted)
        keep = [r for r in packs.collect() if any(r["source"] == s and a <= r["pack"] <= b for s, a, b in wanted)]
        assert rows(got.select(*packs.columns)) == sorted((tuple(r) for r in keep), key=repr)
        asked = {r["file"] for r in index.collect() if any(r["source"] == s and r["last_pack"] >= a and r["first_pack"] <= b for s, a, b in wanted)}
        files = set(got.inputFiles()) if asked else set()
        assert {f.split("file=")[1].split("/")[0] for f in files} == asked
    assert len(packfiles.read_packs(spark, path, [("s1", 3, 9)]).inputFiles()) < index.count() / 3
