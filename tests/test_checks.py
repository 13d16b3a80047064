"""Raw records, stage observation, length sketches, cut path trees, null keys."""

import json
import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from turnmill.operators import observe, raw, sketch
from turnmill.operators import order as od
from turnmill.operators import pack as pk
from turnmill.operators.formats import pair_turns
from turnmill.session import stage
from turnmill.sources import readers as rd
from turnmill.sources import sinks as sk

# ---- raw records ---------------------------------------------------------------------------------------------------

GOOD = {"conversation": [{"input": "q", "output": "a"}, {"input": "", "output": "b", "system": None}]}


def lines(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string")


def test_faults_name_what_is_wrong(spark):
    texts = [json.dumps(GOOD), None, "  ", "{", '"text"', "{}", '{"conversation": null}', '{"conversation": {}}', '{"conversation": []}',
             '{"conversation": [{"input": "q"}]}', '{"conversation": ["q"]}', '{"conversation": [{"input": "q", "output": 1.5}]}']
    got = {r["n"]: r["faults"] for r in raw.record_faults(lines(spark, texts)).collect()}
    turn = "turn without input and output as texts"
    assert [got[k] for k in range(len(texts))] == [
        [], ["no record"], ["no record"], ["not json"], ["not an object"], ["$.conversation is missing"], ["$.conversation is missing"],
        ["$.conversation is OBJECT, not ARRAY"], ["$.conversation is empty"], [turn], [turn], [turn]]
    asked = [raw.Expect("$.id", "NUMBER"), raw.Expect("$.name", "STRING", required=False, filled=True)]
    texts = ['{"id": 1}', '{"id": "1", "name": " "}', '{"name": true}']
    got = {r["n"]: r["faults"] for r in raw.record_faults(lines(spark, texts), asked, turns=False).collect()}
    assert got == {0: [], 1: ["$.id is STRING, not NUMBER", "$.name is empty"], 2: ["$.id is missing", "$.name is BOOLEAN, not STRING"]}


def plain_census(texts):
    values, records = {}, {}
    kind = lambda v: ("VOID" if v is None else "BOOLEAN" if isinstance(v, bool) else "NUMBER" if isinstance(v, (int, float)) else
                      "STRING" if isinstance(v, str) else "ARRAY" if isinstance(v, list) else "OBJECT")

    def walk(path, v, seen):
        seen.append((path, kind(v)))
        for name, x in v.items() if isinstance(v, dict) else ():
            walk(f"{path}.{name}", x, seen)
        for x in v if isinstance(v, list) else ():
            walk(f"{path}[*]", x, seen)
    for t in texts:
        seen = []
        try:
            walk("$", json.loads(t), seen) if t is not None else seen.append(("$", "MISSING"))
        except ValueError:
            seen = [("$", "BROKEN")]
        for k in seen:
            values[k] = values.get(k, 0) + 1
        for k in set(seen):
            records[k] = records.get(k, 0) + 1
    return sorted((p, k, n, records[p, k]) for (p, k), n in values.items())


def test_census_counts_every_path(spark):
    texts = [json.dumps(GOOD), None, "{", "[1, [2, \"x\"], null]", '{"a": {"b": {"c": [true, 1.25]}}, "a2": 10000000000000000000}', "5", '""'] * 3
    assert sorted(tuple(r) for r in raw.type_census(lines(spark, texts)).collect()) == plain_census(texts)
    shallow = {r["path"] for r in raw.type_census(lines(spark, texts), depth=2).collect()}
    assert shallow == {"$", "$.conversation", "$[*]", "$.a", "$.a2"}
    assert raw.type_census(lines(spark, texts).limit(0)).count() == 0


def test_mapping_goes_with_the_records(spark):
    standard, other = lines(spark, [json.dumps(GOOD)] * 3), lines(spark, ['{"text": "x"}', json.dumps(GOOD)])
    raw.check_mapping(standard, None)
    raw.check_mapping(other.where("n = 0"), "pretrain")
    with pytest.raises(ValueError, match="1 of 2 records are not in the standard form"):
        raw.check_mapping(other, None)
    with pytest.raises(ValueError, match="3 of 3 records are in the standard form already"):
        raw.check_mapping(standard, "pretrain")
    with pytest.raises(ValueError, match="unknown format"):
        raw.check_mapping(standard, "nothing")


# ---- observation ---------------------------------------------------------------------------------------------------

def test_stages_are_counted_in_the_one_run(spark, tmp_path):
    seen = observe.Stages(keep=4)
    runs = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    df = seen.watch(spark.range(1000).mapInArrow(touch, "id long").repartition(7), "all", id_col="id")
    df = seen.watch(df.where("id % 3 = 0").withColumn("size", F.col("id") * 2), "thirds", id_col="id", length=F.col("size"), show=F.col("id"))
    df = seen.watch(df.where("id > 5000"), "none", id_col="id")
    df.write.parquet(f"{tmp_path}/out")
    found = seen.rows()
    assert runs.value == 1000
    assert [r[:6] for r in found] == [(0, "all", 1000, 0, 0, 0), (1, "thirds", 334, 666, sum(range(0, 1000, 3)) * 2, 1998), (2, "none", 0, 334, 0, 0)]
    assert len(found[0][6]) == 4 and len(found[1][6]) == 4 and found[2][6] == []
    assert all(json.loads(t)["id"] < 1000 for t in found[0][6]) and all(int(t) % 3 == 0 for t in found[1][6])
    again = observe.Stages(keep=4)
    again.watch(spark.range(1000).coalesce(1), "all", id_col="id").write.parquet(f"{tmp_path}/again")
    assert again.rows()[0][6] == found[0][6]
    assert seen.report(spark).count() == 3


# ---- sketches ------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("error", [0.01, 0.05])
def test_quantiles_stay_within_the_error_and_merge_exactly(spark, error):
    rng = random.Random(4)
    values = {"a": [int(rng.lognormvariate(5, 2)) for _ in range(3000)], "b": [0, 0, 1, 10 ** 9], None: [7], "empty": []}
    data = [(k, i % 5, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("a", 1, None), ("empty", 0, None)]
    df = spark.createDataFrame(data, "source string, file int, size long")
    fine = sketch.sketch(df, ["source", "file"], "size", error)
    merged = sketch.merged(stage(fine, "fine"), ["source"])
    once = sketch.sketch(df, ["source"], "size", error)
    assert rows(merged) == rows(once)
    asked = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    for r in sketch.quantiles(merged, asked, error).collect():
        v = sorted(values[r["source"]])
        assert (r["n"], r["total"], r["shortest"], r["longest"]) == (len(v), sum(v), v[0], v[-1])
        for q in asked:
            true = v[math.floor(q * (len(v) - 1))]
            assert abs(r[f"q{round(q * 100)}"] - true) <= error * true + 1e-9


# ---- cut path trees ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("bound", [1, 5, 40, 10_000])
def test_cuts_are_small_and_keep_the_order(spark, bound):
    rng = random.Random(6)
    paths = {f"hot/f{k}.txt" for k in range(150)} | {f"{rng.choice('abc')}/{rng.choice('xy')}/{rng.randrange(500)}.txt" for _ in range(120)}
    paths |= {f"{k}.txt" for k in range(40)} | {"a", "ab", "abc", "hot/f", "hot/f1", "deep/" + "/".join("d" * 12) + "/z", "é/ü.txt"}
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string").withColumn("sort_key", rd.sort_key_of(F.col("rel_path")))
    cuts = rd.path_cuts(df, bound)
    sizes = [r["count"] for r in cuts.groupBy("cut").count().collect()]
    assert max(sizes) <= bound
    key = lambda p: "\x01".join(("0" if i == p.count("/") else "1") + part for i, part in enumerate(p.split("/"))).encode()
    got = [r["rel_path"] for r in sorted(rd.ordered_files(df, bound).collect(), key=lambda r: r["file_no"])]
    assert got == sorted(paths, key=key)
    assert [r["file_no"] for r in rd.ordered_files(df, bound).orderBy("file_no").collect()] == list(range(len(paths)))


# ---- null keys -----------------------------------------------------------------------------------------------------

def halved(spark, n=100):
    ids = "CAST(id AS BIGINT) AS sample_id"
    return spark.range(n).selectExpr(ids, "CASE WHEN id % 2 = 0 THEN 's' END AS source", "CAST(id % 2 AS INT) AS k", "5L AS num_tokens",
                                     "array_repeat(CAST(id AS INT), 5) AS input_ids", "array_repeat(CAST(id AS INT), 5) AS labels")


def test_null_sources_are_packed_like_others(spark):
    df = stage(halved(spark), "halved")
    packs = pk.pack_range(df, 25).collect()
    assert len(packs) == 20 and sum(p["source"] is None for p in packs) == 10
    for segment in (3, 1 << 18):
        fit = pk.next_fit(df, 12, drop_oversize=False, segment=segment).collect()
        assert len(fit) == 100 and {(r["source"], r["bin"]) for r in fit} == {(s, b) for s in ("s", None) for b in range(25)}
    assert pk.soft_pack(df, 12).agg(F.sum("n_samples")).first()[0] == 100


@pytest.mark.parametrize("kind", ["string", "long", "double", "date", "struct<a:int>"])
def test_null_keys_of_every_type_keep_their_rows(spark, kind):
    value = {"string": "CAST(id % 3 AS STRING)", "date": "date_add(DATE'2020-01-01', CAST(id % 3 AS INT))", "struct<a:int>": "named_struct('a', CAST(id % 3 AS INT))"}
    df = spark.range(60).selectExpr("id", f"CASE WHEN id % 4 > 0 THEN {value.get(kind, f'CAST(id % 3 AS {kind})')} END AS k")
    placed = od.shuffled(df, "id", keys=["k"], totals={"n": "idx"}).collect()
    assert len(placed) == 60 and sorted(r["idx"] for r in placed if r["k"] is None) == list(range(15))
    assert all(r["n"] == 15 for r in placed if r["k"] is None)
    lag = od.previous_row(df, order="id", bucket=od.chunk_bucket("id", 7), keys=["k"], cols={"before": "id"}).collect()
    assert {r["id"]: r["before"] for r in lag if r["k"] is None} == {i: i - 4 if i else None for i in range(0, 60, 4)}
    sparse = od.running_sparse(df, order=["id"], bucket=od.chunk_bucket("id", 7), keys=["k"], index="at", bound=14).collect()
    assert {r["id"]: r["at"] for r in sparse if r["k"] is None} == {i: i // 4 for i in range(0, 60, 4)}


def test_rows_without_a_place_come_first(spark):
    df = spark.createDataFrame([(None, "x"), (3, "x"), (1, "x"), (None, None), (9000, None)], "at long, k string")
    out = od.running(df, order=["at"], bucket=od.chunk_bucket("at"), keys=["k"], index="i")
    assert rows(out, "k", "at", "i") == sorted([("x", None, 0), ("x", 1, 1), ("x", 3, 2), (None, None, 0), (None, 9000, 1)], key=repr)


def test_null_sample_ids_files_and_ratios(spark):
    m = spark.createDataFrame([(s, t, "user" if t % 2 == 0 else "assistant", f"{t}") for s in (None, 1) for t in range(6)],
                              "sample_id long, turn long, role string, content string")
    turns = pair_turns(m, chunk=2)
    assert rows(turns, "sample_id", "turn_no", "input", "output") == sorted(
        [(s, t, str(2 * t), str(2 * t + 1)) for s in (None, 1) for t in range(3)], key=repr)
    df = halved(spark)
    assert od.sample_ratio(df, "sample_id", {"s": 2.0}, key="source").count() == 150
    marked = df.selectExpr("source AS file", "sample_id", "'x' AS line", "1L AS num_tokens")
    parts = sk.train_valid(marked, file="file", order=["sample_id"], bucket=od.chunk_bucket("sample_id"), every=10, keep_above=2)
    assert sk.split_totals(parts, by=["file"]).count() == 4 and parts.count() == 110


# ---- collators and options -----------------------------------------------------------------------------------------

def test_rewards_stand_beside_their_padded_samples(spark):
    from turnmill.operators.batch import collate_rewards
    df = spark.createDataFrame([(2, 0, [5, 6], [-100, 6], 0.5), (1, 0, [7], [7], None), (3, 1, [8], [8], -1.0)],
                               "sample_id long, batch long, input_ids array<int>, labels array<int>, reward double")
    got = {r["batch"]: r for r in collate_rewards(df, "batch", "sample_id").collect()}
    assert got[0]["input_ids"] == [[7, 0], [5, 6]] and got[0]["labels"] == [[7, -100], [-100, 6]]
    assert got[0]["attention_mask"] == [[True, False], [True, True]] and got[0]["rewards"] == [None, 0.5]
    assert got[1]["input_ids"] == [[8]] and got[1]["rewards"] == [-1.0]


def test_builds_refuse_options_that_do_not_go_together(spark):
    from turnmill.plans.presets import build_preset
    records = spark.createDataFrame([(1, "q", "", "a")], "doc_id long, instruction string, input string, output string")
    with pytest.raises(ValueError, match="packing needs the train split"):
        build_preset(records, "alpaca", id_col="doc_id", split="test")
    with pytest.raises(ValueError, match="batch size 1; max_length must divide"):
        build_preset(records, "alpaca", id_col="doc_id", varlen=True, batch=2, sp=3)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 1000])
@pytest.mark.parametrize("decay", [1.0, 0.99, 0.5, 0.0])
def test_backward_sums_of_any_length(spark, n, decay):
    from turnmill.operators.rl import backward_sums
    rng = random.Random(n)
    deltas = [rng.uniform(-1, 1) for _ in range(n)]
    want, last = [], 0.0
    for d in reversed(deltas):
        last = d + decay * last
        want.append(last)
    got = spark.createDataFrame([(deltas,)], "d array<double>").select(backward_sums(F.col("d"), decay)).first()[0]
    assert got == pytest.approx(want[::-1], abs=1e-9)
