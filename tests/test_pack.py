import random

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from turnmill.operators import batch as bt
from turnmill.operators import order as od
from turnmill.operators import pack as pk
from turnmill.plans import inputs


def lengths(spark, values, source="a"):
    return spark.createDataFrame([(i, source, n) for i, n in enumerate(values)], "sample_id bigint, source string, num_tokens bigint")


def in_order(df, limit, **kw):
    return pk.range_fragments(df, limit, shuffle=False, order="sample_id", bucket=od.chunk_bucket("sample_id", 2), **kw)


def test_range_golden(spark):
    cut = in_order(lengths(spark, [3, 5, 4, 6]), 6)
    assert rows(cut, "pack", "at", "n") == [(0, 0, 3), (0, 3, 3), (1, 0, 2), (1, 2, 4), (2, 0, 6)]
    tail = lengths(spark, [4, 4])
    assert rows(in_order(tail, 6), "pack", "n") == [(0, 2), (0, 4)]
    assert rows(in_order(tail, 6, tail="emit"), "pack", "n") == [(0, 2), (0, 4), (1, 2)]


def test_packed_arrays(spark):
    s = lengths(spark, [3, 5, 4, 6]).withColumn("input_ids", F.transform(
        F.sequence(F.lit(1), F.col("num_tokens").cast("int")), lambda x: x + 10 * F.col("sample_id").cast("int"))).withColumn("labels", F.col("input_ids"))
    cut = in_order(s, 6)
    part = lambda c: F.slice(c, F.col("skip") + 1, F.col("n"))
    packs = pk.gather_packs(cut.select("source", "pack", "at", part("input_ids").alias("ids"), part("labels").alias("labels")),
                            keys=["source", "pack"]).orderBy("pack").collect()
    assert packs[0]["input_ids"] == [1, 2, 3, 11, 12, 13]
    assert packs[0]["cumulative_len"] == [0, 3, 6] and packs[0]["position_ids"] == [0, 1, 2, 0, 1, 2]
    assert packs[2]["cumulative_len"] == [0, 6]


def test_range_conserves_tokens(spark):
    docs = inputs.document_lengths(spark, SF)
    plan = pk.range_plan(docs, 777)
    total = {r["source"]: r["t"] for r in docs.groupBy("source").agg(F.sum("num_tokens").alias("t")).collect()}
    got = {r["source"]: r["t"] for r in plan.groupBy("source").agg(F.sum("n").alias("t")).collect()}
    assert got == {s: t // 777 * 777 for s, t in total.items() if t >= 777}


def walk(values, limit, drop):
    """Next-fit in one pass."""
    bins, fill, out = -1, None, []
    for i, n in values:
        if drop and n > limit:
            continue
        if fill is None or fill + n > limit:
            bins, fill = bins + 1, 0
        out.append((i, bins, fill))
        fill += n
    return sorted(out)


@pytest.mark.parametrize("drop", [True, False])
@pytest.mark.parametrize("segment", [1, 3, 16, 10_000])
def test_next_fit_equals_one_pass(spark, drop, segment, monkeypatch):
    monkeypatch.setattr(pk, "FAN", 3)  # a tree of several levels
    rnd = random.Random(segment)
    values = [rnd.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(150)] + [500] * 3
    df = lengths(spark, values)
    order = [r["sample_id"] for r in df.orderBy(od.shuffle_key("sample_id"), "sample_id").collect()]
    for limit in (13, 60, 10_000):
        got = rows(pk.next_fit(df, limit, drop_oversize=drop, segment=segment), "sample_id", "bin", "at")
        assert sorted(got) == walk([(i, values[i]) for i in order], limit, drop)


def test_soft_pack_golden():
    assert [b for _, b, _ in walk(list(enumerate([2, 3, 7, 9, 4, 12])), 9, False)] == [0, 0, 1, 2, 3, 4]


def test_partition_independence(spark):
    docs = inputs.document_lengths(spark, SF)
    first = None
    for n in (1, 7, 64):
        d = docs.repartition(n)
        got = (rows(pk.range_plan(d, 512)), rows(pk.next_fit(d, 512, drop_oversize=False)),
               rows(bt.length_grouped(d.select("sample_id", F.col("num_tokens").alias("length")), 2, 2)))
        first = first or got
        assert got == first


def test_running_over_chunks_and_hot_key(spark):
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
                               "id", (F.col("id") % 7).alias("v"))
    expect = {}
    seen = {}
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{i}"
        expect[i] = seen.setdefault(k, [0, 0])[:]
        seen[k][0] += 1
        seen[k][1] += i % 7
    got = od.running(df, order=["id"], bucket=od.chunk_bucket("id", 16), keys=["k"], index="i", sums={"s": F.col("v")}, totals={"n": "i"}).collect()
    assert all([r["i"], r["s"]] == expect[r["id"]] and r["n"] == seen[r["k"]][0] for r in got) and len(got) == n


def test_previous_row_across_chunks(spark):
    df = spark.range(50).select(F.lit(1).alias("k"), "id")
    for ahead in (False, True):
        got = od.previous_row(df, order="id", bucket=od.chunk_bucket("id", 4), keys=["k"], cols={"p": "id"}, ahead=ahead).collect()
        step = 1 if ahead else -1
        assert all(r["p"] == (r["id"] + step if 0 <= r["id"] + step < 50 else None) for r in got)


def test_sample_ratio(spark):
    df = spark.range(5)
    got = od.sample_ratio(df, "id", 2.5).groupBy("id").count().collect()
    assert sum(r["count"] for r in got) == 12 and sorted(r["count"] for r in got) == [2, 2, 2, 3, 3]
    assert od.sample_exact(df, "id", 99).count() == 5


def test_round_up_and_stripes(spark):
    df = spark.range(5).select("id", F.col("id").alias("pos"), F.lit(5).cast("long").alias("n"))
    up = bt.stripe(bt.round_up(df, 2, 2), 2)
    by = lambda r: [x["id"] for x in up.where(f"rank = {r}").orderBy("step").collect()]
    assert by(0) == [0, 2, 4, 1] and by(1) == [1, 3, 0, 2]
    down = bt.stripe(bt.drop_remainder(df, 2), 2)
    assert rows(down, "rank", "step", "id") == [(0, 0, 0), (0, 1, 2), (1, 0, 1), (1, 1, 3)]


def test_length_grouped_is_a_permutation(spark):
    docs = inputs.document_lengths(spark, SF).select("sample_id", F.col("num_tokens").alias("length"))
    signed = docs.withColumn("length", F.when(F.col("sample_id") % 3 == 0, -F.col("length")).otherwise(F.col("length")))
    n = docs.count()
    for plan in (bt.length_grouped(docs, 2, 2), bt.length_grouped_by_rank(docs, 2, 2), bt.length_grouped_by_modality(signed, 2, 2),
                 bt.length_grouped_by_modality(docs, 2, 2)):
        assert sorted(r["pos"] for r in plan.collect()) == list(range(n))
    top = bt.length_grouped(docs, 2, 2).where("pos = 0").collect()[0]["length"]
    assert top == docs.agg(F.max("length")).collect()[0][0]
    assert rows(bt.length_grouped_by_modality(docs, 2, 2)) == rows(bt.length_grouped(docs, 2, 2))


def test_pad_to_multiple_and_efficiency(spark):
    df = spark.createDataFrame([(list(range(6)), list(range(6)), [0, 3, 6], [0, 1, 2, 0, 1, 2])],
                               "input_ids array<int>, labels array<int>, cumulative_len array<int>, position_ids array<int>")
    got = bt.pad_to_multiple(df, 4).collect()[0]
    assert got["cumulative_len"] == [0, 3, 6, 8] and got["attention_mask"] == [True] * 6 + [False] * 2 and len(got["input_ids"]) == 8
    same = bt.pad_to_multiple(df, 3).collect()[0]
    assert same["cumulative_len"] == [0, 3, 6] and same["attention_mask"] is None
    plan = spark.createDataFrame([("a", 0, 2), ("a", 1, 7), ("a", 2, 3), ("a", 3, 9), ("b", 0, 2), ("b", 1, 3), ("b", 2, 7), ("b", 3, 9)],
                                 "strategy string, pos bigint, length bigint")
    assert {r["strategy"]: round(r["efficiency"], 3) for r in bt.padding_report(plan, 2).collect()} == {"a": 0.656, "b": 0.875}
