import math

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from turnmill.operators import metrics as mt
from turnmill.operators import pairs as pr
from turnmill.operators import profile as pf
from turnmill.operators import regions as rg
from turnmill.operators import rl
from turnmill.plans import presets


def test_gae_golden_in_any_chunking(spark):
    df = spark.createDataFrame([(1, s, float(r), 0.5) for s, r in enumerate([0, 0, 1])], "traj_id bigint, step bigint, reward double, value double")
    for chunk in (1, 2, 100):
        got = rows(rl.gae(df, gamma=1.0, lam=0.5, chunk=chunk), "step", "advantage", "ret")
        assert got == [(0, 0.125, 0.625), (1, 0.25, 0.75), (2, 0.5, 1.0)]
    one = spark.createDataFrame([([0.0, 0.0, 1.0], [0.5, 0.5, 0.5])], "r array<double>, v array<double>")
    assert rows(one.select(rl.gae_arrays("r", "v", gamma=1.0, lam=0.5))) == [([0.125, 0.25, 0.5],)]


def test_reward_normalise_golden(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0)], "batch bigint, reward double")
    got = sorted(r["reward"] for r in rl.reward_normalise(df).collect())
    assert got == pytest.approx([(x - 2) / math.sqrt(1.00001) for x in (1, 2, 3)])


def test_kl_rewards(spark):
    df = spark.createDataFrame([(0, 2, -1.0, -2.0, 9.0), (1, 2, -1.0, -2.0, 9.0)],
                               "step bigint, n_steps bigint, policy_lp double, ref_lp double, score double")
    assert [r["kl_reward"] for r in rl.kl_rewards(df).orderBy("step").collect()] == [-0.01, 9.0]


def test_boxes(spark):
    df = spark.range(1).select(
        rg.normalised_box(*[F.lit(float(v)) for v in (10, 20, 30, 40, 100, 200)]).alias("box"),
        mt.box_iou(F.array(*[F.lit(v) for v in (0, 0, 9, 9)]), F.array(*[F.lit(v) for v in (5, 0, 14, 9)])).alias("iou"))
    r = df.collect()[0]
    assert r["box"] == [5, 20, 20, 60] and round(r["iou"], 3) == 0.333


def test_tiles(spark):
    g = rg.closest_grid(F.lit(800), F.lit(400))
    r = spark.range(1).select(g["i"], g["j"], rg.vision_tiles(g)).collect()[0]
    assert tuple(r) == (2, 1, 3) and rg.patch_tokens() == 256


def test_circular(spark):
    p = spark.createDataFrame([(1, "B"), (1_000_001, "The answer is C"), (2, "Because B"), (3, "AB")], "index bigint, prediction string")
    a = spark.createDataFrame([(1, "B", "x"), (1_000_001, "C", "x"), (2, "B", "coarse_perception"), (3, "A", "x")],
                              "index bigint, answer string, category string")
    assert rows(mt.circular_hits(p, a)) == [(1, 1), (2, 1), (3, 0)]
    assert rows(mt.circular_accuracy(p, a), "ability", "n") == [("Average", 3), ("CP", 1), ("x", 2)]


def test_micro_and_macro(spark):
    data = [("anatomy", 1, 1)] + [("virology", 0, 1)] * 3
    got = {(r["level"], r["name"]): r["accuracy"] for r in mt.hierarchical_accuracy(
        spark.createDataFrame(data, "subject string, pred int, gt int")).collect()}
    assert got[("category", "other (business, health, misc.)")] == 25.0 and got[("average", "average")] == 50.0


def test_orpo_skips_nan_rows(spark):
    cols = "policy_chosen double, policy_rejected double"
    both = pr.orpo_report(spark.createDataFrame([(-0.5, -1.0), (0.5, -1.0)], cols), 1.0).collect()[0]
    one = pr.orpo_report(spark.createDataFrame([(-0.5, -1.0)], cols), 1.0).collect()[0]
    assert both["log_odds_ratio"] == one["log_odds_ratio"]


def test_parameter_checks(spark):
    with pytest.raises(ValueError, match="needs packing"):
        presets.check_corpus_options(varlen=True, pack=False, split="train", batch=1, max_length=8)
    with pytest.raises(ValueError, match="batch size 1"):
        presets.check_corpus_options(varlen=True, pack=True, split="train", batch=2, max_length=8)
    with pytest.raises(ValueError, match="train split"):
        presets.check_corpus_options(varlen=False, pack=True, split="test", batch=1, max_length=8)
    with pytest.raises(ValueError, match="missing column"):
        pf.require_columns(spark.range(1), {"text": "string"})


def test_build_preset(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lit("c").alias("instruction"), F.col("lang").alias("input"), F.col("text").alias("output"))
    packs = presets.build_preset(docs, "alpaca", id_col="doc_id")
    sizes = {len(r["input_ids"]) for r in packs.collect()}
    assert sizes == {2048}
