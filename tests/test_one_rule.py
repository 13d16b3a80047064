"""Both forms of an operator give the same rows: null texts, null system texts, unknown roles, rejects, any chunk size."""

import os
import random

import pytest
from conftest import rows

from turnmill.operators import encode as en
from turnmill.operators import formats as fm
from turnmill.operators import pairs as pr
from turnmill.operators import render as rn
from turnmill.operators import rl
from turnmill.plans.presets import dialogue_rejects, encode_dialogues
from turnmill.sources import readers as rd

SCHEMA = "sample_id long, turn long, role string, content string, name string"


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(11)
    data = []
    for s in range(60):
        known = ["user", "assistant", "system"] if s % 3 else ["user", "assistant", "assistant", "tool", "thought"]
        for t in range(rng.randint(1, 9)):
            role = None if s % 17 == 5 and t == 1 else rng.choice(known)
            data.append((s, t, role, rng.choice([None, "", "a b", "c", "d  e"]), None))
    return spark.createDataFrame(data, SCHEMA).cache()


def forms(messages):
    plain = messages.drop("name")
    return {
        "pair_turns": lambda **k: fm.pair_turns(plain, **k),
        "qwen_chat": lambda **k: encode_dialogues(plain, "qwen_chat", max_length=9, **k),
        "minicpm": lambda **k: encode_dialogues(plain, "minicpm", max_length=9, **k),
        "encode_messages": lambda **k: en.encode_messages(plain, "llama3", max_length=9, **k),
        "merge_sub_roles": lambda **k: rn.merge_sub_roles(messages, **k),
        "encode_markup": lambda **k: en.encode_markup(messages, max_length=9, **k),
        "react_turns": lambda **k: fm.react_turns(plain, **k),
    }


@pytest.mark.parametrize("name", ["pair_turns", "qwen_chat", "minicpm", "encode_messages", "merge_sub_roles", "encode_markup", "react_turns"])
def test_forms_agree(messages, name):
    run = forms(messages)[name]
    short = rows(run(bounded=True))
    assert short
    cols = sorted(run(bounded=True).columns)
    for chunk in (1, 2, 8192):
        assert rows(run(chunk=chunk), *cols) == rows(run(bounded=True), *cols), chunk


def test_rejects_have_no_tokens_and_are_listed(messages):
    plain = messages.drop("name")
    coded = encode_dialogues(plain, "minicpm", max_length=99)
    assert coded.where("input_ids is null or num_tokens <> size(input_ids)").count() == 0
    listed = {r["sample_id"]: r["reason"] for r in dialogue_rejects(plain, "minicpm").collect()}
    assert set(listed.values()) == {"unknown role", "system text without a place"}
    assert not {r["sample_id"] for r in coded.collect()} & set(listed)


def test_gae_forms_agree(spark):
    rng = random.Random(2)
    data = [(t, s, rng.random(), rng.random()) for t in range(5) for s in range(rng.randint(1, 12))]
    df = spark.createDataFrame(data, "traj_id long, step long, reward double, value double")
    want = {(r["traj_id"], r["step"]): round(r["advantage"], 9) for r in rl.gae(df, lam=0.9, bounded=True).collect()}
    for chunk in (1, 3, 1024):
        assert {(r["traj_id"], r["step"]): round(r["advantage"], 9) for r in rl.gae(df, lam=0.9, chunk=chunk).collect()} == want


def test_ipo_works_on_averages_of_unequal_lengths(spark):
    lp = spark.createDataFrame([(1, -6.0, -4.0, -3.0, -3.0, 3, 2)],
                               "pair_id long, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double, n_chosen long, n_rejected long")
    out = pr.dpo_losses(lp, beta=0.1).first()
    # chosen (-6 + 3) / 3 = -1, rejected (-4 + 3) / 2 = -0.5; (-0.5 - 5)^2
    assert out["loss_ipo"] == pytest.approx(30.25)
    assert out["chosen_reward"] == pytest.approx(-0.3)


def test_orpo_means_are_over_all_pairs(spark):
    lp = spark.createDataFrame([(-1.0, -2.0), (0.0, -1.0), (0.0, 0.0)], "policy_chosen double, policy_rejected double")
    out = pr.orpo_report(lp, 0.5).first()
    assert out["chosen_rewards"] == pytest.approx(-1 / 30) and out["reward_acc"] == pytest.approx(2 / 3)
    assert out["log_odds_chosen"] != out["log_odds_chosen"]  # not a number: one pair has no odds
    assert -1 < out["log_odds_ratio"] < 0 and out["loss"] == pytest.approx(0.5 - 0.1 * out["log_odds_ratio"])


def test_combined_reward_loss(spark):
    sc = spark.createDataFrame([("a", 1.0, 0.0), ("a", 0.0, 2.0)], "ds string, chosen double, rejected double")
    for loss, penalty in (("ranking", "l2"), ("focal", "log_barrier"), ("ranking", "none")):
        r = pr.reward_losses(sc, by=["ds"], loss=loss, penalty=penalty, penalty_weight=0.5).first()
        assert r["loss"] == pytest.approx(r[f"{loss}_loss"] + (0.5 * r[penalty] if penalty != "none" else 0))


def test_a_batch_of_one_row_is_normalised(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 4.0)], "batch long, reward double")
    got = [r["reward"] for r in rl.reward_normalise(df).orderBy("batch", "ori_reward").collect()]
    assert got[0] == 0 and None not in got


def test_malformed_tools_are_listed_without_parameters():
    text = ('x {"name": "a", "description": "A", "paths": [{"parameters": [{"name": "p"}]}]} {"name": "b", "description": 5} '
            '{"name": "c", "description": "C", "paths": {"q": 1}} {bad {"name": "d", "description": "D", "paths": [{"parameters": [{"name": "p", "description": "P"}]}]}')
    tools = fm.tool_objects(text)
    assert [t["name"] for t in tools] == ["a", "c", "d"]
    assert [fm.tool_parameters(t) for t in tools] == ["", "", "\n输入参数: {'p': 'P'}"]


def test_offsets_of_lines_that_end_in_cr_lf(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ab\r\ncd\r\n\r\ne")
    got = rows(rd.number_lines(rd.read_lines(spark, str(tmp_path))), "line_no", "offset")
    assert got == [(0, 0), (1, 4), (2, 8), (3, 10)]


def test_content_keys_follow_the_bytes_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rd, "BLOCK_BYTES", 4)
    for name, data in {"a": b"0123456789", "b": b"0123456789", "c": b"0123456780", "d": b""}.items():
        (tmp_path / name).write_bytes(data)
    keys = {r["path"][-1]: r["file_key"] for r in rd.content_keys(spark, str(tmp_path), "v").collect()}
    assert set(keys) == set("abc") and keys["a"] == keys["b"] != keys["c"]


def test_staged_folders_end_with_their_block(spark, tmp_path):
    from turnmill.session import fresh_path, stage, staging
    kept = fresh_path(spark, "kept")
    with staging(spark):
        df = stage(spark.range(5), "inner")
        inner = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
        df.write.parquet(kept)
        assert os.path.isdir(inner)
    assert not os.path.exists(inner) and spark.read.parquet(kept).count() == 5


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from turnmill.session import shared_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        shared_dir(cluster)
