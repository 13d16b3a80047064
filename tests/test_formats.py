from conftest import rows
from pyspark.sql import functions as F

import pytest

from turnmill.operators import formats as fm

MESSAGES = "sample_id bigint, turn bigint, role string, content string"


def turns_of(df):
    return [[(t["system"], t["input"], t["output"]) for t in r["conversation"]] for r in df.collect()]


def test_oasst1_drops_unanswered(spark):
    df = spark.createDataFrame([("### Human: a### Assistant: b### Human: c",)], "text string")
    assert turns_of(fm.normalise(df, "oasst1")) == [[(None, "a", "b")]]


def test_openai_pairing_array_and_long_form_agree(spark):
    said = [("assistant", "x"), ("system", "s"), ("user", "a"), ("user", "b"), ("assistant", "y"), ("user", "c")]
    record = spark.createDataFrame([([{"role": r, "content": c} for r, c in said],)],
                                   "messages array<struct<role:string,content:string>>")
    assert turns_of(fm.normalise(record, "openai")) == [[("s", "ab", "y")]]
    flat = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(said)], MESSAGES)
    for chunk in (1, 2, 100):
        got = rows(fm.pair_turns(flat, chunk=chunk), "system", "input", "output", "is_first")
        assert got == [("s", "ab", "y", True)]


def test_loss_flag(spark):
    record = spark.createDataFrame([([("user", "q", None), ("assistant", "a", "False")],)],
                                   "messages array<struct<role:string,content:string,loss:string>>")
    conv = fm.normalise(record, "openai").collect()[0]["conversation"]
    assert conv[0]["output_with_loss"] is False


def test_unknown_role_is_a_reject(spark):
    record = spark.createDataFrame([([("narrator", "q"), ("assistant", "a")],)],
                                   "messages array<struct<role:string,content:string>>")
    assert fm.rejects(fm.normalise(record, "openai")).count() == 1


def test_alpaca_nooutput_and_colors(spark):
    df = spark.createDataFrame([("i", "x", "<nooutput>"), ("i", "x", "o")], "instruction string, input string, output string")
    assert turns_of(fm.normalise(df, "alpaca")) == [[], [(None, "i\nx", "o")]]
    df = spark.createDataFrame([("Name: deep: sea ", "#001"), ("no mark", "#002")], "description string, color string")
    assert [t[0][1] for t in turns_of(fm.normalise(df, "colors"))] == ["deep: sea", ""]


def test_llava_moves_image(spark):
    df = spark.createDataFrame([([("human", "what is <image> this"), ("gpt", "a cat")],)],
                               "conversations array<struct<from:string,value:string>>")
    assert turns_of(fm.normalise(df, "llava")) == [[(None, "<image>\nwhat is  this", "a cat")]]


def test_positional_pairs_odd_is_reject(spark):
    schema = "conversations array<struct<role:string,value:string>>"
    df = spark.createDataFrame([([("user", "a"), ("model", "b")],), ([("user", "a")],)], schema)
    out = fm.normalise(df, "role_patient").collect()
    assert [(t["input"], t["output"]) for t in out[0]["conversation"]] == [("a", "b")]
    assert out[1]["conversation"] is None


def test_tool_parts_keep_key_order(spark):
    line = '{"chat": {"turn_1": {"Human": "h", "Tool Responses": "t", "MOSS": "m"}}, "num_turns": 1, "meta_instruction": "meta"}'
    df = spark.createDataFrame([(1, line)], "sample_id bigint, value string").select(
        "sample_id", F.from_json("value", "chat map<string,map<string,string>>, num_turns int, meta_instruction string").alias("j"))
    parts = fm.tool_parts(df.select("sample_id", "j.*")).orderBy("key_no").collect()
    assert [p["key"] for p in parts] == ["Human", "Tool Responses", "MOSS"]


def test_react_rejects_broken_call(spark):
    good = '<|startofthink|>{"api_name": "f", "parameters": {"a": 1}}<|endofthink|>'
    data = [(1, 0, "user", "q"), (1, 1, "assistant", good), (2, 0, "user", "q"),
            (2, 1, "assistant", "<|startofthink|>{broken<|endofthink|>"), (3, 0, "user", "alone")]
    got = rows(fm.react_turns(spark.createDataFrame(data, MESSAGES)), "sample_id", "input", "output")
    assert got == [(1, "q\n", "Action:f\nAction Input:{'a': 1}\n\n")]


def test_tool_listing_with_parameters(spark):
    text = ('tools: {"x": 1} {"name": "f", "description": "d", "paths": [{"parameters": [{"name": "p", "description": "pd"}]}]} end')
    df = spark.createDataFrame([(1, 0, "system", text), (1, 1, "user", "q"), (1, 2, "assistant", "a")], MESSAGES)
    system = fm.react_turns(df).collect()[0]["system"]
    assert "{'f': \"d\\n输入参数: {'p': 'pd'}\"}" in system and "[['f']]" in system


def test_registry(spark):
    assert len(fm.format_names()) >= 20
    with pytest.raises(ValueError):
        fm.register_format("alpaca", lambda d: d)
    with pytest.raises(ValueError):
        fm.normalise(spark.range(1), "nope")


def test_react_blocks(spark):
    call = lambda n: '<|startofthink|>```JSON\n{"api_name": "%s", "parameters": {}}```<|endofthink|>' % n
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a" + call("f") + "b" + call("g") + "tail<|startofthink|>open"),
            (2, 0, "user", "q"), (2, 1, "assistant", "x<|startofexec|>not closed"),
            (3, 0, "user", "q"), (3, 1, "assistant", "x<|startofexec|>[1]<|endofexec|> done "),
            (4, 0, "user", "q"), (4, 1, "assistant", "<|startofexec|>1<|endofexec|><|startofexec|>2<|endofexec|>"),
            (5, 0, "user", "q"), (5, 1, "assistant", "x<|startofexec|>[bad<|endofexec|> done")]
    got = rows(fm.react_turns(spark.createDataFrame(data, MESSAGES)), "sample_id", "system", "output")
    assert got == [
        (1, "", "Thought:a\nAction:f\nAction Input:{}\nThought:b\nAction:g\nAction Input:{}\ntail<|startofthink|>open\n"),
        (2, "", "Final Answer:x\n"), (3, "", "Final Answer:x\n"), (3, "Response:[1]\n", "Final Answer:done\n"),
        (5, "", "Final Answer:x\n")]


def test_dialogues_with_unknown_roles_are_rejects_in_both_forms(spark):
    from turnmill.plans.presets import encode_dialogues
    data = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "narrator", "n"), (2, 2, "assistant", "a")]
    df = spark.createDataFrame(data, MESSAGES)
    for chunk in (1, 100):
        assert rows(fm.pair_turns(df, chunk=chunk), "sample_id", "input", "output") == [(1, "q", "a")]
        assert rows(encode_dialogues(df, "default", max_length=9, chunk=chunk), "sample_id") == [(1,)]
    assert rows(fm.unknown_roles(df), "sample_id", "role") == [(2, "narrator")]


def test_official_keys_and_bare_lists(spark):
    message = "struct<role:string,content:string>"
    said = [("user", "q"), ("assistant", "a")]
    keyed = spark.createDataFrame([(1, said, None, None), (2, None, said, None), (3, None, None, said)],
                                  f"id int, messages array<{message}>, message_data array<{message}>, dialogs array<{message}>")
    bare = spark.createDataFrame([(1, said)], f"id int, record array<{message}>")
    for df, n in ((keyed, 3), (bare, 1)):
        got = fm.normalise(df, "openai").selectExpr("id", "inline(conversation)").collect()
        assert [(r["id"], r["input"], r["output"]) for r in sorted(got)] == [(k + 1, "q", "a") for k in range(n)]
    with pytest.raises(ValueError):
        fm.normalise(spark.range(1), "openai")
