import pytest
from conftest import SF, rows
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.functions import tokens as tk
from turnmill.functions.text import fill
from turnmill.operators import encode as en
from turnmill.operators import pairs as pr
from turnmill.operators import render as rn
from turnmill.plans import inputs


class Digits:
    """Encoder for golden cases: words are numbers already."""

    bos, eos, version, in_jvm = (1,), (2,), "digits", True

    def ids(self, c) -> Column:
        return F.transform(tk.words(c), lambda w: w.cast("int"))

    def length(self, c) -> Column:
        return F.size(tk.words(c))


TURN = "array<struct<input:string,output:string,output_with_loss:boolean,need_eos_token:boolean,sep:string>>"


@pytest.mark.parametrize("eos,ids,labels", [
    (True, [1, 5, 6, 2, 1, 7, 8, 2], [-100, -100, 6, 2, -100, -100, 8, 2]),
    (False, [1, 5, 6, 7, 8], [-100, -100, 6, -100, 8]),
])
def test_encode_golden(spark, eos, ids, labels):
    conv = [("5", "6", True, eos, ""), ("7", "8", True, eos, "")]
    got = en.encode_conversation(spark.createDataFrame([(conv,)], f"conversation {TURN}"), Digits(), max_length=99).collect()[0]
    assert (got["input_ids"], got["labels"], got["num_tokens"]) == (ids, labels, len(ids))
    long = spark.createDataFrame([(1, 0, True, *conv[0]), (1, 1, False, *conv[1])],
                                 "sample_id bigint, turn_no bigint, is_first boolean, input string, output string, "
                                 "output_with_loss boolean, need_eos_token boolean, sep string")
    for chunk in (1, 50):
        got = en.encode_sft(long, Digits(), max_length=99, chunk=chunk).collect()[0]
        assert (got["input_ids"], got["labels"]) == (ids, labels)


def test_cut_at_max_length_in_any_chunking(spark):
    long = spark.createDataFrame([(1, i, i == 0, "5 5", "6 6", True, False, "9") for i in range(20)],
                                 "sample_id bigint, turn_no bigint, is_first boolean, input string, output string, "
                                 "output_with_loss boolean, need_eos_token boolean, sep string")
    whole = en.encode_sft(long, Digits(), max_length=1000).collect()[0]["input_ids"]
    for chunk in (1, 3, 100):
        assert en.encode_sft(long, Digits(), max_length=17, chunk=chunk).collect()[0]["input_ids"] == whole[:17]


def test_input_only(spark):
    long = spark.createDataFrame([(1, 0, "5 6", "7")], "sample_id bigint, turn_no bigint, input string, output string")
    got = en.encode_turns(long, Digits(), with_output=False).collect()[0]
    assert got["ids"] == [1, 5, 6] and got["labels"] == [-100] * 3 and got["n"] == 3


def test_user_encoder_matches_jvm_encoder(spark):
    import hashlib
    slow = tk.UserEncoder(lambda t: [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) + 1 for w in t.split(" ") if w], bos=(1,), eos=(2,))
    docs = inputs.table(spark, SF, "documents")
    assert docs.where(slow.ids("text") != tk.HashEncoder().ids("text")).count() == 0


def test_signed_tokens(spark):
    df = spark.createDataFrame([([1, -3, 0, 4],)], "tokens array<int>").select(
        tk.signed_to_ids("tokens").alias("i"), tk.signed_to_labels("tokens").alias("l"))
    assert rows(df) == [([1, 3, 0, 4], [1, -100, -100, 4])]


def test_rl_labels(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "p array<int>, r array<int>").select(en.rl_labels("p", "r"))
    assert rows(df) == [([-100, 3, 4, -100],)]


def test_templates(spark):
    t = catalog.TEMPLATES["qwen_chat"]
    df = spark.createDataFrame([("S", "{round}?", "o", 0)], "system string, input string, output string, turn_no int")
    got = rn.render_turns(df, "qwen_chat").collect()[0]
    assert got["input"] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n{round}?<|im_end|>\n<|im_start|>assistant\n"
    assert (got["output"], got["need_eos_token"], got["sep"]) == ("o<|im_end|>", False, "\n") and t.suffix_as_eos
    second = spark.createDataFrame([("", "q", "o", 1)], "system string, input string, output string, turn_no int")
    assert rn.render_turns(second, "chatglm2").collect()[0]["input"] == "[Round 2]\n\n问：q\n\n答："
    assert rn.render_turns(df, "minicpm").collect()[0]["input"] is None  # a system text without a place
    assert len(catalog.TEMPLATES) == 28 and not any(rn.template_faults(t) for t in catalog.TEMPLATES.values())
    assert rn.chat_template_faults({"user": "{usr}", "function_call": "{assistant}"}) == [
        "user lacks {user}", "function_call lacks {function_call}"]


def test_fill_is_one_pass(spark):
    df = spark.range(1).select(fill("a {input} b {round}", input=F.lit("{round}"), round=F.lit("7")))
    assert rows(df) == [("a {round} b 7",)]


def test_pair_labels(spark):
    msg = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([([("user", "1 2")], [("assistant", "3 4")], [("assistant", "5")])],
                               f"prompt {msg}, chosen {msg}, rejected {msg}")
    plain = catalog.ChatTemplate(system="{system} ", user="{user} ", assistant="{assistant}", sep="")
    got = pr.encode_pairs(df, plain, Digits(), max_length=9).collect()[0]
    assert got["chosen_ids"] == [1, 2, 3, 4] and got["chosen_labels"] == [-100, -100, 3, 4]
    got = pr.encode_pairs(df, plain, Digits(), max_length=2, reward_token=99).collect()[0]
    assert got["chosen_ids"] == [1, 2, 99] and got["chosen_labels"] == [-100, -100, 0] and got["rejected_labels"] == [-100, -100, 1]
    with pytest.raises(ValueError):
        pr.preference_set(df, plain, max_length=9, is_dpo=True, is_reward=True)


def test_image_pieces(spark):
    df = spark.createDataFrame([("5 <image> 6",), ("5",), ("<image><image>",)], "t string").select(en.image_pieces("t", Digits()))
    assert [r[0] for r in df.collect()] == [[5, -200, 6], [5], None]


def test_tool_dialogue_mask_and_cut(spark):
    parts = [(1, "10 11", t, k, key, v) for t in (1, 2) for k, (key, v) in enumerate(
        [("Human", "20"), ("Tool Responses", "<|Results|>: 30 31 <eor>\n"), ("MOSS", "40")])]
    df = spark.createDataFrame(parts, "sample_id bigint, meta_instruction string, turn_no bigint, key_no int, key string, value string")
    got = en.encode_tool_dialogue(df, max_length=10, bot_name=None).collect()[0]
    assert got["n_turns"] == 1 and got["num_tokens"] == 9
    assert [x == -100 for x in got["labels"]] == [True] * 3 + [False, False, True, True, False, False]
    assert en.encode_tool_dialogue(df, max_length=4).count() == 0


def test_short_and_long_dialogues_agree(spark):
    """Chunks of one or two messages force the long form; results are the same."""
    from turnmill.operators import formats as fm
    from turnmill.plans.formats import _react_messages
    from turnmill.plans.presets import encode_dialogues
    from turnmill.plans.rendering import sub_role_messages
    m = inputs.messages(spark, SF)
    for fn in (lambda c: fm.pair_turns(m, chunk=c), lambda c: encode_dialogues(m, "chatglm2", max_length=150, chunk=c),
               lambda c: en.encode_messages(m, "llama3", max_length=150, chunk=c),
               lambda c: rn.merge_sub_roles(sub_role_messages(spark, SF), chunk=c),
               lambda c: en.encode_markup(sub_role_messages(spark, SF), max_length=150, chunk=c),
               lambda c: fm.react_turns(_react_messages(spark, SF), chunk=c)):
        whole = fn(8192)
        cut = fn(3)
        assert rows(whole) == rows(cut.select(*whole.columns)) and whole.count() > 0


def test_python_tokenizer_gives_the_same_corpus(spark):
    import hashlib
    from turnmill.plans.presets import encode_dialogues
    slow = tk.UserEncoder(lambda t: [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) + 1 for w in t.split(" ") if w], bos=(1,), eos=(2,))
    m = inputs.messages(spark, SF)
    assert rows(encode_dialogues(m, "qwen_chat", slow, max_length=100)) == rows(encode_dialogues(m, "qwen_chat", max_length=100))
    assert rows(en.encode_messages(m, "qwen2", slow, max_length=100)) == rows(en.encode_messages(m, "qwen2", max_length=100))


def test_bos_policies():
    assert tk.bos_ids("qwen") == () and tk.bos_ids("chatglm") == (64790, 64792) and tk.bos_ids("llama", 1) == (1,)


def test_lengths_and_labels_do_not_encode_inputs(spark):
    conv = [("a b", "c", True, True, ""), ("d " * 50, "e  f", True, True, "g"), (None, "", False, True, "")]
    coded = en.encode_conversation(spark.createDataFrame([(conv,)], f"conversation {TURN}"), tk.HashEncoder(), max_length=40)
    counted = en.drop_unsupervised(coded).agg(F.count("*"), F.sum("num_tokens"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1 and tuple(counted.collect()[0]) == (1, 40)
    got = coded.collect()[0]
    ids = [int(i) for i in spark.range(1).select(tk.HashEncoder().ids(F.lit("a b c" + " d" * 50))).collect()[0][0]]
    assert got["input_ids"] == [1, *ids[:3], 2, 1, *ids[3:37]] and got["labels"] == [-100] * 3 + [ids[2], 2] + [-100] * 35
