"""The corpus build as one function, its checks, and the ready-made corpora."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.tokens import HashEncoder
from turnmill.operators.encode import (drop_empty, drop_unsupervised, encode_conversation, encode_sft,
                                       encode_tool_dialogue)
from turnmill.operators.formats import message_arrays, normalise, pair_turns, tool_parts, unknown_roles
from turnmill.operators.order import CHUNK, sample_exact
from turnmill.operators.pack import pack_range
from turnmill.operators.render import render_conversation, render_turns
from turnmill.session import stage


@dataclass(frozen=True)
class Preset:
    fmt: str
    template: str = "default"
    max_length: int = 2048
    pack: bool = True
    shuffle: bool = True


# Ready-made corpora and their formats.
PRESETS: dict[str, Preset] = {
    "alpaca": Preset("alpaca"),
    "alpaca_zh": Preset("alpaca_zh"),
    "arxiv": Preset("arxiv"),
    "code_alpaca": Preset("code_alpaca"),
    "colorist": Preset("colors"),
    "law_crime": Preset("crime_kg_assitan"),
    "law_reference": Preset("law_reference"),
    "medical": Preset("medical"),
    "oasst1": Preset("oasst1"),
    "open_orca": Preset("openorca"),
    "sql": Preset("sql"),
    "tiny_codes": Preset("tiny_codes"),
    "wizardlm": Preset("wizardlm"),
}
# Mixes of presets.
MIXES = {"alpaca_en_zh": ("alpaca", "alpaca_zh"), "lawyer": ("law_crime", "law_reference")}


def check_corpus_options(*, varlen: bool, pack: bool, split: str | None, batch: int, max_length: int, sp: int = 1) -> None:
    """Option rules, checked before any plan is built."""
    faults = []
    if varlen and not pack:
        faults.append("variable-length attention needs packing")
    if pack and split not in (None, "train"):
        faults.append("packing needs the train split or all splits")
    if varlen and batch != 1:
        faults.append("variable-length attention needs batch size 1")
    if varlen and max_length % sp:
        faults.append("max_length must divide by the sequence-parallel size")
    if faults:
        raise ValueError("; ".join(faults))


def encode_corpus(records: DataFrame, fmt: str, template: str, encoder=HashEncoder(), *, id_col: str, max_length: int,
                  sample_n: int | None = None, rename: dict[str, str] | None = None,
                  keep: list[str] | None = None) -> DataFrame:
    """Sample -> normalise -> drop empty -> render -> rename and prune -> encode -> drop unsupervised.

    Record-shaped input only; every step but the optional sample is a narrow transformation.
    """
    if sample_n is not None:
        records = sample_exact(records, id_col, sample_n)
    turns = render_conversation(drop_empty(normalise(records, fmt)), template)
    if rename:
        turns = turns.withColumnsRenamed(rename)
    turns = turns.select(id_col, *(keep or []), "conversation")
    coded = encode_conversation(turns, encoder, max_length=max_length).drop("conversation")
    return drop_unsupervised(coded)


def encode_dialogues(messages: DataFrame, template: str, encoder=HashEncoder(), *, max_length: int,
                     sample: str = "sample_id", order: str = "turn", loss: str | None = None,
                     chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Flat message table -> ``(sample, input_ids, labels, num_tokens)``.

    Dialogues stay in long form to the end.  ``bounded`` is the caller's word that every dialogue is short:
    they are then gathered by one shuffle and paired, rendered and encoded in place, with the same rows.
    Encoders that run in Python take the long form throughout, because a fold over an array cannot call
    them.  Rejects give no row: dialogues with unknown roles (see ``pair_turns``), and dialogues with a
    system text where the template has no place for it; ``dialogue_rejects`` lists both.
    """
    def long(rows: DataFrame) -> DataFrame:
        turns = render_turns(pair_turns(rows, sample=sample, order=order, loss=loss, chunk=chunk), template)
        return encode_sft(turns, encoder, sample=sample, max_length=max_length, chunk=chunk)

    def short(rows: DataFrame) -> DataFrame:
        cols = ["role", "content", *([loss] if loss else [])]
        turns = drop_empty(normalise(message_arrays(rows, sample=sample, order=order, cols=cols), "openai"))
        coded = encode_conversation(render_conversation(turns, template), encoder, max_length=max_length)
        return coded.where(F.col("input_ids").isNotNull()).select(sample, "input_ids", "labels", "num_tokens")

    return short(messages) if bounded and encoder.in_jvm else long(messages)


def dialogue_rejects(messages: DataFrame, name: str, *, sample: str = "sample_id", order: str = "turn",
                     role: str = "role", text: str = "content") -> DataFrame:
    """``(sample, reason)`` of the dialogues that ``encode_dialogues`` leaves out, one row each.

    ``unknown role`` goes before ``system text without a place``, which concerns turns that are answered.
    """
    roles = unknown_roles(messages, role).select(sample).distinct().withColumn("reason", F.lit("unknown role"))
    turns = render_turns(pair_turns(messages, sample=sample, order=order, role=role, text=text), name)
    placeless = turns.where(F.col("input").isNull()).select(sample).distinct().withColumn("reason", F.lit("system text without a place"))
    return roles.unionByName(placeless)


def build_preset(records: DataFrame, name: str, encoder=HashEncoder(), *, id_col: str, varlen: bool = False, split: str | None = None,
                 batch: int = 1, sp: int = 1) -> DataFrame:
    """Encoded samples of a preset, or its packs where the preset packs.

    ``varlen``, ``split``, ``batch`` and ``sp`` are those of the run the corpus is for; what does not go together is refused here.
    """
    p = PRESETS[name]
    check_corpus_options(varlen=varlen, pack=p.pack, split=split, batch=batch, max_length=p.max_length, sp=sp)
    coded = encode_corpus(records, p.fmt, p.template, encoder, id_col=id_col, max_length=p.max_length)
    coded = coded.withColumn("source", F.lit(name))
    return pack_range(stage(coded, name), p.max_length, sample=id_col, shuffle=p.shuffle) if p.pack else coded


def build_mix(records: dict[str, DataFrame], encoder=HashEncoder(), *, id_col: str) -> DataFrame:
    """Several presets as one corpus; each keeps its name in ``source`` and its own packs."""
    out = None
    for name, rows in records.items():
        part = build_preset(rows, name, encoder, id_col=id_col)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def build_tool_dialogues(records: dict[str, DataFrame], encoder=HashEncoder(), *, id_col: str, max_length: int = 2048,
                         bot_name: str | None = None) -> DataFrame:
    """Tool-dialogue corpora (with and without plugins) from nested records, as one corpus."""
    out = None
    for name, rows in records.items():
        part = encode_tool_dialogue(tool_parts(rows, sample=id_col), encoder, max_length=max_length,
                                    bot_name=bot_name, sample=id_col).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
