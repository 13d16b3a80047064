"""Normalisers: raw record shapes -> the conversation model.

Two forms carry the same model.  *Array form*: one row per record with
``conversation array<struct<system,input,output,output_with_loss,need_eos_token>>``; used where a record
already arrives as one row (JSON lines, streams).  *Long form*: one row per turn,
``(sample_id, turn_no, system, input, output, output_with_loss)``; used for flat message tables, where a
conversation of any length stays spread over tasks.

A normaliser is registered by name with ``register_format``; a record that breaks its format's rules gets
a null conversation and is returned by ``rejects``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill import catalog
from turnmill.functions.text import after_first, blank_if_null, col, strip
from turnmill.functions.tokens import IMAGE_MARK
from turnmill.operators.order import CHUNK, chunk_bucket, int_div, join_keys, running

TURN = ("struct<system:string,input:string,output:string,"
        "output_with_loss:boolean,need_eos_token:boolean>")
CONVERSATION = f"array<{TURN}>"

Normaliser = Callable[[DataFrame], DataFrame]
_FORMATS: dict[str, Normaliser] = {}


def register_format(name: str, fn: Normaliser) -> None:
    """Add a normaliser (DataFrame -> DataFrame with a ``conversation`` column) under a name."""
    if name in _FORMATS:
        raise ValueError(f"format {name!r} is already registered")
    _FORMATS[name] = fn


def format_names() -> list[str]:
    return sorted(_FORMATS)


def normalise(df: DataFrame, fmt: str) -> DataFrame:
    if fmt not in _FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(format_names())}")
    return _FORMATS[fmt](df)


def rejects(df: DataFrame) -> DataFrame:
    return df.where(F.col("conversation").isNull())


def turn(input: Column, output: Column, system: Column | None = None, loss: Column | None = None,
         need_eos: bool = True) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (none if system is None else system).alias("system"),
        input.alias("input"),
        output.alias("output"),
        (F.lit(True) if loss is None else loss).alias("output_with_loss"),
        F.lit(need_eos).alias("need_eos_token"),
    ).cast(TURN)


def _no_turns() -> Column:
    return F.array().cast(CONVERSATION)


def _single(input: Callable[[], Column], output: str, system: str | None = None,
            system_col: str | None = None) -> Normaliser:
    def run(df: DataFrame) -> DataFrame:
        s = F.lit(catalog.SYSTEMS[system]) if system else (F.col(system_col) if system_col else None)
        return df.withColumn("conversation", F.array(turn(input(), F.col(output), s)))
    return run


def _two_lines(first: str, second: str) -> Callable[[], Column]:
    return lambda: F.concat(F.col(first), F.lit("\n"), F.col(second))


def _one(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


def alpaca(df: DataFrame) -> DataFrame:
    one = F.array(turn(_two_lines("instruction", "input")(), F.col("output")))
    return df.withColumn("conversation", F.when(F.col("output").eqNullSafe("<nooutput>"), _no_turns()).otherwise(one))


def colors(df: DataFrame) -> DataFrame:
    return df.withColumn("conversation", F.array(turn(
        strip(after_first("description", ":")), F.col("color"), F.lit(catalog.SYSTEMS["colorist"]))))


def pretrain(df: DataFrame) -> DataFrame:
    return df.withColumn("conversation", F.array(turn(F.lit(""), strip("text"), need_eos=False)))


def oasst1(df: DataFrame) -> DataFrame:
    """``### Human: .. ### Assistant: ..`` text; an unanswered last question is dropped."""
    pieces = F.transform(F.split(F.col("text"), "###"), strip)
    kept = F.filter(pieces, lambda p: p.startswith("Human:") | p.startswith("Assistant:"))
    bodies = F.transform(kept, lambda p: strip(
        F.when(p.startswith("Human:"), F.substring(p, 7, F.length(p))).otherwise(F.substring(p, 11, F.length(p)))))
    pairs = F.floor(F.size("_said") / 2).cast("int")
    turns = F.transform(
        F.sequence(F.lit(0), pairs - 1),
        lambda i: turn(F.element_at("_said", 2 * i + 1), F.element_at("_said", 2 * i + 2)))
    return (df.withColumn("_said", bodies)
            .withColumn("conversation", F.when(pairs > 0, turns).otherwise(_no_turns())).drop("_said"))


def pair_messages(messages: Column, *, role: str, text: str, human: str, model: str, system: str | None = None,
                  loss: str | None = None, edit: Callable[[Column], Column] = lambda t: t) -> Column:
    """Array form of turn pairing, as a fold over one record's messages; a null text is an empty text.

    Leading model messages are skipped; human texts are concatenated until a model message closes the
    turn; the last system text since the previous turn applies; an unanswered rest is dropped.  A role
    outside the known ones makes the result null (a reject).
    """
    state = f"struct<system:string,input:string,started:boolean,bad:boolean,turns:{CONVERSATION}>"
    start = F.struct(F.lit("").alias("system"), F.lit("").alias("input"), F.lit(False).alias("started"),
                     F.lit(False).alias("bad"), _no_turns().alias("turns")).cast(state)

    def step(s: Column, m: Column) -> Column:
        r, t = m[role], blank_if_null(m[text])
        is_model, is_human = r == model, r == human
        is_system = (r == system) if system else F.lit(False)
        keep_loss = (F.lower(F.coalesce(m[loss].cast("string"), F.lit("true"))) == "true") if loss else None
        closed = F.concat(s["turns"], F.array(turn(
            s["input"], t, s["system"] if system else None, keep_loss)))
        closes = is_model & s["started"]
        return F.struct(
            F.when(closes, F.lit("")).when(is_system, t).otherwise(s["system"]).alias("system"),
            F.when(closes, F.lit("")).when(is_human, F.concat(s["input"], edit(t))).otherwise(s["input"]).alias("input"),
            (s["started"] | ~is_model).alias("started"),
            (s["bad"] | ~F.coalesce(is_model | is_human | is_system, F.lit(False))).alias("bad"),
            F.when(closes, closed).otherwise(s["turns"]).alias("turns"),
        ).cast(state)

    return F.aggregate(messages, start, step,
                       lambda s: F.when(s["bad"], F.lit(None).cast(CONVERSATION)).otherwise(s["turns"]))


def wizardlm(df: DataFrame) -> DataFrame:
    return df.withColumn("conversation", pair_messages(
        F.col("conversations"), role="from", text="value", human="human", model="gpt"))


def image_first(text: Column) -> Column:
    """Move the image mark in front; all marks become one."""
    moved = strip(F.concat(F.lit(IMAGE_MARK + "\n"), strip(F.replace(text, F.lit(IMAGE_MARK), F.lit("")))))
    return F.when(F.contains(text, F.lit(IMAGE_MARK)), moved).otherwise(text)


def llava(df: DataFrame) -> DataFrame:
    return df.withColumn("conversation", pair_messages(
        F.col("conversations"), role="from", text="value", human="human", model="gpt", edit=image_first))


def llava_image_only(df: DataFrame) -> DataFrame:
    """Human text reduced to the image mark; a human message without one rejects the record."""
    has_mark = F.forall("conversations", lambda m: (m["from"] != "human") | F.contains(m["value"], F.lit(IMAGE_MARK)))
    paired = pair_messages(F.col("conversations"), role="from", text="value", human="human", model="gpt",
                           edit=lambda t: F.lit(IMAGE_MARK))
    return df.withColumn("conversation", F.when(has_mark, paired))


def openai(df: DataFrame) -> DataFrame:
    """Per record ``messages``, else ``message_data``, else ``dialogs``; ``loss`` is optional.

    A table with none of these columns holds bare lists: its one column of message lists is taken.
    """
    names = [n for n in ("messages", "message_data", "dialogs") if n in df.columns]
    if not names:
        names = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
                 and {"role", "content"} <= set(f.dataType.elementType.names)]
        if len(names) != 1:
            raise ValueError("openai format needs messages, message_data or dialogs, or one column of message lists")
    has_loss = "loss" in df.schema[names[0]].dataType.elementType.names
    return df.withColumn("conversation", pair_messages(
        F.coalesce(*[F.col(n) for n in names]), role="role", text="content", human="user", model="assistant", system="system",
        loss="loss" if has_loss else None))


def nested_turns(df: DataFrame) -> DataFrame:
    """``messages`` is already a list of turns with own field names."""
    return df.withColumn("conversation", F.transform(
        "messages", lambda m: turn(m["toy_input"], m["toy_output"], m["toy_system"])))


def positional_pairs(df: DataFrame) -> DataFrame:
    """Messages (0,1), (2,3), ..; odd counts are rejects."""
    n = F.size("conversations")
    half = F.floor(n / 2).cast("int")
    turns = F.transform(F.sequence(F.lit(0), half - 1), lambda i: turn(
        F.element_at("conversations", 2 * i + 1)["value"], F.element_at("conversations", 2 * i + 2)["value"]))
    return df.withColumn("conversation", F.when(n % 2 == 1, F.lit(None).cast(CONVERSATION))
                         .when(n == 0, _no_turns()).otherwise(turns))


for _name, _fn in {
    "alpaca": alpaca,
    "alpaca_zh": _single(_two_lines("instruction_zh", "input_zh"), "output_zh"),
    "arxiv": _single(_one("abstract"), "title", "arxiv_gentile"),
    "code_alpaca": _single(_one("prompt"), "completion", "coder"),
    "colors": colors,
    "crime_kg_assitan": _single(_one("input"), "output", "lawyer"),
    "default": _single(_one("input"), "output"),
    "law_reference": _single(_one("question"), "answer", "lawyer"),
    "llava_image_only": llava_image_only,
    "llava": llava,
    "medical": _single(_two_lines("instruction", "input"), "output", "medical"),
    "oasst1": oasst1,
    "openai": openai,
    "openorca": _single(_one("question"), "response", system_col="system_prompt"),
    "pretrain": pretrain,
    "sql": _single(_two_lines("context", "question"), "answer", "sql"),
    "stack_exchange": _single(_one("question"), "response"),
    "tiny_codes": _single(_one("prompt"), "response", "coder"),
    "wizardlm": wizardlm,
    "role_patient": positional_pairs,
    "role_expert": _single(_one("input"), "output"),
    "role_teacher": _single(_one("question"), "answer"),
    "single_turn": _single(_one("toy_input"), "toy_output", system_col="toy_system"),
    "multi_turn_nested": nested_turns,
}.items():
    register_format(_name, _fn)


# ---------------------------------------------------------------- long form

def message_arrays(messages: DataFrame, *, sample: str, order: str, cols: list[str]) -> DataFrame:
    """One row per dialogue with its ordered messages; for dialogues of bounded length."""
    packed = F.array_sort(F.collect_list(F.struct(order, *cols)))
    return messages.groupBy(sample).agg(F.transform(packed, lambda m: F.struct(*[m[c].alias(c) for c in cols])).alias("messages"))


def pair_turns(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
               text: str = "content", human: str = "user", model: str = "assistant", system: str = "system",
               loss: str | None = None, chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Long form of turn pairing: ``(sample, turn_no, is_first, system, input, output, output_with_loss)``.

    Dialogues are paired by running totals over chunks of their messages, so no task ever holds one whole.
    ``bounded`` is the caller's word that every dialogue is short: they are then gathered by one shuffle and
    folded in place, with the same result.  A null text is an empty text.  A dialogue with a role outside
    the known ones is a reject: it gives no turns, and ``unknown_roles`` lists it.
    """
    messages = messages.withColumn(text, blank_if_null(text))
    names = dict(sample=sample, order=order, role=role, text=text, human=human, model=model, system=system, loss=loss)

    def short(rows: DataFrame) -> DataFrame:
        lists = message_arrays(rows, sample=sample, order=order, cols=[role, text, *([loss] if loss else [])])
        conv = pair_messages(F.col("messages"), role=role, text=text, human=human, model=model, system=system, loss=loss)
        turns = lists.select(sample, F.posexplode(conv).alias("turn_no", "_t"))
        return turns.select(
            sample, F.col("turn_no").cast("long").alias("turn_no"), (F.col("turn_no") == 0).alias("is_first"),
            *[F.col(f"_t.{c}").alias(c) for c in ("system", "input", "output", "output_with_loss")])

    return short(messages) if bounded else _pair_chunks(messages, chunk=chunk, **names)


def _pair_chunks(messages: DataFrame, *, sample: str, order: str, role: str, text: str, human: str, model: str,
                 system: str, loss: str | None, chunk: int) -> DataFrame:
    """A turn's key is the number of model messages before it.

    Rows behind the last model message are dropped before the texts are collected, so a group holds one turn.
    """
    is_model = F.coalesce(F.col(role) == model, F.lit(False))
    odd = ~F.coalesce(F.col(role).isin(human, model, system), F.lit(False))
    placed = running(
        messages, order=[order], keys=[sample], bucket=chunk_bucket(order, chunk),
        sums={"_grp": is_model.cast("int"), "_opened": (~is_model).cast("int"), "_odd": odd.cast("int")},
        totals={"_models": "_grp", "_bad": "_odd"})
    body = F.when(F.col(role) == human, F.col(text))
    keep_loss = (F.lower(F.coalesce(F.col(loss).cast("string"), F.lit("true"))) == "true") if loss else F.lit(True)
    placed = placed.where((F.col("_bad") == 0) & (F.col("_grp") < F.col("_models")))
    # a model message before anything else opens no turn
    placed = placed.where(~(is_model & (F.col("_opened") == 0)))
    grouped = placed.groupBy(sample, "_grp").agg(
        F.max_by(F.when(F.col(role) == system, F.col(text)),
                 F.when(F.col(role) == system, F.col(order))).alias("_system"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body.isNotNull(), F.struct(order, body.alias("t"))))),
                                 lambda s: s["t"]), "").alias("input"),
        F.max(F.when(is_model, F.col(text))).alias("output"),
        F.bool_or(F.when(is_model, keep_loss)).alias("output_with_loss"),
    )
    numbered = running(grouped, order=["_grp"], keys=[sample], bucket=chunk_bucket("_grp", chunk), index="turn_no")
    return numbered.select(
        sample, "turn_no", (F.col("turn_no") == 0).alias("is_first"),
        F.coalesce("_system", F.lit("")).alias("system"), "input", "output", "output_with_loss")


def unknown_roles(messages: DataFrame, role: str = "role",
                  known: tuple[str, ...] = ("user", "assistant", "system")) -> DataFrame:
    return messages.where(~F.coalesce(F.col(role).isin(*known), F.lit(False)))


def positional_turns(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn",
                     text: str = "content") -> tuple[DataFrame, DataFrame]:
    """Long form of positional pairing over a dense 0-based order: (turns, reject ids)."""
    sizes = messages.groupBy(sample).agg(F.count(F.lit(1)).alias("n_messages"))
    odd = sizes.where("n_messages % 2 = 1")
    even = join_keys(messages, sizes.where("n_messages % 2 = 0"), [sample])
    first = (F.col(order) % 2) == 0
    turns = (even.groupBy(sample, int_div(order, 2).alias("turn_no"))
             .agg(F.max(F.when(first, F.col(text))).alias("input"),
                  F.max(F.when(~first, F.col(text))).alias("output")))
    return turns, odd


def to_messages(turns: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Turns -> messages in order: system (where given), user, assistant."""
    parts = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit(1).alias("part"), F.lit("user").alias("role"), F.col("input").alias("content")),
        F.struct(F.lit(2).alias("part"), F.lit("assistant").alias("role"), F.col("output").alias("content")))
    given = F.filter(parts, lambda p: p["content"].isNotNull() & ~((p["role"] == "system") & (p["content"] == "")))
    return (turns.withColumn("_m", F.explode(given))
            .select(sample, "turn_no", F.col("_m.part").alias("part"), F.col("_m.role").alias("role"),
                    F.col("_m.content").alias("content")))


def prepend_system(messages: DataFrame, text: str, *, sample: str = "sample_id", order: str = "turn",
                   role: str = "role", content: str = "content") -> DataFrame:
    """One optional system message in front of every sample."""
    first = messages.groupBy(sample).agg((F.min(order) - 1).alias(order)).select(
        sample, order, F.lit("system").alias(role), F.lit(text).alias(content))
    return first.unionByName(messages.select(sample, order, role, content))


def image_parts(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
                text: str = "content", images: str = "images", human: str = "user", interleave: bool = False,
                chunk: int = CHUNK) -> DataFrame:
    """Split human texts at image marks; the k-th mark of a sample takes its k-th image.

    Output: ``(sample, turn, part, type, value)``.  Images come first unless ``interleave``.
    """
    is_human = F.col(role) == human
    marks = F.when(is_human, F.size(F.split(F.col(text), IMAGE_MARK)) - 1).otherwise(0)
    placed = running(messages, order=[order], keys=[sample], bucket=chunk_bucket(order, chunk), sums={"_seen": marks})
    pieces = F.split(F.col(text), IMAGE_MARK)
    texts = F.transform(pieces, lambda p, i: F.struct(
        (2 * i).alias("at"), F.lit("text").alias("type"), strip(p).alias("value")))
    shots = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.struct(
        (2 * i - 1).alias("at"), F.lit("image_url").alias("type"),
        F.get(F.col(images), (F.col("_seen") + i - 1).cast("int")).alias("value")))
    no_shots = F.array().cast("array<struct<at:int,type:string,value:string>>")
    shots = F.when(F.size(pieces) > 1, shots).otherwise(no_shots)
    texts = F.filter(texts, lambda t: t["value"] != "")
    both = F.concat(shots, texts)
    both = F.array_sort(both) if interleave else both
    plain = F.array(F.struct(F.lit(0).alias("at"), F.lit("text").alias("type"), F.col(text).alias("value")))
    return (placed.withColumn("_parts", F.when(is_human, both).otherwise(plain))
            .select(sample, order, role, F.posexplode("_parts").alias("part", "_p"))
            .select(sample, order, role, "part", F.col("_p.type").alias("type"), F.col("_p.value").alias("value")))


# ---------------------------------------------------------------- tool dialogues

# The tool-dialogue system text, cut at the tool list and the tool names.
REACT_HEAD = "你是一个可以调用外部工具的助手，可以使用的工具包括：\n"
REACT_FORMAT = (
    "如果使用工具请遵循以下格式回复：\n```\nThought:思考你当前步骤需要解决什么问题，是否需要使用工具\n"
    "Action:工具名称，你的工具必须从 [{names}] 选择\nAction Input:工具输入参数\n```\n"
    "工具返回按照以下格式回复：\n```\nResponse:调用工具后的结果\n```\n"
    "如果你已经知道了答案，或者你不需要工具，请遵循以下格式回复\n```\n"
    "Thought:给出最终答案的思考过程\nFinal Answer:最终答案\n```\n开始!\n")
# Block marks, as patterns.
THINK_OPEN, THINK_CLOSE = r"<\|startofthink\|>", r"<\|endofthink\|>"
EXEC_OPEN, EXEC_CLOSE = r"<\|startofexec\|>", r"<\|endofexec\|>"


def tool_objects(text: str) -> list[dict]:
    """The JSON objects in a text that describe a tool: ``name`` and ``description`` are texts.

    An object that describes none is searched for objects inside it; text that is no JSON is passed over.
    """
    decoder, found, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            value, end = None, at + 1
        if isinstance(value, dict) and all(isinstance(value.get(k), str) for k in ("name", "description")):
            found.append(value)
        else:
            end = at + 1
        at = text.find("{", end)
    return found


def tool_parameters(tool: dict) -> str:
    """The listing of a tool's parameters; a tool whose parameters are not well formed is listed without."""
    try:
        given = tool["paths"][0]["parameters"]
        return f"\n输入参数: { {p['name']: p['description'] for p in given} }"
    except (LookupError, TypeError):
        return ""


@F.pandas_udf(T.StructType([T.StructField("listing", T.StringType()), T.StructField("names", T.StringType())]))
def tool_listing(texts: pd.Series) -> pd.DataFrame:
    """Tools named by JSON objects inside a text: their listing and names."""
    def scan(text: str | None) -> tuple[str, str]:
        about = {tool["name"]: tool["description"] + tool_parameters(tool) for tool in tool_objects(text or "")}
        return str(about), str(list(about))

    return pd.DataFrame([scan(t) for t in texts], columns=["listing", "names"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def python_literals(texts: pd.Series) -> pd.Series:
    """JSON texts as Python literals, the way the dialogues spell them; null where one does not parse."""
    def show(t):
        try:
            return str(json.loads(t))
        except (ValueError, TypeError):
            return None
    return texts.map(lambda ts: None if ts is None else [show(t) for t in ts])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("api", T.StringType()), T.StructField("params", T.StringType())])))
def tool_calls(texts: pd.Series) -> pd.Series:
    def read(t):
        try:
            call = json.loads(t)
            return {"api": str(call["api_name"]), "params": str(call["parameters"])}
        except (ValueError, TypeError, KeyError):
            return None
    return texts.map(lambda ts: None if ts is None else [read(t) for t in ts])


def _json_body(c: Column) -> Column:
    for junk in ("```JSON", "```", "\n"):
        c = F.replace(c, F.lit(junk), F.lit(""))
    return c


def react_turns(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
                text: str = "content", chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Tool dialogues in long form: ``(sample, turn_no, system, input, output)``; ``bounded`` as in ``pair_turns``.

    Think blocks become Thought / Action / Action Input, exec blocks a Response and a turn of their own
    for the final answer.  Dialogues with under two messages, or with a block that does not parse, are
    left out.
    """
    messages = messages.withColumn(text, blank_if_null(text))
    t = F.col(text)
    is_model = F.coalesce(F.col(role) == "assistant", F.lit(False))
    has_exec = is_model & F.contains(t, F.lit("<|startofexec|>"))
    pieces = F.split(t, EXEC_OPEN)
    m = messages.withColumn("_said", F.when(has_exec, F.get(pieces, F.lit(0))).otherwise(t))
    m = m.withColumn("_exec", F.when(has_exec, F.get(pieces, F.lit(1))))
    # behind each opening mark: block, closing mark, and the lead of the next block or the tail
    m = m.withColumn("_cut", F.when(is_model, F.split("_said", THINK_OPEN)))
    blocks = F.transform(F.slice("_cut", F.lit(2), F.size("_cut")), lambda p: F.split(p, THINK_CLOSE, 2))
    m = m.withColumn("_blocks", F.when(F.size("_cut") > 1, blocks))
    closed = F.coalesce(F.filter("_blocks", lambda b: F.size(b) == 2), F.array().cast("array<array<string>>"))
    m = (m.withColumn("_closed", closed)
         .withColumn("_open_end", F.coalesce(F.size(F.element_at("_blocks", -1)) == 1, F.lit(False)))
         .withColumn("_unclosed", F.coalesce(F.exists(F.slice("_blocks", F.lit(1), F.greatest(
             F.size("_blocks") - 1, F.lit(0))), lambda b: F.size(b) == 1), F.lit(False)))
         .withColumn("_after", F.transform("_closed", lambda b: F.get(b, F.lit(1))))
         .withColumn("_think", F.transform("_closed", lambda b: _json_body(F.get(b, F.lit(0)))))
         .withColumn("_lead", F.slice(F.concat(F.array(F.get("_cut", F.lit(0))), "_after"), F.lit(1), F.size("_closed")))
         .withColumn("_tail", F.when(F.size("_closed") == 0, F.col("_said")).otherwise(F.concat(
             F.element_at("_after", -1), F.when(F.col("_open_end"), F.concat(
                 F.lit("<|startofthink|>"), F.get(F.element_at("_blocks", -1), F.lit(0)))).otherwise(F.lit("")))))
         .withColumn("_done", F.split("_exec", EXEC_CLOSE, 2))
         .withColumn("_exec_hit", F.coalesce(F.size("_done") == 2, F.lit(False)))
         .withColumn("_calls", tool_calls("_think"))
         .withColumn("_tools", tool_listing(F.when(F.col(role) == "system", t)))
         .withColumn("_exec_json", F.get(python_literals(F.array(_json_body(F.get("_done", F.lit(0))))), F.lit(0)))
         .withColumn("_exec_rest", strip(F.get("_done", F.lit(1)))))
    actions = F.zip_with("_lead", "_calls", lambda lead, call: F.concat(
        F.when(strip(lead) != "", F.concat(F.lit("Thought:"), strip(lead), F.lit("\n"))).otherwise(F.lit("")),
        F.lit("Action:"), call["api"], F.lit("\nAction Input:"), call["params"], F.lit("\n")))
    broken = is_model & (F.col("_unclosed") | F.exists("_calls", lambda c: c.isNull()) | (has_exec & (F.size(pieces) > 2)))
    output = F.when(F.size("_think") > 0, F.concat(F.array_join(actions, ""), F.col("_tail"), F.lit("\n"))) \
        .otherwise(F.concat(F.lit("Final Answer:"), F.col("_said"), F.lit("\n")))
    answered = F.concat(F.lit("Response:"), F.col("_exec_json"), F.lit("\n"), F.when(
        F.col("_exec_rest") != "", F.concat(F.lit("Final Answer:"), F.col("_exec_rest"), F.lit("\n"))).otherwise(F.lit("")))
    response = F.when(F.col("_exec_hit"), answered).otherwise(F.concat(F.lit("<|startofexec|>"), "_exec"))
    system_text = F.concat(F.lit(REACT_HEAD), F.col("_tools.listing"), F.lit("\n"),
                           *_around(REACT_FORMAT, "{names}", F.col("_tools.names")))
    m = m.select(sample, order, role, F.coalesce(broken, F.lit(False)).alias("_broken"),
                 F.when(is_model, output).when(F.col(role) == "system", system_text)
                 .when(F.col(role) == "user", F.concat(t, F.lit("\n"))).alias("_text"),
                 F.when(is_model, response).alias("_response"))
    turns = _react_short(m, sample, order, role) if bounded else _react_long(m, sample, order, role, chunk)
    halves = F.split(F.col("_response"), "Final Answer:")
    extra = F.when(F.size(halves) == 2, F.struct(
        (2 * F.col("_grp") + 1).alias("turn_no"), F.get(halves, F.lit(0)).alias("system"),
        F.lit(None).cast("string").alias("input"),
        F.concat(F.lit("Final Answer:"), F.get(halves, F.lit(1))).alias("output")))
    main = F.struct((2 * F.col("_grp")).alias("turn_no"), "system", "input", "output")
    return turns.select(sample, F.explode(F.array_compact(F.array(main, extra))).alias("_t")).select(sample, "_t.*")


REACT_TURNS = "array<struct<system:string,input:string,output:string,_response:string>>"


def _react_short(m: DataFrame, sample: str, order: str, role: str) -> DataFrame:
    """Bounded dialogues: one shuffle, then a fold; every message is parsed once."""
    lists = message_arrays(m, sample=sample, order=order, cols=[role, "_broken", "_text", "_response"])
    lists = lists.where((F.size("messages") >= 2) & ~F.exists("messages", lambda x: x["_broken"]))
    state = f"struct<system:string,input:string,turns:{REACT_TURNS}>"
    start = F.struct(F.lit("").alias("system"), F.lit("").alias("input"), F.array().cast(REACT_TURNS).alias("turns")).cast(state)

    def step(s: Column, x: Column) -> Column:
        closes = x[role] == "assistant"
        closed = F.concat(s["turns"], F.array(F.struct(s["system"].alias("system"), s["input"].alias("input"),
                                                       x["_text"].alias("output"), x["_response"].alias("_response"))))
        grown = lambda c, who: F.when(closes, F.lit("")).when(x[role] == who, F.concat(s[c], x["_text"])).otherwise(s[c])
        return F.struct(grown("system", "system").alias("system"), grown("input", "user").alias("input"),
                        F.when(closes, closed).otherwise(s["turns"]).alias("turns")).cast(state)

    folded = F.aggregate("messages", start, step, lambda s: s["turns"])
    return lists.select(sample, F.posexplode(folded).alias("_grp", "_t")).select(
        sample, F.col("_grp").cast("long").alias("_grp"), "_t.*")


def _react_long(m: DataFrame, sample: str, order: str, role: str, chunk: int) -> DataFrame:
    """Dialogues of any length: a turn's key is the number of model messages before it."""
    is_model = F.coalesce(F.col(role) == "assistant", F.lit(False))
    placed = running(m, order=[order], keys=[sample], bucket=chunk_bucket(order, chunk),
                     index="_at", sums={"_grp": is_model.cast("int"), "_faults": F.col("_broken").cast("int")},
                     totals={"_n": "_at", "_models": "_grp", "_bad": "_faults"})
    placed = placed.where("_n >= 2 and _bad = 0 and _grp < _models")

    def ordered(which: str) -> Column:
        rows = F.collect_list(F.when(F.col(role) == which, F.struct(F.col(order), F.col("_text"))))
        return F.array_join(F.transform(F.array_sort(rows), lambda r: r["_text"]), "")

    return placed.groupBy(sample, "_grp").agg(
        ordered("system").alias("system"), ordered("user").alias("input"),
        F.max(F.when(is_model, F.col("_text"))).alias("output"), F.max("_response").alias("_response"))


def _around(pattern: str, slot: str, value: Column) -> list[Column]:
    head, tail = pattern.split(slot)
    return [F.lit(head), value, F.lit(tail)]


def tool_parts(df: DataFrame, *, sample: str = "sample_id", chat: str = "chat", turns: str = "num_turns",
               meta: str = "meta_instruction") -> DataFrame:
    """Nested tool dialogues ``chat.turn_i.{key: text}`` -> one row per part, key order kept."""
    per_turn = df.select(sample, F.col(meta).alias("meta_instruction"), F.col(chat).alias("_chat"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col(turns).cast("long"))).alias("turn_no"))
    said = F.map_entries(F.col("_chat")[F.concat(F.lit("turn_"), F.col("turn_no").cast("string"))])
    return per_turn.select(sample, "meta_instruction", "turn_no", F.posexplode(said).alias("key_no", "_e")).select(
        sample, "meta_instruction", "turn_no", "key_no", F.col("_e.key").alias("key"), F.col("_e.value").alias("value"))


# ---------------------------------------------------------------- preference records

MESSAGE = "struct<role:string,content:string>"


def _message(role: str, content: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), col(content).alias("content"))


def orca_pairs(df: DataFrame) -> DataFrame:
    """system, question, chosen, rejected texts -> prompt / chosen / rejected message lists."""
    return (df.withColumn("prompt", F.array(_message("system", "system"), _message("user", "question")))
            .withColumn("chosen", F.array(_message("assistant", "chosen")))
            .withColumn("rejected", F.array(_message("assistant", "rejected"))))


def mixed_pairs(df: DataFrame) -> DataFrame:
    """Full chosen / rejected dialogues of equal length: the last message is the answer."""
    same = F.size("chosen") == F.size("rejected")
    head = F.slice("chosen", F.lit(1), F.greatest(F.size("chosen") - 1, F.lit(0)))
    return df.select(
        *[c for c in df.columns if c not in ("chosen", "rejected")],
        F.when(same, head).alias("prompt"),
        F.when(same, F.slice("chosen", -1, 1)).alias("chosen"),
        F.when(same, F.slice("rejected", -1, 1)).alias("rejected"))

