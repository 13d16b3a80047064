"""Prompt rendering: templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.catalog import ChatTemplate, Template
from turnmill.functions.text import blank_if_null, col, fill
from turnmill.functions.tokens import IMAGE_MARK
from turnmill.operators.formats import message_arrays
from turnmill.operators.order import CHUNK, chunk_bucket, previous_row, running


def template(name: str | Template) -> Template:
    if isinstance(name, Template):
        return name
    if name not in catalog.TEMPLATES:
        raise ValueError(f"unknown template {name!r}")
    return catalog.TEMPLATES[name]


def chat_template(name: str | ChatTemplate) -> ChatTemplate:
    return catalog.CHAT_TEMPLATES[name] if isinstance(name, str) else name


def template_faults(t: Template) -> list[str]:
    """Missing placeholders; an empty list means the template is usable."""
    faults = []
    if "{input}" not in t.instruction:
        faults.append("instruction lacks {input}")
    if t.system is not None and "{system}" not in t.system:
        faults.append("system lacks {system}")
    return faults


# Placeholder each pattern of a message-wise template must hold.
CHAT_SLOTS = {
    "system": ("system",), "user": ("user",), "assistant": ("assistant",),
    "function_call": ("function_call", "assistant"), "function_result": ("function_result",),
    "functions": ("functions",), "code_interpreter": ("code_interpreter",),
    "code_interpreter_call": ("code_interpreter_call", "assistant"),
    "code_interpreter_result": ("code_interpreter_result",), "files": ("files",),
}


def chat_template_faults(patterns: dict[str, str]) -> list[str]:
    return [f"{part} lacks {{{slot}}}" for part, pattern in patterns.items()
            for slot in CHAT_SLOTS.get(part, ()) if "{%s}" % slot not in pattern]


def rendered_input(t: Template, input: Column | str, system: Column | str, round_no: Column | str) -> Column:
    """Null where a system text is given but the template has no place for it (a reject)."""
    body = fill(t.instruction, input=blank_if_null(input), round=col(round_no).cast("string"))
    given = blank_if_null(system) != ""
    if t.system is None:
        return F.when(~given, body)
    return F.when(given, F.concat(fill(t.system, system=col(system)), body)).otherwise(body)


def rendered_output(t: Template, output: Column | str) -> Column:
    return F.concat(blank_if_null(output), F.lit(t.suffix)) if t.suffix else col(output)


def render_turns(turns: DataFrame, name: str | Template, *, round_no: Column | str = "turn_no",
                 base: int = 0) -> DataFrame:
    """Long form: input and output rendered, ``need_eos_token`` and ``sep`` set by the template.

    ``round_no`` is the turn's 0-based number (``base`` = 0) or 1-based (``base`` = 1).
    """
    t = template(name)
    return (turns.withColumn("_in", rendered_input(t, "input", "system", col(round_no) + (1 - base)))
            .withColumn("output", rendered_output(t, "output"))
            .withColumn("input", F.col("_in")).drop("_in")
            .withColumn("need_eos_token", F.lit(not t.suffix_as_eos))
            .withColumn("sep", F.lit(t.sep)))


def rendered_sizes(turns: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Every turn in every named template: turns, rejects and characters per template.

    The templates are an array literal that is exploded, and the counts combine map-side.
    """
    per = []
    for name in names or list(catalog.TEMPLATES):
        t = template(name)
        shown = rendered_input(t, "input", "system", F.col("turn_no") + 1)
        per.append(F.struct(F.lit(name).alias("template"), F.length(shown).alias("n_in"),
                            F.length(rendered_output(t, "output")).alias("n_out"), shown.isNull().alias("bad")))
    rows = turns.select(F.explode(F.array(*per)).alias("_t")).select("_t.*")
    return rows.groupBy("template").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if("bad").alias("n_rejects"),
        F.sum(F.when(~F.col("bad"), F.col("n_in") + F.col("n_out"))).alias("n_chars"))


def marked_inputs(turns: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per template: placeholder faults, and turns whose raw input already holds one of its stop words."""
    per = []
    for name in names or list(catalog.TEMPLATES):
        t = template(name)
        hit = F.lit(False)
        for word in t.stop_words:
            hit = hit | F.contains("input", F.lit(word))
        per.append(F.struct(F.lit(name).alias("template"), F.lit("; ".join(template_faults(t))).alias("faults"),
                            F.lit(t.system is not None).alias("has_system"), hit.alias("marked")))
    rows = turns.select(F.explode(F.array(*per)).alias("_t")).select("_t.*")
    return rows.groupBy("template", "faults", "has_system").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if("marked").alias("n_marked"))


RENDERED = ("array<struct<input:string,output:string,output_with_loss:boolean,"
            "need_eos_token:boolean,sep:string>>")


def render_conversation(df: DataFrame, name: str | Template, column: str = "conversation") -> DataFrame:
    """Array form of ``render_turns``."""
    t = template(name)
    turns = F.transform(column, lambda x, i: F.struct(
        rendered_input(t, x["input"], x["system"], i + 1).alias("input"),
        rendered_output(t, x["output"]).alias("output"),
        x["output_with_loss"].alias("output_with_loss"),
        F.lit(not t.suffix_as_eos).alias("need_eos_token"),
        F.lit(t.sep).alias("sep")))
    bad = F.exists(turns, lambda x: x["input"].isNull())
    return df.withColumn(column, F.when(bad, F.lit(None)).otherwise(turns).cast(RENDERED))


def message_prompt(t: ChatTemplate, role: Column | str, text: Column | str) -> Column:
    r = col(role)
    return (F.when(r == "system", fill(t.system, system=text))
            .when(r == "user", fill(t.user, user=text))
            .when(r == "assistant", fill(t.assistant, assistant=text)))


def message_text(parts: Column | str) -> Column:
    """Text of a multi-part message: parts joined by newlines, images as their mark."""
    return F.array_join(F.transform(col(parts), lambda p: F.when(
        p["type"] == "image_url", F.lit(IMAGE_MARK)).otherwise(p["text"])), "\n")


def render_messages(messages: DataFrame, name: str | ChatTemplate, *, role: str = "role",
                    text: str = "content") -> DataFrame:
    """Long form: ``prompt`` of every message and ``tail`` (the separator behind assistant messages)."""
    t = chat_template(name)
    return (messages.withColumn("prompt", message_prompt(t, role, text))
            .withColumn("tail", F.when(F.col(role) == "assistant", F.lit(t.sep)).otherwise(F.lit(""))))


def rendered_chat(t: ChatTemplate, messages: Column) -> Column:
    """Array form: one string for a message list that arrives as one record.

    The user pattern already ends with the assistant's begin mark, so a prompt that ends with a user
    message is ready for generation.
    """
    return F.array_join(F.transform(messages, lambda m: F.concat(
        message_prompt(t, m["role"], m["content"]),
        F.when(m["role"] == "assistant", F.lit(t.sep)).otherwise(F.lit("")))), "")


# ---------------------------------------------------------------- chat markup with sub-roles

def role_begin(role: Column | str, name: Column | str | None) -> Column:
    """Begin mark by role; a name picks the named form, and tool names become tokens."""
    r = col(role)
    out = F.lit("")
    for role_name, cfg in catalog.CHAT_ROLES.items():
        begin = F.lit(cfg.plain)
        if name is not None:
            n = col(name)
            shown = n
            if role_name in catalog.NAME_TOKEN_ROLES:
                for plain, token in catalog.NAME_TOKENS.items():
                    shown = F.when(n == plain, F.lit(token)).otherwise(shown)
            begin = F.when(n.isNotNull(), fill(cfg.named, name=shown) if cfg.named else F.lit("")).otherwise(begin)
        out = F.when(r == role_name, begin).otherwise(out)
    return out


def role_end(role: Column | str) -> Column:
    return _by_role(role, lambda cfg: F.lit(cfg.end), F.lit(""))


def _by_role(role: Column | str, pick, default: Column) -> Column:
    out = default
    for role_name, cfg in catalog.CHAT_ROLES.items():
        out = F.when(col(role) == role_name, pick(cfg)).otherwise(out)
    return out


def belongs(role: Column | str) -> Column:
    return _by_role(role, lambda cfg: F.lit(cfg.belong is not None), F.lit(False))


def merge_sub_roles(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
                    text: str = "content", name: str = "name", chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Tool and thought messages join the assistant message before them, or open one: rows numbered by ``msg``.

    A null text is an empty text.  ``bounded`` is the caller's word that every dialogue is short; both forms give the same.
    """
    names = dict(sample=sample, order=order, role=role, text=text, name=name)
    return merge_short(messages, **names) if bounded else merge_long(messages, chunk=chunk, **names)


def merge_short(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
                text: str = "content", name: str = "name") -> DataFrame:
    """Dialogues of bounded length: one shuffle, then a fold over each dialogue's messages."""
    extra = [c for c in ("type", "loss") if c in messages.columns]
    sub = belongs(role)
    shown = F.when(sub, F.concat(role_begin(role, name), blank_if_null(text), role_end(role))).otherwise(blank_if_null(text))
    m = messages.select(sample, order, F.when(sub, F.lit("assistant")).otherwise(F.col(role)).alias("role"),
                        F.when(~sub, F.col(name)).alias("name"), shown.alias("content"), sub.alias("sub"), *extra)
    types = dict(m.dtypes)
    fields = ["role", "name", "content", *extra]
    merged = "array<struct<" + ",".join(f"{c}:{types[c]}" for c in fields) + ">>"
    lists = message_arrays(m, sample=sample, order=order, cols=[*fields, "sub"])

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = x["sub"] & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["role"] == "assistant")
        longer = F.struct(*[(F.concat(last["content"], x["content"]) if c == "content" else last[c]).alias(c) for c in fields])
        own = F.struct(*[x[c].alias(c) for c in fields])
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(own))).cast(merged)

    folded = F.aggregate("messages", F.array().cast(merged), step)
    return lists.select(sample, F.posexplode(folded).alias("msg", "_m")).select(
        sample, F.col("msg").cast("long").alias("msg"), *[F.col(f"_m.{c}").alias(c) for c in fields])


def merge_long(messages: DataFrame, *, sample: str = "sample_id", order: str = "turn", role: str = "role",
               text: str = "content", name: str = "name", chunk: int = CHUNK) -> DataFrame:
    """Dialogues of any length.  A sub-role message starts a new message exactly where the message before
    it is neither assistant nor another sub-role; messages are numbered by a running count of starts.
    """
    sub = belongs(role)
    edged = previous_row(messages, order=order, bucket=chunk_bucket(order, chunk), keys=[sample],
                         cols={"_prev_role": role})
    starts = ~sub | ~(F.coalesce(F.col("_prev_role") == "assistant", F.lit(False))
                      | F.coalesce(belongs("_prev_role"), F.lit(False)))
    placed = running(edged.withColumn("_start", starts.cast("int")), order=[order], keys=[sample],
                     bucket=chunk_bucket(order, chunk), sums={"_before": F.col("_start")})
    group = F.col("_before") + F.col("_start")
    shown = F.when(sub, F.concat(role_begin(role, name), blank_if_null(text), role_end(role))).otherwise(blank_if_null(text))
    rows = placed.select(sample, (group - 1).alias("msg"), order, F.when(sub, F.lit("assistant")).otherwise(
        F.col(role)).alias("role"), F.when(~sub, F.col(name)).alias("name"), shown.alias("_text"),
        *[c for c in ("type", "loss") if c in messages.columns])
    carried = [F.min_by(c, order).alias(c) for c in ("type", "loss") if c in messages.columns]
    return rows.groupBy(sample, "msg").agg(
        F.min_by("role", order).alias("role"), F.min_by("name", order).alias("name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "_text"))), lambda s: s["_text"]),
                     "").alias("content"), *carried)


# ---------------------------------------------------------------- multiple-choice prompts

def mcq_prompt(question: Column | str, options: dict[str, Column], hint: Column | str | None = None) -> Column:
    """``<image>``, hint, question, ``A. ..`` lines of the given options, and the closing line."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{letter}. "), c, F.lit("\n"))).otherwise(F.lit(""))
             for letter, c in options.items()]
    body = F.concat(col(question), F.lit("\n"), *lines)
    if hint is not None:
        body = F.concat(F.when(col(hint).isNotNull(), F.concat(col(hint), F.lit("\n"))).otherwise(F.lit("")), body)
    body = F.concat(F.lit(IMAGE_MARK + "\n"), body)
    closing = F.when(body.rlike("[一-鿿]"), F.lit(catalog.MCQ_CLOSING_CJK)).otherwise(F.lit(catalog.MCQ_CLOSING))
    return F.concat(body, closing)
