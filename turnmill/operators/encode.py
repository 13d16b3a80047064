"""Tokenizing and loss masks, length filters, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.catalog import ChatTemplate, Template
from turnmill.functions.text import blank_if_null, col, fill, strip
from turnmill.functions.tokens import (IGNORE_INDEX, IMAGE_INDEX, IMAGE_MARK, INTS, HashEncoder, clip, int_array,
                                       masked, negate, words)
from turnmill.operators.order import CHUNK, chunk_bucket, count_ranks, running
from turnmill.operators.render import (chat_template, merge_sub_roles, render_messages, role_begin,
                                       role_end)
from turnmill.session import stage


def assemble(pieces: DataFrame, *, sample: str = "sample_id", order: str = "turn_no", max_length: int,
             chunk: int = CHUNK, keep: dict[str, Column] | None = None) -> DataFrame:
    """Pieces (``n``, ``ids``, ``labels`` per sample and order) -> one row per sample, cut at ``max_length``.

    The offset of a piece is a running total in chunks, taken from ``n`` alone; pieces behind the cut
    and empty pieces go before the arrays are collected, so a row gathers at most ``max_length``
    tokens whatever the length of the dialogue.  ``keep`` adds aggregates over the whole sample.
    Where pieces carry ``reject``, samples with any such piece give no row.
    """
    flagged = "reject" in pieces.columns
    placed = running(pieces, order=[order], keys=[sample], bucket=chunk_bucket(order, chunk),
                     sums={"_at": F.col("n")})
    inside = (F.col("_at") < max_length) & (F.col("n") > 0)
    room = (F.lit(max_length) - F.col("_at")).cast("int")
    piece = F.struct(F.col("_at"), clip("ids", room).alias("ids"), clip("labels", room).alias("labels"))
    rows = placed.groupBy(sample).agg(
        F.array_sort(F.collect_list(F.when(inside, piece))).alias("_p"),
        *[c.alias(name) for name, c in (keep or {}).items()], *([F.bool_or("reject").alias("_reject")] if flagged else []))
    if flagged:
        rows = rows.where(~F.col("_reject"))
    return rows.select(
        sample,
        F.flatten(F.transform("_p", lambda p: p["ids"])).alias("input_ids"),
        F.flatten(F.transform("_p", lambda p: p["labels"])).alias("labels"),
        *(keep or {})).withColumn("num_tokens", F.size("input_ids"))


def encode_turns(turns: DataFrame, encoder=HashEncoder(), *, sample: str = "sample_id",
                 with_output: bool = True) -> DataFrame:
    """Rendered turns -> token pieces per turn: ``(sample, turn_no, n, ids, labels)``.

    BOS opens the first turn and every turn behind one that ended with EOS (``need_eos_token`` is a
    property of the template, hence of the sample).  Input, BOS and separator carry no loss; output
    and EOS carry it where ``output_with_loss``.  A turn without a rendering (null) is marked ``reject``.
    """
    if not with_output:
        return (turns.withColumn("_in", encoder.ids("input"))
                .withColumn("ids", F.concat(int_array(encoder.bos), F.col("_in")))
                .select(sample, "turn_no", (encoder.length("input") + len(encoder.bos)).alias("n"), "ids",
                        masked("ids").alias("labels")))
    empty = F.array().cast(INTS)
    opens = F.col("is_first") | F.col("need_eos_token")
    n = (F.when(opens, len(encoder.bos)).otherwise(0) + encoder.length("input") + encoder.length("output")
         + F.when(F.col("need_eos_token"), len(encoder.eos)).otherwise(0) + encoder.length("sep"))
    t = (turns.withColumn("n", n if encoder.in_jvm else F.lit(None))
         .withColumn("_bos", F.when(opens, int_array(encoder.bos)).otherwise(empty))
         .withColumn("_in", encoder.ids("input"))
         .withColumn("_out", encoder.ids("output"))
         .withColumn("_eos", F.when(F.col("need_eos_token"), int_array(encoder.eos)).otherwise(empty))
         .withColumn("_sep", encoder.ids("sep")))
    learned = F.concat("_out", "_eos")
    ids = F.concat("_bos", "_in", "_out", "_eos", "_sep")
    return t.select(
        sample, "turn_no", F.coalesce(F.col("n") if encoder.in_jvm else F.when(F.col("input").isNotNull(), F.size(ids)), F.lit(0)).alias("n"),
        ids.alias("ids"), F.concat(masked("_bos"), masked("_in"), F.when(F.col("output_with_loss"), learned).otherwise(masked(learned)),
                                   masked("_sep")).alias("labels"), (F.col("input").isNull() | F.col("output").isNull()).alias("reject"))


def encode_sft(turns: DataFrame, encoder=HashEncoder(), *, max_length: int, sample: str = "sample_id",
               chunk: int = CHUNK) -> DataFrame:
    """Rendered turns -> ``(sample, input_ids, labels, num_tokens)``; samples with a turn that has no rendering are left out.

    Pieces of a tokenizer that runs in Python are staged, so that it runs once per text.
    """
    pieces = encode_turns(turns, encoder, sample=sample)
    pieces = pieces if encoder.in_jvm else stage(pieces, "pieces")
    return assemble(pieces, sample=sample, max_length=max_length, chunk=chunk)


def gather(pieces: DataFrame, *, sample: str, order: str = "turn_no", max_length: int) -> DataFrame:
    """``assemble`` for samples known to have a bounded number of pieces: one shuffle."""
    flagged = "reject" in pieces.columns
    rows = pieces.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(order, "ids", "labels"))).alias("_p"),
                                      *([F.bool_or("reject").alias("_reject")] if flagged else []))
    if flagged:
        rows = rows.where(~F.col("_reject"))
    return rows.select(
        sample, clip(F.flatten(F.transform("_p", lambda p: p["ids"])), max_length).alias("input_ids"),
        clip(F.flatten(F.transform("_p", lambda p: p["labels"])), max_length).alias("labels")).withColumn(
        "num_tokens", F.size("input_ids"))


def encode_conversation(df: DataFrame, encoder=HashEncoder(), *, max_length: int,
                        column: str = "conversation") -> DataFrame:
    """Array form of ``encode_sft``: one record per row, any mix of ``need_eos_token``; no shuffle.

    The pieces pass a one-row generator, so that every text is cut and encoded once however often ids
    and labels are referred to, and later filters cannot be pushed below that.  Only outputs have labels:
    inputs and separators pass it as the texts of their tokens, which ``input_ids`` alone encodes, so that
    who reads labels and lengths pays for the ids of the outputs only.  No text goes on behind the cut.
    """
    empty = F.array().cast(INTS)
    bos, eos = int_array(encoder.bos), int_array(encoder.eos)
    before = lambda i: F.get(F.col(column), i - 1)["need_eos_token"]
    # An encoder that does not tell cutting from encoding has its ids pass the generator.
    cut, code = (encoder.units, encoder.unit_ids) if hasattr(encoder, "units") else (encoder.ids, lambda ids: ids)
    units = lambda c: clip(cut(c), max_length)
    pieces = F.transform(column, lambda t, i: F.struct(
        F.when((i == 0) | before(i), bos).otherwise(empty).alias("b"),
        units(blank_if_null(t["input"])).alias("i"),
        code(units(t["output"])).alias("o"),
        F.when(t["need_eos_token"], eos).otherwise(empty).alias("e"),
        units(blank_if_null(t["sep"])).alias("s"),
        t["output_with_loss"].alias("loss")))
    coded = df.select(*df.columns, F.inline(F.array(F.struct(pieces.alias("_p")))))
    ids = F.flatten(F.transform("_p", lambda p: F.concat(
        p["b"], code(p["i"]), p["o"], p["e"], code(p["s"]))))
    labels = F.flatten(F.transform("_p", lambda p: F.concat(
        masked(p["b"]), masked(p["i"]), F.when(p["loss"], p["o"]).otherwise(masked(p["o"])),
        F.when(p["loss"], p["e"]).otherwise(masked(p["e"])), masked(p["s"]))))
    n = F.aggregate("_p", F.lit(0), lambda acc, p: acc + F.size(p["b"]) + F.size(p["i"]) + F.size(p["o"])
                    + F.size(p["e"]) + F.size(p["s"]))
    return coded.select(*df.columns, clip(ids, max_length).alias("input_ids"), clip(labels, max_length).alias("labels"),
                        F.when(F.col("_p").isNotNull(), F.least(n, F.lit(max_length))).alias("num_tokens"))


def image_pieces(text: Column | str, encoder=HashEncoder()) -> Column:
    """Ids with the image index between exactly two chunks; null for any other number of marks."""
    chunks = F.split(col(text), IMAGE_MARK)
    spliced = F.concat(encoder.ids(F.get(chunks, F.lit(0))), int_array([IMAGE_INDEX]),
                       encoder.ids(F.coalesce(F.get(chunks, F.lit(1)), F.lit(""))))
    return F.when(F.size(chunks) == 1, encoder.ids(text)).when(F.size(chunks) == 2, spliced)


def encode_messages(messages: DataFrame, template: str | ChatTemplate, encoder=HashEncoder(), *, max_length: int,
                    sample: str = "sample_id", order: str = "turn", chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Chat messages with message-wise loss (``loss`` column optional; default: assistant only).

    The sample opens with BOS; the separator behind assistant messages carries no loss.  A null text is an
    empty text; samples with a role that the template does not know are left out.  ``bounded`` is the
    caller's word that every dialogue is short; both forms give the same.
    """
    messages = messages.withColumn("content", blank_if_null("content"))
    loss = F.col("role") == "assistant"
    if "loss" in messages.columns:
        loss = F.coalesce(F.col("loss"), loss)
    room = max_length - len(encoder.bos)

    def pieces(rows: DataFrame) -> DataFrame:
        m = render_messages(rows, chat_template(template)).withColumn("_loss", loss)
        m = m.withColumn("_ids", encoder.ids("prompt")).withColumn("_tail", encoder.ids("tail"))
        n = encoder.length("prompt") + encoder.length("tail") if encoder.in_jvm else F.size("_ids") + F.size("_tail")
        n = F.when(F.col("prompt").isNull(), 0).otherwise(n)
        out = m.select(sample, F.col(order).alias("turn_no"), n.alias("n"), F.concat("_ids", "_tail").alias("ids"), F.concat(
            F.when(F.col("_loss"), F.col("_ids")).otherwise(masked("_ids")), masked("_tail")).alias("labels"),
            F.col("prompt").isNull().alias("reject"))
        return out if encoder.in_jvm else stage(out, "pieces")

    rows = (gather(pieces(messages), sample=sample, max_length=room) if bounded
            else assemble(pieces(messages), sample=sample, max_length=room, chunk=chunk))
    lead = int_array(encoder.bos)
    return (rows.withColumn("input_ids", F.concat(lead, "input_ids"))
            .withColumn("labels", F.concat(masked(lead), "labels"))
            .withColumn("num_tokens", F.size("input_ids")))


def encode_markup(messages: DataFrame, encoder=HashEncoder(), *, max_length: int = 32768, sample: str = "sample_id",
                  order: str = "turn", chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Chat-markup messages with sub-roles -> signed tokens per sample (``bounded``: every sample has few messages)."""
    merged = merge_sub_roles(messages, sample=sample, order=order, chunk=chunk, bounded=bounded)
    return encode_signed(merged, encoder, max_length=max_length, sample=sample, chunk=chunk, bounded=bounded)


def encode_signed(messages: DataFrame, encoder=HashEncoder(), *, max_length: int = 32768,
                  sample: str = "sample_id", order: str = "msg", chunk: int = CHUNK, bounded: bool = False) -> DataFrame:
    """Merged chat-markup messages -> signed tokens (negative: no loss), BOS in front, cut at ``max_length``.

    ``bounded`` says that every sample is known to have few messages.
    """
    begin, end = role_begin("role", "name"), role_end("role")
    loss = F.lit(False)
    end_loss = F.lit(False)
    kind = F.coalesce(F.col("type"), F.lit("current")) if "type" in messages.columns else F.lit("current")
    wanted = F.coalesce(F.col("loss"), F.lit(True)) if "loss" in messages.columns else F.lit(True)
    for name, cfg in catalog.CHAT_ROLES.items():
        hit = F.col("role") == name
        loss = F.when(hit, kind.isin(*cfg.loss_types) & wanted if cfg.loss_types else F.lit(False)).otherwise(loss)
        end_loss = F.when(hit, F.lit(cfg.end_loss)).otherwise(end_loss)
    m = (messages.withColumn("_begin", begin).withColumn("_end", end).withColumn("_loss", loss)
         .withColumn("_end_loss", end_loss)
         .withColumn("_whole_text", F.concat("_begin", "content", "_end"))
         .withColumn("_b", encoder.ids("_begin")).withColumn("_e", encoder.ids("_end"))
         .withColumn("_whole", encoder.ids("_whole_text")))
    content = F.greatest(F.size("_whole") - F.size("_b") - F.size("_e"), F.lit(0))
    m = m.withColumn("_c", F.slice("_whole", F.size("_b") + 1, content))
    signed = F.concat(negate("_b"), F.when(F.col("_loss"), F.col("_c")).otherwise(negate("_c")),
                      F.when(F.col("_end_loss"), F.col("_e")).otherwise(negate("_e")))
    marks = encoder.length("_begin") + encoder.length("_end")
    n = F.greatest(encoder.length("_whole_text"), marks) if encoder.in_jvm else F.size(signed)
    pieces = m.select(sample, F.col(order).alias("turn_no"), n.alias("n"), signed.alias("ids")).withColumn("labels", F.col("ids"))
    pieces = pieces if encoder.in_jvm else stage(pieces, "pieces")
    room = max_length - len(encoder.bos)
    rows = gather(pieces, sample=sample, max_length=room) if bounded else assemble(
        pieces, sample=sample, max_length=room, chunk=chunk)
    return rows.select(sample, F.concat(int_array(encoder.bos), "input_ids").alias("tokens")).withColumn(
        "num_tokens", F.size("tokens"))


# The key of tool results and the marks around them that keep their loss.
TOOL_KEY = "Tool Responses"
TOOL_OPEN = "<|Results|>:"
TOOL_CLOSE = "<eor>\n"
DEFAULT_BOT = "MOSS"


def encode_tool_dialogue(parts: DataFrame, encoder=HashEncoder(), *, max_length: int, bot_name: str | None = None,
                         sample: str = "sample_id", chunk: int = CHUNK) -> DataFrame:
    """Tool dialogues from ``(sample, meta_instruction, turn_no, key_no, key, value)`` rows.

    Whole turns are kept while the running length fits ``max_length``; the meta instruction and the
    inside of tool results carry no loss; samples without a kept turn, or with an empty part, are
    dropped.
    """
    text, meta = F.col("value"), F.col("meta_instruction")
    if bot_name is not None:
        text, meta = (F.replace(c, F.lit(DEFAULT_BOT), F.lit(bot_name)) for c in (text, meta))
    pre, post = encoder.length(F.lit(TOOL_OPEN)), encoder.length(F.lit(TOOL_CLOSE))
    p = (parts.withColumn("_text", text).withColumn("n", encoder.length(F.col("_text")))
         .withColumn("ids", encoder.ids("_text")))
    inside = lambda i: (i >= pre) & (i < F.size("ids") - post)
    labels = F.when(F.col("key") == TOOL_KEY, F.transform(
        "ids", lambda x, i: F.when(inside(i), F.lit(IGNORE_INDEX)).otherwise(x))).otherwise(F.col("ids"))
    turns = p.withColumn("_l", labels).groupBy(sample, "turn_no").agg(
        F.sum("n").alias("n"), F.min("n").alias("_least"),
        F.array_sort(F.collect_list(F.struct("key_no", "ids", "_l"))).alias("_keys"),
        F.first("meta_instruction").alias("meta_instruction"))
    turns = turns.select(
        sample, "turn_no", "n", "_least", "meta_instruction",
        F.flatten(F.transform("_keys", lambda k: k["ids"])).alias("ids"),
        F.flatten(F.transform("_keys", lambda k: k["_l"])).alias("labels"))
    lead_n = len(encoder.bos) + encoder.length(meta)
    placed = running(turns.withColumn("_lead", lead_n), order=["turn_no"], keys=[sample],
                     bucket=chunk_bucket("turn_no", chunk),
                     sums={"_at": F.col("n"), "_faults": (F.col("_least") == 0).cast("int")},
                     totals={"_bad": "_faults"})
    kept = placed.where((F.col("_bad") == 0) & (F.col("_lead") + F.col("_at") + F.col("n") <= max_length))
    rows = kept.groupBy(sample).agg(
        F.array_sort(F.collect_list(F.struct("_at", "ids", "labels"))).alias("_p"),
        F.max(meta).alias("_meta"), F.count(F.lit(1)).alias("n_turns"))
    lead = F.concat(int_array(encoder.bos), encoder.ids("_meta"))
    return (rows.withColumn("_lead", lead)
            .select(sample, "n_turns",
                    F.concat("_lead", F.flatten(F.transform("_p", lambda q: q["ids"]))).alias("input_ids"),
                    F.concat(masked("_lead"), F.flatten(F.transform("_p", lambda q: q["labels"]))).alias("labels"))
            .withColumn("num_tokens", F.size("input_ids")))


def image_token_text(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.concat(F.lit("<img>"), F.repeat(F.lit("<IMG_CONTEXT>"), n), F.lit("</img>"))


def vision_text(text: Column | str, image_text: Column) -> Column:
    """Human text with its image mark replaced by the image's context tokens, in front.

    ``image_text`` null means a text-only row, whose stray marks are removed.
    """
    bare = F.replace(col(text), F.lit(IMAGE_MARK), F.lit(""))
    moved = strip(F.concat(image_text, F.lit("\n"), strip(bare)))
    return strip(F.when(image_text.isNull(), bare).when(F.contains(col(text), F.lit(IMAGE_MARK)), moved)
                 .otherwise(col(text)))


def encode_vision(turns: DataFrame, template: Template, system: str, encoder=HashEncoder(), *, max_length: int,
                  sample: str = "sample_id", chunk: int = CHUNK) -> DataFrame:
    """Image dialogues: the system text opens the first turn only, BOS too; no EOS, no separator."""
    body = fill(template.instruction, input=F.col("input"), round=(F.col("turn_no") + 1).cast("string"))
    opened = F.concat(F.lit((template.system or "").replace("{system}", system)), body)
    t = (turns.withColumn("input", F.when(F.col("is_first"), opened).otherwise(body))
         .withColumn("output", F.concat(strip("output"), F.lit(template.suffix)))
         .withColumn("output_with_loss", F.lit(True)).withColumn("need_eos_token", F.lit(False))
         .withColumn("sep", F.lit("")))
    return encode_sft(t, encoder, max_length=max_length, sample=sample, chunk=chunk)


def rl_labels(prompt: Column | str, response: Column | str) -> Column:
    """Labels of prompt + response, shifted by one: -100 x (P - 1), response, -100."""
    p, r = col(prompt), col(response)
    return F.concat(F.array_repeat(F.lit(IGNORE_INDEX), F.greatest(F.size(p) - 1, F.lit(0))), r,
                    int_array([IGNORE_INDEX]))


# ---------------------------------------------------------------- filters

def drop_empty(df: DataFrame, column: str = "conversation") -> DataFrame:
    return df.where(F.size(column) > 0)


def drop_unsupervised(df: DataFrame, labels: str = "labels") -> DataFrame:
    return df.where(F.exists(labels, lambda x: x >= 0))


def min_length(df: DataFrame, n: int, length: str = "num_tokens") -> DataFrame:
    return df.where(F.col(length) >= n) if n > 0 else df


def max_length(df: DataFrame, n: int, length: str = "num_tokens") -> DataFrame:
    """Rows strictly shorter than ``n``."""
    return df.where(F.col(length) < n)


def category_since(df: DataFrame, categories: list[str], start: str, *, column: str = "categories",
                   date: str = "update_date") -> DataFrame:
    """Any of ``categories`` in a whitespace list, and a date from ``start`` on.

    The date test is a plain comparison, so it reaches the Parquet scan where ``date`` is a stored
    date or timestamp; text dates are parsed as ``yyyy-MM-dd``.
    """
    d = F.to_date(F.col(date), "yyyy-MM-dd") if dict(df.dtypes)[date] == "string" else F.col(date)
    since = F.lit(start).cast("date") if dict(df.dtypes)[date] == "string" else F.lit(start).cast(dict(df.dtypes)[date])
    wanted = F.array(*[F.lit(c) for c in categories])
    return df.where((d >= since) & F.arrays_overlap(F.split(strip(column), r"\s+"), wanted))


# ---------------------------------------------------------------- vocabulary

def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Map-side combined counts; a word that makes a third of the text costs one row per task."""
    return df.select(F.explode(words(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(counts: DataFrame, specials: tuple[str, ...] = catalog.SPECIAL_TOKENS, first_id: int = 0) -> DataFrame:
    """``(word, n, token_id)``: dense ids by falling frequency (ties by md5), missing specials behind.

    Ranks come from the histogram of the counts and, inside one count, from md5 buckets sized by its words.
    """
    counts = stage(counts, "word-counts")
    ranked = count_ranks(counts, key=F.md5("word"), index="token_id")
    known = ranked.select("word", "n", (F.col("token_id") + first_id).alias("token_id"))
    present = counts.where(F.col("word").isin(*specials)).select("word")  # at most len(specials) rows
    extra = df_of_words(counts, specials).join(present, "word", "left_anti")
    w = Window.orderBy("pos")
    size = counts.agg(F.count(F.lit(1))).scalar()
    extra = extra.select("word", F.lit(0).cast("long").alias("n"),
                         (size + F.row_number().over(w) - 1 + first_id).cast("long").alias("token_id"))
    return known.unionByName(extra)


def df_of_words(like: DataFrame, items: tuple[str, ...]) -> DataFrame:
    return like.sparkSession.createDataFrame([(w, i) for i, w in enumerate(items)], "word string, pos int")


def encode_with_vocab(df: DataFrame, id_col: str, text: str, vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """Vocabulary encoder: join words to ids, in order.  Texts are rows, so a row's words are bounded."""
    rows = df.select(id_col, F.posexplode(words(text)).alias("pos", "word"))
    coded = rows.join(vocab.select("word", "token_id"), "word", "left")
    return coded.groupBy(id_col).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(unknown)).alias("token_id")))),
        lambda s: s["token_id"]).alias("input_ids"))


def rank_ids(samples: DataFrame, *, reserved: int = 3) -> DataFrame:
    """``(token_id, n, rank_id)``: dense ids by falling frequency (ties by id), behind the reserved ones."""
    seen = samples.select(F.explode("input_ids").alias("token_id")).where(F.col("token_id") >= reserved)
    counts = stage(seen.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    ranked = count_ranks(counts, key=F.lpad(F.hex(F.col("token_id").cast("long")), 8, "0"), index="_r", skip=1)
    return ranked.select("token_id", "n", (F.col("_r") + reserved).cast("int").alias("rank_id"))


def apply_ranks(samples: DataFrame, ranks: DataFrame, *, sample: str = "sample_id") -> DataFrame:
    """Samples of hashed ids -> samples of vocabulary ids; reserved ids and masked labels stay.

    A row's tokens are bounded by its ``max_length``.  The id table is staged, so that Spark joins it by
    its size: without a shuffle of the tokens while it is small, with skew handling beyond.
    """
    table = stage(ranks.select("token_id", "rank_id"), "ranks")
    each = samples.select(sample, F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "_t")).select(
        sample, "pos", F.col("_t.input_ids").alias("token_id"), F.col("_t.labels").alias("label"))
    new = F.coalesce("rank_id", "token_id")
    coded = each.join(table, "token_id", "left").select(
        sample, F.struct("pos", new.alias("i"), F.when(F.col("label") >= 0, new).otherwise(F.col("label")).alias("l")).alias("_t"))
    rows = coded.groupBy(sample).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    return rows.select(sample, F.transform("_t", lambda t: t["i"]).alias("input_ids"),
                       F.transform("_t", lambda t: t["l"]).alias("labels"), F.size("_t").alias("num_tokens"))


def decode_preview(samples: DataFrame, vocab: DataFrame, *, sample: str = "sample_id", k: int = 10,
                   order: list | None = None) -> DataFrame:
    """Text and loss-masked text of the first ``k`` samples (a preview: the limit is its purpose)."""
    first = samples.orderBy(*(order or [sample])).limit(k)
    rows = first.select(sample, F.posexplode(F.arrays_zip("input_ids", "labels")).alias("pos", "_t")).select(
        sample, "pos", F.col("_t.input_ids").alias("token_id"), F.col("_t.labels").alias("label"))
    named = rows.join(vocab.select("token_id", "word"), "token_id", "left").withColumn(
        "_w", F.when(F.col("token_id") == IMAGE_INDEX, F.lit(IMAGE_MARK)).otherwise(
            F.coalesce("word", F.concat(F.lit("<"), F.col("token_id").cast("string"), F.lit(">")))))
    shown = named.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("pos", "_w", "label"))).alias("_r"))
    return shown.select(
        sample,
        F.array_join(F.transform("_r", lambda r: r["_w"]), " ").alias("text"),
        F.array_join(F.transform("_r", lambda r: F.when(r["label"] >= 0, r["_w"]).otherwise(
            F.lit("[-100]"))), " ").alias("masked_text"),
        F.size("_r").alias("n_tokens"))
