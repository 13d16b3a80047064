"""Queries: tokenizing, loss masks, filters, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.functions import tokens as tk
from turnmill.functions.tokens import HashEncoder, joined
from turnmill.operators import encode as en
from turnmill.operators import formats as fm
from turnmill.plans import inputs, sql
from turnmill.plans.formats import pair_texts, _PAIR_ROWS
from turnmill.plans.presets import build_tool_dialogues, dialogue_rejects, encode_dialogues
from turnmill.plans.registry import query
from turnmill.plans.rendering import MERGED, sub_role_messages
from turnmill.session import fresh_path, stage
from turnmill.sources import readers as rd

ENC = HashEncoder()


def shown(df, *ids):
    return df.select(*ids, F.col("num_tokens").cast("long").alias("num_tokens"), joined("input_ids").alias("input_ids"),
                     joined("labels").alias("labels"))


_SHOWN = f"num_tokens, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels"


def odd_messages(spark, d):
    """The conversations with every fault: unknown roles, null texts, null system texts."""
    m = inputs.messages(spark, d)
    odd, turn = F.col("sample_id") % 10, F.col("turn")
    return m.withColumn("role", F.when((odd == 3) & (turn == 1), "tool").when((odd == 4) & (turn == 0), F.lit(None)).otherwise(F.col("role"))).withColumn(
        "content", F.when((odd == 5) & (turn % 2 == 0), F.lit(None)).when((odd == 6) & (turn == 0), F.lit(None)).otherwise(F.col("content")))


@query("encode_rejects", f"""
WITH m AS (SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN 'tool' WHEN conv_id % 10 = 4 AND turn = 0 THEN NULL ELSE role END AS role,
  CASE WHEN conv_id % 10 = 5 AND turn % 2 = 0 THEN '' WHEN conv_id % 10 = 6 AND turn = 0 THEN '' ELSE text END AS text FROM conversations),
bad AS (SELECT DISTINCT conv_id FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'system')),
conversations AS (SELECT * FROM m WHERE conv_id NOT IN (SELECT conv_id FROM bad)),
{sql.TURNS},
placeless AS (SELECT DISTINCT sample_id FROM turns WHERE system <> ''),
kept AS (SELECT sample_id, CAST(sum(5 + {sql.n_words('input')} + {sql.n_words('output')}) AS BIGINT) AS n FROM turns
         WHERE sample_id NOT IN (SELECT sample_id FROM placeless) GROUP BY sample_id)
SELECT conv_id AS sample_id, 'unknown role' AS reason, CAST(NULL AS BIGINT) AS num_tokens FROM bad
UNION ALL SELECT sample_id, 'system text without a place', NULL FROM placeless
UNION ALL SELECT sample_id, 'encoded', n FROM kept""")
def encode_rejects(spark, d):
    """Dialogues that a template without a place for system texts cannot encode, and the tokens of the others.

    A turn has BOS, two marks, its words, EOS and a separator.
    """
    m = odd_messages(spark, d)
    coded = encode_dialogues(m, "minicpm", ENC, max_length=1 << 20)
    return dialogue_rejects(m, "minicpm").withColumn("num_tokens", F.lit(None).cast("long")).unionByName(
        coded.select("sample_id", F.lit("encoded").alias("reason"), F.col("num_tokens").cast("long").alias("num_tokens")))


@query("encode_sft", f"WITH {sql.samples(256)} SELECT sample_id, {_SHOWN} FROM samples")
def encode_sft(spark, d):
    return shown(inputs.samples(spark, d, 256), "sample_id")


@query("encode_pretrain", f"""
WITH c AS (SELECT doc_id, {sql.ids(sql.strip('text'))} AS b FROM documents),
w AS (SELECT doc_id, list_concat([CAST(1 AS BIGINT)], b)[1:1024] AS input_ids, list_concat([CAST(-100 AS BIGINT)], b)[1:1024] AS labels FROM c)
SELECT doc_id, CAST(len(input_ids) AS BIGINT) AS num_tokens, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels FROM w""")
def encode_pretrain(spark, d):
    """Array form on a pretraining corpus: one record per row, no shuffle."""
    df = fm.normalise(inputs.texts(spark, d).select("doc_id", "text"), "pretrain")
    turns = F.transform("conversation", lambda t: F.struct(
        t["input"].alias("input"), t["output"].alias("output"), t["output_with_loss"].alias("output_with_loss"),
        t["need_eos_token"].alias("need_eos_token"), F.lit("").alias("sep")))
    return shown(en.encode_conversation(df.withColumn("conversation", turns), ENC, max_length=1024), "doc_id")


@query("encode_image", f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE lang || ' <image> ' || text END
             || CASE WHEN doc_id % 5 = 0 THEN ' <image>' ELSE '' END AS t FROM documents),
s AS (SELECT doc_id, string_split(t, '<image>') AS c FROM t),
e AS (SELECT doc_id, CASE WHEN len(c) = 1 THEN {sql.ids('c[1]')} WHEN len(c) = 2 THEN
        list_concat({sql.ids('c[1]')}, [CAST(-200 AS BIGINT)], {sql.ids('c[2]')}) END AS ids FROM s)
SELECT doc_id, ids IS NULL AS rejected, CASE WHEN ids IS NOT NULL THEN {sql.text('ids')} END AS input_ids FROM e""")
def encode_image(spark, d):
    docs = inputs.texts(spark, d)
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("lang", F.lit(" <image> "), "text")),
                    F.when(F.col("doc_id") % 5 == 0, " <image>").otherwise(""))
    coded = docs.select("doc_id", en.image_pieces(text, ENC).alias("ids"))
    return coded.select("doc_id", F.col("ids").isNull().alias("rejected"), joined("ids").alias("input_ids"))


_LLAMA3 = catalog.CHAT_TEMPLATES["llama3"]
_QWEN2 = catalog.CHAT_TEMPLATES["qwen2"]


def _prompt_sql(t) -> str:
    cases = " ".join(f"WHEN role = '{r}' THEN replace({sql.lit(getattr(t, r))}, '{{{r}}}', text)" for r in ("system", "user", "assistant"))
    return f"CASE {cases} END"


@query("encode_chat", f"""
WITH m AS (SELECT conv_id, turn, role, (role = 'assistant' AND turn % 3 <> 0) OR (role = 'user' AND conv_id % 7 = 0) AS loss,
             {_prompt_sql(_QWEN2)} AS prompt, CASE WHEN role = 'assistant' THEN chr(10) ELSE '' END AS tail FROM conversations),
e AS (SELECT *, {sql.ids('prompt')} AS a, {sql.ids('tail')} AS b FROM m),
w AS (SELECT conv_id AS sample_id, list_concat([CAST(1 AS BIGINT)], flatten(list(list_concat(a, b) ORDER BY turn)))[1:512] AS input_ids,
        list_concat([CAST(-100 AS BIGINT)], flatten(list(list_concat(CASE WHEN loss THEN a ELSE {sql.masked('a')} END, {sql.masked('b')})
          ORDER BY turn)))[1:512] AS labels FROM e GROUP BY conv_id)
SELECT sample_id, CAST(len(input_ids) AS BIGINT) AS num_tokens, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels FROM w""")
def encode_chat(spark, d):
    m = inputs.messages(spark, d).withColumn("loss", F.when(
        F.col("role") == "assistant", F.col("turn") % 3 != 0).when(F.col("role") == "user", F.col("sample_id") % 7 == 0))
    return shown(en.encode_messages(m, "qwen2", ENC, max_length=512), "sample_id")


@query("encode_signed", f"""
WITH {MERGED},
t AS (SELECT *, '<|im_start|>' || role || CASE WHEN name IS NULL THEN '' WHEN role = 'system' THEN ' name=<|interpreter|>'
          ELSE ' name=' || name END || chr(10) AS b, '<|im_end|>' || chr(10) AS e FROM merged),
i AS (SELECT *, {sql.ids('b')} AS bi, {sql.ids('e')} AS ei, {sql.ids('b || content || e')} AS al FROM t),
c AS (SELECT *, al[len(bi) + 1 : len(al) - len(ei)] AS ci FROM i),
s AS (SELECT sample_id, msg, list_concat(list_transform(bi, lambda x: -x),
        CASE WHEN role = 'assistant' AND loss AND type IN ('icl', 'current') THEN ci ELSE list_transform(ci, lambda x: -x) END,
        CASE WHEN role = 'assistant' THEN ei ELSE list_transform(ei, lambda x: -x) END) AS toks FROM c),
w AS (SELECT sample_id, list_concat([CAST(1 AS BIGINT)], flatten(list(toks ORDER BY msg)))[1:512] AS toks FROM s GROUP BY sample_id)
SELECT sample_id, CAST(len(toks) AS BIGINT) AS num_tokens, {sql.text('toks')} AS tokens FROM w""")
def encode_signed(spark, d):
    out = en.encode_markup(sub_role_messages(spark, d), ENC, max_length=512)
    return out.select("sample_id", F.col("num_tokens").cast("long").alias("num_tokens"), joined("tokens").alias("tokens"))


@query("signed_tokens_decode", f"""
WITH c AS (SELECT doc_id, {sql.ids('text')} AS ids FROM documents),
s AS (SELECT doc_id, list_transform(ids, lambda x, i: CASE WHEN i % 3 = 0 THEN -x WHEN i % 11 = 0 THEN 0 ELSE x END) AS toks FROM c)
SELECT CAST(len(toks) AS BIGINT) AS num_tokens, {sql.text('list_transform(toks, lambda x: abs(x))')} AS input_ids,
       {sql.text('list_transform(toks, lambda x: CASE WHEN x > 0 THEN x ELSE -100 END)')} AS labels
FROM s WHERE len(toks) >= 50""")
def signed_tokens_decode(spark, d):
    """Signed-token lines, written to a folder and read from it."""
    path = fresh_path(spark, "signed")
    inputs.texts(spark, d).select(F.transform(ENC.ids("text"), lambda x, i: F.when(
        (i + 1) % 3 == 0, -x).when((i + 1) % 11 == 0, 0).otherwise(x)).alias("tokens")).write.json(path)
    kept = rd.read_signed(spark, path, min_length=50).withColumn("num_tokens", F.col("length"))
    return shown(kept.withColumn("input_ids", tk.signed_to_ids("tokens")).withColumn("labels", tk.signed_to_labels("tokens")))


def _tool_parts(spark, d):
    t = inputs.turns(spark, d)
    said = F.array(*[F.struct(F.lit(k).alias("key"), F.concat(*v).alias("value")) for k, v in {
        "Human": [F.lit("<|Human|>: "), F.col("input"), F.lit("<eoh>\n")],
        "Inner Thoughts": [F.lit("<|Inner Thoughts|>: ask MOSS<eot>\n")],
        "Tool Responses": [F.lit("<|Results|>: found "), F.col("system"), F.lit(" by MOSS <eor>\n")],
        "MOSS": [F.lit("<|MOSS|>: "), F.col("output"), F.lit(" <eom>\n")]}.items()])
    return t.select("sample_id", "turn_no", F.concat(F.lit("MOSS no "), F.col("sample_id").cast("string")).alias("meta_instruction"),
                    F.posexplode(said).alias("key_no", "e")).select("*", "e.key", "e.value").drop("e")


def _tool_list(expr: str) -> str:
    return f"[{expr}]"


_TOOL_SQL = f"""
WITH {sql.TURNS},
k AS (SELECT sample_id, turn_no, {sql.ids("'<|Human|>: ' || input || '<eoh>' || chr(10)")} AS h,
        {sql.ids("'<|Inner Thoughts|>: ask Ada<eot>' || chr(10)")} AS i, {sql.ids("'<|Results|>: found ' || replace(system, 'MOSS', 'Ada') || ' by Ada <eor>' || chr(10)")} AS r,
        {sql.ids("'<|MOSS|>: ' || output || ' <eom>' || chr(10)")} AS mm,
        {sql.ids("'<|Ada|>: ' || output || ' <eom>' || chr(10)")} AS m FROM turns),
p AS (SELECT sample_id, turn_no, list_concat(h, i, r, m) AS ids, list_concat(h, i,
        list_transform(r, lambda x, j: CASE WHEN j > 1 AND j <= len(r) - 1 THEN -100 ELSE x END), m) AS labels FROM k),
a AS (SELECT *, 1 + {sql.n_words("'Ada no ' || sample_id")} + sum(len(ids)) OVER (PARTITION BY sample_id ORDER BY turn_no) AS upto FROM p),
w AS (SELECT sample_id, count(*) AS n_turns, list_concat([CAST(1 AS BIGINT)], {sql.ids("'Ada no ' || sample_id")}) AS lead,
        flatten(list(ids ORDER BY turn_no)) AS ids, flatten(list(labels ORDER BY turn_no)) AS labels FROM a WHERE upto <= 300 GROUP BY sample_id)
SELECT sample_id, n_turns, CAST(len(lead) + len(ids) AS BIGINT) AS num_tokens, {sql.text('list_concat(lead, ids)')} AS input_ids,
       {sql.text(f"list_concat({sql.masked('lead')}, labels)")} AS labels FROM w"""


@query("encode_tool_dialogue", _TOOL_SQL)
def encode_tool_dialogue(spark, d):
    out = en.encode_tool_dialogue(_tool_parts(spark, d), ENC, max_length=300, bot_name="Ada")
    return shown(out, "sample_id", "n_turns")


@query("encode_tool_records", f"SELECT sample_id, 'moss' AS source, n_turns, num_tokens, input_ids, labels FROM ({_TOOL_SQL})")
def encode_tool_records(spark, d):
    """The same dialogues as nested JSON records: written, read, flattened and encoded."""
    parts = _tool_parts(spark, d)
    said = parts.groupBy("sample_id", "meta_instruction", "turn_no").agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("key_no", "key", "value"))), lambda p: F.struct(p["key"], p["value"]))).alias("said"))
    records = said.groupBy("sample_id", "meta_instruction").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("turn_"), (F.col("turn_no") + 1).cast("string")), "said"))).alias("chat"),
        F.count(F.lit(1)).alias("num_turns"))
    path = fresh_path(spark, "tool-records")
    records.write.json(path)
    schema = "sample_id long, meta_instruction string, chat map<string, map<string, string>>, num_turns long"
    coded = build_tool_dialogues({"moss": spark.read.schema(schema).json(path)}, ENC, id_col="sample_id", max_length=300, bot_name="Ada")
    return shown(coded, "sample_id", "source", "n_turns")


_VIS_SYS = "You see images."


@query("encode_vision", f"""
WITH m AS (SELECT conv_id AS sample_id, turn, role, CASE WHEN role = 'user' THEN {sql.strip(f'''CASE
           WHEN conv_id % 3 = 0 THEN {sql.strip("'<img>' || repeat('<IMG_CONTEXT>', 4) || '</img>' || chr(10) || " + sql.strip("'see  and ' || text"))}
           WHEN conv_id % 3 = 1 THEN 'see  and ' || text ELSE text END''')} ELSE text END AS content FROM conversations WHERE role <> 'system'),
n AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w, 0) AS grp,
        coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) AS opened
      FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT sample_id, grp, min(opened) = 0 AS is_first, coalesce(string_agg(content, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS input,
        max(content) FILTER (WHERE role = 'assistant') AS output
      FROM n WHERE NOT (role = 'assistant' AND opened = 0) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE role = 'assistant') > 0),
t AS (SELECT sample_id, grp, is_first, CASE WHEN is_first THEN '<|im_start|>system' || chr(10) || '{_VIS_SYS}' || '<|im_end|>' || chr(10) ELSE '' END ||
        '<|im_start|>user' || chr(10) || input || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS a,
        {sql.strip('output')} || '<|im_end|>' AS b FROM g),
e AS (SELECT sample_id, grp, is_first, {sql.ids('a')} AS ai, {sql.ids('b')} AS bi FROM t),
w AS (SELECT sample_id, flatten(list(list_concat(CASE WHEN is_first THEN [CAST(1 AS BIGINT)] ELSE [] END, ai, bi) ORDER BY grp))[1:400] AS input_ids,
        flatten(list(list_concat(CASE WHEN is_first THEN [CAST(-100 AS BIGINT)] ELSE [] END, {sql.masked('ai')}, bi) ORDER BY grp))[1:400] AS labels
      FROM e GROUP BY sample_id)
SELECT sample_id, CAST(len(input_ids) AS BIGINT) AS num_tokens, {sql.text('input_ids')} AS input_ids, {sql.text('labels')} AS labels FROM w""")
def encode_vision(spark, d):
    m = inputs.messages(spark, d).where("role <> 'system'")
    third = F.col("sample_id") % 3
    raw = F.when(third < 2, F.concat(F.lit("see <image> and "), "content")).otherwise(F.col("content"))
    image = F.when(third == 0, en.image_token_text(4))
    m = m.withColumn("content", F.when(F.col("role") == "user", en.vision_text(raw, image)).otherwise(F.col("content")))
    return shown(en.encode_vision(fm.pair_turns(m), catalog.TEMPLATES["qwen_chat"], _VIS_SYS, ENC, max_length=400), "sample_id")


@query("rl_labels", f"""
WITH {_PAIR_ROWS}, e AS (SELECT conv_id * 1000 + turn AS pair_id, {sql.ids('question')} AS q, {sql.ids('chosen')} AS r FROM p)
SELECT pair_id, CAST(len(q) + len(r) AS BIGINT) AS num_tokens, {sql.text('list_concat(q, r)')} AS input_ids,
       {sql.text(f"list_concat({sql.masked('q[2:]')}, r, [-100])")} AS labels FROM e""")
def rl_labels(spark, d):
    p = pair_texts(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
                                    ENC.ids("question").alias("q"), ENC.ids("chosen").alias("r"))
    return shown(p.select("pair_id", F.concat("q", "r").alias("input_ids"), en.rl_labels("q", "r").alias("labels"))
                 .withColumn("num_tokens", F.size("input_ids")), "pair_id")


_WORDS = f"""
vw AS (SELECT DISTINCT unnest({sql.words('x')}) AS word FROM (
  SELECT input AS x FROM rendered UNION ALL SELECT output FROM rendered UNION ALL SELECT sep FROM rendered)),
vocab AS (SELECT CAST('0x' || substr(md5(word), 1, 7) AS BIGINT) + 1 AS token_id, min(word) AS word FROM vw GROUP BY 1)
"""


@query("decode_preview", f"""
WITH {sql.samples(128)}, {_WORDS},
f AS (SELECT sample_id, unnest(input_ids) AS token_id, unnest(labels) AS label, generate_subscripts(input_ids, 1) AS pos
      FROM (SELECT * FROM samples ORDER BY sample_id LIMIT 20)),
n AS (SELECT sample_id, pos, label, coalesce(word, '<' || f.token_id || '>') AS w FROM f LEFT JOIN vocab USING (token_id))
SELECT sample_id, string_agg(w, ' ' ORDER BY pos) AS text, string_agg(CASE WHEN label >= 0 THEN w ELSE '[-100]' END, ' ' ORDER BY pos) AS masked_text,
       CAST(count(*) AS INTEGER) AS n_tokens FROM n GROUP BY sample_id""")
def decode_preview(spark, d):
    r = inputs.rendered(spark, d)
    used = r.select(F.explode(F.concat(*[tk.words(c) for c in ("input", "output", "sep")])).alias("word"))
    vocab = used.groupBy(tk.hash_id(F.col("word")).alias("token_id")).agg(F.min("word").alias("word"))
    return en.decode_preview(en.encode_sft(r, ENC, max_length=128), vocab, k=20)


@query("vocab_build", f"""
WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({sql.words('text')}) AS word FROM documents) GROUP BY word),
r AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, md5(word), word) - 1 AS token_id FROM c),
s AS (SELECT * FROM (VALUES {', '.join(f"({sql.lit(w)}, {i})" for i, w in enumerate(catalog.SPECIAL_TOKENS))}) v(word, pos))
SELECT word, n, token_id FROM r UNION ALL
SELECT word, CAST(0 AS BIGINT), (SELECT count(*) FROM c) + row_number() OVER (ORDER BY pos) - 1 FROM s WHERE word NOT IN (SELECT word FROM c)""")
def vocab_build(spark, d):
    return en.build_vocab(stage(en.word_counts(inputs.texts(spark, d), "text"), "words"))


@query("encode_vocab", f"""
WITH w AS (SELECT conv_id * 1000 + turn AS msg_id, {sql.words('text')} AS ws FROM conversations),
x AS (SELECT msg_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
c AS (SELECT word, count(*) AS n FROM x GROUP BY word),
r AS (SELECT word, row_number() OVER (ORDER BY n DESC, md5(word), word) - 1 AS token_id FROM c)
SELECT msg_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY pos) AS input_ids FROM x JOIN r USING (word) GROUP BY msg_id""")
def encode_vocab(spark, d):
    m = inputs.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")
    coded = en.encode_with_vocab(m, "msg_id", "text", en.build_vocab(stage(en.word_counts(m, "text"), "words")))
    return coded.select("msg_id", joined("input_ids").alias("input_ids"))


@query("encode_sft_vocab", f"""
WITH {sql.samples(256)},
x AS (SELECT sample_id, unnest(input_ids) AS tok, unnest(labels) AS label, generate_subscripts(input_ids, 1) AS pos FROM samples),
c AS (SELECT tok, count(*) AS n FROM x WHERE tok >= 3 GROUP BY tok),
r AS (SELECT tok, row_number() OVER (ORDER BY n DESC, tok) + 2 AS id FROM c),
m AS (SELECT sample_id, pos, coalesce(id, tok) AS id, CASE WHEN label >= 0 THEN coalesce(id, tok) ELSE label END AS label FROM x LEFT JOIN r USING (tok))
SELECT sample_id, count(*) AS num_tokens, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS input_ids,
       string_agg(CAST(label AS VARCHAR), ',' ORDER BY pos) AS labels FROM m GROUP BY sample_id""")
def encode_sft_vocab(spark, d):
    """Dialogues in the ids of a frequency-ranked vocabulary built from themselves."""
    s = stage(inputs.samples(spark, d, 256), "samples")
    return shown(en.apply_ranks(s, en.rank_ids(s)), "sample_id")


@query("drop_empty", "SELECT doc_id, lang || chr(10) || substr(text, 1, 40) AS input FROM documents WHERE doc_id % 17 <> 0")
def drop_empty(spark, d):
    from turnmill.plans.formats import _alpaca
    kept = en.drop_empty(fm.normalise(_alpaca(spark, d), "alpaca"))
    return kept.select("doc_id", F.get("conversation", F.lit(0))["input"].alias("input"))


@query("drop_unsupervised", f"""
WITH {sql.samples(64)}
SELECT sample_id, num_tokens, CAST(len(list_filter(labels, lambda x: x >= 0)) AS BIGINT) AS n_supervised
FROM samples WHERE sample_id % 3 <> 0 AND len(list_filter(labels, lambda x: x >= 0)) > 0""")
def drop_unsupervised(spark, d):
    r = inputs.rendered(spark, d).withColumn("output_with_loss", F.col("sample_id") % 3 != 0)
    kept = en.drop_unsupervised(en.encode_sft(r, ENC, max_length=64))
    return kept.select("sample_id", F.col("num_tokens").cast("long").alias("num_tokens"),
                       tk.supervised("labels").cast("long").alias("n_supervised"))


@query("min_length", f"SELECT doc_id, {sql.n_words('text')} AS num_tokens FROM documents WHERE len({sql.words('text')}) >= 50")
def min_length(spark, d):
    return en.min_length(inputs.document_lengths(spark, d), 50).select(F.col("sample_id").alias("doc_id"), "num_tokens")


@query("max_length", f"""
WITH n AS (SELECT source, len({sql.words('text')}) AS n FROM documents)
SELECT source, count(*) FILTER (WHERE n < 256) AS n_kept, count(*) FILTER (WHERE n >= 256) AS n_dropped FROM n GROUP BY source""")
def max_length(spark, d):
    docs = inputs.document_lengths(spark, d)
    kept = en.max_length(docs, 256).groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"))
    whole = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    n_kept = F.coalesce("n_kept", F.lit(0))
    return whole.join(kept, "source", "left").select("source", n_kept.alias("n_kept"), (F.col("n") - n_kept).alias("n_dropped"))


@query("category_date_filter", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(o_orderdate AS DATE) AS o_orderdate, p_type || ' ' || p_name AS categories
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND list_has_any(string_split(p_type || ' ' || p_name, ' '), ['SMALL', 'ring', 'hot'])""")
def category_date_filter(spark, d):
    rows = (inputs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
            .join(inputs.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
            .join(inputs.table(spark, d, "part").select(
                F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_name").alias("categories")), "l_partkey"))
    return en.category_since(rows, ["SMALL", "ring", "hot"], "1998-01-01", date="o_orderdate").withColumn(
        "o_orderdate", F.col("o_orderdate").cast("date"))
