"""Queries: record normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.operators import formats as fm
from turnmill.plans import inputs, sql
from turnmill.plans.registry import query

_ALPACA = """
alpaca AS (
  SELECT doc_id, lang AS instruction, substr(text, 1, 40) AS input,
         CASE WHEN doc_id % 17 = 0 THEN '<nooutput>' ELSE substr(text, 41) END AS output FROM documents)
"""


def _alpaca(spark, d):
    t = F.col("text")
    return inputs.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("instruction"), F.substring(t, 1, 40).alias("input"),
        F.when(F.col("doc_id") % 17 == 0, "<nooutput>").otherwise(F.substring(t, F.lit(41), F.length(t))).alias("output"))


def _flat(df, *ids):
    """Array form -> one row per turn."""
    return df.select(*ids, F.posexplode("conversation").alias("turn_no", "t")).select(
        *ids, F.col("turn_no").cast("long").alias("turn_no"), F.col("t.system").alias("system"),
        F.col("t.input").alias("input"), F.col("t.output").alias("output"))


def _at_once(docs, shapes):
    """Several formats of one table in one scan: ``(doc_id, format, conversation)``; ``shapes`` names each format's columns."""
    df = docs
    for k, (name, cols) in enumerate(shapes.items()):
        df = fm.normalise(df.withColumns(cols), name).drop(*cols).withColumnRenamed("conversation", f"_c{k}")
    each = [F.struct(F.lit(name).alias("format"), F.col(f"_c{k}").alias("conversation")) for k, name in enumerate(shapes)]
    return df.select("doc_id", F.inline(F.array(*each)))


@query("fmt_alpaca", f"""
WITH {_ALPACA}
SELECT doc_id, CAST(CASE WHEN output = '<nooutput>' THEN 0 ELSE 1 END AS BIGINT) AS n_turns,
       CASE WHEN output <> '<nooutput>' THEN instruction || chr(10) || input END AS input,
       CASE WHEN output <> '<nooutput>' THEN output END AS output
FROM alpaca""")
def fmt_alpaca(spark, d):
    df = fm.normalise(_alpaca(spark, d), "alpaca")
    first = F.get("conversation", F.lit(0))
    return df.select("doc_id", F.size("conversation").cast("long").alias("n_turns"),
                     first["input"].alias("input"), first["output"].alias("output"))


@query("fmt_two_field", """
SELECT doc_id, CAST(0 AS BIGINT) AS turn_no, lang || chr(10) || substr(text, 1, 40) AS input, substr(text, 41) AS output
FROM documents""")
def fmt_two_field(spark, d):
    t = F.col("text")
    raw = inputs.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("instruction_zh"), F.substring(t, 1, 40).alias("input_zh"),
        F.substring(t, F.lit(41), F.length(t)).alias("output_zh"))
    return _flat(fm.normalise(raw, "alpaca_zh"), "doc_id").drop("system")


_FIXED = {
    "arxiv": ("arxiv_gentile", "text"), "code_alpaca": ("coder", "text"), "crime_kg_assitan": ("lawyer", "text"),
    "law_reference": ("lawyer", "text"), "medical": ("medical", "lang || chr(10) || text"),
    "sql": ("sql", "lang || chr(10) || text"), "tiny_codes": ("coder", "text"),
}


@query("fmt_fixed_system", "\nUNION ALL\n".join(
    f"SELECT '{f}' AS format, doc_id, {sql.lit(catalog.SYSTEMS[s])} AS system, {i} AS input, source AS output FROM documents"
    for f, (s, i) in _FIXED.items()))
def fmt_fixed_system(spark, d):
    names = {"arxiv": ("abstract", None, "title"), "code_alpaca": ("prompt", None, "completion"),
             "crime_kg_assitan": ("input", None, "output"), "law_reference": ("question", None, "answer"),
             "medical": ("input", "instruction", "output"), "sql": ("question", "context", "answer"),
             "tiny_codes": ("prompt", None, "response")}
    shapes = {f: {first: F.col("text"), answer: F.col("source"), **({second: F.col("lang")} if second else {})}
              for f, (first, second, answer) in names.items()}
    docs = inputs.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return _flat(_at_once(docs, shapes), "format", "doc_id").drop("turn_no")


@query("fmt_colors", f"""
SELECT doc_id, {sql.lit(catalog.SYSTEMS['colorist'])} AS system,
       {sql.strip("substr(t, instr(t, ':') + 1)")} AS input, lang AS output
FROM (SELECT doc_id, lang, source || ': ' || text || ' ' AS t FROM documents)""")
def fmt_colors(spark, d):
    raw = inputs.table(spark, d, "documents").select(
        "doc_id", F.concat("source", F.lit(": "), "text", F.lit(" ")).alias("description"), F.col("lang").alias("color"))
    return _flat(fm.normalise(raw, "colors"), "doc_id").drop("turn_no")


@query("fmt_default", "\nUNION ALL\n".join(
    f"SELECT '{f}' AS format, doc_id, {s} AS system, lang AS input, text AS output FROM documents"
    for f, s in {"default": "CAST(NULL AS VARCHAR)", "openorca": "source", "stack_exchange": "CAST(NULL AS VARCHAR)",
                 "role_expert": "CAST(NULL AS VARCHAR)", "role_teacher": "CAST(NULL AS VARCHAR)"}.items()))
def fmt_default(spark, d):
    names = {"default": ("input", "output"), "openorca": ("question", "response"), "stack_exchange": ("question", "response"),
             "role_expert": ("input", "output"), "role_teacher": ("question", "answer")}
    shapes = {f: {"system_prompt": F.col("source"), a: F.col("lang"), b: F.col("text")} for f, (a, b) in names.items()}
    docs = inputs.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return _flat(_at_once(docs, shapes), "format", "doc_id").drop("turn_no")


@query("fmt_pretrain", f"SELECT doc_id, '' AS input, {sql.strip('text')} AS output, FALSE AS need_eos_token FROM documents")
def fmt_pretrain(spark, d):
    df = fm.normalise(inputs.table(spark, d, "documents").select("doc_id", "text"), "pretrain")
    t = F.get("conversation", F.lit(0))
    return df.select("doc_id", t["input"].alias("input"), t["output"].alias("output"),
                     t["need_eos_token"].alias("need_eos_token"))


_PAIRED_NO_SYSTEM = f"WITH {sql.TURNS} SELECT sample_id, turn_no, input, output FROM turns"


@query("turn_pairing", _PAIRED_NO_SYSTEM)
def turn_pairing(spark, d):
    return inputs.turns(spark, d).select("sample_id", "turn_no", "input", "output")


@query("fmt_openai", f"""
WITH {sql.TURNS}
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY turn_no) - 1 AS turn_no, system, input, output,
       output_with_loss FROM turns""")
def fmt_openai(spark, d):
    """Array form, the list under one of three keys: it is folded in place, without a shuffle."""
    lists, key = inputs.message_lists(spark, d), F.col("sample_id") % 3
    df = fm.normalise(lists.select("sample_id", *[F.when(key == k, F.col("messages")).alias(name) for k, name in enumerate(
        ("message_data", "dialogs", "messages"))]), "openai")
    return df.select("sample_id", F.posexplode("conversation").alias("turn_no", "t")).select(
        "sample_id", F.col("turn_no").cast("long").alias("turn_no"), F.col("t.system").alias("system"),
        F.col("t.input").alias("input"), F.col("t.output").alias("output"),
        F.col("t.output_with_loss").alias("output_with_loss"))


def _sharegpt(spark, d):
    """human / gpt messages without system; every third conversation shows an image in its human texts."""
    m = inputs.messages(spark, d).where("role <> 'system'")
    who = F.when(F.col("role") == "user", "human").otherwise("gpt")
    shown = F.when((F.col("role") == "user") & (F.col("sample_id") % 3 == 0),
                   F.concat(F.lit("see <image> and "), "content")).otherwise(F.col("content"))
    return m.select("sample_id", "turn", who.alias("from"), shown.alias("value")).groupBy("sample_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "from", "value"))),
        lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def _sharegpt_sql(edit: str) -> str:
    return f"""
WITH m AS (SELECT conv_id AS sample_id, turn, role,
       CASE WHEN role = 'user' THEN {edit} ELSE text END AS content FROM (
         SELECT conv_id, turn, role, text, CASE WHEN role = 'user' AND conv_id % 3 = 0
                THEN 'see <image> and ' || text ELSE text END AS shown FROM conversations WHERE role <> 'system')),
n AS (SELECT *, coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER w, 0) AS grp,
        coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) AS opened
      FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT sample_id, grp, coalesce(string_agg(content, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS input,
        max(content) FILTER (WHERE role = 'assistant') AS output
      FROM n WHERE NOT (role = 'assistant' AND opened = 0) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE role = 'assistant') > 0)
SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY grp) - 1 AS turn_no, input, output FROM g"""


_IMAGE_FIRST = ("CASE WHEN contains(shown, '<image>') THEN "
                + sql.strip("'<image>' || chr(10) || " + sql.strip("replace(shown, '<image>', '')")) + " ELSE shown END")


@query("fmt_llava", _sharegpt_sql(_IMAGE_FIRST))
def fmt_llava(spark, d):
    return _flat(fm.normalise(_sharegpt(spark, d), "llava"), "sample_id").drop("system")


@query("fmt_wizardlm", _sharegpt_sql("shown"))
def fmt_wizardlm(spark, d):
    return _flat(fm.normalise(_sharegpt(spark, d), "wizardlm"), "sample_id").drop("system")


@query("fmt_image_only", f"""
SELECT * FROM ({_sharegpt_sql("'<image>'")}) WHERE sample_id % 3 = 0""")
def fmt_image_only(spark, d):
    """Records whose human texts lack an image are rejects."""
    df = fm.normalise(_sharegpt(spark, d), "llava_image_only")
    has_human = F.exists("conversations", lambda m: m["from"] == "human")
    return _flat(df.where(has_human), "sample_id").drop("system")


_OASST = """
t AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '### Human: ' ELSE '### Assistant: ' END || text, '' ORDER BY turn)
        AS text FROM conversations WHERE role <> 'system' GROUP BY conv_id)
"""


@query("fmt_oasst1", f"""
WITH {_OASST},
s AS (SELECT conv_id, {sql.strip('piece')} AS p, pos FROM (
        SELECT conv_id, unnest(string_split(text, '###')) AS piece, generate_subscripts(string_split(text, '###'), 1) AS pos FROM t)),
b AS (SELECT conv_id, pos, {sql.strip("CASE WHEN starts_with(p, 'Human:') THEN substr(p, 7) ELSE substr(p, 11) END")} AS body
      FROM s WHERE starts_with(p, 'Human:') OR starts_with(p, 'Assistant:')),
r AS (SELECT conv_id, body, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS rn,
        count(*) OVER (PARTITION BY conv_id) AS n FROM b)
SELECT conv_id, CAST(rn // 2 AS BIGINT) AS turn_no, max(body) FILTER (WHERE rn % 2 = 0) AS input,
       max(body) FILTER (WHERE rn % 2 = 1) AS output
FROM r WHERE rn < n - n % 2 GROUP BY conv_id, rn // 2""")
def fmt_oasst1(spark, d):
    m = inputs.messages(spark, d).where("role <> 'system'")
    said = F.concat(F.when(F.col("role") == "user", "### Human: ").otherwise("### Assistant: "), "content")
    texts = m.select(F.col("sample_id").alias("conv_id"), "turn", said.alias("s")).groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]), "").alias("text"))
    return _flat(fm.normalise(texts, "oasst1"), "conv_id").drop("system")


@query("fmt_positional_pairs", """
WITH n AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
SELECT conv_id AS sample_id, CAST(turn // 2 AS BIGINT) AS turn_no, max(text) FILTER (WHERE turn % 2 = 0) AS input,
       max(text) FILTER (WHERE turn % 2 = 1) AS output, FALSE AS rejected
FROM n WHERE c % 2 = 0 GROUP BY conv_id, turn // 2
UNION ALL
SELECT DISTINCT conv_id, CAST(NULL AS BIGINT), NULL, NULL, TRUE FROM n WHERE c % 2 = 1""")
def fmt_positional_pairs(spark, d):
    good, odd = fm.positional_turns(inputs.messages(spark, d))
    none = F.lit(None)
    return good.withColumn("rejected", F.lit(False)).unionByName(odd.select(
        "sample_id", none.cast("long").alias("turn_no"), none.cast("string").alias("input"),
        none.cast("string").alias("output"), F.lit(True).alias("rejected")))


@query("fmt_nested", """
SELECT doc_id, CAST(i AS BIGINT) AS turn_no, CASE WHEN i = 0 THEN source END AS system, lang AS input,
       string_split(text, chr(10))[i + 1] AS output
FROM (SELECT doc_id, source, lang, text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)""")
def fmt_nested(spark, d):
    """Documents as nested dialogues: one turn per line."""
    docs = inputs.table(spark, d, "documents")
    raw = docs.select("doc_id", F.transform(F.split("text", "\n"), lambda line, i: F.struct(
        F.when(i == 0, F.col("source")).alias("toy_system"), F.col("lang").alias("toy_input"),
        line.alias("toy_output"))).alias("messages"))
    return _flat(fm.normalise(raw, "multi_turn_nested"), "doc_id")


@query("conv_to_messages", f"""
WITH {sql.TURNS}
SELECT sample_id, turn_no, 0 AS part, 'system' AS role, system AS content FROM turns WHERE system <> ''
UNION ALL SELECT sample_id, turn_no, 1, 'user', input FROM turns
UNION ALL SELECT sample_id, turn_no, 2, 'assistant', output FROM turns""")
def conv_to_messages(spark, d):
    return fm.to_messages(inputs.turns(spark, d))


def _image_messages(spark, d):
    """User texts carry an image mark in front and one behind where the text has a comma."""
    m = inputs.messages(spark, d)
    shown = F.when(F.col("role") == "user", F.concat(
        F.lit("look "), F.lit("<image>"), "content", F.when(F.contains("content", F.lit(",")), F.lit("<image>")).otherwise(
            F.lit("")))).otherwise(F.col("content"))
    urls = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(
        F.lit("img/"), F.col("sample_id").cast("string"), F.lit("_"), k.cast("string"), F.lit(".jpg")))
    return m.select("sample_id", "turn", "role", shown.alias("content"), urls.alias("images"))


def _parts_sql(order: str) -> str:
    return f"""
WITH m AS (SELECT conv_id AS sample_id, turn, role, CASE WHEN role = 'user' THEN 'look <image>' || text ||
         CASE WHEN contains(text, ',') THEN '<image>' ELSE '' END ELSE text END AS content FROM conversations),
s AS (SELECT sample_id, turn, role, content, unnest(CASE WHEN role = 'user' THEN string_split(content, '<image>') ELSE [content] END) AS piece,
        generate_subscripts(CASE WHEN role = 'user' THEN string_split(content, '<image>') ELSE [content] END, 1) - 1 AS k FROM m),
seen AS (SELECT sample_id, turn, coalesce(sum(CASE WHEN role = 'user' THEN len(string_split(content, '<image>')) - 1 ELSE 0 END) OVER
        (PARTITION BY sample_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
p AS (SELECT sample_id, turn, role, 2 * k AS spot, 'text' AS type, {sql.strip('piece')} AS value FROM s
        WHERE role = 'user' AND {sql.strip('piece')} <> ''
      UNION ALL SELECT sample_id, turn, role, 0, 'text', content FROM m WHERE role <> 'user'
      UNION ALL SELECT s.sample_id, s.turn, role, 2 * k - 1, 'image_url',
        'img/' || s.sample_id || '_' || CAST(before + k - 1 AS BIGINT) || '.jpg' FROM s JOIN seen USING (sample_id, turn)
        WHERE role = 'user' AND k > 0)
SELECT sample_id, turn, role, CAST(row_number() OVER (PARTITION BY sample_id, turn ORDER BY {order}) - 1 AS INTEGER) AS part,
       type, value FROM p"""


@query("llava_parts", _parts_sql("type, spot"))
def llava_parts(spark, d):
    return fm.image_parts(_image_messages(spark, d))


@query("llava_parts_interleave", _parts_sql("spot"))
def llava_parts_interleave(spark, d):
    return fm.image_parts(_image_messages(spark, d), interleave=True)


_PAIR_ROWS = """
p AS (SELECT a.conv_id, a.turn, u.text AS question, a.text AS chosen, b.text AS rejected
      FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
      JOIN conversations b ON b.conv_id = a.conv_id + 1 AND b.turn = a.turn AND b.role = 'assistant'
      WHERE a.role = 'assistant')
"""


def pair_texts(spark, d):
    """Chosen: an assistant message; rejected: the one of the next conversation at the same turn."""
    m = inputs.table(spark, d, "conversations")
    a = m.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("chosen"))
    u = m.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    b = m.where("role = 'assistant'").select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("text").alias("rejected"))
    return a.join(u, ["conv_id", "turn"]).join(b, ["conv_id", "turn"])


def pair_lists(spark, d):
    return fm.orca_pairs(pair_texts(spark, d).withColumn("system", F.lit("Be brief."))).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "prompt", "chosen", "rejected")


@query("fmt_preference", f"""
WITH {_PAIR_ROWS}
SELECT 'orca' AS format, conv_id * 1000 + turn AS pair_id, 'system=Be brief.|user=' || question AS prompt, 'assistant=' || chosen AS chosen,
       'assistant=' || rejected AS rejected FROM p
UNION ALL
SELECT 'mix', conv_id * 1000 + turn, 'user=' || question, 'assistant=' || chosen, 'assistant=' || rejected FROM p""")
def fmt_preference(spark, d):
    t = pair_texts(spark, d).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    orca = fm.orca_pairs(t.withColumn("system", F.lit("Be brief.")))
    user = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    said = lambda c: F.struct(F.lit("assistant").alias("role"), F.col(c).alias("content"))
    mixed = fm.mixed_pairs(t.select("pair_id", F.array(user, said("chosen")).alias("chosen"),
                                    F.array(user, said("rejected")).alias("rejected")))
    show = lambda c: F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")
    cols = lambda name: [F.lit(name).alias("format"), "pair_id", *[show(c).alias(c) for c in ("prompt", "chosen", "rejected")]]
    return orca.select(*cols("orca")).unionByName(mixed.select(*cols("mix")))


def _react_messages(spark, d):
    """Tool dialogues: system texts list one tool; assistant texts of some turns call it."""
    m = inputs.messages(spark, d)
    tool = F.concat("content", F.lit(' {"name": "search", "description": "find pages"} end'))
    call = F.concat(F.lit('check<|startofthink|>```JSON\n{"api_name": "search", "parameters": {"id": '),
                    F.col("sample_id").cast("string"),
                    F.lit('}}```<|endofthink|><|startofexec|>```JSON\n{"ok": true}```<|endofexec|>'), "content")
    text = (F.when(F.col("role") == "system", tool)
            .when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), call).otherwise(F.col("content")))
    return m.select("sample_id", "turn", "role", text.alias("content"))


_REACT_SYS = sql.lit(fm.REACT_HEAD + "{'search': 'find pages'}\n" + fm.REACT_FORMAT.replace("{names}", "['search']"))


@query("fmt_react", f"""
WITH m AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n,
             coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM conversations),
g AS (SELECT conv_id, grp, coalesce(string_agg({_REACT_SYS}, '') FILTER (WHERE role = 'system'), '') AS system,
        coalesce(string_agg(text || chr(10), '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS input,
        max(text) FILTER (WHERE role = 'assistant') AS said, max(turn) FILTER (WHERE role = 'assistant') AS spot
      FROM m WHERE n >= 2 GROUP BY conv_id, grp HAVING count(*) FILTER (WHERE role = 'assistant') > 0)
SELECT conv_id AS sample_id, CAST(2 * grp AS BIGINT) AS turn_no, system, input,
       CASE WHEN spot % 4 = 1 THEN 'Thought:check' || chr(10) || 'Action:search' || chr(10) || 'Action Input:{{''id'': ' || conv_id || '}}' ||
            chr(10) || chr(10) ELSE 'Final Answer:' || said || chr(10) END AS output FROM g
UNION ALL
SELECT conv_id, CAST(2 * grp + 1 AS BIGINT), 'Response:{{''ok'': True}}' || chr(10), NULL,
       'Final Answer:' || {sql.strip('said')} || chr(10) FROM g WHERE spot % 4 = 1""")
def fmt_react(spark, d):
    return fm.react_turns(_react_messages(spark, d))
