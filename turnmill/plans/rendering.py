"""Queries: prompt rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.operators import formats as fm
from turnmill.operators import render as rn
from turnmill.plans import inputs, sql
from turnmill.plans.registry import query


@query("render_template", f"WITH {sql.RENDERED} SELECT sample_id, turn_no, input, output, need_eos_token, sep FROM rendered")
def render_template(spark, d):
    return inputs.rendered(spark, d).select("sample_id", "turn_no", "input", "output", "need_eos_token", "sep")


@query("render_round", f"""
WITH {sql.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY turn_no) AS round FROM turns)
SELECT sample_id, CAST(round - 1 AS BIGINT) AS turn_no,
       CASE WHEN system <> '' THEN system || chr(10) ELSE '' END || '[Round ' || round || ']' || chr(10) || chr(10) || '问：' || input
       || chr(10) || chr(10) || '答：' AS input, output, TRUE AS need_eos_token, chr(10) || chr(10) AS sep FROM r""")
def render_round(spark, d):
    turns = rn.render_turns(inputs.turns(spark, d), "chatglm2")
    return turns.select("sample_id", "turn_no", "input", "output", "need_eos_token", "sep")


def _template_sql(name: str) -> str:
    t = catalog.TEMPLATES[name]
    body = f"replace(replace({sql.lit(t.instruction)}, '{{round}}', CAST(turn_no + 1 AS VARCHAR)), '{{input}}', input)"
    if t.system is None:
        shown = f"CASE WHEN system = '' THEN {body} END"
    else:
        shown = f"CASE WHEN system <> '' THEN replace({sql.lit(t.system)}, '{{system}}', system) ELSE '' END || {body}"
    return (f"SELECT {sql.lit(name)} AS template, count(*) AS n_turns, count(*) FILTER (WHERE ({shown}) IS NULL) AS n_rejects, "
            f"CAST(sum(length({shown}) + length(output || {sql.lit(t.suffix)})) AS BIGINT) AS n_chars FROM turns")


@query("template_catalog", f"WITH {sql.TURNS} " + "\nUNION ALL\n".join(_template_sql(n) for n in catalog.TEMPLATES))
def template_catalog(spark, d):
    return rn.rendered_sizes(inputs.turns(spark, d))


@query("template_lint", f"WITH {sql.TURNS} " + "\nUNION ALL\n".join(
    f"SELECT {sql.lit(n)} AS template, '' AS faults, {'FALSE' if t.system is None else 'TRUE'} AS has_system, count(*) AS n_turns, "
    f"count(*) FILTER (WHERE {' OR '.join(f'contains(input, {sql.lit(w)})' for w in t.stop_words) or 'FALSE'}) AS n_marked FROM turns"
    for n, t in catalog.TEMPLATES.items()))
def template_lint(spark, d):
    return rn.marked_inputs(inputs.turns(spark, d))


def _chat_sql(t) -> str:
    cases = " ".join(f"WHEN role = '{r}' THEN replace({sql.lit(getattr(t, r))}, '{{{r}}}', text)" for r in ("system", "user", "assistant"))
    return (f"SELECT conv_id AS sample_id, turn, role, CASE {cases} END AS prompt, "
            f"CASE WHEN role = 'assistant' THEN {sql.lit(t.sep)} ELSE '' END AS tail FROM conversations")


@query("render_chat", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS template, * FROM ({_chat_sql(t)})" for n, t in catalog.CHAT_TEMPLATES.items()))
def render_chat(spark, d):
    """All templates in one scan."""
    m, shown = inputs.messages(spark, d), []
    for k, name in enumerate(catalog.CHAT_TEMPLATES):
        m = rn.render_messages(m, name).withColumnsRenamed({"prompt": f"_p{k}", "tail": f"_t{k}"})
        shown.append(F.struct(F.lit(name).alias("template"), F.col(f"_p{k}").alias("prompt"), F.col(f"_t{k}").alias("tail")))
    return m.select("sample_id", "turn", "role", F.inline(F.array(*shown)))


def sub_role_messages(spark, d):
    """Messages with tool and thought roles, names, a type and a loss flag."""
    m = inputs.messages(spark, d)
    role = (F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool")
            .when((F.col("role") == "user") & (F.col("turn") % 6 == 4), "thought").otherwise(F.col("role")))
    name = (F.when(role == "tool", "plugin").when(role == "system", "interpreter")
            .when((role == "user") & (F.col("sample_id") % 2 == 0), "bob"))
    kind = F.when(F.col("sample_id") % 4 == 0, "icl").when(F.col("sample_id") % 4 == 1, "prefix").otherwise("current")
    return m.select("sample_id", "turn", role.alias("role"), "content", name.alias("name"), kind.alias("type"),
                    (F.col("sample_id") % 5 != 0).alias("loss"))


MERGED = """
sub AS (SELECT conv_id AS sample_id, turn, text AS content,
          CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool' WHEN role = 'user' AND turn % 6 = 4 THEN 'thought' ELSE role END AS role,
          CASE WHEN conv_id % 4 = 0 THEN 'icl' WHEN conv_id % 4 = 1 THEN 'prefix' ELSE 'current' END AS type, conv_id % 5 <> 0 AS loss
        FROM conversations),
named AS (SELECT *, CASE WHEN role = 'tool' THEN 'plugin' WHEN role = 'system' THEN 'interpreter'
                         WHEN role = 'user' AND sample_id % 2 = 0 THEN 'bob' END AS name,
            CASE WHEN role NOT IN ('tool', 'thought')
                   OR coalesce(lag(role) OVER (PARTITION BY sample_id ORDER BY turn), 'user') NOT IN ('assistant', 'tool', 'thought')
                 THEN 1 ELSE 0 END AS starts FROM sub),
grouped_msgs AS (SELECT *, sum(starts) OVER (PARTITION BY sample_id ORDER BY turn) - 1 AS msg FROM named),
merged AS (
  SELECT sample_id, CAST(msg AS BIGINT) AS msg, arg_min(CASE WHEN role IN ('tool', 'thought') THEN 'assistant' ELSE role END, turn) AS role,
         min(name) FILTER (WHERE starts = 1 AND role NOT IN ('tool', 'thought')) AS name,
         string_agg(CASE WHEN role = 'tool' THEN '<|action_start|><|plugin|>' || chr(10) || content || '<|action_end|>' || chr(10)
                    ELSE content END, '' ORDER BY turn) AS content, any_value(type) AS type, bool_or(loss) AS loss
  FROM grouped_msgs GROUP BY sample_id, msg)
"""


@query("chatml_merge", f"WITH {MERGED} SELECT sample_id, msg, role, name, content FROM merged")
def chatml_merge(spark, d):
    return rn.merge_sub_roles(sub_role_messages(spark, d)).select("sample_id", "msg", "role", "name", "content")


@query("mcq_prompt", f"""
WITH q AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '中 ' || text ELSE text END AS question,
             CASE WHEN doc_id % 3 = 0 THEN 'hint ' || lang END AS hint FROM documents),
p AS (SELECT q.doc_id, '<image>' || chr(10) || CASE WHEN hint IS NOT NULL THEN hint || chr(10) ELSE '' END || question || chr(10)
        || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10)
        || CASE WHEN d.doc_id % 2 = 0 THEN 'C. ' || n_chars || chr(10) ELSE '' END AS body FROM q JOIN documents d ON d.doc_id = q.doc_id)
SELECT doc_id, body || CASE WHEN regexp_matches(body, '[一-鿿]') THEN {sql.lit(catalog.MCQ_CLOSING_CJK)}
       ELSE {sql.lit(catalog.MCQ_CLOSING)} END AS prompt FROM p""")
def mcq_prompt(spark, d):
    docs = inputs.table(spark, d, "documents")
    even = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string"))
    question = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("中 "), "text")).otherwise(F.col("text"))
    hint = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("hint "), "lang"))
    return docs.select("doc_id", rn.mcq_prompt(question, {"A": F.col("lang"), "B": F.col("source"), "C": even}, hint).alias("prompt"))


@query("prepend_system", """
SELECT conv_id AS sample_id, turn, role, text AS content FROM conversations
UNION ALL SELECT conv_id, min(turn) - 1, 'system', 'Answer in one line.' FROM conversations GROUP BY conv_id""")
def prepend_system(spark, d):
    return fm.prepend_system(inputs.messages(spark, d), "Answer in one line.")
