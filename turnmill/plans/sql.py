"""SQL fragments for the check queries (ANSI with the list functions of the checking engine)."""

from __future__ import annotations

from turnmill.functions.text import STRIP_CHARS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"trim({expr}, {lit(STRIP_CHARS)})"


def words(expr: str) -> str:
    return f"list_filter(string_split({expr}, ' '), lambda w: w <> '')"


def ids(expr: str) -> str:
    return f"list_transform({words(expr)}, lambda w: CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) + 1)"


def n_words(expr: str) -> str:
    return f"CAST(len({words(expr)}) AS BIGINT)"


def masked(expr: str) -> str:
    return f"list_transform({expr}, lambda x: CAST(-100 AS BIGINT))"


def text(expr: str) -> str:
    """List as comma-joined text; an empty list is the empty string."""
    return f"coalesce(array_to_string({expr}, ','), '')"


def r6(expr: str) -> str:
    """Six digits, without negative zero."""
    return f"(round({expr}, 6) + CAST(0 AS DOUBLE))"


def key(ident: str, seed: int = 1024, epoch: int = 0) -> str:
    return f"md5(concat_ws(':', '{seed}', '{epoch}', CAST({ident} AS VARCHAR)))"


# Long form of turn pairing over the conversations table.
TURNS = """
msgs AS (
  SELECT conv_id AS sample_id, turn, role, text AS content,
         coalesce(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp,
         coalesce(sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened
  FROM conversations),
grouped AS (
  SELECT sample_id, grp, min(opened) = 0 AS is_first,
         coalesce(max_by(content, turn) FILTER (WHERE role = 'system'), '') AS system,
         coalesce(string_agg(content, '' ORDER BY turn) FILTER (WHERE role = 'user'), '') AS input,
         max(content) FILTER (WHERE role = 'assistant') AS output
  FROM msgs WHERE NOT (role = 'assistant' AND opened = 0)
  GROUP BY sample_id, grp HAVING count(*) FILTER (WHERE role = 'assistant') > 0),
turns AS (
  SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY grp) - 1 AS turn_no, is_first, system, input, output, TRUE AS output_with_loss
  FROM grouped)
"""

# The same turns in the chat template qwen_chat.
RENDERED = TURNS + """,
rendered AS (
  SELECT sample_id, turn_no, is_first, output_with_loss,
         CASE WHEN system <> '' THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END
         || '<|im_start|>user' || chr(10) || input || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
           AS input,
         output || '<|im_end|>' AS output, FALSE AS need_eos_token, chr(10) AS sep
  FROM turns)
"""

# Token pieces per turn: BOS 1 on the first turn only, because the suffix stands for EOS.
PIECES = RENDERED + f""",
coded AS (
  SELECT sample_id, turn_no, is_first, {ids('input')} AS a, {ids('output')} AS b, {ids('sep')} AS c FROM rendered),
pieces AS (
  SELECT sample_id, turn_no,
         list_concat(CASE WHEN is_first THEN [CAST(1 AS BIGINT)] ELSE [] END, a, b, c) AS ids,
         list_concat(CASE WHEN is_first THEN [CAST(-100 AS BIGINT)] ELSE [] END, {masked('a')}, b, {masked('c')}) AS labels
  FROM coded)
"""


def samples(max_length: int) -> str:
    """Encoded samples cut at ``max_length``."""
    return PIECES + f""",
whole AS (
  SELECT sample_id, flatten(list(ids ORDER BY turn_no)) AS ids, flatten(list(labels ORDER BY turn_no)) AS labels
  FROM pieces GROUP BY sample_id),
samples AS (
  SELECT sample_id, ids[1:{max_length}] AS input_ids, labels[1:{max_length}] AS labels,
         CAST(len(ids[1:{max_length}]) AS BIGINT) AS num_tokens FROM whole)
"""
