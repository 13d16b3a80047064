"""Chat formatting with minimum-cost role repair.

A dialogue is legal if an optional system turn comes first, user and assistant turns then alternate beginning with a user
turn, and the last turn is the assistant's.  Every message is put into a turn: it opens the next one or is merged into the
turn before, under its own role or relabelled; empty turns may be inserted anywhere.  Dynamic programming over the states
of the automaton finds the cheapest repair: merging costs ``MERGE``, a new label ``RELABEL``, an empty turn ``INSERT``.
Equal costs are settled by the order system, user, assistant of the state before (then merging before opening), so reruns
agree.  The repaired dialogue is rendered as text.

The cost of a stretch of messages is a table from state to state, and tables of neighbouring stretches combine.  Dialogues
of more than ``PART`` messages are therefore repaired in parts of so many: part tables are made in parallel, chained per dialogue (one
short row per part), and every part is then rendered between the states that the best whole repair passes through.  The
texts of a dialogue's parts, in order, are the text of the dialogue.

Unknown and null roles match no turn and are relabelled.  A null text is empty.  Messages are ordered by turn (null first),
then role and text; repeated rows are messages of their own.  A null conv_id is a dialogue of its own.  Marks inside a text
are broken up, so that a text cannot end its turn.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import read_only_columns, slices, small, stage
from turnmill.operators.order import int_div, running

ROLES = ("system", "user", "assistant")
START = 3
STATES = 4
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FINAL = 2
MERGE, RELABEL, INSERT = 1, 3, 2
PART = 4096
# Leading characters of a text by which the messages of long dialogues are dealt to ranges.
PREFIX = 1024
NEVER = 1 << 40
OPEN, END = "<|{}|>\n", "<|end|>\n"


@cache
def detours() -> dict[tuple[int, int], tuple[int, ...]]:
    """The shortest chain of empty turns from one state to another (the chain ends in the second state)."""
    found: dict[tuple[int, int], tuple[int, ...]] = {(s, s): () for s in range(STATES)}
    ends = list(found)
    while ends:
        longer = []
        for s, e in ends:
            for n in LEGAL[e]:
                if (s, n) not in found:
                    found[s, n] = (*found[s, e], n)
                    longer.append((s, n))
        ends = longer
    return found


@cache
def step(role: int) -> tuple[tuple[tuple[int, int, int, tuple[int, ...]], ...], ...]:
    """For a message of ``role`` (or -1) and each state after it: ``(cost, state before, merged, empty turns)``, cheapest first."""
    out = []
    for q in range(len(ROLES)):
        label = 0 if q == role else RELABEL
        moves = [(label + MERGE, q, 1, ())]
        for (s, e), chain in detours().items():
            if q in LEGAL[e]:
                moves.append((label + INSERT * len(chain), s, 0, chain))
        best: dict[int, tuple] = {}
        for move in sorted(moves, key=lambda m: (m[0], -m[2], m[3])):
            best.setdefault(move[1], move)
        out.append(tuple(best[s] for s in sorted(best)))
    return tuple(out)


def closing(state: int) -> tuple[int, ...]:
    """Empty turns that bring a dialogue to its legal end."""
    return detours()[state, FINAL]


def forward(roles: list[int], costs: list[int]) -> tuple[list[int], list[list[tuple | None]]]:
    """Costs of the states after all messages, and the move taken into each state at each message."""
    trail = []
    for role in roles:
        after, moves = [NEVER] * STATES, [None] * STATES
        for q, options in enumerate(step(role)):
            for move in options:
                cost = costs[move[1]] + move[0]
                if cost < after[q]:
                    after[q], moves[q] = cost, move
        costs = after
        trail.append(moves)
    return costs, trail


def part_table(roles: list[int]) -> list[int]:
    """Cost from each state (rows) to each state through the messages."""
    return [c for s in range(STATES) for c in forward(roles, [0 if k == s else NEVER for k in range(STATES)])[0]]


def chain(tables: list[list[int]]) -> list[tuple[int, int]]:
    """Entry and exit state of every part on the cheapest way from the start to the legal end."""
    costs, backs = [0 if s == START else NEVER for s in range(STATES)], []
    for table in tables:
        after, back = [NEVER] * STATES, [START] * STATES
        for e in range(STATES):
            for s in range(STATES):
                cost = costs[s] + table[s * STATES + e]
                if cost < after[e]:
                    after[e], back[e] = cost, s
        costs = after
        backs.append(back)
    state, out = best_end(costs), []
    for back in reversed(backs):
        out.append((back[state], state))
        state = back[state]
    return out[::-1]


def best_end(costs: list[int]) -> int:
    return min(range(len(ROLES)), key=lambda s: (costs[s] + INSERT * len(closing(s)), s))


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> list[tuple[int, int, tuple[int, ...]]]:
    """``(role, merged, empty turns before)`` of every message on the cheapest way from ``entry`` to ``leave`` (or to a legal end)."""
    costs, trail = forward(roles, [0 if s == entry else NEVER for s in range(STATES)])
    state, out = best_end(costs) if leave is None else leave, []
    for moves in reversed(trail):
        _, before, merged, empty = moves[state]
        out.append((state, merged, empty))
        state = before
    return out[::-1]


def role_of(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else -1


def safe(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def render(roles: list[str | None], texts: list[str | None], entry: int = START, leave: int | None = None, last: bool = True) -> dict:
    """The repaired part as text, with what was done to it.  Concatenated parts are the whole dialogue."""
    plan = repair([role_of(r) for r in roles], entry, leave)
    pieces, turns, begun = [], [], entry != START
    counts = {"n_messages": len(roles), "n_turns": 0, "n_merged": 0, "n_relabelled": 0, "n_inserted": 0}

    def begin(role: int, text: str) -> None:
        nonlocal begun
        pieces.append((END if begun else "") + OPEN.format(ROLES[role]) + text)
        turns.append(ROLES[role])
        begun = True

    def insert(empty: tuple[int, ...]) -> None:
        for role in empty:
            begin(role, "")
        counts["n_inserted"] += len(empty)

    for (role, merged, empty), name, text in zip(plan, roles, texts, strict=True):
        insert(empty)
        counts["n_relabelled"] += role != role_of(name)
        counts["n_merged"] += merged
        if merged:
            pieces.append("\n" + safe(text))
        else:
            begin(role, safe(text))
    if last:
        insert(closing(plan[-1][0] if plan else entry))
        pieces.append(END)
    counts["n_turns"] = len(turns)
    cost = MERGE * counts["n_merged"] + RELABEL * counts["n_relabelled"] + INSERT * counts["n_inserted"]
    return {**counts, "cost": cost, "roles": ",".join(turns), "rendered": "".join(pieces)}


# ---- Spark jobs ----------------------------------------------------------------------------------------------------

OUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_messages", pa.int64()), ("n_turns", pa.int64()), ("n_merged", pa.int64()),
                 ("n_relabelled", pa.int64()), ("n_inserted", pa.int64()), ("cost", pa.int64()), ("roles", pa.string()), ("rendered", pa.string())])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal ``keys``; the partition is sorted by them."""
    current, rows = None, []
    for batch in slices(batches, 4096):
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield current, rows


def format_dialogues(conversations: DataFrame, part: int = PART) -> DataFrame:
    """One row per dialogue and part: counts of repairs, their cost, the turns' roles and the rendered text.

    ``part`` is the number of messages per part; dialogues of no more, the usual case, are one row.
    """
    messages = read_only_columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    long = stage(messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select(F.col("conv_id").alias("conv")), "chat-long")
    whole = {"part": F.lit(0).cast("long"), "pos": F.lit(0).cast("long"), "entry": F.lit(START), "leave": F.lit(None).cast("int"), "last": F.lit(True)}
    if long.isEmpty():
        placed = messages.withColumns(whole)
    else:
        named = small(long)
        same = messages["conv_id"].eqNullSafe(named["conv"])
        numbered = _numbered(messages.join(named, same, "left_semi"), part)
        ways = stage(_ways(numbered), "chat-ways").withColumnsRenamed({"conv_id": "conv", "part": "p"})
        known = numbered["conv_id"].eqNullSafe(ways["conv"]) & (numbered["part"] == ways["p"])
        parts = numbered.join(small(ways), known).select("conv_id", "turn", "role", "text", "part", "pos", "entry", "leave", "last")
        placed = messages.join(named, same, "left_anti").withColumns(whole).unionByName(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, number), rows in _groups(batches, ("conv_id", "part")):
            found = render([r["role"] for r in rows], [r["text"] for r in rows], rows[0]["entry"], rows[0]["leave"], rows[0]["last"])
            out.append({"conv_id": conv, "part": number, **found})
            if len(out) == 256:
                yield pa.RecordBatch.from_pylist(out, OUT)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, OUT)

    ordered = placed.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos", "turn", "role", "text")
    return ordered.mapInArrow(run, ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in OUT))


def _numbered(messages: DataFrame, part: int) -> DataFrame:
    """The messages of long dialogues with their place ``pos`` in the order of turn, role and text, and their ``part``.

    Rows are range-sorted by that order, whatever the dialogue, so a dialogue spreads over many ranges even if its turns
    are null or repeated; equal messages, whose order is free, are dealt by a random number.  (Messages of one turn and
    role whose texts share their first ``PREFIX`` characters, but are longer, stay in one range.)
    """
    prefix = F.substring("text", 1, PREFIX)
    free = F.when(F.coalesce(F.length("text"), F.lit(0)) < PREFIX, F.rand(0)).otherwise(F.lit(0.0))
    dealt = messages.withColumns({"prefix": prefix, "free": free}).repartitionByRange("conv_id", "turn", "role", "prefix", "free")
    ranged = stage(dealt.drop("prefix", "free").withColumn("range", F.spark_partition_id().cast("long")).withColumn(
        "key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))), "chat-ranges")
    placed = running(ranged, order=["turn", "role", "text"], bucket=F.col("range"), keys=["key"], index="pos")
    return placed.drop("range", "key").withColumn("part", int_div("pos", part))


def _ways(numbered: DataFrame) -> DataFrame:
    """``(conv_id, part, entry, leave, last)`` of the parts of long dialogues."""
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, number), rows in _groups(batches, ("conv_id", "part")):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": number, "costs": part_table([role_of(r["role"]) for r in rows])}],
                                             pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int64()))]))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in _groups(batches, ("conv_id",)):
            states = chain([r["costs"] for r in rows])
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv, "part": r["part"], "entry": e, "leave": s, "last": r is rows[-1]} for r, (e, s) in zip(rows, states, strict=True)],
                pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())]))

    narrow = numbered.select("conv_id", "part", "pos", "role")
    sorted_rows = narrow.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos").select("conv_id", "part", "role")
    parts = sorted_rows.mapInArrow(tables, "conv_id long, part long, costs array<long>")
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(chains, "conv_id long, part long, entry int, leave int, last boolean")
