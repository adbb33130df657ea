"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant
turns in alternation, from a user turn to an assistant turn. Turns that break
this are repaired at least cost: a turn may be merged into the one before it,
may get another role, or an empty turn may be put before it (after the last turn:
behind it). Dynamic programming over the automaton's states (nothing yet, and
the role of the last turn) finds the cheapest actions; of equal costs the first
in the order keep, merge, insert wins, then the smaller role number.

A conversation is cut into chunks of ``CHUNK`` turn numbers. What a chunk does
to the states is a matrix of least costs; these compose over the chunks (minimum
for sum, sum for product), which fixes the states at the chunks' bounds, and every
chunk is then repaired by itself. So a conversation that holds a third of all
rows is worked on by many tasks. Rows come out one for each turn, with the
fragment it adds to the rendered conversation: the fragments of a conversation,
in order, are its text.

Edge cases: exact copies of a row (same conversation, turn, role and text) count
once; turns of equal number stand in the order of role and text, null turn
numbers first; a null or unknown role must be relabelled or merged; a null text is empty; rows with a
null conversation form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices

ROLES = ("system", "user", "assistant")
START = 3  # states 0 to 2: the role of the last turn
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, INSERT = 1, 2, 3
CHUNK = 1000
_INF = 1 << 40


def _moves() -> dict[int, list[tuple[int, int, int, tuple[int, ...], str]]]:
    """For each role (-1: unknown): (from, to, cost, inserted roles, action), in the order of preference."""
    out = {}
    for role in (-1, 0, 1, 2):
        moves = []
        for s in (0, 1, 2, START):
            for x in NEXT[s]:
                moves.append((s, x, 0 if x == role else RELABEL, (), "keep" if x == role else "relabel"))
            if s != START:
                moves.append((s, s, MERGE + (0 if s == role else RELABEL), (), "merge"))
            for y in NEXT[s]:
                for x in NEXT[y]:
                    moves.append((s, x, INSERT + (0 if x == role else RELABEL), (y,), "insert" if x == role else "insert_relabel"))
        rank = {"keep": 0, "relabel": 1, "merge": 2, "insert": 3, "insert_relabel": 4}
        out[role] = sorted(moves, key=lambda m: (m[2], rank[m[4]], m[0], m[1]))
    return out


MOVES = _moves()
#: Cost and inserted roles that end a conversation from each state.
END = {START: (0, ()), 0: (2 * INSERT, (1, 2)), 1: (INSERT, (2,)), 2: (0, ())}


def forward(roles: list[int], costs: list[int]) -> list[list[int]]:
    """Least cost of every state after each turn, from the costs before the first."""
    out = [costs]
    for role in roles:
        now = [_INF] * 4
        last = out[-1]
        for s, x, cost, _, _ in MOVES[role]:
            if last[s] + cost < now[x]:
                now[x] = last[s] + cost
        out.append(now)
    return out


def matrix(roles: list[int]) -> list[int]:
    """Least cost from each state before to each state after the turns, row by row."""
    return [c for s in range(4) for c in forward(roles, [0 if x == s else _INF for x in range(4)])[-1]]


def path(roles: list[int], before: int, after: int) -> list[tuple]:
    """The moves of least cost from one state to another."""
    table = forward(roles, [0 if x == before else _INF for x in range(4)])
    out, state = [], after
    for k in range(len(roles) - 1, -1, -1):
        move = next(m for m in MOVES[roles[k]] if m[1] == state and table[k][m[0]] + m[2] == table[k + 1][state])
        out.append(move)
        state = move[0]
    return out[::-1]


def bounds(matrices: list[list[int]]) -> list[int]:
    """States at the chunks' bounds of the cheapest repair of a whole conversation."""
    costs = [[0 if s == START else _INF for s in range(4)]]
    for m in matrices:
        costs.append([min(costs[-1][s] + m[4 * s + x] for s in range(4)) for x in range(4)])
    state = min(range(4), key=lambda s: (costs[-1][s] + END[s][0], s))
    out = [state]
    for k in range(len(matrices) - 1, -1, -1):
        state = next(s for s in range(4) if costs[k][s] + matrices[k][4 * s + state] == costs[k + 1][state])
        out.append(state)
    return out[::-1]


def _open(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


_CLOSE = "<|im_end|>\n"


def render(turns: list[tuple[str | None, str | None]], before: int, after: int, last: bool) -> list[tuple[str, str, int, str]]:
    """(role, action, cost, fragment) of each turn of a chunk between two states."""
    number = {r: k for k, r in enumerate(ROLES)}
    roles = [number.get(r, -1) for r, _ in turns]
    out = []
    for (_, text), (s, x, cost, inserted, action) in zip(turns, path(roles, before, after)):
        if action == "merge":
            fragment = "\n\n" + (text or "")
        else:
            fragment = "".join([_CLOSE if s != START else "", *(_open(y) + _CLOSE for y in inserted), _open(x), text or ""])
        out.append([ROLES[x], action, cost, fragment])
    if last and out:
        cost, inserted = END[after]
        out[-1][2] += cost
        out[-1][3] += _CLOSE + "".join(_open(y) + _CLOSE for y in inserted)
    return [tuple(r) for r in out]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in byte_slices(batch, "text") if "text" in batch.schema.names else (batch,):
            yield from part.to_pylist()


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int = 5000, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about ``limit`` characters."""
    held: list[tuple] = []
    chars = 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or chars >= limit:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, chars = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


_KEY = ("conv", "chunk")


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """One row for each turn: conv_id, turn, nth (of the turns of equal number), role, new_role, action, cost, fragment."""
    turns = df.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                      F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).distinct()
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 62))).cast("long"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "turn", "role", "text")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {r: k for k, r in enumerate(ROLES)}
        rows = ((*key, matrix([number.get(r["role"], -1) for r in g])) for key, g in groupby(_rows(batches), lambda r: (r["conv"], r["chunk"])))
        return _batches(rows, [pa.int64(), pa.int64(), pa.list_(pa.int64())], ["conv", "chunk", "costs"])

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for conv, g in groupby(_rows(batches), lambda r: r["conv"]):
                g = list(g)
                at = bounds([r["costs"] for r in g])
                yield from ((conv, r["chunk"], at[k], at[k + 1], k == len(g) - 1) for k, r in enumerate(g))
        return _batches(rows(), [pa.int64()] * 4 + [pa.bool_()], ["conv", "chunk", "before", "after", "last"])

    chunks = (dealt(turns).select(*_KEY, "role").mapInArrow(costs, "conv long, chunk long, costs array<long>")
              .repartition("conv").sortWithinPartitions("conv", "chunk")
              .mapInArrow(states, "conv long, chunk long, before long, after long, last boolean"))
    known = chunks.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), "before", "after", "last")
    both = turns.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))).drop("c", "k")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (conv, _), g in groupby(_rows(batches), lambda r: (r["conv"], r["chunk"])):
                g = list(g)
                done = render([(r["role"], r["text"]) for r in g], g[0]["before"], g[0]["after"], g[0]["last"])
                nth, turn = 0, object()
                for r, d in zip(g, done):
                    nth, turn = (nth + 1 if r["turn"] == turn else 0), r["turn"]
                    yield (conv, turn, nth, r["role"], *d)
        types = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64(), pa.string()]
        return _batches(rows(), types, ["conv", "turn", "nth", "role", "new_role", "action", "cost", "fragment"])

    schema = "conv long, turn long, nth long, role string, new_role string, action string, cost long, fragment string"
    return dealt(both).mapInArrow(pieces, schema).toDF(
        "conv_id", "turn", "nth", "role", "new_role", "action", "cost", "fragment")


def conversations(repaired: DataFrame) -> DataFrame:
    """conv_id, its cost and its rendered text (for conversations that fit into a row)."""
    return repaired.groupBy("conv_id").agg(
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "nth", "fragment"))), lambda x: x["fragment"]), "").alias("text"))
