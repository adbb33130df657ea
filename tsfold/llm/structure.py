"""Repair of conversation structure by iterative-deepening A*.

A legal conversation is empty, or an optional system turn followed by user and
assistant turns in pairs. Edits: keep a row, give it another role, delete it, or
insert a turn with empty text; rows with faults (blank, repeated, cut off) must
go or cost more. From each state of the automaton exactly one of user and
assistant may come next, so the letters of the edits (D, I, K, R) determine the
repair, and the cheapest repair whose letters are the least string is unique.

The search (``search``) is a depth-first search that tries the edits in ASCII
order within a bound of the cost; the bound starts at a lower estimate (what
each row costs at least) and grows to the least cost that went beyond it. A
transposition table keeps what is known about a failed state (place, automaton
state): the least cost that any way on from it needs. The first path that ends
in an accepting state is the answer.

On Spark: rows become narrow (a digest stands for role and text, copies of a row
are counted before anything is sorted), go through one range shuffle by
(conversation, turn, digest), and runs of a conversation are cut into chunks of at
most ``CHUNK`` places. A conversation that lies within one chunk is searched at once.
Of longer ones every chunk is searched for the least cost between each pair of
states; these costs are added up from the last chunk backwards, which gives each
chunk the cost of what follows it; with that as the cost of its end states a
chunk finds the least letters from every state it may be entered in, and a walk
over the chunks picks the entries. A hot conversation is thus worked on by many tasks;
only 20 numbers of a chunk, and at last the bytes that its one hash and one
string are made of, pass through a task of its own, as a stream.

Order: by turn, nulls first; rows of equal turn by the digest of role and text.

Edge cases: a null role, text (and, in the damage, conversation or turn) counts
as one space, so a null role fits nowhere and a null text is blank; rows with a
null conversation form one conversation; a role's first character is what
counts, an empty role has none; empty tables give an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices
from tsfold.session import scratch_path

CHUNK = 256
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START = 0
#: The state after a turn whose role begins with this letter.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state after the one user or assistant turn that may come next.
FORCED = (2, 2, 3, 2)
#: Cost of the inserted turns that end a conversation from each state.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
SPACES = " \t\n\x0b\f\r"
#: What a row may be: its role's first letter, and whether it is sound, cut off or must go.
INITIALS = "sua?"
SOUND, CUT, GONE = 0, 4, 8


def _moves() -> list[list[tuple[tuple[str, int, int, int], ...]]]:
    """For each kind of row and state: (letter, rows used, next state, cost) in ASCII order."""
    out = []
    for fault in (SOUND, CUT, GONE):
        for initial in INITIALS:
            states = []
            extra = CUT_OFF if fault == CUT else 0
            for q in range(4):
                moves = [("D", 1, q, DELETE), ("I", 0, FORCED[q], INSERT)]
                if fault != GONE and (q, initial) in STEP:
                    moves.append(("K", 1, STEP[q, initial], KEEP + extra))
                if fault != GONE:
                    moves.append(("R", 1, FORCED[q], REROLE + extra))
                states.append(tuple(moves))
            out.append(states)
    return out


MOVES = _moves()
#: The least that a row of each kind costs in any state.
LEAST = [min(c for moves in states for letter, _, _, c in moves if letter != "I") for states in MOVES]


def estimates(kinds: bytes, final: tuple[int, ...] | list[int]) -> list[int]:
    """A lower estimate of the cost still needed from each (place, state): what each row costs at least."""
    known = [0] * (4 * len(kinds)) + list(final)
    least = min(final)
    for i in range(len(kinds) - 1, -1, -1):
        least += LEAST[kinds[i]]
        known[4 * i:4 * i + 4] = [least] * 4
    return known


def search(kinds: bytes, entry: int, final: tuple[int, ...] | list[int], known: list[int] | None = None) -> tuple[int, str, int]:
    """Least cost from ``entry`` over all rows, the cost of the end state included; the least letters that have
    this cost; and the end state. (``FAR`` or more: no way.) ``known`` is the table of failed states; searches with
    the same rows and end costs may share one."""
    n = len(kinds)
    known = estimates(kinds, final) if known is None else known
    bound = known[entry]
    while bound < FAR:
        letters: list[str] = []
        places, rests, nexts, beyond = [entry], [bound], [0], [FAR]
        while places:
            at = places[-1]
            if at >= 4 * n:  # within the bound, or it would not have been entered
                return bound, "".join(letters), at % 4
            moves = MOVES[kinds[at >> 2]][at & 3]
            k = nexts[-1]
            if k == len(moves):
                known[at] = max(known[at], beyond[-1])
                for stack in (places, rests, nexts, beyond):
                    stack.pop()
                if places:
                    letter, used, q, cost = MOVES[kinds[places[-1] >> 2]][places[-1] & 3][nexts[-1] - 1]
                    beyond[-1] = min(beyond[-1], cost + known[at])
                    letters.pop()
                continue
            nexts[-1] += 1
            letter, used, q, cost = moves[k]
            to = 4 * ((at >> 2) + used) + q
            if cost + known[to] > rests[-1]:
                beyond[-1] = min(beyond[-1], cost + known[to])
                continue
            places.append(to)
            rests.append(rests[-1] - cost)
            nexts.append(0)
            beyond.append(FAR)
            letters.append(letter)
        bound = known[entry]
    return FAR, "", entry


def cost_matrix(kinds: bytes) -> list[int]:
    """Least cost from each state before to each state after the rows, row by row; ``FAR`` where there is no way."""
    out = [FAR] * 16
    system = any(k == SOUND or k == CUT for k in kinds)
    for x in range(4):
        final = [0 if y == x else FAR for y in range(4)]
        known = estimates(kinds, final)
        for s in range(4):
            if not (x == 0 and s != 0 or x == 1 and s not in (0, 1) or (s, x) == (0, 1) and not system):
                out[4 * s + x] = search(kinds, s, final, known)[0]
    return out


def costs_after(matrices: list[list[int]]) -> list[list[int]]:
    """For each chunk of a conversation: the least cost of all that follows it, from each of its end states."""
    out = [list(END)]
    for m in matrices[:0:-1]:
        out.append([min(FAR, *(m[4 * s + x] + out[-1][x] for x in range(4))) for s in range(4)])
    return out[::-1]


def turns_made(kinds: bytes, letters: str, entry: int) -> Iterator[tuple[str, int, str]]:
    """(letter, row or -1, new role or "" for its own) of each turn that the edits leave."""
    row, q = 0, entry
    for letter in letters:
        if letter == "D":
            row += 1
            continue
        if letter == "K":
            q = STEP[q, INITIALS[kinds[row] & 3]]
        else:
            q = FORCED[q]
        yield letter, -1 if letter == "I" else row, "" if letter == "K" else "user" if q == 2 else "assistant"
        row += letter != "I"


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows (conv, turn, role, text) of a table with faults put in by crc32 of ``conv:turn`` modulo 20: 0 drops a row,
    1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 gives it the role user."""
    def own(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), own(role_col).alias("role"),
                     own(text_col).alias("text"), F.pmod(F.crc32(F.concat(own(conv_col), F.lit(":"), own(turn_col))), F.lit(20)).alias("what"))
    rows = rows.filter("what <> 0").select(
        "conv", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _digest() -> Column:
    """16 bytes for role and text."""
    return F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))


def faults(rows: DataFrame) -> DataFrame:
    """Stored narrow rows: conv, turn, dg (digest of role and text), n (copies), initial, blank, cut, late (its role and
    text stand in an earlier row). Copies after the first are late as well."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    narrow = rows.select("conv", "turn", _digest().alias("dg"), F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"),
                         (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    narrow = narrow.groupBy("conv", "turn", "dg").agg(F.count("*").alias("n"), F.first("initial").alias("initial"),
                                                      F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    narrow = _stored(narrow, "structure-rows")
    when = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    repeated = (narrow.groupBy("conv", "dg").agg(F.min(when).alias("first"), F.count("*").alias("rows")).filter("rows > 1")
                .select(F.col("conv").alias("c"), F.col("dg").alias("d"), "first"))
    joined = narrow.join(repeated, F.col("conv").eqNullSafe(F.col("c")) & (F.col("dg") == F.col("d")), "left")
    late = F.coalesce(~F.col("first").eqNullSafe(when), F.lit(False)) & F.col("first").isNotNull()
    return _stored(joined.select(*narrow.columns, late.alias("late")), "structure-faults")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``limit`` bytes; the last item of a row is its size."""
    held: list[tuple] = []
    size = 0
    for *row, n in rows:
        held.append(tuple(row))
        size += n + 100
        if size >= limit:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _kind(row: dict) -> int:
    initial = INITIALS.find(row["initial"]) if row["initial"] in ("s", "u", "a") else 3
    return initial | (GONE if row["blank"] or row["late"] else CUT if row["cut"] else SOUND)


_CHUNK = "part long, seq long, whole boolean, kinds binary, turns array<long>, dgs binary, illegal long, first string, final string"


def chunks(narrow: DataFrame, size: int = CHUNK) -> DataFrame:
    """Stored chunks of the conversations in order (conv, part, seq): kinds (a byte for each place), turns and digests of
    the rows (places after the first of a row's copies have an empty digest), illegal neighbours within, first and last
    initial; ``whole`` where the chunk is known to be all of its conversation."""
    conv = narrow.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def places() -> Iterator[tuple]:
            for r in _rows(batches):
                kind = _kind(r)
                yield r["conv"], kind, r["turn"], r["dg"], r["initial"]
                for _ in range(r["n"] - 1):
                    yield r["conv"], kind & 3 | GONE, r["turn"], bytes(16), r["initial"]

        def cut() -> Iterator[tuple]:
            seq, held, inner = 0, [], False

            def chunk(ends: bool):
                initials = [x[4] for x in held]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                return (held[0][0], part, seq, inner and ends, bytes(x[1] for x in held), [x[2] for x in held],
                        b"".join(x[3] for x in held), illegal, initials[0], initials[-1], 40 * len(held))

            for x in places():
                if held and x[0] != held[0][0]:
                    yield chunk(True)
                    seq, held, inner = seq + 1, [], True
                elif len(held) == size:
                    yield chunk(False)
                    seq, held, inner = seq + 1, [], False
                held.append(x)
            if held:
                yield chunk(False)

        schema = pa.schema([("conv", arrow), ("part", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("kinds", pa.binary()),
                            ("turns", pa.list_(pa.int64())), ("dgs", pa.binary()), ("illegal", pa.int64()), ("first", pa.string()), ("final", pa.string())])
        return _batches(cut(), schema)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(conv)
    ordered = narrow.repartitionByRange("conv", "turn", "dg").sortWithinPartitions("conv", "turn", "dg")
    return _stored(ordered.mapInArrow(run, f"conv {conv.simpleString()}, {_CHUNK}"), "structure-chunks")


def edits(chunked: DataFrame) -> DataFrame:
    """Stored chunks with the edits: the columns of ``chunks`` and entry (state), letters (those of the turns that end the
    conversation included), cost."""
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(chunked.schema["conv"].dataType)
    conv = f"conv {chunked.schema['conv'].dataType.simpleString()}"
    key = ["conv", "part", "seq"]

    def solved(table: DataFrame, entries: bool) -> DataFrame:
        """The least letters of every chunk: from the start to the end of a whole conversation, or from each state."""
        out = table.selectExpr("*", "cast(null as array<string>) letters", "cast(null as array<int>) ends", "cast(null as array<long>) costs")
        schema, columns = out.schema, table.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column("kinds").to_pylist()
                finals = batch.column("after").to_pylist() if entries else [END] * len(kinds)
                lasts = batch.column("last").to_pylist() if entries else [True] * len(kinds)
                tables = [estimates(k, f) for k, f in zip(kinds, finals)]
                found = [[search(k, s, f, t) for s in (range(4) if entries else (START,))] for k, f, t in zip(kinds, finals, tables)]
                cols = [batch.column(c) for c in columns]
                cols += [pa.array([[x[1] + ("I" * (END[x[2]] // INSERT) if z else "") for x in r] for r, z in zip(found, lasts)], pa.list_(pa.string())),
                         pa.array([[x[2] for x in r] for r in found], pa.list_(pa.int32())),
                         pa.array([[x[0] for x in r] for r in found], pa.list_(pa.int64()))]
                yield pa.record_batch(cols, names=schema.names)

        return table.mapInArrow(run, schema)

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in key), pa.array([cost_matrix(k) for k in batch.column("kinds").to_pylist()], pa.list_(pa.int64()))],
                                  names=[*key, "m"])

    def by_conversation(rows: Iterator[dict]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for r in rows:
            if held and r["conv"] != held[0]["conv"]:
                yield held
                held = []
            held.append(r)
        if held:
            yield held

    def backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["conv"], r["part"], r["seq"], after, k == len(g) - 1, 40) for g in by_conversation(_rows(batches))
                for k, (r, after) in enumerate(zip(g, costs_after([x["m"] for x in g]))))
        return _batches(rows, pa.schema([("conv", arrow), ("part", pa.int64()), ("seq", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())]))

    def forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk() -> Iterator[tuple]:
            for g in by_conversation(_rows(batches)):
                state = START
                for r in g:
                    yield r["conv"], r["part"], r["seq"], state, 10
                    state = r["ends"][state]
        return _batches(walk(), pa.schema([("conv", arrow), ("part", pa.int64()), ("seq", pa.int64()), ("entry", pa.int64())]))

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("conv").sortWithinPartitions(*key)

    def keyed(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.drop("conv"), ["part", "seq"])  # part and seq name a chunk alone

    whole = solved(chunked.filter("whole"), False).selectExpr(
        *chunked.columns, f"{START}L entry", "letters[0] letters", "costs[0] cost")
    cut = chunked.filter("NOT whole")
    after = in_order(cut.select(*key, "kinds").mapInArrow(price, f"{conv}, part long, seq long, m array<long>")).mapInArrow(
        backwards, f"{conv}, part long, seq long, after array<long>, last boolean")
    from_each = _stored(solved(keyed(cut, after), True), "structure-letters")
    entry = in_order(from_each.select(*key, "ends")).mapInArrow(forwards, f"{conv}, part long, seq long, entry long")
    at = F.col("entry").cast("int")
    # cost: of the chunk and all that follows, less what follows
    own = F.get("costs", at) - F.when(F.col("last"), 0).otherwise(F.get("after", F.get("ends", at)))
    parts = keyed(from_each, entry).select(*chunked.columns, "entry", F.get("letters", at).alias("letters"), own.alias("cost"))
    return _stored(whole.unionByName(parts), "structure-edits")


def repaired_turns(rows: DataFrame, edited: DataFrame) -> DataFrame:
    """The repaired conversations: conv, part, seq, k (place in the chunk; together the order), edit, role, text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for r in _rows(batches):
                for k, (letter, row, role) in enumerate(turns_made(r["kinds"], r["letters"], r["entry"])):
                    dg = r["dgs"][16 * row:16 * row + 16] if row >= 0 else None
                    yield r["conv"], r["part"], r["seq"], k, letter, role, r["turns"][row] if row >= 0 else None, dg, 60
        return _batches(made(), arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    conv = edited.schema["conv"].dataType.simpleString()
    schema = f"conv {conv}, part long, seq long, k long, edit string, new_role string, at long, d binary"
    turns = edited.select("conv", "part", "seq", "kinds", "letters", "entry", "turns", "dgs")
    arrow = to_arrow_schema(edited.sparkSession.createDataFrame([], schema).schema)
    made = turns.mapInArrow(run, schema)
    texts = rows.select(F.col("conv").alias("c"), "turn", "role", "text", _digest().alias("dg")).dropDuplicates(["c", "turn", "dg"])
    kept = made.filter("d IS NOT NULL").join(
        texts, F.col("conv").eqNullSafe(F.col("c")) & F.col("at").eqNullSafe(F.col("turn")) & (F.col("d") == F.col("dg")))
    role = F.when(F.col("new_role") == "", F.col("role")).otherwise(F.col("new_role"))
    order = ["conv", "part", "seq", "k", "edit"]
    return kept.select(*order, role.alias("role"), "text").unionByName(
        made.filter("d IS NULL").select(*order, F.col("new_role").alias("role"), F.lit("").alias("text")))


def _ends(edited: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, illegal, cost, audit, repaired_sha256 of every conversation: its chunks and turns stream by in order."""
    from pyspark.sql.pandas.types import to_arrow_type

    conv = edited.schema["conv"].dataType
    arrow = to_arrow_type(conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended() -> Iterator[tuple]:
            now = None
            for r in (x for batch in batches for part in byte_slices(batch, "text") for x in part.to_pylist()):
                if now is None or r["conv"] != now[0]:
                    if now:
                        yield now[0], now[1], now[2], "".join(now[3]), now[4].hexdigest(), 200 + len(now[3])
                    now = [r["conv"], 0, 0, [], hashlib.sha256(), "", False]
                if r["k"] < 0:  # the head of a chunk
                    if now[3]:
                        now[1] += now[5] + r["first"] not in ("su", "ua", "au")
                    now[1] += r["illegal"]
                    now[2] += r["cost"]
                    now[3].append(r["text"])
                    now[5] = r["final"]
                else:
                    now[4].update((("\n" if now[6] else "") + r["role"] + ":" + r["text"]).encode())
                    now[6] = True
            if now:
                yield now[0], now[1], now[2], "".join(now[3]), now[4].hexdigest(), 200 + len(now[3])

        return _batches(ended(), pa.schema([("conv", arrow), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    heads = edited.select("conv", "part", "seq", F.lit(-1).cast("long").alias("k"), F.lit("").alias("role"),
                          F.col("letters").alias("text"), "illegal", "cost", "first", "final")
    rest = turns.select("conv", "part", "seq", "k", "role", "text").selectExpr("*", "0L illegal", "0L cost", "'' first", "'' final")
    ordered = heads.unionByName(rest).repartition("conv").sortWithinPartitions("conv", "part", "seq", "k")
    return ordered.mapInArrow(run, f"conv {conv.simpleString()}, illegal long, cost long, audit string, repaired_sha256 string")


def report(rows: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row for each distinct id of ``conversations``: what is wrong with its ``rows`` (conv, turn, role, text), the
    least cost and letters of its repair and the hash of the repaired conversation."""
    narrow = faults(rows)
    edited = edits(chunks(narrow))
    ends = _ends(edited, repaired_turns(rows, edited))
    first = F.when(F.col("late"), 0).otherwise(1)
    counts = narrow.groupBy("conv").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - first)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("late") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
        (F.max("turn") - F.min("turn") + 1).alias("span"))
    turns = narrow.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("turns"))
    out = conversations.select(F.col(conv_col).alias("id")).distinct()
    for facts in (counts, turns, ends):
        facts = facts.withColumnRenamed("conv", "key")
        out = out.join(facts, F.col("id").eqNullSafe(F.col("key")), "left").drop("key")

    def number(c: Column) -> Column:
        return F.coalesce(c, F.lit(0)).cast("long")

    return out.select(
        F.col("id").alias(conv_col), number(F.col("span") - F.col("turns")).alias("gaps"),
        *(number(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
