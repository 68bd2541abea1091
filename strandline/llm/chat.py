"""Chat formatting with minimum-cost role repair.

A rendered conversation is an optional system message, then user and assistant
in turn, ending with the assistant.  Every given turn keeps its role, takes
another, or is merged into the message before it, and empty messages may be
inserted; dynamic programming over the automaton's states finds the cheapest
repair, which is then rendered.

One turn acts on the states as a (min, +) matrix.  Matrix products associate, so
a conversation is cut into chunks of bounded size, the chunks' matrices are
multiplied up a tree, and entry and exit states are handed back down it: a
conversation that makes up a third of all rows is repaired by many tasks, with
the same result as in one piece.  Output is one row per turn whose ``rendered``
parts, joined in order, are the conversation.

Turns stand in order of ``turn`` (null last), equal ones by a hash of role and
text.  Between repairs of equal cost, the earlier entry of ``_moves`` wins, then
the lower state.

Defined cases: null conv_id is a conversation of its own; a null or unknown role
is relabelled at a lower cost; null text is empty; template markers inside a text
lose their bars; repeated rows are turns of their own; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import shuffle_width
from strandline.scratch import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Cost of a merge into a message of the same role, of another; of a relabel of a known role, of an unknown one; of an empty message.
MERGE, MERGE_OTHER, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 4, 3, 1, 2
CHUNK_TURNS, CHUNK_BYTES, FAN_IN = 256, 4_000_000, 64
FAR = 1 << 40

Matrix = tuple[tuple[int, ...], ...]
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


@lru_cache(maxsize=64)
def _moves(role: int) -> tuple[tuple[int, int, int, str, int], ...]:
    """(from, to, cost, action, inserted role or 0) of every way to take a turn; ``role`` 0 is unknown."""
    out = []
    price = lambda to: 0 if to == role else RELABEL if role else RELABEL_UNKNOWN
    for state in range(4):
        for to in LEGAL[state]:
            out.append((state, to, price(to), "keep" if to == role else "relabel", 0))
        if state != START:
            out.append((state, state, MERGE if state == role or not role else MERGE_OTHER, "merge", 0))
        for between in LEGAL[state]:
            if between != SYSTEM:
                out += [(state, to, INSERT + price(to), "keep" if to == role else "relabel", between) for to in LEGAL[between]]
    return tuple(out)


@lru_cache(maxsize=64)
def _matrix(role: int) -> Matrix:
    cost = [[FAR] * 4 for _ in range(4)]
    for a, b, c, _, _ in _moves(role):
        cost[a][b] = min(cost[a][b], c)
    return tuple(map(tuple, cost))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in range(4))) for j in range(4)) for i in range(4))


def role_code(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES[1:] else 0


def ending(state: int) -> tuple[int, ...]:
    """Empty messages that close a conversation which stands in ``state``."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


def exit_of(costs: tuple[int, ...]) -> int:
    """The cheapest last state, given the cost of each."""
    return min(range(4), key=lambda s: (costs[s] + INSERT * len(ending(s)), s))


def states_through(steps: list[Matrix], entry: int, leave: int) -> list[int]:
    """The states after each step of a cheapest way from ``entry`` to ``leave``; ties go to the lower state."""
    left = [tuple(0 if s == leave else FAR for s in range(4))]
    for m in reversed(steps):
        left.append(tuple(min(FAR, *(m[i][j] + left[-1][j] for j in range(4))) for i in range(4)))
    left.reverse()
    states, at = [], entry
    for m, rest in zip(steps, left[1:], strict=True):
        at = min(range(4), key=lambda j: (m[at][j] + rest[j], j))
        states.append(at)
    return states


def _clean(text: str) -> str:
    return text.replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>")


def _message(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


def repair(roles: list[int], texts: list[str], entry: int, leave: int, last: bool) -> Iterator[tuple[str, str, str | None, int, str]]:
    """(action, out_role, inserted_before, cost, rendered) of each turn of a chunk."""
    at = entry
    for k, (role, text, to) in enumerate(zip(roles, texts, states_through([_matrix(r) for r in roles], entry, leave), strict=True)):
        _, _, cost, action, between = min((m for m in _moves(role) if m[:2] == (at, to)), key=lambda m: m[2])
        close = "<|im_end|>\n"
        if action == "merge":
            out = "\n\n" + _clean(text)
        else:
            out = (close if at != START else "") + (_message(between) + close if between else "") + _message(to) + _clean(text)
        if last and k == len(roles) - 1:
            extra = ending(to)
            out += close + "".join(_message(r) + close for r in extra)
            cost += INSERT * len(extra)
        yield action, ROLES[to], ROLES[between] or None, cost, out
        at = to


def _chunks(turns: DataFrame) -> DataFrame:
    """key, part, local, conv_id, matrix, turns: conversation chunks in order of (part, local)."""
    width = shuffle_width(turns.sparkSession)
    order = ["key", "late", "turn", "tie"]
    rows = turns.select(
        F.to_json(F.struct(F.col("conv_id").alias("c"))).alias("key"), F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"), F.xxhash64("role", "text").alias("tie"),
        F.monotonically_increasing_id().alias("row"), "conv_id", "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartitionByRange(width, *order, "row").sortWithinPartitions(*order, "row")
    rows = rows.select("key", F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text")
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    item = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    names = ["key", "part", "local", "conv_id", "matrix", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = conv_id = None
        local, held, size, part = 0, [], 0, 0
        kind = None

        def done() -> pa.RecordBatch:
            total = UNIT
            for t in held:
                total = product(total, _matrix(role_code(t["role"])))
            flat = [x for row in total for x in row]
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([part], pa.int32()), pa.array([local], pa.int64()), pa.array([conv_id], kind), pa.array([flat], pa.list_(pa.int64())), pa.array([held], pa.list_(item))], names)

        for batch in batches:
            kind, ready = batch.column("conv_id").type, []
            for k, p, c, t, r, x in zip(*(batch.column(n).to_pylist() for n in ("key", "part", "conv_id", "turn", "role", "text")), strict=True):
                if held and (k != key or len(held) >= CHUNK_TURNS or size >= CHUNK_BYTES):
                    ready.append(done())
                    local = local + 1 if k == key else 0
                    held, size = [], 0
                key, part, conv_id = k, p, c
                held.append({"turn": t, "role": r, "text": x})
                size += len(x)
            yield from ready
        if held:
            yield done()

    return rows.mapInArrow(run, f"key string, part int, local long, conv_id {conv}, matrix array<bigint>, turns array<struct<turn:{turn},role:string,text:string>>")


def _boundaries(chunks: DataFrame) -> DataFrame:
    """key, part, local, entry, leave of every chunk."""
    square = lambda m: tuple(tuple(int(x) for x in m[4 * i : 4 * i + 4]) for i in range(4))

    def grouped(nodes: DataFrame, part, local) -> DataFrame:
        return nodes.select("key", "part", "local", part.alias("up_part"), local.alias("up_local"), "matrix")

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        total, frame = UNIT, frame.sort_values(["part", "local"])
        for m in frame["matrix"]:
            total = product(total, square(m))
        one = frame.iloc[0]
        return pd.DataFrame({"key": [one["key"]], "part": [one["up_part"]], "local": [one["up_local"]], "matrix": [[x for row in total for x in row]]})

    def hand_down(children: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values(["part", "local"])
        entry, leave = int(parent["entry"].iloc[0]), int(parent["leave"].iloc[0])
        after = states_through([square(m) for m in children["matrix"]], entry, leave)
        return pd.DataFrame({"key": children["key"], "part": children["part"], "local": children["local"], "entry": [entry, *after[:-1]], "leave": after})

    nodes = chunks.select("key", "part", "local", "matrix")
    most = nodes.agg(F.max("part").alias("p"), F.max("local").alias("l")).first()
    p, n, levels = most["p"] or 0, most["l"] or 0, []
    while p or n:
        part, local = (F.col("part"), F.floor(F.col("local") / FAN_IN)) if n else (F.floor(F.col("part") / FAN_IN).cast("int"), F.lit(0))
        levels.append(grouped(nodes, part, local.cast("long")))
        nodes = materialise(levels[-1].groupBy("key", "up_part", "up_local").applyInPandas(combine, "key string, part int, local long, matrix array<bigint>"), "nodes")
        p, n = (p, n // FAN_IN) if n else (p // FAN_IN, 0)
    closing = F.array(*[F.element_at("matrix", s + 1) + INSERT * len(ending(s)) for s in range(4)])  # as exit_of
    down = nodes.select("key", "part", "local", F.lit(START).alias("entry"), (F.array_position(closing, F.array_min(closing)) - 1).cast("int").alias("leave"))
    for level in reversed(levels):
        above = down.select("key", F.col("part").alias("up_part"), F.col("local").alias("up_local"), "entry", "leave")
        keys = ["key", "up_part", "up_local"]
        down = level.groupBy(*keys).cogroup(above.groupBy(*keys)).applyInPandas(hand_down, "key string, part int, local long, entry int, leave int")
    return down


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, action, out_role, inserted_before, cost, rendered: one row per given turn."""
    chunks = materialise(_chunks(turns), "chunks")
    ends = chunks.groupBy("key").agg(F.max(F.struct("part", "local")).alias("end"), F.count(F.lit(1)).alias("n"))
    several = materialise(chunks.select("key", "part", "local", "matrix").join(ends.where("n > 1").select("key", "end"), "key"), "several")
    states = _boundaries(several).join(ends.where("n > 1").select("key", "end"), "key")
    known = states.select("key", "part", "local", "entry", "leave", (F.struct("part", "local") == F.col("end")).alias("last"))
    rows = chunks.join(known, ["key", "part", "local"], "left")
    conv, turn = chunks.schema["conv_id"].dataType.simpleString(), chunks.schema["turns"].dataType.elementType["turn"].dataType.simpleString()
    names = ["conv_id", "turn", "role", "action", "out_role", "inserted_before", "cost", "rendered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("turns", "matrix", "entry", "leave", "last")}
                given = row["turns"]
                if row["entry"] is None:  # a whole conversation
                    row |= {"entry": START, "leave": exit_of(tuple(row["matrix"][:4])), "last": True}
                out = list(repair([role_code(t["role"]) for t in given], [t["text"] for t in given], row["entry"], row["leave"], row["last"]))
                columns = list(zip(*out, strict=True))
                kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array([k] * len(given))), pa.array([t["turn"] for t in given], pa.int64()), pa.array([t["role"] for t in given], pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return rows.select("conv_id", "turns", "matrix", "entry", "leave", "last").mapInArrow(run, f"conv_id {conv}, turn {turn}, role string, action string, out_role string, inserted_before string, cost long, rendered string")
