"""Operator 4, chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn is followed by user and assistant turns in
alternation, beginning with the user (it may end with either). A dynamic program over the automaton
START -> SYSTEM -> USER <-> ASSISTANT chooses for each turn, at the least total cost:

    keep      its own role is legal here                                        0
    merge     its text goes on in the turn before it: of the same role          1, of another     4
    insert    an empty turn of the missing role comes first, then keep          2 for each
    relabel   it takes the role that is legal here: a role that means nothing   1, another        3

Equal costs are settled by the order keep, merge, insert, relabel, at the latest turn first. The repaired
sequence is rendered turn by turn; the pieces of a conversation in order, joined, are its text.

A step of the program is a 4 x 4 matrix in the (min, +) algebra, so a conversation need not fit one task:
rows are cut by range into blocks of about `BLOCK` turns; of a conversation that goes beyond one block each
block gives one matrix, these settle the states between the blocks, and every block is then repaired on its
own, conversation by conversation in one stream, between the states it has.

Defined cases: turns are ordered by turn (null first), then role and text (nulls first); equal rows are
turns of their own; a null text is empty, a null or unknown role must be relabelled or merged; rows with
null conv_id make one conversation; an empty table gives no rows. Columns beside those named are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import read, work_table

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "developer": "system"}
MERGE_SAME, MERGE_OTHER, INSERT, RELABEL_UNKNOWN, RELABEL = 1, 4, 2, 1, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state the roles that may come next.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
BLOCK = 5_000
INF = 1 << 40
KINDS = ("keep", "merge", "insert", "relabel")


def role_of(name: str | None) -> int:
    """The state of a role's name, or START for none that means anything."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else START


def _paths(state: int, role: int, most: int = 2) -> list[tuple[int, ...]]:
    """Empty turns that lead from state to where role is legal, none of them `role` followed by itself."""
    found, todo = [], [(state, ())]
    while todo:
        at, inserted = todo.pop(0)
        if role in NEXT[at]:
            found.append(inserted)
        elif len(inserted) < most:
            todo += [(r, (*inserted, r)) for r in NEXT[at]]
    return found


def _choices(role: int) -> list[tuple[int, int, int, int, tuple[int, ...]]]:
    """(state before, state after, cost, kind, inserted turns) for a turn of this role, in order of preference."""
    out = []
    for state in range(4):
        if role and role in NEXT[state]:
            out.append((state, role, 0, 0, ()))
        if state != START:
            out.append((state, state, MERGE_SAME if state == role else MERGE_OTHER, 1, ()))
        if role and role not in NEXT[state]:
            for inserted in _paths(state, role)[:1]:
                out.append((state, role, INSERT * len(inserted), 2, inserted))
        for other in NEXT[state]:
            if other != role:
                out.append((state, other, RELABEL if role else RELABEL_UNKNOWN, 3, ()))
    return sorted(out, key=lambda c: c[3])


CHOICES = {r: _choices(r) for r in range(4)}


def _matrices() -> np.ndarray:
    out = np.full((4, 4, 4), INF, np.int64)
    for r, choices in CHOICES.items():
        for a, b, cost, _, _ in choices:
            out[r, a, b] = min(out[r, a, b], cost)
    return out


MATRIX = _matrices()


def block_matrix(roles: np.ndarray) -> np.ndarray:
    """The (min, +) product of the turns' matrices, by halves."""
    m = MATRIX[roles]
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, [IDENTITY]])
        m = np.minimum((m[::2, :, :, None] + m[1::2, None, :, :]).min(2), INF)
    return m[0] if len(m) else IDENTITY


IDENTITY = np.where(np.eye(4, dtype=bool), 0, INF)


def repair(roles: list[int], enter: int = START, beyond: Sequence[int] = (0, 0, 0, 0)) -> tuple[int, list[tuple[int, int, tuple[int, ...]]]]:
    """Cost, and for each turn (kind, state after, inserted turns), from a state on; beyond: the least cost of
    what follows, by the state that it follows. Of the choices that reach the least cost each turn takes the
    first, so that a repair is the same however its conversation lies in blocks."""
    to_go = [list(beyond)]
    for role in reversed(roles):
        later, here = to_go[-1], [INF] * 4
        for a, b, cost, _, _ in CHOICES[role]:
            here[a] = min(here[a], cost + later[b])
        to_go.append(here)
    to_go.reverse()
    state, out = enter, []
    for role, here, later in zip(roles, to_go, to_go[1:], strict=False):
        _, state, _, kind, inserted = next(c for c in CHOICES[role] if c[0] == state and c[2] + later[c[1]] == here[state])
        out.append((kind, state, inserted))
    return to_go[0][enter], out


def _head(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


END = "<|end|>\n"


def render(texts: list[str], steps: list[tuple[int, int, tuple[int, ...]]], first: bool, last: bool) -> list[str]:
    """A piece for each turn; first, last: whether the conversation begins and ends here."""
    pieces = []
    for i, (text, (kind, state, inserted)) in enumerate(zip(texts, steps, strict=True)):
        if kind == 1:
            piece = "\n\n" + text
        else:
            piece = "" if first and i == 0 else END
            piece += "".join(_head(s) + END for s in inserted) + _head(state) + text
        pieces.append(piece + (END if last and i + 1 == len(texts) else ""))
    return pieces


def _blocks(df: DataFrame, conv: str, turn: str, role: str, text: str, block: int) -> DataFrame:
    rows = df.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    parts = max(1, -(-rows.count() // block))
    tie = F.xxhash64("role", "text")
    # equal ranges for equal turns only: what is spread over blocks is in order
    cut = rows.withColumn("tie", tie).repartitionByRange(parts, "conv_id", "turn", "tie").withColumn("part", F.spark_partition_id())
    return work_table(cut, "turns")


def _streamed(rows: DataFrame, columns: list[str], run, ddl: str) -> DataFrame:
    """run(part, conversation, rows of it) -> rows of ddl, over blocks in order; a block lies in one task, and
    a task holds one conversation's share of one block at a time."""
    places = ["part", "conv_id", "turn", "tie"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*places, *columns).repartition(n, "part").sortWithinPartitions(*places)
    types = T._parse_datatype_string(ddl)
    schema = to_arrow_schema(types)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out, size = [], None, [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != key:
                    if held:
                        out += run(*key, held)
                        size += sum(len(x) for r in held for x in r if isinstance(x, str))
                    held, key = [], row[:2]
                held.append(row[2:])
            if size > 1 << 22 or len(out) > 10_000:
                yield batch()
                out, size = [], 0
        if held:
            out += run(*key, held)
        if out:
            yield batch()

    return ordered.mapInArrow(stream, ddl)


def repaired(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """For each turn: conv_id, seq (its place in the conversation, from 0), turn, role, text, action,
    new_role, inserted (roles of the empty turns before it), piece."""
    rows = _blocks(df, conv, turn, role, text, block)

    def matrix(part: int, conv_id: int | None, turns: list[tuple]) -> list[tuple]:
        roles = np.array([role_of(r) for _, _, r in turns])
        return [(part, conv_id, block_matrix(roles).ravel().tolist(), len(roles))]

    # blocks are ranges in the order of conversations: only a block's first and last can go beyond it
    ends = rows.groupBy("part").agg(F.min(_key()).alias("low"), F.max(_key()).alias("high"))
    edge = rows.select("part", "conv_id", "turn", "tie", "role").join(ends, "part").where((_key() == F.col("low")) | (_key() == F.col("high")))
    matrices = work_table(_streamed(edge, ["role"], matrix, "part int, conv_id long, m array<long>, n long"), "matrices")

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """What follows each block costs this, by the state that it follows."""
        pdf = pdf.sort_values("part")
        beyond = [np.zeros(4, np.int64)]
        for m in list(pdf["m"])[:0:-1]:
            beyond.append(np.minimum((np.array(m).reshape(4, 4) + beyond[-1]).min(1), INF))
        n, before = len(pdf), np.cumsum([0, *pdf["n"]])[:-1]
        return pd.DataFrame({"conv_id": [key[0]] * n, "part": pdf["part"], "beyond": [b.tolist() for b in beyond[::-1]], "before": before, "first": [i == 0 for i in range(n)], "last": [i + 1 == n for i in range(n)]}).astype({"conv_id": "Int64"})

    # a row for each block of a conversation that goes beyond one
    several = matrices.groupBy(F.col("conv_id").alias("__c")).agg(F.count("*").alias("blocks")).where("blocks > 1")
    several = matrices.join(several, F.col("conv_id").eqNullSafe(F.col("__c")), "left_semi")
    settled = work_table(several.groupBy("conv_id").applyInPandas(settle, "conv_id long, part int, beyond array<long>, before long, first boolean, last boolean"), "settled")

    def placed(turns: DataFrame, found: DataFrame, how: str) -> DataFrame:
        found = found.withColumnsRenamed({"conv_id": "__c", "part": "__p"})
        return turns.join(found, turns["conv_id"].eqNullSafe(F.col("__c")) & (turns["part"] == F.col("__p")), how)

    def leaves(part: int, conv_id: int | None, turns: list[tuple]) -> list[tuple]:
        roles, beyond = [role_of(t[2]) for t in turns], turns[0][3]
        return [(part, conv_id, [repair(roles, s, beyond)[1][-1][1] for s in range(4)])]

    left = work_table(_streamed(placed(edge, settled, "inner"), ["role", "beyond"], leaves, "part int, conv_id long, leave array<int>"), "leaves")

    def entered(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        states = [START]
        for leave in list(pdf["leave"])[:-1]:
            states.append(int(leave[states[-1]]))
        return pd.DataFrame({"conv_id": [key[0]] * len(pdf), "part": pdf["part"], "enter": states}).astype({"conv_id": "Int64"})

    states = left.groupBy("conv_id").applyInPandas(entered, "conv_id long, part int, enter int")
    states = work_table(placed(states, settled, "inner").drop("__c", "__p"), "states")
    bounded = placed(rows, states, "left")

    def act(part: int, conv_id: int | None, turns: list[tuple]) -> list[tuple]:
        _, _, _, _, enter, beyond, before, first, last = turns[0]
        roles = [t[2] for t in turns]
        _, steps = repair([role_of(r) for r in roles], START if enter is None else enter, beyond or (0, 0, 0, 0))
        made = render([t[3] or "" for t in turns], steps, first is not False, last is not False)
        return [(conv_id, (before or 0) + i, t[0], t[2], t[3], KINDS[s[0]], ROLES[s[1] - 1], ",".join(ROLES[x - 1] for x in s[2]), piece) for i, (t, s, piece) in enumerate(zip(turns, steps, made, strict=True))]

    out = "conv_id long, seq long, turn long, role string, text string, action string, new_role string, inserted string, piece string"
    return _streamed(bounded, ["role", "text", "enter", "beyond", "before", "first", "last"], act, out)


def _key():
    """A conversation's id with null as a value of its own, in the order of a sort."""
    return F.struct(F.col("conv_id").isNotNull().alias("known"), F.coalesce("conv_id", F.lit(0)).alias("id"))


def rendered(pieces: DataFrame) -> DataFrame:
    """conv_id and text; for conversations that fit a row."""
    return pieces.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("seq", "piece"))), lambda p: p["piece"])).alias("text"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repaired(read(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "seq", "role", "action", "new_role", "inserted", "piece", F.length("piece").cast("long").alias("n_chars"))
