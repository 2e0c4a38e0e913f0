"""Chat formatting: the cheapest repair of role sequences by dynamic programming over an automaton of legal turns.

Legal is an optional system turn, then user and assistant in turn, ending with
an assistant. A turn may keep its role, get another, or be merged into the one
before; empty turns may be inserted. The costs of a stretch of turns, from
every state to every state, are a small matrix, and matrices of neighbouring
stretches multiply (minimum of sums). So a long conversation is cut at the
borders of Spark's partitions: stretches are summed up, what comes before each
is worked out from the sums, and stretches are repaired apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourlens.llm.shared import written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: After each state, the turns that may come.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Other names of the roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "ai": ASSISTANT,
         "bot": ASSISTANT, "model": ASSISTANT, "gpt": ASSISTANT}
KEEP, MERGE, RELABEL, MERGE_RELABEL = "keep", "merge", "relabel", "merge_relabel"
NEVER = 1 << 40


@dataclass(frozen=True)
class Settings:
    """Costs of the repairs (``name``: giving a role to a turn without a known one), and the markers of the text."""

    merge: int = 2
    relabel: int = 4
    name: int = 1
    insert: int = 5
    begin: str = "<|{role}|>\n"
    end: str = "<|end|>\n"
    merged: str = "\n"


def role_code(role: str | None) -> int:
    """Number of a role; START for unknown ones and null."""
    return NAMES.get((role or "").strip().lower(), START)


@lru_cache(maxsize=8)
def moves(settings: Settings) -> list[list[list[tuple[int, int, str] | None]]]:
    """By role, state before and state after: (cost, inserted role or START, action) of the cheapest move, or None.

    Of equal costs the first counts: without insertion, then keep, merge, relabel.
    """
    table = [[[None] * 4 for _ in range(4)] for _ in range(4)]
    for role in range(4):
        for state in range(4):
            options = []
            for inserted in (START, *LEGAL[state]):
                if inserted == SYSTEM:
                    continue
                at, paid = (inserted, settings.insert) if inserted else (state, 0)
                for target in LEGAL[at]:
                    right = target == role
                    change = 0 if right else settings.relabel if role else settings.name
                    options.append((target, paid + change, inserted, KEEP if right else RELABEL))
                if at != START and not inserted:
                    right = at == role
                    change = 0 if right else settings.relabel if role else settings.name
                    options.append((at, settings.merge + change, inserted, MERGE if right else MERGE_RELABEL))
            order = {KEEP: 0, MERGE: 1, RELABEL: 2, MERGE_RELABEL: 3}
            for target, cost, inserted, action in sorted(options, key=lambda o: (o[1], o[2] != START, order[o[3]])):
                if table[role][state][target] is None:
                    table[role][state][target] = (cost, inserted, action)
    return table


def ending(settings: Settings) -> list[tuple[int, tuple[int, ...]]]:
    """By last state: the cost of a legal end, and the empty turns it inserts."""
    return [(0, ()), (2 * settings.insert, (USER, ASSISTANT)), (settings.insert, (ASSISTANT,)), (0, ())]


@lru_cache(maxsize=8)
def _costs(settings: Settings) -> np.ndarray:
    return np.array([[[m[0] if m else NEVER for m in row] for row in role] for role in moves(settings)], np.int64)


def stretch(codes: list[int], settings: Settings) -> np.ndarray:
    """Least cost of a stretch of turns from every state to every state."""
    costs = _costs(settings)
    total = np.where(np.eye(4, dtype=bool), 0, NEVER)
    for code in codes:
        total = np.minimum((total[:, :, None] + costs[code]).min(axis=1), NEVER)
    return total


def traces(codes: list[int], before: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """States after each turn on the cheapest way to every last state, and the state such a way begins in.

    ``before``: least cost of each state in front. Of equal ways the one with
    the smaller state before a turn counts, the last turn first.
    """
    costs, cost, back = _costs(settings), before, []
    for code in codes:
        ways = cost[:, None] + costs[code]
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), NEVER)
    states, at = np.zeros((len(codes), 4), np.int8), np.arange(4)
    for i in range(len(codes) - 1, -1, -1):
        states[i] = at
        at = back[i][at]
    return states, at


def _escape(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def render(rows: list[tuple], states: list[int], entry: int, settings: Settings, last: bool) -> Iterator[tuple]:
    """(turn, sub, role, action, piece) of each repaired turn. Pieces in order are the conversation's text."""
    table, state = moves(settings), entry

    def opened(role: int, before: int, text: str) -> str:
        return (settings.end if before else "") + settings.begin.format(role=ROLES[role]) + text

    for (turn, role, text), after in zip(rows, states):
        _, inserted, action = table[role_code(role)][state][after]
        if inserted:
            yield turn, 0, ROLES[inserted], "insert", opened(inserted, state, "")
            state = inserted
        merged = action in (MERGE, MERGE_RELABEL)
        yield turn, 1, ROLES[after], action, settings.merged + _escape(text) if merged else opened(
            after, state, _escape(text))
        state = after
    if last:
        for sub, role in enumerate(ending(settings)[state][1], 2):
            yield None, sub, ROLES[role], "insert", opened(role, state, "")
            state = role
        yield None, 4, None, "end", settings.end


_OUT = "conv_id long, place long, turn long, role string, action string, piece string"
_FIELDS = [("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
           ("action", pa.string()), ("piece", pa.string())]


def _placed(conv, base: int, part: int, rows: list[tuple], states: list[int], entry: int, settings: Settings,
            last: bool) -> Iterator[tuple]:
    """Rendered rows with ``place``, which grows along the conversation: partition, row in it, inserted or own."""
    i = base
    for turn, sub, role, action, piece in render(rows, states, entry, settings, last):
        at = i if sub <= 1 else base + len(rows) - 1
        yield conv, part << 40 | at << 3 | sub, turn, role, action, piece
        i += sub == 1


def _first_pass(batches, settings: Settings):
    """Repairs conversations that lie inside a partition; rows of those at its borders are passed on."""
    part, base, seen_first = TaskContext.get().partitionId(), 0, False
    conv, rows = None, []

    def batch_of(done: list[tuple], open_: list[tuple]):
        full = [(*d, None, None, None) for d in done] + [
            (c, None, t, r, None, x, part, i, "open") for c, i, t, r, x in open_]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in full], t) for i, (_, t) in enumerate(_OPEN)],
                                          [n for n, _ in _OPEN])

    def close(border: bool):
        if border:
            return batch_of([], [(conv, base + i, t, r, x) for i, (t, r, x) in enumerate(rows)])
        states, _ = traces([role_code(r) for _, r, _ in rows], np.array([0, NEVER, NEVER, NEVER]), settings)
        return batch_of(list(_placed(conv, base, part, rows, states[:, _last(rows, settings)], START, settings, True)), [])

    for batch in batches:
        for c, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if rows and c != conv:
                yield close(not seen_first)
                base, rows, seen_first = base + len(rows), [], True
            conv = c
            rows.append((turn, role, text))
    if rows:
        yield close(True)


_OPEN = [*_FIELDS, ("part", pa.int32()), ("row", pa.int64()), ("kind", pa.string())]


def _best_end(cost: np.ndarray, settings: Settings) -> int:
    return int((cost + np.array([c for c, _ in ending(settings)])).argmin())


def _last(rows: list[tuple], settings: Settings) -> int:
    total = stretch([role_code(r) for _, r, _ in rows], settings)
    return _best_end(total[START], settings)


def repair(conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """conv_id, place, turn, role, action, piece: the repaired turns of every conversation (conv_id, turn, role, text).

    One row per turn, inserted turn and end of a conversation; ``piece`` is its
    part of the rendered text, which is the pieces by ``place``. So neither a
    conversation nor what is merged is ever held as one text. Action is keep,
    merge, relabel, merge_relabel, insert or end; the sum of their costs is the
    least possible. Turns are ordered by turn, role and a hash of the text,
    nulls first; equal rows are one; rows without a conv_id are one
    conversation; unknown and null roles can be given any role; null texts are
    empty; markers inside texts are broken up; an empty table gives no rows.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), "text").distinct()
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    schema = _OUT + ", part int, row long, kind string"
    passed = written(turns.repartitionByRange(*order).sortWithinPartitions(*order, "text").select(
        "conv_id", "turn", "role", "text").mapInArrow(lambda b: _first_pass(b, settings), schema), "chat")
    columns = ["conv_id", "place", "turn", "role", "action", "piece"]
    done = passed.where("kind IS NULL").select(columns)
    open_ = passed.where("kind = 'open'").select("conv_id", "part", "row", "turn", "role", F.col("piece").alias("text"))

    def summed(key, group: pd.DataFrame) -> pd.DataFrame:
        total = stretch([role_code(r) for r in group.sort_values("row")["role"]], settings)
        return pd.DataFrame({"conv_id": [key[0]], "part": [key[1]], "costs": [total.ravel().tolist()]})

    def ahead(group: pd.DataFrame) -> pd.DataFrame:
        """What every state costs in front of each stretch; the last stretch also knows the state at the end."""
        group, cost, before = group.sort_values("part"), np.array([0, NEVER, NEVER, NEVER]), []
        for costs in group["costs"]:
            before.append(cost.tolist())
            cost = np.minimum((cost[:, None] + np.array(costs).reshape(4, 4)).min(axis=0), NEVER)
        ends = [-1] * (len(group) - 1) + [_best_end(cost, settings)]
        return group[["conv_id", "part"]].assign(before=before, end=ends)

    def begun(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        _, entry = traces([role_code(r) for r in group["role"]], np.array(group["before"].iloc[0]), settings)
        return pd.DataFrame({"conv_id": [key[0]], "part": [key[1]], "end": [group["end"].iloc[0]],
                             "entries": [entry.tolist()], "before": [group["before"].iloc[0]]})

    def behind(group: pd.DataFrame) -> pd.DataFrame:
        """The state each stretch ends in: the one that the way through the next begins in."""
        group = group.sort_values("part", ascending=False)
        end, ends = int(group["end"].iloc[0]), []
        for entries in group["entries"]:
            ends.append(end)
            end = int(entries[end])
        last = [True] + [False] * (len(group) - 1)
        return group[["conv_id", "part", "before"]].assign(after=ends, last=last)

    def finished(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row")
        codes = [role_code(r) for r in group["role"]]
        states, entry = traces(codes, np.array(group["before"].iloc[0]), settings)
        after = int(group["after"].iloc[0])
        turns_ = [None if pd.isna(t) else int(t) for t in group["turn"]]
        rows = list(zip(turns_, group["role"], group["text"]))
        out = pd.DataFrame(list(_placed(
            None, int(group["row"].iloc[0]), int(key[1]), rows, states[:, after], int(entry[after]), settings,
            bool(group["last"].iloc[0]))), columns=columns)
        out["conv_id"] = pd.array([None if pd.isna(key[0]) else int(key[0])] * len(out), "Int64")
        out["turn"] = out["turn"].astype("Int64")
        return out

    def joined(table: DataFrame) -> DataFrame:
        named = table.withColumnRenamed("conv_id", "c").withColumnRenamed("part", "p")
        return open_.join(named, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")

    sums = open_.groupBy("conv_id", "part").applyInPandas(summed, "conv_id long, part int, costs array<long>")
    front = written(sums.groupBy("conv_id").applyInPandas(
        ahead, "conv_id long, part int, before array<long>, end int"), "front")
    ways = joined(front).groupBy("conv_id", "part").applyInPandas(
        begun, "conv_id long, part int, end int, entries array<int>, before array<long>")
    ends = written(ways.groupBy("conv_id").applyInPandas(
        behind, "conv_id long, part int, before array<long>, after int, last boolean"), "ends")
    return done.union(joined(ends).groupBy("conv_id", "part").applyInPandas(finished, _OUT))
