import itertools
import random

import numpy as np
import pytest

from hourlens.llm import chat
from hourlens.llm.chat import ASSISTANT, LEGAL, ROLES, START, Settings, repair, role_code

COST = Settings()


def price(actions, unknown):
    """Cost of a repaired conversation from the actions of its rows."""
    total = 0
    for action, blank in zip(actions, unknown):
        change = COST.name if blank else COST.relabel
        total += {"keep": 0, "end": 0, "insert": COST.insert, "merge": COST.merge, "relabel": change,
                  "merge_relabel": COST.merge + change}[action]
    return total


def least(roles):
    """Least cost by trying: shortest path over (turns done, state), one move at a time."""
    best = {(0, START): 0}
    queue = [(0, 0, START)]
    while queue:
        queue.sort()
        cost, i, s = queue.pop(0)
        if i == len(roles) and s in (START, ASSISTANT):
            return cost
        steps = [(cost + COST.insert, i, t) for t in LEGAL[s] if t != chat.SYSTEM]
        if i < len(roles):
            change = [0 if roles[i] == t else COST.relabel if roles[i] else COST.name for t in range(4)]
            steps += [(cost + change[t], i + 1, t) for t in LEGAL[s]]
            if s != START:
                steps.append((cost + COST.merge + change[s], i + 1, s))
        for c, j, t in steps:
            if c < best.get((j, t), 1 << 30):
                best[j, t] = c
                queue.append((c, j, t))


def test_stretch_is_the_least_cost():
    ends = np.array([c for c, _ in chat.ending(COST)])
    for n in range(5):
        for roles in itertools.product(range(4), repeat=n):
            total = chat.stretch(list(roles), COST)
            assert (total[START] + ends).min() == least(roles)


def conversations(n=40):
    rng, rows = random.Random(3), []
    for c in range(n):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "user", "system", "Human", None, "tool"]),
                         f"text {c} {t} <|user|>"))
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"long {t}") for t in range(3000)]
    return rows


@pytest.mark.parametrize("partitions", [1, 13])
def test_repairs(spark, partitions):
    rows = conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    given = {}
    for c, t, role, text in rows:
        given.setdefault(c, []).append((t, role, text))
    assert set(by) == set(given)
    for c, out in by.items():
        own = [r for r in out if r.action not in ("insert", "end")]
        assert [r.turn for r in own] == [t for t, _, _ in given[c]]
        codes = {t: role_code(role) for t, role, _ in given[c]}
        assert price([r.action for r in out], [r.action not in ("insert", "end") and not codes[r.turn] for r in out]) == (
            least([codes[t] for t, _, _ in given[c]]) if c < 1000 else int(
                (chat.stretch([codes[t] for t, _, _ in given[c]], COST)[START] + [c for c, _ in chat.ending(COST)]).min()))
        text = "".join(r.piece for r in out)
        turns = [part.split("\n", 1) for part in text.removesuffix(COST.end).split(COST.end)]
        state = START
        for head, body in turns:
            role = ROLES.index(head.removeprefix("<|").removesuffix("|>"))
            assert role in LEGAL[state] and "<|" not in body
            state = role
        assert state == ASSISTANT and out[-1].action == "end" and text.endswith(COST.end)
        for _, _, body in given[c]:
            assert body.replace("<|", "< |") in text


def test_partitions_do_not_change_the_result(spark):
    table = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    out = []
    for n in (2, 9):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = sorted(repair(table).collect(), key=lambda r: (r.conv_id, r.place))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        out.append([(r.conv_id, r.turn, r.role, r.action, r.piece) for r in rows])
    assert out[0] == out[1]


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, piece int"
    rows = [(1, None, None, None, 0), (1, 0, "user", "", 0), (1, 0, "user", "", 0), (None, 1, "system", "x", 0),
            (None, None, "assistant", "y" * 100_000, 0), (2, 5, "user", "tie a", 0), (2, 5, "user", "tie b", 0)]
    got = repair(spark.createDataFrame(rows, schema)).collect()
    assert {r.conv_id for r in got} == {1, 2, None}
    assert sum(r.action not in ("insert", "end") for r in got) == 6
    assert sum(r.action == "end" for r in got) == 3
    assert repair(spark.createDataFrame([], schema)).collect() == []
