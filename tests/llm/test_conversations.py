"""Conversation repair: the search against a shortest path, the query against a plain version of its contract."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from pathlib import Path

import pytest

from tabgauge.llm import conversations

DATA = Path("/root/testdata/sf0.001")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shortest(rows):
    """Cheapest and ASCII-least edits of ``(role, text, fault)`` rows, and the repaired lines, by Dijkstra on (cost, edits)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, edits, lines
        here = (i, initials[-1:] if initials else "-")
        if here in seen:
            continue
        seen.add(here)

        def go(extra, edit, ahead, initial="", line=()):
            then = initials + initial
            if re.fullmatch("(s?(ua)*u?)?", then):
                heapq.heappush(heap, (cost + extra, edits + edit, i + ahead, then, lines + line))  # noqa: B023

        for name in ("user", "assistant"):
            go(2, "I", 0, name[0], (f"{name}:",))
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", 1)
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                if role[:1] and role[0] in "sua":
                    go(late, "K", 1, role[0], (f"{role}:{text}",))
                for name in ("user", "assistant"):
                    go(2 + late, "R", 1, name[0], (f"{name}:{text}",))
    raise AssertionError


def plain(table):
    """The contract, row by row."""
    damaged = {}
    for conv, turn, role, text in table:
        rows = damaged.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = re.sub("[.!?]", "", text)
        if hit == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(hit, 1)
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[0] for r in rows} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = shortest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def found(frame):
    assert frame.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 32])
def test_search_is_a_shortest_path(block):
    random.seed(block)
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for _ in range(600):
        rows = "".join(random.choice("suauauaxdUASX") for _ in range(random.randint(0, 9)))
        told = [(roles.get(c.lower(), "user"), "", "blank" if c == "d" else "truncated" if c.isupper() else "") for c in rows]
        assert conversations.repair(rows, block) == shortest(told)[:2], rows


def test_long_conversations_take_linear_work():
    assert conversations.repair("ua" * 20_000) == (0, "K" * 40_000)
    assert conversations.repair("u" * 20_000)[0] == 20_000
    assert conversations.repair("d" * 20_000) == (60_000, "D" * 20_000)


@pytest.mark.skipif(not DATA.exists(), reason="the given tables are absent")
def test_query(spark):
    table = spark.read.parquet(str(DATA / "conversations.parquet")).select("conv_id", "turn", "role", "text")
    assert found(conversations.query(spark, str(DATA))) == sorted(plain(map(tuple, table.collect())), key=str)


def test_odd_rows(spark):
    random.seed(3)
    texts = [None, "", " \t\x0b", "Yes.", "Yes. \n", "No", "no ", "Ça va?", "¿", "a:b\nc!", "x." * 50_000]
    roles = [None, "", "user", "User", "assistant", "system", "tool", "u"]
    rows = [(random.choice([None, *range(12)]), random.choice([None, *range(-2, 5)]), random.choice(roles), random.choice(texts)) for _ in range(300)]
    rows += [(99, 1, "user", "Same.")] * 40 + [(k, 0, "user", "Alone.") for k in range(200, 260)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, copies int, fault string")
    assert found(conversations.repaired(conversations.damaged(frame))) == sorted(plain(rows), key=str)
    assert found(conversations.repaired(conversations.damaged(frame.limit(0)))) == []


def test_one_shuffle(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    plan = conversations.repaired(conversations.damaged(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
