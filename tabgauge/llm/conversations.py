"""Cheapest repair of the role structure of conversations, by iterative-deepening A*.

Each row of a conversation is kept, given another role or deleted, and empty turns may be
put in anywhere, until the role initials read ``(s?(ua)+)?``. The search goes depth first
in ASCII order of the edits' initials (``D`` delete, ``I`` insert, ``K`` keep, ``R`` new
role) under a bound on the cost that rises by one until a path is accepted. Each bound
starts from a lower estimate: what the faults cost in any case, and one for each pair of
neighbours that must not stand together, as no edit mends two of them for less than 2.
States that failed are remembered with the budget they failed with. At the least bound
that accepts anything, the first path found is the ASCII-least of all cheapest.

What a path has done fixes the role that comes next, one of four states, so a long
conversation is searched in blocks of rows from its end: the costs found for a block's
four states are the end costs of the block before. Work is linear in the rows of a conversation.

All rows of a conversation meet in one task, because the digest of the repaired texts
reads them in order. Sorting is Spark's, and spills. Each row comes twice, first without
its text: the task keeps a few letters a row for the search, and then passes the texts
through the digest one by one. It never holds a conversation's texts.

Defined results: nulls in role and text are one space, and so they are in the key of the
damage. A null conversation id is an id. Rows are ordered by turn, null first, then role,
then text (by bytes). An empty role has no initial and cannot be kept. A conversation
without rows has zeros, an empty audit and the digest of an empty text. Other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import shared

#: White space, as in the contract's ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
#: Rows searched at once.
BLOCK = 32
#: Costs of edits; a truncated row that stays adds one.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

# States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a user or assistant turn put in or made in each state.
_NEXT = (USER, USER, ASSISTANT, USER)
#: State after a kept row, by state and initial.
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What ends a conversation in each state, and its cost.
_CLOSING = ("", "II", "I", "")
_END = tuple(INSERT * len(x) for x in _CLOSING)
_LEGAL = {"su", "ua", "au"}
_ROLE = {USER: "user", ASSISTANT: "assistant"}


def _estimates(rows: str) -> list[int]:
    """What the rows from each place on cost at least."""
    rest, after = [0], ""
    for code in reversed(rows):
        here = DELETE if code == "d" else TRUNCATED * code.isupper()
        if code != "d":
            here += bool(after) and code.lower() + after not in _LEGAL
            after = code.lower()
        rest.append(rest[-1] + here)
    return rest[::-1]


@lru_cache(maxsize=1 << 14)
def search(rows: str, entry: int, ends: tuple[int, ...]) -> tuple[int, str, int]:
    """Cost with the end's, edits and last state of the best path through ``rows`` from ``entry``.

    A row is the initial of its role (``x`` if it has no place in the pattern), in upper case
    if truncated, or ``d`` if it must go. ``ends`` are the costs of what follows, by state.
    """
    rest, least, n = _estimates(rows), min(ends), len(rows)
    failed: dict[tuple[int, int], int] = {}

    def descend(i: int, state: int, left: int) -> tuple[str, int] | None:
        if i == n:
            return ("", state) if ends[state] <= left else None
        if rest[i] + least > left or failed.get((i, state), -1) >= left:
            return None
        code = rows[i]
        extra = TRUNCATED * code.isupper()
        for edit in "DIKR":
            if edit == "D":
                found = descend(i + 1, state, left - DELETE)
            elif edit == "I":
                found = descend(i, _NEXT[state], left - INSERT)
            elif code == "d":
                break
            elif edit == "K":
                kept = _KEPT[state].get(code.lower())
                found = None if kept is None else descend(i + 1, kept, left - extra)
            else:
                found = descend(i + 1, _NEXT[state], left - REROLE - extra)
            if found:
                return edit + found[0], found[1]
        failed[i, state] = left
        return None

    bound = rest[0] + least
    while not (found := descend(0, entry, bound)):
        bound += 1
    return bound, *found


def repair(rows: str, block: int = BLOCK) -> tuple[int, str]:
    """Cost and edits of the best repair of a whole conversation."""
    ends, parts = _END, []
    for at in reversed(range(0, len(rows), block)):
        part = rows[at : at + block]
        parts.append([search(part, state, ends) for state in range(4)] if at else {START: search(part, START, ends)})
        ends = tuple(x[0] for x in parts[-1]) if at else ends
    state, edits = START, []
    for part in reversed(parts):
        _, path, state = part[state]
        edits.append(path)
    return (parts[-1][START][0] if parts else 0), "".join(edits) + _CLOSING[state]


class _Conversation:
    """What is known of the conversation that is being read: rows without texts first, then with them."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.codes, self.before = conv_id, [], None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.edits, self.at, self.state, self.joined = None, 0, START, False
        self.digest = hashlib.sha256()

    def fact(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += fault == "b"
        self.duplicate += fault == "d"
        self.truncated += fault == "t"
        self.illegal += self.before is not None and self.before + initial not in _LEGAL
        self.before = initial
        code = initial if initial and initial in "sua" else "x"
        self.codes.append("d" if fault in ("b", "d") else code.upper() if fault == "t" else code)

    def _solve(self) -> None:
        if self.edits is None:
            self.cost, self.edits = repair("".join(self.codes))
            self.codes = []

    def _put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.joined else ''}{role}:{text}".encode())
        self.joined = True

    def _insert(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.state, self.at = _NEXT[self.state], self.at + 1
            self._put(_ROLE[self.state], "")

    def text(self, role: str, text: str) -> None:
        self._solve()
        self._insert()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "R":
            self.state = _NEXT[self.state]
            self._put(_ROLE[self.state], text)
        elif edit == "K":
            self.state = _KEPT[self.state][role[0]]
            self._put(role, text)

    def result(self) -> tuple:
        self._solve()
        self._insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.edits, self.digest.hexdigest())


_COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repaired(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), *((c, pa.int64()) for c in _COLUMNS[1:7]), *((c, pa.string()) for c in _COLUMNS[7:])])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "step", "turn", "role", "text", "fault")]
            for conv_id, step, turn, role, text, fault in zip(*columns, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if step == 1:
                    now.fact(turn, role[:1], fault)
                elif step == 2:
                    now.text(role, text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                done = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(now.result(), schema.types, strict=True)], schema=schema)

    return work


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv_id, turn, role, text`` with ``copies``, how often the row stands there; 0 keeps the id only."""
    bare = F.rtrim("text", F.lit(SPACE))
    together = rows.repartition("conv_id")  # every window and sort below keeps this partitioning
    each = together.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    order = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    seen = F.row_number().over(Window.partitionBy("conv_id", F.col("copies") > 0, "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    fault = (
        F.when(bare == "", "b").when(seen > 1, "d").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "t").otherwise("")
    )
    facts = each.withColumn("fault", fault).withColumn("place", place)
    # Step 0 only names the conversation, step 1 brings the facts of its rows, step 2 their texts.
    steps = facts.withColumn("step", F.explode(F.when(F.col("copies") > 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    sent = steps.withColumn("text", F.when(F.col("step") == 2, F.col("text"))).sortWithinPartitions("conv_id", "step", "place")
    field = rows.schema["conv_id"]
    schema = f"conv_id {field.dataType.simpleString()}, {', '.join(f'{c} bigint' for c in _COLUMNS[1:7])}, audit string, repaired_sha256 string"
    return sent.select("conv_id", "step", "turn", "role", "text", "fault").mapInArrow(_repaired(to_arrow_type(field.dataType)), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with the contract's damage, by the CRC-32 of ``conv_id:turn``."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.crc32(key.cast("binary")) % 20
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations``, damaged and repaired."""
    return repaired(damaged(shared.table(spark, sf_dir, "conversations")))
