"""Repair of conversation structure by a cheapest sequence of edits.

A conversation is a system turn or none, then pairs of user and assistant. Rows
are dealt out by conversation and sorted by turn, so a task reads each
conversation as a stream; what it carries from one Arrow batch to the next is a
state of constant size: for each of four places in the grammar (nothing yet,
behind a system turn, behind a user, behind an assistant) the least cost so far
and how the edits that reach it compare. Of every row four bytes stay, one a
place: which place it was reached from, by which edit, and how many turns were
inserted behind it.

Conversations that fit are traced back, hashed and done in the same pass. For
one that does not, the texts are let go and the bytes leave the task in chunks,
as rows of a table in the shared checkpoint folder. A second pass reads each
such conversation's chunks from the last to the first and turns them into
edits; a third streams its rows once more, beside the edits, into the hash.

A row that repeats an earlier one is found by a join on digests before the
stream, so no task remembers all texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, table

SPACE = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The place behind an inserted or re-roled turn: a user anywhere but behind a user.
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DKR"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FIRST = ((0, (0, "")), None, (INSERT, (0, "I")), (2 * INSERT, (0, "II")))  # places before the first row, with what is inserted there


@lru_cache(maxsize=100_000)
def _step(states: tuple, initial: str, fault: str) -> tuple[int, bytes, tuple]:
    """(cost to add, four bytes, states behind the row).

    A state is (cost, (order, tail)): tail are the inserts at the end of the
    edits, order ranks the rest of them. Edits that reach different places by
    as many rows are either told apart before their tails or equal up to them,
    so pairs compare as the whole texts do.
    """
    best: dict[int, tuple] = {}
    for place, state in enumerate(states):
        if state is None:
            continue
        cost, (order, tail) = state
        moves = [(DELETE, "D", place)]
        if not fault or fault == "truncated":
            more, follows = TRUNCATED * bool(fault), FOLLOWS[place]
            moves.append((REROLE + more, "R", follows))
            if initial == " sua"[follows] or initial == "s" and place == START:
                moves.append((more, "K", SYSTEM if initial == "s" else follows))
        for extra, letter, to in moves:
            found = (cost + extra, order, tail + letter, place)
            if to not in best or found[:3] < best[to][:3]:
                best[to] = found
    rank = {key: i for i, key in enumerate(sorted({b[1:3] for b in best.values()}))}
    out: list[tuple | None] = [None] * 4
    for place, (cost, order, letters, came) in best.items():
        to = place
        for n in range(3):
            found = (cost + n * INSERT, (rank[order, letters], "I" * n), came | LETTERS.index(letters[-1]) << 2 | n << 4)
            if out[to] is None or found[:2] < out[to][:2]:
                out[to] = found
            to = FOLLOWS[to]
    least = min(o[0] for o in out if o)
    return least, bytes(o[2] if o else 255 for o in out), tuple((o[0] - least, o[1]) if o else None for o in out)


def _back(steps: bytes, place: int) -> tuple[str, int]:
    """The edits of a run of rows that ends at place, and the place it began at."""
    edits = []
    for at in range(len(steps) - 4, -1, -4):
        b = steps[at + place]
        edits.append(LETTERS[b >> 2 & 3] + "I" * (b >> 4))
        place = b & 3
    return "".join(reversed(edits)), place


def _ahead(place: int) -> str:
    """What is inserted before the first row."""
    return FIRST[place][1][1]


class _Text:
    """The repaired conversation's hash, fed by rows and edits in order."""

    def __init__(self):
        self.sha, self.place, self.any = hashlib.sha256(), START, False

    def put(self, role: str, text: str, place: int) -> None:
        self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.place, self.any = place, True

    def insert(self) -> None:
        to = FOLLOWS[self.place]
        self.put(ROLES[to], "", to)

    def edit(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.put(role, text, SYSTEM if role[0] == "s" else FOLLOWS[self.place])
        elif letter == "R":
            to = FOLLOWS[self.place]
            self.put(ROLES[to], text, to)


class _Conversation:
    """What is known of one conversation while its rows pass."""

    def __init__(self, key: str, most_rows: int, most_bytes: int):
        self.key, self.most_rows, self.most_bytes = key, most_rows, most_bytes
        self.counts = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.states, self.cost, self.steps = FIRST, 0, bytearray()
        self.low = self.high = self.turn = None
        self.distinct = self.chunks = self.held = 0
        self.before, self.last, self.rows, self.spilt = None, None, [], False

    def row(self, turn: int | None, role: str, text: str, digest: bytes, again: bool, tied: bool) -> None:
        """again: an earlier turn has the row's role and text; tied: its own turn is the first that does."""
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += self.high is None or turn != self.high
            self.high = turn
        body, initial = text.strip(SPACE), role[:1]
        same = tied and self.last == (turn, digest)
        self.last = (turn, digest)
        fault = "blank" if not body else "duplicate" if again or same else "truncated" if body[-1] not in ".!?" else ""
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = initial
        extra, step, self.states = _step(self.states, initial if initial in ("s", "u", "a") else "", fault)
        self.cost += extra
        self.steps += step
        if not self.spilt:
            self.rows.append((role, text))
            self.held += len(text) + len(role)
            if self.held > self.most_bytes or len(self.rows) > self.most_rows:
                self.spilt, self.rows = True, []

    def chunk(self) -> dict | None:
        """A full chunk of steps of a conversation that does not fit."""
        if self.spilt and len(self.steps) >= 4 * self.most_rows:
            return self._steps()
        return None

    def _steps(self) -> dict:
        out = {"key": self.key, "chunk": self.chunks, "steps": bytes(self.steps)}
        self.chunks, self.steps = self.chunks + 1, bytearray()
        return out

    def done(self) -> Iterator[dict]:
        """The conversation's row; where it does not fit, the rest of its steps before, and no hash yet."""
        ends = [(self.states[p][0], self.states[p][1], p) for p in (START, ASSISTANT) if self.states[p]]
        cost, _, place = min(ends)
        if self.high is not None:
            self.counts["gaps"] = self.high - self.low + 1 - self.distinct
        out = {"key": self.key, **self.counts, "cost": self.cost + cost, "place": place}
        if self.spilt:
            if self.steps:
                yield self._steps()
        else:
            edits, begin = _back(bytes(self.steps), place)
            out["audit"] = _ahead(begin) + edits
            out["repaired_sha256"] = _hash(out["audit"], iter(self.rows))
        yield out


def _hash(audit: str, rows: Iterator[tuple[str, str]]) -> str:
    text = _Text()
    for letter in audit:
        if letter == "I":
            text.insert()
        else:
            text.edit(letter, *next(rows))
    return text.sha.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(most_rows: int, most_bytes: int, columns: list[str]):
    """First pass: rows of finished conversations, and chunks of steps of those that do not fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, out, size = None, [], 0
        for batch in batches:
            for key, turn, no_turn, role, text, digest, again, tied in zip(*[batch[c] for c in ("key", "turn", "no_turn", "role", "text", "digest", "again", "tied")], strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        out += now.done()
                    now = _Conversation(key, most_rows, most_bytes)
                if role is not None:  # a dropped row only says that the conversation is there
                    now.row(None if no_turn else int(turn), role, text, bytes(digest), again, tied)
                    full = now.chunk()
                    if full:
                        out.append(full)
                        size += len(full["steps"])
                if len(out) >= 2_000 or size > 8 << 20:
                    yield pd.DataFrame(out, columns=columns, dtype=object)
                    out, size = [], 0
        if now is not None:
            out += now.done()
        if out:
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return run


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Second pass: chunks from the last to the first, each behind the conversation's end, to the edits of each."""
    key = place = None
    for batch in batches:
        out = []
        for k, chunk, end, steps in zip(batch["key"], batch["chunk"], batch["place"], batch["steps"], strict=True):
            if k != key:
                key, place = k, int(end)
            edits, place = _back(bytes(steps), place)
            out.append((k, chunk, (_ahead(place) if chunk == 0 else "") + edits))
        yield pd.DataFrame(out, columns=["key", "chunk", "edits"])


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Third pass: a conversation's edits in order, then its rows in order, to its audit and hash."""
    key, edits, text, at = None, [], None, 0

    def to_next_row(audit: str) -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            text.insert()
            at += 1

    out, audit = [], ""
    for batch in batches:
        for k, part, role, words in zip(batch["key"], batch["edits"], batch["role"], batch["text"], strict=True):
            if k != key:
                if key is not None:
                    out.append((key, audit, text.sha.hexdigest()))
                key, edits, text, at, audit = k, [], _Text(), 0, ""
            if role is None:
                edits.append(part)
                continue
            if edits:
                audit, edits = "".join(edits), []
                to_next_row(audit)
            text.edit(audit[at], role, words)
            at += 1
            to_next_row(audit)
        if out:
            yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
            out = []
    if key is not None:
        yield pd.DataFrame([(key, audit, text.sha.hexdigest())], columns=["key", "audit", "repaired_sha256"])


def repair(turns: DataFrame, most_rows: int = 200_000, most_bytes: int = 64 << 20, conversation_col: str = "conv_id") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of (conversation_col, turn, role, text).

    Rows go by turn, nulls first, then role and text. A null role and text mark
    a row that says no more than that the conversation is there; one that has
    no other rows costs nothing. Each row's first fault counts: blank,
    duplicate (an earlier row has its role and text), truncated (it ends in none
    of ``.!?``). The audit is the cheapest sequence of Keep, Rerole, Delete and
    Insert that leaves ``(s?(ua)+)?`` by the roles' first letters, of equal ones
    the least by ASCII; a role without letters fits nowhere. A null
    conversation is one of its own. An empty table gives no rows.

    A conversation of more than most_rows rows or most_bytes characters is not
    held: only its steps are, in chunks. Its rows are still one task's stream,
    as the hash of its text is one sequence.
    """
    kind = turns.schema[conversation_col].dataType.simpleString()
    id_ = F.col(conversation_col)
    key = F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))
    there = F.col("role").isNotNull()
    rows = turns.select(key.alias("key"), "turn", "role", "text", F.when(there, digest).alias("digest"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # Counted within tasks first; only digests that a conversation has twice meet the rows, written out so that Spark can split a frequent one.
    twice = cut(rows.where(there).groupBy("key", "digest").agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "digest", "first"))
    told = rows.join(twice, ["key", "digest"], "left")
    told = told.withColumn("tied", F.coalesce(F.col("first") == when, F.lit(False))).withColumn("again", F.coalesce(F.col("first") < when, F.lit(False)))
    order = ["key", F.col("no_turn").desc(), "turn", F.col("role").asc_nulls_first(), "text"]
    stream = told.select("key", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text", F.coalesce("digest", F.lit(b"")).alias("digest"), "again", "tied").repartition("key").sortWithinPartitions(*order)
    schema = "key string, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", place int, audit string, repaired_sha256 string, chunk int, steps binary"
    columns = [f.split()[0] for f in schema.split(", ")]
    first = cut(stream.mapInPandas(_streamed(most_rows, most_bytes, columns), schema))
    done = [F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias("id"), *_COUNTS, "audit", "repaired_sha256"]
    ready = first.where("audit is not null").select(*done)
    large = first.where("audit is null and steps is null").select("key", *_COUNTS, "place")
    if large.isEmpty():
        return ready
    chunks = first.where("steps is not null").select("key", "chunk", "steps").join(large.select("key", "place"), "key")
    edits = cut(chunks.repartition("key").sortWithinPartitions("key", F.col("chunk").desc()).select("key", "chunk", "place", "steps").mapInPandas(_traced, "key string, chunk int, edits string"))
    again = rows.where(there).join(large.select("key"), "key", "left_semi").select("key", F.lit(None).cast("int").alias("chunk"), F.lit(None).cast("string").alias("edits"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNull().alias("no_turn"), "role", "text")
    both = edits.select("key", "chunk", "edits", F.lit(0).cast("bigint").alias("turn"), F.lit(False).alias("no_turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")).unionByName(again)
    hashed = both.repartition("key").sortWithinPartitions("key", F.col("chunk").asc_nulls_last(), *order[1:]).select("key", "edits", "role", "text").mapInPandas(_hashed, "key string, audit string, repaired_sha256 string")
    return ready.unionByName(large.join(hashed, "key").select(*done))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults laid in by a checksum of conversation and turn; dropped rows stay with null role and text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    text: Column = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), name("role").alias("role"), name("text").alias("text"), kind.alias("k"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("k") == 4, "user").otherwise(F.col("role")))
    for c in ("role", "text"):
        rows = rows.withColumn(c, F.when(F.col("k") != 0, F.col(c)))
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("k", "copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("id", "conv_id")
