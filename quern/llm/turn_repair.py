"""Repair of conversations by error-correcting Earley parsing.

A conversation's rows, in the order of their turns, are parsed by a weighted
grammar of roles, ``(s?(ua)+)?`` by initials.  Beside keeping a row there are
error productions: delete it, give it another role, insert a turn with an empty
text.  The grammar is left-linear, so every item of the chart begins at the
first row and the chart of a position is one item for each nonterminal, which
retains the least (cost, audit) and the digest of the turns repaired so far; it
follows from the chart before it.  A task therefore streams the rows of a
conversation, however long, without holding them: what grows is the audit, one
letter for an edit, which is a column of the result.  (One digest over a whole
conversation is sequential by nature, so its rows pass through one task; texts
are shuffled once, and repeated rows are found beforehand on slim keys.)

Edits: K keeps a row (0), R gives it the role user or assistant (3), D deletes
it (4; required for blank rows and repeated ones), I inserts a turn (3); a
truncated row that is not deleted adds 3.

Defined cases: a null role or text is one space, so a null text is blank; rows
are ordered by turn (nulls first), then role and text; a null conv_id is a
conversation of its own; a conversation that has lost all its rows has zeros,
an empty audit and the digest of nothing; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import bounded_batches

#: head -> prior terminal: what stands before the last turn, and that turn's initial.
GRAMMAR = (("system", "empty", "s"), ("asked", "empty", "u"), ("asked", "system", "u"), ("answered", "asked", "a"), ("asked", "answered", "u"))
GOALS = ("empty", "answered")
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: After so many rows audits are frozen into ranks, so that ties are told by two numbers and a short tail.
FREEZE = 64

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Item:
    """The best way to a nonterminal: its cost, its audit (a frozen part with a rank, and a tail) and the digest of its turns."""

    __slots__ = ("cost", "rank", "tail", "frozen", "digest")

    def __init__(self, cost: int, rank: int, tail: str, frozen: tuple | None, digest):
        self.cost, self.rank, self.tail, self.frozen, self.digest = cost, rank, tail, frozen, digest

    def audit(self) -> str:
        parts, node = [self.tail], self.frozen
        while node:
            node, part = node
            parts.append(part)
        return "".join(reversed(parts))


def _offer(found: dict, head: str, item: Item, cost: int, letter: str, turn: tuple[str, str] | None) -> bool:
    """Retain the way over ``item`` if it is the least to ``head`` so far.

    Equal costs never come with an audit that begins the other: both cover the same rows, so it would be longer by insertions, which cost.
    """
    new = (item.cost + cost, item.rank, item.tail + letter)
    if head in found and found[head][:3] <= new:
        return False
    found[head] = (*new, item, turn)
    return True


def _built(found: dict, priors: dict) -> dict[str, Item]:
    """Items of the retained ways; a digest is copied only where a turn is added."""
    out = {}
    for head, (cost, rank, tail, item, turn) in found.items():
        digest = item.digest
        if turn is not None:
            digest = digest.copy()
            digest.update((("" if priors[head] == "empty" else "\n") + turn[0] + ":" + turn[1]).encode("utf-8", "surrogatepass"))
        out[head] = Item(cost, rank, tail, item.frozen, digest)
    return out


def _completed(chart: dict[str, Item]) -> dict[str, Item]:
    """The chart with what insertions reach, until nothing gets cheaper."""
    changed = True
    while changed:
        changed = False
        for head, prior, terminal in GRAMMAR:
            if prior in chart and terminal in ROLES:
                found = {head: (i.cost, i.rank, i.tail, i, None)} if (i := chart.get(head)) else {}
                if _offer(found, head, chart[prior], INSERT, "I", (ROLES[terminal], "")):
                    chart.update(_built(found, {head: prior}))
                    changed = True
    return chart


def start() -> dict[str, Item]:
    return _completed({"empty": Item(0, 0, "", None, hashlib.sha256())})


def scanned(chart: dict[str, Item], role: str, text: str, lost: bool, truncated: bool) -> dict[str, Item]:
    """The chart after one more row; ``lost`` rows can only be deleted."""
    found, priors = {}, {}
    for head, item in chart.items():
        _offer(found, head, item, DELETE, "D", None)
    if not lost:
        more = TRUNCATED if truncated else 0
        for head, prior, terminal in GRAMMAR:
            if prior not in chart:
                continue
            if role[:1] == terminal:
                if _offer(found, head, chart[prior], more, "K", (role, text)):
                    priors[head] = prior
            elif terminal in ROLES and _offer(found, head, chart[prior], REROLE + more, "R", (ROLES[terminal], text)):
                priors[head] = prior
    return _completed(_built(found, priors))


def frozen(chart: dict[str, Item]) -> dict[str, Item]:
    """The same chart with audits moved to shared frozen parts, ranked among themselves.

    Insertions at the end stay in the tail: all frozen parts then cover the same rows and end with one, so none begins another and their order is final.
    """
    cuts = {head: len(item.tail.rstrip("I")) for head, item in chart.items()}
    keys = sorted({(item.rank, item.tail[: cuts[head]]) for head, item in chart.items()})
    nodes, out = {}, {}
    for head, item in chart.items():
        key = (item.rank, item.tail[: cuts[head]])
        node = nodes.setdefault(key, (item.frozen, key[1]))
        out[head] = Item(item.cost, keys.index(key), item.tail[cuts[head] :], node, item.digest)
    return out


class Conversation:
    """Counts and chart of the rows of one conversation so far."""

    def __init__(self) -> None:
        self.chart, self.rows = start(), 0
        self.least = self.most = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None
        self.last: tuple | None = None
        self.repeats: set[bytes] = set()

    def repeat(self, turn: int | None, digest: bytes) -> None:
        """A row with this digest at this turn has occurred at an earlier one."""
        if self.last is None or self.last[0] != turn:
            self.repeats = set()
        self.last = (turn, None, None)
        self.repeats.add(digest)

    def add(self, turn: int | None, role: str, text: str, digest: bytes | None) -> None:
        if self.last is None or self.last[0] != turn:
            self.repeats = set()
        if turn is not None and turn != self.turn:
            self.least, self.most, self.turns, self.turn = turn if self.turns == 0 else self.least, turn, self.turns + 1, turn
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        blank = not shown
        duplicate = not blank and (digest in self.repeats or self.last == (turn, role, text))
        truncated = not blank and not duplicate and shown[-1] not in ".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial, self.last = role[:1], (turn, role, text)
        self.chart = scanned(self.chart, role, text, blank or duplicate, truncated)
        self.rows += 1
        if self.rows % FREEZE == 0:
            self.chart = frozen(self.chart)

    def result(self) -> tuple:
        best = min((self.chart[g] for g in GOALS if g in self.chart), key=lambda i: (i.cost, i.rank, i.tail))
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit(), best.digest.hexdigest()


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, kept): rows dropped, emptied, unpunctuated, repeated or given to the user by the checksum of ``conv_id:turn``.

    A dropped row stays with ``kept`` false, so that its conversation is known.
    """
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), _text(role).alias("role"), _text(text).alias("text"))
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn"))) % 20
    rows = rows.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("kept"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def earlier_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest), once each: role and text at this turn occurred at an earlier turn of the conversation."""
    slim = rows.filter("kept").select("conv_id", F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("no")).alias("at"), _digest().alias("digest"))
    groups = slim.groupBy("conv_id", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first <> last")
    groups = groups.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), "first")
    found = slim.join(groups, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")) & (F.col("at") != F.col("first")))
    return found.select("conv_id", F.col("at.no").alias("turn"), "digest").distinct()


def repaired(rows: DataFrame) -> DataFrame:
    """One row of ``RESULT`` for each conversation of ``rows`` (conv_id, turn, role, text, kept)."""
    bounded_batches(rows.sparkSession)
    # At a turn the digests of repeated rows come first, then its rows.
    marks = earlier_rows(rows).select("conv_id", "turn", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("kept"), "digest")
    stream = rows.withColumn("digest", _digest()).unionByName(marks)
    stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, own, done, size = None, None, [], 0
        for batch in batches:
            for key, turn, role, text, kept, digest in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if own is None or key != conv:
                    if own is not None:
                        done.append((conv, *own.result()))
                        size += len(done[-1][-2])
                    conv, own = key, Conversation()
                if role is None:
                    own.repeat(turn, digest)
                elif kept:
                    own.add(turn, role, text, digest)
            if len(done) >= 1000 or size > 1 << 20:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)
                done, size = [], 0
        if own is not None:
            done.append((conv, *own.result()))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema)

    return stream.select("conv_id", "turn", "role", "text", "kept", "digest").mapInArrow(run, RESULT)
