"""Conversation structure repair: the cheapest edits that turn a conversation into `(s?(ua)+)?`.

Rows of a conversation are taken by turn (nulls first; ties by role, then text).  A row's first fault counts: *blank*
(only ASCII white space), *duplicate* (same role and text earlier in the conversation), *truncated* (the last other character
is none of `.!?`).  Each row is Kept (cost 0), Reroled to user or assistant (2) or Deleted (3; blank and duplicate rows must be);
turns with an empty text may be Inserted anywhere (2); a truncated row that is not deleted costs 1 more.  The initials
of the roles must come out as an optional `s` and pairs `ua`, or as nothing; of equally cheap edits the ASCII-least
string of initials K, R, D, I wins.

The rows are shuffled once, by conversation, and sorted by turn; duplicates are numbered by a window that
reuses that shuffle.  `mapInArrow` then carries the dynamic program across Arrow batches: four states (nothing yet, after
`s`, after `u`, after `a`), each with its cost and its rank among the states' strings.  Strings of one
row never are prefixes of each other, since each ends in that row's own edit, so ranks suffice to compare what follows.
A row leaves one byte per state as back-pointer; back-pointers and the texts that may stay are spooled,
and conversations beyond SPOOL_BYTES go on in an unnamed scratch file of the running task, which a lost executor's
task just writes anew.  Memory holds one batch, the spool and, for a giant conversation, its string of edits, which is part of the result.

A conversation is sequential by this method, so one task reads all of it, however long.
Null roles and texts count as one space; so does a null id or turn where `damaged` spells it.  Rows without an id are one conversation.
Repeated rows are duplicates.  Extra columns are not looked at.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from groundswell.llm.frames import slices
from groundswell.plans.shared import parallelism, ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPOOL_BYTES = 8 << 20
OUT_ROWS = 4096
BLANK, DUPLICATE, CUT = 1, 2, 3
FAULTS = {0: None, BLANK: "blank", DUPLICATE: "duplicate", CUT: "truncated"}
_MARK = re.compile(r"[^\x20\x09-\x0D]")
_LAST_MARK = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

# States: nothing yet, after s, after u, after a.  A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
_ROLES = {USER: "user", ASSISTANT: "assistant"}
_AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where a user or assistant turn leads
_LEGAL = {"su", "ua", "au"}
_ARROW = {"long": pa.int64(), "string": pa.string()}
_EDITS = "DKR"


def _insertions(state: int) -> list[int]:
    """States after 0, 1 and 2 inserted turns; more never pay, as two of them lead back."""
    return [state, _AFTER[state], _AFTER[_AFTER[state]]]


def _ways(initial: str, kind: int) -> Iterator[tuple[int, int, str, int, int]]:
    """`(from, insertions, edit, to, cost)` of every way to take a row."""
    extra = TRUNCATED if kind == CUT else 0
    for state in range(4):
        for n, at in enumerate(_insertions(state)):
            yield state, n, "D", at, n * INSERT + DELETE
            if kind in (BLANK, DUPLICATE):
                continue
            yield state, n, "R", _AFTER[at], n * INSERT + REROLE + extra
            if initial == "s" and at == START:
                yield state, n, "K", SYSTEM, n * INSERT + KEEP + extra
            if initial == _ROLES[_AFTER[at]][0]:
                yield state, n, "K", _AFTER[at], n * INSERT + KEEP + extra


Best = tuple[tuple[int, int, int], ...]  # (state, cost above the least, rank of its string)


@lru_cache(maxsize=1 << 16)
def advance(best: Best, initial: str, kind: int) -> tuple[Best, int, bytes]:
    """The states after one more row, what the least cost grew by, and a back-pointer for each state.

    Costs of the states differ by a few edits at most, so the same few arguments come again and again.
    """
    known = {state: (cost, rank) for state, cost, rank in best}
    found: dict[int, tuple] = {}
    for before, n, edit, after, cost in _ways(initial, kind):
        if before in known:
            base, rank = known[before]
            way = ((base + cost, rank, "I" * n + edit), before, n, edit)
            if after not in found or way[0] < found[after][0]:
                found[after] = way
    ranks = {key: i for i, key in enumerate(sorted({way[0][1:] for way in found.values()}))}
    least = min(way[0][0] for way in found.values())
    pointers = bytearray(4)
    for after, (_, before, n, edit) in found.items():
        pointers[after] = before | n << 2 | _EDITS.index(edit) << 4
    return tuple((after, way[0][0] - least, ranks[way[0][1:]]) for after, way in sorted(found.items())), least, bytes(pointers)


def fault(text: str, seen: bool) -> int:
    if not _MARK.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return 0 if _LAST_MARK.search(text).group(1) in ".!?" else CUT


class Conversation:
    """One conversation while its rows come in: the program's states, back-pointers, counts and the rows that may stay."""

    def __init__(self, conv_id) -> None:
        self.id = conv_id
        self.best: Best = ((START, 0, 0),)
        self.base = self.rows = 0
        self.trail = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.spool = tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES)
        self.counts = [0, 0, 0, 0]
        self.illegal, self.previous = 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        kind, initial = fault(text, seen), role[:1]
        self.counts[kind] += 1
        self.illegal += self.previous is not None and self.previous + initial not in _LEGAL
        self.previous = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.best, grown, pointers = advance(self.best, initial if initial in ("s", "u", "a") else "", kind)
        self.base += grown
        self.rows += 1
        self.trail.write(pointers)
        head, body = (b"", b"") if kind in (BLANK, DUPLICATE) else (role.encode(), text.encode())
        self.spool.write(struct.pack("<BQQ", kind, len(head), len(body)) + head + body)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def edits(self) -> tuple[int, str]:
        """Cost and string of edits; the trail is read from its end in pieces."""
        ends = []
        for state, cost, rank in self.best:
            for n, at in enumerate(_insertions(state)):
                if at in (START, ASSISTANT):
                    ends.append((self.base + cost + n * INSERT, rank, "I" * n, state))
        cost, _, tail, state = min(ends)
        reverse, piece = [tail], 1 << 16
        for stop in range(self.rows, 0, -piece):
            start = max(0, stop - piece)
            self.trail.seek(4 * start)
            pointers = self.trail.read(4 * (stop - start))
            for at in range(len(pointers) - 4, -1, -4):
                p = pointers[at + state]
                reverse.append(_EDITS[p >> 4] + "I" * (p >> 2 & 3))
                state = p & 3
        return cost, "".join(reverse)[::-1]

    def repaired(self, edits: str) -> Iterator[tuple[str, str, str, int]]:
        """`(edit, role, text, fault)` of every turn that stays, in order."""
        self.spool.seek(0)
        state = START
        for edit in edits:
            kind, role, text = 0, "", ""
            if edit != "I":
                kind, head, body = struct.unpack("<BQQ", self.spool.read(17))
                role, text = self.spool.read(head).decode(), self.spool.read(body).decode()
                if edit == "D":
                    continue
            state = SYSTEM if edit == "K" and role[:1] == "s" else _AFTER[state]
            yield edit, role if edit == "K" else _ROLES[state], text, kind

    def close(self) -> None:
        self.trail.close()
        self.spool.close()


def _by_conversation(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """`(id, turn, role, text, seen)` dealt by conversation and sorted; `seen` numbers rows of equal role and text."""
    plain = rows.select(
        F.col(id).alias("id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")
    )
    dealt = plain.repartition(parallelism(rows.sparkSession), "id")
    same = Window.partitionBy("id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return dealt.withColumn("seen", F.row_number().over(same)).sortWithinPartitions("id", F.asc_nulls_first("turn"), "role", "text", "seen")


def _walk(rows: DataFrame, schema: str, finish: Callable[[Conversation], Iterator[tuple]], *columns: str) -> DataFrame:
    """One pass over the sorted rows; `finish` gives the output rows of a conversation that has ended."""
    ship_package(rows.sparkSession)
    dealt = _by_conversation(rows, *columns)
    out = f"{columns[0]} {dealt.schema['id'].dataType.simpleString()}, {schema}"
    names = [part.split()[0] for part in out.split(", ")]
    batch_type = to_arrow_type(dealt.schema["id"].dataType)

    def run(batches):
        held: list[tuple] = []
        size = 0
        now: Conversation | None = None
        types = [batch_type, *(_ARROW[part.split()[1]] for part in schema.split(", "))]

        def full() -> pa.RecordBatch:
            nonlocal held, size
            columns, held, size = list(zip(*held)), [], 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for row in finish(now):
                held.append((now.id, *row))
                size += sum(len(v) for v in row if isinstance(v, str))
                if len(held) >= OUT_ROWS or size >= SPOOL_BYTES:
                    yield full()
            now.close()

        for batch in batches:
            for part in slices(batch, 3):
                for conv, turn, role, text, seen in zip(*[c.to_pylist() for c in part.columns]):
                    if now is None or conv != now.id:
                        if now is not None:
                            yield from done()
                        now = Conversation(conv)
                    now.add(turn, role, text, seen > 1)
        if now is not None:
            yield from done()
        if held:
            yield full()

    return dealt.mapInArrow(run, out)


def audits(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: `gaps` between the turns, counts of faults, `illegal` neighbours, `cost`, `audit` and the digest of the repaired turns."""

    def finish(c: Conversation) -> Iterator[tuple]:
        cost, edits = c.edits()
        digest = hashlib.sha256()
        for i, (_, role, text, _) in enumerate(c.repaired(edits)):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        yield c.gaps, *c.counts[1:], c.illegal, cost, edits, digest.hexdigest()

    schema = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _walk(rows, schema, finish, id, turn, role, text)


def repaired_turns(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: `(id, place, edit, role, text, fault)`; places count from 0, the fault is null, `truncated` at most."""

    def finish(c: Conversation) -> Iterator[tuple]:
        for place, (edit, role, text, kind) in enumerate(c.repaired(c.edits()[1])):
            yield place, edit, role, text, FAULTS[kind]

    return _walk(rows, "place long, edit string, role string, text string, fault string", finish, id, turn, role, text)


def damaged(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with known damage, drawn by a checksum of `id:turn` (twenty sides): 0 drops the row, 1 empties its text,
    2 takes `.!?` out, 3 repeats the row, 4 makes it a user's.  Null roles and texts become one space."""
    spelled = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id, turn)])
    side = F.crc32(spelled) % 20
    said = F.coalesce(F.col(text), F.lit(" "))
    changed = F.when(side == 1, "").when(side == 2, F.translate(said, ".!?", "")).otherwise(said)
    whose = F.when(side == 4, "user").otherwise(F.coalesce(F.col(role), F.lit(" ")))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("_side") == 3, 2).otherwise(1)))
    kept = rows.select(F.col(id), F.col(turn), whose.alias(role), changed.alias(text), side.alias("_side")).where("_side <> 0")
    return kept.select(id, turn, role, text, copies.alias("_copy")).drop("_copy")
