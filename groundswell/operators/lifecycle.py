"""The rules of one robot's command queue, as a step over plain values.

Both the batch replay and the stream feed requests through `advance`; Spark does
the partitioning, the ordering and the state keeping around it.
"""

from __future__ import annotations

from typing import NamedTuple

from groundswell import schema as S


class Request(NamedTuple):
    seq: int
    at_ms: int
    kind: str
    command_id: str | None
    type: str | None
    param_error: str | None
    actor: str | None
    ack_status: str | None
    ack_reason: str | None


class Open(NamedTuple):
    """A command that is not finished yet."""

    id: str
    type: str
    seq: int
    created: int
    sent: int | None = None

    @property
    def deadline(self) -> int | None:
        if self.sent is not None:
            return self.sent + S.ACK_TIMEOUT_MS
        return None if self.type == "estop" else self.created + S.QUEUE_TTL_MS


class Move(NamedTuple):
    """One transition; `due` is set instead of a time when a deadline passed."""

    command: Open
    before: str | None
    after: str
    actor: str
    reason: str | None = None
    due: int | None = None


def expiry(c: Open) -> Move:
    if c.sent is None:
        return Move(c, "queued", "expired", "system", "not picked up before TTL", c.deadline)
    return Move(c, "sent", "expired", "system", "robot did not acknowledge", c.deadline)


def advance(pending: list[Open], r: Request, robot_id: str) -> tuple[list[Open], list[Move], int | None]:
    """Apply request `r` to the open commands; returns what stays open, the moves and an error code.

    A missing target gives 409; the caller knows whether the command ever existed.
    """
    overdue = [c for c in pending if c.deadline is not None and c.deadline < r.at_ms]
    moves = [expiry(c) for c in overdue]
    pending = [c for c in pending if c not in overdue]
    target = next((c for c in pending if c.id == r.command_id), None)

    if r.kind == "issue":
        if r.param_error:
            return pending, moves, 400
        if r.type == "estop":
            moves += [Move(c, "queued", "cancelled", r.actor, "superseded by estop") for c in pending if c.sent is None]
            pending = [c for c in pending if c.sent is not None]
        elif len(pending) >= S.MAX_PENDING:
            return pending, moves, 429
        new = Open(r.command_id, r.type, r.seq, r.at_ms)
        return [*pending, new], [*moves, Move(new, None, "queued", r.actor)], None

    if r.kind == "next":
        waiting = sorted((c for c in pending if c.sent is None), key=lambda c: (c.type != "estop", c.created, c.seq))
        if not waiting:
            return pending, moves, None
        chosen = waiting[0]
        pending = [c._replace(sent=r.at_ms) if c is chosen else c for c in pending]
        return pending, [*moves, Move(chosen, "queued", "sent", f"robot:{robot_id}")], None

    if r.kind in ("ack", "cancel"):
        acking = r.kind == "ack"
        if target is None or (target.sent is None) == acking:
            return pending, moves, 409
        rest = [c for c in pending if c is not target]
        if acking:
            move = Move(target, "sent", r.ack_status, f"robot:{robot_id}", r.ack_reason or None)
        else:
            move = Move(target, "queued", "cancelled", r.actor, "cancelled by operator")
        return rest, [*moves, move], None

    return pending, moves, None
