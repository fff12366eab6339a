"""A plain, sequential model of the whole command service, for comparison with the Spark replay."""

from __future__ import annotations

TERMINAL = {"completed", "rejected", "cancelled", "expired"}


def run(requests):
    """Requests as dicts in order; returns (audit, errors)."""
    commands, audit, errors = {}, [], {}

    def move(c, to, actor, reason, r):
        audit.append((r["at_ms"], c["id"], c["robot"], c["status"], to, actor, reason, r["seq"]))
        c["status"] = to

    for r in requests:
        now = r["at_ms"]
        for c in commands.values():
            if c["status"] == "queued" and c["type"] != "estop" and now - c["created"] > 120_000:
                move(c, "expired", "system", "not picked up before TTL", r)
            elif c["status"] == "sent" and now - c["sent"] > 30_000:
                move(c, "expired", "system", "robot did not acknowledge", r)
        mine = [c for c in commands.values() if c["robot"] == r["robot_id"]]
        if r["kind"] == "issue":
            flow = r["flow_lpm"]
            ok = flow is not None and 0 < flow <= 250 if r["type"] == "set_flow" else flow is None
            if not ok:
                errors[r["seq"]] = 400
                continue
            if r["type"] == "estop":
                for c in mine:
                    if c["status"] == "queued":
                        move(c, "cancelled", r["actor"], "superseded by estop", r)
            elif sum(c["status"] not in TERMINAL for c in mine) >= 20:
                errors[r["seq"]] = 429
                continue
            c = dict(id=r["command_id"], robot=r["robot_id"], type=r["type"], status=None, created=now)
            commands[c["id"]] = c
            move(c, "queued", r["actor"], None, r)
        elif r["kind"] == "next":
            queued = [c for c in mine if c["status"] == "queued"]
            stops = [c for c in queued if c["type"] == "estop"]
            for c in (stops or queued)[:1]:
                c["sent"] = now
                move(c, "sent", "robot:" + r["robot_id"], None, r)
        elif r["kind"] in ("ack", "cancel"):
            c = commands.get(r["command_id"])
            if c is None:
                errors[r["seq"]] = 404
            elif c["status"] != ("sent" if r["kind"] == "ack" else "queued"):
                errors[r["seq"]] = 409
            elif r["kind"] == "ack":
                move(c, r["ack_status"], "robot:" + c["robot"], r["ack_reason"], r)
            else:
                move(c, "cancelled", r["actor"], "cancelled by operator", r)
    return audit, errors
