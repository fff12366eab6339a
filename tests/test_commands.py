from __future__ import annotations

import random
from datetime import timedelta

import command_model
import pyarrow as pa
import pytest
from conftest import utc
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.operators import commands as C
from groundswell.plans import slices
from groundswell.sources.trail import StoredTrail

T0 = utc("2026-10-01 12:00:00")
FIELDS = ("kind", "robot_id", "command_id", "type", "flow_lpm", "actor", "ack_status", "ack_reason")


def request(seq, ms, kind, robot_id="unit-01", **rest):
    r = dict.fromkeys(FIELDS) | dict(seq=seq, at_ms=int(T0.timestamp() * 1000) + ms, kind=kind, robot_id=robot_id, ms=ms) | rest
    if kind in ("issue", "cancel") and r["actor"] is None:
        r["actor"] = "alice"
    return r


def log(spark, requests):
    rows = [
        (r["seq"], T0 + timedelta(milliseconds=r["ms"]), r["kind"], r["robot_id"], r["command_id"], r["type"],
         None if r["flow_lpm"] is None else (r["flow_lpm"],), r["actor"], r["ack_status"], r["ack_reason"])
        for r in requests
    ]
    return spark.createDataFrame(rows, S.COMMAND_REQUESTS)


def replay(spark, requests):
    out = C.replay_commands(log(spark, requests).repartition(3))
    audit = out.audit.selectExpr("unix_millis(at)", "command_id", "robot_id", "from_status", "to_status", "actor", "reason", "order_seq").collect()
    return [tuple(r) for r in audit], {r.seq: r.code for r in out.errors.collect()}, out


def script(*steps):
    """(ms, kind, rest) steps with numbered requests."""
    return [request(i, ms, kind, **rest) for i, (ms, kind, rest) in enumerate(steps)]


def issue(ms, name, type="pause", **rest):  # noqa: A002
    return ms, "issue", dict(command_id=name, type=type, **rest)


def ack(ms, name, status="completed", reason=None):
    return ms, "ack", dict(command_id=name, ack_status=status, ack_reason=reason)


SCRIPTS = {
    "fifo": script(issue(0, "a"), issue(1, "b", "set_flow", flow_lpm=90.0), (1, "next", {}), ack(1, "a"), (1, "next", {}),
                   ack(1, "b", "rejected", "pump offline"), (1, "next", {})),
    "isolated": script(issue(0, "a"), (0, "next", dict(robot_id="unit-02"))),
    "estop": script(issue(0, "a"), issue(0, "b", "set_flow", flow_lpm=100.0), issue(5, "c", "estop", actor="bob"), (5, "next", {})),
    "full": script(*[issue(0, f"p{i}") for i in range(21)], issue(0, "stop", "estop")),
    "ttl": script(issue(0, "a"), (0, "issue", dict(command_id="s", type="estop", robot_id="unit-02")), (120_001, "next", {}),
                  (120_001, "next", dict(robot_id="unit-02"))),
    "ttl edge": script(issue(0, "a"), (120_000, "next", {})),
    "unanswered": script(issue(0, "a", "resume"), (0, "next", {}), ack(30_001, "a")),
    "answered in time": script(issue(0, "a", "resume"), (0, "next", {}), ack(30_000, "a")),
    "params": script(issue(0, "a", "set_flow"), issue(0, "b", "set_flow", flow_lpm=0.0), issue(0, "c", "set_flow", flow_lpm=251.0),
                     issue(0, "d", flow_lpm=10.0)),
    "cancel": script(issue(0, "a"), (0, "next", {}), (0, "cancel", dict(command_id="a")), (0, "cancel", dict(command_id="zz"))),
    "stop waits": script(issue(0, "s", "estop"), issue(400_000, "a"), issue(400_001, "t", "estop"), (900_000, "next", {}), ack(900_001, "t"),
                         issue(2_000_000, "b"), (2_000_001, "next", {}), ack(2_000_002, "s"), ack(2_000_003, "b")),
    "late ack": script(issue(0, "a"), issue(1, "bad", "set_flow"), (9, "next", {}), issue(500_000, "b"), ack(500_001, "a"), ack(500_002, "bad")),
    "cross robot": script(issue(0, "a"), (1, "next", {}), (2, "ack", dict(command_id="a", robot_id="unit-09", ack_status="completed"))),
}


def test_scripts(spark):
    """All scripts as robots of their own in one log, an hour apart, so one replay covers them."""
    requests = []
    for n, (_name, steps) in enumerate(SCRIPTS.items()):
        for r in steps:
            named = r["command_id"] and f"{n}-{r['command_id']}"
            requests.append(request(len(requests), n * 3_600_000 + r["ms"], **{k: r[k] for k in FIELDS if k not in ("robot_id", "command_id", "kind")},
                                    kind=r["kind"], robot_id=f"{n}-{r['robot_id']}", command_id=named))
    audit, errors, out = replay(spark, requests)
    want_audit, want_errors = command_model.run(requests)
    assert sorted(audit, key=str) == sorted(want_audit, key=str)
    assert errors == want_errors

    state = {r.command_id: r for r in C.audit_current_state(out.audit).collect()}
    index = {name: n for n, name in enumerate(SCRIPTS)}

    def status(name, command):
        return state[f"{index[name]}-{command}"].status

    assert (status("fifo", "a"), status("fifo", "b")) == ("completed", "rejected")
    assert state[f"{index['fifo']}-b"].reason == "pump offline"
    assert [status("estop", c) for c in "abc"] == ["cancelled", "cancelled", "sent"] or status("estop", "c") == "expired"
    assert status("full", "stop") == "queued" and 429 in errors.values()
    assert (status("ttl", "a"), status("unanswered", "a"), status("answered in time", "a")) == ("expired", "expired", "completed")
    assert status("cross robot", "a") == "completed"


def random_log(seed, n=900):
    """Bursts and silences, robots that never poll, polls without work, late and wrong acks."""
    rng = random.Random(seed)
    ms, out, issued = 0, [], []
    for seq in range(n):
        ms += rng.choice([0, 1, 200, 2000, 2000, 9000, 31_000, 125_000, 200_000 if rng.random() < 0.3 else 500])
        robot = rng.choice(["hot", "hot", "hot", "a", "b", "silent"])
        kind = rng.choices(["issue", "next", "ack", "cancel", "list"], [40, 30 if robot != "silent" else 0, 20, 8, 2])[0]
        rest = {}
        if kind == "issue":
            kinds = ["pause", "resume", "clear_fault", "set_flow"] + ["estop"] * (rng.random() < 0.6)
            rest = dict(command_id=f"c{seq}", type=rng.choice(kinds), actor=f"op{seq % 3}")
            if rest["type"] == "set_flow":
                rest["flow_lpm"] = rng.choice([90.0, 250.0, 0.0, 300.0])
            issued.append(f"c{seq}")
        elif kind in ("ack", "cancel"):
            rest = dict(command_id=rng.choice([None, "nope", *issued[-1:], *issued[-2:-1], *issued[-40:][:1]]), actor="op")
            if kind == "ack":
                rest |= dict(ack_status=rng.choice(["completed", "rejected"]), ack_reason=rng.choice([None, "", "pump offline"]), actor=None)
        out.append(request(seq, ms, kind, robot, **rest))
    return out


@pytest.mark.parametrize("seed,segment", [(11, None), (12, None), (13, None), (11, 7), (13, 3), (14, 40)])
def test_replay_equals_the_sequential_service(spark, monkeypatch, seed, segment):
    """Wherever the log is cut, also inside a stretch that never pauses."""
    if seed == 12:
        monkeypatch.setattr(slices, "PIECE_ROWS", 3)
    if segment:
        monkeypatch.setattr(C, "SEGMENT_ROWS", segment)
    requests = random_log(seed)
    if seed == 13:  # a burst without polls reaches the pending limit
        end = requests[-1]["ms"]
        requests += [request(900 + i, end + 10 * i, "issue", "hot", command_id=f"x{i}", type="pause") for i in range(60)]
    audit, errors, _ = replay(spark, requests)
    want_audit, want_errors = command_model.run([{**r, "ack_reason": r["ack_reason"] or None} for r in requests])
    assert sorted(audit, key=str) == sorted(want_audit, key=str)
    assert errors == want_errors
    assert seed != 13 or 429 in errors.values()


def test_door_check_does_not_sweep(spark):
    requests = [
        request(0, 0, "issue", command_id="a", type="pause"),
        request(1, 121_000, "issue", "unit-02", command_id="b", type="explode"),
        request(2, 121_500, "ack", "unit-02", command_id="a", ack_status="maybe"),
        request(3, 122_000, "list", "unit-02"),
    ]
    audit, errors, _ = replay(spark, requests)
    assert errors == {1: 400, 2: 400}
    assert [(a[4], a[7]) for a in sorted(audit, key=lambda a: a[7])] == [("queued", 0), ("expired", 3)]


def test_views(spark):
    requests = script(
        issue(0, "a"), issue(1, "b", "set_flow", flow_lpm=90.0), issue(2, "c"), (3, "next", {}), ack(1500, "a"),
        (2000, "next", dict(robot_id="unit-07")), (2100, "issue", dict(command_id="d", type="estop", robot_id="unit-08")),
    )
    df = log(spark, requests)
    out = C.replay_commands(df)
    table = C.commands_table(out.audit, df)
    assert [r.command_id for r in C.list_commands(table, limit=2).collect()] == ["d", "c"]
    assert [r.command_id for r in C.list_commands(table, robot_id="unit-01", status="queued").collect()] == ["c", "b"]
    assert {(r.robot_id, r.command_id) for r in C.next_command(table).collect()} == {("unit-01", "b"), ("unit-08", "d")}
    assert {r.robot_id: r.pending for r in C.pending_per_robot(table).collect()} == {"unit-01": 2, "unit-08": 1}
    links = {r.robot_id: (r.last_poll_at is None, r.pending) for r in C.robot_links(df, table).collect()}
    assert links == {"unit-01": (False, 2), "unit-07": (False, 0), "unit-08": (True, 1)}
    assert {r.command for r in C.command_log_view(table).collect()} == {"pause", "set_flow 90 L/min", "estop"}
    waits = {r.command_id: (r.queue_s, r.ack_s) for r in C.command_latency(out.audit).collect()}
    assert waits["a"] == (0.003, 1.497) and waits["b"] == (None, None)
    assert C.get_command(table, "nope").count() == 0
    trail = [(r.from_status, r.to_status, r.actor) for r in C.audit_log(out.audit).collect()][::-1]
    assert trail[-3:] == [("queued", "sent", "robot:unit-01"), ("sent", "completed", "robot:unit-01"), (None, "queued", "alice")]
    with pytest.raises(ValueError):
        C.list_commands(table, status="lost")


def test_stored_trail_follows_the_log(spark, tmp_path, monkeypatch):
    requests = random_log(17, 300)
    path = str(tmp_path / "trail")
    with pytest.raises(FileNotFoundError):
        StoredTrail(spark, path).audit
    first = StoredTrail(spark, path).refresh(log(spark, requests[:200]))
    want = C.replay_commands(log(spark, requests[:200]))
    assert sorted(map(tuple, first.audit.collect()), key=str) == sorted(map(tuple, want.audit.collect()), key=str)
    with monkeypatch.context() as m:  # the same log again: nothing is replayed
        m.setattr(C, "replay_commands", None)
        StoredTrail(spark, path).refresh(log(spark, requests[:200]))

    def broken(*_):
        raise OSError("no space")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(C, "commands_table", broken)
        StoredTrail(spark, path).refresh(log(spark, requests))
    assert first.audit.count() == want.audit.count(), "a replay that fails leaves the old generation"
    grown = StoredTrail(spark, path).refresh(log(spark, requests))
    want = C.replay_commands(log(spark, requests))
    assert sorted(map(tuple, grown.audit.collect()), key=str) == sorted(map(tuple, want.audit.collect()), key=str)
    assert sorted(map(tuple, grown.errors.collect())) == sorted(map(tuple, want.errors.collect()))
    df = log(spark, requests)
    table = C.commands_table(want.audit, df)
    assert sorted(map(tuple, C.robot_links(grown.polls, grown.commands).collect())) == sorted(map(tuple, C.robot_links(df, table).collect()))
    assert sorted(map(tuple, grown.commands.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)
    assert "PushedFilters: [IsNotNull(command_id), EqualTo(command_id,c3)]" in C.get_command(grown.commands, "c3")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("slice_s,group_s", [(3600, 86_400), (1, 4), (2, 2)])
def test_first_mark_after_a_point(spark, slice_s, group_s):
    """Gaps of many days, marks before 1970, equal times and points behind the last mark."""
    rng = random.Random(group_s)
    span = [rng.choice([rng.randrange(-9000, 9000), rng.randrange(0, 4_000_000), rng.randrange(10**10, 10**10 + 5000)]) for _ in range(400)]
    points, marks = span[:200] + [10**12], span[200:] + span[:20]
    at = F.timestamp_millis(F.col("ms"))
    p = spark.createDataFrame([(m,) for m in points], "ms long").select(at.alias("at"))
    m = spark.createDataFrame([(v, i) for i, v in enumerate(marks)], "ms long, seq long").select(at.alias("at"), "seq")
    out = slices.first_after(p, m, slice_s, group_s)
    got = {(a, b, c) for a, b, c in out.select(F.unix_millis("at"), F.unix_millis("mark_at"), "mark_seq").collect()}
    want = set()
    for v in points:
        later = min(((k, i) for i, k in enumerate(marks) if k > v), default=None)
        if later:
            want.add((v, *later))
    assert got == want
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("partition" in line or ", [" in line for line in text.splitlines() if "Window" in line and "windowspec" in line)


def test_a_parameter_given_as_null_is_given(spark):
    df = log(spark, [request(0, 0, "issue", command_id="a", type="pause"), request(1, 0, "issue", command_id="b", type="set_flow")])
    given = df.withColumn("params", F.struct(F.lit(None).cast("double").alias("flow_lpm")))
    errors = [r.param_error for r in C.valid_command_params(given).orderBy("seq").collect()]
    assert errors[0] == "pause takes no params" and errors[1].startswith("set_flow requires")
    assert C.valid_command_params(df).where("seq = 0").first().param_error is None


def test_segments_of_a_partition_share_a_fold():
    """A call of Python for each short segment is what took the time; nothing that is open crosses from one to the next."""
    fields = [f.name for f in C._MOVES_ARROW if f.name in ("robot_id", "episode", "segment", "created", "sent")]
    steps = [("a", 1, "issue", "c1"), ("a", 2, "issue", "c2"), ("b", 1, "next", None), ("b", 3, "issue", "c3")]
    rows = [
        dict.fromkeys(fields) | dict.fromkeys(C.Request._fields) | dict(robot_id=r, episode=1, segment=0, seq=i, at_ms=at, kind=k, command_id=c, type="pause")
        for i, (r, at, k, c) in enumerate(steps)
    ]
    batch = pa.RecordBatch.from_pylist(rows)
    moves = [m for out in C._fold(iter([batch.slice(0, 1), batch.slice(1)])) for m in out.to_pylist()]
    assert [(m["robot_id"], m["command_id"], m["to_status"], m["phase"]) for m in moves] == [
        ("a", "c1", "queued", 1), ("a", "c2", "queued", 1), ("a", "c1", "expired", C._EXIT), ("a", "c2", "expired", C._EXIT),
        ("b", "c3", "queued", 1), ("b", "c3", "expired", C._EXIT),
    ]


def test_a_refresh_reads_one_stored_copy_of_the_log(spark, tmp_path, monkeypatch):
    """The log is a view that costs several shuffles; the replay, the flows and the polls must not each derive it again."""
    seen = []
    real = C.commands_table
    monkeypatch.setattr(C, "commands_table", lambda audit, requests: seen.append(requests) or real(audit, requests))
    df = log(spark, random_log(18, 40))
    assert not df.inputFiles()
    StoredTrail(spark, str(tmp_path / "trail")).refresh(df)
    assert seen[0].inputFiles() and seen[0].count() == 40
