from __future__ import annotations

import random
import shutil
import tracemalloc
from datetime import timedelta

import command_model
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SMALL, utc
from pyspark.sql import functions as F
from test_commands import log, random_log
from test_timeseries import frame, per_robot, random_rows

from groundswell.operators import ingest
from groundswell.operators import timeseries as ts
from groundswell.plans.shared import store
from groundswell.sources import adapters as A
from groundswell.sources import batches as B
from groundswell.sources import tables
from groundswell.streaming import arrival, sinks, stateful
from groundswell.streaming import commands as sc
from groundswell.streaming import telemetry as st


def files(spark, df, path, parts):
    """Write in `parts` files, one after another, so that the stream takes several batches."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def chunks(spark, rows, n):
    size = -(-len(rows) // n)
    return [frame(spark, rows[i : i + size]) for i in range(0, len(rows), size)]


@pytest.fixture(scope="module")
def rows():
    return sorted(random_rows(21, 400), key=lambda r: r["ts"])


def test_latest_over_batches_with_late_rows(spark, tmp_path, rows):
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    df = frame(spark, shuffled)
    stream = st.stream_latest(files(spark, df, str(tmp_path / "in"), chunks(spark, shuffled, 4)))
    path, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    sinks.run_epochs(stream, sinks.epoch_writer(path), checkpoint)
    epochs = sinks.read_epochs(spark, path, stream.schema)
    assert epochs.select("epoch").distinct().count() >= 4
    got = sinks.newest(epochs, ["site_id", "robot_id"])
    want = ts.latest_per_robot(df)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_merged_epochs_are_all_a_reader_needs(spark, tmp_path):
    """A merge when the epochs hold as many rows as the last one, a retried epoch, and readers that skip what is merged."""
    path = str(tmp_path / "out")
    write = sinks.merging_writer(path, ["k"], least_rows=6)
    schema = "k long, v long"
    truth, rng = {}, random.Random(4)
    for epoch in range(12):
        rows = {rng.randrange(10): 100 * epoch + i for i in range(3)}
        batch = spark.createDataFrame(list(rows.items()), schema)
        truth |= rows
        write(batch, epoch)
        if epoch % 5 == 4:
            write(batch, epoch)  # a retry
        got = sinks.read_merged(spark, path, batch.schema, ["k"])
        assert {r.k: r.v for r in got.collect()} == truth
    merges = sorted(p.name for p in (tmp_path / "out" / "_merges").glob("merge-*"))
    assert 2 <= len(merges) < 6
    shutil.rmtree(tmp_path / "out" / "epoch=0")  # behind the last merge: nobody looks there any more
    assert {r.k: r.v for r in sinks.read_merged(spark, path, batch.schema, ["k"]).collect()} == truth


def test_fleet_state_over_batches(spark, tmp_path, rows):
    """Rows may come out of order inside the delay; the settled litres do not notice."""
    swapped = rows[:]
    for i in range(0, len(swapped) - 1, 2):
        if swapped[i + 1]["ts"] - swapped[i]["ts"] < timedelta(minutes=10):
            swapped[i], swapped[i + 1] = swapped[i + 1], swapped[i]
    df = frame(spark, swapped)
    spark = stateful.stateful_session(spark)
    stream = stateful.stream_fleet_state(files(spark, df, str(tmp_path / "in"), chunks(spark, swapped, 4)))
    path = str(tmp_path / "out")
    sinks.run_epochs(stream, sinks.epoch_writer(path), str(tmp_path / "cp"))
    got = {r.robot_id: r for r in sinks.newest(sinks.read_epochs(spark, path, stream.schema), ["site_id", "robot_id"]).collect()}
    settled = max(r["ts"] for r in rows) - timedelta(minutes=10)
    for robot, group in per_robot(rows):
        r = got[robot]
        assert r.latest_seq == group[-1]["seq"]
        assert [h.seq for h in r.history] == [g["seq"] for g in group[-120:]]
        done = [g for g in group if g["ts"] <= settled]
        litres = sum(
            (a["flow_rate_lpm"] + b["flow_rate_lpm"]) / 2 * (b["ts"] - a["ts"]).total_seconds() / 60 for a, b in zip(done, done[1:], strict=False)
        )
        assert r.volume_l == pytest.approx(litres)


def test_buckets_close_behind_the_watermark(spark, tmp_path, rows):
    df = frame(spark, rows)
    stream = stateful.stream_buckets(files(stateful.stateful_session(spark), df, str(tmp_path / "in"), chunks(spark, rows, 3)), 3600)
    sinks.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < got.agg({"count": "sum"}).first()[0] <= len(rows)
    assert got.groupBy("robot_id", "bucket").count().where("count > 1").count() == 0
    end = max(r["ts"] for r in rows) - timedelta(minutes=10)
    series = ts.robot_series(df, rows[0]["ts"] - timedelta(days=1), end + timedelta(days=1), 3600)
    closed = {(r.robot_id, r.bucket): r for r in series.collect() if r.bucket.replace(tzinfo=end.tzinfo) + timedelta(hours=1) <= end}
    assert {(r.robot_id, r.bucket) for r in got.collect()} == set(closed)
    for r in got.collect():
        want = closed[r.robot_id, r.bucket]
        assert r["count"] == want["count"] and r.max_uplift_mm == want.max_uplift_mm and r.max_pressure_kpa == want.max_pressure_kpa
        assert r.volume_injected_l == pytest.approx(want.volume_injected_l) and r.avg_flow_lpm == pytest.approx(want.avg_flow_lpm)


@pytest.mark.parametrize("seed", [31, 32])
def test_commands_over_batches(spark, tmp_path, seed):
    """Final statuses equal the sequential service, whatever the batches."""
    requests = [r for r in random_log(seed, 500)]
    for r in requests:  # an ack or cancel names its command only
        if r["kind"] in ("ack", "cancel"):
            r["robot_id"] = None
    closing = {**requests[-1], "seq": 10_000, "kind": "list", "command_id": None, "type": None, "flow_lpm": None}
    closing["ms"] += 1_000_000
    closing["at_ms"] += 1_000_000
    requests.append(closing)
    df = log(spark, requests)
    spark = stateful.stateful_session(spark)
    parts = [log(spark, requests[i : i + 130]) for i in range(0, len(requests), 130)]
    stream = sc.stream_commands(files(spark, df, str(tmp_path / "in"), parts), "0 seconds")
    sinks.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    trail = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    got = {r.command_id: r["count"] for r in trail.groupBy("command_id").count().collect()}
    audit, _ = command_model.run([{**r, "ack_reason": r["ack_reason"] or None} for r in requests])
    want_moves, want_status = {}, {}
    for a in audit:
        want_moves[a[1]] = want_moves.get(a[1], 0) + 1
        want_status[a[1]] = a[4]
    assert got == want_moves
    last = trail.groupBy("command_id").agg({"step": "max"}).withColumnRenamed("max(step)", "step").join(trail, ["command_id", "step"])
    assert {r.command_id: r.to_status for r in last.collect()} == want_status


@pytest.mark.parametrize("keep_days", [7.0, None])
def test_fleet_state_loses_no_late_row(spark, tmp_path, keep_days):
    """Rows behind the watermark split segments that were already integrated; times may be equal."""
    start = utc("2026-01-01 00:00:00")
    minutes = [60, 120, 0, 180, 61, 61, 90, 200, 30, 119, 240, 1, 239, 300]
    rows = [dict(ts=start + timedelta(minutes=m), robot_id=f"r{i % 2 if i > 3 else 0}", flow_rate_lpm=float(7 * i % 11 + 1)) for i, m in enumerate(minutes)]
    spark = stateful.stateful_session(spark)
    df = frame(spark, rows)
    parts = [df.where(F.col("seq") == i) for i in range(len(rows))]
    stream = stateful.stream_fleet_state(files(spark, df, str(tmp_path / "in"), parts), keep_days=keep_days)
    sinks.run_epochs(stream, sinks.epoch_writer(str(tmp_path / "out")), str(tmp_path / "cp"))
    epochs = sinks.read_epochs(spark, str(tmp_path / "out"), stream.schema)
    assert epochs.select("epoch").distinct().count() >= len(rows)
    got = {r.robot_id: r for r in sinks.newest(epochs, ["site_id", "robot_id"]).collect()}
    settled = start + timedelta(minutes=290)
    for robot, group in per_robot(df.collect()):
        r = got[robot]
        assert r.unplaced == 0 and [h.seq for h in r.history] == [g["seq"] for g in group] and r.latest_seq == group[-1]["seq"]
        done = [g for g in group if g["ts"].replace(tzinfo=settled.tzinfo) <= settled]
        want = sum((a["flow_rate_lpm"] + b["flow_rate_lpm"]) / 2 * (b["ts"] - a["ts"]).total_seconds() / 60 for a, b in zip(done, done[1:], strict=False))
        assert r.volume_l == pytest.approx(want)


def test_rows_older_than_what_is_kept_are_counted(spark, tmp_path):
    start = utc("2026-01-01 00:00:00")
    rows = [dict(ts=start + timedelta(hours=h)) for h in (0, 30, 60, 90, 1, 91)]
    spark = stateful.stateful_session(spark)
    df = frame(spark, rows)
    stream = stateful.stream_fleet_state(files(spark, df, str(tmp_path / "in"), [df.where(F.col("seq") == i) for i in range(6)]), keep_days=1.0)
    sinks.run_epochs(stream, sinks.epoch_writer(str(tmp_path / "out")), str(tmp_path / "cp"))
    got = sinks.newest(sinks.read_epochs(spark, str(tmp_path / "out"), stream.schema), ["site_id", "robot_id"]).collect()
    assert [(r.unplaced, len(r.history)) for r in got] == [(1, 6)]


def test_ingest_equals_batch(spark, tmp_path):
    uploads = A.sample_batches(spark, SMALL).select("batch_id", "body", "received_at")
    source = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 2).parquet(store(uploads, "uploads"))
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    st.stream_ingest(source, good, bad, str(tmp_path / "cp"))
    first = spark.read.parquet(good).count(), spark.read.parquet(bad).count()
    st.stream_ingest(source, good, bad, str(tmp_path / "cp"))  # nothing new: nothing is written twice
    assert (spark.read.parquet(good).count(), spark.read.parquet(bad).count()) == first
    st.stream_ingest(source, good, bad, str(tmp_path / "cp2"))  # a replay from the start overwrites its epochs
    assert (spark.read.parquet(good).count(), spark.read.parquet(bad).count()) == first


def test_ingested_table_is_a_telemetry_table(spark, tmp_path):
    uploads = A.sample_batches(spark, SMALL).select("batch_id", "body", "received_at")
    source = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 1).parquet(store(uploads.repartition(3), "uploads"))
    good = str(tmp_path / "good")
    st.stream_ingest(source, good, str(tmp_path / "bad"), str(tmp_path / "cp"))
    table = tables.read_telemetry(spark, good)
    assert table.columns == [*tables.COLUMNS, "ts_date"]
    n = table.count()
    assert n > 0 and table.select("seq").distinct().count() == n
    want = ingest.accepted_samples(B.parse_batches(uploads), A.now()).select(*[c for c in tables.COLUMNS if c != "seq"])
    assert sorted(map(tuple, table.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_requests_behind_the_watermark_are_applied(spark, tmp_path):
    """Three batches: another robot runs ahead, then an e-stop from before that, then a poll."""
    blank = dict.fromkeys(("command_id", "type", "flow_lpm", "actor", "ack_status", "ack_reason"))
    start = 1_767_225_600_000

    def request(seq, s, kind, robot_id, **more):
        return {**blank, "seq": seq, "ms": start + s * 1000, "at_ms": start + s * 1000, "kind": kind, "robot_id": robot_id, **more}

    requests = [
        request(1, 0, "issue", "a", command_id="c1", type="pause", actor="op"),
        request(2, 61, "next", "b"),
        request(3, 50, "issue", "a", command_id="c2", type="estop", actor="op"),
        request(4, 50, "list", "b"),
        request(5, 62, "next", "a"),
    ]
    spark = stateful.stateful_session(spark)
    df = log(spark, requests)
    stream = sc.stream_commands(files(spark, df, str(tmp_path / "in"), [log(spark, requests[i : i + 2]) for i in (0, 2, 4)]), "0 seconds")
    sinks.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    trail = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).orderBy("step").collect()
    assert [(r.command_id, r.to_status) for r in trail if r.robot_id == "a" and r.to_status != "expired"] == [
        ("c1", "queued"), ("c1", "cancelled"), ("c2", "queued"), ("c2", "sent")
    ]


class _Entries(dict):
    """A map state in memory."""

    exists = dict.__len__
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__


def test_router_takes_many_commands_in_one_call():
    """A call of Python for each command id is what took the time; ids share one, keep the robot of their first issue and are written once."""
    router, entries = sc.CommandRouter(), _Entries()
    router.init(type("Handle", (), {"getMapState": lambda self, *_: entries})())

    def call(*requests):
        rows = [dict.fromkeys(sc._STEP_NAMES) | dict(zip(("seq", "kind", "command_id", "robot_id"), r, strict=True)) for r in requests]
        out = list(router.handleInputRows((0,), iter([pd.DataFrame(rows)]), None))
        assert len(out) == 1
        return [(int(s), c, r) for s, c, r in zip(out[0]["seq"], out[0]["command_id"], out[0]["robot_id"], strict=True)]

    first = call((3, "ack", "c1", None), (1, "issue", "c1", "a"), (2, "issue", "c2", "b"), (0, "cancel", "c2", None), (4, "issue", "c1", "b"))
    assert first == [(1, "c1", "a"), (2, "c2", "b"), (3, "c1", "a"), (4, "c1", "b")]
    assert call((5, "ack", "c1", None), (6, "ack", "c9", None), (7, "ack", "c2", "x")) == [(5, "c1", "a"), (7, "c2", "b")]
    assert call((8, "issue", "c3", None), (9, "issue", "c3", "d"), (10, "ack", "c3", None)) == [(9, "c3", "d"), (10, "c3", "d")]
    assert entries == {("c1",): ("a",), ("c2",): ("b",), ("c3",): ("d",)}


class _Value:
    """A value or list state in memory that counts the rows it is asked for."""

    def __init__(self):
        self.rows, self.read = [], 0

    def exists(self):
        return bool(self.rows)

    def update(self, row):
        self.rows = [row]

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Single(_Value):
    def get(self):
        return self.rows[0]


class _List(_Value):
    def get(self):
        self.read += len(self.rows)
        return iter(self.rows)


def test_waiting_rows_are_read_once():
    """Rows that wait are neither read at each trigger nor again for their earliest; what is due at once never waits."""
    timed, waiting = stateful.BucketFold(1, 0), _List()
    timed.init(type("Handle", (), {"getListState": lambda self, *_: waiting, "getValueState": lambda self, *_: _Single()})())
    row = lambda ts, seq: (ts, seq, 1.0, 2.0, 0.0)
    assert timed.next_waiting() is None
    assert timed.hold([row(30, 1), row(20, 2)], 10) == [] and timed.next_waiting() == 20
    assert timed.hold([row(15, 3), row(40, 4), row(12, 5)], 15) == [row(12, 5), row(15, 3)] and timed.next_waiting() == 20
    assert waiting.read == 0
    assert timed.hold([row(20, 0), row(50, 6)], 30) == [row(20, 0), row(20, 2), row(30, 1)] and timed.next_waiting() == 40
    assert waiting.read == 3
    assert timed.hold([], 50) == [row(40, 4), row(50, 6)] and timed.next_waiting() is None and not waiting.exists()
    assert waiting.read == 5


def test_late_rows_join_the_piece_they_fall_into(spark, tmp_path):
    """Several late rows in one piece of five minutes find each other and what was there."""
    start = utc("2026-01-01 00:00:00")
    seconds = [0, 60, 180, 290, 1200, 2400, 120, 90, 91]
    rows = [dict(ts=start + timedelta(seconds=s), flow_rate_lpm=float(7 * i % 11 + 1)) for i, s in enumerate(seconds)]
    spark = stateful.stateful_session(spark)
    df = frame(spark, rows)
    parts = [df.where("seq < 6"), df.where("seq = 6"), df.where("seq > 6")]
    stream = stateful.stream_fleet_state(files(spark, df, str(tmp_path / "in"), parts))
    sinks.run_epochs(stream, sinks.epoch_writer(str(tmp_path / "out")), str(tmp_path / "cp"))
    (got,) = sinks.newest(sinks.read_epochs(spark, str(tmp_path / "out"), stream.schema), ["site_id", "robot_id"]).collect()
    done = [r for r in sorted(rows, key=lambda r: r["ts"]) if r["ts"] <= start + timedelta(seconds=1800)]
    want = sum((a["flow_rate_lpm"] + b["flow_rate_lpm"]) / 2 * (b["ts"] - a["ts"]).total_seconds() / 60 for a, b in zip(done, done[1:], strict=False))
    assert got.unplaced == 0 and got.volume_l == pytest.approx(want)


@pytest.mark.parametrize("keys", [10, 100_000])
def test_rows_of_a_key_are_merged_by_arrival(monkeypatch, keys):
    """Runs over several levels, with repeated numbers, nulls and a short last run; equal numbers stay in the order they come in."""
    monkeypatch.setattr(arrival, "RUN_ROWS", 50)
    monkeypatch.setattr(arrival, "BLOCK_ROWS", 8)
    monkeypatch.setattr(arrival, "FAN_IN", 3)
    rng = random.Random(keys)
    schema = arrival.arrow_schema("seq long, name string")
    for n in (0, 1, 49, 50, 51, 120, 2003):
        rows = [(rng.randrange(keys) if rng.random() < 0.99 else None, None if i % 7 == 0 else f"{i}é") for i in range(n)]
        frames = (pd.DataFrame({"name": [r[1] for r in rows[i : i + 13]], "seq": pd.Series([r[0] for r in rows[i : i + 13]], dtype=object)}) for i in range(0, n, 13))
        got = [tuple(r.values()) for b in arrival.by_arrival(frames, schema) for r in b.to_pylist()]
        assert got == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


class _Queue:
    """What a robot's queue keeps, in memory."""

    def __init__(self):
        self.states, self.timers = {"open": _List(), "step": _Single()}, []

    def getListState(self, name, _):
        return self.states[name]

    getValueState = getListState

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)


def _held_by_a_robot(n: int) -> tuple[int, list[tuple]]:
    """Most bytes of Python and Arrow objects while a robot takes n requests in one trigger, last ones first, and its moves."""
    queue, moves = sc.RobotQueue(), []
    queue.init(_Queue())
    blank = dict.fromkeys(sc.Request._fields)

    def frames():
        for end in range(n, 0, -500):
            rows = range(max(0, end - 500), end)
            kinds = [("issue", "next", "ack")[i % 3] for i in rows]
            yield pd.DataFrame([blank | dict(seq=i, at_ms=1000 * i, kind=k, command_id=None if k == "next" else f"c{i // 3}", type="pause", actor="op", ack_status="completed") for i, k in zip(rows, kinds, strict=True)])

    most, before = 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for out in queue.handleInputRows(("r",), frames(), type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()):
        most = max(most, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - before)
        moves += [len(out), *out["step"].agg(["min", "max"]).tolist()] if len(out) else []
    tracemalloc.stop()
    assert queue.step.get() == (n // 3 * 3,) and not queue.open.exists()
    return most, moves


def test_a_robots_memory_does_not_grow_with_the_trigger(monkeypatch):
    monkeypatch.setattr(arrival, "RUN_ROWS", 1000)
    monkeypatch.setattr(arrival, "BLOCK_ROWS", 50)
    monkeypatch.setattr(sc, "OUT_ROWS", 500)
    _held_by_a_robot(300)  # imports and caches
    small, _ = _held_by_a_robot(3000)
    large, moves = _held_by_a_robot(30_000)
    assert large < 2 * small
    assert sum(moves[::3]) == 30_000 and moves[1::3] == [0, *[m + 1 for m in moves[2::3][:-1]]]  # each move once, numbered through


def test_router_forgets_no_id_that_left_its_hand(monkeypatch):
    """More ids in one call than it keeps at hand, in more than one run: later acks find the robot of the first issue among the entries."""
    monkeypatch.setattr(arrival, "RUN_ROWS", 40)
    monkeypatch.setattr(arrival, "BLOCK_ROWS", 8)
    monkeypatch.setattr(sc, "KNOWN_IDS", 5)
    router, entries = sc.CommandRouter(), _Entries()
    router.init(type("Handle", (), {"getMapState": lambda self, *_: entries})())
    blank = dict.fromkeys(sc._STEP_NAMES)
    rows = [blank | dict(seq=i, kind="issue", command_id=f"c{i % 60}", robot_id=f"r{i}") for i in range(90)]
    rows += [blank | dict(seq=90 + i, kind="ack", command_id=f"c{i}") for i in range(70)]
    random.Random(3).shuffle(rows)
    out = pd.concat(router.handleInputRows((0,), iter([pd.DataFrame(rows[i : i + 30]) for i in range(0, len(rows), 30)]), None))
    assert out["seq"].tolist() == list(range(150))  # the last ten acks name no command
    assert out["robot_id"].tolist() == [f"r{i}" for i in range(90)] + [f"r{i}" for i in range(60)]
    assert entries == {(f"c{i}",): (f"r{i}",) for i in range(60)}
