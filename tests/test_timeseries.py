from __future__ import annotations

import random
from datetime import timedelta
from itertools import groupby

import pytest
from conftest import utc
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.operators import fleet
from groundswell.operators import timeseries as ts
from groundswell.plans import slices

T0 = utc("2026-10-01 10:00:00")
ORIGIN = utc("2000-01-01")
NAMES = [f.name for f in S.TELEMETRY]


def frame(spark, rows):
    base = dict(site_id="s", state="injecting", x_m=0.0, y_m=0.0, depth_m=15.0, injection_pressure_kpa=700.0,
                flow_rate_lpm=140.0, surface_uplift_mm=2.0, battery_pct=90.0, robot_id="r1", ts=T0)
    full = [{**base, "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], S.TELEMETRY)


@pytest.fixture(scope="module")
def contract(spark):
    rows = [("r1", "site-a", 120, 100, 900, 3), ("r1", "site-a", 0, 100, 800, 1), ("r1", "site-a", 60, 100, 1000, 2),
            ("r1", "site-a", 330, 0, 0, 3.5), ("r2", "site-a", 0, 50, 600, 0.5), ("r3", "site-b", 0, 0, 0, 0)]
    return frame(spark, [
        dict(robot_id=r, site_id=s, ts=T0 + timedelta(seconds=o), flow_rate_lpm=float(f), injection_pressure_kpa=float(p), surface_uplift_mm=float(u))
        for r, s, o, f, p, u in rows
    ])


def test_latest(contract):
    got = ts.latest_per_robot(contract, "site-a").orderBy("robot_id").collect()
    assert [(r.robot_id, r.seq) for r in got] == [("r1", 3), ("r2", 4)]


def test_latest_ties_and_age(spark):
    df = frame(spark, [dict(ts=T0), dict(ts=T0), dict(ts=T0 - timedelta(days=2), robot_id="old")])
    assert [r.seq for r in ts.latest_per_robot(df).where("robot_id = 'r1'").collect()] == [1]
    fresh = ts.latest_per_robot(df, now=F.lit(T0), max_age="1 DAY")
    assert [r.robot_id for r in fresh.collect()] == ["r1"]


def test_series_contract(contract):
    got = ts.robot_series(contract, T0, T0 + timedelta(hours=1), "5m", "r1").orderBy("bucket").collect()
    assert [r["count"] for r in got] == [3, 1]
    assert (got[0].avg_pressure_kpa, got[0].max_pressure_kpa, got[0].max_uplift_mm) == (900, 1000, 3)
    assert [r.volume_injected_l for r in got] == [200, 175]
    assert ts.robot_series(contract, T0, T0 + timedelta(hours=1), "5m", "nobody").count() == 0


def test_series_args():
    now = utc("2026-10-01 12:00:00")
    assert ts.series_args(now) == (now - timedelta(hours=1), now, 60.0)
    assert ts.series_args(now, bucket="5m")[2] == 300
    assert ts.series_args(now, "2026-10-01T11:00:00Z", "2026-10-01T11:30:00Z")[0] == utc("2026-10-01 11:00:00")
    bad = [dict(bucket="1ms"), dict(bucket="banana"), dict(start=now, end=now), dict(start="2026-01-01T00:00:00Z"),
           dict(start=now - timedelta(hours=24), bucket="1s"), dict(start="2026-10-01")]
    for args in bad:
        with pytest.raises(ValueError):
            ts.series_args(now, **args)
    ts.series_args(now, now - timedelta(seconds=10_000.5), bucket="1s")  # the quotient is cut before the check


def random_rows(seed, n=1500):
    """One robot owns most rows; equal times, gaps of hours and a burst at one instant."""
    rng = random.Random(seed)
    rows, at = [], T0
    for _ in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 1, 7, 60, 600, 9000]))
        robot = "hot" if rng.random() < 0.7 else f"r{rng.randrange(5)}"
        rows.append(dict(
            robot_id=robot, ts=at, flow_rate_lpm=round(rng.uniform(0, 200), 2), state=rng.choice(["idle", "idle", "fault"]),
            injection_pressure_kpa=round(rng.uniform(0, 900), 1), surface_uplift_mm=round(rng.uniform(-5, 5), 2),
            x_m=rng.randrange(-8, 8) / 4, y_m=rng.randrange(-8, 8) / 4,
        ))
    order = list(range(n))
    rng.shuffle(order)  # the sequence number is the arrival order, not the time order
    return [{**r, "seq": s} for r, s in zip(rows, order, strict=True)]


def per_robot(rows):
    key = lambda r: (r["robot_id"], r["ts"], r["seq"])
    for robot, group in groupby(sorted(rows, key=key), key=lambda r: r["robot_id"]):
        yield robot, list(group)


@pytest.mark.parametrize("seed, hot_rows", [(1, slices.PIECE_ROWS), (2, 4)])
def test_sliced_windows_equal_a_plain_walk(spark, monkeypatch, seed, hot_rows):
    """With four rows as the limit most slices are cut by instant and arrival."""
    monkeypatch.setattr(slices, "PIECE_ROWS", hot_rows)
    rows = random_rows(seed)
    df = frame(spark, rows).repartition(7)
    segments, runs, litres = {}, [], {}
    for robot, group in per_robot(rows):
        before = None
        for r in group:
            dt = (r["ts"] - before["ts"]).total_seconds() / 60 if before else None
            piece = (r["flow_rate_lpm"] + before["flow_rate_lpm"]) / 2 * dt if before else None
            segments[r["seq"]] = piece
            bucket = (r["ts"] - ORIGIN) // timedelta(minutes=90)
            litres[robot, bucket] = litres.get((robot, bucket), 0.0) + (piece or 0.0)
            before = r
        for state, run in groupby(group, key=lambda r: r["state"]):
            run = list(run)
            runs.append((robot, state, run[0]["ts"], run[-1]["ts"], len(run)))
    got = {r.seq: r.segment_l for r in ts.flow_segments(df).collect()}
    assert got.keys() == segments.keys()
    assert all(got[s] == pytest.approx(v) for s, v in segments.items())
    micros = lambda t: int(t.timestamp() * 1e6)
    got_runs = ts.state_runs(df).selectExpr("robot_id", "state", "unix_micros(run_start) a", "unix_micros(run_end) b", "samples")
    assert sorted(map(tuple, got_runs.collect())) == sorted((r, s, micros(a), micros(b), n) for r, s, a, b, n in runs)
    span_end = max(r["ts"] for r in rows) + timedelta(seconds=1)
    inside = [r for r in rows if r["ts"] < span_end]
    series = ts.robot_series(df, T0, span_end, "90m").selectExpr("robot_id", "unix_micros(bucket) b", "volume_injected_l v", "count").collect()
    assert sum(r["count"] for r in series) == len(inside)
    for r in series:
        into = timedelta(microseconds=r.b - micros(ORIGIN))
        bucket = into // timedelta(minutes=90)
        last = into + timedelta(minutes=90) > span_end - ORIGIN
        assert last or r.v == pytest.approx(litres[r.robot_id, bucket], abs=1e-6)


def test_results_do_not_depend_on_row_order(spark):
    rows = random_rows(5, 400)
    one, two = frame(spark, rows).coalesce(1), frame(spark, rows[::-1]).repartition(5)
    for op in (ts.latest_per_robot, ts.robot_history, fleet.survey_cells, fleet.last_uplift_gauge):
        assert sorted(map(tuple, op(one).collect())) == sorted(map(tuple, op(two).collect()))


def test_history_keeps_the_newest_120(spark):
    rows = [dict(ts=T0 + timedelta(seconds=i)) for i in range(170)]
    got = sorted(r.seq for r in ts.robot_history(frame(spark, rows)).collect())
    assert got == list(range(50, 170))
    spread = [dict(ts=T0 + timedelta(hours=5 * i)) for i in range(170)]
    assert sorted(r.seq for r in ts.robot_history(frame(spark, spread)).collect()) == list(range(50, 170))


def test_late_row_updates_history_but_not_latest(spark):
    df = frame(spark, [dict(ts=T0 + timedelta(seconds=10), flow_rate_lpm=1.0), dict(ts=T0 + timedelta(seconds=5), flow_rate_lpm=2.0)])
    assert [r.flow_rate_lpm for r in ts.latest_per_robot(df).collect()] == [1]
    assert [r.flow_rate_lpm for r in ts.robot_history(df).orderBy("ts").collect()] == [2, 1]


def test_survey_summary_bounds(spark):
    df = frame(spark, [
        dict(x_m=1.1, surface_uplift_mm=1.0), dict(x_m=0.9, surface_uplift_mm=3.0), dict(x_m=5.0, surface_uplift_mm=2.0),
    ])
    cells = {(r.cell_x, r.cell_y): r.uplift for r in fleet.survey_cells(df).collect()}
    assert cells == {(1, 0): 3.0, (5, 0): 2.0}
    two = frame(spark, [{}, dict(robot_id="r2", state="fault", flow_rate_lpm=0.0, x_m=9.0, surface_uplift_mm=5.0)])
    s = fleet.fleet_summary(ts.latest_per_robot(two), fleet.survey_cells(two)).first()
    assert (s.robots, s.injecting, s.faulted, s.total_flow_lpm, s.max_uplift_mm) == (2, 1, 1, 140, 5)
    low = frame(spark, [dict(surface_uplift_mm=-3.0)])
    assert fleet.fleet_summary(ts.latest_per_robot(low), fleet.survey_cells(low)).first().max_uplift_mm == 0
    assert fleet.max_uplift_scale(fleet.survey_cells(low)).first().max_uplift == 1


def test_bounds(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 40.0, 10.0)], "site_id string, x double, y double")
    sites = spark.createDataFrame([("a",), ("b",)], "site_id string")
    got = {r.site_id: tuple(r)[1:] for r in fleet.site_bounds(points, pad=5.0, sites=sites).collect()}
    assert got["a"][:2] == (-5, 45) and got["a"][3] - got["a"][2] == 50
    assert got["b"] == (-30, 30, -30, 30)


@pytest.mark.parametrize("step_us", [3_600_000, 0])
def test_pieces_follow_the_rows_of_a_slice(spark, monkeypatch, step_us):
    """One robot, one hour: distinct times, then one time for all; no piece is much over the limit and few are small."""
    monkeypatch.setattr(slices, "PIECE_ROWS", 50)
    df = spark.range(1000).select(
        F.lit("r").alias("robot_id"), F.timestamp_micros(F.lit(1_767_225_600_000_000) + F.col("id") * step_us).alias("ts"), F.col("id").alias("seq")
    )
    pieces = slices.sliced(df, ["robot_id"], F.date_trunc("hour", "ts")).groupBy(*slices.SLICE).count().collect()
    assert sum(p["count"] for p in pieces) == 1000
    assert len(pieces) <= 2 * 1000 / 50 and max(p["count"] for p in pieces) <= 100


def test_series_over_two_years_and_limits_of_a_request(spark):
    df = frame(spark, [{**r, "ts": T0 + timedelta(days=100 * i), "robot_id": "r"} for i, r in enumerate(random_rows(3)[:8])])
    assert sum(r["count"] for r in ts.robot_series(df, T0, T0 + timedelta(days=800), "1h").collect()) == 8
    with pytest.raises(ValueError, match="31 days"):
        ts.requested_series(df, T0, T0, T0 + timedelta(days=800), "1h")
    assert ts.requested_series(df, T0 + timedelta(minutes=1)).count() == 1


def test_robots_are_listed_by_name(spark):
    df = spark.createDataFrame([("r2", "s1"), ("r10", "s1"), ("r1", "s2"), ("r1", "s1")], "robot_id string, site_id string")
    assert [tuple(r) for r in ts.sort_by_robot(df).collect()] == [("r1", "s1"), ("r1", "s2"), ("r10", "s1"), ("r2", "s1")]
