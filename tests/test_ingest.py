from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from conftest import utc
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.operators import ingest
from groundswell.sources import batches as B

NOW = utc("2026-10-01 12:00:00")
GOOD = dict(
    seq=0, ts=NOW, site_id="north-1", robot_id="unit-01", state="injecting", x_m=12.0, y_m=-4.0, depth_m=18.0,
    injection_pressure_kpa=850.0, flow_rate_lpm=120.0, surface_uplift_mm=3.2, battery_pct=77.0,
)
INF, NAN = float("inf"), float("nan")
CASES = [
    ({}, None),
    ({"robot_id": ""}, "robot_id is required"),
    ({"robot_id": None}, "robot_id is required"),
    ({"site_id": ""}, "site_id is required"),
    ({"ts": utc("0001-01-01")}, "ts is required"),
    ({"ts": None}, "ts is required"),
    ({"ts": NOW + timedelta(minutes=1)}, None),
    ({"ts": NOW + timedelta(minutes=5)}, None),
    ({"ts": NOW + timedelta(hours=1)}, "ts 2026-10-01T13:00:00Z is more than 5m0s in the future"),
    ({"state": "dancing"}, 'unknown state "dancing"'),
    ({"state": 'a"b\\'}, 'unknown state "a\\"b\\\\"'),
    ({"injection_pressure_kpa": NAN}, "injection_pressure_kpa must be finite"),
    ({"x_m": INF}, "x_m must be finite"),
    ({"x_m": NAN, "battery_pct": -INF}, "x_m must be finite"),
    ({"depth_m": -1.0}, "depth_m -1.00 outside [0, 200]"),
    ({"injection_pressure_kpa": 10001.0}, "injection_pressure_kpa 10001.0 outside [0, 10000]"),
    ({"flow_rate_lpm": -0.1}, "flow_rate_lpm -0.1 outside [0, 2000]"),
    ({"flow_rate_lpm": -0.35}, "flow_rate_lpm -0.3 outside [0, 2000]"),
    ({"surface_uplift_mm": -12.0}, None),
    ({"surface_uplift_mm": -5000.5}, "surface_uplift_mm -5000.5 outside ±5000"),
    ({"battery_pct": 101.0}, "battery_pct 101.0 outside [0, 100]"),
    ({"depth_m": 0.0}, None), ({"depth_m": 200.0}, None), ({"injection_pressure_kpa": 10000.0}, None),
    ({"flow_rate_lpm": 2000.0}, None), ({"surface_uplift_mm": 5000.0}, None), ({"surface_uplift_mm": -5000.0}, None),
    ({"battery_pct": 0.0}, None), ({"battery_pct": 100.0}, None), ({"flow_rate_lpm": None}, None),
]


def test_first_failure_wins_and_bounds_are_inclusive(spark):
    names = [f.name for f in S.TELEMETRY]
    rows = [tuple({**GOOD, **change, "seq": i}[n] for n in names) for i, (change, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, S.TELEMETRY)
    got = ingest.validate_samples(df, F.lit(NOW)).orderBy("seq").select("valid", "error").collect()
    want = [e and f"invalid sample: {e}" for _, e in CASES]
    assert [r.error for r in got] == want
    assert [r.valid for r in got] == [e is None for e in want]
    assert ingest.accepted_samples(df, F.lit(NOW)).count() == want.count(None)


def sample(**change):
    s = dict(robot_id="unit-01", site_id="s1", ts="2026-10-01T11:59:00Z", state="injecting", x_m=1, y_m=2, depth_m=15,
             injection_pressure_kpa=700, flow_rate_lpm=90, surface_uplift_mm=4, battery_pct=80)
    return {**s, **change}


def body(*samples):
    return json.dumps({"samples": samples})


BODIES = {
    "mixed": (body(sample(), sample(battery_pct=180)), "ok", 202, 1),
    "cut off": ('{"samples":', "malformed", 400, 0),
    "stray key": ('{"samples":[],"extra":1}', "malformed", 400, 0),
    "empty": ('{"samples":[]}', "refused", 400, 0),
    "null list": ('{"samples": null}', "refused", 400, 0),
    "no list": ("{}", "refused", 400, 0),
    "not a list": ('{"samples":5}', "malformed", 400, 0),
    "all bad": (body({"robot_id": "x"}), "ok", 422, 0),
    "good": (body(sample()), "ok", 202, 1),
    "stray sample key": (body(sample(colour="red")), "malformed", 400, 0),
    "number as text": (body(sample(), sample(x_m="1")), "malformed", 400, 0),
    "text as number": (body(sample(robot_id=5)), "malformed", 400, 0),
    "truth as number": (body(sample(x_m=True)), "malformed", 400, 0),
    "overflow": (body(sample()).replace('"x_m": 1', '"x_m": 1e400'), "malformed", 400, 0),
    "nan": (body(sample(x_m=NAN)), "malformed", 400, 0),
    "bad time": (body(sample(ts="yesterday")), "malformed", 400, 0),
    "null number": (body(sample(x_m=None)), "ok", 202, 1),
    "null sample": ('{"samples":[null]}', "ok", 422, 0),
    "quote in text": (body(sample(robot_id='a"x_m": "b')), "ok", 202, 1),
    "text after": (body(sample()) + " and more", "ok", 202, 1),
    "too many": (body(*[{} for _ in range(5001)]), "refused", 400, 0),
    "too long": (body(sample(robot_id="r" * (1 << 20))), "malformed", 400, 0),
}


@pytest.fixture(scope="module")
def uploads(spark):
    rows = [(name, text, NOW) for name, (text, *_) in BODIES.items()]
    return spark.createDataFrame(rows, "batch_id string, body string, received_at timestamp")


def test_uploads_are_refused_as_a_whole(uploads):
    got = {r.batch_id: r.status for r in B.batch_status(uploads).collect()}
    assert got == {name: status for name, (_, status, _, _) in BODIES.items()}


def test_responses(uploads):
    out = ingest.upload_responses(B.uploaded_rows(uploads), F.lit(NOW))
    got = {r.batch_id: r for r in out.collect()}
    assert {n: (r.code, r.accepted) for n, r in got.items()} == {n: (c, a) for n, (_, _, c, a) in BODIES.items()}
    assert [x["index"] for x in got["mixed"].rejected] == [1]


def test_arrival_numbers_are_dense_and_ordered(spark):
    late, early = datetime(2026, 1, 2), datetime(2026, 1, 1)
    rows = [(f"b{i:03d}", body(sample(), sample()), late if i % 3 == 0 else early) for i in range(200)] + [(None, "{}", None)]
    df = spark.createDataFrame(rows, "batch_id string, body string, received_at timestamp").repartition(7)
    numbered = {r.arrival: r.batch_id for r in B.with_arrival(df).collect()}
    want = [None] + [n for n, _, at in sorted(rows[:-1], key=lambda r: (r[2], r[0]))]
    assert numbered == dict(enumerate(want))
    seqs = [r.seq for r in B.sequenced_rows(df).orderBy("received_at", "batch_id", "index").collect()]
    assert seqs == sorted(seqs) and len(set(seqs)) == 400
    assert B.with_arrival(df.limit(0)).count() == 0


OTHER_CASE = {
    "other case": (body(sample(), sample(battery_pct=180)).replace("samples", "Samples").replace("robot_id", "Robot_ID").replace("x_m", "X_M"), "ok", 202, 1),
    "twice in other case": (body({**sample(depth_m=999), "Depth_M": 15}), "ok", 202, 1),
    "stray key in other case": (body(sample(Colour="red")), "malformed", 400, 0),
    "number as text in other case": (body(sample()).replace('"x_m": 1', '"X_m": "1"'), "malformed", 400, 0),
    "null list in other case": ('{"SAMPLES": null}', "refused", 400, 0),
}


def test_keys_are_matched_in_any_letter_case(spark):
    df = spark.createDataFrame([(name, text, NOW) for name, (text, *_) in OTHER_CASE.items()], "batch_id string, body string, received_at timestamp")
    assert {r.batch_id: r.status for r in B.batch_status(df).collect()} == {name: status for name, (_, status, _, _) in OTHER_CASE.items()}
    accepted = ingest.accepted_samples(B.parse_batches(df), F.lit(NOW)).collect()
    assert [(r.batch_id, r.robot_id, r.x_m, r.depth_m) for r in sorted(accepted)] == [
        ("other case", "unit-01", 1.0, 15.0), ("twice in other case", "unit-01", 1.0, 15.0)
    ]


def test_counters(uploads):
    counted = ingest.ingest_counters(B.uploaded_rows(uploads), F.lit(NOW))
    malformed = sum(s == "malformed" for _, s, _, _ in BODIES.values())
    assert {r.outcome: r.n for r in counted.collect()} == {"accepted": 5, "validation": 3, "malformed": malformed}


def test_ndjson(spark, tmp_path):
    broken = ['{"x_m": 1', "[1]", '{"x_m": "far"}']
    (tmp_path / "a.json").write_text("\n".join([json.dumps(sample(x_m=i)) for i in range(3)] + broken))
    got = B.read_samples_ndjson(spark, str(tmp_path)).orderBy("x_m").collect()
    assert [r.x_m for r in got] == [0, 1, 2]
    assert sorted(r.line for r in B.corrupt_lines(spark, str(tmp_path)).collect()) == sorted(broken)
    assert got[0].ts is not None and got[0].robot_id == "unit-01"
