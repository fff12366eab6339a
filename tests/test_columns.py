from __future__ import annotations

import math
import random
from datetime import timedelta

import pytest
from conftest import utc
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions import columns as fn


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", expr("v").alias("o")).orderBy("i").collect()]


def test_time_bin_floors_from_the_origin_even_before_it(spark):
    stamps = ["1969-12-31 23:59:59", "1999-12-31 23:58:00", "2000-01-01 00:00:00", "2024-02-29 12:34:56"]
    origin = utc("2000-01-01")
    for width in (420, 60, 300, 90, 3600):
        got = column(spark, [utc(s) for s in stamps], "timestamp", lambda c, w=width: fn.time_bin(c, w).cast("string"))
        step = timedelta(seconds=width)
        want = [origin + (utc(s) - origin) // step * step for s in stamps]
        assert got == [w.strftime("%Y-%m-%d %H:%M:%S") for w in want]


def test_round_half_away_is_binary(spark):
    assert column(spark, [1.005, -2.5, 2.5, 0.0], "double", lambda c: fn.round_half_away(c, 2))[0] == 1.0
    assert column(spark, [-2.5, 2.5], "double", lambda c: fn.round_half_away(c, 0)) == [-3.0, 3.0]


@pytest.mark.parametrize("places", [1, 2])
def test_fixed_text_rounds_the_exact_value(spark, places):
    rng = random.Random(7)
    ties = [0.35, -0.35, 0.25, 0.75, 0.125, 2.675, 1e-9, -0.04, 0.0, 10000.05, 250.45, 99.95]
    values = ties + [round(rng.uniform(-3000, 3000), 2) for _ in range(300)] + [rng.uniform(-1e6, 1e6) for _ in range(100)]
    scale = F.lit(10.0**places)
    got = column(spark, values, "double", lambda c: fn.units_text(c, fn.scaled_units(c, scale), F.lit(places)))
    assert got == [f"{v:.{places}f}" for v in values]


def test_mogi_closed_form_and_decay(spark):
    got = column(spark, [0.0, 4.0, 100.0], "double", lambda c: fn.mogi_uplift_m(F.lit(10.0), F.lit(5.0), F.col(c)))
    assert got[0] == pytest.approx(0.65 * 10 / (math.pi * 25))
    assert got[0] > got[1] > got[2] > 0
    zero = column(spark, [1.0], "double", lambda c: fn.mogi_uplift_m(F.lit(0.0), F.lit(5.0), F.col(c)))
    none = column(spark, [1.0], "double", lambda c: fn.mogi_uplift_m(F.lit(10.0), F.lit(0.0), F.col(c)))
    assert zero == none == [0.0]


def test_mogi_volume_under_the_surface(spark):
    """The lift integrates to 2 (1 - v) dV; rings of the plane, in Spark."""
    ring = 0.05
    r = (F.col("id") + 0.5) * ring
    total = spark.range(2_000_000).select(
        F.sum(fn.mogi_uplift_m(F.lit(3.0), F.lit(10.0), r * r) * 2 * math.pi * r * ring).alias("v")
    ).first().v
    assert total == pytest.approx(2 * 0.65 * 3.0, rel=1e-3)


def test_expected_pressure_rises(spark):
    def p(depth, flow, filled):
        return column(spark, [flow], "double", lambda c: fn.expected_pressure_kpa(F.lit(depth), c, F.lit(filled)))[0]

    assert p(10.0, 0.0, 0.5) == 0.0
    assert p(10.0, 100.0, 0.0) == pytest.approx(19 * 10 * 1.15 + 240)
    assert p(11.0, 100.0, 0.0) > p(10.0, 100.0, 0.0) < p(10.0, 110.0, 0.0)
    assert p(10.0, 100.0, 1.0) == p(10.0, 100.0, 9.0) > p(10.0, 100.0, 0.5)


def test_ramp(spark):
    assert column(spark, [0.0, 1.0, -3.0, 9.0], "double", fn.ramp_colour) == [S.RAMP[0], S.RAMP[-1], S.RAMP[0], S.RAMP[-1]]
    assert column(spark, [0.0], "double", lambda c: fn.ramp_colour(c, dark=True)) == [S.RAMP[-1]]


def test_rfc3339(spark):
    millis = [0, 951_782_400_005, 1_790_000_000_123]
    text = column(spark, millis, "long", lambda c: fn.format_rfc3339(F.timestamp_millis(c)))
    assert text == ["1970-01-01T00:00:00.000Z", "2000-02-29T00:00:00.005Z", "2026-09-21T14:13:20.123Z"]
    back = column(spark, text, "string", lambda c: F.unix_millis(fn.parse_rfc3339(c)))
    assert back == millis
    bad = ["2026-10-01", "2026-10-01 12:00:00Z", "2026-10-01T12:00:00", "2026-13-01T12:00:00Z", "x", None]
    assert column(spark, bad, "string", fn.parse_rfc3339) == [None] * len(bad)
    odd = ["2026-10-01T14:00:00+02:00", "2026-10-01T12:00:00.1234567891Z"]
    assert column(spark, odd, "string", lambda c: F.unix_micros(fn.parse_rfc3339(c)) % 1_000_000_000) == [
        int(utc("2026-10-01 12:00:00").timestamp() * 1e6) % 1_000_000_000,
        int(utc("2026-10-01 12:00:00.123456").timestamp() * 1e6) % 1_000_000_000,
    ]


def test_durations():
    good = {"1m": 60, "5m": 300, "1h30m": 5400, "250ms": 0.25, "1.5s": 1.5, "0": 0, "-2s": -2}
    assert {t: fn.duration_seconds(t) for t in good} == good
    for bad in ("banana", "", "5", "m", "1m x"):
        with pytest.raises(ValueError):
            fn.duration_seconds(bad)
