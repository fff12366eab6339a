from __future__ import annotations

import math
import random

import pytest

from groundswell.operators import fleet, spatial

SURVEY = "site_id string, x double, y double, uplift double, first_seq long"
PLACES = "site_id string, x double, y double"


def survey(spark, points, site="s"):
    return spark.createDataFrame([(site, *map(float, p), i) for i, p in enumerate(points)], SURVEY)


def at(spark, *places, site="s"):
    return spark.createDataFrame([(site, float(x), float(y)) for x, y in places], PLACES)


def uplift(df):
    return {(r.x, r.y): r.uplift for r in df.collect()}


def test_idw_contract(spark):
    points = survey(spark, [(0, 0, 10), (10, 0, 0)])
    got = uplift(spatial.idw_interpolate(points, at(spark, (0, 0), (5, 0), (2, 0), (100, 100))))
    assert got[0, 0] == 10 and got[5, 0] == 5 and got[2, 0] > 5 and got[100, 100] is None


def test_idw_radius_is_inclusive_and_the_first_hit_wins(spark):
    points = survey(spark, [(0, 0, 1), (0.00001, 0, 2), (12, 30, 3)])
    got = uplift(spatial.idw_interpolate(points, at(spark, (0, 0), (0, 30), (-0.001, 30))))
    assert got == {(0, 0): 1, (0, 30): 3, (-0.001, 30): None}


@pytest.mark.parametrize("power", [2.0, 3.0])
def test_idw_equals_all_pairs(spark, power):
    rng = random.Random(3)
    points = [(rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-5, 40)) for _ in range(300)]
    places = [(rng.uniform(-70, 70), rng.uniform(-70, 70)) for _ in range(200)] + [points[0][:2]]
    both = spatial.idw_interpolate(survey(spark, points).union(survey(spark, [(0, 0, 99)], "t")), at(spark, *places), power=power)
    for (x, y), got in uplift(both).items():
        near = [((px - x) ** 2 + (py - y) ** 2, u) for px, py, u in points]
        hit = [u for d2, u in near if d2 < 1e-9]
        near = [(d2, u) for d2, u in near if d2 <= 144]
        want = hit[0] if hit else sum(u / d2 ** (power / 2) for d2, u in near) / sum(1 / d2 ** (power / 2) for d2, _ in near) if near else None
        assert got == (want if want is None else pytest.approx(want))
        assert got is None or min(u for _, u in near) - 1e-9 <= got <= max(u for _, u in near) + 1e-9


def test_grid_covers_the_bounds(spark):
    bounds = spark.createDataFrame([("s", -1.5, 2.0, 0.0, 1.2)], "site_id string, min_x double, max_x double, min_y double, max_y double")
    got = sorted((r.x0, r.y0, r.x, r.y) for r in spatial.grid_cells(bounds).collect())
    assert [g[:2] for g in got] == [(x, y) for x in (-2, -1, 0, 1) for y in (0, 1)]
    assert got[0][2:] == (-1.5, 0.5)


def test_grid_colours(spark):
    points = survey(spark, [(0.5, 0.5, 20), (3.5, 0.5, 0)])
    bounds = fleet.site_bounds(points, pad=0.0)
    cells = {(r.x0, r.y0): r.colour for r in spatial.uplift_grid(points, bounds, fleet.max_uplift_scale(points)).collect()}
    assert cells[0, 0] == "#0d366b" and cells[3, 0] == "#cde2fb"


def test_nearest_robot_equals_all_pairs(spark):
    rng = random.Random(4)
    robots = [(f"r{i:02d}", rng.randrange(-40, 40) * 1.0, rng.randrange(-40, 40) * 1.0) for i in range(60)] + [("r99", 0.0, 0.0), ("r98", 0.0, 0.0)]
    latest = spark.createDataFrame([("s", *r) for r in robots], "site_id string, robot_id string, x_m double, y_m double")
    places = [(rng.uniform(-60, 60), rng.uniform(-60, 60)) for _ in range(150)] + [(0.0, 0.0)]
    for r in spatial.nearest_robot(latest, at(spark, *places), limit=9.0).collect():
        best = min((math.dist((r.x, r.y), (x, y)), name) for name, x, y in robots)
        assert r.robot_id == (best[1] if best[0] < 9 else None)


def test_uplift_field(spark):
    schema = "site_id string, x double, y double, depth_m double, volume_m3 double"
    one, two = ("s", 0.0, 0.0, 10.0, 4.0), ("s", 6.0, 0.0, 10.0, 4.0)

    def field(*wells):
        df = spark.createDataFrame(wells, schema)
        return {(r.site_id, r.x): r.uplift_mm for r in spatial.uplift_field(places, df).collect()}

    places = at(spark, (3, 0), (80, 0)).union(at(spark, (3, 0), site="other"))
    both, single = field(one, two), field(one)
    assert both["s", 3.0] == pytest.approx(2 * single["s", 3.0])
    closed = 0.65 * 4 * 0.55 / math.pi * 10 / (9 + 100) ** 1.5 * 1000
    assert single["s", 3.0] == pytest.approx(closed)
    assert both["s", 80.0] > 0, "there is no cut-off"
    assert field(one, one) == {k: pytest.approx(2 * v) for k, v in single.items()}
    none = both["other", 3.0]
    assert none == 0.0 and math.copysign(1, none) == 1
    dry = field(("s", 0.0, 0.0, 0.0, 4.0), ("s", 0.0, 0.0, 5.0, 0.0))
    assert dry["s", 3.0] == 0.0


def test_field_equals_all_pairs_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 30)
    rng = random.Random(9)
    wells = [("s", rng.randrange(-300, 300) * 1.0, rng.randrange(-300, 300) * 1.0, rng.uniform(5, 20), rng.uniform(0, 9)) for _ in range(200)]
    places = [(rng.uniform(-300, 300), rng.uniform(-300, 300)) for _ in range(80)]
    df = spark.createDataFrame(wells, "site_id string, x double, y double, depth_m double, volume_m3 double")
    got = spatial.uplift_field(at(spark, *places), df).collect()
    assert len(got) == len(places)
    for r in got:
        want = sum(0.65 * v * 0.55 / math.pi * d / ((x - r.x) ** 2 + (y - r.y) ** 2 + d * d) ** 1.5 for _, x, y, d, v in wells) * 1000
        assert r.uplift_mm == pytest.approx(want)


def test_injections(spark):
    wells = spark.createDataFrame(
        [("s", 1.0, 1.0, 9.0, 5000.0, "completed"), ("s", 2.0, 1.0, 9.0, 250.0, "active"), ("s", 3.0, 1.0, 9.0, 0.0, "active")],
        "site_id string, x double, y double, depth_m double, injected_l double, status string",
    )
    assert sorted(r.volume_m3 for r in spatial.all_injections(wells).collect()) == [0.25, 5.0]
    v = spatial.injected_volume(wells).first()
    assert (v.total_m3, v.wells_done, v.wells_total) == (5.25, 1, 3)


def test_grid_follows_the_survey_and_not_an_outlier(spark):
    survey = spark.createDataFrame(
        [("s", 0.0, 0.0, 1.0, 1), ("s", 1e6, 1e6, 2.0, 2), ("s", 1e300, 0.0, 3.0, 3)], "site_id string, x double, y double, uplift double, first_seq long"
    )
    bounds = spark.createDataFrame([("s", -5.0, 1e300, -5.0, 1e6 + 5.0)], "site_id string, min_x double, max_x double, min_y double, max_y double")
    scale = spark.createDataFrame([("s", 3.0)], "site_id string, max_uplift double")
    cells = {(r.x0, r.y0): r.uplift for r in spatial.uplift_grid(survey, bounds, scale).collect()}
    near = lambda x, y: {(i, j) for i in range(x - 13, x + 14) for j in range(y - 13, y + 14) if (i + 0.5 - x) ** 2 + (j + 0.5 - y) ** 2 <= 144}
    assert set(cells) == {c for c in near(0, 0) if min(c) >= -5} | {c for c in near(10**6, 10**6) if c[1] < 1e6 + 5}


@pytest.mark.parametrize("packed,depth", [(8, 24), (40, 24), (8, 1)])
def test_nearest_robot_in_crowded_tiles(spark, monkeypatch, packed, depth):
    """Crowds in one tile and across corners, ties, robots on one spot, sparse neighbours and queries around all of them."""
    monkeypatch.setattr(spatial, "PACKED", packed)
    monkeypatch.setattr(spatial, "MAX_DEPTH", depth)
    rng = random.Random(packed + depth)
    spots = [(round(rng.gauss(4, 0.3), 2), round(rng.gauss(4, 0.3), 2)) for _ in range(300)]
    spots += [(round(rng.uniform(-2, 2), 1), round(rng.uniform(-2, 2), 1)) for _ in range(200)]
    spots += [(3.0 + k, -7.0) for k in range(5)] + [(40.0, 40.0)] + [(4.0, 4.0)] * 30
    rows = [("s" if i % 7 else "other", f"r{i:04d}", float(x), float(y)) for i, (x, y) in enumerate(spots)]
    latest = spark.createDataFrame(rows, "site_id string, robot_id string, x_m double, y_m double")
    places = [("s", float(rng.uniform(-12, 14)), float(rng.uniform(-12, 14))) for _ in range(150)] + [("s", 4.0, 4.0), ("s", 0.0, 0.0), ("other", 5.0, 5.0), ("none", 0.0, 0.0)]
    queries = spark.createDataFrame(places * 2, "site_id string, x double, y double")
    got = spatial.nearest_robot(latest, queries, limit=9.0).collect()
    assert len(got) == 2 * len(places)
    for r in got:
        near = [(math.sqrt((x - r.x) ** 2 + (y - r.y) ** 2), i) for s, i, x, y in rows if s == r.site_id]
        d, robot = min(near, default=(math.inf, None))
        assert (r.robot_id, r.distance_m) == ((robot, pytest.approx(d)) if d < 9 else (None, None))
