"""The site view: survey cells, summaries, bounds, cards and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import cell
from groundswell.operators.timeseries import latest_per_robot, robot_history


def survey_cells(df: DataFrame, order: str = "arrival") -> DataFrame:
    """Last reading per site and 1 m cell, and the cell's first arrival.

    `order="arrival"` lets a late replay overwrite; `"event"` keeps the newest `ts`.
    """
    by = F.col("seq") if order == "arrival" else F.struct("ts", "seq")
    return df.groupBy("site_id", cell("x_m").alias("cell_x"), cell("y_m").alias("cell_y")).agg(
        F.max_by("x_m", by).alias("x"),
        F.max_by("y_m", by).alias("y"),
        F.max_by("surface_uplift_mm", by).alias("uplift"),
        F.min("seq").alias("first_seq"),
    )


def fleet_summary(latest: DataFrame, survey: DataFrame) -> DataFrame:
    """Per site: robots, how many inject or are in fault, total flow now, peak uplift ever (at least 0)."""
    now = latest.groupBy("site_id").agg(
        F.count("*").alias("robots"),
        F.count_if(F.col("state") == "injecting").alias("injecting"),
        F.count_if(F.col("state") == "fault").alias("faulted"),
        F.sum("flow_rate_lpm").alias("total_flow_lpm"),
    )
    peak = survey.groupBy("site_id").agg(F.greatest(F.lit(0.0), F.max("uplift")).alias("max_uplift_mm"))
    return now.join(peak, "site_id", "left").fillna({"max_uplift_mm": 0.0})


def map_points(survey: DataFrame, latest: DataFrame) -> DataFrame:
    """Survey points and robot positions of each site."""
    robots = latest.select("site_id", F.col("x_m").alias("x"), F.col("y_m").alias("y"))
    return survey.select("site_id", "x", "y").unionByName(robots)


def site_bounds(points: DataFrame, pad: float = S.BOUNDS_PAD_M, sites: DataFrame | None = None) -> DataFrame:
    """Square bounds per site; sites without a point get the default square."""
    box = points.groupBy("site_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    if sites is not None:
        box = sites.select("site_id").distinct().join(box, "site_id", "left")
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(S.BOUNDS_MIN_SPAN_M)) / 2 + pad
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    sides = {"min_x": cx - half, "max_x": cx + half, "min_y": cy - half, "max_y": cy + half}
    empty = F.col("x0").isNull()

    def side(name: str, value: Column) -> Column:
        default = F.lit(-S.BOUNDS_EMPTY_M if name.startswith("min") else S.BOUNDS_EMPTY_M)
        return F.when(empty, default).otherwise(value).alias(name)

    return box.select("site_id", *[side(n, v) for n, v in sides.items()])


def max_uplift_scale(survey: DataFrame) -> DataFrame:
    """Per site, the uplift that maps to the end of the colour ramp."""
    return survey.groupBy("site_id").agg(F.greatest(F.lit(1.0), F.max("uplift")).alias("max_uplift"))


def robot_cards(df: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Latest sample, control link and pressure history of each robot.

    The history is an array, and never longer than 120.
    """
    latest = latest_per_robot(df)
    point = F.struct("ts", "seq", "injection_pressure_kpa")
    history = robot_history(df).groupBy("site_id", "robot_id").agg(F.sort_array(F.collect_list(point)).alias("history"))
    age = F.floor((F.unix_millis(now) - F.unix_millis("last_poll_at")) / F.lit(1000.0) + F.lit(0.5)).cast("long")
    return (
        latest.join(links, "robot_id", "left")
        .join(history, ["site_id", "robot_id"], "left")
        .withColumn("control_age_s", age)
        .withColumn("stale", _stale(now))
    )


def _stale(now: Column) -> Column:
    return F.col("ts") < now - F.expr(f"INTERVAL {S.STALE_AFTER_S} SECONDS")


def stale_robots(latest: DataFrame, now: Column) -> DataFrame:
    """Robots whose newest sample is more than 15 s old."""
    return latest.where(_stale(now))


def low_battery(df: DataFrame) -> DataFrame:
    """Per robot: samples below the battery floor and the first of them."""
    return df.where(F.col("battery_pct") < S.LOW_BATTERY_PCT).groupBy("robot_id").agg(
        F.count("*").alias("samples"), F.min("ts").alias("first_ts"), F.min("battery_pct").alias("min_battery_pct")
    )


def pressure_trips(df: DataFrame) -> DataFrame:
    """Per robot: samples above the trip line, the first of them and the peak."""
    return df.where(F.col("injection_pressure_kpa") > S.PRESSURE_LIMIT_KPA).groupBy("robot_id").agg(
        F.count("*").alias("trips"), F.min("ts").alias("first_trip"), F.max("injection_pressure_kpa").alias("max_pressure_kpa")
    )


def last_uplift_gauge(df: DataFrame) -> DataFrame:
    """Last stored uplift per site and robot, by arrival."""
    return df.groupBy("site_id", "robot_id").agg(F.max_by("surface_uplift_mm", "seq").alias("uplift_mm"))
