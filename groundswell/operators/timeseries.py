"""Latest readings, bucketed series and ordered per-robot views."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.functions.columns import duration_seconds, minutes_between, time_bin
from groundswell.plans.shared import materialize
from groundswell.plans.slices import SLICE, SLICE_S, carry_forward, sliced


def site_feed(df: DataFrame, site_id: str = "") -> DataFrame:
    """Rows of one site, or all rows when no site is named."""
    return df.where(F.col("site_id") == site_id) if site_id else df


def _stamp(t: datetime) -> Column:
    utc = t if t.tzinfo else t.replace(tzinfo=timezone.utc)
    return F.lit(utc.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")).cast("timestamp")


def series_range(df: DataFrame, start: datetime, end: datetime, robot_id: str | None = None) -> DataFrame:
    """Half-open `[start, end)`; partitions by day are pruned where the table has them."""
    df = df.where((F.col("ts") >= _stamp(start)) & (F.col("ts") < _stamp(end)))
    if "ts_date" in df.columns:
        df = df.where((F.col("ts_date") >= F.to_date(_stamp(start))) & (F.col("ts_date") <= F.to_date(_stamp(end))))
    return df if robot_id is None else df.where(F.col("robot_id") == robot_id)


def _instant(value: str | datetime | None, default: datetime, name: str) -> datetime:
    if value is None or value == "":
        return default
    if isinstance(value, datetime):
        return value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    try:
        parsed = datetime.fromisoformat(value)
    except ValueError as e:
        raise ValueError(f"{name}: {e}") from None
    if parsed.tzinfo is None or len(value) < 20:
        raise ValueError(f"{name}: {value!r} is not RFC 3339")
    return parsed


def bucket_seconds(bucket: str | float | None) -> float:
    """One minute by default."""
    return 60.0 if bucket in (None, "") else duration_seconds(bucket) if isinstance(bucket, str) else float(bucket)


def series_args(
    now: datetime,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    bucket: str | float | None = None,
) -> tuple[datetime, datetime, float]:
    """Check a series request; defaults are the last hour in one-minute buckets."""
    end_at = _instant(end, now, "to")
    start_at = _instant(start, now - timedelta(hours=1), "from")
    width = bucket_seconds(bucket)
    span = (end_at - start_at).total_seconds()
    if span <= 0:
        raise ValueError("from must be before to")
    if span > S.MAX_SERIES_SPAN_S:
        raise ValueError("range exceeds 31 days")
    if width < S.MIN_BUCKET_S:
        raise ValueError("bucket must be >= 1s")
    if span // width > S.MAX_BUCKETS:
        raise ValueError("too many buckets; widen bucket")
    return start_at, end_at, width


def requested_series(
    df: DataFrame,
    now: datetime,
    start: str | datetime | None = None,
    end: str | datetime | None = None,
    bucket: str | float | None = None,
    robot_id: str | None = None,
) -> DataFrame:
    """`robot_series` behind the checks and defaults of a request."""
    return robot_series(df, *series_args(now, start, end, bucket), robot_id)


def robot_series(
    df: DataFrame, start: datetime, end: datetime, bucket: str | float, robot_id: str | None = None
) -> DataFrame:
    """Per robot and bucket: count, mean and peak pressure, mean flow, peak uplift, litres injected.

    Any range and width; `requested_series` adds the limits of a request.
    Litres are the trapezoid of flow between neighbouring samples, booked on the
    later one.  Rows are shuffled once, on (robot, slice of a bucket); each slice
    shrinks to one row, and only those rows meet again per robot, where the
    segments that cross a cut are added.
    """
    width = bucket_seconds(bucket)
    rows = series_range(df, start, end, robot_id).select(
        "robot_id", "ts", "seq",
        F.col("injection_pressure_kpa").alias("p"), F.col("flow_rate_lpm").alias("f"), F.col("surface_uplift_mm").alias("u"),
        time_bin("ts", width).alias("bucket"),
    )
    into = F.unix_micros("ts") - F.unix_micros("bucket")
    start = F.timestamp_micros(F.unix_micros("ts") - into % F.lit(SLICE_S * 1_000_000))  # counted from the bucket's start
    rows = sliced(rows, ["robot_id"], start)
    w = Window.partitionBy("robot_id", *SLICE).orderBy("ts", "seq")
    before, after = F.lag("ts").over(w), F.lead("ts").over(w)
    rows = rows.select(
        "*",
        F.when(before.isNull(), F.struct("ts", "f")).alias("first"),
        F.when(after.isNull(), F.struct("ts", "f")).alias("last"),
        ((F.col("f") + F.lag("f").over(w)) / 2 * minutes_between("ts", before)).alias("litres"),
    )
    slices = rows.groupBy("robot_id", *SLICE).agg(
        F.min("bucket").alias("bucket"),
        F.count("*").alias("n"),
        F.sum("p").alias("sum_p"), F.max("p").alias("max_p"), F.sum("f").alias("sum_f"), F.max("u").alias("max_u"),
        F.sum("litres").alias("litres"),
        F.max("first.ts").alias("first_ts"), F.max("first.f").alias("first_f"),
        F.max("last.ts").alias("last_ts"), F.max("last.f").alias("last_f"),
    )
    along = Window.partitionBy("robot_id").orderBy(*SLICE)
    crossing = (F.col("first_f") + F.lag("last_f").over(along)) / 2 * minutes_between(
        "first_ts", F.lag("last_ts").over(along)
    )
    return (
        slices.withColumn("crossing", crossing)
        .groupBy("robot_id", "bucket")
        .agg(
            F.sum("n").alias("count"),
            (F.sum("sum_p") / F.sum("n")).alias("avg_pressure_kpa"),
            F.max("max_p").alias("max_pressure_kpa"),
            (F.sum("sum_f") / F.sum("n")).alias("avg_flow_lpm"),
            F.max("max_u").alias("max_uplift_mm"),
            (F.coalesce(F.sum("litres"), F.lit(0.0)) + F.coalesce(F.sum("crossing"), F.lit(0.0))).alias("volume_injected_l"),
        )
    )


def flow_segments(df: DataFrame) -> DataFrame:
    """Each sample with the minutes since, and the flow of, the robot's previous one, and the litres between."""
    df = carry_forward(
        df.select("robot_id", "seq", "ts", "flow_rate_lpm"), ["robot_id"], {"_prev": F.struct("ts", "flow_rate_lpm")}
    )
    dt = minutes_between("ts", "_prev.ts")
    before = F.col("_prev.flow_rate_lpm")
    return df.select(
        "robot_id", "seq", "ts", "flow_rate_lpm", dt.alias("dt_min"), before.alias("flow_prev_lpm"),
        ((F.col("flow_rate_lpm") + before) / 2 * dt).alias("segment_l"),
    )


def latest_per_robot(
    df: DataFrame, site_id: str = "", now: Column | None = None, max_age: str | None = None
) -> DataFrame:
    """Newest sample of each robot on each site; of equal times the one that arrived last."""
    df = site_feed(df, site_id)
    if max_age is not None:
        df = df.where(F.col("ts") > now - F.expr(f"INTERVAL {max_age}"))
    best = df.groupBy("site_id", "robot_id").agg(
        F.max_by(F.struct(*[c for c in df.columns if c not in ("site_id", "robot_id")]), F.struct("ts", "seq")).alias("s")
    )
    return best.select("site_id", "robot_id", "s.*")


def sort_by_robot(df: DataFrame) -> DataFrame:
    """Robots by name, as reports list them; for small results such as the latest samples or the links."""
    return df.orderBy(*[c for c in ("robot_id", "site_id") if c in df.columns])


def robot_history(df: DataFrame, length: int = S.HISTORY_LEN) -> DataFrame:
    """The newest `length` samples of each robot.

    Days are trimmed first, so what meets per robot is at most `length` rows a day.
    """
    newest = [F.desc("ts"), F.desc("seq")]
    per_day = Window.partitionBy("site_id", "robot_id", "_day").orderBy(*newest)
    overall = Window.partitionBy("site_id", "robot_id").orderBy(*newest)
    return (
        df.withColumn("_day", F.to_date("ts"))
        .withColumn("_rank", F.row_number().over(per_day))
        .where(F.col("_rank") <= length)
        .withColumn("_rank", F.row_number().over(overall))
        .where(F.col("_rank") <= length)
        .drop("_day", "_rank")
    )


def pressure_panel(df: DataFrame, start: datetime, end: datetime, bucket: str = "1m") -> DataFrame:
    """Mean pressure per bucket and robot over `[start, end]`."""
    inside = df.where(F.col("ts").between(_stamp(start), _stamp(end)))
    return inside.groupBy(time_bin("ts", duration_seconds(bucket)).alias("time"), "robot_id").agg(
        F.avg("injection_pressure_kpa").alias("value")
    )


def state_runs(df: DataFrame) -> DataFrame:
    """Consecutive samples of a robot in one state, as one row each.

    Runs are found inside time slices; only the first and the last run of a slice
    can continue in a neighbour, so only those two meet per robot.
    """
    rows = sliced(df.select("robot_id", "ts", "seq", "state"), ["robot_id"], time_bin("ts", SLICE_S))
    w = Window.partitionBy("robot_id", *SLICE).orderBy("ts", "seq")
    rows = rows.select(
        "*",
        F.coalesce((F.lag("state").over(w) != F.col("state")).cast("int"), F.lit(0)).alias("change"),
        F.lead("ts").over(w).isNull().alias("ends_slice"),
    ).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The state is the same throughout a run; as a key it keeps the aggregation a hash one.
    runs = rows.groupBy("robot_id", *SLICE, "run", "state").agg(
        F.min("ts").alias("run_start"), F.max("ts").alias("run_end"),
        F.count("*").alias("samples"), F.max("ends_slice").alias("ends_slice"),
    )
    runs = materialize(runs, "state-runs")  # read twice below; far fewer rows than samples
    out = ["robot_id", "state", "run_start", "run_end", "samples"]
    edge = (F.col("run") == 0) | F.col("ends_slice")
    along = Window.partitionBy("robot_id").orderBy(*SLICE, "run")
    joined = (F.col("run") == 0) & (F.lag("state").over(along) == F.col("state"))
    edges = (
        runs.where(edge)
        .withColumn("starts", F.coalesce((~joined).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("robot_id", "island", "state")
        .agg(
            F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
            F.sum("samples").alias("samples"),
        )
    )
    return runs.where(~edge).select(*out).unionByName(edges.select(*out))
