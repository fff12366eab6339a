"""Views of the generic `events` table in the shapes the operators read.

Every event becomes one raw sample (with deliberate faults), one well record,
one command request, one HTTP request and one row of an upload batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.operators.ingest import accepted_samples
from groundswell.plans.slices import carry_forward

NOW = "2024-01-30 12:00:00"
COMMANDS_START = "2024-01-01 00:00:00"
ROBOTS, SITES, COMMAND_ROBOTS, BATCH_ROWS = 50, 4, 10, 50


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _every(n: int) -> Column:
    return F.col("event_id") % n == 0


def _robot(n: int) -> Column:
    return F.concat(F.lit("unit-"), F.lpad((F.col("user_id") % n).cast("string"), 2, "0"))


def _site() -> Column:
    return F.concat(F.lit("site-"), (F.col("user_id") % ROBOTS % SITES).cast("string"))


def raw_samples(ev: DataFrame) -> DataFrame:
    return ev.selectExpr(
        "event_id AS seq",
        "ts",
        f"CASE WHEN event_id % 101 = 0 THEN '' ELSE concat('site-', user_id % {ROBOTS} % {SITES}) END AS site_id",
        f"CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('unit-', lpad(user_id % {ROBOTS}, 2, '0')) END AS robot_id",
        """CASE WHEN event_id % 89 = 0 THEN 'dancing' WHEN event_type = 'view' THEN 'idle'
             WHEN event_type = 'signup' THEN 'drilling' WHEN event_type = 'error' THEN 'fault' ELSE 'injecting' END AS state""",
        "((event_id * 37) % 481 - 240) / 10D AS x_m",
        "((event_id * 53) % 481 - 240) / 10D AS y_m",
        "double(event_id % 211) AS depth_m",
        "CASE WHEN event_id % 83 = 0 THEN double('NaN') ELSE value * 30 END AS injection_pressure_kpa",
        "value - 1 AS flow_rate_lpm",
        "((event_id * 7) % 301 - 50) / 4D AS surface_uplift_mm",
        "double(event_id % 103) AS battery_pct",
    )


def telemetry_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_samples(events(spark, sf_dir))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_samples(telemetry_raw(spark, sf_dir), now())


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples with the batch they were uploaded in and their place in it."""
    return telemetry_raw(spark, sf_dir).select(
        F.floor(F.col("seq") / BATCH_ROWS).alias("batch_id"), (F.col("seq") % BATCH_ROWS).alias("index"), "*"
    )


def sample_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as JSON text of all samples, and for some batches an empty upload more (id `-1 - batch_id`).

    The faults are made from the real text: one body is cut in half, one gets a stray
    key, and a NaN is written as the bare token that JSON does not have.
    """
    rows = batch_rows(spark, sf_dir)
    sample = F.struct(
        "robot_id", "site_id", format_rfc3339_us("ts").alias("ts"), "state", "x_m", "y_m", "depth_m",
        "injection_pressure_kpa", "flow_rate_lpm", "surface_uplift_mm", "battery_pct",
    )
    # A batch never has more than BATCH_ROWS samples.
    bodies = rows.groupBy("batch_id").agg(
        F.sort_array(F.collect_list(F.struct("index", sample.alias("s")))).alias("a"), F.max("ts").alias("sent_at")
    )
    good = F.regexp_replace(F.to_json(F.struct(F.col("a.s").alias("samples"))), '"NaN"', "NaN")
    body = (
        F.when(F.col("batch_id") % 29 == 0, F.left(good, F.floor(F.length(good) / 2).cast("int")))
        .when(F.col("batch_id") % 31 == 0, F.concat(F.left(good, F.length(good) - 1), F.lit(',"extra":1}')))
        .otherwise(good)
    )
    own = F.struct("batch_id", body.alias("body"))
    empty = F.struct((-1 - F.col("batch_id")).alias("batch_id"), F.lit('{"samples":[]}').alias("body"))
    sent = F.when(F.col("batch_id") % 37 == 0, F.array(own, empty)).otherwise(F.array(own))
    return bodies.select(F.explode(sent).alias("u"), "sent_at").select("u.batch_id", "u.body", "sent_at", now().alias("received_at"))


def format_rfc3339_us(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per injection well: where, how much is planned and how much is in."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("well_id"),
        _site().alias("site_id"),
        _robot(ROBOTS).alias("robot_id"),
        (F.col("event_id") % 61 - 30).cast("double").alias("x"),
        ((F.col("event_id") * 7) % 61 - 30).cast("double").alias("y"),
        (F.col("event_id") % 7 + 12).cast("double").alias("depth_m"),
        F.lit(12.0).alias("planned_m3"),
        (F.col("value") * 100).alias("injected_l"),
        F.when(F.col("event_type").isin("view", "error"), "active").otherwise("completed").alias("status"),
    )


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.col("ts").alias("at"),
        F.col("event_type").alias("route"),
        F.when(_every(10), 422).otherwise(202).cast("long").alias("code"),
        (F.col("value") / 100).alias("duration_s"),
    )


def command_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request every two seconds; acks and cancels aim at the robot's newest attempt."""
    ev = events(spark, sf_dir)
    kind = (
        F.when(F.col("event_type").isin("signup", "purchase"), "issue")
        .when(F.col("event_type") == "view", "next")
        .when(F.col("event_type") == "click", "ack")
        .otherwise(F.when(_every(3), "cancel").otherwise("next"))
    )
    slot = F.col("event_id") % 7
    command = (
        F.when(slot == 0, "estop").when(slot == 1, "set_flow").when(slot == 2, "resume")
        .when(slot == 3, "clear_fault").otherwise("pause")
    )
    rows = ev.select(
        F.col("event_id").alias("seq"),
        F.timestamp_micros(F.unix_micros(F.lit(COMMANDS_START).cast("timestamp")) + F.col("event_id") * 2_000_000).alias("at"),
        kind.alias("kind"),
        _robot(COMMAND_ROBOTS).alias("robot_id"),
        command.alias("type"),
        "value",
    )
    issued = F.col("kind") == "issue"
    own = F.when(issued, F.concat(F.lit("c"), F.col("seq").cast("string")))
    rows = carry_forward(rows, ["robot_id"], {"_newest": own}, ts="at")
    acked = F.col("kind") == "ack"
    rejected = F.col("seq") % 5 == 0
    return rows.select(
        "seq", "at", "kind", "robot_id",
        own_or_target(issued).alias("command_id"),
        F.when(issued, F.col("type")).alias("type"),
        F.when(issued & (F.col("type") == "set_flow"), F.struct(F.col("value").alias("flow_lpm"))).alias("params"),
        F.when(issued | (F.col("kind") == "cancel"), F.concat(F.lit("op-"), (F.col("seq") % 3).cast("string"))).alias("actor"),
        F.when(acked, F.when(rejected, "rejected").otherwise("completed")).alias("ack_status"),
        F.when(acked & rejected, "pump offline").alias("ack_reason"),
    )


def own_or_target(issued: Column) -> Column:
    target = F.when(F.col("kind").isin("ack", "cancel"), F.col("_newest"))
    return F.when(issued, F.concat(F.lit("c"), F.col("seq").cast("string"))).otherwise(target)
