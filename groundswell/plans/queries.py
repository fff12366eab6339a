"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import date, datetime, timedelta
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.functions import columns as fn
from groundswell.operators import commands as C
from groundswell.operators import fleet, ingest, metrics, spatial
from groundswell.operators import timeseries as ts
from groundswell.plans.shared import fresh_path, materialize, shared_dir, store
from groundswell.sources import adapters as A
from groundswell.sources import batches as B
from groundswell.sources import tables
from groundswell.session import beside
from groundswell.sources.trail import StoredTrail
from groundswell.streaming import commands as stream_commands_mod
from groundswell.streaming import sinks, stateful
from groundswell.streaming import telemetry as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
SCAN_START, SCAN_END = datetime(2024, 1, 5, 6), datetime(2024, 1, 20, 18)
TODAY = date(2024, 1, 30)
SITE = "site-1"
STREAM_DELAY = "10 minutes"
TRIGGER_BYTES = 1 << 30  # a trigger takes no more, so its state and sorts stay bounded


def utc_session(spark: SparkSession) -> SparkSession:
    """The caller's session, or one beside it if the caller's has another time zone, whose settings stay as they are."""
    if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC"):
        return spark
    return beside(spark, {"spark.sql.session.timeZone": "UTC"})


def query(f: Query) -> Query:
    """Register under the function's name; timestamps leave as plain UTC date-times."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = f(utc_session(spark), sf_dir)
        return df.select(
            *[
                F.col(c.name).cast("timestamp_ntz").alias(c.name) if isinstance(c.dataType, T.TimestampType) else F.col(c.name)
                for c in df.schema
            ]
        )

    QUERIES[f.__name__] = run
    return run


def _r(col: Column | str, places: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, places)


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n, places) for n in names})


# ---- sources and sinks --------------------------------------------------------


@query
def ingest_batches(spark, sf):
    return B.batch_status(A.sample_batches(spark, sf))


@query
def read_samples_ndjson(spark, sf):
    path = fresh_path(spark, "ndjson")
    rows = A.telemetry(spark, sf).select(A.format_rfc3339_us("ts").alias("ts"), *[c for c in tables.COLUMNS if c not in ("seq", "ts")])
    rows.write.json(path)
    return B.read_samples_ndjson(spark, path)


@query
def write_telemetry(spark, sf):
    path = fresh_path(spark, "telemetry")
    tables.write_telemetry(A.telemetry(spark, sf), path)
    return tables.read_telemetry(spark, path)


@query
def store_uploads(spark, sf):
    path = fresh_path(spark, "telemetry")
    tables.store_uploads(A.sample_batches(spark, sf), A.now(), path)
    return tables.read_telemetry(spark, path)


@query
def quarantine(spark, sf):
    path = fresh_path(spark, "quarantine")
    tables.quarantine(A.batch_rows(spark, sf), A.now(), path)
    return spark.read.parquet(path).select("batch_id", "index", "reason", "error")


def _stored(spark, sf) -> str:
    path = fresh_path(spark, "telemetry")
    tables.write_telemetry(A.telemetry(spark, sf), path)
    return path


@query
def telemetry_scan(spark, sf):
    return tables.telemetry_scan(spark, _stored(spark, sf), SCAN_START, SCAN_END, SITE)


@query
def expire_partitions(spark, sf):
    table = tables.read_telemetry(spark, _stored(spark, sf))
    return tables.expire_partitions(table, TODAY, keep_days=14)


@query
def drop_expired(spark, sf):
    name = f"telemetry_{uuid.uuid4().hex}"
    days = tables.read_telemetry(spark, _stored(spark, sf))
    days.write.partitionBy("ts_date").option("path", fresh_path(spark, "telemetry-days")).saveAsTable(name)
    tables.drop_expired(spark, name, TODAY, keep_days=14)
    return spark.table(name)


@query
def compact_partitions(spark, sf):
    """Two runs a week apart: the second one takes up the days that turned cold between them."""
    path, out = _stored(spark, sf), fresh_path(spark, "compacted")
    tables.compact_partitions(spark, path, out, TODAY - timedelta(days=7))
    tables.compact_partitions(spark, path, out, TODAY)
    return tables.read_compacted(spark, path, out)


# ---- validation and filters ---------------------------------------------------


@query
def validate_samples(spark, sf):
    return ingest.validate_samples(A.telemetry_raw(spark, sf), A.now()).select("seq", "valid", "reason", "error")


@query
def accepted_samples(spark, sf):
    return ingest.accepted_samples(A.telemetry_raw(spark, sf), A.now())


@query
def rejected_samples(spark, sf):
    return ingest.rejected_samples(A.batch_rows(spark, sf), A.now())


@query
def batch_response(spark, sf):
    out = ingest.upload_responses(B.uploaded_rows(A.sample_batches(spark, sf)), A.now())
    rejects = F.transform("rejected", lambda r: F.concat(r["index"].cast("string"), F.lit(": "), r["error"]))
    return out.select(
        "batch_id", F.col("code").cast("long").alias("code"), "accepted",
        F.when(F.col("code") != 400, F.array_join(rejects, "\n")).alias("rejects"),
    )


@query
def site_feed(spark, sf):
    return ts.site_feed(A.telemetry(spark, sf), SITE).select("site_id", "robot_id", "seq", "ts", "state", "surface_uplift_mm")


@query
def series_range(spark, sf):
    return ts.series_range(A.telemetry(spark, sf), SCAN_START, SCAN_END).select("robot_id", "seq", "ts", "flow_rate_lpm")


@query
def stale_robots(spark, sf):
    """At the middle between the oldest and the newest of the latest samples, so that some robots are stale and some are not."""
    latest = ts.latest_per_robot(A.telemetry(spark, sf))
    ends = latest.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    now = F.timestamp_micros(F.lit((ends.a + ends.b) // 2))
    return fleet.stale_robots(latest, now).select("site_id", "robot_id", "ts")


@query
def low_battery(spark, sf):
    return fleet.low_battery(A.telemetry(spark, sf))


@query
def pressure_trips(spark, sf):
    return fleet.pressure_trips(A.telemetry(spark, sf))


# ---- time series --------------------------------------------------------------


@query
def latest_per_robot(spark, sf):
    return ts.latest_per_robot(A.telemetry(spark, sf))


@query
def sort_by_robot(spark, sf):
    return ts.sort_by_robot(ts.latest_per_robot(A.telemetry(spark, sf)))


@query
def latest_last_day(spark, sf):
    return ts.latest_per_robot(A.telemetry(spark, sf), now=A.now(), max_age="1 DAY").select("site_id", "robot_id", "seq", "ts")


@query
def robot_series(spark, sf):
    out = ts.robot_series(A.telemetry(spark, sf), START, END, "6h")
    return _rounded(out, 4, "avg_pressure_kpa", "avg_flow_lpm", "volume_injected_l")


@query
def pressure_panel(spark, sf):
    return _rounded(ts.pressure_panel(A.telemetry(spark, sf), START, END), 4, "value")


@query
def flow_segments(spark, sf):
    return ts.flow_segments(A.telemetry(spark, sf))


@query
def robot_history(spark, sf):
    return ts.robot_history(A.telemetry(spark, sf)).select("site_id", "robot_id", "seq", "ts", "injection_pressure_kpa")


@query
def state_runs(spark, sf):
    return ts.state_runs(A.telemetry(spark, sf))


# ---- the site -----------------------------------------------------------------


def _survey(spark, sf):
    return fleet.survey_cells(A.telemetry(spark, sf))


def _map_points(spark, sf):
    return fleet.map_points(_survey(spark, sf), ts.latest_per_robot(A.telemetry(spark, sf)))


@query
def survey_cells(spark, sf):
    return _survey(spark, sf)


@query
def survey_cells_by_event(spark, sf):
    return fleet.survey_cells(A.telemetry(spark, sf), order="event")


@query
def fleet_summary(spark, sf):
    out = fleet.fleet_summary(ts.latest_per_robot(A.telemetry(spark, sf)), _survey(spark, sf))
    return _rounded(out, 4, "total_flow_lpm")


@query
def map_points(spark, sf):
    return _map_points(spark, sf)


@query
def site_bounds(spark, sf):
    return _rounded(fleet.site_bounds(_map_points(spark, sf)), 6, "min_x", "max_x", "min_y", "max_y")


@query
def max_uplift_scale(spark, sf):
    return fleet.max_uplift_scale(_survey(spark, sf))


@query
def last_uplift_gauge(spark, sf):
    return fleet.last_uplift_gauge(A.telemetry(spark, sf))


@query
def robot_cards(spark, sf):
    trail = _control(spark, sf)
    cards = fleet.robot_cards(A.telemetry(spark, sf), C.robot_links(trail.polls, trail.commands), A.now())
    return cards.select(
        "site_id", "robot_id", "ts", "state", "stale", "last_poll_at", "pending", "control_age_s",
        F.size("history").cast("long").alias("history_points"),
        F.element_at("history", 1)["ts"].alias("history_from"),
        F.array_max(F.transform("history", lambda p: p["injection_pressure_kpa"])).alias("history_peak_kpa"),
    )


@query
def idw_interpolate(spark, sf):
    places = A.wells(spark, sf).select("site_id", "x", "y").distinct()
    return _rounded(spatial.idw_interpolate(_survey(spark, sf), places), 6, "uplift")


@query
def uplift_grid(spark, sf):
    survey = materialize(_survey(spark, sf), "survey")
    bounds = fleet.site_bounds(fleet.map_points(survey, ts.latest_per_robot(A.telemetry(spark, sf))))
    grid = spatial.uplift_grid(survey, bounds, fleet.max_uplift_scale(survey))
    return _rounded(grid, 6, "uplift")


@query
def nearest_robot(spark, sf):
    places = _survey(spark, sf).select("site_id", "x", "y")
    return _rounded(spatial.nearest_robot(ts.latest_per_robot(A.telemetry(spark, sf)), places), 6, "distance_m")


@query
def uplift_field(spark, sf):
    places = A.telemetry(spark, sf).select("site_id", F.col("x_m").alias("x"), F.col("y_m").alias("y")).distinct()
    return _rounded(spatial.uplift_field(places, spatial.all_injections(A.wells(spark, sf))), 6, "uplift_mm")


@query
def all_injections(spark, sf):
    return _rounded(spatial.all_injections(A.wells(spark, sf)), 6, "volume_m3")


@query
def injected_volume(spark, sf):
    return _rounded(spatial.injected_volume(A.wells(spark, sf)), 4, "total_m3")


# ---- service metrics ----------------------------------------------------------


@query
def ingest_counters(spark, sf):
    return ingest.ingest_counters(B.uploaded_rows(A.sample_batches(spark, sf)), A.now())


@query
def ingest_rate(spark, sf):
    return _rounded(metrics.windowed_rate(A.telemetry(spark, sf), "ts"), 6, "rate")


@query
def reject_rate(spark, sf):
    bad = ingest.validate_samples(A.telemetry_raw(spark, sf), A.now()).where(~F.col("valid"))
    malformed = B.batch_status(A.sample_batches(spark, sf), keep=["sent_at"]).where(F.col("status") == "malformed")
    events = bad.select(F.lit("validation").alias("reason"), F.col("ts").alias("at")).unionByName(
        malformed.select(F.lit("malformed").alias("reason"), F.col("sent_at").alias("at"))
    )
    return _rounded(metrics.windowed_rate(events, "at", ["reason"]), 6, "rate")


@query
def batch_size_histogram(spark, sf):
    return metrics.batch_size_histogram(B.batch_status(A.sample_batches(spark, sf)))


@query
def latency_histogram(spark, sf):
    return metrics.latency_histogram(A.http_requests(spark, sf))


@query
def p95_ingest_latency(spark, sf):
    return _rounded(metrics.p95_latency(A.http_requests(spark, sf)), 6, "value")


# ---- scalar functions ---------------------------------------------------------


@query
def time_bin(spark, sf):
    ev = A.events(spark, sf)
    bins = {"bin_7m": 420, "bin_90s": 90, "bin_1h": 3600}
    return ev.select("event_id", *[fn.time_bin("ts", s).alias(n) for n, s in bins.items()])


@query
def mogi_uplift(spark, sf):
    w = A.wells(spark, sf)
    lift = fn.mogi_uplift_m(F.col("injected_l") / 1000.0, F.col("depth_m"), F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return w.select("well_id", _r(lift * 1000, 6).alias("uplift_mm"))


@query
def expected_pressure(spark, sf):
    out = spatial.pressure_residual(A.telemetry(spark, sf), F.col("battery_pct") / 100)
    return _rounded(out, 4, "expected_kpa", "residual_kpa")


@query
def round_half_away(spark, sf):
    ev = A.events(spark, sf)
    return ev.select("event_id", *[fn.round_half_away(F.col("value") / 7 - 3, p).alias(f"r{p}") for p in (1, 2, 3)])


@query
def ramp_bin(spark, sf):
    t = F.col("surface_uplift_mm") / 40
    return A.telemetry(spark, sf).select("seq", fn.ramp_colour(t).alias("light"), fn.ramp_colour(t, dark=True).alias("dark"))


@query
def rfc3339_text(spark, sf):
    ev = A.events(spark, sf)
    text = fn.format_rfc3339("ts")
    return ev.select("event_id", text.alias("text"), fn.parse_rfc3339(text).alias("parsed"))


# ---- commands -----------------------------------------------------------------

def _control(spark, sf) -> StoredTrail:
    """The stored trail, brought up to date with the log first."""
    name = hashlib.sha256(f"{spark.sparkContext.applicationId} {sf}".encode()).hexdigest()[:16]
    trail = StoredTrail(spark, f"{shared_dir(spark)}/groundswell/trail-{name}")
    return trail.refresh(A.command_requests(spark, sf), A.events(spark, sf))


@query
def valid_command_params(spark, sf):
    return C.valid_command_params(A.command_requests(spark, sf)).select("seq", "kind", "type", "param_error")


@query
def replay_commands(spark, sf):
    audit = C.replay_commands(A.command_requests(spark, sf)).audit
    return audit.drop("ordinal").withColumn("phase", F.col("phase").cast("long"))


@query
def replay_errors(spark, sf):
    return C.replay_commands(A.command_requests(spark, sf)).errors.select("seq", F.col("code").cast("long").alias("code"))


@query
def expiry_time(spark, sf):
    requests = A.command_requests(spark, sf)
    issued = requests.where(F.col("kind") == "issue")
    deadlines = issued.select(F.timestamp_millis(F.unix_millis("at") + C.S.QUEUE_TTL_MS).alias("at")).distinct()
    return C.expiry_time(deadlines, requests).withColumnsRenamed({"at": "deadline", "mark_at": "expired_at", "mark_seq": "sweep_seq"})


@query
def superseded_by_estop(spark, sf):
    return C.superseded_by_estop(_control(spark, sf).audit)


@query
def audit_current_state(spark, sf):
    return C.audit_current_state(_control(spark, sf).audit).drop("seq")


@query
def command_latency(spark, sf):
    return C.command_latency(_control(spark, sf).audit)


@query
def audit_log(spark, sf):
    return C.audit_log(_control(spark, sf).audit).drop("ordinal", "phase")


@query
def audit_ring(spark, sf):
    return C.audit_ring(_control(spark, sf).audit).drop("ordinal", "phase")


@query
def next_command(spark, sf):
    return C.next_command(_control(spark, sf).commands)


@query
def get_command(spark, sf):
    """The first command that was admitted."""
    commands = _control(spark, sf).commands
    first = commands.agg(F.min_by("command_id", "seq").alias("id")).first().id
    return C.get_command(commands, first).drop("seq")


@query
def list_commands(spark, sf):
    return C.list_commands(_control(spark, sf).commands, status="completed").drop("seq")


@query
def command_log_view(spark, sf):
    return C.command_log_view(_control(spark, sf).commands)


@query
def pending_per_robot(spark, sf):
    return C.pending_per_robot(_control(spark, sf).commands)


@query
def known_robots(spark, sf):
    trail = _control(spark, sf)
    return C.known_robots(trail.polls, trail.commands)


@query
def robot_links(spark, sf):
    trail = _control(spark, sf)
    return C.robot_links(trail.polls, trail.commands)


# ---- streams, run to the end of what is there ---------------------------------


def _sample_stream(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    files = spark.readStream.schema(schema).option("maxBytesPerTrigger", TRIGGER_BYTES)
    ev = files.parquet(f"{sf}/events.parquet*")  # a stream reads folders or patterns
    raw = A.raw_samples(ev.withColumn("ts", F.col("ts").cast("timestamp")))
    return ingest.accepted_samples(raw, A.now())


def _ingested(spark, sf) -> str:
    uploads = A.sample_batches(spark, sf).select("batch_id", "body", "received_at")
    source = spark.readStream.schema(uploads.schema).parquet(store(uploads, "uploads"))
    path, checkpoint = sinks.scratch(spark, "stream-ingest")
    st.stream_ingest(source, f"{path}/accepted", f"{path}/rejected", checkpoint)
    return path


@query
def stream_ingest_latest(spark, sf):
    """From JSON uploads through the streamed table to the latest samples; all times differ, so `seq` decides nothing."""
    return ts.latest_per_robot(tables.read_telemetry(spark, f"{_ingested(spark, sf)}/accepted")).drop("seq", "ts_date")


@query
def stream_ingest(spark, sf):
    path = _ingested(spark, sf)
    good = spark.read.parquet(f"{path}/accepted").withColumn("reason", F.lit(None).cast("string"))
    bad = spark.read.parquet(f"{path}/rejected")
    return good.select("batch_id", "index", "reason").unionByName(bad.select("batch_id", "index", "reason"))


@query
def stream_site_feed(spark, sf):
    path, checkpoint = sinks.scratch(spark, "stream-feed")
    feed = st.stream_site_feed(_sample_stream(spark, sf), SITE).select("site_id", "robot_id", "seq", "ts", "state", "surface_uplift_mm")
    sinks.run_to_table(feed, path, checkpoint)
    return spark.read.schema(feed.schema).parquet(path)


@query
def stream_site_feed_handover(spark, sf):
    """Half of the uploads are stored before the feed begins and half after; what the viewer is shown, by its two halves."""
    uploads = A.sample_batches(spark, sf)
    path = fresh_path(spark, "telemetry")
    tables.store_uploads(uploads.where("batch_id % 2 = 0"), A.now(), path)
    feed = st.site_feed(spark, path, SITE)
    seed = materialize(feed.seed, "feed-seed")
    tables.store_uploads(uploads.where("batch_id % 2 <> 0"), A.now(), path)
    out, checkpoint = sinks.scratch(spark, "feed-follow")
    sinks.run_to_table(feed.follow, out, checkpoint)
    shown = seed.withColumn("part", F.lit("seed")).unionByName(spark.read.schema(feed.follow.schema).parquet(out).withColumn("part", F.lit("follow")))
    return shown.select("part", "site_id", "robot_id", "ts", "state", "surface_uplift_mm")


def _epochs(spark, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    path, checkpoint = sinks.scratch(spark, name)
    sinks.run_epochs(stream, sinks.merging_writer(path, keys), checkpoint)
    return sinks.read_merged(spark, path, stream.schema, keys)


@query
def stream_latest(spark, sf):
    return _epochs(spark, st.stream_latest(_sample_stream(spark, sf)), "stream-latest", ["site_id", "robot_id"])


@query
def stream_survey(spark, sf):
    return _epochs(spark, st.stream_survey(_sample_stream(spark, sf)), "stream-survey", ["site_id", "cell_x", "cell_y"])


@query
def stream_buckets(spark, sf):
    path, checkpoint = sinks.scratch(spark, "stream-buckets")
    buckets = stateful.stream_buckets(_sample_stream(stateful.stateful_session(spark), sf), 3600, STREAM_DELAY)
    sinks.run_to_table(buckets, path, checkpoint)
    return _rounded(spark.read.schema(buckets.schema).parquet(path), 4, "avg_pressure_kpa", "avg_flow_lpm", "volume_injected_l")


@query
def stream_fleet_state(spark, sf):
    states = stateful.stream_fleet_state(_sample_stream(stateful.stateful_session(spark), sf), STREAM_DELAY)
    path, checkpoint = sinks.scratch(spark, "stream-fleet")
    sinks.run_epochs(states, sinks.epoch_writer(path), checkpoint)
    out = sinks.newest(sinks.read_epochs(spark, path, states.schema), ["site_id", "robot_id"])
    return out.select(
        "site_id", "robot_id", F.timestamp_micros("latest_us").alias("ts"), F.col("latest_seq").alias("seq"), "state", "flow_rate_lpm",
        F.size("history").cast("long").alias("history_points"),
        F.element_at("history", 1)["seq"].alias("history_first_seq"),
        _r("volume_l", 4).alias("volume_l"),
    )


@query
def stream_commands(spark, sf):
    """Acks and cancels name their command only."""
    anonymous = F.when(~F.col("kind").isin("ack", "cancel"), F.col("robot_id"))
    requests = A.command_requests(spark, sf).withColumn("robot_id", anonymous)
    source = stateful.stateful_session(spark).readStream.schema(requests.schema).parquet(store(requests, "command-requests"))
    moves = stream_commands_mod.stream_commands(source, delay="0 seconds")
    path, checkpoint = sinks.scratch(spark, "stream-commands")
    sinks.run_to_table(moves, path, checkpoint)
    trail = spark.read.schema(moves.schema).parquet(path)
    step = F.concat_ws("|", "to_status", F.coalesce("actor", F.lit("")), F.coalesce("reason", F.lit("")))
    # A command has at most three moves.
    steps = F.sort_array(F.collect_list(F.struct("step", step.alias("s"))))["s"]
    return trail.groupBy("command_id").agg(
        F.max_by("to_status", "step").alias("status"), F.count("*").alias("moves"), F.array_join(steps, "\n").alias("steps")
    )
