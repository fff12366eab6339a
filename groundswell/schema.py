"""Row schemas and the fixed values the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: limits, names and intervals that results depend on -------

STATES = ("idle", "drilling", "injecting", "fault")
MAX_DEPTH_M = 200
MAX_PRESSURE_KPA = 10_000
MAX_FLOW_LPM = 2_000
MAX_UPLIFT_MM = 5_000
MAX_BATTERY_PCT = 100
MAX_CLOCK_SKEW_S = 300

MAX_BODY_BYTES = 1 << 20
MAX_BATCH = 5_000

MAX_SERIES_SPAN_S = 31 * 86_400
MIN_BUCKET_S = 1
MAX_BUCKETS = 10_000
BIN_ORIGIN_S = 946_684_800  # 2000-01-01T00:00:00Z

HISTORY_LEN = 120
STALE_AFTER_S = 15
LOW_BATTERY_PCT = 8.0
PRESSURE_LIMIT_KPA = 1_200.0

POISSON = 0.35
VOLUME_EFFICIENCY = 0.55
OVERBURDEN_KPA_PER_M = 19.0
BREAKDOWN_FACTOR = 1.15
RESISTANCE_KPA_PER_LPM = 2.4

IDW_POWER = 2.0
IDW_RADIUS_M = 12.0
IDW_HIT_D2 = 1e-9
BOUNDS_PAD_M = 6.0
BOUNDS_MIN_SPAN_M = 20.0
BOUNDS_EMPTY_M = 30.0
PICK_LIMIT_M = 20.0

RAMP = (
    "#cde2fb", "#b7d3f6", "#9ec5f4", "#86b6ef", "#6da7ec", "#5598e7", "#3987e5",
    "#2a78d6", "#256abf", "#1c5cab", "#184f95", "#104281", "#0d366b",
)

COMMAND_TYPES = ("pause", "resume", "estop", "clear_fault", "set_flow")
COMMAND_STATUSES = ("queued", "sent", "completed", "rejected", "cancelled", "expired")
TERMINAL = ("completed", "rejected", "cancelled", "expired")
ACK_STATUSES = ("completed", "rejected")
SWEEPING_KINDS = ("issue", "next", "ack", "cancel", "list", "links")
MAX_REASON_CHARS = 500
MAX_SETPOINT_LPM = 250.0
QUEUE_TTL_MS = 120_000
ACK_TIMEOUT_MS = 30_000
MAX_PENDING = 20
AUDIT_RING = 10_000

BATCH_SIZE_BOUNDS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

COMPRESS_AFTER_DAYS = 7
RETAIN_DAYS = 365

# ---------------------------------------------------------------------------

NUMERIC_FIELDS = (
    "x_m", "y_m", "depth_m", "injection_pressure_kpa", "flow_rate_lpm",
    "surface_uplift_mm", "battery_pct",
)
TEXT_FIELDS = ("robot_id", "site_id", "ts", "state")

SAMPLE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("site_id", T.StringType()),
        T.StructField("robot_id", T.StringType()),
        T.StructField("state", T.StringType()),
        *[T.StructField(name, T.DoubleType()) for name in NUMERIC_FIELDS],
    ]
)

TELEMETRY = T.StructType([T.StructField("seq", T.LongType()), *SAMPLE.fields])

COMMAND_REQUESTS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("robot_id", T.StringType()),
        T.StructField("command_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("params", T.StructType([T.StructField("flow_lpm", T.DoubleType())])),
        T.StructField("actor", T.StringType()),
        T.StructField("ack_status", T.StringType()),
        T.StructField("ack_reason", T.StringType()),
    ]
)
