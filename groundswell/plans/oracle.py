"""The same results in DuckDB SQL over the given tables.

The SQL is written on its own, mostly by brute force: plain windows over whole
robots, full point-by-point joins, and a recursive walk of the command log.
"""

from __future__ import annotations

RAW = """
telemetry_raw AS (
  SELECT event_id AS seq, ts,
    CASE WHEN event_id % 101 = 0 THEN '' ELSE concat('site-', (user_id % 50) % 4) END AS site_id,
    CASE WHEN event_id % 97 = 0 THEN '' ELSE concat('unit-', lpad(cast(user_id % 50 AS VARCHAR), 2, '0')) END AS robot_id,
    CASE WHEN event_id % 89 = 0 THEN 'dancing' WHEN event_type = 'view' THEN 'idle' WHEN event_type = 'signup' THEN 'drilling'
         WHEN event_type = 'error' THEN 'fault' ELSE 'injecting' END AS state,
    ((event_id * 37) % 481 - 240) / 10::DOUBLE AS x_m,
    ((event_id * 53) % 481 - 240) / 10::DOUBLE AS y_m,
    (event_id % 211)::DOUBLE AS depth_m,
    CASE WHEN event_id % 83 = 0 THEN 'NaN'::DOUBLE ELSE value * 30 END AS injection_pressure_kpa,
    value - 1 AS flow_rate_lpm,
    ((event_id * 7) % 301 - 50) / 4::DOUBLE AS surface_uplift_mm,
    (event_id % 103)::DOUBLE AS battery_pct
  FROM events),
checked AS (
  SELECT *, CASE
    WHEN robot_id = '' THEN 'robot_id' WHEN site_id = '' THEN 'site_id'
    WHEN ts > TIMESTAMP '2024-01-30 12:05:00' THEN 'future_ts'
    WHEN state NOT IN ('idle', 'drilling', 'injecting', 'fault') THEN 'state'
    WHEN isnan(injection_pressure_kpa) THEN 'finite'
    WHEN NOT depth_m BETWEEN 0 AND 200 THEN 'depth_m'
    WHEN NOT injection_pressure_kpa BETWEEN 0 AND 10000 THEN 'injection_pressure_kpa'
    WHEN NOT flow_rate_lpm BETWEEN 0 AND 2000 THEN 'flow_rate_lpm'
    WHEN abs(surface_uplift_mm) > 5000 THEN 'surface_uplift_mm'
    WHEN NOT battery_pct BETWEEN 0 AND 100 THEN 'battery_pct' END AS reason
  FROM telemetry_raw),
explained AS (
  SELECT *, 'invalid sample: ' || CASE reason
    WHEN 'robot_id' THEN 'robot_id is required' WHEN 'site_id' THEN 'site_id is required'
    WHEN 'future_ts' THEN 'ts ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' is more than 5m0s in the future'
    WHEN 'state' THEN 'unknown state "' || state || '"'
    WHEN 'finite' THEN 'injection_pressure_kpa must be finite'
    WHEN 'depth_m' THEN printf('depth_m %.2f outside [0, 200]', depth_m)
    WHEN 'injection_pressure_kpa' THEN printf('injection_pressure_kpa %.1f outside [0, 10000]', injection_pressure_kpa)
    WHEN 'flow_rate_lpm' THEN printf('flow_rate_lpm %.1f outside [0, 2000]', flow_rate_lpm)
    WHEN 'battery_pct' THEN printf('battery_pct %.1f outside [0, 100]', battery_pct) END AS error,
    seq // 50 AS batch_id, seq % 50 AS "index"
  FROM checked),
telemetry AS (SELECT * EXCLUDE (reason) FROM checked WHERE reason IS NULL)
"""

SITE = RAW + """,
latest AS (
  SELECT * FROM telemetry
  QUALIFY row_number() OVER (PARTITION BY site_id, robot_id ORDER BY ts DESC, seq DESC) = 1),
celled AS (
  SELECT *, floor(x_m + 0.5::DOUBLE)::BIGINT AS cell_x, floor(y_m + 0.5::DOUBLE)::BIGINT AS cell_y FROM telemetry),
survey AS (
  SELECT site_id, cell_x, cell_y, x_m AS x, y_m AS y, surface_uplift_mm AS uplift,
    min(seq) OVER (PARTITION BY site_id, cell_x, cell_y) AS first_seq
  FROM celled QUALIFY row_number() OVER (PARTITION BY site_id, cell_x, cell_y ORDER BY seq DESC) = 1),
points AS (
  SELECT site_id, x, y FROM survey UNION ALL SELECT site_id, x_m, y_m FROM latest),
box AS (
  SELECT site_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy,
    greatest(max(x) - min(x), max(y) - min(y), 20::DOUBLE) / 2 + 6 AS half
  FROM points GROUP BY site_id),
scale AS (SELECT site_id, greatest(1::DOUBLE, max(uplift)) AS max_uplift FROM survey GROUP BY site_id)
"""

WELLS = """
wells AS (
  SELECT event_id AS well_id, concat('site-', (user_id % 50) % 4) AS site_id, (event_id % 61 - 30)::DOUBLE AS x,
    ((event_id * 7) % 61 - 30)::DOUBLE AS y, (event_id % 7 + 12)::DOUBLE AS depth_m, value * 100 AS injected_l,
    CASE WHEN event_type IN ('view', 'error') THEN 'active' ELSE 'completed' END AS status
  FROM events),
injections AS (
  SELECT site_id, x, y, depth_m, injected_l / 1000 AS volume_m3 FROM wells WHERE status = 'completed'
  UNION ALL
  SELECT site_id, x, y, depth_m, injected_l / 1000 FROM wells WHERE status = 'active' AND injected_l > 0)
"""

UPLOADS = RAW + """,
full_uploads AS (
  SELECT batch_id, max(ts) AS sent_at, count(*) AS n,
    CASE WHEN batch_id % 29 = 0 OR batch_id % 31 = 0 OR bool_or(isnan(injection_pressure_kpa)) THEN 'malformed' ELSE 'ok' END AS status
  FROM explained GROUP BY batch_id),
uploads AS (
  SELECT * FROM full_uploads
  UNION ALL SELECT -1 - batch_id, sent_at, 0, 'refused' FROM full_uploads WHERE batch_id % 37 = 0),
uploaded AS (
  SELECT e.* EXCLUDE ("index"), row_number() OVER (PARTITION BY batch_id ORDER BY seq) - 1 AS "index"
  FROM explained e JOIN uploads u USING (batch_id)
  WHERE u.status = 'ok')
"""

HTTP = """
http AS (
  SELECT ts AS moment, event_type AS route, CASE WHEN event_id % 10 = 0 THEN 422 ELSE 202 END::BIGINT AS code, value / 100 AS duration_s
  FROM events),
bounds AS (SELECT unnest(['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1', '2.5', '5', '10', 'inf']::DOUBLE[]) AS le)
"""

REQUESTS = """
slots AS (
  SELECT event_id AS seq, TIMESTAMP '2024-01-01' + to_seconds(event_id * 2) AS moment,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'issue' WHEN event_type = 'view' THEN 'next' WHEN event_type = 'click' THEN 'ack'
         WHEN event_id % 3 = 0 THEN 'cancel' ELSE 'next' END AS kind,
    concat('unit-', lpad(cast(user_id % 10 AS VARCHAR), 2, '0')) AS robot_id,
    ['estop', 'set_flow', 'resume', 'clear_fault', 'pause', 'pause', 'pause'][event_id % 7 + 1] AS typ, value
  FROM events),
aimed AS (
  SELECT *, last_value(CASE WHEN kind = 'issue' THEN 'c' || seq END IGNORE NULLS)
    OVER (PARTITION BY robot_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM slots),
requests AS (
  SELECT seq, moment, epoch_ms(moment) AS ms, kind, robot_id,
    CASE WHEN kind = 'issue' THEN 'c' || seq WHEN kind IN ('ack', 'cancel') THEN newest END AS command_id,
    CASE WHEN kind = 'issue' THEN typ END AS type,
    CASE WHEN kind = 'issue' AND typ = 'set_flow' THEN value END AS flow_lpm,
    CASE WHEN kind IN ('issue', 'cancel') THEN 'op-' || (seq % 3) END AS actor,
    CASE WHEN kind = 'ack' THEN CASE WHEN seq % 5 = 0 THEN 'rejected' ELSE 'completed' END END AS ack_status,
    CASE WHEN kind = 'ack' AND seq % 5 = 0 THEN 'pump offline' END AS ack_reason,
    CASE WHEN kind = 'issue' AND typ = 'set_flow' AND NOT (value > 0 AND value <= 250)
         THEN 'set_flow requires params.flow_lpm in (0, 250]' END AS param_error,
    row_number() OVER (PARTITION BY robot_id ORDER BY moment, seq) AS n
  FROM aimed)
"""

_CMD = "STRUCT(id VARCHAR, typ VARCHAR, seq BIGINT, created BIGINT, sent BIGINT)"
_MOVE = "STRUCT(id VARCHAR, typ VARCHAR, cseq BIGINT, was VARCHAR, now VARCHAR, actor VARCHAR, reason VARCHAR, due BIGINT)"
_DEADLINE = "CASE WHEN c.sent IS NOT NULL THEN c.sent + 30000 WHEN c.typ <> 'estop' THEN c.created + 120000 END"
_EXPIRED = f"""list_transform({{src}}, lambda c: {{{{'id': c.id, 'typ': c.typ, 'cseq': c.seq,
      'was': CASE WHEN c.sent IS NULL THEN 'queued' ELSE 'sent' END, 'now': 'expired', 'actor': 'system',
      'reason': CASE WHEN c.sent IS NULL THEN 'not picked up before TTL' ELSE 'robot did not acknowledge' END, 'due': {_DEADLINE}}}}}::{_MOVE})"""


def _move(c: str, was: str, now: str, actor: str, reason: str) -> str:
    return (
        f"{{'id': {c}.id, 'typ': {c}.typ, 'cseq': {c}.seq, 'was': {was}, 'now': {now}, 'actor': {actor}, "
        f"'reason': {reason}, 'due': NULL}}::{_MOVE}"
    )


_NEW = f"{{'id': command_id, 'typ': type, 'seq': seq, 'created': ms, 'sent': NULL}}::{_CMD}"

TRAIL = REQUESTS + f""",
walk(robot_id, n, seq, pending, ok, code, expired, own) AS (
  SELECT DISTINCT robot_id, 0::BIGINT, NULL::BIGINT, []::{_CMD}[], false, NULL::BIGINT, []::{_MOVE}[], []::{_MOVE}[] FROM requests
  UNION ALL
  SELECT robot_id, n, seq,
    CASE WHEN kind = 'issue' AND code IS NULL AND type = 'estop' THEN list_append(list_filter(live, lambda c: c.sent IS NOT NULL), {_NEW})
         WHEN kind = 'issue' AND code IS NULL THEN list_append(live, {_NEW})
         WHEN kind = 'next' AND chosen IS NOT NULL THEN list_transform(live, lambda c:
           {{'id': c.id, 'typ': c.typ, 'seq': c.seq, 'created': c.created, 'sent': CASE WHEN c.id = chosen.id THEN ms ELSE c.sent END}}::{_CMD})
         WHEN kind IN ('ack', 'cancel') AND code IS NULL THEN list_filter(live, lambda c: c.id <> command_id)
         ELSE live END,
    CASE WHEN kind = 'issue' THEN code IS NULL ELSE ok END,
    code, expired,
    CASE WHEN kind = 'issue' AND code IS NULL AND type = 'estop' THEN
           list_append(list_transform(list_filter(live, lambda c: c.sent IS NULL), lambda c: {_move("c", "'queued'", "'cancelled'", "actor", "'superseded by estop'")}),
             {_move(f"({_NEW})", "NULL", "'queued'", "actor", "NULL")})
         WHEN kind = 'issue' AND code IS NULL THEN [{_move(f"({_NEW})", "NULL", "'queued'", "actor", "NULL")}]
         WHEN kind = 'next' AND chosen IS NOT NULL THEN [{_move("chosen", "'queued'", "'sent'", "'robot:' || robot_id", "NULL")}]
         WHEN kind = 'ack' AND code IS NULL THEN [{_move("target", "'sent'", "ack_status", "'robot:' || robot_id", "ack_reason")}]
         WHEN kind = 'cancel' AND code IS NULL THEN [{_move("target", "'queued'", "'cancelled'", "actor", "'cancelled by operator'")}]
         ELSE []::{_MOVE}[] END
  FROM (
    SELECT *, CASE
      WHEN kind = 'issue' AND param_error IS NOT NULL THEN 400
      WHEN kind = 'issue' AND type <> 'estop' AND len(live) >= 20 THEN 429
      WHEN kind IN ('ack', 'cancel') AND NOT ok THEN 404
      WHEN kind = 'ack' AND (target IS NULL OR target.sent IS NULL) THEN 409
      WHEN kind = 'cancel' AND (target IS NULL OR target.sent IS NOT NULL) THEN 409 END::BIGINT AS code
    FROM (
      SELECT *, list_filter(live, lambda c: c.id = command_id)[1] AS target,
        coalesce(list_filter(live, lambda c: c.sent IS NULL AND c.typ = 'estop')[1], list_filter(live, lambda c: c.sent IS NULL)[1]) AS chosen
      FROM (
        SELECT r.*, w.ok,
          list_filter(w.pending, lambda c: coalesce({_DEADLINE} >= r.ms, true)) AS live,
          {_EXPIRED.format(src=f"list_filter(w.pending, lambda c: coalesce({_DEADLINE} < r.ms, false))")} AS expired
        FROM walk w JOIN requests r ON r.robot_id = w.robot_id AND r.n = w.n + 1)))),
overdue AS (
  SELECT robot_id, unnest(expired) AS m FROM walk
  UNION ALL
  SELECT robot_id, unnest({_EXPIRED.format(src=f"list_filter(pending, lambda c: {_DEADLINE} IS NOT NULL)")})
  FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY n DESC) = 1)),
moved AS (
  SELECT robot_id, seq, unnest(own) AS m, generate_subscripts(own, 1) AS k FROM walk),
audit AS (
  SELECT s.moment, m.id AS command_id, o.robot_id, m.typ AS type, m.was AS from_status, m.now AS to_status, m.actor AS actor,
    m.reason AS reason, s.seq AS order_seq, 0::BIGINT AS phase, m.cseq AS ordinal
  FROM (SELECT *, m.due AS due FROM overdue) o ASOF JOIN requests s ON o.due < s.ms
  UNION ALL
  SELECT r.moment, m.id, v.robot_id, m.typ, m.was, m.now, m.actor, m.reason, v.seq, 1, k
  FROM moved v JOIN requests r ON r.seq = v.seq),
commands AS (
  SELECT command_id, min(a.robot_id) AS robot_id, min(a.type) AS type,
    arg_max(to_status, (order_seq, phase, ordinal)) AS status,
    arg_max(reason, (order_seq, phase, ordinal)) FILTER (reason IS NOT NULL) AS reason,
    max(actor) FILTER (to_status = 'queued') AS issued_by,
    min(moment) FILTER (to_status = 'queued') AS created_at, min(moment) FILTER (to_status = 'sent') AS sent_at,
    max(moment) FILTER (to_status NOT IN ('queued', 'sent')) AS finished_at, min(order_seq) AS seq
  FROM audit a GROUP BY command_id),
flows AS (SELECT c.*, r.flow_lpm FROM commands c LEFT JOIN (SELECT command_id, flow_lpm FROM requests WHERE kind = 'issue') r USING (command_id)),
links AS (
  SELECT robot_id, last_poll_at, coalesce(pending, 0) AS pending
  FROM (SELECT robot_id, max(moment) AS last_poll_at FROM requests WHERE kind = 'next' GROUP BY 1)
  FULL JOIN (SELECT robot_id, count(*) FILTER (status IN ('queued', 'sent')) AS pending FROM commands GROUP BY 1) USING (robot_id))
"""

_SAMPLE = "ts, site_id, robot_id, state, x_m, y_m, depth_m, injection_pressure_kpa, flow_rate_lpm, surface_uplift_mm, battery_pct"
_DAYS = "seq, " + _SAMPLE + ", ts::DATE AS ts_date"
_RANGE = "ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts < TIMESTAMP '2024-01-20 18:00:00'"
_RAMP = (
    "['#cde2fb', '#b7d3f6', '#9ec5f4', '#86b6ef', '#6da7ec', '#5598e7', '#3987e5', "
    "'#2a78d6', '#256abf', '#1c5cab', '#184f95', '#104281', '#0d366b']"
)


def _ramp(t: str, dark: bool = False) -> str:
    ramp = f"list_reverse({_RAMP})" if dark else _RAMP
    return f"{ramp}[floor(least(greatest({t}, 0::DOUBLE), 1::DOUBLE) * 12 + 0.5::DOUBLE)::INTEGER + 1]"


def _idw(queries: str) -> str:
    """All pairs of a site; the exact hit first, else the weighted mean inside the radius."""
    return f"""
idw AS (
  SELECT *, coalesce(hit, num / den) AS uplift FROM (
    SELECT site_id, x, y, arg_min(u, first_seq) FILTER (d2 < 1e-9) AS hit,
      sum(u / d2) FILTER (d2 >= 1e-9 AND d2 <= 144) AS num, sum(1 / d2) FILTER (d2 >= 1e-9 AND d2 <= 144) AS den
    FROM (SELECT q.site_id, q.x, q.y, s.uplift AS u, s.first_seq, (s.x - q.x) ** 2 + (s.y - q.y) ** 2 AS d2
          FROM ({queries}) q LEFT JOIN survey s USING (site_id))
    GROUP BY site_id, x, y))"""


def _mogi(volume: str, depth: str, r2: str) -> str:
    return (
        f"CASE WHEN {depth} <= 0 OR {volume} = 0 THEN 0 "
        f"ELSE 0.65::DOUBLE * ({volume}) / pi() * {depth} / pow({r2} + {depth} * {depth}, 1.5::DOUBLE) END"
    )


def _rate(by: str, source: str) -> str:
    group = f"{by}, " if by else ""
    return f"""
steps AS (SELECT {group}time_bucket(INTERVAL '5 seconds', moment, TIMESTAMP '2000-01-01') AS step, count(*) AS n FROM ({source}) GROUP BY ALL),
spread AS (SELECT *, unnest(range(1, 13)) AS k FROM steps)
SELECT {group}step + to_seconds(k * 5) AS window_end, round(sum(n) / 60::DOUBLE, 6) AS rate FROM spread GROUP BY ALL"""


def _histogram(source: str, value: str, by: str) -> str:
    group = f"{by}, " if by else ""
    return f"SELECT {group}le, count(*) FILTER ({value} <= le) AS n FROM ({source}), bounds GROUP BY {group}le"


def _half_away(v: str, places: int) -> str:
    m = f"{10**places}::DOUBLE"
    return f"sign({v}) * floor(abs({v}) * {m} + 0.5::DOUBLE) / {m}"


_SERIES = """
SELECT robot_id, bucket, count(*) AS count, round(avg(p), 4) AS avg_pressure_kpa, max(p) AS max_pressure_kpa,
  round(avg(f), 4) AS avg_flow_lpm, max(u) AS max_uplift_mm, round(coalesce(sum((f + f_prev) / 2 * dt), 0), 4) AS volume_injected_l
FROM (
  SELECT robot_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS bucket, injection_pressure_kpa AS p,
    flow_rate_lpm AS f, surface_uplift_mm AS u, lag(flow_rate_lpm) OVER w AS f_prev,
    (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60e6 AS dt
  FROM telemetry WINDOW w AS (PARTITION BY robot_id ORDER BY ts, seq))
GROUP BY robot_id, bucket"""

_RUNS = """
SELECT robot_id, min(state) AS state, min(ts) AS run_start, max(ts) AS run_end, count(*) AS samples
FROM (
  SELECT *, sum(change) OVER (PARTITION BY robot_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT robot_id, ts, seq, state,
      CASE WHEN lag(state) OVER (PARTITION BY robot_id ORDER BY ts, seq) = state THEN 0 ELSE 1 END AS change
    FROM telemetry))
GROUP BY robot_id, run"""

_HISTORY = "SELECT * FROM telemetry QUALIFY row_number() OVER (PARTITION BY site_id, robot_id ORDER BY ts DESC, seq DESC) <= 120"

_GRID = """
SELECT site_id, x0 + 0.5::DOUBLE AS x, y0 + 0.5::DOUBLE AS y
FROM (SELECT *, unnest(generate_series(floor(cy - half)::BIGINT, ceil(cy + half)::BIGINT - 1)) AS y0
      FROM (SELECT *, unnest(generate_series(floor(cx - half)::BIGINT, ceil(cx + half)::BIGINT - 1)) AS x0 FROM box))"""

_CLOSED = "(SELECT max(ts) - INTERVAL '10 minutes' FROM telemetry)"

_AUDIT = "moment AS \"at\", command_id, robot_id, type, from_status, to_status, actor, reason, order_seq"
_STATE = "command_id, robot_id, type, status, reason, issued_by, created_at, sent_at, finished_at"


def _with(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{body.strip()}"


def _sql() -> dict[str, str]:
    raw: dict[str, str] = {
        "read_samples_ndjson": f"SELECT {_SAMPLE} FROM telemetry",
        "write_telemetry": f"SELECT {_DAYS} FROM telemetry",
        "quarantine": 'SELECT batch_id, "index", reason, error FROM explained WHERE reason IS NOT NULL',
        "telemetry_scan": f"SELECT seq, {_SAMPLE} FROM telemetry WHERE site_id = 'site-1' AND {_RANGE}",
        "expire_partitions": f"SELECT {_DAYS} FROM telemetry WHERE ts >= TIMESTAMP '2024-01-16'",
        "drop_expired": f"SELECT {_DAYS} FROM telemetry WHERE ts >= TIMESTAMP '2024-01-16'",
        "compact_partitions": f"SELECT {_DAYS} FROM telemetry",
        "validate_samples": "SELECT seq, reason IS NULL AS valid, reason, error FROM explained",
        "accepted_samples": f"SELECT seq, {_SAMPLE} FROM telemetry",
        "rejected_samples": 'SELECT batch_id, "index", reason, error FROM explained WHERE reason IS NOT NULL',
        "site_feed": "SELECT site_id, robot_id, seq, ts, state, surface_uplift_mm FROM telemetry WHERE site_id = 'site-1'",
        "series_range": f"SELECT robot_id, seq, ts, flow_rate_lpm FROM telemetry WHERE {_RANGE}",
        "low_battery": "SELECT robot_id, count(*) AS samples, min(ts) AS first_ts, min(battery_pct) AS min_battery_pct "
        "FROM telemetry WHERE battery_pct < 8 GROUP BY robot_id",
        "pressure_trips": "SELECT robot_id, count(*) AS trips, min(ts) AS first_trip, max(injection_pressure_kpa) AS max_pressure_kpa "
        "FROM telemetry WHERE injection_pressure_kpa > 1200 GROUP BY robot_id",
        "robot_series": _SERIES,
        "pressure_panel": "SELECT time_bucket(INTERVAL '1 minute', ts, TIMESTAMP '2000-01-01') AS time, robot_id, "
        "round(avg(injection_pressure_kpa), 4) AS value FROM telemetry GROUP BY ALL",
        "flow_segments": "SELECT robot_id, seq, ts, flow_rate_lpm, dt AS dt_min, f_prev AS flow_prev_lpm, "
        "(flow_rate_lpm + f_prev) / 2 * dt AS segment_l FROM (SELECT *, lag(flow_rate_lpm) OVER w AS f_prev, "
        "(epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60e6 AS dt FROM telemetry WINDOW w AS (PARTITION BY robot_id ORDER BY ts, seq))",
        "robot_history": f"SELECT site_id, robot_id, seq, ts, injection_pressure_kpa FROM ({_HISTORY})",
        "state_runs": _RUNS,
        "last_uplift_gauge": "SELECT site_id, robot_id, arg_max(surface_uplift_mm, seq) AS uplift_mm FROM telemetry GROUP BY ALL",
        "expected_pressure": "SELECT seq, robot_id, ts, round(e, 4) AS expected_kpa, round(injection_pressure_kpa - e, 4) AS residual_kpa FROM ("
        "SELECT *, CASE WHEN flow_rate_lpm <= 0 THEN 0 ELSE 19::DOUBLE * depth_m * 1.15::DOUBLE + 2.4::DOUBLE * flow_rate_lpm "
        "* (1 + pow(least(greatest(battery_pct / 100, 0), 1), 2)) END AS e FROM telemetry)",
        "ramp_bin": f"SELECT seq, {_ramp('surface_uplift_mm / 40')} AS light, {_ramp('surface_uplift_mm / 40', True)} AS dark FROM telemetry",
        "stream_site_feed": "SELECT site_id, robot_id, seq, ts, state, surface_uplift_mm FROM telemetry WHERE site_id = 'site-1'",
        "stream_buckets": "SELECT robot_id, b AS bucket, count(*) AS count, round(avg(injection_pressure_kpa), 4) AS avg_pressure_kpa, "
        "max(injection_pressure_kpa) AS max_pressure_kpa, round(avg(flow_rate_lpm), 4) AS avg_flow_lpm, max(surface_uplift_mm) AS max_uplift_mm, "
        "round(coalesce(sum((flow_rate_lpm + f_prev) / 2 * dt), 0), 4) AS volume_injected_l FROM (SELECT *, "
        "time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '2000-01-01') AS b, lag(flow_rate_lpm) OVER w AS f_prev, "
        "(epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60e6 AS dt FROM telemetry WINDOW w AS (PARTITION BY robot_id ORDER BY ts, seq)) "
        f"WHERE b + INTERVAL '1 hour' <= {_CLOSED} GROUP BY robot_id, b",
    }
    site: dict[str, str] = {
        "stale_robots": "SELECT site_id, robot_id, ts FROM latest WHERE ts < (SELECT make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2) FROM latest) - INTERVAL 15 SECOND",
        "latest_per_robot": f"SELECT seq, {_SAMPLE} FROM latest",
        "sort_by_robot": f"SELECT seq, {_SAMPLE} FROM latest",
        "stream_latest": f"SELECT seq, {_SAMPLE} FROM latest",
        "latest_last_day": "SELECT site_id, robot_id, seq, ts FROM latest WHERE ts > TIMESTAMP '2024-01-29 12:00:00'",
        "survey_cells": "SELECT * FROM survey",
        "stream_survey": "SELECT * FROM survey",
        "survey_cells_by_event": "SELECT site_id, cell_x, cell_y, x_m AS x, y_m AS y, surface_uplift_mm AS uplift, "
        "min(seq) OVER (PARTITION BY site_id, cell_x, cell_y) AS first_seq FROM celled "
        "QUALIFY row_number() OVER (PARTITION BY site_id, cell_x, cell_y ORDER BY ts DESC, seq DESC) = 1",
        "fleet_summary": "SELECT * FROM (SELECT site_id, count(*) AS robots, count(*) FILTER (state = 'injecting') AS injecting, "
        "count(*) FILTER (state = 'fault') AS faulted, round(sum(flow_rate_lpm), 4) AS total_flow_lpm FROM latest GROUP BY site_id) "
        "JOIN (SELECT site_id, greatest(0::DOUBLE, max(uplift)) AS max_uplift_mm FROM survey GROUP BY site_id) USING (site_id)",
        "map_points": "SELECT * FROM points",
        "site_bounds": "SELECT site_id, round(cx - half, 6) AS min_x, round(cx + half, 6) AS max_x, round(cy - half, 6) AS min_y, "
        "round(cy + half, 6) AS max_y FROM box",
        "max_uplift_scale": "SELECT * FROM scale",
        "nearest_robot": "SELECT site_id, x, y, best.robot_id AS robot_id, round(best.d, 6) AS distance_m FROM ("
        "SELECT s.site_id, s.x, s.y, s.cell_x, s.cell_y, min({'d': sqrt((s.x - l.x_m) ** 2 + (s.y - l.y_m) ** 2), 'robot_id': l.robot_id}) "
        "FILTER (sqrt((s.x - l.x_m) ** 2 + (s.y - l.y_m) ** 2) < 20) AS best FROM survey s LEFT JOIN latest l USING (site_id) GROUP BY ALL)",
        "stream_fleet_state": f"""
SELECT l.site_id, l.robot_id, l.ts, l.seq, l.state, l.flow_rate_lpm, h.history_points, h.history_first_seq, coalesce(v.volume_l, 0) AS volume_l
FROM latest l
JOIN (SELECT site_id, robot_id, count(*) AS history_points, arg_min(seq, (ts, seq)) AS history_first_seq FROM ({_HISTORY}) GROUP BY ALL) h
  USING (site_id, robot_id)
LEFT JOIN (
  SELECT site_id, robot_id, round(coalesce(sum((f + f_prev) / 2 * dt), 0), 4) AS volume_l FROM (
    SELECT site_id, robot_id, flow_rate_lpm AS f, lag(flow_rate_lpm) OVER w AS f_prev, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60e6 AS dt
    FROM telemetry WHERE ts <= {_CLOSED} WINDOW w AS (PARTITION BY site_id, robot_id ORDER BY ts, seq))
  GROUP BY ALL) v USING (site_id, robot_id)""",
    }
    uploads: dict[str, str] = {
        "ingest_batches": "SELECT batch_id, status, CASE WHEN status = 'ok' THEN n ELSE 0 END AS samples FROM uploads",
        "batch_response": """
SELECT u.batch_id, CASE WHEN status <> 'ok' THEN 400 WHEN accepted > 0 THEN 202 ELSE 422 END::BIGINT AS code, coalesce(accepted, 0) AS accepted,
  CASE WHEN status = 'ok' THEN coalesce(rejects, '') END AS rejects
FROM uploads u LEFT JOIN (
  SELECT batch_id, count(*) FILTER (reason IS NULL) AS accepted,
    string_agg("index" || ': ' || error, chr(10) ORDER BY "index") FILTER (reason IS NOT NULL) AS rejects
  FROM uploaded GROUP BY batch_id) USING (batch_id)""",
        "ingest_counters": "SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'validation' END AS outcome, count(*) AS n FROM uploaded GROUP BY ALL "
        "UNION ALL SELECT 'malformed', count(*) FROM uploads WHERE status = 'malformed'",
        "batch_size_histogram": "SELECT le, count(*) FILTER (n <= le) AS n FROM (SELECT n FROM uploads WHERE status = 'ok'), "
        "(SELECT unnest(['1', '4', '16', '64', '256', '1024', '4096', 'inf']::DOUBLE[]) AS le) GROUP BY le",
        "store_uploads": f"""SELECT arrival * 8192 + "index" AS seq, {_SAMPLE}, ts::DATE AS ts_date FROM uploaded
  JOIN (SELECT batch_id, row_number() OVER (ORDER BY batch_id) - 1 AS arrival FROM uploads) USING (batch_id) WHERE reason IS NULL""",
        "stream_site_feed_handover": """
SELECT 'seed' AS part, site_id, robot_id, ts, state, surface_uplift_mm FROM uploaded WHERE reason IS NULL AND site_id = 'site-1' AND batch_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY ts DESC) = 1
UNION ALL
SELECT 'follow', site_id, robot_id, ts, state, surface_uplift_mm FROM uploaded WHERE reason IS NULL AND site_id = 'site-1' AND batch_id % 2 <> 0""",
        "stream_ingest": 'SELECT batch_id, "index", reason FROM uploaded',
        "stream_ingest_latest": f"SELECT {_SAMPLE} FROM uploaded WHERE reason IS NULL "
        "QUALIFY row_number() OVER (PARTITION BY site_id, robot_id ORDER BY ts DESC) = 1",
    }
    wells: dict[str, str] = {
        "all_injections": "SELECT site_id, x, y, depth_m, round(volume_m3, 6) AS volume_m3 FROM injections",
        "injected_volume": "SELECT site_id, round(sum(injected_l) / 1000, 4) AS total_m3, count(*) FILTER (status = 'completed') AS wells_done, "
        "count(*) AS wells_total FROM wells GROUP BY site_id",
        "mogi_uplift": f"SELECT well_id, round(({_mogi('injected_l / 1000', 'depth_m', 'x * x + y * y')}) * 1000, 6) AS uplift_mm FROM wells",
    }
    lift = _mogi("i.volume_m3 * 0.55::DOUBLE", "i.depth_m", "((p.x - i.x) ** 2 + (p.y - i.y) ** 2)")
    trail: dict[str, str] = {
        "replay_commands": f"SELECT {_AUDIT}, phase FROM audit",
        "replay_errors": "SELECT seq, code FROM walk WHERE code IS NOT NULL",
        "superseded_by_estop": "SELECT d.command_id, d.robot_id, d.moment AS \"at\", s.command_id AS estop_id FROM audit d JOIN audit s "
        "ON s.robot_id = d.robot_id AND s.order_seq = d.order_seq AND s.type = 'estop' AND s.to_status = 'queued' WHERE d.reason = 'superseded by estop'",
        "audit_current_state": f"SELECT {_STATE} FROM commands",
        "command_latency": "SELECT command_id, (epoch_ms(s) - epoch_ms(q)) / 1000::DOUBLE AS queue_s, (epoch_ms(a) - epoch_ms(s)) / 1000::DOUBLE AS ack_s FROM ("
        "SELECT command_id, min(moment) FILTER (to_status = 'queued') AS q, min(moment) FILTER (to_status = 'sent') AS s, "
        "min(moment) FILTER (to_status IN ('completed', 'rejected')) AS a FROM audit GROUP BY command_id)",
        "audit_log": f"SELECT {_AUDIT} FROM audit ORDER BY order_seq DESC, phase DESC, ordinal DESC LIMIT 200",
        "audit_ring": f"SELECT {_AUDIT} FROM audit ORDER BY order_seq DESC, phase DESC, ordinal DESC LIMIT 10000",
        "next_command": "SELECT robot_id, command_id, type, created_at FROM commands WHERE status = 'queued' "
        "QUALIFY row_number() OVER (PARTITION BY robot_id ORDER BY type <> 'estop', created_at, seq) = 1",
        "get_command": f"SELECT {_STATE}, flow_lpm FROM flows WHERE seq = (SELECT min(seq) FROM commands)",
        "list_commands": f"SELECT {_STATE}, flow_lpm FROM flows WHERE status = 'completed' ORDER BY created_at DESC, seq LIMIT 100",
        "command_log_view": "SELECT created_at, robot_id, type || CASE WHEN flow_lpm <> 0 THEN ' ' || regexp_replace(flow_lpm::VARCHAR, '\\.0$', '') "
        "|| ' L/min' ELSE '' END AS command, status, issued_by FROM (SELECT * REPLACE (coalesce(flow_lpm, 0) AS flow_lpm) FROM flows)",
        "pending_per_robot": "SELECT robot_id, count(*) AS pending FROM commands WHERE status IN ('queued', 'sent') GROUP BY robot_id",
        "known_robots": "SELECT robot_id FROM requests WHERE kind = 'next' UNION SELECT robot_id FROM commands",
        "robot_links": "SELECT * FROM links",
        "stream_commands": "SELECT command_id, arg_max(to_status, (order_seq, phase, ordinal)) AS status, count(*) AS moves, "
        "string_agg(concat(to_status, '|', actor, '|', reason), chr(10) ORDER BY order_seq, phase, ordinal) AS steps FROM audit GROUP BY command_id",
    }
    sql = {n: _with(RAW, b) for n, b in raw.items()}
    sql |= {n: _with(SITE, b) for n, b in site.items()}
    sql |= {n: _with(UPLOADS, b) for n, b in uploads.items()}
    sql |= {n: _with(WELLS, b) for n, b in wells.items()}
    sql |= {n: _with(TRAIL, b, recursive=True) for n, b in trail.items()}
    sql["ingest_rate"] = _with(RAW + "," + _rate("", "SELECT ts AS moment FROM telemetry"), "")
    sql["reject_rate"] = _with(
        UPLOADS + "," + _rate("reason", "SELECT 'validation' AS reason, ts AS moment FROM checked WHERE reason IS NOT NULL "
                              "UNION ALL SELECT 'malformed', sent_at FROM uploads WHERE status = 'malformed'"), "")
    sql["latency_histogram"] = _with(HTTP, _histogram("SELECT * FROM http", "duration_s", "route, code"))
    sql["p95_ingest_latency"] = _with(
        HTTP
        + ", h AS ("
        + _histogram("SELECT *, time_bucket(INTERVAL '5 minutes', moment, TIMESTAMP '2000-01-01') AS window_start FROM http", "duration_s", "route, window_start")
        + "), w AS (SELECT *, coalesce(lag(le) OVER g, 0) AS low, coalesce(lag(n) OVER g, 0) AS below, "
        "0.95::DOUBLE * max(n) OVER (PARTITION BY route, window_start) AS rank FROM h WINDOW g AS (PARTITION BY route, window_start ORDER BY le))",
        "SELECT route, window_start, round(CASE WHEN isinf(le) OR n = below THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 6) AS value "
        "FROM w WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY route, window_start ORDER BY le) = 1",
    )
    sql["idw_interpolate"] = _with(
        SITE + "," + WELLS + "," + _idw("SELECT DISTINCT site_id, x, y FROM wells"), "SELECT site_id, x, y, round(uplift, 6) AS uplift FROM idw"
    )
    sql["uplift_grid"] = _with(
        SITE + "," + _idw(_GRID),
        "SELECT site_id, floor(x)::BIGINT AS x0, floor(y)::BIGINT AS y0, round(uplift, 6) AS uplift, "
        f"{_ramp('uplift / max_uplift')} AS colour FROM idw JOIN scale USING (site_id) WHERE uplift IS NOT NULL",
    )
    sql["uplift_field"] = _with(
        RAW + "," + WELLS,
        f"SELECT p.site_id, p.x, p.y, round(coalesce(sum({lift}), 0) * 1000, 6) AS uplift_mm "
        "FROM (SELECT DISTINCT site_id, x_m AS x, y_m AS y FROM telemetry) p LEFT JOIN injections i USING (site_id) GROUP BY ALL",
    )
    sql["time_bin"] = "SELECT event_id, " + ", ".join(
        f"time_bucket(INTERVAL '{i}', ts, TIMESTAMP '2000-01-01') AS {n}"
        for n, i in (("bin_7m", "7 minutes"), ("bin_90s", "90 seconds"), ("bin_1h", "1 hour"))
    ) + " FROM events"
    sql["round_half_away"] = "SELECT event_id, " + ", ".join(f"{_half_away('(value / 7 - 3)', p)} AS r{p}" for p in (1, 2, 3)) + " FROM events"
    sql["rfc3339_text"] = (
        "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS text, date_trunc('millisecond', ts) AS parsed FROM events"
    )
    sql["valid_command_params"] = _with(REQUESTS, "SELECT seq, kind, type, param_error FROM requests")
    sql["expiry_time"] = _with(
        REQUESTS,
        "SELECT to_timestamp(deadline / 1000)::TIMESTAMP AS deadline, s.moment AS expired_at, s.seq AS sweep_seq "
        "FROM (SELECT DISTINCT ms + 120000 AS deadline FROM requests WHERE kind = 'issue') ASOF JOIN requests s ON deadline < s.ms",
    )
    sql["robot_cards"] = _with(
        SITE + "," + TRAIL,
        f"""SELECT l.site_id, l.robot_id, l.ts, l.state, l.ts < TIMESTAMP '2024-01-30 11:59:45' AS stale, last_poll_at, pending,
  floor((epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(last_poll_at)) / 1000 + 0.5::DOUBLE)::BIGINT AS control_age_s,
  history_points, history_from, history_peak_kpa
FROM latest l LEFT JOIN links USING (robot_id)
LEFT JOIN (SELECT site_id, robot_id, count(*) AS history_points, min(ts) AS history_from, max(injection_pressure_kpa) AS history_peak_kpa
           FROM ({_HISTORY}) GROUP BY ALL) USING (site_id, robot_id)""",
        recursive=True,
    )
    return sql


ORACLE: dict[str, str] = _sql()
