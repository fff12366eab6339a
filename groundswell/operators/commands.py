"""The command lifecycle: request log in, audit trail and current state out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundswell import schema as S
from groundswell.operators.lifecycle import Open, Request, advance, expiry
from groundswell.plans.shared import materialize, parallelism, ship_package
from groundswell.plans.slices import carry_forward, first_after

_MOVES = (
    "robot_id string, command_id string, type string, from_status string, to_status string, actor string, "
    "reason string, at_ms long, due_ms long, order_seq long, phase int, ordinal long, error int, episode long, segment long, "
    "created long, sent long"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
_MOVES_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in _MOVES.split(", "))])
_SEGMENT = ["robot_id", "episode", "segment"]
SEGMENT_ROWS = 100_000  # steps of an episode that are folded in one go
_EXIT = 2  # phase of the rows that tell what is open at the end of a segment
# After this long without a new command, none but an e-stop can be open.
_SETTLED_MS = S.QUEUE_TTL_MS + S.ACK_TIMEOUT_MS


# ---- requests ---------------------------------------------------------------


def _dto_error() -> Column:
    """What is refused at the door, before anything is swept."""
    flow = F.col("params.flow_lpm")
    return F.coalesce(
        F.when((F.col("kind") == "issue") & ~F.coalesce(F.col("type").isin(*S.COMMAND_TYPES), F.lit(False)), "unknown command type"),
        F.when((F.col("kind") == "issue") & (F.isnan(flow) | (F.abs(flow) == float("inf"))), "flow_lpm must be a number"),
        F.when((F.col("kind") == "ack") & ~F.coalesce(F.col("ack_status").isin(*S.ACK_STATUSES), F.lit(False)), "unknown ack status"),
        F.when((F.col("kind") == "ack") & (F.length("ack_reason") > S.MAX_REASON_CHARS), "reason too long"),
    )


def _param_error() -> Column:
    """What an otherwise well-formed issue is refused for, after the sweep."""
    flow = F.col("params.flow_lpm")
    setpoint = (F.col("type") == "set_flow") & ~F.coalesce((flow > 0) & (flow <= S.MAX_SETPOINT_LPM), F.lit(False))
    return F.when(
        F.col("kind") == "issue",
        F.when(setpoint, f"set_flow requires params.flow_lpm in (0, {S.MAX_SETPOINT_LPM:.0f}]").when(
            # A parameter that is given as null is given; without any the struct is null.
            (F.col("type") != "set_flow") & F.col("params").isNotNull(), F.concat(F.col("type"), F.lit(" takes no params"))
        ),
    )


def valid_command_params(requests: DataFrame) -> DataFrame:
    """Every request with `param_error`, null when it is acceptable."""
    return requests.withColumn("param_error", F.coalesce(_dto_error(), _param_error()))


def sweeps(requests: DataFrame) -> DataFrame:
    """The requests that expire stale commands on their way in (`at, seq`)."""
    return requests.where(F.col("kind").isin(*S.SWEEPING_KINDS) & _dto_error().isNull()).select("at", "seq")


def expiry_time(deadlines: DataFrame, requests: DataFrame) -> DataFrame:
    """`at` of each deadline with the first sweep strictly after it (`mark_at, mark_seq`)."""
    return first_after(deadlines, sweeps(requests))


# ---- replay -----------------------------------------------------------------


class Replay(NamedTuple):
    audit: DataFrame
    errors: DataFrame


def _ms(col: str) -> Column:
    return F.unix_millis(col)


def _episodes(requests: DataFrame) -> DataFrame:
    """Issues and polls with `episode`, a stretch of a robot's log that starts with nothing open.

    A robot may own a third of the log, so its log is cut where no state crosses:
    at an issue more than 150 s after the previous one (anything but an e-stop has
    then run out), if a poll more than 30 s earlier has taken a waiting e-stop away.
    Polls that cannot deliver anything are left out: those later than the queue
    TTL after the newest issue, except the first poll after it.
    """
    rows = requests.where(F.col("kind").isin("issue", "next"))
    rows = carry_forward(rows, ["robot_id"], {"_prev": F.when(F.col("kind") == "issue", F.struct("at", "seq"))}, ts="at")
    rows = materialize(rows, "requests-ordered")
    polls = rows.where((F.col("kind") == "next") & F.col("_prev").isNotNull())
    first_poll = polls.groupBy("robot_id", F.col("_prev.seq").alias("_prev_seq")).agg(
        F.min(F.struct("at", "seq")).alias("_poll"), F.min("_prev.at").alias("_prev_at")
    )
    issues = rows.where(F.col("kind") == "issue").withColumn("_prev_seq", F.col("_prev.seq"))
    issues = issues.join(first_poll.drop("_prev_at"), ["robot_id", "_prev_seq"], "left")
    settled = (_ms("at") - _ms("_prev.at") > _SETTLED_MS) & (_ms("at") - _ms("_poll.at") > S.ACK_TIMEOUT_MS)
    starts = F.col("_prev").isNull() | F.coalesce(settled, F.lit(False))
    issues = issues.withColumn("first_of_episode", F.when(starts, F.col("seq"))).drop("_prev", "_poll", "_prev_seq")
    prompt = polls.where(_ms("at") - _ms("_prev.at") <= S.QUEUE_TTL_MS).drop("_prev")
    tardy = first_poll.where(_ms("_poll.at") - _ms("_prev_at") > S.QUEUE_TTL_MS).select(
        "robot_id", "_poll.at", "_poll.seq", F.lit("next").alias("kind")
    )
    both = issues.unionByName(prompt, allowMissingColumns=True).unionByName(tardy, allowMissingColumns=True)
    return carry_forward(both, ["robot_id"], {"episode": F.col("first_of_episode")}, ts="at", inclusive=True).drop(
        "first_of_episode"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_MOVES_ARROW)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, _MOVES_ARROW, strict=True)], schema=_MOVES_ARROW
    )


def _values(column: pa.Array) -> list:
    """As `to_pylist`, but without a scalar object for each value where there is a shorter way."""
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of a sorted partition, one after another, each from the commands that are open at its start.

    Only open commands stay in memory.  The last rows of a segment say what is open at its end, in the form of the expiry it would come to.
    Most segments are short, so they share batches: a call of Python for each costs more than its steps.
    """
    key: tuple | None = None
    pending: list[Open] = []
    last = (0, -1)

    def row(m, r, phase, ordinal):
        at, seq = (None, None) if m.due is not None else (r.at_ms, r.seq)
        c = m.command
        return key[0], c.id, c.type, m.before, m.after, m.actor, m.reason, at, m.due, seq, phase, ordinal, None, key[1], key[2], None, None

    def ends():
        # A waiting e-stop has no deadline.
        return [(*row(expiry(c), Request(c.seq, *[None] * 8), _EXIT, c.seq)[:-2], c.created, c.sent) for c in pending]

    for batch in batches:
        out = []
        columns = [_values(batch.column(f)) for f in (*_SEGMENT, "created", "sent", *Request._fields)]
        for robot_id, episode, segment, created, sent, *values in zip(*columns, strict=True):
            if (robot_id, episode, segment) != key:
                out += ends()
                key, pending, last = (robot_id, episode, segment), [], (0, -1)
            r = Request(*values)
            if created is not None:
                pending.append(Open(r.command_id, r.type, r.seq, created, sent))
                continue
            if (r.at_ms, r.seq) < last:
                raise RuntimeError("requests of a segment must arrive in order")
            last = (r.at_ms, r.seq)
            pending, moves, error = advance(pending, r, robot_id)
            for i, m in enumerate(moves):
                due = m.due is not None
                out.append(row(m, r, 0 if due else 1, m.command.seq if due else i))
            if error is not None:
                out.append((robot_id, r.command_id, r.type, None, None, r.actor, None, r.at_ms, None, r.seq, 1, 0, error, episode, segment, None, None))
        yield _batch(out)
    yield _batch(ends())


def _segments(steps: DataFrame) -> DataFrame:
    """Add `segment`: an episode of more than SEGMENT_ROWS steps is cut into equal spans of time with about so many each."""
    cuts = (
        steps.groupBy("robot_id", "episode")
        .agg(F.count("*").alias("n"), F.min("at_ms").alias("_from"), F.max("at_ms").alias("_to"))
        .where(F.col("n") > SEGMENT_ROWS)
        .select("robot_id", "episode", "_from", "_to", F.ceil(F.col("n") / F.lit(SEGMENT_ROWS)).alias("_cuts"))
    )
    cuts = materialize(cuts, "cuts")  # at most rows / SEGMENT_ROWS entries
    part = F.floor((F.col("at_ms") - F.col("_from")) * F.col("_cuts") / (F.col("_to") - F.col("_from") + 1))
    return steps.join(cuts, ["robot_id", "episode"], "left").withColumn("segment", F.coalesce(part, F.lit(0).cast("long"))).drop("_from", "_to", "_cuts")


def _run_segments(steps: DataFrame, entries: DataFrame | None) -> DataFrame:
    rows = steps if entries is None else steps.unionByName(entries, allowMissingColumns=True)
    dealt = rows.repartition(parallelism(steps.sparkSession), *_SEGMENT).sortWithinPartitions(
        *_SEGMENT, F.col("created").isNull(), F.when(F.col("created").isNull(), F.col("at_ms")), "seq"
    )
    return materialize(dealt.mapInArrow(_fold, _MOVES), "moves")


def _fold_segments(steps: DataFrame) -> DataFrame:
    """The moves of all segments, each from the commands its predecessor leaves open.

    Segments run side by side, first from nothing. Those whose predecessor turns out to leave something else open than was
    assumed run again, until nothing changes: then every segment has followed from the one before, as if in one go.
    Queues forget: a command is gone 150 s after it was issued, so a wrong start seldom reaches the end of a segment, and few
    rounds are needed; each costs no more than the segments that changed.
    """
    steps = steps.withColumns({"created": F.lit(None).cast("long"), "sent": F.lit(None).cast("long")})
    moves = _run_segments(steps, None)
    ends = moves.where(F.col("phase") == _EXIT)
    order = Window.partitionBy("robot_id", "episode").orderBy("segment")
    following = steps.select(*_SEGMENT).distinct().withColumn("_next", F.lead("segment").over(order)).where(F.col("_next").isNotNull())
    following = materialize(following, "segments-that-go-on")
    if following.isEmpty():
        return moves
    # What stays open at the end of a segment that goes on is an entry of the next one, and no expiry.
    assumed = None
    while True:
        entries = ends.join(following, _SEGMENT).select(
            "robot_id", "episode", F.col("_next").alias("segment"), F.lit("open").alias("kind"), "command_id", "type",
            F.col("ordinal").alias("seq"), "created", "sent",
        )
        entries = materialize(entries, "entries")
        signature = F.sort_array(F.collect_list(F.struct("seq", "command_id", "created", F.coalesce("sent", F.lit(-1)))))  # a queue's open commands
        now = entries.groupBy(*_SEGMENT).agg(signature.alias("now"))
        before = entries.where("false") if assumed is None else assumed
        before = before.groupBy(*_SEGMENT).agg(signature.alias("before"))
        changed = materialize(now.join(before, _SEGMENT, "full").where(~F.col("now").eqNullSafe(F.col("before"))).select(*_SEGMENT), "changed")
        if changed.isEmpty():
            last = following.select(*_SEGMENT, F.lit(True).alias("_goes_on"))
            moves = moves.join(last, _SEGMENT, "left")
            return materialize(moves.where((F.col("phase") != _EXIT) | F.col("_goes_on").isNull()).drop("_goes_on"), "all-moves")
        again = _run_segments(steps.join(changed, _SEGMENT, "left_semi"), entries.join(changed, _SEGMENT, "left_semi"))
        moves = materialize(moves.join(changed, _SEGMENT, "left_anti").unionByName(again), "moves-so-far")
        ends, assumed = moves.where(F.col("phase") == _EXIT), entries


def replay_commands(requests: DataFrame, stored: bool = False) -> Replay:
    """Walk the request log: the audit trail and the refused requests.

    `stored` says that `requests` is a table, which costs little to read again.
    Statuses depend on the robot's own requests only; the time of an expiry is that
    of the first request of anyone after the deadline, found by `expiry_time`.
    """
    ship_package(requests.sparkSession)
    requests = requests.withColumn("at", F.timestamp_millis(F.unix_millis("at")))
    requests = requests if stored else materialize(requests, "requests")
    refused = requests.where(_dto_error().isNotNull())
    log = requests.where(_dto_error().isNull())
    own = materialize(_episodes(log), "episodes")
    attempts = own.where(F.col("kind") == "issue").select(
        "command_id", F.col("robot_id").alias("_robot"), "episode", F.col("type").alias("_type"), F.col("at").alias("_issued")
    )
    aimed = log.where(F.col("kind").isin("ack", "cancel"))
    # A null id cannot match; it stays out of the join so that it forms no hot key.
    known = materialize(aimed.where(F.col("command_id").isNotNull()).drop("type", "params").join(attempts, "command_id", "left"), "aimed")
    late = (_ms("at") - _ms("_issued") > _SETTLED_MS) & (F.col("_type") != "estop")
    routed = known.where(F.col("_robot").isNotNull() & ~late).withColumn("robot_id", F.col("_robot"))
    routed = routed.drop("_robot", "_type", "_issued")
    steps = own.unionByName(routed, allowMissingColumns=True)
    steps = steps.select(
        "robot_id", "episode", "seq", _ms("at").alias("at_ms"), "kind", "command_id", "type",
        _param_error().alias("param_error"), "actor", "ack_status", "ack_reason",
    )
    moves = _fold_segments(_segments(materialize(steps, "routed-steps")))
    # What is open at the end of an episode runs out; a waiting e-stop does not.
    moves = moves.where((F.col("phase") != _EXIT) | F.col("due_ms").isNotNull())
    moves = moves.withColumn("phase", F.when(F.col("phase") == _EXIT, 0).otherwise(F.col("phase"))).drop("episode", "segment", "created", "sent")
    columns = ["at", "command_id", "robot_id", "type", "from_status", "to_status", "actor", "reason", "order_seq", "phase", "ordinal"]
    done = moves.where(F.col("to_status").isNotNull())
    timed = done.where(F.col("due_ms").isNull()).withColumn("at", F.timestamp_millis("at_ms")).select(*columns)
    overdue = done.where(F.col("due_ms").isNotNull()).drop("order_seq").withColumn("due", F.timestamp_millis("due_ms"))
    swept = expiry_time(overdue.select(F.col("due").alias("at")), log)
    expired = overdue.join(swept.withColumnRenamed("at", "due"), "due").select(
        F.col("mark_at").alias("at"), "command_id", "robot_id", "type", "from_status", "to_status", "actor", "reason",
        F.col("mark_seq").alias("order_seq"), "phase", "ordinal",
    )
    audit = materialize(timed.unionByName(expired), "audit")

    # Too late to change anything: refused as finished, or as unknown if the attempt itself was refused.
    queued = timed.where(F.col("to_status") == "queued").select("command_id", F.lit(True).alias("_created"))
    tardy = known.where(late).join(queued, "command_id", "left").withColumn(
        "code", F.when(F.col("_created"), 409).otherwise(404)
    )
    unknown = aimed.where(F.col("command_id").isNull()).select("seq").unionByName(known.where(F.col("_robot").isNull()).select("seq"))
    # A target that is not open is finished (409) if it was admitted before, else unknown (404).
    admitted = timed.where(F.col("to_status") == "queued").groupBy("command_id").agg(F.min(F.struct(_ms("at"), "order_seq")).alias("_admitted"))
    missed = moves.where(F.col("error") == 409).join(admitted, "command_id", "left")
    before = F.coalesce(F.col("_admitted") < F.struct("at_ms", "order_seq"), F.lit(False))
    parts = [
        moves.where(F.col("error") != 409).select(F.col("order_seq").alias("seq"), F.col("error").alias("code")),
        missed.select(F.col("order_seq").alias("seq"), F.when(before, 409).otherwise(404).alias("code")),
        tardy.select("seq", "code"),
        unknown.select("seq", F.lit(404).alias("code")),
        refused.select("seq", F.lit(400).alias("code")),
    ]
    errors = parts[0]
    for part in parts[1:]:
        errors = errors.unionByName(part)
    return Replay(audit, errors)


# ---- state derived from the trail --------------------------------------------


def _order() -> Column:
    return F.struct("order_seq", "phase", "ordinal")


def audit_current_state(audit: DataFrame) -> DataFrame:
    """Current status of each command; a reason survives later moves that have none."""
    terminal = F.col("to_status").isin(*S.TERMINAL)
    return audit.groupBy("command_id").agg(
        F.min("robot_id").alias("robot_id"),
        F.min("type").alias("type"),
        F.max_by("to_status", _order()).alias("status"),
        F.max_by("reason", F.when(F.col("reason").isNotNull(), _order())).alias("reason"),
        F.max_by("actor", F.when(F.col("to_status") == "queued", _order())).alias("issued_by"),
        F.min(F.when(F.col("to_status") == "queued", F.col("at"))).alias("created_at"),
        F.min(F.when(F.col("to_status") == "sent", F.col("at"))).alias("sent_at"),
        F.max(F.when(terminal, F.col("at"))).alias("finished_at"),
        F.min("order_seq").alias("seq"),
    )


def commands_table(audit: DataFrame, requests: DataFrame) -> DataFrame:
    """Current state of each command with the flow it was issued with."""
    flows = requests.where((F.col("kind") == "issue") & F.col("params").isNotNull()).select(
        "command_id", F.col("params.flow_lpm").alias("flow_lpm")
    )
    return audit_current_state(audit).join(flows, "command_id", "left")


def next_command(commands: DataFrame) -> DataFrame:
    """Per robot the command a poll would deliver: an e-stop first, else the oldest."""
    waiting = commands.where(F.col("status") == "queued")
    rank = F.struct((F.col("type") != "estop").alias("late"), "created_at", "seq")
    return waiting.groupBy("robot_id").agg(F.min_by(F.struct("command_id", "type", "created_at"), rank).alias("c")).select(
        "robot_id", "c.*"
    )


def get_command(commands: DataFrame, command_id: str) -> DataFrame:
    return commands.where(F.col("command_id") == command_id)


def list_commands(
    commands: DataFrame, robot_id: str | None = None, status: str | None = None, limit: int = 100
) -> DataFrame:
    """Newest first; commands of one instant in the order of issue.  `limit` is clamped to 1..500."""
    if status is not None and status not in S.COMMAND_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    if robot_id:
        commands = commands.where(F.col("robot_id") == robot_id)
    if status:
        commands = commands.where(F.col("status") == status)
    return commands.orderBy(F.desc("created_at"), "seq").limit(min(max(limit, 1), 500))


def audit_log(audit: DataFrame, limit: int = 200) -> DataFrame:
    """The newest entries, newest first.  `limit` is clamped to 1..1000."""
    newest = [F.desc("order_seq"), F.desc("phase"), F.desc("ordinal")]
    return audit.orderBy(*newest).limit(min(max(limit, 1), 1000))


def command_log_view(commands: DataFrame) -> DataFrame:
    """What the log shows: time, robot, command with its flow, status and issuer."""
    flow = F.when(F.col("flow_lpm") != 0, F.concat(_plain(F.col("flow_lpm")), F.lit(" L/min")))
    return commands.select(
        "created_at", "robot_id", F.concat_ws(" ", "type", flow).alias("command"), "status", "issued_by"
    )


def _plain(number: Column) -> Column:
    """Shortest decimal text, without `.0` for whole numbers."""
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def pending_per_robot(commands: DataFrame) -> DataFrame:
    return commands.where(~F.col("status").isin(*S.TERMINAL)).groupBy("robot_id").agg(F.count("*").alias("pending"))


def known_robots(requests: DataFrame, commands: DataFrame) -> DataFrame:
    """Robots that ever polled or were ever sent a command."""
    polled = requests.where(F.col("kind") == "next").select("robot_id")
    return polled.union(commands.select("robot_id")).distinct()


def robot_links(requests: DataFrame, commands: DataFrame) -> DataFrame:
    """Last poll and open commands of each known robot."""
    polls = requests.where(F.col("kind") == "next").groupBy("robot_id").agg(F.max("at").alias("last_poll_at"))
    terminal = F.col("status").isin(*S.TERMINAL)
    owned = commands.groupBy("robot_id").agg(F.count_if(~terminal).alias("pending"))
    return polls.join(owned, "robot_id", "full").fillna({"pending": 0})


def command_latency(audit: DataFrame) -> DataFrame:
    """Seconds in the queue and seconds until the robot answered."""

    def first(status: Column) -> Column:
        return F.min(F.when(status, _ms("at")))

    to = F.col("to_status")
    times = audit.groupBy("command_id").agg(
        first(to == "queued").alias("created"), first(to == "sent").alias("sent"),
        first(to.isin(*S.ACK_STATUSES)).alias("answered"),
    )
    return times.select(
        "command_id", ((F.col("sent") - F.col("created")) / 1000).alias("queue_s"), ((F.col("answered") - F.col("sent")) / 1000).alias("ack_s")
    )


def superseded_by_estop(audit: DataFrame) -> DataFrame:
    """Commands an e-stop took out of the queue, with that e-stop.

    Both happen in the same request, so this is an equi-join on (robot, request).
    """
    stops = audit.where((F.col("type") == "estop") & (F.col("to_status") == "queued")).select(
        "robot_id", "order_seq", F.col("command_id").alias("estop_id")
    )
    dropped = audit.where((F.col("to_status") == "cancelled") & (F.col("reason") == "superseded by estop"))
    return dropped.join(stops, ["robot_id", "order_seq"]).select("command_id", "robot_id", "at", "estop_id")


def audit_ring(audit: DataFrame, keep: int = S.AUDIT_RING) -> DataFrame:
    """Only the newest `keep` entries, as the service holds them."""
    newest = [F.desc("order_seq"), F.desc("phase"), F.desc("ordinal")]
    return audit.orderBy(*newest).limit(keep)
