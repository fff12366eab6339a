"""The command queue as two chained stateful streams: by command id, then by robot."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from groundswell.operators.commands import _dto_error, _param_error
from groundswell.operators.lifecycle import Open, Request, advance, expiry
from groundswell.plans.shared import by_value, ship_package
from groundswell.streaming.arrival import arrow_schema, by_arrival, values

MOVES = (
    "command_id string, robot_id string, type string, from_status string, to_status string, actor string, "
    "reason string, at_ms long, command_seq long, step long"
)
_NAMES = [part.split()[0] for part in MOVES.split(", ")]
STEPS = "robot_id string, seq long, at_ms long, kind string, command_id string, type string, param_error string, actor string, ack_status string, ack_reason string"
_STEP_NAMES = [part.split()[0] for part in STEPS.split(", ")]
_STEP_ROWS = arrow_schema(STEPS)
_REQUEST_ROWS = pa.schema([_STEP_ROWS.field(f) for f in Request._fields])
ROUTER_BUCKETS = 1024  # of command ids; fixed, as a stream's state outlives a session
KNOWN_IDS = 50_000  # that a call of the router keeps at hand
OUT_ROWS = 10_000


class CommandRouter(StatefulProcessor):
    """Per bucket of command ids: which robot each was issued to. Acks and cancels leave with that robot; those of an unknown id end here.

    A call of Python costs milliseconds and an entry of state a fraction of one, so ids share buckets and only their entries are their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.robots = handle.getMapState("robots", "command_id string", "robot_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.robots.exists()
        known: dict[str, str | None] = {}
        for block in by_arrival(rows, _STEP_ROWS):
            robots = []
            for kind, command_id, robot in values(block, ("kind", "command_id", "robot_id")):
                if command_id not in known:
                    if len(known) >= KNOWN_IDS:
                        known.clear()
                        held = True  # what this call has learned is among the entries
                    known[command_id] = self.robots.getValue((command_id,))[0] if held and self.robots.containsKey((command_id,)) else None
                if kind == "issue" and known[command_id] is None and robot is not None:
                    known[command_id] = robot
                    self.robots.updateValue((command_id,), (robot,))
                robots.append(robot if kind == "issue" else known[command_id])
            routed = block.set_column(block.schema.get_field_index("robot_id"), "robot_id", pa.array(robots, pa.string()))
            yield routed.filter(routed.column("robot_id").is_valid()).to_pandas(integer_object_nulls=True)

    def close(self) -> None:
        pass


class RobotQueue(StatefulProcessor):
    """Per robot: its open commands as a typed list; a timer stands for the earliest deadline.

    `step` counts the robot's moves, so the trail keeps its order across epochs.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "id string, type string, seq long, created long, sent long")
        self.step = handle.getValueState("step", "step long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        steps = chain.from_iterable(values(block, Request._fields) for block in by_arrival(rows, _REQUEST_ROWS))
        requests = (Request(int(seq), int(at_ms), *rest) for seq, at_ms, *rest in steps)
        yield from self._apply(key[0], requests, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._apply(key[0], [], timerValues.getCurrentWatermarkInMs())

    def _apply(self, robot_id: str, requests: Iterable[Request], now: int) -> Iterator[pd.DataFrame]:
        pending = [Open(*c) for c in self.open.get()] if self.open.exists() else []
        step = self.step.get()[0] if self.step.exists() else 0
        out = []

        def emit(move, at_ms):
            c = move.command
            out.append((c.id, robot_id, c.type, move.before, move.after, move.actor, move.reason, at_ms, c.seq, step + len(out)))

        for r in requests:
            pending, moves, _ = advance(pending, r, robot_id)
            for move in moves:
                emit(move, r.at_ms)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=_NAMES)
                step += len(out)
                out.clear()
        for c in [c for c in pending if c.deadline is not None and c.deadline < now]:
            emit(expiry(c), now)
            pending.remove(c)
        if pending:
            self.open.put([tuple(c) for c in pending])
        elif self.open.exists():
            self.open.clear()
        self.step.update((step + len(out),))
        due = min((c.deadline for c in pending if c.deadline is not None), default=None)
        if due is not None:
            at = max(due, now) + 1
            if not any(now < t <= at for t in self.handle.listTimers()):
                self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def stream_commands(requests: DataFrame, delay: str) -> DataFrame:
    """Transitions as they happen (append mode); the session must use the RocksDB state store (`stateful_session`).

    No request is lost, however late: requests are applied in the order of arrival (`seq`), each at its own time, as long as
    triggers follow that order.  The clock that expires commands of silent robots runs `delay` behind the newest request of anyone.

    An ack or cancel needs no robot: the first operator learns from the issue whose command it is, and what it sends on reaches
    the second one in the same trigger.  An id keeps the robot of its first issue.  An expiry is
    stamped with the robot's next request or with the watermark, whichever finds it
    first; the batch replay stamps it with the next request of anyone.
    """
    ship_package(requests.sparkSession)
    # Spark drops rows behind the watermark.  Each request therefore comes twice: a tick with
    # its time, which moves the watermark and ends here, and the request without, which is never late.
    twice = requests.where(_dto_error().isNull()).select("*", F.explode(F.array(F.lit(None).cast("timestamp"), F.col("at"))).alias("_clock"))
    # What later filters ask for depends on the clock, else they would be moved below the watermark and keep ticks from it.
    settled = {c: F.when(F.col("_clock").isNull(), F.col(c)) for c in ("robot_id", "kind", "command_id")}
    steps = (
        twice.withWatermark("_clock", delay)
        .where(F.col("_clock").isNull())
        .select(
            settled["robot_id"].alias("robot_id"), "seq", F.unix_millis("at").alias("at_ms"), settled["kind"].alias("kind"),
            settled["command_id"].alias("command_id"), "type", _param_error().alias("param_error"), "actor", "ack_status", "ack_reason",
        )
    )
    named = F.col("kind").isin("issue", "ack", "cancel") & F.col("command_id").isNotNull()
    with by_value():
        dealt = steps.where(named).withColumn("bucket", F.pmod(F.xxhash64("command_id"), F.lit(ROUTER_BUCKETS)))
        routed = dealt.groupBy("bucket").transformWithStateInPandas(CommandRouter(), STEPS, "append", "eventtime")
        both = routed.unionByName(steps.where(F.col("kind") == "next")).where(F.col("robot_id").isNotNull())
        return both.groupBy("robot_id").transformWithStateInPandas(RobotQueue(), MOVES, "append", "eventtime")
