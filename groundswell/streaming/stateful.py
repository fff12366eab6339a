"""Stateful folds of the sample stream: fleet state without loss, and buckets with litres.

Both keep typed list, map and value state and event-time timers (`transformWithState`), so the session must use the RocksDB
state store; `stateful_session` gives one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from groundswell import schema as S
from groundswell.plans.shared import by_value, ship_package
from groundswell.session import beside

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Together for the stores of an executor, outside its heap; else each takes two write buffers of 64 MB and a cache.
_BOUNDED = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200"}
SPAN_US = 300_000_000  # settled flows are kept in pieces of five minutes


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside the caller's, whose own settings stay as they are.

    Each state partition is a store of its own that every trigger opens, so there are no more of them than cores.
    """
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return beside(spark, {_STORE: _ROCKS, "spark.sql.shuffle.partitions": str(partitions), **_BOUNDED})


def litres(a: tuple, b: tuple) -> float:
    """Trapezoid of two `(ts_us, seq, flow)`."""
    return (a[2] + b[2]) / 2 * (b[0] - a[0]) / 60e6


def _rows(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return [r for f in frames for r in zip(*[f[c].tolist() for c in columns], strict=True)]


class _Timed(StatefulProcessor):
    """Samples wait in a list until the watermark has passed them; one timer stands for the earliest.

    The list is read only when the watermark has reached its earliest row, whose time is kept beside it, and a row that
    the watermark has already passed never enters it.
    """

    WAITING = "ts_us long, seq long, flow double, pressure double, uplift double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.WAITING)
        self.earliest = handle.getValueState("earliest", "ts_us long")

    def hold(self, rows: list[tuple], watermark_us: int) -> list[tuple]:
        """Put rows on the list; returns, in order, those that the watermark has passed."""
        ready = [r for r in rows if r[0] <= watermark_us]
        rest = [r for r in rows if r[0] > watermark_us]
        first = self.next_waiting()
        if first is not None and first <= watermark_us:
            held = [tuple(r) for r in self.waiting.get()]
            ready += [r for r in held if r[0] <= watermark_us]
            rest += [r for r in held if r[0] > watermark_us]
            first = None
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
                self.earliest.clear()
        elif rest:
            self.waiting.appendList(rest)
        if rest:
            self.earliest.update((min([r[0] for r in rest] + ([] if first is None else [first])),))
        return sorted(ready)

    def wake(self, at_us: int, watermark_us: int) -> None:
        due = max(at_us, watermark_us) // 1000 + 1
        # A timer that has just fired is still listed.
        if not any(watermark_us // 1000 < t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def next_waiting(self) -> int | None:
        if self.earliest.exists():
            return self.earliest.get()[0]
        # State from before the time was kept.
        return min((r[0] for r in self.waiting.get()), default=None) if self.waiting.exists() else None

    def close(self) -> None:
        pass


# ---- fleet state --------------------------------------------------------------

FLEET_STATE = (
    "site_id string, robot_id string, latest_us long, latest_seq long, state string, flow_rate_lpm double, "
    "history array<struct<ts_us:long,seq:long,pressure:double>>, volume_l double, unplaced long"
)


class FleetFold(_Timed):
    """Per site and robot; every row counts, however late.

    Settled flows stay in the map `settled`, a piece of time each, for `keep_us` behind the newest: a row that comes after the
    watermark has passed its time finds its neighbours there, and the segment between them is split.  A row older than
    that still enters the history and the latest; as its litres cannot be placed, it is counted in `unplaced`.
    """

    def __init__(self, keep_us: int | None) -> None:
        self.keep_us = keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.latest = handle.getValueState("latest", "ts_us long, seq long, state string, flow double")
        self.history = handle.getListState("history", "ts_us long, seq long, pressure double")
        self.settled = handle.getMapState("settled", "span long", "rows array<struct<ts_us:long,seq:long,flow:double>>")
        self.sums = handle.getValueState("sums", "ts_us long, seq long, flow double, litres double, unplaced long, oldest long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows, "ts_us", "seq", "flow_rate_lpm", "injection_pressure_kpa", "state")
        newest = max(new, key=lambda r: r[:2])
        if not self.latest.exists() or newest[:2] >= tuple(self.latest.get()[:2]):
            self.latest.update((newest[0], newest[1], newest[4], newest[2]))
        old = [tuple(r) for r in self.history.get()] if self.history.exists() else []
        self.history.put(sorted(old + [(r[0], r[1], r[3]) for r in new])[-S.HISTORY_LEN :])
        yield self._fold(key, [(*r[:4], 0.0) for r in new], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._fold(key, [], timerValues)

    def _fold(self, key, new: list[tuple], timerValues) -> pd.DataFrame:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        last, total, unplaced, oldest = None, 0.0, 0, None
        if self.sums.exists():
            ts, seq, flow, total, unplaced, oldest = self.sums.get()
            last = (ts, seq, flow)
        late = sorted(r[:3] for r in new if last is not None and r[:2] < last[:2])
        for row in late:
            before, after = self._neighbours(row, last)
            if before is None and oldest is not None:  # what came before it is forgotten
                unplaced += 1
                continue
            total += litres(row, after) + (litres(before, row) - litres(before, after) if before else 0.0)
            self._keep([row], last)
        ready, settled = self.hold([r for r in new if last is None or r[:2] >= last[:2]], watermark), last
        for row in (r[:3] for r in ready):
            total += litres(last, row) if last else 0.0
            last = row
        self._keep([r[:3] for r in ready], settled)
        oldest = self._forget(settled, last, oldest)
        if last is not None:
            self.sums.update((*last, total, unplaced, oldest))
        if (due := self.next_waiting()) is not None:
            self.wake(due, watermark)
        ts, seq, state, flow = self.latest.get()
        history = [{"ts_us": r[0], "seq": r[1], "pressure": r[2]} for r in self.history.get()]
        row = (*key, ts, seq, state, flow, history, total, unplaced)
        return pd.DataFrame([row], columns=[p.split()[0] for p in FLEET_STATE.split(", ")])

    def _piece(self, span: int) -> list[tuple]:
        return [tuple(r) for r in self.settled.getValue((span,))[0]] if self.settled.containsKey((span,)) else []

    def _keep(self, rows: list[tuple], newest: tuple | None) -> None:
        """Add to the pieces; none lies behind that of the `newest` settled row, so those need no look."""
        pieces: dict[int, list[tuple]] = {}
        for r in rows:
            pieces.setdefault(r[0] // SPAN_US, []).append(r)
        for span, more in pieces.items():
            own = self._piece(span) if newest is not None and span <= newest[0] // SPAN_US else []
            self.settled.updateValue((span,), (sorted(own + more),))

    def _neighbours(self, row: tuple, last: tuple) -> tuple[tuple | None, tuple]:
        """The settled rows around a late one; there always is one after it."""
        span = row[0] // SPAN_US
        own = self._piece(span)
        at = bisect_left(own, row)
        before, after = own[at - 1] if at else None, own[at] if at < len(own) else None
        if before is None or after is None:
            spans = sorted(k[0] for k in self.settled.keys())
            here = bisect_left(spans, span)
            if before is None and here:
                before = self._piece(spans[here - 1])[-1]
            if after is None:
                beyond = [s for s in spans[here : here + 2] if s > span]
                after = self._piece(beyond[0])[0] if beyond else last
        return before, after

    def _forget(self, before: tuple | None, last: tuple | None, oldest: int | None) -> int | None:
        """Drop pieces behind `keep_us`, when a new piece has begun; returns the first piece that is kept, once any was dropped."""
        if self.keep_us is None or before is None or before[0] // SPAN_US == last[0] // SPAN_US:
            return oldest
        limit = (last[0] - self.keep_us) // SPAN_US
        gone = [k[0] for k in self.settled.keys() if k[0] < limit]
        for span in gone:
            self.settled.removeKey((span,))
        return limit if gone else oldest


def stream_fleet_state(samples: DataFrame, delay: str = "10 minutes", keep_days: float | None = 7.0) -> DataFrame:
    """Per site and robot: latest, bounded history, litres of what the watermark has passed, rows too late to be placed (update mode).

    Spark drops rows behind the watermark.  Each sample therefore comes twice: a tick with its time, which moves
    the watermark and ends here, and the sample without an event time, which is never late.
    """
    ship_package(samples.sparkSession)
    twice = samples.select("*", F.explode(F.array(F.lit(None).cast("timestamp"), F.col("ts"))).alias("_clock"))
    rows = twice.withWatermark("_clock", delay).where(F.col("_clock").isNull()).select(
        "_clock", "site_id", "robot_id", F.unix_micros("ts").alias("ts_us"), "seq", "state", "flow_rate_lpm", "injection_pressure_kpa"
    )
    keep_us = None if keep_days is None else int(keep_days * 86_400_000_000)
    with by_value():
        return rows.groupBy("site_id", "robot_id").transformWithStateInPandas(FleetFold(keep_us), FLEET_STATE, "update", "eventtime")


# ---- buckets ------------------------------------------------------------------

BUCKETS = (
    "robot_id string, bucket_us long, count long, avg_pressure_kpa double, max_pressure_kpa double, avg_flow_lpm double, "
    "max_uplift_mm double, volume_injected_l double"
)


class BucketFold(_Timed):
    """Per robot: samples are taken in order behind the watermark; the last one of a bucket is carried into the next."""

    def __init__(self, width_us: int, origin_us: int) -> None:
        self.width_us, self.origin_us = width_us, origin_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.carry = handle.getValueState("carry", "ts_us long, seq long, flow double")
        self.open = handle.getValueState("open", "start long, n long, sum_p double, max_p double, sum_f double, max_u double, litres double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = _rows(rows, "ts_us", "seq", "flow_rate_lpm", "injection_pressure_kpa", "surface_uplift_mm")
        yield self._fold(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._fold(key, [], timerValues)

    def _fold(self, key, new: list[tuple], timerValues) -> pd.DataFrame:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        last = tuple(self.carry.get()) if self.carry.exists() else None
        now = list(self.open.get()) if self.open.exists() else None
        out = []

        def shut() -> None:
            start, n, sum_p, max_p, sum_f, max_u, volume = now
            out.append((key[0], start, n, sum_p / n, max_p, sum_f / n, max_u, volume))

        for ts, seq, flow, p, u in self.hold(new, watermark):
            start = ts - (ts - self.origin_us) % self.width_us
            if now is not None and now[0] != start:
                shut()
                now = None
            if now is None:
                now = [start, 0, 0.0, p, 0.0, u, 0.0]
            row = (ts, seq, flow)
            now = [start, now[1] + 1, now[2] + p, max(now[3], p), now[4] + flow, max(now[5], u), now[6] + (litres(last, row) if last else 0.0)]
            last = row
        if now is not None and now[0] + self.width_us <= watermark:
            shut()
            now = None
        if last is not None:
            self.carry.update(last)
        if now is not None:
            self.open.update(tuple(now))
        elif self.open.exists():
            self.open.clear()
        due = [t for t in (self.next_waiting(), now and now[0] + self.width_us) if t is not None]
        if due:
            self.wake(min(due), watermark)
        return pd.DataFrame(out, columns=[part.split()[0] for part in BUCKETS.split(", ")])


def stream_buckets(samples: DataFrame, bucket_s: int, delay: str = "10 minutes") -> DataFrame:
    """Closed buckets per robot with the litres injected (append mode), as `robot_series` has them.

    A bucket closes when the watermark reaches its end; samples behind the watermark come too late for it and are dropped.
    """
    ship_package(samples.sparkSession)
    rows = samples.withWatermark("ts", delay).select(
        "ts", "robot_id", F.unix_micros("ts").alias("ts_us"), "seq", "flow_rate_lpm", "injection_pressure_kpa", "surface_uplift_mm"
    )
    fold = BucketFold(bucket_s * 1_000_000, S.BIN_ORIGIN_S * 1_000_000)
    with by_value():
        closed = rows.groupBy("robot_id").transformWithStateInPandas(fold, BUCKETS, "append", "eventtime")
    return closed.select("robot_id", F.timestamp_micros("bucket_us").alias("bucket"), *[p.split()[0] for p in BUCKETS.split(", ")[2:]])
