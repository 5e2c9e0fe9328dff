"""Alert states and repeat suppression over streams of evaluations and notifications, in the order of their ticks.

Rows of one key may come in any order, from any file.  They wait in the key's state until the watermark has passed
them, a timer wakes the key, and what is due is taken in the order of ticks; rows that come after that are dropped and
counted by Spark (``windows.late_rows``).  A key's state leaves the store when it says nothing any more: an alert that
is not pending or firing, a notification whose repeat interval is over.  So the store holds what is under way, not every
key there ever was, and a restart goes on where the query stopped.

Batch twins: ``alerts.alert_transitions`` and ``alerts.suppress_repeats``.  Timers need the RocksDB state store: start
such queries inside :func:`timer_store`, or set it for the session.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from telemill.functions.timegrid import MICROS

DEFAULT_DELAY = "10 minutes"
TRANSITION_COLUMNS = (
    "fingerprint string, rule_name string, state string, tick_us bigint, starts_us bigint, ends_us bigint, value double"
)
SENT_COLUMNS = "fingerprint string, channel string, state string, tick_us bigint"


@contextmanager
def timer_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, on the executors' disks; others keep the session's store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class InOrder(StatefulProcessor):
    """Keeps rows until the watermark has passed them, then hands them on one by one, in order, each tick once."""

    row: tuple[str, ...]  # columns of a waiting row, the tick first
    waiting_schema: str
    state_schema: str
    output: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [tuple(r) for batch in rows for r in batch[list(self.row)].astype(object).itertuples(index=False)]
        if fresh:
            self.waiting.appendList(fresh)
            self._wake_at(min(r[0] for r in fresh))
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = {r[0]: tuple(r) for r in self.waiting.get()} if self.waiting.exists() else {}
        due = sorted(t for t in rows if t <= passed)
        out: list[tuple] = []
        if due:
            state = tuple(self.state.get()) if self.state.exists() else None
            for tick in due:
                state = self.advance(key, state, rows[tick], out)
            if state is None:
                self.state.clear()
            else:
                self.state.update(state)
        left = sorted(t for t in rows if t > passed)
        if left:
            self.waiting.put([rows[t] for t in left])
            self._wake_at(left[0])
        else:
            self.waiting.clear()
            self.idle(passed)
        yield self._frame(out)

    def _wake_at(self, tick_us: int) -> None:
        self.handle.registerTimer(max(1, -(-int(tick_us) // 1000)))  # a timer at the epoch never fires

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=list(self.output))
        for column in frame.columns:
            if column.endswith("_us"):
                frame[column] = frame[column].astype("Int64")
        return frame

    def advance(self, key: tuple, state: tuple | None, row: tuple, out: list[tuple]) -> tuple | None:
        """The state after a row; None is no state."""
        raise NotImplementedError

    def idle(self, passed_us: int) -> None:
        """Called when nothing is waiting."""

    def close(self) -> None:
        pass


class AlertStates(InOrder):
    row = ("tick_us", "rule_name", "firing", "duration_s", "value")
    waiting_schema = "tick_us bigint, rule_name string, firing boolean, duration_s bigint, value double"
    state_schema = "state string, starts_us bigint"
    output = ("fingerprint", "rule_name", "state", "tick_us", "starts_us", "ends_us", "value")

    def advance(self, key, state, row, out):
        tick, rule_name, firing, duration_s, value = row
        before, starts = state or ("", tick)
        current = before
        if firing:
            if not before:
                current = "pending"
            elif before == "pending" and tick - starts >= duration_s * MICROS:
                current = "firing"
        elif before:
            current = "resolved"
        if current != before:
            out.append((key[0], rule_name, current, tick, starts, tick if current == "resolved" else None, value))
        return (current, starts) if current in ("pending", "firing") else None


class Repeats(InOrder):
    row = ("tick_us", "repeat_interval_s")
    waiting_schema = "tick_us bigint, repeat_interval_s bigint"
    state_schema = "last_us bigint, due_us bigint"
    output = ("fingerprint", "channel", "state", "tick_us")

    def advance(self, key, state, row, out):
        tick, repeat_s = row
        if state is None or tick - state[0] >= repeat_s * MICROS:
            out.append((*key, tick))
            return (tick, tick + repeat_s * MICROS)
        return (state[0], max(state[1], state[0] + repeat_s * MICROS))

    def idle(self, passed_us):
        """What comes after the interval is sent whatever was sent before: the state may go then."""
        if not self.state.exists():
            return
        due = self.state.get()[1]
        if due <= passed_us:
            self.state.clear()
        else:
            self._wake_at(due)


def _in_order(rows: DataFrame, keys: list[str], processor: InOrder, columns: str, delay: str) -> DataFrame:
    timed = rows.withColumn("at", F.timestamp_micros("tick_us")).withWatermark("at", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, columns, "Append", "EventTime")


def stream_alert_transitions(evaluations: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Transitions of a stream with fingerprint, rule_name, tick_us, firing, duration_s, value.

    A tick counts once the watermark, ``delay`` behind the latest tick, has passed it; ticks may come in any order until
    then.  Deliveries of one tick count once.  :func:`telemill.streaming.windows.close_stream` ends a stream.
    """
    rows = evaluations.select("fingerprint", "rule_name", "tick_us", "firing", "duration_s", "value")
    return _in_order(rows, ["fingerprint"], AlertStates(), TRANSITION_COLUMNS, delay)


def stream_suppress_repeats(candidates: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """The notifications of a stream that go out: (fingerprint, channel, state, tick_us), as the watermark passes them."""
    rows = candidates.select("fingerprint", "channel", "state", "tick_us", "repeat_interval_s")
    return _in_order(rows, ["fingerprint", "channel", "state"], Repeats(), SENT_COLUMNS, delay)
