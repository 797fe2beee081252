"""Visits: when a key begins to be active and when it has been silent for so long that it counts as gone.

One operator for who is looking at a case, and for jobs that are due: an event begins a visit, others within the time prolong
it, and silence ends it without any event, by a timer. The stream keeps one state a key, begin and last event, until the
visit has ended; a busy target has as many keys as viewers. The table form tells the same from all events at once.

Defined cases: events with a null key or time are left out; events of one time count as one; an event that is late, but
within the watermark, and before the begin already told prolongs nothing; an end is told once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a session that runs these streams must be set to: timers need this state store.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def changes(events: DataFrame, keys: Sequence[str], seconds: int) -> DataFrame:
    """(keys, change, at) of events(ts, keys...) as a table: began at a visit's first event, ended so long after its last.

    Visits still open at the table's end are told as ended too."""
    rows = _timed(events, keys)
    before = F.lag("us").over(W.partitionBy(*keys).orderBy("us"))
    rows = rows.withColumn("gap", F.col("us") - before)
    following = F.lead("gap").over(W.partitionBy(*keys).orderBy("us"))
    span = seconds * 1_000_000
    rows = rows.withColumn("next_gap", following)
    told = F.array_compact(F.array(_change(F.col("gap").isNull() | (F.col("gap") > span), "began", F.col("us")), _change(F.col("next_gap").isNull() | (F.col("next_gap") > span), "ended", F.col("us") + span)))
    return rows.select(*keys, F.inline(told)).withColumn("at", F.timestamp_micros("at"))


def _change(holds: Column, what: str, at: Column) -> Column:
    return F.when(holds, F.struct(F.lit(what).alias("change"), at.alias("at")))


def _timed(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.dropna(subset=["ts", *keys]).withColumn("us", F.unix_micros("ts"))


class Visit(StatefulProcessor):
    """State of a key: the first and last event of the visit it is on, in microseconds."""

    def __init__(self, seconds: int, keys: Sequence[str]):
        self.span, self.keys = seconds * 1_000_000, tuple(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visit = handle.getValueState("visit", "begin long, last long")

    def _due(self, last: int) -> int:
        return -(-(last + self.span) // 1000) + 1

    def _row(self, key, change: str, at: int) -> Row:
        return Row(**dict(zip(self.keys, key, strict=True)), change=change, at=at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        told, (begin, last) = [], self.visit.get() if self.visit.exists() else (None, None)
        had = last
        for us in sorted(r["us"] for r in rows):
            if begin is None or us - last > self.span:
                if begin is not None:
                    told.append(("ended", last + self.span))
                told.append(("began", us))
                begin = last = us
            last = max(last, us)
        if had is not None:
            self.handle.deleteTimer(self._due(had))
        self.visit.update((begin, last))
        self.handle.registerTimer(self._due(last))
        return iter([self._row(key, *x) for x in told])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.visit.exists():
            return iter(())
        _, last = self.visit.get()
        if self._due(last) > expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        self.visit.clear()
        return iter([self._row(key, "ended", last + self.span)])

    def close(self) -> None:
        pass


def stream(events: DataFrame, keys: Sequence[str], seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same of a stream of events(ts, keys...), keys being strings."""
    rows = _timed(events, keys).withWatermark("ts", late)
    kinds = ", ".join([*[f"{k} string" for k in keys], "change string", "at long"])
    out = rows.groupBy(*keys).transformWithState(Visit(seconds, keys), kinds, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))


def due(runs: DataFrame, job: str, now: Column, seconds: int = 86_400) -> DataFrame:
    """(job, last_run, due): whether each job's last of runs(ts, job) is so long ago, to the second."""
    last = runs.groupBy(job).agg(F.max("ts").alias("last_run"))
    return last.withColumn("due", F.unix_micros(now) - F.unix_micros("last_run") >= seconds * 1_000_000)
