"""Streaming forms of the audit operators: tail, presence, idle sessions, login throttle.

Every one bounds its state: windows by a watermark, keyed state by a timeout."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.sources.stores import AUDIT

# Failures and seconds of the throttle, seconds that a viewer counts as present.
FAILURES, WINDOW, SEEN = 5, 300, 90


def read_stream(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    return spark.readStream.schema(schema).json(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tail(events: DataFrame, action: str = "", user: str = "", target: str = "") -> DataFrame:
    """Events of an action whose user name, in any case, and target contain what is given."""
    out = events
    if action:
        out = out.filter(F.col("action") == action)
    if user:
        out = out.filter(F.contains(F.lower("username"), F.lit(user.lower())))
    return out.filter(F.contains(F.col("target"), F.lit(target))) if target else out


def idle_sessions(events: DataFrame, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", f"{minutes} minutes").alias("w"), "username").agg(F.count("*").alias("events"))
    return out.select("username", F.col("w.start").alias("began"), F.col("w.end").alias("ends"), "events")


def presence(events: DataFrame, seconds: int = SEEN) -> DataFrame:
    """Each heartbeat with the others whose last one on the same target is at most so many seconds old; for tables.

    A target's time is cut into stretches of that length, and a heartbeat also goes, as one to look back on, to the stretch
    after its own: so a busy target is spread over its stretches, and no frame reaches beyond two."""
    span = seconds * 1_000_000
    rows = events.filter("target is not null").withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    own = F.floor(F.col("__us") / span)
    rows = rows.withColumn("__at", F.explode(F.array(F.struct(own.alias("k"), F.lit(True).alias("own")), F.struct((own + 1).alias("k"), F.lit(False).alias("own")))))
    here = W.partitionBy("target", "__at.k").orderBy("__us").rangeBetween(-span, W.currentRow)
    others = F.array_sort(F.array_remove(F.collect_set("username").over(here), F.col("username")))
    return rows.withColumn("others", others).filter("__at.own").drop("__at", "__us")


def last_seen(events: DataFrame) -> DataFrame:
    """(target, username, seen): the last heartbeat of each viewer, for streams in update or complete mode; one row of state a viewer."""
    return events.groupBy("target", "username").agg(F.max("ts").alias("seen"))


def present(seen: DataFrame, now: str, asker: str, seconds: int = SEEN) -> DataFrame:
    """The viewers of each target but the asker, at a moment, from what last_seen() tells."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("seen").cast("timestamp"))
    near = seen.filter((age <= seconds * 1_000_000) & (F.col("username") != asker))
    return near.groupBy("target").agg(F.array_sort(F.collect_set("username")).alias("viewers"))


def throttle_step(failures: list[float], now: float, ok: bool) -> tuple[list[float], int]:
    """Failures that still count after an attempt, and the seconds to wait: 0 where it was let through.

    An attempt that is refused isn't recorded; a success clears all."""
    recent = [t for t in failures if now - t < WINDOW]
    if len(recent) >= FAILURES:
        return recent, int(WINDOW - (now - min(recent))) + 1
    return ([], 0) if ok else ([*recent, now], 0)


def throttle(attempts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(ip, username, ts, wait) of every attempt(ts, ip, username, ok); works on streams."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        failures = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        waits = []
        for ts, ok in zip(rows["ts"], rows["ok"], strict=True):
            failures, wait = throttle_step(failures, ts.timestamp(), bool(ok))
            waits.append(wait)
        state.update((failures,))
        latest = max(int(rows["ts"].iloc[-1].timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(latest + WINDOW * 1000 + 1)
        yield pd.DataFrame({"ip": key[0], "username": key[1], "ts": rows["ts"].to_numpy(), "wait": waits})

    keyed = attempts.withColumn("username", F.lower("username")).withWatermark("ts", late).groupBy("ip", "username")
    return keyed.applyInPandasWithState(run, "ip string, username string, ts timestamp, wait long", "failures array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def throttled(attempts: DataFrame) -> DataFrame:
    """(event_id, ip, username, wait) of every attempt(ts, event_id, ip, username, ok) of a table, as throttle() tells of a stream.

    An address and name's attempts stream through one task in order; of them it holds the failures that still count."""
    rows = attempts.select("event_id", "ip", F.lower("username").alias("username"), "ok", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    rows = rows.repartition("ip", "username").sortWithinPartitions("ip", "username", "t", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, failures = None, []
        for batch in batches:
            waits = []
            for ip, name, t, ok in zip(*(batch[c].to_pylist() for c in ("ip", "username", "t", "ok")), strict=True):
                if (ip, name) != who:
                    who, failures = (ip, name), []
                failures, wait = throttle_step(failures, t, bool(ok))
                waits.append(wait)
            yield pa.RecordBatch.from_arrays([batch["event_id"], batch["ip"], batch["username"], pa.array(waits, pa.int64())], ["event_id", "ip", "username", "wait"])

    return rows.mapInArrow(run, "event_id long, ip string, username string, wait long")
