"""Streams against their table forms: visits with timers, the case store with its ledger."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.streaming import upserts, visits

BEGIN = dt.datetime(2024, 1, 5, 10)


@pytest.fixture(scope="module")
def timers(spark):
    for k, v in visits.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in visits.STATE_STORE:
        spark.conf.unset(k)


def lines(rows):
    return "\n".join(json.dumps({"ts": (BEGIN + dt.timedelta(seconds=s)).isoformat() + "Z", "target": t, "username": u}) for s, t, u in rows)


def test_visits_end_without_an_event(spark, tmp_path, timers):
    draw = random.Random(1)
    rows = sorted((draw.randrange(0, 4000) + draw.choice([0, 0.5]), f"t{draw.randrange(2)}", f"u{draw.randrange(3)}") for _ in range(120))
    src = tmp_path / "in"
    src.mkdir()
    stream = spark.readStream.schema("ts timestamp, target string, username string").json(str(src))
    q = visits.stream(stream, ["target", "username"], 90, "10 seconds").writeStream.format("memory").queryName("visits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for i in range(3):  # portions in the order of time
            (src / f"{i}.json").write_text(lines(rows[i * 40 : i * 40 + 40]))
            q.processAllAvailable()
        told = spark.table("visits").count()
        (src / "last.json").write_text(lines([(9000, "other", "x")]))  # time goes on, of these keys nothing more comes
        q.processAllAvailable()
        (src / "more.json").write_text(lines([(9001, "other", "x")]))
        q.processAllAvailable()
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("visits").filter("target <> 'other'").collect()}
    table = spark.read.schema("ts timestamp, target string, username string").json([str(src / f"{i}.json") for i in range(3)])
    want = {tuple(r) for r in visits.changes(table, ["target", "username"], 90).collect()}
    assert got == want and told < len(want) and len(want) > 20


def test_table_of_visits(spark):
    rows = [(0, "t", "u"), (90, "t", "u"), (181, "t", "u"), (181, "t", "u"), (5, "t", None)]
    df = spark.createDataFrame([(BEGIN + dt.timedelta(seconds=s), t, u) for s, t, u in rows] + [(None, "t", "u")], "ts timestamp, target string, username string")
    got = sorted((r["change"], (r["at"] - BEGIN).total_seconds()) for r in visits.changes(df, ["target", "username"], 90).collect())
    assert got == [("began", 0.0), ("began", 181.0), ("ended", 180.0), ("ended", 271.0)]
    runs = visits.due(df, "username", F.lit("2024-01-05 10:03:31").cast("timestamp"), 30)
    assert {r["username"]: r["due"] for r in runs.collect()} == {"u": True, None: True}
    assert visits.due(df, "username", F.lit("2024-01-05 10:03:30").cast("timestamp"), 30).filter("username = 'u'").first()["due"] is False


SCHEMA = "id string, last_modified int, status string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def content(store, spark):
    return {r["id"]: (r["last_modified"], r["status"]) for r in store.read(spark).collect()}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = upserts.Store(str(tmp_path / "s"), SCHEMA, parts=4)
    assert content(store, spark) == {}
    first = rows(spark, ("a", 1, "new"), ("b", 1, "new"), ("a", 3, "newest"), (None, 1, "none"))
    assert store.merge(first, 0) and content(store, spark) == {"a": (3, "newest"), "b": (1, "new"), None: (1, "none")}
    second = rows(spark, ("a", 2, "older"), ("b", 2, "changed"), ("c", None, "undated"), (None, 1, "as late"))
    assert store.merge(second, 1)
    want = {"a": (3, "newest"), "b": (2, "changed"), "c": (None, "undated"), None: (1, "none")}
    assert content(store, spark) == want
    for batch, i in ((first, 0), (second, 1)):
        assert not store.merge(batch, i) and content(store, spark) == want
    assert store.merge(rows(spark), 2) and content(store, spark) == want and store.entries() == [0, 1, 2]
    store.tidy()
    assert content(store, spark) == want and store.merge(rows(spark, ("c", 1, "dated")), 3) and content(store, spark)["c"] == (1, "dated")


def test_a_crash_before_the_entry(spark, tmp_path, monkeypatch):
    store = upserts.Store(str(tmp_path / "s"), SCHEMA, parts=2)
    store.merge(rows(spark, ("a", 1, "one")), 0)

    def crash(self, batch_id, versions):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(upserts.Store, "_enter", crash)
        with pytest.raises(OSError):
            store.merge(rows(spark, ("a", 2, "two")), 1)
    assert content(store, spark) == {"a": (1, "one")}
    assert store.merge(rows(spark, ("a", 2, "two")), 1) and content(store, spark) == {"a": (2, "two")}


def test_streams_into_a_store(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    store = upserts.Store(str(tmp_path / "s"), SCHEMA, parts=4)
    stream = spark.readStream.schema(SCHEMA).json(str(src))

    def go(checkpoint):
        q = upserts.to_store(stream, store, str(tmp_path / checkpoint)).start()
        q.processAllAvailable()
        q.stop()

    (src / "0.json").write_text('{"id":"a","last_modified":1,"status":"x"}\n{"id":"b","last_modified":1,"status":"x"}')
    go("c")
    (src / "1.json").write_text('{"id":"a","last_modified":2,"status":"y"}')
    go("c")
    want = {"a": (2, "y"), "b": (1, "x")}
    assert content(store, spark) == want and store.entries() == [0, 1]
    go("lost")  # without its checkpoint the stream begins anew, with batch 0
    assert content(store, spark) == want and store.entries() == [0, 1]
    events = spark.createDataFrame([("2024-01-31T10:00:00Z", "login"), ("2024-02-01T10:00:00Z", "login")], "ts string, action string")
    for _ in range(2):
        upserts.append_once(events, str(tmp_path / "log"), 7)
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and sorted(p.name for p in (tmp_path / "log" / "batch=7").glob("yyyymm=*")) == ["yyyymm=202401", "yyyymm=202402"]
