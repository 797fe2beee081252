"""Dates, search, redaction, bundles, stores and event rules."""

import json
import math
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import dates, redact, search
from vellum.sources import stores
from vellum.streaming import audit


def test_document_dates(spark):
    rows = [
        ("Date: 31 February 2024, seen 12th March 2024", "2024-03-12"), ("112 March 2024", "2024-03-12"), ("12/03/2024 and 1 Jan 2023", "2023-01-01"), ("March 5, 2021", "2021-03-05"),
        ("31/02/2024 then 28-02-2024", "2024-02-28"), ("1 May 1889", None), ("nothing", None), (None, None), ("x" * 2000 + " 1 May 2020", None), ("Dated: 3rd sept 2019", "2019-09-03"),
    ]
    got = spark.createDataFrame(rows, "t string, want string").select("want", dates.document_date(F.col("t")).cast("string").alias("got")).collect()
    assert [r["got"] for r in got] == [w for _, w in rows]
    names = [("2024-01-31_a.pdf", "2024-01-31"), ("2024-02-31_a.pdf", None), ("a2024-01-31_.pdf", None)]
    got = spark.createDataFrame(names, "t string, want string").select(dates.filename_date(F.col("t")).cast("string").alias("got")).collect()
    assert [r["got"] for r in got] == [w for _, w in names]


def brute_scan(pages, q):
    found, kws = [], set()
    for kw in q.keywords:
        hits = 0
        for _, f, p, t in pages:
            low, at = t.lower(), -1
            while hits < 3 and (at := low.find(kw.lower(), at + 1)) >= 0:
                found.append((kw, f, p))
                kws.add(kw)
                hits += 1
                at += len(kw) - 1
        if len(found) >= 10:
            break
    return sorted(kws), len(found), found[:10]


def test_keyword_scan(spark):
    pages = [(i, f"f{i}", 0, "doctor CT act. " * (i % 3) + "fact " * (i % 2) + "a.b") for i in range(12)]
    qs = [search.Question("q", "t", ("ct", "a.b", "act", "doc", "fact", "zzz")), search.Question("n", "t", ("zzz",)), search.Question("e", "t", ())]
    got = {r["question_id"]: r for r in search.keyword_scan(spark.createDataFrame(pages, "file_seq int, source_file string, page_num int, text string"), qs).collect()}
    assert set(got) == {"q"}
    kws, n, found = brute_scan(pages, qs[0])
    assert got["q"]["matched_keywords"] == kws and got["q"]["match_count"] == n == 12
    assert [(m["keyword"], m["source_file"], m["page_num"]) for m in got["q"]["matches"]] == found


def test_evidence(spark):
    pages = [(0, "f", 0, "short\n\nThis has blood pressure in it.\n \nNothing here at all, truly.\n\nSmoking and blood history noted"), (1, "g", 2, "Blood again in page two"), (2, "h", 0, None)]
    q = search.Question("q", keywords=("blood", "smoking"), hints=("history",))
    got = search.evidence(spark.createDataFrame(pages, "file_seq int, source_file string, page_num int, text string"), [q]).orderBy("place").collect()
    assert [(r["source_file"], r["confidence"]) for r in got] == [("f", 1.0), ("f", 0.5), ("g", 0.5)]


def test_blank_out(spark):
    df = spark.createDataFrame([("é Dr Smith met Dr Jones", [(2, 10), (15, 23), (4, 8)]), ("none", [])], "t string, m array<struct<s:int,e:int>>")
    assert [r[0] for r in df.select(redact.blank_out(F.col("t"), F.col("m"))).collect()] == ["é [REDACTED] met [REDACTED]", "none"]


def test_apply_redactions(spark):
    pages = spark.createDataFrame([("f", 0, "my mother came")], "source_file string, page_num int, text string")
    c = [("a", 150.0, 92.0, 240.0, 106.0, 0, "approved"), ("Mother", 0.0, 0.0, 0.0, 0.0, 0, "approved"), ("ghost", 0.0, 0.0, 0.0, 0.0, 0, "auto_redact"), ("b", 1.0, 1.0, 2.0, 2.0, 7, "approved"),
         (" ", 0.0, 5.0, 5.0, 9.0, 0, "approved"), ("c", 1.0, 1.0, 2.0, 2.0, 0, "flagged")]
    df = spark.createDataFrame(c, "text string, x0 double, y0 double, x1 double, y1 double, page_num int, status string").withColumn("source_file", F.lit("f"))
    got = {r["text"]: r["outcome"] for r in redact.apply_redactions(pages, df).collect()}
    assert got == {"a": "box", "Mother": "search", "ghost": "failed", "b": "failed", " ": "failed"}


def brute_split(sizes, most, parts=5):
    total = sum(sizes)
    if total <= most:
        return [0] * len(sizes)
    cap = max(most, math.ceil(total / parts))
    while True:
        out, part, size = [], 0, 0
        for s in sizes:
            if size and size + s > cap:
                part, size = part + 1, 0
            out.append(part)
            size += s
        if part + 1 <= parts:
            return out
        cap = int(cap * 1.25)


@pytest.mark.parametrize("sizes", [[5] * 8, [100, 1, 1, 1], [3, 9, 2, 8, 4, 7, 6, 5, 1], [7], []])
@pytest.mark.parametrize("most", [0, 6, 200])
def test_split_parts(spark, sizes, most):
    df = spark.createDataFrame([([(f"f{i}", s) for i, s in enumerate(sizes)],)], "files array<struct<file:string,size:bigint>>")
    assert df.select(redact.split_parts(F.col("files"), most).alias("p")).first()["p"] == brute_split(sizes, most)


def test_split_parts_of_many_files(spark):
    """The cap is found once, not for every file: 2,000 files took minutes otherwise."""
    sizes = [(i * 7919) % 1000 + 1 for i in range(2000)]
    df = spark.createDataFrame([([(f"f{i}", s) for i, s in enumerate(sizes)],)], "files array<struct<file:string,size:bigint>>")
    began = time.time()
    assert df.select(redact.split_parts(F.col("files"), 200).alias("p")).first()["p"] == brute_split(sizes, 200)
    assert time.time() - began < 30

def test_wrap(spark):
    df = spark.createDataFrame([("aa bb ccc dddddddd e",), ("",), (" x ",)], "t string")
    assert [r[0] for r in df.select(redact.wrap(F.col("t"), 6)).collect()] == [["aa bb", "ccc", "dddddddd", "e"], [], ["x"]]


def test_retention(spark):
    now = "2024-06-30T12:00:00Z"
    rows = [("a", "complete", "2024-01-01T00:00:00Z", ""), ("b", "complete", "2024-06-29T00:00:00Z", ""), ("c", "reviewing", "2020-01-01", ""), ("d", "complete", "", ""), ("e", "complete", "not-a-date", "also-bad"),
            ("f", "complete", "", "2023-01-01T00:00:00Z"), ("g", "complete", "2024-01-02T12:00:00Z", "")]
    df = spark.createDataFrame(rows, "id string, status string, completed_at string, last_modified string")
    assert {r["id"] for r in stores.expired(df, 180, now).collect()} == {"a", "f", "g"}
    assert stores.expired(df, 0, now).count() == 0


def test_case_store(spark):
    docs = [("s1", json.dumps({"id": "s1", "created_at": "2024-01-01T10:00:00", "pdf_files": ["/old/abs/doc.pdf", "C:\\x\\y.pdf"]})), ("s2", json.dumps({"id": "s2", "due_date": "2024-05-05", "archived": True}))]
    got = {r["id"]: r for r in stores.read_cases(spark.createDataFrame(docs, "id string, doc string")).collect()}
    assert got["s1"]["pdf_files"] == ["doc.pdf", "y.pdf"] and got["s1"]["due_date"] == "2024-01-31" and got["s1"]["archived"] is False
    assert got["s2"]["due_date"] == "2024-05-05" and got["s2"]["archived"] is True
    assert stores.config({"retention_days": 7, "unknown": 1, "practice_name": " A "})["retention_days"] == "7"
    ids = spark.createDataFrame([("ok",), ("-bad",), ("have",)], "id string")
    have = spark.createDataFrame([("have",)], "id string")
    assert {r["id"]: r["outcome"] for r in stores.importable(ids, have).collect()} == {"ok": "imported", "-bad": "invalid", "have": "conflict"}
    assert stores.upsert(have.withColumn("v", F.lit(1)), ids.withColumn("v", F.lit(2))).filter("id = 'have'").first()["v"] == 2


def test_audit_store(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ts":"2024-01-05T10:00:00Z","action":"login","username":"admin","target":"x"}\nnot json\n')
    events = stores.read_audit(spark, str(tmp_path / "a.json"))
    assert events.count() == 1
    stores.append_audit(events, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["yyyymm=202401"]


def test_throttle_steps():
    failures, waits = [], []
    for now, ok in [(0, False), (1, False), (2, False), (3, False), (4, False), (5, False), (299.9, True), (300, True), (301, False)]:
        failures, wait = audit.throttle_step(failures, now, ok)
        waits.append(wait)
    assert waits == [0, 0, 0, 0, 0, 296, 1, 0, 0] and failures == [301]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    lines = [{"ts": f"2024-01-05T10:00:{i:02d}Z", "action": "login_failed", "username": "Bob" if i % 2 else "bob", "ip": "1", "target": "t"} for i in range(7)]
    (src / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    events = audit.read_stream(spark, str(src))
    attempts = events.select("ts", "ip", "username", (F.col("action") == "login").alias("ok"))
    for name, df, mode in (("throttled", audit.throttle(attempts), "append"), ("tailed", audit.tail(events, "login_failed", "BO", "t"), "append"), ("seen", audit.last_seen(events), "update"), ("idle", audit.idle_sessions(events), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [r["wait"] > 0 for r in spark.table("throttled").orderBy("ts").collect()] == [False] * 5 + [True] * 2
    assert spark.table("tailed").count() == 7 and spark.table("idle").count() == 2
    assert spark.table("seen").count() == 2
    near = audit.present(spark.table("seen"), "2024-01-05T10:01:30Z", "carol").first()
    assert near["viewers"] == ["Bob", "bob"] and near["target"] == "t"
    assert audit.present(spark.table("seen"), "2024-01-05T10:01:36Z", "Bob").first()["viewers"] == ["bob"]
    assert audit.present(spark.table("seen"), "2024-01-05T10:01:37Z", "carol").count() == 0
