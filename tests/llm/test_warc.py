import hashlib
import os

from vellum.llm import warc

SCHEMA = "page_id long, url string, html string"


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 40
    rows = [(3, "http://a/1", big), (1, "http://a/2", big), (2, "http://b\n/3", "short"), (5, None, "short"), (4, "u", None), (6, "u", ""), (7, "v", "WARC/1.1\r\n\r\n" + "y" * 200), (None, "w", big)]
    path = f"file://{tmp_path}/arc"
    got = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest"), path).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i]["payload_bytes"] == len(data) and got[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["refers_to"]} == {3: ("revisit", 1), None: ("revisit", 1)}
    assert got[2]["url"] == "http://b%0A/3" and got[5]["url"] is None


def test_pushed_predicates_skip_payloads(spark, tmp_path):
    path = f"file://{tmp_path}/arc"
    warc.write(spark.createDataFrame([(i, f"http://h{i % 3}/", "x" * 300 if i % 2 else f"page {i}") for i in range(20)], SCHEMA), path)
    assert warc.read(spark, path).filter("target_uri = 'http://h1/'").count() == 7
    assert warc.read(spark, path, payload=False).filter("record_type IN ('revisit')").count() == 9
    reader = warc.WarcReader({"path": path, "payload": "true"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("content_length",), 5)]))
    assert len(left) == 1 and reader.tests == [("warc-type", "=", "response")]
    assert sum(len(p.paths) for p in reader.partitions()) == len([f for f in os.listdir(tmp_path / "arc") if f.endswith(".txt")])
    assert all(b.column(0).to_pylist().count("revisit") == 0 for p in reader.partitions() for b in reader.read(p))


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/arc").count() == 0
