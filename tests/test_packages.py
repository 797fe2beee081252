"""Case packages: round trip, two-phase commit, faults of archives, import."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources import packages as P


def case(i, **more):
    return json.dumps({"id": i, "last_modified": f"2024-01-0{len(i)}", "subject": {"full_name": f"Name {i}"}, **more})


@pytest.fixture
def tables(spark):
    cases = spark.createDataFrame([(i, case(i)) for i in ("a", "b-2", "empty")], "id string, doc string")
    files = [("a", "x.pdf", b"one"), ("a", "../../x.pdf", b"two"), ("a", "C:\\y\\z", None), ("b-2", "n.txt", bytes(range(256)) * 5000), ("nobody", "n.txt", b"?")]
    return cases, spark.createDataFrame(files, "id string, name string, data binary")


def test_round_trip(spark, tables, tmp_path):
    P.write_packages(*tables, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["_pending", "a.sarpack", "b-2.sarpack", "empty.sarpack"] and os.listdir(tmp_path / "_pending") == []
    rows = P.read_packages(spark, f"file://{tmp_path}").collect()
    assert {r["outcome"] for r in rows} == {"ok"}
    assert {r["id"]: r["doc"] for r in rows if r["name"] is None} == {i: case(i) for i in ("a", "b-2", "empty")}
    files = {(r["id"], r["name"]): bytes(r["data"]) for r in rows if r["name"]}
    assert files == {("a", "x-2.pdf"): b"one", ("a", "x.pdf"): b"two", ("a", "z"): b"", ("b-2", "n.txt"): bytes(range(256)) * 5000}
    manifest = json.loads(zipfile.ZipFile(tmp_path / "a.sarpack").read("manifest.json"))
    assert manifest["sar_id"] == "a" and manifest["subject_name"] == "Name a" and manifest["format_version"] == 1
    assert P.read_packages(spark, str(tmp_path), members=False).count() == 3


def test_nothing_stays_of_a_failed_job(spark, tables, tmp_path):
    cases, files = tables
    P.write_packages(cases, files, str(tmp_path))
    bad = cases.unionByName(spark.createDataFrame([("../out", case("../out"))], "id string, doc string"))
    with pytest.raises(Exception, match="not an id"):
        P.write_packages(bad.withColumn("doc", F.lit(case("a", changed=True))), files, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["_pending", "a.sarpack", "b-2.sarpack", "empty.sarpack"] and os.listdir(tmp_path / "_pending") == []
    assert {r["doc"] for r in P.read_packages(spark, str(tmp_path)).filter("name IS NULL").collect()} == {case(i) for i in ("a", "b-2", "empty")}


def test_writing_again(spark, tables, tmp_path):
    cases, files = tables
    P.write_packages(cases, files, str(tmp_path))
    P.write_packages(cases.filter("id = 'a'").withColumn("doc", F.lit(case("a", n=2))), files, str(tmp_path))
    assert P.read_packages(spark, str(tmp_path)).filter("name IS NULL").count() == 3
    P.write_packages(cases.filter("id = 'a'"), files, str(tmp_path), overwrite=True)
    assert [r["id"] for r in P.read_packages(spark, str(tmp_path), False).collect()] == ["a"]
    P.write_packages(cases.limit(0), files, str(tmp_path / "none"))
    assert P.read_packages(spark, str(tmp_path / "none")).count() == 0


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_faults_and_import(spark, tmp_path):
    good = {"manifest.json": "{}", "pdfs/": b"", "pdfs/../../etc/x.pdf": b"x", "other/y": b"y"}
    made = {
        "a": archive(good | {"sar.json": case("a")}), "b": archive(good | {"sar.json": case("a", n=2)}), "c": archive({"sar.json": case("c")}),
        "d": archive({"manifest.json": "{}"}), "e": b"no archive", "f": archive(good | {"sar.json": "no json"}), "g": archive(good | {"sar.json": case("../../evil")}),
        "h": archive(good | {"sar.json": case("here")}), "i": archive(good | {"sar.json": json.dumps({"id": 7})}), "j": archive(good | {"sar.json": "[1]"}),
    }
    for n, data in made.items():
        (tmp_path / f"{n}.sarpack").write_bytes(data)
    (tmp_path / "note.txt").write_text("not read")
    read = P.read_packages(spark, str(tmp_path))
    assert {r["name"] for r in read.filter("name IS NOT NULL").collect()} == {"x.pdf"}
    store = spark.createDataFrame([("here", case("here", old=True)), ("else", case("else"))], "id string, doc string")
    got = {os.path.basename(r["path"])[0]: (r["outcome"], r["existing_modified"], r["subject_name"]) for r in P.incoming(read, store).collect()}
    assert {k: v[0].split(":")[0] for k, v in got.items()} == {
        "a": "imported", "b": "another has its id", "c": "not a package", "d": "not a package", "e": "unreadable", "f": "unreadable", "g": "invalid id",
        "h": "conflict", "i": "invalid id", "j": "unreadable",
    }
    assert got["h"][1:] == ("2024-01-04", "Name here")
    after = {r["id"]: r["doc"] for r in P.import_packages(read, store).collect()}
    assert after == {"here": case("here", old=True), "else": case("else"), "a": case("a")}
    assert {r["id"]: r["doc"] for r in P.import_packages(read, store, force=True).collect()}["here"] == case("here")


def test_folder_of_documents(spark, tmp_path):
    for n, text in {"a.json": case("a"), "b.json": case("here", n=2), "c.json": "no json", "d.json": "{}", "e.txt": case("e")}.items():
        (tmp_path / n).write_text(text)
    store = spark.createDataFrame([("here", case("here"))], "id string, doc string")
    assert {r["id"]: r["doc"] for r in P.migrate_folder(spark, str(tmp_path), store).collect()} == {"a": case("a"), "here": case("here", n=2)}


def test_many_archives_share_folders_and_tasks(spark, tmp_path):
    cases = spark.range(1, 301).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id")).withColumn("doc", F.to_json(F.struct("id")))
    files = cases.select("id", F.lit("x.txt").alias("name"), F.encode("id", "UTF-8").alias("data"))
    flat, dealt = str(tmp_path / "flat"), str(tmp_path / "dealt")
    P.write_packages(cases, files, flat)
    assert P.read_packages(spark, flat).rdd.getNumPartitions() == 2
    P.write_packages(cases, files.unionByName(files.withColumn("id", F.concat(F.lit("no"), "id"))), dealt, folders=8)
    assert sorted(os.listdir(dealt)) == ["_pending", *[f"in-{i}" for i in range(8)]]
    assert P.read_packages(spark, dealt).rdd.getNumPartitions() == 2
    rows = P.read_packages(spark, dealt).collect()
    assert {(r["id"], bytes(r["data"]).decode()) for r in rows if r["name"]} == {(f"c{i}", f"c{i}") for i in range(1, 301)} and len(rows) == 600
    P.write_packages(cases.filter("id = 'c7'").withColumn("doc", F.lit(case("c7", n=2))), files, dealt, folders=8)
    assert {r["id"]: r["doc"] for r in P.read_packages(spark, dealt, False).collect()} == {f"c{i}": case("c7", n=2) if i == 7 else f'{{"id":"c{i}"}}' for i in range(1, 301)}
    P.write_packages(cases.filter("id = 'c7'"), files, dealt, overwrite=True, folders=8)
    assert [r["id"] for r in P.read_packages(spark, dealt, False).collect()] == ["c7"]
