"""The seeded corpus with its answer key, the demo record, folder sizes."""

import os

from pyspark.sql import functions as F

from vellum.operators import names, pii
from vellum.plans import registry
from vellum.sources import corpus, folders


def test_same_notes_however_they_are_dealt(spark):
    def rows(**more):
        return sorted((r["doc_id"], r["text"], tuple(map(tuple, r["planted"]))) for r in corpus.planted_notes(spark, **more).collect())

    one = rows(n=50, partitions=1)
    assert one == rows(n=50, partitions=7) and len(one) == 50 and one == rows(n=60, partitions=9)[:50]
    assert one != rows(n=50, seed=1) and rows(n=0) == []


def findings(notes):
    name = F.transform(names.detect_names(F.col("text")), lambda m: F.struct(F.lit("person_name").alias("category"), m["text"].alias("text")))
    rest = F.transform(pii.detect_patterns(F.col("text")), lambda m: F.struct(m["category"].alias("category"), m["text"].alias("text")))
    return notes.select("doc_id", F.explode(F.concat(name, rest)).alias("m")).select("doc_id", "m.*")


def test_recall_and_precision_on_the_answer_key(spark):
    notes = corpus.planted_notes(spark, 200, 42)
    got = {r["category"]: r for r in corpus.quality(notes, findings(notes)).collect()}
    assert got["person_name"]["planted"] > 300
    assert got["person_name"]["recall"] >= 0.95 and got["person_name"]["prec"] >= 0.97, got["person_name"]
    for c in ("nhs_number", "phone_number", "postcode", "email"):
        assert got[c]["planted"] > 60 and got[c]["recall"] == 1.0, got[c]
    # the key can tell: without names nothing of them is found
    none = corpus.quality(notes, findings(notes).filter("category <> 'person_name'")).filter("category = 'person_name'").first()
    assert none["hit"] == 0 and none["recall"] == 0.0


def test_demo_record(spark):
    rows = corpus.demo_record(spark).orderBy("page_num").collect()
    assert [(r["doc_id"], r["page_num"]) for r in rows] == [(0, i) for i in range(4)] and rows == corpus.demo_record(spark).orderBy("page_num").collect()
    cases = spark.createDataFrame([("a", "Al", False, 1), ("b", "x synthetic y", True, 2)], "id string, full_name string, archived boolean, more int")
    once = corpus.add_demo(cases, spark)
    assert [r["id"] for r in once.orderBy("id").collect()] == ["a", "b", "demo"] and corpus.add_demo(once, spark).count() == 3


def test_folder_sizes_open_no_file(spark, tmp_path):
    for name, size in {"a/x.bin": 10, "a/b/y.bin": 20, "z.bin": 5, "a/b/c/empty": 0, "a/b/c/one": 1, "with space/é.bin": 7}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    files = folders.file_sizes(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
    got = {r["folder"]: (r["depth"], r["n_files"], r["bytes"]) for r in folders.folder_sizes(files).collect()}
    assert got == {"": (0, 5, 43), "a": (1, 3, 31), "a/b": (2, 2, 21), "a/b/c": (3, 1, 1), "with space": (1, 1, 7)}
    cases = spark.createDataFrame([(True,), (False,), (None,)], "archived boolean")
    assert tuple(folders.status(cases, files).first()) == (2, 1, 5, 43)
    assert registry.QUERIES["agg18_folder_sizes"](spark, "/root/testdata/sf0.001").filter("folder = ''").first()["bytes"] > 0
