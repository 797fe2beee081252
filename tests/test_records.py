"""A case's record: pages, dates, lists, staff by words, snapshots, reports, names' findings."""

import json

import pytest
from pyspark.sql import functions as F

from vellum.operators import cases, letters, record
from vellum.sources import backups, stores

FILES = "case_id long, seq int, source_file string, pages int, dated string"


def files(spark):
    return spark.createDataFrame([(1, 1, "a", 3, None), (1, 2, "b", 2, "2001-01-02"), (1, 3, "c", 1, ""), (1, 4, "d", 4, "1999-12-31"), (2, 1, "a", 1, None)], FILES)


def test_order_and_pages_of_a_bundle(spark):
    got = {(r["case_id"], r["source_file"]): (r["place"], r["first_page"]) for r in record.bundle_pages(files(spark)).collect()}
    assert got == {(1, "d"): (1, 1), (1, "b"): (2, 5), (1, "a"): (3, 7), (1, "c"): (4, 10), (2, "a"): (1, 1)}
    asked = spark.createDataFrame([(1, "a", 1, "1990-01-01"), (1, "d", 1, "2030-01-01"), (1, "d", 2, None), (2, "z", 1, "1990-01-01")], "case_id long, source_file string, at int, dated string")
    new = record.in_file_order(record.set_dates(files(spark), asked))
    assert [r["source_file"] for r in new.filter("case_id = 1").orderBy("place").collect()] == ["a", "b", "c", "d"]
    chosen = spark.createDataFrame([(1, "c"), (2, "gone")], "case_id long, source_file string")
    assert {r["case_id"]: r["main_file"] for r in record.main_file(files(spark), chosen).collect()} == {1: "c", 2: "a"}
    assert {r["case_id"]: r["main_file"] for r in record.main_file(files(spark), chosen.limit(0)).collect()} == {1: "d", 2: "a"}


def test_deleted_pages(spark):
    found = spark.createDataFrame([(1, "d", p, f"d{p}") for p in range(4)] + [(1, "a", 1, "a1"), (2, "a", 0, "other case"), (1, None, 0, "no file")], "case_id long, source_file string, page_num int, text string")
    asked = spark.createDataFrame([(1, "d", 0), (1, "d", 2), (1, "d", 2), (1, "d", 4), (1, "d", -1), (1, "z", 0), (2, "a", None)], "case_id long, source_file string, page_num int")
    left, kept = record.delete_pages(files(spark), found, asked)
    assert {(r["case_id"], r["source_file"]): r["pages"] for r in left.collect()} == {(1, "a"): 3, (1, "b"): 2, (1, "c"): 1, (1, "d"): 2, (2, "a"): 1}
    assert {r["text"]: r["page_num"] for r in kept.collect()} == {"d1": 0, "d3": 1, "a1": 1, "other case": 0, "no file": 0}
    assert record.delete_pages(files(spark), found.limit(0), asked)[1].count() == 0


def test_lists(spark, tmp_path):
    have = spark.createDataFrame([("On File", 1)], "phrase string, n int")
    more = spark.createDataFrame([("on file", 1), ("New", 3), ("NEW", 2), (None, 0)], "phrase string, n int")
    grown = record.add_entries(have, more, "phrase", "n")
    assert {r["phrase"] for r in grown.collect()} == {"On File", "NEW"}
    assert {r["phrase"] for r in record.remove_entries(grown, spark.createDataFrame([("new",), ("gone",)], "phrase string"), "phrase").collect()} == {"On File"}
    write = lambda name, what: (tmp_path / name).write_text(json.dumps(what, indent=1)) and str(tmp_path / name)
    assert [tuple(r) for r in stores.read_staff(spark, write("s", [{"name": "Dr A"}, {"name": " "}, {"role": "x"}])).collect()] == [("Dr A", "")]
    assert [tuple(r) for r in stores.read_custom_words(spark, write("c", [{"phrase": "x", "case_sensitive": True}, {"phrase": "y"}, {}])).collect()] == [("x", True), ("y", False)]
    assert sorted(tuple(r) for r in stores.read_risk_words(spark, write("r", {"a": ["p", "q"], "b": [], "c": ["p"]})).collect()) == [("a", "p"), ("a", "q"), ("c", "p")]
    assert {r["name"] for r in stores.read_surnames(spark, write("n", [" Okafor", "okafor", "", "Lee"])).collect()} == {"okafor", "lee"}


def test_staff_by_words_as_by_expression(spark):
    from vellum.operators import classify

    staff = ["Dr Peter Wright", "Sarah Hughes", "Nurse", " ", "de Souza"]
    names = ["Peter", "dr", "Dr", "Mr WRIGHT", "Dr Jones", "sarah  hughes", "Nurse", "Nurse Jones", "Souza de", "", None, "hughe", "Dr Peter Wright"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    table = spark.createDataFrame([(s,) for s in staff], "name string")
    want = {r["i"] for r in df.filter(classify.is_staff(F.col("name"), [s for s in staff if s.strip()])).collect()}
    assert {r["i"] for r in record.staff_named(df, table, ["i"]).collect()} == want and len(want) > 6
    assert record.staff_named(df, table.limit(0), ["i"]).count() == 0


def test_snapshots(spark, tmp_path):
    root, df = str(tmp_path), spark.range(3)
    assert backups.snapshots(root) == []
    with pytest.raises(ValueError):
        backups.restore(spark, root)
    (tmp_path / "backup-20000101-000000" / "t").mkdir(parents=True)  # a writer died
    (tmp_path / "other").mkdir()
    for i in range(9):
        backups.snapshot({"t": df.withColumn("i", F.lit(i)), "empty": df.limit(0)}, root, f"2001010{i}-000000")
    assert backups.snapshots(root, complete=False) == [f"2001010{i}-000000" for i in range(2, 9)]
    back = backups.restore(spark, root)
    assert back["t"].filter("i = 8").count() == 3 and back["empty"].count() == 0 and (tmp_path / "other").exists()
    assert backups.restore(spark, root, "20010103-000000")["t"].first()["i"] == 3
    with pytest.raises(ValueError):
        backups.snapshot({"t": df}, root, "20010108-000000")
    with pytest.raises(ValueError):
        backups.restore(spark, root, "20010101-000000")


def test_report_lines(spark):
    reports = spark.createDataFrame([(1, None, "Al", ""), (2, "T", None, None)], "case_id long, template_name string, full_name string, address string")
    answers = spark.createDataFrame([(1, 2, "q2", "Two?", " yes "), (1, 1, "q1", None, None)], "case_id long, seq int, question_id string, question_text string, answer string")
    evidence = spark.createDataFrame([(1, "q2", p, f"f{p}", p, "" if p == 1 else "t") for p in range(6)] + [(1, "q1", 0, "f", 0, None)], "case_id long, question_id string, place int, source_file string, page_num int, text string")
    out = letters.report(reports, answers, evidence, F.lit("2024-03-04").cast("date"))
    lines = {i: [r["line"] for r in out.filter(F.col("case_id") == i).orderBy(*letters.LINE[:4]).collect()] for i in (1, 2)}
    assert lines[1] == ["MEDICAL REPORT", "Report Type: General", "Generated: 04 March 2024", "Report ID: 1", "PATIENT DETAILS", "Name: Al", "REPORT FINDINGS", "Q1. ", "A: [No answer provided]", "Q2. Two?", "A: yes", "Sources: f0 p.1; f2 p.3; f3 p.4", "─" * 60]
    assert lines[2] == ["MEDICAL REPORT", "Report Type: T", "Generated: 04 March 2024", "Report ID: 2", "PATIENT DETAILS", "REPORT FINDINGS", "─" * 60]


def test_first_findings_of_a_name(spark):
    rows = [(c, "f", p, p, "email", f" {t} ", "approved") for c in (1, 2) for p, t in enumerate(["Al", "al", "AL", "bo"])]
    got = cases.occurrences(spark.createDataFrame(rows, "case_id long, source_file string, page_num int, seq int, category string, text string, status string"), 4).collect()
    assert sorted((r["name"], r["place"], r["case_id"], r["page_num"], r["more"]) for r in got) == [("al", 1, 1, 0, 2), ("al", 2, 1, 1, 2), ("al", 3, 1, 2, 2), ("al", 4, 2, 0, 2), ("bo", 1, 1, 3, 0), ("bo", 2, 2, 3, 0)]


def test_mails_with_subjects_and_attachments(spark, tmp_path):
    """Whatever a text holds, it is read back as subject and body, and attachments are listed."""
    from vellum.plans import records

    texts = [None, "", "a  b", " lead and trail ", "nl\nin\n", "tab\tx\r\ny\r", "éÜ日本 =?utf-8?B?YQ==?= x", "\n\nFrom: x\n--b\n", "😀" * 30]
    rows = [(conv, turn, "user", text) for conv in (3, 4) for turn, text in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["conv_id"], r["turn"]): r["layout"] for r in records.fn18_email_layout(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for conv, turn, _, text in rows:
        cc, attached = "" if turn % 2 else "Cc: copy\n", "\n\nAttachments:\n  - a.pdf" if conv == 3 else ""
        assert got[conv, turn] == f"From: user\nTo: desk\n{cc}Date: Mon, 01 Jan 2024 10:{turn:02}:00 +0000\nSubject: {(text or '')[:20]}\n\n{text or '(no body)'}{attached}"
