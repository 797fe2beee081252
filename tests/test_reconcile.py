"""Two versions of a case's findings, decisions in batches, names learned from decisions."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from vellum.operators import learning, reconcile

OLD = "case_id long, id string, seq int, source_file string, page_num int, x0 double, y0 double, text string, category string, status string"
NEW = "case_id long, seq int, source_file string, page_num int, x0 double, y0 double, text string, category string, status string, note string"


def old(spark, rows):
    return spark.createDataFrame(rows, OLD)


def new(spark, rows):
    return spark.createDataFrame([(*r, "n") for r in rows], NEW)


def by_id(df):
    return {r["id"]: (r["seq"], r["status"], r["change"]) for r in df.collect()}


BEFORE = [
    (1, "a", 1, "f", 0, 10.04, 5.0, "Ann Lee", "person_name", "rejected"),
    (1, "b", 2, "f", 0, 30.0, 5.0, "ann lee ", "person_name", "approved"),
    (1, "c", 3, "f", 1, 9.0, 9.0, "[box]", "manual", "approved"),
    (1, "d", 4, "f", 2, 9.0, 9.0, "gone", "email", "flagged"),
    (2, "e", 1, "f", 0, 10.0, 5.0, "Ann Lee", "person_name", "flagged"),
    (2, "f", 2, None, None, None, None, None, None, "rejected"),
    (2, "g", 3, "f", 3, 1.0, 1.0, "twice", "email", "flagged"),
    (2, "h", 4, "f", 3, 1.0, 1.0, "twice", "email", "flagged"),
]


def test_detecting_anew(spark):
    after = [
        (1, 1, "f", 0, 10.0, 5.0, "ANN LEE", "person_name", "flagged"),  # a's place; the last decision on the name was b's
        (1, 2, "f", 5, 10.0, 5.0, "Ann Lee", "person_name", "flagged"),  # a new place, remembered all the same
        (1, 3, "f", 5, 10.0, 5.0, "Ann Lee", "email", "auto_redact"),  # another category isn't
        (2, 1, "f", 0, 10.0, 5.0, "Ann Lee", "person_name", "auto_redact"),  # another case's decision isn't; undecided before
        (2, 2, None, None, None, None, None, None, "flagged"),
        (2, 3, "f", 3, 1.0, 1.0, "twice", "email", "flagged"),
    ]
    got = reconcile.redetect(old(spark, BEFORE), new(spark, after))
    rows = by_id(got)
    assert rows["a"] == (1, "approved", "kept") and rows["e"] == (1, "auto_redact", "kept") and rows["f"] == (2, "rejected", "kept")
    assert rows["b"][2] == rows["d"][2] == rows["h"][2] == "gone" and rows["c"] == (3, "approved", "manual") and rows["g"][2] == "kept"
    fresh = {r["id"]: (r["category"], r["status"]) for r in got.filter("change = 'added'").collect()}
    assert sorted(fresh.values()) == [("email", "auto_redact"), ("person_name", "approved")] and all(len(i) == 16 for i in fresh)
    again = reconcile.redetect(old(spark, BEFORE), new(spark, after))
    assert {r["id"] for r in again.filter("change = 'added'").collect()} == set(fresh)
    assert got.filter("change = 'gone'").filter("note IS NOT NULL").count() == 0
    # detecting once more changes nothing
    valid = got.filter("change <> 'gone'").drop("change", "note")
    third = reconcile.redetect(valid, new(spark, after))
    assert {(r["id"], r["status"]) for r in third.filter("change <> 'gone'").collect()} == {(r["id"], r["status"]) for r in valid.collect()}


def test_parsing_anew_only_adds(spark):
    after = [
        (1, 1, "f", 0, 10.0, 5.0, "ANN LEE", "email", "flagged"),  # a's place, whatever the category
        (1, 2, "f", 7, 1.0, 1.0, "New", "email", "flagged"),
        (1, 3, "f", 7, 1.04, 1.0, "new", "email", "auto_redact"),  # the same place again
    ]
    got = reconcile.reparse(old(spark, BEFORE), new(spark, after)).collect()
    assert len(got) == len(BEFORE) + 1
    assert sorted((r["id"], r["status"]) for r in got if r["change"] == "kept") == sorted((r[1], r[9]) for r in BEFORE)
    added = [r for r in got if r["change"] == "added"]
    assert [(r["seq"], r["text"], r["status"], r["note"]) for r in added] == [(2, "New", "flagged", "n")]


def test_empty_versions(spark):
    none_old, none_new = old(spark, []), new(spark, [])
    assert {r["change"] for r in reconcile.redetect(old(spark, BEFORE), none_new).collect()} == {"gone", "manual"}
    assert {r["change"] for r in reconcile.redetect(none_old, new(spark, [(1, 1, "f", 0, 1.0, 1.0, "t", "email", "flagged")])).collect()} == {"added"}
    assert reconcile.redetect(none_old, none_new).count() == reconcile.reparse(none_old, none_new).count() == 0
    assert reconcile.reparse(old(spark, BEFORE), none_new).count() == len(BEFORE)


def test_batch_decisions(spark):
    findings = old(spark, BEFORE).withColumn("exemption", F.lit("third_party"))
    updates = spark.createDataFrame(
        [(1, "a", 1, "approved", "other"), (1, "a", 2, None, None), (1, "d", 5, "rejected", None), (1, "d", 3, "approved", None), (2, "a", 9, "approved", None)],
        "case_id long, id string, at int, status string, exemption string",
    )
    got = {r["id"]: (r["status"], r["exemption"]) for r in reconcile.decide_by_id(findings, updates).collect()}
    assert got["a"] == ("approved", "other") and got["d"] == ("rejected", "third_party") and got["e"] == ("flagged", "third_party") and len(got) == len(BEFORE)
    texts = spark.createDataFrame([(1, " ANN lee", 1, "rejected"), (2, "twice", 1, "approved"), (2, "twice", 2, "rejected")], "case_id long, text string, at int, status string")
    got = {r["id"]: r["status"] for r in reconcile.decide_by_text(findings, texts).collect()}
    assert (got["a"], got["b"], got["c"], got["e"], got["f"], got["g"]) == ("rejected", "rejected", "approved", "flagged", "rejected", "rejected")


def day(n):
    return dt.datetime(2024, 1, n)


def test_learned_names(spark):
    rows = [
        ("Dr Smithersfield", "person_name", "approved", day(1)),
        ("J. O'Dowda-Quill, J. O'Dowda-Quill", "person_name", "approved", day(2)),
        ("Mrs SMITHERSFIELD", "person_name", "approved", day(3)),
        ("Smithersfield", "person_name", "approved", day(2)),
        ("A Smithersfield", "person_name", "approved", day(5)),
        ("Smithersfield", "person_name", "rejected", day(9)),
        ("Smithersfield", "email", "approved", day(9)),
        ("John Smith Ward 'ab' --x-", "person_name", "approved", day(9)),
        (None, "person_name", "approved", day(9)),
        ("", "person_name", "approved", day(9)),
    ]
    schema = "text string, category string, status string, at timestamp"
    known = {"smith", "john"}
    state = learning.learn(spark.createDataFrame(rows, schema), known)
    got = {r["name"]: (r["n"], r["last_seen"], r["examples"]) for r in state.collect()}
    assert got == {"smithersfield": (4, day(5), ["Dr Smithersfield", "Smithersfield", "Mrs SMITHERSFIELD"]), "o'dowda-quill": (2, day(2), [rows[1][0]]), "mrs": (1, day(3), [rows[2][0]])}
    table = spark.createDataFrame([(" Smith",), ("JOHN",)], "name string")
    assert {r["name"] for r in learning.learn(spark.createDataFrame(rows, schema), table).collect()} == set(got)
    # in two portions as at once
    halves = [learning.learn(spark.createDataFrame(rows[:3], schema), known), learning.learn(spark.createDataFrame(rows[3:], schema), known)]
    both = {r["name"]: (r["n"], r["last_seen"], set(r["examples"])) for r in learning.add(*halves).collect()}
    assert {k: v[:2] for k, v in both.items()} == {k: v[:2] for k, v in got.items()} and len(both["smithersfield"][2]) == 3
    names = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert [r["name"] for r in learning.suggestions(state, names(), names(), 3).collect()] == ["smithersfield"]
    assert [r["name"] for r in learning.suggestions(state, names("SMITHERSFIELD "), names("zz")).collect()] == ["o'dowda-quill"]
    left, accepted = learning.accept(state, names("x"), names(" Smithersfield", "", "  "))
    assert {r["name"] for r in left.collect()} == {"o'dowda-quill", "mrs"} and {r["name"] for r in accepted.collect()} == {"x", "smithersfield"}
    left, dismissed = learning.dismiss(left, names(), names("O'DOWDA-QUILL"))
    assert {r["name"] for r in left.collect()} == {"mrs"}
    # a dismissed name is counted on, but doesn't come back
    later = learning.add(left, halves[0])
    assert later.filter("name = 'o''dowda-quill'").count() == 1
    assert "o'dowda-quill" not in {r["name"] for r in learning.suggestions(later, accepted, dismissed, 1).collect()}
    # what was accepted is found by the detector's lists
    from vellum.functions.lexicons import DEFAULT_LEXICON

    assert "smithersfield" in DEFAULT_LEXICON.extended(r["name"] for r in accepted.collect()).surnames


def test_examples_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("Abcd", "person_name", "approved", day(1))], "text string, category string, status string, at timestamp")
    plan = learning.learn(df, {"x"})._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["wf08_redetect", "set02_valid_findings", "wf09_reparse", "red03_failure_triage"])
def test_findings_are_dealt_by_case_once(spark, name):
    """What a query tells of findings comes of one shuffle by case; other shuffles only look up texts."""
    from vellum.plans import casework

    plan = casework.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert [keys.split("#")[0] for keys in dealt if "_partkey#" not in keys] == ["case_id"] and not any(", " in keys for keys in dealt)


def test_valid_findings_are_counted_as_detecting_anew_leaves_them(spark):
    before = [
        *BEFORE,
        (1, "i", 5, "f", 4, 1.0, 1.0, "Box", "manual", "approved"),
        (1, "j", 6, "f", 4, 1.0, 1.0, "box", "manual", "approved"),
        (3, "k", 1, None, None, None, None, None, "manual", "approved"),
        (3, "l", 2, "f", 1, 1.0, 1.0, "x", None, "flagged"),
    ]
    after = [
        (1, 1, "f", 0, 10.0, 5.0, "ANN LEE", "person_name", "flagged"),
        (1, 2, "f", 4, 1.04, 1.0, "BOX", "manual", "flagged"),  # one of the two that were there
        (2, 1, "f", 9, 1.0, 1.0, "new", "manual", "flagged"),
        (2, 2, "f", 9, 1.0, 1.0, "new", "manual", "flagged"),
        (3, 1, None, None, None, None, None, "manual", "flagged"),
        (3, 2, "f", 1, 1.0, 1.0, "x", None, "flagged"),
        (3, 3, "f", 1, 1.0, 1.0, "y", None, "flagged"),
    ]
    both = reconcile.stacked(old(spark, before), new(spark, after))
    want = reconcile.redetect_stacked(both).filter("change <> 'gone'").groupBy("case_id", "category").agg(F.count("*").alias("n"))
    got = {(r["case_id"], r["category"]): r["n"] for r in reconcile.count_valid(both).collect()}
    assert got == {(r["case_id"], r["category"]): r["n"] for r in want.collect()}
    assert got[(1, "manual")] == 3 and got[(2, "manual")] == 2 and got[(3, None)] == 2


def shuffled(spark, name):
    """The rows that a query deals by case, as the plan names their columns, and the whole plan."""
    from vellum.plans import casework

    plan = casework.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = re.search(r"Exchange hashpartitioning\(case_id.*?Project \[(.*?)\]\n", plan, re.S).group(1)
    return rows, plan


def test_counting_valid_findings_deals_no_numbers_and_few_columns(spark):
    rows, plan = shuffled(spark, "set02_valid_findings")
    assert "Window" not in plan and "l_shipdate" not in plan and "l_extendedprice" not in plan
    assert "p_name#" not in re.sub(r"CASE WHEN.*? END AS \w+#\d+L?", "", rows)  # a text is dealt with a manual finding only


def test_findings_are_dealt_as_they_were_read(spark):
    """What is made of a finding's columns, such as its status and file, is made after the shuffle by case."""
    rows, _ = shuffled(spark, "wf09_reparse")
    assert "p_name#" in rows and " AS " not in rows.replace("l_orderkey", "").replace("AS case_id", "")
