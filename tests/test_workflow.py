"""Requests judged in order, finalising, resolving failures, the gate, logs and letters."""

from pyspark.sql import functions as F

from vellum.operators import letters, workflow

CASE = "id long, " + ", ".join(f"{n} {t}" for n, t in workflow.STATE.items()) + ", note string"
REQUEST = "case_id long, " + ", ".join(f"{n} {t}" for n, t in workflow.REQUEST.items()) + ", extra string"


def cases(spark, *rows):
    return spark.createDataFrame([tuple((r | {"note": "kept"}).get(n) for n in ["id", *workflow.STATE, "note"]) for r in rows], CASE)


def asked(spark, rows):
    """(case, action, role, user, value, override) in order, a day apart."""
    made = [(c, f"2024-01-{i + 1:02d}", i, user, role, action, value, override, "x") for i, (c, action, role, user, value, override) in enumerate(rows)]
    return spark.createDataFrame(made, REQUEST)


def verdicts(df):
    return [r["verdict"] for r in df.orderBy("case_id", "n").collect()]


def test_a_case_from_allocation_to_disclosure(spark):
    c = cases(spark, {"id": 1, "status": "reviewing", "workflow": "new"}, {"id": 2, "status": "pending"})
    steps = [
        (1, "allocate", "gp", "u1", "u1", None, "admins_only"), (1, "allocate", "admin", "a", "nobody", None, "no_such_user"), (1, "allocate", "admin", "a", "u1", None, "ok"),
        (1, "workflow", "gp", "u2", "ready_for_signoff", None, "not_own_case"), (1, "workflow", "gp", "u1", "in_review", None, "only_for_signoff"), (1, "workflow", "gp", "u1", "complete", None, "invalid_status"),
        (1, "pause", "admin", "a", None, None, "ok"), (1, "pause", "admin", "a", None, None, "already_paused"), (1, "resume", "admin", "a", "reason", None, "ok"), (1, "resume", "admin", "a", None, None, "not_paused"),
        (1, "workflow", "gp", "u1", "ready_for_signoff", None, "ok"), (1, "finalise", "admin", "a", None, None, "signoff_required"), (1, "signoff", "gp", "u1", None, None, "own_review"), (1, "signoff", "gp", "u2", None, None, "ok"),
        (1, "disclose", "admin", "a", None, None, "not_finalised"), (1, "finalise", "admin", "a", None, None, "ok"), (1, "disclose", "gp", "u2", None, None, "ok"), (1, "finalise", "admin", "a", None, None, "ok"),
        (1, "clear_signoff", "admin", "a", None, None, "ok"), (1, "finalise", "admin", "a", None, None, "signoff_required"), (1, "archive", "gp", "u2", None, None, "ok"), (1, "dance", "admin", "a", None, None, "unknown"),
        (9, "pause", "admin", "a", None, None, "not_found"),
    ]
    done = workflow.judged(c, asked(spark, [s[:6] for s in steps]), workflow.Settings(True, frozenset({"u1", "u2"})))
    assert verdicts(done) == [s[6] for s in steps]
    got = {r["id"]: r.asDict() for r in workflow.after(c, done).collect()}
    assert got[1] == {
        "id": 1, "status": "complete", "workflow": "complete", "allocated_to": "u1", "signoff_by": None, "completed_at": "2024-01-16", "clock_paused": False, "paused_at": None,
        "paused_days": 2, "n_failures": None, "needs_refinalise": False, "archived": True, "note": "kept",
    }
    assert got[2]["status"] == "pending" and got[2]["note"] == "kept" and len(got) == 2
    assert [tuple(r) for r in workflow.pause_log(done).collect()] == [(1, 9, "2024-01-07", "2024-01-09", "reason", 2)]


def test_disclosure_gate(spark):
    made = [{"id": i, "status": "complete", "n_failures": n, "needs_refinalise": again} for i, (n, again) in enumerate([(0, False), (2, False), (0, True), (2, True)])]
    rows = [(i, "disclose", role, "u", None, override) for i in range(4) for role, override in (("admin", False), ("gp", True), ("admin", True))]
    done = workflow.judged(cases(spark, *made), asked(spark, rows), workflow.Settings())
    assert verdicts(done) == ["ok", "ok", "ok", "failures", "admin_override_only", "ok", "needs_refinalise", "admin_override_only", "ok", "failures", "admin_override_only", "ok"]


def test_pauses_that_were_open_before(spark):
    c = cases(spark, {"id": 1, "clock_paused": True, "paused_at": "2023-12-30T10:00:00", "paused_days": 5}, {"id": 2, "clock_paused": True, "paused_at": "no date"})
    done = workflow.judged(c, asked(spark, [(1, "resume", "admin", "a", None, None), (2, "resume", "admin", "a", None, None)]), workflow.Settings())
    assert {r["case_id"]: (r["days"], r["reason"]) for r in workflow.pause_log(done).collect()} == {1: (2, ""), 2: (0, "")}
    assert {r["id"]: r["paused_days"] for r in workflow.after(c, done).collect()} == {1: 7, 2: 0}
    assert workflow.judged(c.limit(0), asked(spark, []), workflow.Settings()).count() == 0


CANDIDATE = "case_id long, id string, seq int, source_file string, page_num int, x0 double, y0 double, x1 double, y1 double, text string, category string, status string, confidence double, reason string, exemption string"


def test_finalising_and_resolving(spark):
    rows = [
        (1, "a", 1, "f", 0, 1.0, 1.0, 2.0, 2.0, "boxed", "email", "approved", 0.845, "Why", "third_party"),
        (1, "b", 2, "f", 0, 0.0, 1.0, 2.0, 2.0, "Seen", "person_name", "auto_redact", 0.9, "", ""),
        (1, "c", 3, "f", 0, 0.0, 0.0, 0.0, 0.0, "unseen", "email", "approved", 0.5, "Why", "own_code"),
        (1, "d", 4, "f", 9, 1.0, 1.0, 2.0, 2.0, "no page", "email", "approved", 0.5, None, None),
        (1, "e", 5, "f", 0, 0.0, 0.0, 0.0, 0.0, " ", "manual", "approved", 1.0, "", ""),
        (1, "f", 6, "f", 0, 0.0, 0.0, 0.0, 0.0, "unseen", "email", "flagged", 0.125, "Why", ""),
        (2, "a", 1, "f", 0, 0.0, 0.0, 0.0, 0.0, "Seen", "email", "approved", 0.5, "Why", ""),
        (2, "x", 2, "f", 0, 0.0, 0.0, 0.0, 0.0, None, "email", "rejected", None, None, ""),
    ]
    c = spark.createDataFrame(rows, CANDIDATE)
    pages = spark.createDataFrame([(1, "f", 0, "it was SEEN here"), (2, "f", 0, None)], "case_id long, source_file string, page_num int, text string")
    done, placed = workflow.finalise(cases(spark, {"id": 1}, {"id": 2}, {"id": 3}), c, pages)
    assert {(r["case_id"], r["id"]): r["outcome"] for r in placed.collect()} == {(1, "a"): "box", (1, "b"): "search", (1, "c"): "failed", (1, "d"): "failed", (1, "e"): "failed", (2, "a"): "failed"}
    assert {r["id"]: (r["n_failures"], r["needs_refinalise"]) for r in done.collect()} == {1: (3, False), 2: (1, False), 3: (0, False)}
    failures = placed.filter("outcome = 'failed'").select("case_id", "id", "text")
    asked_for = [(1, "c", False), (1, "d", False), (1, "e", False), (1, "e", True), (1, "b", True), (3, "a", True)]
    requests = spark.createDataFrame(asked_for, "case_id long, id string, dismissed boolean")
    done2, c2, left = workflow.resolve(done, c, failures, requests)
    got = {(r["case_id"], r["id"]): (r["status"], r["reason"]) for r in c2.collect()}
    assert got[1, "c"] == ("rejected", "Why; Superseded by manual redaction via fix queue") and got[1, "d"] == ("rejected", "Superseded by manual redaction via fix queue")
    assert got[1, "e"] == ("rejected", "") and got[1, "b"] == ("auto_redact", "") and got[2, "a"] == ("approved", "Why")
    assert [(r["case_id"], r["id"]) for r in left.collect()] == [(2, "a")]
    assert {r["id"]: (r["n_failures"], r["needs_refinalise"]) for r in done2.collect()} == {1: (0, True), 2: (1, False), 3: (0, False)}
    again = workflow.resolve(done2, c2, left, requests)
    assert {r["id"]: r["needs_refinalise"] for r in again[0].collect()} == {1: True, 2: False, 3: False} and again[2].count() == 1


def test_redaction_log(spark):
    rows = [
        (1, 1, "auto_redact", False, "email", "a@b", "f.pdf", 0, 0.845, "Why", "third_party", [("hiv", "health")]),
        (1, 2, "approved", False, "person_name", "Al", "f.pdf", 1, 0.9, "", "own_code", []),
        (1, 3, "approved", True, "email", "lost", "g.pdf", 2, 0.5, "Because", "", None),
        (1, 4, "rejected", False, "email", "no", "g.pdf", 2, 0.5, "Because", "", []),
        (1, 5, "flagged", False, "email", "?", "g.pdf", 2, 0.125, None, "", []),
        (1, 6, "excluded_subject", False, "email", "me", "g.pdf", 2, 1.0, "", "", []),
    ]
    schema = "case_id long, seq int, status string, failed boolean, category string, text string, source_file string, page_num int, confidence double, reason string, exemption string, risk_flags array<struct<phrase:string,category:string>>"
    images = spark.createDataFrame([(1, "g.pdf", 4), (7, "x", 1)], "case_id long, source_file string, page_num int")
    log = letters.redaction_log(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame(rows, schema), images, "now")
    text = {}
    for r in log.orderBy(*letters.LINE[:4]).collect():
        text.setdefault(r["case_id"], []).append(r["line"])
    one = "\n".join(text[1])
    assert "SAR Reference: 1\nGenerated: now\n\nSUMMARY" in one and "Total detections: 6\nRedactions applied: 2\nREDACTION FAILURES (approved but NOT applied): 1\nExcluded (data subject): 1\nExcluded (staff): 0" in one
    assert '\n1. [EMAIL]\n   Text: "a@b"\n   File: f.pdf\n   Page: 1\n   Confidence: 84%\n   Reason: Why\n   Method: Auto-redacted\n   Exemption: Third-party data (s.16(4))\n   Risk flags: health: hiv\n\n2. [PERSON_NAME]' in one
    assert "   Method: Manually approved\n   Exemption: own_code\n\n====" in one and '1. [EMAIL]\n   Text: "lost"\n   File: g.pdf\n   Page: 3\n   Reason for detection: Because' in one
    assert "   Confidence: 12%\n\n====" in one and one.endswith("\n\n1. File: g.pdf\n   Page: 5")
    order = [one.index(letters.TITLES[s]) for s in (letters.APPLIED, letters.FAILED, letters.REJECTED, letters.UNREVIEWED, letters.UNSCREENED)]
    assert order == sorted(order)
    assert text[2][6:14] == [f"{label}: 0" for label, _ in letters.COUNTED] and text[2][-1] == letters.RULE and set(text) == {1, 2}


def test_letters(spark):
    schema = "id long, full_name string, first_name string, last_name string, address string, birth string, number string, received date, due date, n_files int, n_redacted int"
    rows = spark.createDataFrame([(1, None, "Ann", "Lee", "1 Road\n\n Town", "1 May", None, None, None, 1, 0), (2, "", "", "", None, "", " ", None, None, None, None)], schema)
    out = letters.letter(rows, letters.Practice(), F.lit("2024-02-03").cast("date"), letters.COVER)
    lines = {i: [r["line"] for r in out.filter(F.col("case_id") == i).orderBy(*letters.LINE[:4]).collect()] for i in (1, 2)}
    assert lines[1][:7] == ["My Surgery", "03 February 2024", "PRIVATE & CONFIDENTIAL", "Ann Lee", "1 Road", "Town", "Dear Ann Lee,"]
    assert lines[1][7] == "Re: Subject Access Request — Ann Lee · DOB 1 May" and "Enclosed: 1 document and a log of what was withheld and why." in lines[1]
    assert not any("blanked out" in x for x in lines[1]) and lines[1][-2:] == ["Yours sincerely,", "My Surgery"]
    assert "Dear Sir/Madam," in lines[2] and not any(x is None for x in lines[2])


def test_certificate(spark):
    rows = [(1, 1, "email", "", "approved"), (1, 2, "email", "other", "auto_redact"), (1, 3, None, "own", "approved"), (1, 4, "email", "", "rejected")]
    got = letters.certificate(spark.createDataFrame(rows, "case_id long, seq int, category string, exemption string, status string"))
    assert [(r["section"], r["item"], r["line"]) for r in got.orderBy("section", "item").collect()] == [
        (0, 1, "Total: 3 redactions"), (1, 1, "email: 2 redactions"), (1, 2, ": 1 redaction"), (2, 1, "Other (see notes): 1 redaction"), (2, 2, "Third-party data (s.16(4)): 1 redaction"), (2, 3, "own: 1 redaction"),
    ]


def test_log_deals_findings_by_case_twice(spark):
    """Once to number them, once beside the cases; before, each section and count made the findings anew."""
    from vellum.plans import disclosures

    plan = disclosures.snk01_redaction_log(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(case_id#") == 2
