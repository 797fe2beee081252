"""Case functions against plain Python, mail, presence and the name lists."""

from datetime import date, timedelta
from email.message import EmailMessage

from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.operators import cases, names
from vellum.sources import readers
from vellum.streaming import audit

TODAY = date(2024, 3, 10)
CASES = "id long, received date, completed date, due date, status string, archived boolean, clock_paused boolean, paused_at date, paused_days int"


def rows():
    d = lambda n: TODAY + timedelta(days=n)
    return [
        (1, d(-40), None, d(-10), "reviewing", False, False, None, 0),  # ten days late
        (2, d(-40), None, d(-10), "reviewing", False, True, d(-12), 0),  # late but for a running pause
        (3, d(-40), None, d(-10), "pending", False, True, d(3), 4),  # a pause that has yet to begin
        (4, d(-20), d(-2), d(10), "complete", False, False, None, 0),
        (5, d(-60), d(-1), d(-30), "complete", True, False, None, 5),
        (6, d(-28), None, None, "reviewing", False, False, None, 0),
        (7, d(-28), None, d(2), "reviewing", False, False, None, 3),
    ]


def plain_days(r):
    if r[3] is None:
        return 99
    live = max(0, (TODAY - r[7]).days) if r[6] and r[7] else 0
    return (r[3] + timedelta(days=(r[8] or 0) + live) - TODAY).days


def test_clock_counts_a_running_pause(spark):
    df, today = spark.createDataFrame(rows(), CASES), F.lit(TODAY)
    got = {r["id"]: r["days_remaining"] for r in cases.with_clock(df, today).collect()}
    assert got == {r[0]: plain_days(r) for r in rows()} and got[1] == -10 and got[2] == 2
    late = sum(not r[5] and r[4] != "complete" and plain_days(r) < 0 for r in rows())
    assert cases.dashboard(df, today).first().asDict() == {"active": 6, "reviewing": 4, "complete": 1, "overdue": late, "archived": 1}
    assert [(r["id"], r["days"], r["late"], r["soon"], r["week"]) for r in cases.urgency(df, today).collect()] == [(1, -10, 1, 0, 1), (7, 5, 1, 0, 1)]
    t = cases.turnaround_totals(df, today).first()
    assert (t["total"], t["completed"], t["open"], t["overdue_open"], t["on_time"], t["on_time_pct"], t["avg_days"], t["max_days"]) == (7, 2, 5, 2, 1, 50.0, 38.5, 59)
    assert {r["month"]: (r["received"], r["completed"]) for r in cases.monthly(df).collect()} == {"2024-01": (4, 0), "2024-02": (3, 0), "2024-03": (0, 2)}


def test_findings(spark):
    made = [(1, 1, " Ann Lee", "person_name", "flagged", "a", ""), (1, 2, "ann lee ", "person_name", "approved", "b", "other"), (1, 3, "x", "email", "approved", "b", "own"), (2, 1, "ann lee", "person_name", "rejected", "a", "")]
    f = spark.createDataFrame(made, "case_id long, seq long, text string, category string, status string, source_file string, exemption string")
    assert {(r["category"], r["name"]): (r["n"], r["files"], r["n_flagged"]) for r in cases.by_name(f).collect()} == {("person_name", "ann lee"): (3, 2, 1), ("email", "x"): (1, 1, 0)}
    assert {(r["case_id"], r["exemption"]): r["n"] for r in cases.certificate_exemptions(f).collect()} == {(1, "Other (see notes)"): 1, (1, "own"): 1}
    assert [(r["category"], r["place"]) for r in cases.certificate_categories(f).orderBy("place").collect()] == [("person_name", 1), ("email", 2)]
    assert {r["case_id"]: (r["pct"], r["flagged"]) for r in cases.review_progress(f).collect()} == {1: (67, 1), 2: (100, 0)}
    summary = {r["id"]: r.asDict() for r in cases.case_summary(spark.createDataFrame(rows(), CASES), f, F.lit(TODAY)).collect()}
    assert summary[1]["total"] == 3 and summary[1]["files"] == 2 and summary[1]["reviewed"] == 2 and summary[7]["total"] == 0


def test_presence(spark):
    made = [(1, 0, "t", "a"), (2, 90, "t", "b"), (3, 181, "t", "c"), (4, 181, "u", "a"), (5, 181, "t", "b"), (6, 200, None, "a")]
    df = spark.createDataFrame(made, "event_id long, s long, target string, username string").withColumn("ts", F.timestamp_seconds("s"))
    want = {i: sorted({u2 for _, s2, t2, u2 in made if t2 == t and u2 != u and 0 <= s - s2 <= 90}) for i, s, t, u in made if t}
    assert {r["event_id"]: r["others"] for r in audit.presence(df).collect()} == want
    seen = audit.last_seen(df)
    assert [r["viewers"] for r in audit.present(seen.filter("target = 't'"), "1970-01-01 00:03:10", "c").collect()] == [["b"]]


def test_mail_limits(monkeypatch):
    monkeypatch.setattr(readers, "MAIL_BYTES", 10)
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@x.com", "b@x.com", "Hi"
    m.make_mixed()
    m.add_attachment(b"12345678901", maintype="text", subtype="plain", filename="big.txt")
    m.add_attachment(b"small", maintype="text", subtype="plain", filename="n.txt")
    m.add_attachment(b"x", maintype="application", subtype="x", filename="z.eml")
    found = list(readers.read_mail("f.eml", bytes(m)))
    assert [f[0] for f in found] == ["f.eml", "f__att__n.txt"] and found[1][2] == "small"
    assert found[0][2].split("\n")[-6:] == ["(no body)", "", "Attachments:", "  - big.txt (too large, not ingested)", "  - n.txt", "  - z.eml"]


def test_recall_over_all_listed_names(spark):
    """Notes, in layouts by turns, that name each listed forename with a surname that isn't listed, and the other way round."""
    layouts = ["Spoke with {f} {s} about it.", "{F} {S} attended.", "seen with daughter {f} {s} again"]
    show = lambda x: x.title() if "'" not in x else x[:2].title() + x[2:].title()
    pairs = [(show(f), "Okafor") for f in sorted(L.DEFAULT_LEXICON.forenames)] + [("Zbigniew", show(s)) for s in sorted(L.DEFAULT_LEXICON.surnames)]
    assert len(L.DEFAULT_LEXICON.forenames) == 280
    made = [(i, layouts[i % 3].format(f=f, s=s, F=f.upper(), S=s.upper()), f"{f} {s}".upper() if i % 3 == 1 else f"{f} {s}") for i, (f, s) in enumerate(pairs)]
    df = spark.createDataFrame(made, "id long, text string, name string")
    rows = df.select("id", "name", names.detect_names(F.col("text"), L.DEFAULT_LEXICON).alias("found")).collect()
    hits = [any(r["name"] in m["text"] for m in r["found"]) for r in rows]
    assert sum(hits) / len(hits) >= 0.97
    for text in ("Spoke with Sophia Lopez", "Seen with Walter Nowak", "LUCAS NOVAK attended", "Timothy Okafor rang", "Cooper, Patricia"):
        assert spark.createDataFrame([(text,)], "t string").select(F.size(names.detect_names(F.col("t"), L.DEFAULT_LEXICON)).alias("n")).first()["n"]
