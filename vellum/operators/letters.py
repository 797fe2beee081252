"""Documents about a case as ordered lines: the redaction log, the cover letter, the acknowledgment, the certificate.

Every document is a table (case_id, section, item, line_no, line): sections are tables of their own, put together by union;
sorted by these columns they read as the document. Items are numbered within their case and section; counts come from one
aggregation a case. Nothing is gathered: an item is one row until its lines are made.

Defined cases: a case without findings has a log with a summary of zeros; a section without items but the first has no lines;
null texts and reasons show as empty; unknown exemption codes show as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import lexicons as L

LINE = ("case_id", "section", "item", "line_no", "line")
RULE = "=" * 60
SUMMARY, APPLIED, FAILED, REJECTED, UNREVIEWED, UNSCREENED = range(6)

# What the log's lines say; {} are filled in.
TITLES = {
    APPLIED: "REDACTIONS APPLIED", FAILED: "!!! REDACTION FAILURES — APPROVED BUT NOT APPLIED !!!", REJECTED: "REJECTED (NOT REDACTED)",
    UNREVIEWED: "UNREVIEWED (NOT REDACTED)", UNSCREENED: "UNSCREENED PAGES — NOT CHECKED BY AUTOMATED DETECTION",
}
COUNTED = (
    ("Total detections", "total"), ("Redactions applied", "applied"), ("REDACTION FAILURES (approved but NOT applied)", "failed"),
    ("Excluded (data subject)", "excluded_subject"), ("Excluded (staff)", "excluded_staff"), ("Rejected by reviewer", "rejected"),
    ("Unreviewed (not redacted)", "unreviewed"), ("UNSCREENED PAGES (image-only, no OCR)", "unscreened"),
)
#: What follows the titles of these two sections, in own words.
WARNINGS = {
    FAILED: ("Approved, but not found on their pages: these stay visible in the documents", "and have to be blanked out by hand before disclosure."),
    UNSCREENED: ("Pages of images that no text could be read from: no detection has seen them.", "They have to be read by a person before disclosure."),
}


def section_of(status: Column, failed: Column) -> Column:
    approved = status.isin("auto_redact", "approved")
    return F.when(approved & failed, FAILED).when(approved, APPLIED).when(status == "rejected", REJECTED).when(status == "flagged", UNREVIEWED)


def log_counts(cases: DataFrame, findings: DataFrame, unscreened: DataFrame) -> DataFrame:
    """(case_id, total, applied, failed, ...) of every case(id); findings(case_id, status, failed), unscreened(case_id)."""
    n = lambda c: F.count(F.when(c, 1))
    section, status = section_of(F.col("status"), F.col("failed")), F.col("status")
    per = findings.groupBy(F.col("case_id").alias("__c")).agg(
        F.count("*").alias("total"), n(section == APPLIED).alias("applied"), n(section == FAILED).alias("failed"), n(status == "excluded_subject").alias("excluded_subject"),
        n(status == "excluded_staff").alias("excluded_staff"), n(section == REJECTED).alias("rejected"), n(section == UNREVIEWED).alias("unreviewed"),
    )
    pages = unscreened.groupBy(F.col("case_id").alias("__p")).agg(F.count("*").alias("unscreened"))
    out = cases.select(F.col("id").alias("case_id")).join(per, F.col("case_id") == F.col("__c"), "left").join(pages, F.col("case_id") == F.col("__p"), "left")
    return out.select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for _, c in COUNTED])


def _block(section: int | Column, item: Column, lines: Sequence[Column] | Column, when: Column | None = None) -> Column:
    """The lines that aren't null as array<struct<section, item, line_no, line>>; none where `when` doesn't hold."""
    section = F.lit(section) if isinstance(section, int) else section
    made = lines if isinstance(lines, Column) else F.array_compact(F.array(*lines))
    rows = F.transform(made, lambda x, i: F.struct(section.cast("int").alias("section"), item.cast("long").alias("item"), i.alias("line_no"), x.alias("line")))
    return rows if when is None else F.when(when, rows).otherwise(F.slice(rows, 1, 0))


def _lines(rows: DataFrame, *blocks: Column) -> DataFrame:
    """All lines of the blocks of each row, made in one pass."""
    return rows.select("case_id", F.inline(F.flatten(F.array(*blocks)))).select(*LINE)


def _items(rows: DataFrame, section: int | Column, lines: Sequence[Column]) -> DataFrame:
    """The lines that aren't null of items, rows with item."""
    section = F.lit(section) if isinstance(section, int) else section
    made = rows.select("case_id", section.cast("int").alias("section"), F.col("item").cast("long").alias("item"), F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "line"))
    return made.select(*LINE)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def redaction_log(cases: DataFrame, findings: DataFrame, unscreened: DataFrame, generated: str) -> DataFrame:
    """The log of every case(id).

    findings(case_id, seq, status, failed, category, text, source_file, page_num, confidence, reason, exemption, risk_flags):
    failed says whether an approved one couldn't be placed; risk_flags are array<struct<phrase, category>>.
    unscreened(case_id, source_file, page_num)."""
    asked = findings.withColumn("kind", F.lit(1)).unionByName(unscreened.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return log_of(cases, asked, generated)


def log_of(cases: DataFrame, asked: DataFrame, generated: str) -> DataFrame:
    """redaction_log() of findings (kind 1) and unscreened pages (kind 2) in one table: all rows are dealt by case once."""
    rows = asked.unionByName(cases.select(F.col("id").alias("case_id"), F.lit(0).alias("kind")), allowMissingColumns=True).repartition("case_id")
    kind, status = F.col("kind"), F.col("status")
    rows = rows.withColumn("section", F.when(kind == 1, section_of(status, F.col("failed"))).when(kind == 2, UNSCREENED))
    n = lambda c: F.count(F.when(c, 1)).over(W.partitionBy("case_id"))
    counts = {
        "total": kind == 1, "applied": F.col("section") == APPLIED, "failed": F.col("section") == FAILED, "excluded_subject": (kind == 1) & (status == "excluded_subject"),
        "excluded_staff": (kind == 1) & (status == "excluded_staff"), "rejected": F.col("section") == REJECTED, "unreviewed": F.col("section") == UNREVIEWED, "unscreened": kind == 2,
    }
    rows = rows.withColumns({"n_cases": n(kind == 0), **{f"n_{c}": n(test) for c, test in counts.items()}})
    rows = rows.filter((kind == 0) | F.col("section").isNotNull() & ((kind == 1) | (F.col("n_cases") > 0)))
    nth = F.row_number().over(W.partitionBy("case_id", "kind", "section").orderBy(F.when(kind == 1, F.col("seq")), "source_file", "page_num"))
    rows, zero = rows.withColumn("item", nth), F.lit(0)
    head = [F.lit("SUBJECT ACCESS REQUEST - REDACTION LOG"), F.concat(F.lit("SAR Reference: "), F.col("case_id").cast("string")), F.lit(f"Generated: {generated}"), F.lit(""), F.lit("SUMMARY"), F.lit("-" * 50)]
    head += [F.concat(F.lit(f"{label}: "), F.col(f"n_{c}").cast("string")) for label, c in COUNTED]
    blocks = [_block(SUMMARY, zero, head)]
    for section, column in ((APPLIED, None), (FAILED, "failed"), (REJECTED, "rejected"), (UNREVIEWED, "unreviewed"), (UNSCREENED, "unscreened")):
        more = ["", *WARNINGS[section]] if section in WARNINGS else []
        blocks.append(_block(section, zero, [F.lit(x) for x in ("", RULE, TITLES[section], RULE, *more)], F.col(f"n_{column}") > 0 if column else None))

    here = F.col("section")
    label = lambda text, value: F.concat(F.lit(f"   {text}: "), value)
    page = (F.col("page_num") + 1).cast("string")
    sure = F.concat(F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%"))
    code, flags = F.coalesce("exemption", F.lit("")), F.col("risk_flags")
    exemption = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.EXEMPTIONS.items() for x in kv]), code), code)
    method = F.when(F.col("status") == "auto_redact", "Auto-redacted").otherwise("Manually approved")
    shown = F.array_join(F.transform(flags, lambda f: F.concat_ws(": ", f["category"], f["phrase"])), ", ")
    only = lambda test, line: F.when(test, line)
    lines = [
        F.lit(""), F.concat(F.col("item").cast("string"), F.lit(". ["), F.upper(_text("category")), F.lit("]")), label("Text", F.concat(F.lit('"'), _text("text"), F.lit('"'))),
        label("File", _text("source_file")), label("Page", page), only(here.isin(APPLIED, UNREVIEWED), label("Confidence", sure)), only(here == APPLIED, label("Reason", _text("reason"))),
        only(here.isin(FAILED, REJECTED), label("Reason for detection", _text("reason"))), only(here == APPLIED, label("Method", method)),
        only((here == APPLIED) & (code != ""), label("Exemption", exemption)), only((here == APPLIED) & (F.size(flags) > 0), label("Risk flags", shown)),
    ]
    image = [F.lit(""), F.concat(F.col("item").cast("string"), F.lit(". File: "), _text("source_file")), label("Page", page)]
    item = F.col("item")
    made = F.when(kind == 0, F.flatten(F.array(*blocks))).when(kind == 1, _block(here, item, lines)).otherwise(_block(UNSCREENED, item, image))
    return _lines(rows, made)


# ---- letters ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Practice:
    """Who writes; paragraphs, by letter, are templates with {name}, {received}, {due}, {practice}, {contact}, {files}, {plural}."""

    name: str = "My Surgery"
    address: str = ""
    officer: str = ""
    role: str = "Data Protection Lead"
    email: str = ""
    footer: str = ""


#: Paragraphs of the letters, in own words; those marked redacted only where something was.
COVER = (
    ("always", "You asked {practice} on {received} for the information we hold about you. It is enclosed."),
    ("always", "Enclosed: {files} document{plural} and a log of what was withheld and why."),
    ("redacted", "Parts are blanked out where the law exempts them, most often because they are about someone else."),
    ("always", "If you think that something is missing or wrong, write to {contact}. You may also complain to the regulator."),
)
ACKNOWLEDGMENT = (
    ("always", "We received your request for the information we hold about you on {received}."),
    ("always", "You will have our answer by {due}. If we need longer, or need to know who you are, we will write to you."),
    ("always", "If you have questions, write to {contact}."),
)


def letter(cases: DataFrame, practice: Practice, today: Column, paragraphs: Sequence[tuple[str, str]], custom: str = "") -> DataFrame:
    """A letter to the subject of every case(id, full_name, first_name, last_name, address, birth, number, received, due, n_files, n_redacted).

    Sections: 0 letterhead, 1 addressee, 2 reference, 3 paragraphs, 4 closing; empty parts leave no line."""
    name = F.coalesce(F.nullif(F.trim(_text("full_name")), F.lit("")), F.trim(F.concat_ws(" ", "first_name", "last_name")))
    rows = cases.withColumnRenamed("id", "case_id").withColumn("__name", F.coalesce(name, F.lit("")))
    given = lambda x: F.lit(x) if x.strip() else F.lit(None).cast("string")
    own_lines = lambda text: [F.lit(x.strip()) for x in text.splitlines() if x.strip()]
    long_date = lambda d: F.date_format(d, "dd MMMM yyyy")
    have = lambda c: F.nullif(F.trim(_text(c)), F.lit(""))
    zero = F.lit(0)
    blocks = [_block(0, zero, [F.lit(practice.name), *own_lines(practice.address), long_date(today)])]
    home = F.filter(F.transform(F.split(_text("address"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    addressed = F.concat(F.array(F.lit("PRIVATE & CONFIDENTIAL"), F.col("__name")), home)
    blocks.append(_block(1, zero, addressed))
    reference = F.concat_ws(" · ", F.concat(F.lit("Subject Access Request — "), F.col("__name")), F.concat(F.lit("DOB "), have("birth")), F.concat(F.lit("NHS No. "), have("number")))
    dear = F.when(F.col("__name") == "", "Sir/Madam").otherwise(F.col("__name"))
    blocks.append(_block(2, zero, [F.concat(F.lit("Dear "), dear, F.lit(",")), F.concat(F.lit("Re: "), reference)]))
    contact = (practice.officer or practice.name) + (f" at {practice.email}" if practice.email else "")
    slots = {
        "{name}": F.col("__name"), "{received}": F.coalesce(long_date(F.col("received")), F.lit("")), "{due}": F.coalesce(long_date(F.col("due")), F.lit("")), "{practice}": F.lit(practice.name),
        "{contact}": F.lit(contact), "{files}": _text("n_files"), "{plural}": F.when(F.col("n_files") == 1, "").otherwise("s"),
    }
    body = []
    for when, text in (*paragraphs, *([("always", custom.strip())] if custom.strip() else [])):
        said = F.lit(text)
        for slot, value in slots.items():
            if slot in text:
                said = F.replace(said, F.lit(slot), value)
        body.append(said if when == "always" else F.when(F.coalesce(F.col("n_redacted"), zero) > 0, said))
    blocks.append(_block(3, zero, body))
    signed = [given(practice.officer), F.when(given(practice.officer).isNotNull(), F.lit(practice.role)), F.lit(practice.name), given(practice.footer)]
    return _lines(rows, *blocks, _block(4, zero, [F.lit("Yours sincerely,"), *signed]))


def certificate(findings: DataFrame) -> DataFrame:
    """What was redacted of each case(case_id, category, exemption, seq): a section by category, one by exemption, the total first.

    Totals and both groupings come from one pass with grouping sets; larger counts first, then names."""
    code = F.coalesce(F.nullif("exemption", F.lit("")), F.lit("third_party"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.EXEMPTIONS.items() for x in kv]), code), code)
    rows = findings.filter(F.col("status").isin("auto_redact", "approved")).select("case_id", F.coalesce("category", F.lit("")).alias("category"), label.alias("label"))
    c, k, e = F.col("case_id"), F.col("category"), F.col("label")
    sums = rows.groupingSets([[c], [c, k], [c, e]], c, k, e).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(k.isNotNull(), 1).when(e.isNotNull(), 2).otherwise(0)
    sums = sums.withColumns({"section": section, "what": F.coalesce(k, e, F.lit("Total"))})
    item = F.row_number().over(W.partitionBy("case_id", "section").orderBy(F.col("n").desc(), "what"))
    many = F.when(F.col("n") == 1, " redaction").otherwise(" redactions")
    return _lines(sums.withColumn("item", item), _block(F.col("section"), F.col("item"), [F.concat("what", F.lit(": "), F.col("n").cast("string"), many)]))


#: Sources that an answer shows.
SOURCES = 3
PATIENT = (("Name", "full_name"), ("Date of Birth", "date_of_birth"), ("NHS Number", "nhs_number"), ("Address", "address"), ("GP", "gp_name"), ("Practice", "gp_practice"))


def report(reports: DataFrame, answers: DataFrame, evidence: DataFrame, generated: Column) -> DataFrame:
    """The lines of every report: section 0 its heading, 1 the patient, 2 questions and answers, 3 a rule at the end.

    reports(case_id, template_name[, full_name, date_of_birth, ...]), answers(case_id, seq, question_id, question_text, answer), evidence(case_id,
    question_id, place, source_file, page_num, text): an answer names the first SOURCES places whose text isn't empty."""
    zero = F.lit(0)
    head = [F.lit("MEDICAL REPORT"), F.concat(F.lit("Report Type: "), F.coalesce("template_name", F.lit("General"))), F.concat(F.lit("Generated: "), F.date_format(generated, "dd MMMM yyyy")), F.concat(F.lit("Report ID: "), F.col("case_id").cast("string"))]
    have = lambda c: F.nullif(_text(c), F.lit("")) if c in reports.columns else F.lit(None).cast("string")
    patient = [F.lit("PATIENT DETAILS"), *[F.concat(F.lit(f"{label}: "), have(c)) for label, c in PATIENT]]
    out = _lines(reports, _block(0, zero, head), _block(1, zero, patient), _block(2, zero, [F.lit("REPORT FINDINGS")]), _block(3, zero, [F.lit("─" * 60)]))
    good = evidence.filter(F.coalesce("text", F.lit("")) != "").withColumn("__i", F.row_number().over(W.partitionBy("case_id", "question_id").orderBy("place")))
    ref = F.concat(F.col("source_file"), F.lit(" p."), (F.col("page_num") + 1).cast("string"))
    refs = good.filter(F.col("__i") <= SOURCES).groupBy("case_id", "question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", ref.alias("r")))), lambda x: x["r"]), "; ").alias("__refs"))
    rows = answers.withColumn("item", F.row_number().over(W.partitionBy("case_id").orderBy("seq"))).join(refs, ["case_id", "question_id"], "left")
    said = F.trim(_text("answer"))
    lines = [
        F.concat(F.lit("Q"), F.col("item").cast("string"), F.lit(". "), _text("question_text")),
        F.concat(F.lit("A: "), F.when(said == "", "[No answer provided]").otherwise(said)), F.concat(F.lit("Sources: "), F.col("__refs")),
    ]
    return out.unionByName(_items(rows, 2, lines))


def save_answers(answers: DataFrame, updates: DataFrame) -> DataFrame:
    """answers(case_id, question_id, ..., answer, reviewed) with the last of updates(case_id, question_id, at, answer, reviewed).

    An update without an answer or a mark clears it; one for a question that isn't asked changes nothing."""
    last = updates.groupBy("case_id", "question_id").agg(F.max_by(F.struct("answer", "reviewed"), "at").alias("__u"))
    out = answers.join(last, ["case_id", "question_id"], "left")
    hit = F.col("__u").isNotNull()
    return out.withColumns({
        "answer": F.when(hit, F.coalesce(F.col("__u")["answer"], F.lit(""))).otherwise(F.col("answer")),
        "reviewed": F.when(hit, F.coalesce(F.col("__u")["reviewed"], F.lit(False))).otherwise(F.col("reviewed")),
    }).select(*answers.columns)
