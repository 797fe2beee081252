"""Case, review, event and document queries as SQL over the engine views.

Each entry is a function of a dialect that returns one statement; Spark runs it with its own spelling, and the check
engine with its own. Time-dependent queries take views.TODAY for today."""

from __future__ import annotations

from collections.abc import Callable

from vellum.functions import lexicons as L
from vellum.plans import views as V

T = V.TODAY
Q: dict[str, Callable] = {}
REVIEWED = "('approved', 'rejected', 'auto_redact', 'excluded_subject', 'excluded_staff')"
BIG = lambda x: f"CAST({x} AS BIGINT)"
CAND_ORDER = "case_id, seq"


def query(name: str):
    def add(f):
        Q[name] = f
        return f

    return add


def left_days(d) -> str:
    """Days to the deadline, paused days and those of a running pause added; 99 without a date."""
    return f"COALESCE({d.days(T, 'effective_due')} + CASE WHEN clock_paused THEN greatest(0, {d.days('received', T)}) ELSE 0 END, 99)"


def newest_first(d, day: str, where: str = "TRUE") -> str:
    """All cases that pass, with their place by day, newest first, null last: the cases of later days, which are counted by
    day, and the place within the day. So no task sorts all cases."""
    return f"""WITH {V.case(d)}, r AS (SELECT id, {day}, COALESCE({day}, DATE '0001-01-01') AS k FROM v_case WHERE {where}),
n AS (SELECT k, COUNT(*) AS n FROM r GROUP BY k), b AS (SELECT k, SUM(n) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) - n AS later FROM n)
SELECT r.id, r.{day}, {BIG("later + ROW_NUMBER() OVER (PARTITION BY r.k ORDER BY r.id)")} AS place FROM r JOIN b ON b.k = r.k"""


# ---- sources ---------------------------------------------------------------------------------------------------------


@query("src01_allowed_extension")
def _(d):
    names = d.pick(["scan.PDF", "a.b.tiff", "note", "mail.eml", "archive.zip", "x.exe", "page.HTML", "letter.docx", "run.sh", ".rtf"], "doc_id % 10")
    allowed = ", ".join(f"'{x}'" for x in L.ALLOWED_TYPES)
    return f"""WITH f AS (SELECT doc_id, {names} AS name FROM documents)
SELECT doc_id, name, ({d.rx_like("name", "[.]")} AND lower({d.rx("name", "[.]([^.]*)$", 1)}) IN ({allowed})) AS allowed FROM f"""


@query("src05_html_text")
def _(d):
    body = d.rx_replace(d.rx_replace("html", "<(?:script|style)[^>]*>[^<]*</(?:script|style)>", " "), "<[^>]+>", " ")
    return f"""SELECT page_id, trim({d.rx_replace(body, "[ \\t\\r\\n]+", " ")}) AS text FROM pages"""


@query("src11_zip_caps")
def _(d):
    return f"""WITH {V.case(d)}, e AS (SELECT subject AS archive, id AS entry, {BIG("id % 977")} AS size FROM v_case),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY archive ORDER BY entry) AS n,
  {BIG("SUM(size) OVER (PARTITION BY archive ORDER BY entry ROWS UNBOUNDED PRECEDING)")} AS so_far FROM e)
SELECT archive, entry, size, so_far, (n <= 2000 AND size <= 800 AND so_far <= 4000) AS taken FROM r"""


@query("src12_unique_names")
def _(d):
    return f"""WITH n AS (SELECT p_partkey, CONCAT(CAST(p_size AS VARCHAR(20)), '.pdf') AS name FROM part),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, CASE WHEN k = 1 THEN name ELSE CONCAT({d.rx("name", "^(.*)[.]pdf$", 1)}, '-', CAST(k AS VARCHAR(20)), '.pdf') END AS name FROM r"""


@query("src15_page_needs_ocr")
def _(d):
    blank = "char_length(translate(t, CONCAT(' ', chr(10), chr(9)), ''))".replace("char_length", "length")
    return f"""WITH p AS (SELECT doc_id, doc_id % 2 AS n_images, COALESCE(text, '') AS t FROM documents)
SELECT doc_id, (n_images > 0 AND {blank} < 30) AS needs_ocr FROM p"""


@query("src16_image_only")
def _(d):
    return "SELECT doc_id, trim(CASE WHEN doc_id % 5 = 0 THEN '   ' ELSE text END) = '' AS image_only FROM documents"


@query("src18_page_count")
def _(d):
    return f"WITH {V.candidate(d)} SELECT source_file, {BIG('MAX(page_num) + 1')} AS pages FROM v_candidate GROUP BY source_file"


@query("src22_package_ids")
def _(d):
    ids = d.pick(["ok-1", "-bad", "a b", "Under_score", "", "x/y", "9lives"], "o_orderkey % 7")
    return f"""WITH p AS (SELECT o_orderkey, {ids} AS id FROM orders)
SELECT o_orderkey, id, {d.rx_like("id", "^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$")} AS valid,
  EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = p.o_orderkey) AS conflict FROM p"""


# ---- scalar functions ------------------------------------------------------------------------------------------------


@query("fn01_normalize")
def _(d):
    return f"""SELECT doc_id, lower({d.rx_replace("CONCAT('  ', COALESCE(text, ''), chr(9), ' ')", "(^[ \\t\\n\\r]+)|([ \\t\\n\\r]+$)", "")}) AS norm FROM documents"""


@query("fn02_strip_punctuation")
def _(d):
    return f"""WITH {V.planted(d)} SELECT doc_id, {d.rx_replace("CONCAT('-', surname, ';. ')", "^[ .,;:'-]+|[ .,;:'-]+$", "")} AS name FROM v_planted"""


@query("fn06_context_snippet")
def _(d):
    a = "greatest(found_at - 1 - 70, 0)"
    return f"""WITH {V.planted(d)}, p AS (SELECT doc_id, text, instr(text, 'Number') AS found_at FROM v_planted),
s AS (SELECT doc_id, text, {a} AS a, least(found_at + 5 + 70, length(text)) AS b FROM p)
SELECT doc_id, CONCAT(CASE WHEN a > 0 THEN '…' ELSE '' END, trim({d.rx_replace("substr(text, CAST(a + 1 AS INT), CAST(b - a AS INT))", "[ \\n\\t]+", " ")}),
  CASE WHEN b < length(text) THEN '…' ELSE '' END) AS context FROM s"""


@query("fn07_name_variants")
def _(d):
    return f"""WITH {V.planted(d)}, n AS (SELECT doc_id, CASE WHEN layout < 5 THEN CONCAT(surname, ', ', forename) ELSE CONCAT(forename, ' ', surname) END AS t FROM v_planted)
SELECT doc_id, t AS name, CASE WHEN instr(t, ',') > 0 THEN CONCAT(trim(substr(t, instr(t, ',') + 1)), ' ', trim(substr(t, 1, instr(t, ',') - 1))) END AS variant FROM n"""


@query("fn09_check_digit")
def _(d):
    digits = d.rx_replace("n", "[^0-9]", "")
    total = " + ".join(f"CAST(substr(k, {i + 1}, 1) AS INT) * {10 - i}" for i in range(9))
    return f"""WITH p AS (SELECT doc_id, {d.pick(V.NUMBERS, f"doc_id % {len(V.NUMBERS)}")} AS n FROM documents), q AS (SELECT doc_id, n, {digits} AS k FROM p),
r AS (SELECT *, 11 - ({total}) % 11 AS c FROM q)
SELECT doc_id, n, (c <> 10 AND CASE WHEN c = 11 THEN 0 ELSE c END = CAST(substr(k, 10, 1) AS INT)) AS valid FROM r"""


@query("fn10_valid_name_word")
def _(d):
    w = d.rx_replace("lower(w)", "[.,;:]+$", "")
    words = ", ".join(f"'{x}'" for x in L.NOT_NAMES)
    return f"""WITH {V.planted(d)}, s AS (SELECT DISTINCT w FROM v_planted {d.unnest(d.split("text", "[ \\n]+"), "w")})
SELECT w, ({w} NOT IN ({words}) AND length({w}) >= 2 AND NOT {d.rx_like(w, "^[0-9]+$")}) AS valid FROM s"""


@query("fn11_filename_date")
def _(d):
    f = d.pick(["2024-02-30_letter.pdf", "2023-11-05_scan.pdf", "2021-01-09 note.txt", "20240101.pdf", "x2024-01-01_.pdf"], "doc_id % 5")
    return f"""WITH p AS (SELECT doc_id, {f} AS name FROM documents)
SELECT doc_id, name, {d.try_date(d.rx("name", "^([0-9]{4}-[0-9]{2}-[0-9]{2})[_ \\t]", 1))} AS dated FROM p"""


@query("fn14_due_dates")
def _(d):
    return f"WITH {V.case(d)} SELECT id, due, effective_due FROM v_case"


@query("fn16_days_remaining")
def _(d):
    return f"WITH {V.case(d)} SELECT id, {BIG(left_days(d))} AS days_remaining FROM v_case"


@query("fn15_live_paused_days")
def _(d):
    return f"WITH {V.case(d)} SELECT id, {BIG('CASE WHEN clock_paused THEN greatest(0, ' + d.days('received', T) + ') ELSE 0 END')} AS live FROM v_case"


@query("fn17_display_dates")
def _(d):
    return f"WITH {V.case(d)} SELECT id, {d.show_date('received')} AS shown FROM v_case"


@query("fn19_tag_strip")
def _(d):
    return f"SELECT page_id, {d.rx_replace('html', '<[^>]+>', '')} AS text FROM pages"


@query("fn21_display_name")
def _(d):
    return """SELECT c_custkey, COALESCE(NULLIF(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), trim(CONCAT(c_mktsegment, ' ', c_name))) AS shown FROM customer"""


@query("fn22_labels")
def _(d):
    f = d.pick(["cover_letter.pdf", "certificate.pdf", "notes_redacted.pdf", "other.pdf"], "p_partkey % 4")
    return f"""WITH p AS (SELECT p_partkey, {f} AS f FROM part) SELECT p_partkey, CASE WHEN f LIKE 'cover_letter%' THEN 'Cover letter'
  WHEN f LIKE 'certificate%' THEN 'Certificate of redaction' WHEN f LIKE '%_redacted.pdf' THEN CONCAT({d.rx("f", "^(.*)_redacted[.]pdf$", 1)}, ' (redacted)') ELSE f END AS label FROM p"""


@query("fn24_truncate")
def _(d):
    return "SELECT doc_id, CASE WHEN length(text) > 60 THEN CONCAT(substr(text, 1, 59), '…') ELSE text END AS short FROM documents"


@query("fn25_html_escape")
def _(d):
    return """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""".replace(
        "''''", "chr(39)"
    )


@query("fn26_basename")
def _(d):
    return f"""SELECT page_id, {d.rx("url", "([^/]*)$", 1)} AS base, {d.rx_like("url", "(^|/)[.][.](/|$)")} AS traversal FROM pages"""


# ---- joins -----------------------------------------------------------------------------------------------------------


@query("jn06_reparse_new")
def _(d):
    return f"""WITH {V.candidate(d)},
old AS (SELECT * FROM v_candidate WHERE supplier % 3 <> 0), new AS (SELECT * FROM v_candidate WHERE supplier % 3 <> 1)
SELECT DISTINCT source_file, page_num, round(x0, 1) AS x0, round(y0, 1) AS y0, lower(text) AS text FROM new n
WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.source_file = n.source_file AND o.page_num = n.page_num AND round(o.x0, 1) = round(n.x0, 1)
  AND round(o.y0, 1) = round(n.y0, 1) AND lower(o.text) = lower(n.text))"""


@query("jn11_answers_questions")
def _(d):
    return """SELECT c.conv_id, c.turn, q.text AS question FROM conversations c LEFT JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = c.turn - 1 AND q.role = 'user' WHERE c.role = 'assistant'"""


@query("jn13_user_lookup")
def _(d):
    return "SELECT a.c_custkey, b.c_custkey AS found FROM customer a JOIN customer b ON lower(a.c_name) = lower(upper(b.c_name))"


@query("jn14_file_order")
def _(d):
    return f"""WITH {V.candidate(d)}, o AS (SELECT 'f3.pdf' AS f, 0 AS pos UNION ALL SELECT 'f0.pdf', 1 UNION ALL SELECT 'gone.pdf', 2 UNION ALL SELECT 'f4.pdf', 3),
p AS (SELECT source_file, {BIG("MAX(page_num)")} AS pages FROM v_candidate GROUP BY 1) SELECT o.pos, o.f, p.pages FROM o JOIN p ON p.source_file = o.f"""


@query("jn15_allocation")
def _(d):
    return f"""WITH {V.case(d)} SELECT c.id, s.s_name AS reviewer_name, CASE WHEN s.s_suppkey IS NULL THEN 'new' ELSE 'in_review' END AS workflow
FROM v_case c LEFT JOIN supplier s ON s.s_suppkey = c.id % 150"""


# ---- aggregations ----------------------------------------------------------------------------------------------------


@query("agg01_case_summary")
def _(d):
    return f"""WITH {V.case(d)}, {V.candidate(d)}
SELECT c.id, {BIG("COUNT(v.case_id)")} AS total, {BIG("COUNT(CASE WHEN v.status = 'auto_redact' THEN 1 END)")} AS auto, {BIG("COUNT(CASE WHEN v.status = 'flagged' THEN 1 END)")} AS flagged,
  {BIG("COUNT(CASE WHEN v.status = 'approved' THEN 1 END)")} AS approved, {BIG(f"COUNT(CASE WHEN v.status IN {REVIEWED} THEN 1 END)")} AS reviewed,
  {BIG("COUNT(DISTINCT v.source_file)")} AS files, {BIG("MAX(" + left_days(d) + ")")} AS days_remaining
FROM v_case c LEFT JOIN v_candidate v ON v.case_id = c.id GROUP BY c.id"""


@query("agg02_dashboard_cards")
def _(d):
    n = lambda p: BIG(f"COUNT(CASE WHEN {p} THEN 1 END)")
    return f"""WITH {V.case(d)} SELECT {n("NOT archived")} AS active, {n("NOT archived AND status = 'reviewing'")} AS reviewing, {n("NOT archived AND status = 'complete'")} AS complete,
  {n("NOT archived AND status <> 'complete' AND " + left_days(d) + " < 0")} AS overdue, {n("archived")} AS archived FROM v_case"""


@query("agg03_urgency_strip")
def _(d):
    return f"""WITH {V.case(d)}, u AS (SELECT id, {BIG(left_days(d))} AS days FROM v_case WHERE NOT archived AND status <> 'complete' AND NOT clock_paused AND {left_days(d)} <= 7),
n AS (SELECT {BIG("COUNT(CASE WHEN days < 0 THEN 1 END)")} AS late, {BIG("COUNT(CASE WHEN days BETWEEN 0 AND 3 THEN 1 END)")} AS soon, {BIG("COUNT(CASE WHEN days BETWEEN 4 AND 7 THEN 1 END)")} AS week FROM u),
f AS (SELECT * FROM u ORDER BY days, id LIMIT 5) SELECT f.id, f.days, n.late, n.soon, n.week FROM f CROSS JOIN n"""


@query("agg04_completion_split")
def _(d):
    n = lambda p: BIG(f"COUNT(CASE WHEN {p} THEN 1 END)")
    return f"""WITH {V.candidate(d)} SELECT case_id, {n("status IN ('auto_redact', 'approved')")} AS redacted, {n("status IN ('rejected', 'flagged')")} AS kept,
  {n("status IN ('excluded_subject', 'excluded_staff')")} AS excluded FROM v_candidate GROUP BY case_id"""


@query("agg05_turnaround_rows")
def _(d):
    return f"""WITH {V.case(d)}, {V.candidate(d)}, r AS (SELECT case_id, {BIG("COUNT(*)")} AS redactions FROM v_candidate WHERE status IN ('auto_redact', 'approved') GROUP BY 1)
SELECT id, received, completed, {BIG(d.days("received", "completed"))} AS days, completed <= effective_due AS on_time, COALESCE(redactions, 0) AS redactions
FROM v_case LEFT JOIN r ON r.case_id = id WHERE status = 'complete'"""


@query("agg06_turnaround_totals")
def _(d):
    done = "status = 'complete'"
    n = lambda p: BIG(f"COUNT(CASE WHEN {p} THEN 1 END)")
    days = d.days("received", "completed")
    return f"""WITH {V.case(d)} SELECT {BIG("COUNT(*)")} AS total, {n(done)} AS completed, {n("status <> 'complete'")} AS open,
  {n("status <> 'complete' AND " + left_days(d) + " < 0")} AS overdue_open, {n(done + " AND completed <= effective_due")} AS on_time,
  CAST({d.half_even("100.0 * COUNT(CASE WHEN completed <= effective_due THEN 1 END) / NULLIF(COUNT(completed), 0)", 0)} AS DOUBLE) AS on_time_pct,
  CAST({d.half_even(f"AVG(CAST({days} AS DOUBLE))", 1)} AS DOUBLE) AS avg_days, {BIG(f"MAX({days})")} AS max_days, {BIG("SUM(paused_days)")} AS paused_used FROM v_case"""


@query("agg07_monthly")
def _(d):
    return f"""WITH {V.case(d)}, r AS (SELECT {d.month("received")} AS m, {BIG("COUNT(*)")} AS n FROM v_case GROUP BY 1), c AS (SELECT {d.month("completed")} AS m, {BIG("COUNT(*)")} AS n FROM v_case WHERE status = 'complete' GROUP BY 1)
SELECT COALESCE(r.m, c.m) AS month, COALESCE(r.n, 0) AS received, COALESCE(c.n, 0) AS completed FROM r FULL OUTER JOIN c ON r.m = c.m"""


@query("agg08_certificate_categories")
def _(d):
    return f"""WITH {V.candidate(d)}, g AS (SELECT case_id, category, {BIG("COUNT(*)")} AS n, MIN(seq) AS first_seq FROM v_candidate WHERE status IN ('auto_redact', 'approved') GROUP BY 1, 2)
SELECT case_id, category, n, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY n DESC, first_seq) AS place FROM g"""


@query("agg09_certificate_exemptions")
def _(d):
    label = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.EXEMPTIONS.items())
    return f"""WITH {V.candidate(d)} SELECT case_id, CASE exemption WHEN '' THEN '{L.EXEMPTIONS["third_party"]}' {label} ELSE exemption END AS exemption, {BIG("COUNT(*)")} AS n
FROM v_candidate WHERE status IN ('auto_redact', 'approved') GROUP BY 1, 2"""


@query("agg11_group_by_name")
def _(d):
    n = lambda s: BIG(f"COUNT(CASE WHEN status = '{s}' THEN 1 END)") + f" AS n_{s}"
    return f"""WITH {V.candidate(d)} SELECT category, lower(trim(text)) AS name, {BIG("COUNT(*)")} AS n, {BIG("COUNT(DISTINCT source_file)")} AS files,
  {", ".join(n(s) for s in L.STATUSES)} FROM v_candidate GROUP BY 1, 2"""


@query("agg12_review_progress")
def _(d):
    return f"""WITH {V.candidate(d)} SELECT case_id, CAST(floor(100.0 * COUNT(CASE WHEN status IN {REVIEWED} THEN 1 END) / COUNT(*) + 0.5) AS BIGINT) AS pct,
  {BIG("COUNT(CASE WHEN status = 'flagged' THEN 1 END)")} AS flagged FROM v_candidate GROUP BY case_id"""


@query("agg14_known_actions")
def _(d):
    return f"WITH {V.audit(d)} SELECT DISTINCT action FROM (SELECT action FROM v_audit ORDER BY ts DESC, event_id DESC LIMIT 5000) x"


@query("agg15_detector_quality")
def _(d):
    n = lambda p: BIG(f"COUNT(CASE WHEN {p} THEN 1 END)")
    return f"""WITH f AS (SELECT doc_id, {d.rx_like("text", "[*#$%&!]{2}|[|]")} AS junk FROM documents), j AS (SELECT junk, quality FROM labels l JOIN f ON l.doc_id = f.doc_id)
SELECT {n("junk AND quality = 0")} AS tp, {n("junk AND quality = 1")} AS fp, {n("NOT junk AND quality = 0")} AS fn,
  CAST({n("junk AND quality = 0")} AS DOUBLE) / NULLIF({n("quality = 0")}, 0) AS recall, CAST({n("junk AND quality = 0")} AS DOUBLE) / NULLIF({n("junk")}, 0) AS prec FROM j"""


@query("agg16_report_status")
def _(d):
    return f"WITH {V.case(d)} SELECT status, {BIG('COUNT(*)')} AS n FROM v_case GROUP BY status"


@query("agg17_total_pages")
def _(d):
    return f"WITH {V.candidate(d)} SELECT {BIG('SUM(pages)')} AS pages FROM (SELECT source_file, MAX(page_num) AS pages FROM v_candidate GROUP BY 1) x"


@query("agg19_questions_per_template")
def _(d):
    return f"SELECT conv_id, {BIG('COUNT(*)')} AS questions FROM conversations WHERE role = 'user' GROUP BY conv_id"


# ---- windows and sorts -----------------------------------------------------------------------------------------------


@query("win01_first_per_key")
def _(d):
    return f"""WITH {V.candidate(d)}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, lower(trim(text)), page_num, source_file, category ORDER BY seq) AS n FROM v_candidate)
SELECT case_id, seq, lower(trim(text)) AS text, status FROM r WHERE n = 1"""


@query("win05_page_renumber")
def _(d):
    return f"""WITH {V.candidate(d)} SELECT case_id, seq, CASE WHEN source_file = 'f1.pdf' AND page_num > 2 THEN page_num - 1 ELSE page_num END AS page_num
FROM v_candidate WHERE NOT (source_file = 'f1.pdf' AND page_num = 2)"""


@query("win06_bundle_pages")
def _(d):
    return f"""WITH {V.candidate(d)}, f AS (SELECT case_id, source_file, {BIG("MAX(page_num)")} AS pages FROM v_candidate GROUP BY 1, 2)
SELECT case_id, source_file, {BIG("1 + COALESCE(SUM(pages) OVER (PARTITION BY case_id ORDER BY source_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")} AS first_page FROM f"""


@query("win07_previous_line")
def _(d):
    return f"""WITH {V.candidate(d)} SELECT case_id, seq, page_num = LAG(page_num) OVER (PARTITION BY case_id ORDER BY seq) AS same_page FROM v_candidate"""


@query("win08_login_failures")
def _(d):
    return f"""WITH {V.audit(d)}, e AS (SELECT event_id, CONCAT(ip, ' ', lower(username)) AS who, CAST(epoch_us AS BIGINT) AS t FROM (SELECT event_id, ip, username, action, MICROS AS epoch_us FROM v_audit_us) x WHERE action = 'error')
SELECT event_id, {BIG("COUNT(*) OVER (PARTITION BY who ORDER BY t RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)")} AS failures FROM e""".replace(
        "MICROS", "us"
    ).replace("v_audit_us", f"(SELECT a.*, {d.micros('ts')} AS us FROM v_audit a) y")


@query("win09_newest")
def _(d):
    return f"WITH {V.audit(d)} SELECT event_id, ts, action, username FROM v_audit WHERE action = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50"


@query("srt02_document_order")
def _(d):
    return f"""WITH {V.case(d)} SELECT subject, id, ROW_NUMBER() OVER (PARTITION BY subject ORDER BY COALESCE(CAST(completed AS VARCHAR(20)), '9999-99-99'), id) AS place FROM v_case"""


@query("srt03_candidate_sorts")
def _(d):
    rank = "CASE status WHEN 'flagged' THEN 0 WHEN 'auto_redact' THEN 1 WHEN 'approved' THEN 2 WHEN 'rejected' THEN 3 ELSE 4 END"
    return f"""WITH {V.candidate(d)} SELECT case_id, seq, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY page_num, y0, seq) AS by_page,
  ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY confidence DESC, seq) AS by_confidence, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY {rank}, page_num, seq) AS by_status FROM v_candidate"""


@query("srt07_bundle_order")
def _(d):
    f = d.pick(["letter", "certificate", "redacted"], "p_partkey % 3")
    return f"""WITH p AS (SELECT p_partkey, p_size AS bundle, {f} AS kind, p_name FROM part)
SELECT bundle, p_partkey, ROW_NUMBER() OVER (PARTITION BY bundle ORDER BY CASE kind WHEN 'letter' THEN 0 WHEN 'certificate' THEN 1 ELSE 2 END, p_name, p_partkey) AS place FROM p"""


@query("srt08_newest_cases")
def _(d):
    return newest_first(d, "received", "NOT archived")


# ---- sets, search ----------------------------------------------------------------------------------------------------


@query("set01_union_detectors")
def _(d):
    return f"""WITH {V.candidate(d)} SELECT case_id, seq, 0 AS stage FROM v_candidate WHERE category = 'person_name'
UNION ALL SELECT case_id, seq, 1 FROM v_candidate WHERE category IN ('email', 'phone_number') UNION ALL SELECT case_id, seq, 2 FROM v_candidate WHERE category = 'safeguarding'"""


@query("set03_known_names")
def _(d):
    return "SELECT lower(p_name) AS name FROM part UNION SELECT lower(s_name) FROM supplier"


@query("set04_token_overlap")
def _(d):
    return f"""SELECT p_partkey, {BIG(d.shared(d.split("lower(p_name)", "[ ]+"), d.string_list(["blue", "red", "green"])))} AS shared FROM part"""


@query("set05_except_dismissed")
def _(d):
    return "SELECT lower(p_name) AS name FROM part EXCEPT SELECT lower(p_name) FROM part WHERE p_partkey % 4 = 0"


@query("set07_distinct_files")
def _(d):
    return f"WITH {V.candidate(d)} SELECT case_id, {d.array_sorted_text('source_file')} AS files FROM v_candidate GROUP BY case_id"


@query("txt02_evidence")
def _(d):
    kws, hints = ["the", "that", "with"], ["and"]
    hit = " + ".join(f"CASE WHEN instr(lower(p), '{k}') > 0 THEN 1 ELSE 0 END" for k in kws)
    hint = " + ".join(f"CASE WHEN instr(lower(p), '{h}') > 0 THEN 0.3 ELSE 0.0 END" for h in hints)
    return f"""WITH {V.page(d)}, q AS (SELECT source_file, page_num, trim(p) AS p FROM v_page {d.unnest(d.split("text", "\\n"), "p")}),
s AS (SELECT *, least(CAST(1.0 AS DOUBLE), CAST(({hit}) AS DOUBLE) / 3 + CAST(({hint}) AS DOUBLE)) AS conf FROM q WHERE length(p) >= 10),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY conf DESC, page_num, p) AS n FROM s WHERE conf > 0)
SELECT source_file, page_num, round(conf, 6) AS conf, CASE WHEN length(p) > 500 THEN CONCAT(substr(p, 1, 500), '...') ELSE p END AS snippet, n FROM r WHERE n <= 5"""


@query("txt03_find_on_page")
def _(d):
    return f"WITH {V.page(d)} SELECT doc_id, instr(lower(text), 'secret') > 0 AS found FROM v_page"


@query("txt04_candidate_filter")
def _(d):
    return f"WITH {V.candidate(d)} SELECT case_id, seq FROM v_candidate WHERE status = 'flagged' AND (instr(lower(text), 'blue') > 0 OR instr(category, 'mail') > 0)"


@query("txt05_audit_filter")
def _(d):
    return f"""WITH {V.audit(d)} SELECT event_id, ts, action, username, target FROM v_audit WHERE action = 'click' AND instr(lower(username), 'ser1') > 0 AND instr(target, '1') > 0
ORDER BY ts DESC, event_id DESC LIMIT 500"""


# ---- redaction, sinks, workflow --------------------------------------------------------------------------------------


@query("snk05_turnaround_csv")
def _(d):
    return f"""WITH {V.case(d)} SELECT CONCAT_WS(',', CAST(id AS VARCHAR(20)), CAST(received AS VARCHAR(20)), CAST(completed AS VARCHAR(20)), CASE WHEN completed <= effective_due THEN 'yes' ELSE 'no' END) AS line FROM v_case WHERE status = 'complete'"""


@query("wf08_redetect_keeps_manual")
def _(d):
    return f"""WITH {V.candidate(d)}, manual AS (SELECT case_id, seq, status FROM v_candidate WHERE category = 'custom_word')
SELECT case_id, seq, CASE WHEN confidence >= 0.8 THEN 'auto_redact' ELSE 'flagged' END AS status FROM v_candidate WHERE category <> 'custom_word' UNION ALL SELECT case_id, seq, status FROM manual"""


@query("wf12_archive_switch")
def _(d):
    return f"WITH {V.case(d)} SELECT id, NOT archived AS archived FROM v_case WHERE status = 'complete'"


@query("wf16_demo_exists")
def _(d):
    return "SELECT count(*) > 0 AS present FROM part WHERE instr(upper(p_name), 'BLUE') > 0"


# ---- events ----------------------------------------------------------------------------------------------------------


@query("str02_idle_sessions")
def _(d):
    return f"""WITH {V.audit(d)}, e AS (SELECT username, event_id, {d.seconds("ts")} AS t, LAG({d.seconds("ts")}) OVER (PARTITION BY username ORDER BY ts, event_id) AS before FROM v_audit),
s AS (SELECT username, t, SUM(CASE WHEN before IS NULL OR t - before >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT username, {BIG("session")} AS session, {BIG("COUNT(*)")} AS events, MIN(t) AS first_t, MAX(t) AS last_t FROM s GROUP BY username, session"""


# ---- more of the same families ---------------------------------------------------------------------------------------


@query("fn08_without_title")
def _(d):
    t = d.pick(["Dr. ", "Mrs ", "", "Nurse "], "doc_id % 4")
    titles = "|".join(L.TITLES)
    return f"""WITH {V.planted(d)}, n AS (SELECT doc_id, lower(CONCAT({t}, forename, ' ', surname)) AS name FROM v_planted)
SELECT doc_id, {d.rx_replace("name", f"^({titles})[.]* ", "")} AS bare FROM n"""


@query("fn13_best_date")
def _(d):
    f = d.pick(["2024-02-30_a.pdf", "2023-11-05_b.pdf", "c.pdf"], "doc_id % 3")
    by_text = d.try_date(d.rx("text", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    return f"""WITH p AS (SELECT doc_id, {f} AS name, CASE WHEN doc_id % 2 = 0 THEN CONCAT('on 2020-01-', CAST(10 + doc_id % 19 AS VARCHAR(20))) ELSE 'no date' END AS text FROM documents)
SELECT doc_id, COALESCE({d.try_date(d.rx("name", "^([0-9]{4}-[0-9]{2}-[0-9]{2})[_ ]", 1))}, {by_text}) AS dated FROM p"""


@query("fn20_newer_version")
def _(d):
    v = d.pick(["v2.6.1", "2.10.0", "V2.6", "3.0-beta", "2.6.1", "2.5.20010", "1.1000000.0"], "p_partkey % 7")
    n = lambda i: f"COALESCE(TRY_CAST({d.rx('v', f'^[vV]?(?:[0-9]+[.-]){{{i}}}([0-9]+)', 1)} AS BIGINT), 0)"
    return f"""WITH p AS (SELECT p_partkey, {v} AS v FROM part) SELECT p_partkey, v, {d.numbers([n(0), n(1), n(2)])} > {d.numbers(["2", "6", "1"])} AS newer FROM p"""


@query("fn27_config_merge")
def _(d):
    return """WITH saved AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'retention_days' WHEN 1 THEN 'practice_name' WHEN 2 THEN 'unknown' ELSE 'backup_dir' END AS k FROM customer),
defaults AS (SELECT 'retention_days' AS k, '180' AS v UNION ALL SELECT 'practice_name', 'My Surgery' UNION ALL SELECT 'idle_timeout_minutes', '30')
SELECT d.k, COALESCE(trim(CASE WHEN s.k = 'practice_name' THEN '  Oak House ' WHEN s.k IS NOT NULL THEN '7' END), d.v) AS v FROM defaults d LEFT JOIN saved s ON s.k = d.k"""


@query("det_k1_risk_flags")
def _(d):
    words = [("abuse", "safeguarding"), ("neglect", "safeguarding"), ("HIV", "health")]
    hit = lambda w: d.rx_like("text", rf"(?i)\b{w}\b")
    parts = ", ".join(f"CASE WHEN {hit(w)} THEN '{w}:{c},' ELSE '' END" for w, c in words)
    return f"WITH {V.planted(d)} SELECT doc_id, CONCAT({parts}) AS flags FROM v_planted"


@query("cls08_scanned_cap")
def _(d):
    return f"WITH {V.candidate(d)} SELECT case_id, seq, CASE WHEN supplier % 2 = 0 THEN least(confidence, 0.85) ELSE confidence END AS confidence FROM v_candidate"


@query("jn01_offsets_to_spans")
def _(d):
    return f"""WITH {V.planted(d)}, w AS (SELECT doc_id, surname, text, instr(text, surname) AS s FROM v_planted), m AS (SELECT doc_id, s, s + length(surname) AS e FROM w WHERE s > 0),
sp AS (SELECT doc_id, 1 AS n, 1 AS a, 21 AS b FROM v_planted UNION ALL SELECT doc_id, 2, 21, 41 FROM v_planted UNION ALL SELECT doc_id, 3, 41, 400 FROM v_planted)
SELECT m.doc_id, sp.n FROM m JOIN sp ON sp.doc_id = m.doc_id AND sp.a < m.e AND sp.b > m.s"""


@query("jn12_months_received_completed")
def _(d):
    return f"""WITH {V.case(d)}, r AS (SELECT DISTINCT {d.month("received")} AS m FROM v_case), c AS (SELECT DISTINCT {d.month("completed")} AS m FROM v_case WHERE status = 'complete')
SELECT COALESCE(r.m, c.m) AS month, r.m IS NOT NULL AS received, c.m IS NOT NULL AS completed FROM r FULL OUTER JOIN c ON r.m = c.m"""


@query("win02_three_hits")
def _(d):
    return f"""WITH {V.candidate(d)}, r AS (SELECT category, text, source_file, page_num, case_id, seq, ROW_NUMBER() OVER (PARTITION BY category, text ORDER BY source_file, page_num, case_id, seq) AS n FROM v_candidate)
SELECT category, text, n, source_file, page_num, case_id, seq FROM r WHERE n <= 3"""


@query("win03_enough_keywords")
def _(d):
    return f"""WITH {V.candidate(d)}, k AS (SELECT category AS q, text AS kw, least(COUNT(*), 3) AS hits FROM v_candidate GROUP BY 1, 2),
r AS (SELECT *, COALESCE(SUM(hits) OVER (PARTITION BY q ORDER BY kw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM k)
SELECT q, {BIG("SUM(hits)")} AS match_count, {BIG("least(SUM(hits), 10)")} AS listed, {d.array_sorted_text("kw")} AS keywords FROM r WHERE earlier < 10 GROUP BY q"""


@query("win04_top_evidence")
def _(d):
    return f"""WITH {V.candidate(d)}, r AS (SELECT category, case_id, seq, ROW_NUMBER() OVER (PARTITION BY category ORDER BY confidence DESC, source_file, page_num, case_id, seq) AS n FROM v_candidate)
SELECT category, n, case_id, seq FROM r WHERE n <= 5"""


@query("srt01_cases_by_created")
def _(d):
    return newest_first(d, "received")


@query("srt05_question_order")
def _(d):
    return "SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY COALESCE(turn % 3, 0), turn) AS place FROM conversations WHERE role = 'user'"


@query("srt06_turnaround_order")
def _(d):
    return newest_first(d, "completed", "status = 'complete'")


@query("set02_manual_rows_stay")
def _(d):
    return f"WITH {V.candidate(d)} SELECT case_id, seq FROM v_candidate WHERE category <> 'address' UNION ALL SELECT case_id, seq FROM v_candidate WHERE category = 'address' AND status = 'approved'"


@query("set06_templates_union")
def _(d):
    return "SELECT p_name AS name, TRUE AS builtin FROM part WHERE p_partkey < 14 UNION ALL SELECT s_name, FALSE FROM supplier"


@query("red02_page_stamp")
def _(d):
    return f"WITH {V.candidate(d)} SELECT DISTINCT source_file, page_num, CONCAT({d.rx('source_file', '^(.*)[.]pdf$', 1)}, ' - page ', CAST(page_num + 1 AS VARCHAR(20))) AS stamp FROM v_candidate"


@query("red05_manual_box")
def _(d):
    return f"""WITH {V.candidate(d)} SELECT case_id, seq, category, status, confidence FROM v_candidate UNION ALL SELECT id, 0, 'manual', 'approved', CAST(1.0 AS DOUBLE) FROM (SELECT DISTINCT case_id AS id FROM v_candidate) x""".replace(
        "seq, category", "CAST(seq AS BIGINT) AS seq, category"
    ).replace("id, 0, 'manual'", "id, CAST(0 AS BIGINT), 'manual'").replace("status, confidence FROM v_candidate U", "status, CAST(confidence AS DOUBLE) AS confidence FROM v_candidate U")


@query("snk02_certificate_lines")
def _(d):
    return f"""WITH {V.candidate(d)}, g AS (SELECT case_id, category, COUNT(*) AS n FROM v_candidate WHERE status IN ('auto_redact', 'approved') GROUP BY 1, 2)
SELECT case_id, CONCAT('  ', category, ': ', CAST(n AS VARCHAR(20)), CASE WHEN n = 1 THEN ' redaction' ELSE ' redactions' END) AS line FROM g"""


@query("src25_planted_corpus")
def _(d):
    return f"WITH {V.planted(d)} SELECT doc_id, text, forename, surname FROM v_planted"
