"""Engine views over the supplied tables: cases, findings, audit events and planted pages, as common table expressions."""

from __future__ import annotations

from vellum.functions import lexicons as L

#: The day that time-dependent queries take for today.
TODAY = "DATE '2001-08-15'"

FORENAMES = ["Emma", "James", "Sarah", "Peter", "Laura", "Simon", "Helen", "Mark", "Diane", "Paul"]
SURNAMES = ["Walker", "Hughes", "Patel", "Turner", "Evans", "Watson", "Harris", "Green", "Lewis", "Wright"]
NUMBERS = ["943 476 5919", "943 476 5918", "401 023 2137", "987-654-4321", "9434765919", "123 456 7881", "450 557 7104", "111 111 1111"]
#: Sensitive terms, two in a note; what follows a surname in the name of a disease.
TERMS = ["safeguarding", "HIV", "domestic violence", "chlamydia", "neglect", "PrEP", "vulnerable adult", "syphilis", "child at risk", "MARAC", "domestic abuse"]
FOLLOWERS = [w.capitalize() for w in L.EPONYM_FOLLOWERS[:7]]


def case(d) -> str:
    return """v_case AS (SELECT o_orderkey AS id, o_custkey AS subject, CAST(o_orderdate AS DATE) AS received,
  CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'reviewing' ELSE 'pending' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 45 AS INT) END AS completed,
  CAST(o_orderkey % 7 AS INT) AS paused_days, (o_orderkey % 11 = 0 AND o_orderstatus <> 'F') AS clock_paused,
  (o_orderkey % 10 = 0) AS archived, CAST(o_orderdate AS DATE) + 30 AS due,
  CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 7 AS INT) AS effective_due,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'new' WHEN '2-HIGH' THEN 'in_review' ELSE 'ready_for_signoff' END AS workflow,
  CONCAT('rev', CAST(o_custkey % 10 AS STRING)) AS reviewer FROM orders)""".replace("AS STRING", "AS VARCHAR(20)")


def candidate(d) -> str:
    case_id, seq, rows = d.numbered("""l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate""")
    return f"""v_candidate AS (SELECT {case_id}, l_linenumber AS page_num, CONCAT('f', CAST(l_suppkey % 5 AS VARCHAR(20)), '.pdf') AS source_file,
  {d.pick(list(L.CATEGORIES[:9]), "l_partkey % 9")} AS category,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'auto_redact' WHEN l_returnflag = 'R' THEN 'flagged'
       WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'approved' WHEN l_returnflag = 'A' THEN 'rejected'
       WHEN l_linestatus = 'F' THEN 'excluded_subject' ELSE 'excluded_staff' END AS status,
  least(1.0, round(0.5 + 5 * l_discount, 4)) AS confidence, p_name AS text, l_suppkey AS supplier, l_quantity AS x0, l_tax AS y0,
  CASE l_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'third_party' WHEN 2 THEN 'serious_harm' ELSE 'local_rule' END AS exemption,
  {seq}
  FROM {rows})"""


def audit(d) -> str:
    return f"""v_audit AS (SELECT event_id, ts, event_type AS action, CONCAT('user', CAST(user_id AS VARCHAR(20))) AS username,
  {d.rx("props", '"k": ?([0-9]+)', 1)} AS target, CONCAT('10.0.0.', CAST(user_id % 3 AS VARCHAR(20))) AS ip, user_id FROM events)"""


def planted_text(d, f: str, s: str, related: bool = False) -> str:
    """A note of labelled fields about the forename f and surname s: one of ten layouts of names, then terms, numbers, places, dates.

    related: two layouts more tell whose relation the person is."""
    wife, neighbour = ("wife ", "Neighbour ") if related else ("", "")
    layouts = [
        f"'daughter ', {f}, ' ', {s}", f"'Dr ', {s}", f"'{wife}Mrs ', {s}", f"upper({s}), ', ', {f}", f"upper({f}), ' ', upper({s})",
        f"{f}, ' ', {s}, ' (Husband)'", f"'Dear Mr ', {s}, ','", f"{neighbour and f"'{neighbour}', "}{f}, ' ', {s}", f"'carer ', {f}", f"{s}, ', ', {f}",
    ]
    cases = " ".join(f"WHEN {i} THEN CONCAT('[', CAST(doc_id AS VARCHAR(20)), '] ', {parts}, ';')" for i, parts in enumerate(layouts))
    day, month = "CAST(1 + doc_id % 31 AS VARCHAR(20))", d.pick(["January", "Feb", "march", "June", "Sept"], "doc_id % 5")
    dated = f"CASE doc_id % 3 WHEN 0 THEN CONCAT('Date: ', {day}, ' ', {month}, ' 2024') WHEN 1 THEN CONCAT({day}, '/', CAST(1 + doc_id % 14 AS VARCHAR(20)), '/2023') ELSE '' END"
    number, follower = d.pick(NUMBERS, f"doc_id % {len(NUMBERS)}"), d.pick(FOLLOWERS, f"doc_id % {len(FOLLOWERS)}")
    one, two = d.pick(TERMS, f"doc_id % {len(TERMS)}"), d.pick(TERMS, f"(doc_id * 3 + 1) % {len(TERMS)}")
    fields = [
        f"'Number: ', {number}", "'Postcode: GU', CAST(doc_id % 9 AS VARCHAR(20)), ' 5SU, on file'", "'phone: 07700 900', CAST(100 + doc_id % 900 AS VARCHAR(20))",
        f"'mail: ', lower({f}), CASE doc_id % 4 WHEN 0 THEN '@nhs.net' WHEN 1 THEN '@dept.nhs.uk' ELSE '@example.com' END",
        f"'terms: ', {one}, ', ', {two}", f"'finding: ', {d.pick(SURNAMES, 'doc_id % 10')}, ' ', {follower}", dated,
    ]
    return f"CONCAT(CASE doc_id % 10 {cases} END, " + ", ".join(f"chr(10), {x}" for x in fields) + ")"


def planted(d, forenames: list[str] = FORENAMES, surnames: list[str] = SURNAMES, related: bool = False) -> str:
    f, s = d.pick(forenames, f"doc_id % {len(forenames)}"), d.pick(surnames, f"(doc_id * 7 + 3) % {len(surnames)}" if surnames is not SURNAMES else "(doc_id + 3) % 10")
    return f"""v_planted AS (SELECT doc_id, {planted_text(d, "f", "s", related)} AS text, f AS forename, s AS surname, CAST(doc_id % 10 AS INT) AS layout
  FROM (SELECT doc_id, {f} AS f, {s} AS s FROM documents) x)"""


def page(d) -> str:
    """All documents as pages whose lines are paragraphs; a null text is empty."""
    return """v_page AS (SELECT doc_id, CONCAT('doc', CAST(doc_id % 20 AS VARCHAR(20)), '.txt') AS source_file, CAST(doc_id AS INT) AS page_num, COALESCE(text, '') AS text
  FROM documents)"""
