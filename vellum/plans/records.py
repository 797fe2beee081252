"""Queries of a case's record: pages, dates, order, lists, snapshots, reports, what was found by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import cases as C
from vellum.operators import classify, letters, record
from vellum.plans import views as V
from vellum.plans.casework import CANDIDATE, CASE, bound, candidates, query
from vellum.sources import backups, readers, stores
from vellum.sources.shared import new_folder

FILES = """f AS (SELECT case_id, min(seq) AS seq, source_file, CAST(max(page_num) + 1 AS BIGINT) AS pages, CASE WHEN min(seq) % 3 <> 0 THEN CAST(DATE '2001-01-01' + CAST(max(supplier) % 50 AS INT) AS VARCHAR(20)) END AS dated
  FROM v_candidate GROUP BY case_id, source_file)"""


def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of every case; a third of them are undated."""
    c = candidates(spark, sf_dir)
    dated = F.when(F.min("seq") % 3 != 0, F.date_add(F.lit("2001-01-01").cast("date"), (F.max("supplier") % 50).cast("int")).cast("string"))
    return c.groupBy("case_id", "source_file").agg(F.min("seq").alias("seq"), (F.max("page_num") + 1).cast("long").alias("pages"), dated.alias("dated"))


@query("wf10_delete_page", f"""WITH {CANDIDATE}, {FILES}, g AS (SELECT DISTINCT c.case_id, c.source_file, p.page_num FROM v_candidate c JOIN (SELECT 2 AS page_num UNION ALL SELECT 4 UNION ALL SELECT 9) p ON true JOIN f USING (case_id, source_file)
  WHERE c.source_file = 'f1.pdf' AND p.page_num < f.pages)
SELECT case_id, seq, source_file, page_num - (SELECT count(*) FROM g WHERE g.case_id = c.case_id AND g.source_file = c.source_file AND g.page_num < c.page_num) AS page_num FROM v_candidate c
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.case_id = c.case_id AND g.source_file = c.source_file AND g.page_num = c.page_num)""")
def wf10_delete_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings after two pages of one file of each case went, and a third was asked for that isn't there."""
    files, c = case_files(spark, sf_dir), candidates(spark, sf_dir)
    asked = files.filter("source_file = 'f1.pdf'").select("case_id", "source_file", F.explode(F.array(F.lit(2), F.lit(4), F.lit(9))).alias("page_num"))
    left = record.delete_pages(files, c, asked)[1]
    return left.select("case_id", "seq", "source_file", F.col("page_num").cast("long").alias("page_num"))


@query("wf12_document_dates", f"""WITH {CANDIDATE}, {FILES}, n AS (SELECT case_id, seq, source_file, pages, CASE WHEN source_file = 'f2.pdf' THEN '2000-12-31' WHEN source_file = 'f3.pdf' THEN NULL ELSE dated END AS dated FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(dated, '9999-99-99'), seq) AS place FROM n)
SELECT case_id, source_file, dated, CAST(place AS BIGINT) AS place, CAST(1 + coalesce(sum(pages) OVER (PARTITION BY case_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_page FROM o""")
def wf12_document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in their order, with the bundle's pages, after one of each case was dated anew, another twice and at last not at all."""
    files = case_files(spark, sf_dir)
    of = lambda name: files.filter(F.col("source_file") == name).select("case_id", "source_file")
    none = F.lit(None).cast("string")
    asked = of("f2.pdf").withColumns({"at": F.lit(1), "dated": F.lit("2000-12-31")})
    asked = asked.unionByName(of("f3.pdf").withColumns({"at": F.lit(1), "dated": F.lit("1999-01-01")})).unionByName(of("f3.pdf").withColumns({"at": F.lit(2), "dated": none}))
    asked = asked.unionByName(of("f0.pdf").select("case_id", F.lit("gone.pdf").alias("source_file"), F.lit(1).alias("at"), F.lit("1990-01-01").alias("dated")))
    out = record.bundle_pages(record.set_dates(files, asked))
    return out.select("case_id", "source_file", "dated", F.col("place").cast("long").alias("place"), "first_page")


@query("srt09_main_record", f"""WITH {CANDIDATE}, {FILES}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY coalesce(dated, '9999-99-99'), seq) AS place FROM f)
SELECT case_id, coalesce(max(source_file) FILTER (source_file = 'f4.pdf' AND case_id % 2 = 0), max(source_file) FILTER (place = 1)) AS main_file FROM o GROUP BY case_id""")
def srt09_main_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other case names a file that it may not have."""
    files = case_files(spark, sf_dir)
    chosen = files.select("case_id", F.lit("f4.pdf").alias("source_file")).distinct().filter("case_id % 2 = 0")
    return record.main_file(files, chosen)


@query("jn02_staff_tokens", """WITH c AS (SELECT p_partkey, lower(p_name) AS name FROM part), t AS (SELECT p_partkey, unnest(string_split(name, ' ')) AS w FROM c),
s AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(lower(n), ' ')) AS w FROM (SELECT s_name AS n FROM supplier UNION ALL SELECT p_name FROM part WHERE p_partkey BETWEEN 10 AND 18) y) x)
SELECT p_partkey, name, EXISTS (SELECT 1 FROM t JOIN s ON t.w = s.w WHERE t.p_partkey = c.p_partkey AND t.w NOT IN ('dr', 'mr', 'mrs', 'ms', 'miss', 'prof', 'professor', 'nurse', 'sister')) AS is_staff FROM c""")
def jn02_staff_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' names against a staff list: the suppliers and some parts, with a title."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    staff = parts.filter("p_partkey BETWEEN 10 AND 18").select(F.concat(F.lit("Dr "), F.initcap("p_name")).alias("name"))
    staff = staff.unionByName(spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("name")))
    hit = record.staff_named(parts.select("p_partkey", F.col("p_name").alias("name")), staff, ["p_partkey"])
    rows = parts.select("p_partkey", F.lower("p_name").alias("name"))
    return rows.join(hit.select("p_partkey", F.lit(True).alias("is_staff")), "p_partkey", "left").withColumn("is_staff", F.coalesce("is_staff", F.lit(False)))


@query("wf14_unique_words", """WITH h AS (SELECT p_name AS phrase, p_partkey FROM part WHERE p_partkey % 5 = 0), a AS (SELECT lower(phrase) AS k, arg_min(phrase, p_partkey) AS phrase FROM h GROUP BY 1),
n AS (SELECT lower(p_name) AS k, arg_min(upper(p_name), p_partkey) AS phrase FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
SELECT k, phrase FROM (SELECT * FROM a UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM a)) x WHERE k NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey = 7)""")
def wf14_unique_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list to which all parts' names are added in capitals, and some removed."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("phrase"), F.col("p_partkey").alias("n"))
    have = record.add_entries(parts.limit(0), parts.filter("n % 5 = 0"), "phrase", "n")
    grown = record.add_entries(have, parts.withColumn("phrase", F.upper("phrase")).filter("n % 5 <> 0"), "phrase", "n")
    left = record.remove_entries(grown, parts.filter("n = 7"), "phrase")
    return left.select(F.lower("phrase").alias("k"), "phrase")


@query("cls06_status_decision", f"""WITH {CANDIDATE} SELECT case_id, seq, CASE WHEN contains(text, 'almond') THEN 'excluded_subject' WHEN contains(text, 'navy') THEN 'excluded_staff' WHEN confidence >= 0.8 THEN 'auto_redact' ELSE 'flagged' END AS status FROM v_candidate""")
def cls06_status_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a finding's text stand for the subject's and the staff's names."""
    status = classify.decide(F.contains("text", F.lit("almond")), F.contains("text", F.lit("navy")), F.col("confidence"), 0.8)
    return candidates(spark, sf_dir).select("case_id", "seq", status.alias("status"))


@query("wf11_retention_expired", f"WITH {CASE} SELECT id FROM v_case WHERE status = 'complete' AND epoch_us(TIMESTAMP '2001-08-15 12:00:00') - epoch_us(CASE WHEN id % 4 = 0 THEN CAST(received AS TIMESTAMP) ELSE CAST(completed AS TIMESTAMP) END) >= 180 * 86400000000")
def wf11_retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete cases of long ago; a quarter has no completion date and goes by its last change."""
    c = bound(spark, sf_dir, V.case, select="id, status, CASE WHEN id % 4 <> 0 THEN CAST(completed AS STRING) ELSE '' END AS completed_at, CAST(received AS STRING) AS last_modified FROM v_case")
    return stores.expired(c, 180, "2001-08-15 12:00:00").select("id")


@query("win10_rolling_backups", f"WITH {CASE}, b AS (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY received DESC, id DESC) AS n FROM v_case) SELECT subject, id FROM b WHERE n > 7")
def win10_rolling_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases standing for snapshots of their subjects: which are one too many."""
    return backups.surplus(bound(spark, sf_dir, V.case, select="subject, id, received FROM v_case"), "subject", "received", "id").select("subject", "id")


@query("snk10_backup_restore", f"""WITH {CASE}, {CANDIDATE} SELECT 'cases' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS ids FROM v_case WHERE id % 9 <> 0 AND id % 3 = 2
UNION ALL SELECT 'findings', count(*), CAST(sum(case_id) AS BIGINT) FROM v_candidate WHERE case_id % 3 = 2""")
def snk10_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of the cases in thirds, of which two are kept; what the newest holds."""
    cases, c, root = bound(spark, sf_dir, V.case, select="id FROM v_case"), candidates(spark, sf_dir).select("case_id", "seq"), new_folder(spark, "backups")
    for i in range(3):
        backups.snapshot({"cases": cases.filter(f"id % 9 <> 0 AND id % 3 = {i}"), "findings": c.filter(f"case_id % 3 = {i}")}, root, f"2001010{i}-000000", keep=2)
    back = backups.restore(spark, root)
    rows = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("ids")) for name, key, df in (("cases", "id", back["cases"]), ("findings", "case_id", back["findings"]))]
    return rows[0].unionByName(rows[1])


@query("agg11_occurrences", f"""WITH {CANDIDATE}, o AS (SELECT *, lower(trim(text)) AS name, row_number() OVER (PARTITION BY category, lower(trim(text)) ORDER BY case_id, source_file, page_num, seq) AS place,
  count(*) OVER (PARTITION BY category, lower(trim(text))) AS n FROM v_candidate WHERE case_id % 10 < 9)
SELECT category, name, CAST(place AS BIGINT) AS place, case_id, source_file, page_num, seq, status, greatest(n - 2, 0) AS more FROM o WHERE place <= 2""")
def agg11_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two findings of every name."""
    found = C.occurrences(candidates(spark, sf_dir).filter("case_id % 10 < 9"), 2)
    return found.withColumn("place", F.col("place").cast("long"))


# ---- reports ---------------------------------------------------------------------------------------------------------

ON = "2001-09-01"


def answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, answers, evidence): a report a conversation, a question a user's turn, the next turns being places it was found."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("conv_id", "case_id")
    reports = turns.select("case_id").distinct().select("case_id", F.when(F.col("case_id") % 2 == 0, "Insurance").alias("template_name"), F.when(F.col("case_id") % 3 != 0, F.concat(F.lit("P"), F.col("case_id").cast("string"))).alias("full_name"), F.lit("").alias("address"))
    q = turns.filter("role = 'user'")
    answers = q.select("case_id", F.col("turn").alias("seq"), F.col("turn").cast("string").alias("question_id"), F.col("text").alias("question_text"), F.lit("").alias("answer"), F.lit(False).alias("reviewed"))
    places = q.select("case_id", F.col("turn").cast("string").alias("question_id"), F.col("turn").alias("t"), F.explode(F.sequence(F.lit(1), F.col("turn") % 6 + 1)).alias("place"))
    evidence = places.select("case_id", "question_id", F.col("place").alias("place"), F.concat(F.lit("f"), F.col("place").cast("string"), F.lit(".pdf")).alias("source_file"), (F.col("t") + F.col("place")).alias("page_num"), F.when(F.col("place") == 2, "").otherwise("x").alias("text"))
    return reports, answers, evidence


_question = "(SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS item FROM conversations WHERE role = 'user')"


@query("wf17_save_answers", "SELECT conv_id AS case_id, CAST(turn AS VARCHAR) AS question_id, CASE WHEN turn % 4 = 0 THEN 'second' WHEN turn % 4 = 2 THEN '' ELSE '' END AS answer, turn % 4 = 0 AS reviewed FROM conversations WHERE role = 'user'")
def wf17_save_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth turn's question is answered twice, another's answer is cleared, some aren't asked at all."""
    return saved(spark, sf_dir)[1].select("case_id", "question_id", "answer", "reviewed")


def saved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reports, answers, evidence = answered(spark, sf_dir)
    one = lambda r, at, text, done: answers.filter(F.col("seq") % 4 == r).select("case_id", "question_id", F.lit(at).alias("at"), F.lit(text).cast("string").alias("answer"), F.lit(done).cast("boolean").alias("reviewed"))
    updates = one(0, 1, "first", False).unionByName(one(0, 2, "second", True)).unionByName(one(2, 1, "gone", True)).unionByName(one(2, 2, None, None))
    updates = updates.unionByName(reports.select("case_id", F.lit("not asked").alias("question_id"), F.lit(1).alias("at"), F.lit("?").alias("answer"), F.lit(True).alias("reviewed")))
    return reports, letters.save_answers(answers, updates), evidence


@query("snk03_report_lines", f"""WITH r AS (SELECT DISTINCT conv_id AS c FROM conversations), q AS {_question},
e AS (SELECT conv_id, turn, string_agg('f' || p || '.pdf p.' || (turn + p + 1), '; ' ORDER BY p) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p) AS i FROM (
  SELECT conv_id, turn, unnest(range(1, turn % 6 + 2)) AS p FROM q) x WHERE p <> 2) y WHERE i <= 3 GROUP BY 1, 2),
l AS (SELECT c, 0 AS section, 0 AS item, ['MEDICAL REPORT', 'Report Type: ' || CASE WHEN c % 2 = 0 THEN 'Insurance' ELSE 'General' END, 'Generated: 01 September 2001', 'Report ID: ' || c] AS ls FROM r
UNION ALL SELECT c, 1, 0, CASE WHEN c % 3 <> 0 THEN ['PATIENT DETAILS', 'Name: P' || c] ELSE ['PATIENT DETAILS'] END FROM r UNION ALL SELECT c, 2, 0, ['REPORT FINDINGS'] FROM r UNION ALL SELECT c, 3, 0, ['{"─" * 60}'] FROM r
UNION ALL SELECT conv_id, 2, item, list_filter(['Q' || item || '. ' || coalesce(text, ''), 'A: ' || CASE WHEN turn % 4 = 0 THEN 'second' ELSE '[No answer provided]' END, 'Sources: ' || refs], lambda x: x IS NOT NULL) FROM q LEFT JOIN e USING (conv_id, turn))
SELECT c AS case_id, section, CAST(item AS BIGINT) AS item, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l""")
def snk03_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = letters.report(*saved(spark, sf_dir), F.lit(ON).cast("date"))
    return out.withColumn("line_no", F.col("line_no").cast("long"))


# ---- what is read ----------------------------------------------------------------------------------------------------

@query("fn18_email_layout", """SELECT conv_id, turn, 'From: ' || role || chr(10) || 'To: desk' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Cc: copy' || chr(10) ELSE '' END
  || 'Date: Mon, 01 Jan 2024 10:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00 +0000' || chr(10) || 'Subject: ' || substr(coalesce(text, ''), 1, 20) || chr(10) || chr(10)
  || CASE WHEN text = '' THEN '(no body)' ELSE coalesce(text, '(no body)') END
  || CASE WHEN conv_id % 3 = 0 THEN chr(10) || chr(10) || 'Attachments:' || chr(10) || '  - a.pdf' ELSE '' END AS layout FROM conversations""")
def fn18_email_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a message, read back as text: a text's beginning is the subject, every third conversation has attachments."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text, lf = F.coalesce("text", F.lit("")), F.lit("\n")
    coded = lambda c: F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")
    subject = F.when(text != "", F.concat(F.lit("=?utf-8?B?"), coded(F.substring(text, 1, 20)), F.lit("?="))).otherwise("")
    cc, at = F.when(F.col("turn") % 2 == 0, "Cc: copy\n").otherwise(""), F.lpad((F.col("turn") % 60).cast("string"), 2, "0")
    head = F.concat(F.lit("From: "), "role", F.lit("\nTo: desk\n"), cc, F.lit("Date: Mon, 01 Jan 2024 10:"), at, F.lit(":00 +0000\nSubject: "), subject, F.lit("\nMIME-Version: 1.0\n"))
    plain = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: "
    edge = F.sha2(text, 256)  # no text holds its own digest
    parts = F.concat(
        F.lit("Content-Type: multipart/mixed; boundary="), edge, F.lit("\n\n--"), edge, lf, F.lit(f"{plain}base64\n\n"), coded(text), F.lit("\n--"), edge,
        F.lit("\nContent-Type: application/pdf\nContent-Disposition: attachment; filename=a.pdf\nContent-Transfer-Encoding: base64\n\nJVBERg==\n--"), edge, F.lit("--\n"),
    )
    mail = F.concat(head, F.when(F.col("conv_id") % 3 == 0, parts).otherwise(F.concat(F.lit(f"{plain}8bit\n\n"), text)))
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".eml"))
    read = readers.read_contents(turns.select(path.alias("path"), F.encode(mail, "UTF-8").alias("content"))).filter("kind = 'eml'")
    number = lambda i: F.regexp_extract("path", r"^(\d+)/(\d+)", i).cast("long")
    return read.select(number(1).alias("conv_id"), number(2).alias("turn"), F.col("text").alias("layout"))


@query("src19_case_store", """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN '2001-02-03' ELSE strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') END AS due_date,
  o_orderkey % 5 = 0 AS archived, 'f' || o_orderkey || '.pdf' AS file FROM orders""")
def src19_case_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases read from their documents: absent fields have defaults, a due date is computed, folders are cut off."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, number = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey").cast("string")
    doc = F.to_json(F.struct(
        number.alias("id"), F.col("o_orderstatus").alias("status"), day.alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, "2001-02-03").alias("due_date"),
        F.when(F.col("o_orderkey") % 5 == 0, True).alias("archived"), F.array(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "C:\\x\\f").otherwise("/old/place/f"), number, F.lit(".pdf"))).alias("pdf_files"),
    ))
    read = stores.read_cases(o.select(number.alias("id"), doc.alias("doc")))
    return read.select("id", "status", "due_date", "archived", F.get("pdf_files", F.lit(0)).alias("file"))


@query("src20_audit_scan", """SELECT event_id, event_type AS action, 'user' || user_id AS username, date_trunc('month', ts) AS month FROM events""")
def src20_audit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, written as JSON lines by month, then read; lines that aren't JSON were put among them."""
    path = new_folder(spark, "audit")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = e.select(stamp.alias("ts"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("username"), F.lit("t").alias("target"), F.col("event_id").cast("string").alias("detail"), F.lit("").alias("ip"))
    stores.append_audit(rows, path)
    e.filter("event_id % 100 = 0").select(F.lit("{no json").alias("value"), F.lit("200101").alias("yyyymm")).write.mode("append").partitionBy("yyyymm").text(path)
    read = stores.read_audit(spark, path)
    return read.select(F.col("detail").cast("long").alias("event_id"), "action", "username", F.date_trunc("month", F.col("ts").cast("timestamp")).alias("month"))
