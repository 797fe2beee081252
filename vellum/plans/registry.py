"""All queries of the engine's own operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.operators import cases as C
from vellum.operators import classify, dates, names, pii, redact, search
from vellum.plans import analytics, casework, detect, disclosures, events, records, searches  # noqa: F401  these add their queries to casework's
from vellum.plans import views as V
from vellum.plans.dialect import Duck
from vellum.plans.dialect import Spark as SparkSql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SUBJECT = classify.Subject("Emma Turner", "Emma", "Turner", "943 476 5919", "", "12 High Street, Guildford", "07700 900150", "", ("Em Turner",))
STAFF = ("Dr Peter Wright", "Sarah Hughes")
CUSTOM = (("on file", False), ("Number", True))
RISK = {"safeguarding": ("abuse", "neglect", "at risk"), "health": ("HIV",)}


def register(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def by_sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        return spark.sql(analytics.Q[name](SparkSql()))

    return run


def planted(spark: SparkSession, sf_dir: str, *names: list[str]) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(f"WITH {V.planted(SparkSql(), *names)} SELECT * FROM v_planted")


def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted notes that name more relations."""
    register(spark, sf_dir)
    return spark.sql(f"WITH {V.planted(SparkSql(), related=True)} SELECT * FROM v_planted")


def of_cases(query: Callable[..., DataFrame], *views: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query that calls a case function on the bound views: v_case with its pauses, v_candidate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        bound = []
        for v in views:
            made = {"v_case": V.case, "v_candidate": V.candidate}[v](SparkSql())
            bound.append(spark.sql(f"WITH {made} SELECT *{', CASE WHEN clock_paused THEN received END AS paused_at' if v == 'v_case' else ''} FROM {v}"))
        return query(*bound)

    return run


TODAY = lambda: F.expr(V.TODAY)
CASE_QUERIES = {
    "fn16_days_remaining": of_cases(lambda c: C.with_clock(c, TODAY()).select("id", "days_remaining"), "v_case"),
    "fn15_live_paused_days": of_cases(lambda c: C.with_clock(c, TODAY()).select("id", F.col("live_paused_days").cast("long").alias("live")), "v_case"),
    "agg01_case_summary": of_cases(lambda c, f: C.case_summary(c, f, TODAY()), "v_case", "v_candidate"),
    "agg02_dashboard_cards": of_cases(lambda c: C.dashboard(c, TODAY()), "v_case"),
    "agg03_urgency_strip": of_cases(lambda c: C.urgency(c, TODAY()), "v_case"),
    "agg04_completion_split": of_cases(C.completion_split, "v_candidate"),
    "agg05_turnaround_rows": of_cases(lambda c, f: C.turnaround(c, f, TODAY()), "v_case", "v_candidate"),
    "agg06_turnaround_totals": of_cases(lambda c: C.turnaround_totals(c, TODAY()), "v_case"),
    "agg07_monthly": of_cases(C.monthly, "v_case"),
    "agg08_certificate_categories": of_cases(C.certificate_categories, "v_candidate"),
    "agg09_certificate_exemptions": of_cases(C.certificate_exemptions, "v_candidate"),
    "agg11_group_by_name": of_cases(C.by_name, "v_candidate"),
    "agg12_review_progress": of_cases(C.review_progress, "v_candidate"),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their whole texts; a null text is empty."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _texts(found: Column) -> list[Column]:
    return [F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda m: m["text"]), "|").alias("found")]


def pages_of(rows: DataFrame, source_file: str) -> DataFrame:
    return rows.select("doc_id", F.lit(source_file).alias("source_file"), F.lit(0).alias("page_num"), F.col("text").alias("page_text"))


def cls12_detection(rows: DataFrame, source_file: str) -> DataFrame:
    found = detect.detect(pages_of(rows, source_file), SUBJECT, detect.Settings(staff=STAFF, custom=CUSTOM, risk=RISK))
    flags = F.array_join(F.transform("risk_flags", lambda f: f["phrase"]), ",")
    return found.withColumn("risk_flags", flags)


def name_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of planted names and precision of what is found; a name counts when all its planted parts are in a finding.

    Every listed forename and surname is planted, those included that are words of other meanings too."""
    every = [[n.title() for n in sorted(x)] for x in (L.DEFAULT_LEXICON.forenames, L.DEFAULT_LEXICON.surnames)]
    rows = planted(spark, sf_dir, *every).withColumn("found", names.detect_names(F.col("text")))
    fore, sur = F.lower("forename"), F.lower("surname")
    whole = F.when(F.col("layout").isin(1, 2, 6), F.array(sur)).when(F.col("layout") == 8, F.array(fore)).otherwise(F.array(fore, sur))
    hit = F.exists("found", lambda m: F.forall(F.col("want"), lambda w: F.contains(F.lower(m["text"]), w)))
    false = F.size(F.filter("found", lambda m: ~F.exists(F.array(fore, sur), lambda w: F.contains(F.lower(m["text"]), w))))
    rows = rows.withColumn("want", whole).select(hit.cast("long").alias("hit"), F.size("found").alias("n"), false.alias("wrong"))
    return rows.agg(
        F.count("*").alias("planted"), F.sum("hit").alias("found"), (F.sum("hit") / F.count("*")).alias("recall"), (1 - F.sum("wrong") / F.sum("n")).alias("prec")
    )


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses in the documents, classified, counted once a document, grouped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.contains("text", F.lit("@")))
    found = docs.select("doc_id", F.explode(pii.plain(F.col("text"))["email"]).alias("m")).select("doc_id", F.lower("m.text").alias("email"), "m.confidence")
    found = found.withColumn("status", classify.decide(F.lit(False), F.lit(False), F.col("confidence"), 0.80)).distinct()
    return found.groupBy("email", "status").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))


def subject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir)
    entity = F.concat_ws(" ", "forename", "surname")
    return rows.select("doc_id", entity.alias("entity"), classify.is_subject(entity, SUBJECT).alias("subject"))


def staff_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir)
    entity = F.concat_ws(" ", F.lit("Mr"), "forename", "surname")
    return rows.select("doc_id", entity.alias("entity"), classify.is_staff(entity, STAFF).alias("staff"))


def address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    rows = spark.table("documents").select("doc_id", F.concat((10 + F.col("doc_id") % 4).cast("string"), F.lit(" High Street Guildford")).alias("entity"))
    return rows.select("doc_id", "entity", classify.address_match(F.lower("entity"), SUBJECT.address).alias("home"))


def cls04_page_staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).withColumn("page", F.concat(F.lit("Practitioner: Dr "), "forename", F.lit(" "), "surname", F.lit("\nFiled by: "), "surname"))
    return rows.select("doc_id", F.array_join(classify.page_staff(F.col("page")), "|").alias("staff"))


def cls05_label_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planted(spark, sf_dir).withColumn("page", F.concat(F.lit("Record author: "), F.repeat(F.lit("x"), (F.col("doc_id") % 120).cast("int")), F.lit(" "), "surname"))
    return rows.select("doc_id", classify.in_staff_label(F.col("page"), F.char_length("page") - F.char_length("surname")).alias("labelled"))


def red01_redacted_text(rows: DataFrame) -> DataFrame:
    """Pages with everything that detection found blanked out."""
    return rows.select("doc_id", redact.blank_out(F.col("text"), F.concat(
        F.transform(names.detect_names(F.col("text")), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))),
        F.transform(pii.detect_patterns(F.col("text")), lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"))),
    )).alias("redacted"))


def cls09_unscreened_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, every other with an image: those with hardly any text."""
    docs = documents(spark, sf_dir)
    pages = docs.select(F.lit("documents").alias("source_file"), F.col("doc_id").alias("page_num"), (F.col("doc_id") % 2).alias("n_images"), F.substring("text", 1, 1 + F.col("doc_id").cast("int") % 60).alias("page_text"))
    return detect.unscreened(pages)


def cls10_enabled_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found where only two categories are asked for, and nobody is excluded."""
    found = detect.detect(pages_of(planted(spark, sf_dir), "planted.txt"), classify.Subject(), detect.Settings(enabled=("email", "phone_number")))
    return found.select("doc_id", "category", "text", "status")


QUESTIONS = (
    search.Question("q1", "Any secrets?", ("secret", "token"), ("password",)),
    search.Question("q2", "Common words", ("the", "and", "that", "with"), ("http",)),
)


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("file_seq"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_file"), F.lit(0).alias("page_num"), "text")


def txt01_keyword_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.keyword_scan(_doc_pages(spark, sf_dir), QUESTIONS)
    shown = F.array_join(F.transform("matches", lambda m: F.concat_ws("@", m["keyword"], m["source_file"])), ",")
    return out.select("question_id", F.array_join("matched_keywords", ",").alias("keywords"), "match_count", shown.alias("matches"))


def txt02_best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.evidence(_doc_pages(spark, sf_dir), QUESTIONS, blank=r"\n")


def snk04_bundle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    files = spark.table("orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("file"), F.col("o_totalprice").cast("long").alias("size")))).alias("files")
    )
    return files.select("o_custkey", F.array_join(redact.split_parts(F.col("files"), 200_000), ",").alias("parts"))


def fn23_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.array_join(redact.wrap(F.col("text"), 60), "\n").alias("wrapped"))


def src03_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as pages, with their page texts rebuilt from one span per line."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    spans = docs.filter(F.trim("text") != "").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("documents").alias("source_file"), "text", F.lit(0).alias("page_num"), F.lit(72.0).alias("x0"),
        (F.col("line_no") * 100.0 + 10).alias("y0"), F.lit(400.0).alias("x1"), (F.col("line_no") * 100.0 + 22).alias("y1"), F.lit(0).alias("block_no"), "line_no", F.lit(0).alias("span_no"),
    )
    return detect.page_texts(spans).select("doc_id", F.size("spans").alias("lines"), F.char_length("page_text").alias("chars"))


def _number_text(d) -> str:
    return "regexp_replace(m, '[^0-9]', '', 'g')"


def _all(pattern: str, keep: str = "true", group: int = 0, show: str = "m", related: bool = False) -> str:
    """Check SQL: all matches that pass keep, joined."""
    got = f"list_filter(regexp_extract_all(text, {Duck().re(pattern)}, {group}), lambda m: {keep})"
    return f"WITH {V.planted(Duck(), related=related)}, f AS (SELECT doc_id, {got} AS l FROM v_planted) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(list_transform(l, lambda m: {show}), '|') AS found FROM f"


def _terms(terms) -> str:
    """Check SQL: matches of labelled terms, one term after the other."""
    lists = ", ".join(f"regexp_extract_all(text, {Duck().re(p)})" for p, _ in terms)
    return f"WITH {V.planted(Duck())}, f AS (SELECT doc_id, flatten([{lists}]) AS l FROM v_planted) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, array_to_string(l, '|') AS found FROM f"


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + ")"


def _word_ok(w: str) -> str:
    bare = f"rtrim(lower({w}), '.,;:')"
    return f"({bare} NOT IN {_list(L.NOT_NAMES)} AND length({bare}) >= 2 AND NOT regexp_matches({bare}, '^[0-9]+$'))"


def _name_layouts() -> dict[str, tuple[str, int, str, str]]:
    """By query: pattern, group of the name (0: the whole match), the condition on a match m and how it is shown."""
    lex, d = L.DEFAULT_LEXICON, Duck()
    g = lambda p, n: f"regexp_extract(m, {d.re(p)}, {n})"
    both = lambda p: f"{_word_ok(g(p, 1))} AND {_word_ok(g(p, 2))}"
    every = _list(lex.forenames | lex.surnames)
    pair = lambda p: f"{both(p)} AND lower({g(p, 2)}) NOT IN {_list(L.EPONYM_FOLLOWERS)} AND (lower({g(p, 1)}) IN {every} OR lower({g(p, 2)}) IN {every})"
    first = _word_ok("string_split(m, ' ')[1]")
    extra = g(L.TITLE_NAME, 3)
    inner = lambda parts: f"{parts[0]}({parts[1]}){parts[2]}"
    return {
        "det_n1_surname_comma": (L.SURNAME_COMMA, 0, both(L.SURNAME_COMMA), "m"),
        "det_n2_titlecase_comma": (L.TITLECASE_COMMA, 0, f"lower({g(L.TITLECASE_COMMA, 1)}) IN {_list(lex.surnames)} AND {both(L.TITLECASE_COMMA)}", "m"),
        "det_n3_titled": (L.TITLE_NAME, 0, _word_ok(g(L.TITLE_NAME, 2)), f"{g(L.TITLE_NAME, 1)} || ' ' || {g(L.TITLE_NAME, 2)} || CASE WHEN {extra} <> '' THEN ' ' || {extra} ELSE '' END"),
        "det_n4_salutation": (inner(L.DEAR), 1, first, "m"),
        "det_n5_relation": (inner(L.RELATION), 1, first, "m"),
        "det_n6_bracket": (inner(L.BRACKET), 1, first, "m"),
        "det_n7_full_name": (L.FULL_NAME, 0, pair(L.FULL_NAME), "m"),
        "det_n8_all_caps": (L.ALL_CAPS, 0, pair(L.ALL_CAPS), "m"),
    }


#: Queries over notes that name more relations.
RELATED = ("det_n5_relation",)


def _name_checks() -> dict[str, str]:
    return {n: _all(pattern, keep, group, show, n in RELATED) for n, (pattern, group, keep, show) in _name_layouts().items()}


def _evidence_check() -> str:
    """Check SQL of the best paragraphs: a paragraph a line, scored for each question."""
    scored = []
    for q in QUESTIONS:
        hit = lambda words: " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words)
        scored.append(f"SELECT '{q.id}' AS question_id, doc_id, i, p, least(1.0::DOUBLE, ({hit(q.keywords)}) / {len(q.keywords)}.0::DOUBLE + 0.3::DOUBLE * ({hit(q.hints)})) AS confidence FROM x")
    return f"""WITH x AS (SELECT doc_id, i, p, lower(p) AS low FROM (SELECT doc_id, trim(unnest(ls), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS p, unnest(range(len(ls))) AS i FROM (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) a) b WHERE length(p) >= 10),
s AS ({" UNION ALL ".join(scored)}), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY confidence DESC, doc_id, i) AS place FROM s WHERE confidence > 0)
SELECT question_id, CAST(place AS INT) AS place, confidence, 'doc' || doc_id AS source_file, 0 AS page_num, CASE WHEN length(p) > 500 THEN substr(p, 1, 500) || '...' ELSE p END AS text FROM r WHERE place <= 5"""


def _suppressed_check() -> str:
    """Check SQL: all layouts' matches with their places, then, by recursion over a note's matches in order of priority, those that
    overlap none kept before. Places are the running lengths of the pieces that a note is cut into at the matches."""
    parts = []
    for i, (pattern, group, keep, show) in enumerate(_name_layouts().values()):
        if group:  # before, name and after, each marked off
            before, inside, behind = (L.DEAR, L.RELATION, L.BRACKET)[i - 3]
            pattern, new = f"({before})({inside})({behind})", "'\\1' || chr(1) || '\\2' || chr(2) || '\\3'"
        else:
            new = "chr(1) || '\\0' || chr(2)"
        cut = f"string_split(regexp_replace(text, {Duck().re(pattern)}, {new}, 'g'), chr(1))"
        parts.append(f"""SELECT doc_id, {i} AS prio, s, s + length(m) AS e, {show} AS shown FROM (
  SELECT doc_id, pos, string_split(seg, chr(2))[1] AS m, coalesce(sum(length(replace(seg, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, unnest(segs) AS seg, unnest(range(len(segs))) AS pos FROM (SELECT doc_id, {cut} AS segs FROM v_planted) a) b) c WHERE pos > 0 AND {keep}""")
    return f"""WITH RECURSIVE {V.planted(Duck())}, l AS ({" UNION ALL ".join(parts)}),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY prio, s) AS i FROM l),
k AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, []::STRUCT(s BIGINT, e BIGINT, shown VARCHAR)[] AS kept FROM v_planted
  UNION ALL SELECT k.doc_id, o.i, CASE WHEN len(list_filter(kept, lambda x: o.s < x.e AND o.e > x.s)) > 0 THEN kept
    ELSE list_append(kept, {{'s': CAST(o.s AS BIGINT), 'e': CAST(o.e AS BIGINT), 'shown': o.shown}}) END FROM k JOIN o ON o.doc_id = k.doc_id AND o.i = k.i + 1),
z AS (SELECT doc_id, list_sort(arg_max(kept, i)) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, CAST(len(kept) AS BIGINT) AS n, array_to_string(list_transform(kept, lambda x: x.shown), '|') AS found FROM z"""


def detections(rows: Callable[[SparkSession, str], DataFrame], source_file: str) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The detection, dating and redaction queries over (doc_id, text) rows."""
    over = lambda found: lambda spark, sf_dir: rows(spark, sf_dir).select("doc_id", *_texts(found(F.col("text"))))
    return {
        "det_r1_numbers": over(lambda t: pii.plain(t)["nhs_number"]),
        "det_r2_phones": over(lambda t: pii.plain(t)["phone_number"]),
        "det_r3_postcodes": over(lambda t: pii.plain(t)["postcode"]),
        "det_r4_emails": over(lambda t: pii.plain(t)["email"]),
        "det_r5_safeguarding": over(lambda t: pii.labelled(t, L.SAFEGUARDING, "safeguarding", 10)),
        "det_r6_sexual_health": over(lambda t: pii.labelled(t, L.SEXUAL_HEALTH, "sexual_health", 30)),
        "det_c1_custom_words": over(lambda t: pii.custom_words(t, CUSTOM)),
        "det_n9_suppressed_names": over(names.detect_names),
        "cls12_detection": lambda spark, sf_dir: cls12_detection(rows(spark, sf_dir), source_file),
        "fn12_document_date": lambda spark, sf_dir: rows(spark, sf_dir).select("doc_id", dates.document_date(F.col("text")).alias("dated")),
        "red01_redacted_text": lambda spark, sf_dir: red01_redacted_text(rows(spark, sf_dir)),
        **{n: over(lambda t, k=n.split("_")[1]: names.layouts(t, L.DEFAULT_LEXICON)[k]) for n in _name_checks()},
    }


def doc_det_k1_risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.transform(pii.risk_flags(F.col("text"), RISK), lambda f: F.concat_ws(":", f["phrase"], f["category"]))
    return documents(spark, sf_dir).select("doc_id", F.array_join(flags, ",").alias("flags"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "emails_by_address": emails,
    "agg15_name_quality": name_quality,
    "cls01_subject": subject_rows,
    "cls02_address": address_rows,
    "cls03_staff": staff_rows,
    "cls04_page_staff": cls04_page_staff,
    "cls05_label_context": cls05_label_context,
    "cls09_unscreened_pages": cls09_unscreened_pages,
    "cls10_enabled_categories": cls10_enabled_categories,
    "fn23_wrap": fn23_wrap,
    "snk04_bundle_parts": snk04_bundle_parts,
    "src03_text_pages": src03_text_pages,
    "txt01_keyword_scan": txt01_keyword_scan,
    "txt02_best_evidence": txt02_best_evidence,
    # over planted notes, which check SQL covers, and over the real texts, where the engines' regular expressions differ
    **detections(planted, "planted.txt"),
    **{n: q for n, q in detections(related, "planted.txt").items() if n in RELATED},
    **{f"doc_{n}": q for n, q in detections(documents, "documents").items()},
    "doc_det_k1_risk_flags": doc_det_k1_risk_flags,
    **{n: by_sql(n) for n in analytics.Q},
    # functions over cases and findings, which the statements of the same names check
    **CASE_QUERIES,
    **casework.QUERIES,
}

_DIGITS = " + ".join(f"CAST(substr({_number_text(None)}, {i + 1}, 1) AS INT) * {10 - i}" for i in range(9))
_CHECK = f"CASE 11 - ({_DIGITS}) % 11 WHEN 11 THEN 0 ELSE 11 - ({_DIGITS}) % 11 END = CAST(substr({_number_text(None)}, 10, 1) AS INT)"

def _date_check() -> str:
    """Check SQL: the first valid date of each layout, layouts in order."""
    d, firsts = Duck(), []
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    for i, p in enumerate(L.DATES):
        g = lambda n, p=p: f"regexp_extract(m, {d.re(p)}, {n})"
        day, month = (g(2), g(1)) if i == 2 else (g(1), g(2))
        number = month if i == 3 else f"CAST(list_position({months}, substr(lower({month}), 1, 3)) AS VARCHAR)"
        iso = f"try_cast({g(3)} || '-' || lpad({number}, 2, '0') || '-' || lpad({day}, 2, '0') AS DATE)"
        firsts.append(f"list_filter(list_transform(regexp_extract_all(substr(text, 1, 2000), {d.re(p)}), lambda m: {iso}), lambda x: x IS NOT NULL AND year(x) BETWEEN 1990 AND 2040)[1]")
    return f"WITH {V.planted(d)} SELECT doc_id, COALESCE({', '.join(firsts)}) AS dated FROM v_planted"


ORACLES: dict[str, str] = {
    "fn12_document_date": _date_check(),
    "cls04_page_staff": f"WITH {V.planted(Duck())} SELECT doc_id, lower('dr ' || forename || ' ' || surname || '|' || surname || '|' || forename || ' ' || surname) AS staff FROM v_planted",
    "cls05_label_context": "SELECT doc_id, doc_id % 120 + 1 + 15 <= 90 AS labelled FROM documents",
    "emails_by_address": rf"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '{L.EMAIL}')) AS m FROM documents),
k AS (SELECT DISTINCT doc_id, lower(m) AS email FROM f WHERE NOT regexp_matches(lower(m), '[@.]nhs\.(net|uk)$'))
SELECT email, 'auto_redact' AS status, count(*) AS n_docs, min(doc_id) AS first_doc FROM k GROUP BY email""",
    "det_r1_numbers": _all(L.NUMBER, _CHECK),
    "det_r2_phones": _all(L.PHONE),
    "det_r3_postcodes": _all(L.POSTCODE),
    "det_r4_emails": _all(L.EMAIL, r"NOT regexp_matches(lower(m), '[@.]nhs\.(net|uk)$')"),
    "det_r5_safeguarding": _terms(L.SAFEGUARDING),
    "det_r6_sexual_health": _terms(L.SEXUAL_HEALTH),
    "det_c1_custom_words": _terms([(("" if cased else "(?i)") + rf"\b{p}\b", p) for p, cased in CUSTOM]),
    "cls01_subject": f"WITH {V.planted(Duck())} SELECT doc_id, forename || ' ' || surname AS entity, (forename = 'Emma' AND surname = 'Turner') AS subject FROM v_planted",
    "cls02_address": "SELECT doc_id, CAST(10 + doc_id % 4 AS VARCHAR) || ' High Street Guildford' AS entity, doc_id % 4 = 2 AS home FROM documents",
    "cls03_staff": f"WITH {V.planted(Duck())} SELECT doc_id, 'Mr ' || forename || ' ' || surname AS entity, (forename IN ('Peter', 'Sarah') OR surname IN ('Wright', 'Hughes')) AS staff FROM v_planted",
    "txt01_keyword_scan": searches.scan_check(" UNION ALL ".join(f"SELECT '{q.id}' AS item, {i} AS i, '{k}' AS kw" for q in QUESTIONS for i, k in enumerate(q.keywords))).replace(
        "@ AS", "string_agg(kw || '@' || source_file, ',' ORDER BY i, n) FILTER (place <= 10) AS", 1
    ),
    "txt02_best_evidence": _evidence_check(),
    "src03_text_pages": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(count(*) AS INT) AS lines, CAST(sum(length(line)) + count(*) - 1 AS INT) AS chars FROM (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) x WHERE trim(line, ' ') <> '' GROUP BY doc_id""",
    "fn23_wrap": r"""SELECT conv_id, turn, coalesce(CASE WHEN len(ws) > 0 THEN list_reduce(ws, lambda a, w: a || CASE WHEN length(regexp_extract(a, '[^\n]*$')) + 1 + length(w) <= 60 THEN ' ' ELSE chr(10) END || w) END, '') AS wrapped
FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws, text FROM conversations) x""",
    "cls09_unscreened_pages": """SELECT 'documents' AS source_file, doc_id AS page_num FROM (SELECT doc_id, substr(coalesce(text, ''), 1, CAST(1 + doc_id % 60 AS INT)) AS t FROM documents) x
WHERE doc_id % 2 > 0 AND length(replace(replace(replace(t, ' ', ''), chr(10), ''), chr(9), '')) < 30""",
    "cls10_enabled_categories": rf"""WITH {V.planted(Duck())}, f AS (SELECT doc_id, 'email' AS category, unnest(regexp_extract_all(text, {Duck().re(L.EMAIL)})) AS text FROM v_planted
UNION ALL SELECT doc_id, 'phone_number', unnest(regexp_extract_all(text, {Duck().re(L.PHONE)})) FROM v_planted)
SELECT DISTINCT doc_id, category, text, 'auto_redact' AS status FROM f WHERE category <> 'email' OR NOT regexp_matches(lower(text), '[@.]nhs\.(net|uk)$')""",
    **_name_checks(),
    "det_n9_suppressed_names": _suppressed_check(),
    **{n: q(Duck()) for n, q in analytics.Q.items()},
    **casework.ORACLES,
}
