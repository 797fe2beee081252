"""The detection pipeline: pages of positioned text to classified findings."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.functions.matching import normalize, scan
from vellum.operators import classify, names, pii, places

FINDING = {"stage": "int", **pii.FIELDS, "before": "string", "context": "string"}
#: Characters before a finding that may hold a label, and those around it that are shown.
BEFORE, AROUND = 90, 70
PUNCTUATION = re.compile(r"""^[\s.,;:'"-]+|[\s.,;:'"-]+$""")
DETECTED = {"person_name", *pii.PLAIN, "safeguarding", "sexual_health", "custom_word"}
SPAN = "struct<text:string,x0:double,y0:double,x1:double,y1:double,s:int,e:int>"


@dataclass(frozen=True)
class Settings:
    auto_threshold: float = 0.80
    enabled: Sequence[str] = tuple(c for c in L.CATEGORIES if c not in ("date_of_birth", "manual"))
    staff: Sequence[str] = ()
    custom: Sequence[tuple[str, bool]] = ()
    risk: dict = field(default_factory=dict)
    lexicon: L.NameLexicon = L.DEFAULT_LEXICON


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc_id, source_file, page_num, page_text, spans): span texts joined by a blank within a line, else by a line break.

    spans: doc_id, source_file, text, page_num, x0, y0, x1, y1, block_no, line_no, span_no."""
    item = F.struct("block_no", "line_no", "span_no", "text", "x0", "y0", "x1", "y1")
    pages = spans.groupBy("doc_id", "source_file", "page_num").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(None).cast("int").alias("b"), F.lit(None).cast("int").alias("l"),
        F.array().cast("array<string>").alias("parts"), F.array().cast(f"array<{SPAN}>").alias("spans"),
    )

    def step(a: Column, x: Column) -> Column:
        gap = F.when(a["b"].isNull(), F.lit("")).when((a["b"] == x["block_no"]) & (a["l"] == x["line_no"]), F.lit(" ")).otherwise(F.lit("\n"))
        s = a["at"] + F.char_length(gap)
        e = s + F.char_length(x["text"])
        span = F.struct(x["text"].alias("text"), *[x[c].alias(c) for c in ("x0", "y0", "x1", "y1")], s.alias("s"), e.alias("e"))
        return F.struct(
            e.alias("at"), x["block_no"].alias("b"), x["line_no"].alias("l"),
            F.array_append(F.array_append(a["parts"], gap), x["text"]).alias("parts"), F.array_append(a["spans"], span.cast(SPAN)).alias("spans"),
        )

    cast = lambda c: c.cast(f"struct<at:int,b:int,l:int,parts:array<string>,spans:array<{SPAN}>>")
    built = F.aggregate("items", cast(start), lambda a, x: cast(step(a, x)))
    pages = pages.withColumn("__b", built)
    return pages.select("doc_id", "source_file", "page_num", F.array_join("__b.parts", "").alias("page_text"), F.col("__b.spans").alias("spans"))


def needs_ocr(n_images: Column, text: Column) -> Column:
    return (n_images > 0) & (F.char_length(F.translate(text, " \n\t", "")) < 30)


def findings(text: str, lexicon: L.NameLexicon, custom: Sequence[tuple[str, bool]]) -> Iterator[tuple]:
    """Names without punctuation at their ends, then patterns, then custom phrases of one page, each with its surroundings."""

    def around(s: int, e: int) -> tuple[str, str]:
        a, b = max(0, s - AROUND), min(len(text), e + AROUND)
        return text[max(0, s - BEFORE) : s], "…" * (a > 0) + " ".join(text[a:b].split()) + "…" * (b < len(text))

    for _, s, e, name, confidence, reason in names.find_names(text, lexicon):
        if bare := PUNCTUATION.sub("", name):
            yield 0, 0, "person_name", s, e, bare, confidence, reason, *around(s, e)
    for stage, found in ((1, pii.find_patterns(text)), (2, pii.find_custom(text, custom))):
        for f in found:
            if f[4]:
                yield stage, *f, *around(f[2], f[3])


def detect(pages: DataFrame, subject: classify.Subject, settings: Settings | None = None) -> DataFrame:
    """One row per finding of pages(doc_id, source_file, page_num, page_text[, spans][, ocr]).

    Names, then patterns, then custom phrases; the subject's and staff's data are excluded; equal findings of a page count
    once, the first wins; disabled categories are dropped before that, exclusions never."""
    st = settings or Settings()
    has_spans, ocr = "spans" in pages.columns, F.col("ocr") if "ocr" in pages.columns else F.lit(False)
    rows = pages.withColumn("ocr", ocr).withColumn("spans", F.col("spans") if has_spans else F.array().cast(f"array<{SPAN}>"))
    text = F.col("page_text")
    rows = rows.withColumn("staff_here", classify.page_staff(text))
    every = scan(text, lambda t: findings(t, st.lexicon, st.custom), FINDING)
    keys = ["doc_id", "source_file", "page_num"]
    # from here on no page text is needed: what is shuffled holds the finding and its surroundings only
    found = rows.select(*keys, "staff_here", "ocr", F.explode(every).alias("m")).select(*keys, "staff_here", "ocr", "m.*")
    if has_spans:
        laid = rows.select(*keys, F.explode("spans").alias("p")).select(*keys, "p.*")
        found = places.boxes(found, laid, keys)
    else:
        found = found.withColumns({c: F.lit(0.0) for c in places.BOX})
    first = W.partitionBy(*keys, "category", normalize(F.col("text"))).orderBy("stage", "ord", "s")
    count_once = lambda df: df.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    if DETECTED <= set(st.enabled):  # nothing is dropped by its status, so that each finding is judged once
        found = classified(count_once(found), subject, st)
    else:
        found = classified(found, subject, st)
        found = count_once(found.filter(F.col("category").isin(list(st.enabled)) | F.col("status").startswith("excluded")))
    return found.select(
        *keys, "stage", "ord", "s", "e", "text", "category", "status", "confidence", "x0", "y0", "x1", "y1", "reason",
        "context", pii.risk_flags(F.col("text"), st.risk).alias("risk_flags"),
    )


def classified(found: DataFrame, subject: classify.Subject, st: Settings) -> DataFrame:
    """Findings with status, reason, confidence and boxes as the subject, staff, thresholds and scanned pages decide."""
    name, custom = F.col("stage") == 0, F.col("stage") == 2
    variants = classify.name_variants(F.col("text"))
    subject_hit = F.when(custom, F.lit(False)).when(name, F.exists(variants, lambda v: classify.is_subject(v, subject))).otherwise(classify.is_subject(F.col("text"), subject))
    label = classify.in_staff_label(F.col("before"), F.char_length("before"))
    here = F.array_contains("staff_here", normalize(F.col("text"))) | F.array_contains("staff_here", classify.without_title(F.col("text")))
    listed = F.exists(variants, lambda v: classify.is_staff(v, st.staff))
    found = found.withColumns({"subject_hit": subject_hit, "label_hit": name & label, "here_hit": name & here})
    staff_hit = F.col("label_hit") | F.col("here_hit") | (name & listed)
    found = found.withColumn("staff_hit", staff_hit & ~F.col("subject_hit"))
    excluded = F.col("subject_hit") | F.col("staff_hit")
    why = (
        F.when(F.col("subject_hit") & name, F.lit("Matched data subject"))
        .when(F.col("subject_hit"), F.concat(F.lit("Matched data subject ("), F.col("category"), F.lit(")")))
        .when(F.col("staff_hit") & F.col("label_hit"), F.lit("Name in staff-labelled field (Practitioner/Author)"))
        .when(F.col("staff_hit") & F.col("here_hit"), F.lit("Name matched practitioner on this page"))
        .when(F.col("staff_hit"), F.lit("Matched staff list"))
        .otherwise(F.col("reason"))
    )
    status = F.when(custom, F.lit("auto_redact")).otherwise(classify.decide(F.col("subject_hit"), F.col("staff_hit"), F.col("confidence"), st.auto_threshold))
    sure = F.when(excluded, F.lit(1.0)).otherwise(F.col("confidence"))
    # the cap for scanned pages comes after the decision and leaves it
    found = found.withColumns({"status": status, "reason": F.when(F.col("ocr"), F.concat(F.lit("OCR: "), why)).otherwise(why)})
    found = found.withColumn("confidence", F.when(F.col("ocr"), F.least(sure, F.lit(0.85))).otherwise(sure))
    return found.withColumns({c: F.when(excluded, F.lit(0.0)).otherwise(F.col(c)) for c in ("x0", "y0", "x1", "y1")})


def unscreened(pages: DataFrame) -> DataFrame:
    """(source_file, page_num) of image pages that no text was read from; pages(…, n_images, page_text)."""
    return pages.filter(needs_ocr(F.col("n_images"), F.col("page_text"))).select("source_file", "page_num")
