"""Queries over the real texts on a small documents table: several languages, long and null texts."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import lexicons as L
from vellum.plans import registry

LONG = "Lorem ipsum dolor. " * 300
TEXTS = {
    1: "Spoke with Dr Smith. Call 07700 900123, GU1 5SU, 943 476 5919 (not 943 476 5918), jo@example.com, me@nhs.net",
    2: "Größe und Straße – Herr Müller schrieb “abuse, HIV” on file. Date: 3 March 2024",
    3: LONG + "Number quoted: 943 476 5919, Dr Jones, 14/02/2023",
    4: None,
    5: "À l’hôpital: rien.",
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at)


FOUND = {
    "doc_det_r1_numbers": {1: ["943 476 5919"], 3: ["943 476 5919"]},
    "doc_det_r2_phones": {1: ["07700 900123"]},
    "doc_det_r3_postcodes": {1: ["GU1 5SU"]},
    "doc_det_r4_emails": {1: ["jo@example.com"]},
    "doc_det_r5_safeguarding": {},
    "doc_det_r6_sexual_health": {2: ["HIV"]},
    "doc_det_c1_custom_words": {2: ["on file"], 3: ["Number"]},
    "doc_det_n3_titled": {1: ["Dr Smith"], 3: ["Dr Jones"]},
    "doc_det_n9_suppressed_names": {1: ["Dr Smith"], 3: ["Dr Jones"]},
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_findings_in_real_texts(spark, sf, name):
    got = {r["doc_id"]: (r["n"], r["found"]) for r in registry.QUERIES[name](spark, sf).collect()}
    assert got == {i: (len(FOUND[name].get(i, [])), "|".join(FOUND[name].get(i, []))) for i in TEXTS}


def test_dates_and_risk_flags(spark, sf):
    dated = {r["doc_id"]: r["dated"] for r in registry.QUERIES["doc_fn12_document_date"](spark, sf).collect()}
    assert dated == {1: None, 2: datetime.date(2024, 3, 3), 3: None, 4: None, 5: None}  # 3's date is behind the head
    flags = {r["doc_id"]: r["flags"] for r in registry.QUERIES["doc_det_k1_risk_flags"](spark, sf).collect()}
    assert flags == {1: "", 2: "abuse:safeguarding,HIV:health", 3: "", 4: "", 5: ""}


def test_detection_and_redaction(spark, sf):
    rows = registry.QUERIES["doc_cls12_detection"](spark, sf).collect()
    assert all((TEXTS[r["doc_id"]])[r["s"] : r["e"]].strip() == r["text"] for r in rows)
    assert {(r["doc_id"], r["text"], r["status"]) for r in rows} >= {(1, "Dr Smith", "auto_redact"), (1, "943 476 5919", "excluded_subject"), (3, "Dr Jones", "auto_redact"), (2, "HIV", "flagged")}
    red = {r["doc_id"]: r["redacted"] for r in registry.QUERIES["doc_red01_redacted_text"](spark, sf).collect()}
    assert red[3] == TEXTS[3].replace("943 476 5919", "[REDACTED]").replace("Dr Jones", "[REDACTED]")
    assert red[4] == "" and red[5] == TEXTS[5] and "Smith" not in red[1]


def test_planted_and_real_queries_pair_up():
    planted = {n for n in registry.QUERIES if n.startswith("det_")} | {"cls12_detection", "fn12_document_date", "red01_redacted_text"}
    assert {f"doc_{n}" for n in planted} == {n for n in registry.QUERIES if n.startswith("doc_")}


def plain_layouts(text):
    """Every layout's names by plain regular expressions and list look-ups."""
    known = L.DEFAULT_LEXICON.forenames | L.DEFAULT_LEXICON.surnames
    ok = lambda w: len(b := w.lower().rstrip(".,;:")) >= 2 and b not in L.NOT_NAMES and not b.isdigit()
    pair = lambda m: m[2].lower() not in L.EPONYM_FOLLOWERS and {m[1].lower(), m[2].lower()} & known and ok(m[1]) and ok(m[2])
    whole = {
        "det_n1_surname_comma": (L.SURNAME_COMMA, lambda m: ok(m[1]) and ok(m[2])), "det_n2_titlecase_comma": (L.TITLECASE_COMMA, lambda m: m[1].lower() in L.DEFAULT_LEXICON.surnames and ok(m[1]) and ok(m[2])),
        "det_n7_full_name": (L.FULL_NAME, pair), "det_n8_all_caps": (L.ALL_CAPS, pair),
    }
    out = {n: [m[0] for m in re.finditer(p, text) if keep(m)] for n, (p, keep) in whole.items()}
    out["det_n3_titled"] = [" ".join(x for x in m.groups() if x) for m in re.finditer(L.TITLE_NAME, text) if ok(m[2])]
    for n, parts, every in (("det_n4_salutation", L.DEAR, False), ("det_n5_relation", L.RELATION, False), ("det_n6_bracket", L.BRACKET, True)):
        found = [m[1] for m in re.finditer("{}({}){}".format(*parts), text)]
        out[n] = [x for x in found if all(map(ok, x.split() if every else x.split()[:1]))]
    return out


def test_layouts_over_whole_texts_as_by_plain_search(spark):
    """Real texts hold few names, so notes with many are put behind them."""
    notes = "\nSMITH, John Dear Mrs Éva Jones, Mr. A. Brown sister Anna Lee (Carer) Anna Lee (Carer) Khan, Ali PATEL SMITH éSmith, John John Smith-Ward Parkinson Disease Green Disease"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(notes)).alias("text")).collect()
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in docs], "doc_id long, text string")
    for name, query in registry.detections(lambda spark, sf_dir: df, "documents").items():
        if name in plain_layouts(""):
            got = {r["doc_id"]: r["found"] for r in query(spark, "").collect()}
            assert got == {r["doc_id"]: "|".join(plain_layouts(r["text"])[name]) for r in docs}, name
            assert any(got.values())
