"""Names, patterns, exclusions and the page pipeline on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import matching as M
from vellum.functions.lexicons import DEFAULT_LEXICON
from vellum.operators import classify, names, pii
from vellum.plans import detect

SUBJECT = classify.Subject("John Smith", "John", "Smith", "943 476 5919", "", "12 High Street, Guildford")

FOUND = [
    ("SMITH, John was seen today with his wife.", ["SMITH, John"]),
    ("Re: JONES, Mary (DOB 01/02/1960)", ["JONES, Mary"]),
    ("Patient: O'BRIEN, SIOBHAN", ["O'BRIEN, SIOBHAN"]),
    ("cc Taylor, James (solicitor)", ["Taylor, James"]),
    ("However, John attended late.", []),
    ("Seen by neighbour Mr McDonald yesterday.", ["Mr McDonald"]),
    ("Letter from Mrs O'Brien received.", ["Mrs O'Brien"]),
    ("Next of kin: JOHN SMITH", ["JOHN SMITH"]),
    ("ACTIVE PROBLEMS", []),
    ("BLOOD PRESSURE", []),
    ("REPEAT PRESCRIPTION", []),
    ("MEDICATION, Aspirin 75mg od", []),
    ("Diagnosis: Parkinson Disease confirmed.", []),
    ("Barrett Oesophagus", []),
    ("Colles Fracture", []),
    ("Spoke with Jane Wilson about the results.", ["Jane Wilson"]),
    ("Adam Simpson (Husband) came", ["Adam Simpson"]),
    ("Dr J. Smith called", ["Dr Smith"]),
    ("Contacted carer\nEmma regarding", ["Emma"]),
    ("", []),
]


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_names(spark):
    df = one(spark, [(i, t) for i, (t, _) in enumerate(FOUND)], "i int, t string").withColumn("m", names.detect_names(F.col("t"), DEFAULT_LEXICON))
    got = {r["i"]: [m["text"] for m in r["m"]] for r in df.collect()}
    assert got == {i: want for i, (_, want) in enumerate(FOUND)}


def test_offsets_are_code_points(spark):
    text = "é Dr Smith 😀 saw Dr Jones\n— Mr Green"
    m = one(spark, [(text,)], "t string").select(names.detect_names(F.col("t")).alias("m")).first()["m"]
    assert [text[x["s"] : x["e"]] for x in m] == ["Dr Smith", "Dr Jones", "Mr Green"]


def test_suppression_keeps_the_first(spark):
    rows = [(1, 0, 10, "a", 0.5, ""), (2, 5, 15, "b", 0.5, ""), (3, 12, 20, "c", 0.5, "")]
    df = one(spark, [(rows,)], f"m {names.FOUND}").select(names.suppress(F.col("m")).alias("m"))
    assert [x["text"] for x in df.first()["m"]] == ["a", "c"]  # b is dropped and shadows nothing


@pytest.mark.parametrize(("number", "good"), [("943 476 5919", True), ("943 476 5918", False), ("12345", False), ("943-476-5919", True)])
def test_check_digit(spark, number, good):
    assert one(spark, [(number,)], "n string").select(M.valid_check_digit(F.col("n")).alias("v")).first()["v"] is good


def test_patterns(spark):
    text = "Ring 07700 900123, john.doe@example.com, GU8 5SU, 943 476 5919. From: surgery.admin@nhs.net tel+44 7700 900123 and +44 7700 900123"
    m = one(spark, [(text,)], "t string").select(pii.detect_patterns(F.col("t")).alias("m")).first()["m"]
    by = {}
    for x in m:
        by.setdefault(x["category"], []).append(x["text"])
    assert by["email"] == ["john.doe@example.com"] and by["postcode"] == ["GU8 5SU"] and by["nhs_number"] == ["943 476 5919"]
    assert by["phone_number"][0] == "07700 900123" and "+44 7700 900123" in by["phone_number"] and len(by["phone_number"]) == 2


def test_terms_and_case(spark):
    text = "nai, aids, PrEP pep; domestic  violence"
    m = one(spark, [(text,)], "t string").select(pii.detect_patterns(F.col("t")).alias("m")).first()["m"]
    assert [x["text"] for x in m if x["category"] == "sexual_health"] == ["aids", "PrEP"]
    assert [x["text"] for x in m if x["category"] == "safeguarding"] == ["domestic  violence", "nai"]


def test_address_and_subject(spark):
    rows = [("14 High Street Guildford", False), ("12 High Street Guildford", True), ("Jane Smith", False), ("Smith", True), ("Dr John Smith Jr", True), ("john", True)]
    df = one(spark, rows, "e string, want boolean").withColumn("got", classify.is_subject(F.col("e"), SUBJECT))
    assert all(r["want"] == r["got"] for r in df.collect())


def test_staff_shares_a_telling_word(spark):
    rows = [("Mr Jones", True), ("Dr Brown", False), ("david", True), ("Dr. Green", True)]
    df = one(spark, rows, "e string, want boolean").withColumn("got", classify.is_staff(F.col("e"), ("Dr David Jones", "Dr. Who")))
    assert {r["e"]: r["got"] for r in df.collect()} == dict(rows)


def test_page_text_and_boxes(spark):
    spans = [
        ("d", "f", t, 0, float(x), float(y), x + 20.0, y + 12.0, 0, line, n)
        for n, (t, x, y, line) in enumerate([("Dr", 72, 10, 0), ("Smith", 95, 10, 0), ("Dr", 72, 110, 1), ("Wilson", 95, 110, 1)])
    ]
    schema = "doc_id string, source_file string, text string, page_num int, x0 double, y0 double, x1 double, y1 double, block_no int, line_no int, span_no int"
    pages = detect.page_texts(one(spark, spans, schema))
    assert pages.first()["page_text"] == "Dr Smith\nDr Wilson"
    found = {r["text"]: r for r in detect.detect(pages, SUBJECT).collect()}
    assert found["Dr Wilson"]["y0"] >= 110 and found["Dr Smith"]["status"] == "auto_redact"


def test_pipeline_rules(spark):
    text = "SMITH, John attended with daughter Emma Watson.\nNHS Number: 943 476 5919\nPractitioner: Dr David Jones\n" + "x " * 60 + "\nDavid Jones wrote. Emma Watson again."
    pages = one(spark, [("d", "f", 0, text, True)], "doc_id string, source_file string, page_num int, page_text string, ocr boolean")
    st = detect.Settings(custom=(("again", False),), enabled=("person_name", "custom_word"), risk={"x": ["watson"]})
    rows = {r["text"]: r for r in detect.detect(pages, SUBJECT, st).collect()}
    assert rows["SMITH, John"]["status"] == "excluded_subject" and rows["943 476 5919"]["status"] == "excluded_subject"  # kept though disabled
    assert rows["David Jones"]["reason"] == "OCR: Name matched practitioner on this page"
    assert rows["SMITH, John"]["confidence"] == 0.85 and rows["SMITH, John"]["x0"] == 0.0  # the cap comes after the decision
    assert rows["again"]["status"] == "auto_redact" and rows["Emma Watson"]["risk_flags"][0]["phrase"] == "watson"
    assert rows["Emma Watson"]["s"] == text.index("Emma")  # counted once, the first wins


def test_context_marks_cuts(spark):
    t = "a" * 100 + " Dr Smith " + "b" * 100
    got = one(spark, [(t,)], "t string").select(M.snippet(F.col("t"), F.lit(101), F.lit(109)).alias("c")).first()["c"]
    assert got.startswith("…") and got.endswith("…") and "Dr Smith" in got


def test_relations_of_four_layouts_are_found(spark):
    """Of ten layouts of planted notes four tell a relation: daughter, wife, neighbour, carer."""
    from vellum.plans import registry

    sf_dir = "/root/testdata/sf0.001"
    found = {r["doc_id"] % 10: r["n"] for r in registry.QUERIES["det_n5_relation"](spark, sf_dir).filter("n > 0").collect()}
    assert found == {0: 1, 2: 1, 7: 1, 8: 1}
