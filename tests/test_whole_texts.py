"""Scalar functions over whole texts and pages against plain Python."""

import html

import pytest

from vellum.plans import registry

TEXTS = {1: "  Short One \n", 2: "A long text, " * 20 + "with its END \t\r\n ", 3: "three " * 20 + "\n\n", 4: None, 5: " \t", 6: "  x" * 40, 9: "Nine: é ß — " * 9}
PAGES = {1: "<p>short & \"plain\"</p>", 2: "a" * 399 + "<b>it's & \"more\"</b>", 3: "", 4: None, 5: "<é>" * 400}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    made = {"documents": (TEXTS, "doc_id long, text string"), "pages": (PAGES, "page_id long, html string")}
    for t in registry.TABLES:
        rows = spark.createDataFrame(list(made[t][0].items()), made[t][1]) if t in made else spark.range(1)
        rows.write.parquet(f"{at}/{t}.parquet")
    return str(at)


def of(spark, sf, name, key, value):
    return {r[key]: r[value] for r in registry.QUERIES[name](spark, sf).collect()}


def test_html_escape(spark, sf):
    want = {i: t and html.escape(t).replace("&#x27;", "&#39;") for i, t in PAGES.items()}
    assert of(spark, sf, "fn25_html_escape", "page_id", "escaped") == want


def test_normalize(spark, sf):
    assert of(spark, sf, "fn01_normalize", "doc_id", "norm") == {i: (t or "").strip(" \t\r\n").lower() for i, t in TEXTS.items()}


def test_needs_ocr(spark, sf):
    want = {i: i % 2 > 0 and sum(c not in " \n\t" for c in t or "") < 30 for i, t in TEXTS.items()}
    assert of(spark, sf, "src15_page_needs_ocr", "doc_id", "needs_ocr") == want
