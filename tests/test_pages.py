"""Search over pages against plain Python: every document has a page, whatever its language."""

from collections import defaultdict

import pytest

from vellum.plans import registry

TEXTS = {
    1: "The cat and that dog with it.\nshort\nnothing much here",
    2: "Über that with the “secret” Straße\n" + "ÿ" * 600 + " the end",
    21: "  the naïve SECRET of the garden  \nwith cafés that matter and the rest",
    3: None,
    4: "日本語のテキストです the text",
    5: "",
    **{41 + 20 * i: f"line {i} — the one with a dash" for i in range(6)},
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    for t in registry.TABLES:
        made = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string") if t == "documents" else spark.range(1)
        made.write.parquet(f"{at}/{t}.parquet")
    return str(at)


def evidence():
    found = defaultdict(list)
    for i, text in TEXTS.items():
        for p in (text or "").split("\n"):
            p, low = p.strip(" "), p.strip(" ").lower()
            conf = min(1.0, sum(k in low for k in ("the", "that", "with")) / 3 + 0.3 * ("and" in low))
            if len(p) >= 10 and conf > 0:
                found[f"doc{i % 20}.txt"].append((-conf, i, p.encode(), p))
    return {
        (f, i, round(-c, 6), p[:500] + "..." if len(p) > 500 else p, n + 1)
        for f, rows in found.items()
        for n, (c, i, _, p) in enumerate(sorted(rows)[:5])
    }


def test_evidence(spark, sf):
    got = {(r["source_file"], r["page_num"], round(float(r["conf"]), 6), r["snippet"], r["n"]) for r in registry.QUERIES["txt02_evidence"](spark, sf).collect()}
    assert got == evidence()


def test_find_on_page(spark, sf):
    got = {r["doc_id"]: r["found"] for r in registry.QUERIES["txt03_find_on_page"](spark, sf).collect()}
    assert got == {i: "secret" in (t or "").lower() for i, t in TEXTS.items()}
