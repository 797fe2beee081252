"""Keyword automaton, literal search, places on pages, the template catalogue."""

import json
import random
import re

import pytest

from vellum.operators import places, search, templates

PAGES = "file_seq long, source_file string, page_num int, text string"


def brute_scan(pages, questions, per=3, enough=10, around=120):
    out = {}
    for q in questions:
        hits, kws = [], set()
        for k in q.keywords:
            n = 0
            for _, f, p, t in pages:
                for m in re.finditer(re.escape(k), t or "", re.IGNORECASE) if k and (t or "").strip() else ():
                    if n < per:
                        n += 1
                        a, b = max(0, m.start() - around), min(len(t), m.end() + around)
                        hits.append((k, f, p, "…" * (a > 0) + t[a:b].replace("\n", " ").strip() + "…" * (b < len(t))))
                        kws.add(k)
            if len(hits) >= enough:
                break
        if hits:
            out[q.id] = (sorted(kws), len(hits), hits[:enough])
    return out


def test_keywords_as_by_regular_expressions(spark):
    draw = random.Random(3)
    words = ["aba", "ab", "a", "BAB", "x.y", "École", "ECOLE", "ſt", "st", "İ", "ı", "µ", "Straße", "Dr (x)", "\n", "  "]
    pages = [(i // 3, f"f{i // 3}", i % 3, None if i == 7 else "".join(draw.choice(words) for _ in range(draw.choice([0, 1, 5, 200])))) for i in range(24)]
    questions = [search.Question(f"q{i}", f"text {i}", tuple(draw.sample(["ab", "aba", "ABA", "x.y", "école", "ST", "i", "μ", "(X", "", "zzz", "bab"], 6))) for i in range(12)]
    questions += [search.Question("none", "", ()), search.Question("twice", "", ("ab", "ab"))]
    got = search.keyword_scan(spark.createDataFrame(pages, PAGES), questions).collect()
    show = lambda r: (r["matched_keywords"], r["match_count"], [(m["keyword"], m["source_file"], m["page_num"], m["context"]) for m in r["matches"]])
    assert {r["question_id"]: show(r) for r in got} == brute_scan(pages, questions)
    assert search.keyword_scan(spark.createDataFrame(pages, PAGES), [search.Question("n")]).count() == 0
    assert search.keyword_scan(spark.createDataFrame([], PAGES), questions).count() == 0


def test_a_long_page_and_many_keywords(spark):
    pages = [(0, "f", 0, " ".join(f"w{i}" for i in range(200_000)))]
    questions = [search.Question(f"q{i}", "", tuple(f"w{i * 20 + j} " for j in range(20))) for i in range(100)]
    got = search.keyword_scan(spark.createDataFrame(pages, PAGES), questions, enough=100).collect()
    assert len(got) == 100 and all(len(r["matched_keywords"]) == 20 for r in got)


@pytest.mark.parametrize("size", [1, 3, 256])
def test_places_by_brute_force(spark, size):
    draw = random.Random(size)
    spans, hits = [], []
    for page in (0, 1, None):
        at = 0
        for line in range(20):
            n = draw.choice([0, 1, 2, 7, 40])
            spans.append((page, at, at + n, 10.0, line * 5.0, 10.0 + n, line * 5.0 + 4, line // 4, line % 4, "s"))
            at += n + 1
        hits += [(page, s, s + draw.choice([1, 2, 9, 80]), f"h{i}") for i, s in enumerate(draw.sample(range(at + 5), 25))]
    hits += [(0, None, 3, "null"), (5, 1, 4, "no page"), hits[0]]
    h = spark.createDataFrame(hits, "page int, s int, e int, name string")
    sp = spark.createDataFrame(spans, "page int, s int, e int, x0 double, y0 double, x1 double, y1 double, block_no int, line_no int, name string")
    over = {x: [p for p in spans if p[0] == x[0] and x[1] is not None and p[1] < x[2] and p[2] > x[1]] for x in set(hits)}
    want = {x: (min(p[3] for p in ps), min(p[4] for p in ps), max(p[5] for p in ps), max(p[6] for p in ps)) if ps else (0.0,) * 4 for x, ps in over.items()}
    assert {tuple(r)[:4]: tuple(r)[4:] for r in places.boxes(h, sp, ["page"], size).collect()} == want
    rects = {(*tuple(r)[:4], r["block_no"], r["line_no"]): (r["x0"], r["y0"], r["x1"], r["y1"]) for r in places.rectangles(h, sp, ["page"], size).collect()}
    want = {(*x, p[7], p[8]): (10.0 + max(x[1], p[1]) - p[1], p[4], 10.0 + min(x[2], p[2]) - p[1], p[6]) for x, ps in over.items() for p in ps}
    assert {k: tuple(round(v, 6) for v in r) for k, r in rects.items()} == want


def test_literals(spark):
    df = spark.createDataFrame([(1, "aAa Aaa"), (2, None), (3, "İaa")], "k int, text string")
    assert sorted(tuple(r) for r in search.find_literal(df, ["k"], "aA").collect()) == [(1, 0, 2), (1, 4, 6), (3, 1, 3)]
    assert search.find_literal(df, ["k"], "").count() == 0


def test_templates(spark, tmp_path):
    q = lambda i, order=None, **more: {"id": i, "text": f"{i}?", "keywords": ["k"], **({"order": order} if order is not None else {}), **more}
    lines = [{"id": "tpl_pip", "questions": [q("b", 2), q("a", 1), q("c")]}, {"id": "own", "name": "Own", "questions": None}, {"name": "no id"}]
    (tmp_path / "b.json").write_text("\n".join([*map(json.dumps, lines), "no json"]))
    builtin = templates.read_templates(spark, str(tmp_path / "b.json"), builtin=True)
    assert {r["id"]: r["name"] for r in builtin.collect()} == {"tpl_pip": templates.BUILTIN["tpl_pip"], "own": "Own"} and len(templates.BUILTIN) == 13
    more = spark.createDataFrame([("mine", "Mine", "c", "", None, [("q1", "Q", "free_text", ["x", "y"], ["h"], 1)]), ("own", "Other", "c", "", None, [])], templates.TEMPLATE)
    custom = templates.save(builtin.limit(0), more)
    every = templates.catalogue(builtin, custom)
    assert {r["id"]: (r["is_builtin"], r["n_questions"], [x["id"] for x in r["questions"]]) for r in every.collect()} == {
        "tpl_pip": (True, 3, ["c", "a", "b"]), "own": (True, 0, []), "mine": (False, 1, ["q1"]),
    }
    assert [(x.id, tuple(x.keywords), tuple(x.hints)) for x in templates.ask(every, "mine")] == [("q1", ("x", "y"), ("h",))] and templates.ask(every, "none") == []
    changed = templates.update(custom, spark.createDataFrame([("mine", "New", None), ("gone", "N", None)], "id string, name string, category string"))
    assert {r["id"]: (r["name"], r["category"]) for r in changed.collect()} == {"mine": ("New", "c"), "own": ("Other", "c")}
    assert [r["id"] for r in templates.delete(changed, changed.filter("id = 'own'")).collect()] == ["mine"]
