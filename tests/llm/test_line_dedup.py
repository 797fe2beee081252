import numpy as np
import pytest

from vellum.llm import line_dedup as ld

LINE = "This Line is certainly more than forty characters long {}"


def brute(rows, min_docs=5, min_chars=40):
    az = {c: c + 32 for c in range(65, 91)}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(az)
    held = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


ROWS = (
    [(i, f"own {i}\n  {LINE.format('A').upper() if i % 2 else LINE.format('a')}\t\nshort\nshort") for i in range(9)]
    + [(20 + i, LINE.format("b") + "\n" + LINE.format("b")) for i in range(4)]
    + [(30, None), (31, ""), (None, LINE.format("a")), (3, LINE.format("a")), (40, "\n".join([LINE.format("a")] * 500)), (41, "é" * 39 + "\n" + "é" * 40)]
    + [(50 + i, "é" * 40) for i in range(6)]
)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_against_brute_force(spark, docs_of, limit):
    docs = docs_of(ROWS)
    index = ld.LineIndex.build(docs, broadcast_bytes=limit)
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in index.report(docs).collect())
    assert got == brute(ROWS)
    new = index.rewrite(docs)
    assert new.columns == docs.columns and new.filter("n_chars <> char_length(coalesce(text, ''))").count() == 0


def test_insert_and_delete_are_reversible(spark, docs_of):
    docs = docs_of(ROWS)
    index = ld.LineIndex.build(docs)
    gone = index.delete(docs.filter("doc_id >= 4").select("doc_id"))
    assert gone.repeated().count() == 0 and gone.passing().count() == 0
    back = gone.insert(docs.filter("doc_id >= 4"))
    state = lambda x: sorted((bytes(r["key"]), r["n_docs"], r["last_doc"]) for r in x.repeated().collect())
    assert state(back) == state(index)
    keys = [k for k, *_ in state(index)]
    held = set().union(*[{k for k, h in zip(keys, ld.Cuckoo.load(bytes(r["blob"])).holds(keys), strict=True) if h} for r in back.filters.collect()])
    assert held == set(keys)
    assert index.insert(docs).refs.count() == index.refs.count()


def test_cuckoo():
    keys = [bytes(x) for x in np.random.default_rng(0).integers(0, 256, (3000, 16), dtype=np.uint8)]
    f = ld.Cuckoo.of(keys[:2000])
    assert f.holds(keys[:2000]).all() and f.holds(keys[2000:]).mean() < 0.01
    assert all(f.remove(k) for k in keys[:1000])
    assert ld.Cuckoo.load(f.dump()).holds(keys[1000:2000]).all() and f.holds(keys[:1000]).mean() < 0.05


def test_empty(spark, docs_of):
    docs = docs_of([(1, "x")]).limit(0)
    assert ld.LineIndex.build(docs).report(docs).count() == 0
