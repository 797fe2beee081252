import random
import re

import pyarrow as pa
import pytest

from vellum.llm import jaccard_join as jj

AZ = {c: c + 32 for c in range(65, 91)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    ids = [i for i, _ in rows if i is not None]
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(i), find(j)
                comp[max(u, v)] = min(u, v)
    return sorted((str(i), len(x), None if i is None else find(i)) for i, x in sets)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(400))
    rows, n = [], 0
    passage = [word() for _ in range(60)]
    for size in (1, 3, 5, 6, 7, 8, 9, 11, 14, 20, 35, 60, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for edits in (0, 0, 1, 1, 2, size // 12, size // 8, size // 5):
                t = list(base)
                for _ in range(edits if len(t) > 1 else 0):
                    at = rng.randrange(len(t))
                    if rng.random() < 0.5:
                        t[at] = word()
                    else:
                        t = t[:at] + t[at + 1 :] if len(t) > 1 else t
                rows.append((n, (" ".join(t) or "x").upper() if rng.random() < 0.1 else " ".join(t)))
                n += 1
    for _ in range(40):  # a passage that many share
        rows.append((n, " ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)])))
        n += 1
    base = [word() for _ in range(200)]
    for _ in range(60):  # near copies, some just below the threshold to others
        t = list(base)
        for _ in range(rng.randrange(1, 9)):
            t[rng.randrange(200)] = word()
        rows.append((n, " ".join(t)))
        n += 1
    return rows


@pytest.mark.parametrize("settings", [jj.Settings(), jj.Settings(n2=1, k2=0), jj.Settings(n2=2, k2=1, spare=0.1), jj.Settings(n2=5, k2=2)])
def test_against_brute_force(spark, docs_of, settings):
    rows = [*corpus(), (5000, None), (5001, ""), (5002, " \n"), (None, "a b c d e f"), (5003, "a b c d e f"), (5004, "A B C D E F"), (7, "w1 w2 w3 w4 w5 w6")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jj.groups(docs_of(rows), settings).collect())
    assert got == brute(rows)


def test_small_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 7)
    monkeypatch.setattr(jj, "TOGETHER", 20)
    monkeypatch.setattr(jj, "CHUNK", 50)
    rows = corpus(5)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jj.groups(docs_of(rows)).collect())
    assert got == brute(rows)


def test_repeated_ids_are_one_node(spark, docs_of):
    """Texts under one id link with different groups, some in one bucket, and tie these together."""
    rows = corpus(7)
    ids = [i for i, _ in rows]
    rng = random.Random(1)
    again = [(rng.choice(ids), t) for _, t in rng.sample(rows, 60)]
    rows += [*again, (5, None), (rows[-1][0], rows[-1][1])]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jj.groups(docs_of(rows)).collect())
    want, sets = {i: i for i, _ in rows}, [(i, shingles(t)) for i, t in rows]

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(i), find(j)
                want[max(u, v)] = min(u, v)
    assert got == sorted((str(i), len(x), find(i)) for i, x in sets)


def test_word_hashes():
    """Equal words have equal hashes wherever they stand and however the bytes are cut; long words too."""
    long = "x" * 9000
    texts = ["", "Ab ab\tAB", None, f" {long} ab\n", "ab", f"{long}y {long}", "é É", "  "]
    for chunk in (7, 100, 1 << 20):
        jj.CHUNK, kept = chunk, jj.CHUNK
        try:
            h, first = jj.word_hashes(pa.array(texts))
        finally:
            jj.CHUNK = kept
        words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ)) for t in texts]
        assert first.tolist() == [sum(map(len, words[:i])) for i in range(len(words) + 1)]
        flat = [w for ws in words for w in ws]
        assert all((flat[i] == flat[j]) == (h[i] == h[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_very_long_and_tied_texts(spark, docs_of):
    """A text of 60,000 words, a copy with a hundredth of its words changed, one blank-free text, and sets just at the threshold."""
    long = [f"w{i * i % 9973}x{i}" for i in range(60_000)]
    near = [w if i % 500 else "changed" for i, w in enumerate(long)]
    at = [f"t{i}" for i in range(11)]  # seven shingles; of the other eight, six shared: 6 of 8 and 6 of 9
    rows = [(3, " ".join(long)), (2, " ".join(near)), (8, "z" * 300_000), (9, "z" * 300_000), (20, " ".join(at)), (21, " ".join([*at[:10], "u"])), (22, " ".join(["v", *at[:10], "u"]))]
    got = {r["doc_id"]: r["component_id"] for r in jj.groups(docs_of(rows)).collect()}
    assert got == {r[0]: r[2] for r in [(int(i), n, c) for i, n, c in brute(rows)]}


def test_keep_first_of_repeated_rows(spark, docs_of):
    docs = docs_of([(1, "a b c d e f"), (1, "a b c d e f"), (1, "else"), (4, "A B C D E F"), (6, None), (6, None)])
    assert sorted((r["doc_id"], r["text"]) for r in jj.keep_first(docs).collect() if r["text"]) == [(1, "a b c d e f"), (1, "else")]
    assert jj.keep_first(docs).count() == 3


def test_keep_first_and_empty(spark, docs_of):
    docs = docs_of([(4, "a b c d e f g"), (2, "A b c d e f g"), (9, "other"), (None, "a b c d e f g"), (5, None)])
    kept = jj.keep_first(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "5", "9", "None"]
    assert jj.groups(docs.limit(0)).count() == 0
