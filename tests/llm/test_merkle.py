"""The manifest against a plain tree, for trees that end in different passes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """{row number: (leaf, subroot, root, proof, folded)} of rows (doc_id, text, lang, source, n_chars)."""
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, la, s, n: h(*map(coded, (d, s, la, n, t)))

    def tree(nodes):
        """(root, for each node the siblings with their side, from below)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, p in enumerate(paths):
                j = at[i] ^ 1
                p.append(("" if j >= len(level) else ("L" if j < at[i] else "R") + level[j]))
                at[i] //= 2
            level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0], paths

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    subs, ways = [], []
    for la in langs:
        own = sorted((i for i, r in enumerate(rows) if r[2] == la), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, leaf(*rows[i])))
        sub, paths = tree([leaf(*rows[i]) for i in own])
        subs.append(sub)
        ways.append(dict(zip(own, paths, strict=True)))
    root, tops = tree(subs)
    out = {}
    for sub, way, top in zip(subs, ways, tops, strict=True):
        for i, path in way.items():
            d, t, la, s, n = rows[i]
            bad = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
            x = leaf(d, t, la, s, n + 1 if bad else n)
            for p in path + top:
                x = h(p[1:], x) if p[:1] == "L" else h(x, p[1:])
            out[i] = (leaf(d, t, la, s, n), sub, root, h(*(p[1:] for p in path + top)), x)
    return out


@pytest.fixture(scope="module")
def table():
    draw = random.Random(5)
    rows = [(i, "x" * (i % 9) + "é", "en", f"s{i % 3}", i % 9 + 1) for i in range(83)]
    rows += [(1000 + i, "t", "fr", None, None) for i in range(16)] + [(2000, None, "de", "s", 3), (None, "", None, "s", 0), (None, "no id", None, None, None)]
    rows += [rows[3], rows[3], (4, "another text of a repeated id", "en", "s", 1), (3000, "y" * 300_000, "zz", "s", 5)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [1, 2, 10])
def test_proofs_as_in_a_plain_tree(spark, table, span):
    docs = spark.createDataFrame([(*r, "h", 1, "p") for r in table], "doc_id long, text string, lang string, source string, n_chars long, hash string, idx int, path string")
    got = merkle.verify(docs, merkle.chosen(F.col("doc_id")), {"n_chars": F.col("n_chars") + 1}, span).collect()
    fields = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    want = [(table[i][0], *v, v[4] == v[2]) for i, v in plain(table).items()]
    assert sorted(((r["doc_id"], *(r[f] for f in fields), r["verified"]) for r in got), key=str) == sorted(want, key=str)
    assert {r["verified"] for r in got} == {True, False}


def test_siblings_fold_to_the_root(spark, table):
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    manifest = merkle.build(merkle.rows(docs), 2)
    root = manifest.root.first()[0]
    leaves = {(r["tree"], r["idx"]): r["hash"] for r in manifest.by_tree.leaves.collect()}
    ways = manifest.siblings().collect()
    assert len(ways) == len(table) == len(leaves)
    assert {merkle.fold(leaves[r["tree"], r["idx"]], r["path"]) for r in ways} == {root}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    r = merkle.verify(one, F.lit(False), {}).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == h()
    assert merkle.verify(one.limit(0), F.lit(False), {}).count() == 0
