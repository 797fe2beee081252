import hashlib
import re
from collections import Counter

import numpy as np

from vellum.llm import fingerprint as fp


def words(t):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", t) if w)


def jaccard(a, b):
    a, b = words(a), words(b)
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_gamma_quantiles():
    x = fp.gamma2_quantile(np.array([0.1, 0.5, 0.9]))
    assert np.allclose(1 - (1 + x) * np.exp(-x), [0.1, 0.5, 0.9])


def test_edges_and_edits(spark, docs_of):
    long = " ".join(f"w{i % 97}" for i in range(20000))
    rows = [(5, "a b c d"), (1, None), (3, ""), (9, "a b c d"), (7, "é ü 😀 x"), (12, long), (None, "n u l l")]
    got = {r["doc_id"]: r for r in fp.fingerprints(docs_of(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted((k, t or "") for k, t, *_ in rows if k is not None) + [(None, "n u l l")]
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        r = got[k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1
    assert got[5]["fingerprint"] == got[9]["fingerprint"] and got[1]["fingerprint"] == got[3]["fingerprint"] == "ffff" * fp.SAMPLES
    assert got[1]["near_next"] == 1.0 and got[3]["near_next"] == 0.0


def test_repeats_and_empty_table(spark, docs_of):
    got = fp.fingerprints(docs_of([(1, "a b"), (1, "a b"), (1, "c d")])).collect()
    assert len(got) == 3 and len({r["fingerprint"] for r in got}) == 2
    assert fp.fingerprints(docs_of([(1, "x")]).limit(0)).count() == 0
    assert fp.fingerprints(docs_of([(1, "only one here")])).first()["near_next"] == 1.0


def test_collision_rate_is_the_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    text = dict(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    ids = list(text)
    err, var = [], []
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[a]) // 2
        for near, other in ((got[a]["near_edited"], text[a][: len(text[a]) - half] + text[b][:half]), (got[a]["near_next"], text[b])):
            j = jaccard(text[a], other)
            err.append(near - j)
            var.append(j * (1 - j) / fp.SAMPLES)
    assert abs(np.mean(err)) < 0.02 and np.mean(np.square(err)) < 1.5 * np.mean(var) + 1e-4
