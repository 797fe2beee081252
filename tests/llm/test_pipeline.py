"""The corpus pipeline, stage by stage, against plain Python on the smallest supplied tables."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SF = "/root/testdata/sf0.001"
AZ = {c: c + 32 for c in range(65, 91)}


def deduped(docs):
    key = lambda x: x.strip(" \t\n\v\f\r").translate(AZ)
    held = {}
    for i, t in docs.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    return {i: "\n".join(x for x in t.split("\n") if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i) for i, t in docs.items()}


def firsts(docs):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(AZ))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    comp = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if comp[a] < comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[b], changed = comp[a], True
    return {i: t for i, t in docs.items() if comp[i] == i}


def test_stages(spark, tmp_path):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = dict(kept["quality"])
    assert all(before[i] == t for i, t in good.items())
    right = [(i in good) == bool(q) for i, q in labels.items() if i in before]
    assert np.mean(right) >= 0.9
    assert dict(kept["line_dedup"]) == deduped(good)
    assert dict(kept["near_copies"]) == firsts(dict(kept["line_dedup"]))
    copies = Counter(i for i, _ in kept["mixing"])
    assert max(copies.values()) <= 3 and set(copies) <= {i for i, _ in kept["near_copies"]}
    words = {i: len(t.split()) for i, t in kept["near_copies"]}
    assert abs(sum(n * words[i] for i, n in copies.items()) / sum(words.values()) - 1) < 0.1
    t, n = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text in kept["mixing"]:
        n[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    assert {r["doc_id"]: r["sum(length)"] for r in docs.groupBy("doc_id").sum("length").collect()} == dict(n)


def test_empty_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30).selectExpr("doc_id", "if(doc_id % 3 = 0, null, if(doc_id % 3 = 1, '', text)) AS text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    docs.collect()
