import math

import zstandard
from pyspark.sql import functions as F

from vellum.llm import compression_classifier as cc
from vellum.llm.queries import op2_compression_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op2_compression_quality(spark, SF).filter("held_out")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    r = got.join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"), F.count("*").alias("n")).first()
    assert r["n"] > 50 and r["acc"] >= 0.93


def test_against_plain_zstandard(spark):
    """Every text's score from plain compression calls with the fitted dictionaries and curve; a very long text among them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(~cc.held_out())
    model = cc.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows += [(10**6, "plain words and more " * 60_000), (10**6 + 1, None), (10**6 + 2, "é" * 1023 + "x")]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in cc.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, t in rows:
        data, sizes = (t or "").encode(), []
        for d in (model.good, model.bad):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(packer.compress(data[a : a + 1024])) for a in range(0, len(data), 1024)))
        x = (sizes[1] - sizes[0]) / sum(sizes) if data else 0.0
        p = 1 / (1 + math.exp(-max(-60.0, min(60.0, model.slope * x + model.bias))))
        assert abs(got[i][0] - p) < 1e-12 and got[i][1] == (got[i][0] >= 0.5)


def test_repeated_and_contradicting_labels(spark, docs_of):
    """A doc_id on many rows counts once, and one with both labels not at all."""
    rows = [(i, ("good plain words here " if i % 2 else "### $$$ *** ") * 200) for i in range(60)]
    labels = [(i, i % 2, 0) for i in range(60)]
    schema = "doc_id long, quality int, toxic int"
    plain = cc.fit(docs_of(rows), spark.createDataFrame(labels, schema))
    more = cc.fit(docs_of(rows + [rows[3]] * 50 + [(70, "### $$$ *** " * 50)]), spark.createDataFrame(labels + [(3, 1, 1)] * 9 + [(70, 1, 0), (70, 0, 0)], schema))
    assert (plain.good, plain.bad, plain.slope, plain.bias) == (more.good, more.bad, more.slope, more.bias)


def test_edges(spark, docs_of):
    docs = docs_of([(i, ("good plain words here " if i % 2 else "### $$$ *** ") * 200) for i in range(60)] + [(100, None), (101, ""), (None, "x"), (1, "again")])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = cc.fit(docs, labels)
    got = cc.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and 2 <= r["doc_id"] < 60)
    empty = [r["score"] for r in got if r["doc_id"] in (100, 101)]
    assert empty[0] == empty[1]
    kept = cc.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id between 2 and 59").count() == 29
    assert cc.score(docs, cc.fit(docs, labels.filter("quality = 1"))).filter("predicted = 0").count() == 0
    assert cc.score(docs.limit(0), cc.fit(docs.limit(0), labels.limit(0))).count() == 0
