"""Corpus pipeline: quality, repeated lines, near copies, mixing, packing; each stage calls one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import compression_classifier, jaccard_join, line_dedup, mixing, packing
from vellum.llm.common import load
from vellum.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    labels = load(spark, sf_dir, "labels").filter(~compression_classifier.held_out())
    return compression_classifier.keep_good(docs, compression_classifier.fit(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without the lines that five or more of them repeat, but for one of each."""
    return line_dedup.dedup(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies."""
    return jaccard_join.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; rows that repeat a doc_id take the least of their draws."""
    drawn = mixing.mix(docs.select("doc_id", "source", "text")).groupBy("doc_id").agg(F.min("copies").alias("n"))
    drawn = drawn.filter("n > 0").select(F.col("doc_id").alias("__doc"), F.sequence(F.lit(1), F.col("n").cast("int")).alias("__times"))
    out = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("__doc")))
    return out.withColumn("__time", F.explode("__times")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("mixing", mix), ("packing", pack)]

#: Compression sizes, fitted models and token ids have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
