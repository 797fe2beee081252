"""The queries of the training-data operators: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import compression_classifier, cover_tree, fingerprint, gated_lm, importance, jaccard_join, line_dedup, merkle, mixing, oracles, packing, secret_scan, url_filter, warc
from vellum.llm.common import load, sha256_utf8


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(load(spark, sf_dir, "documents"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").filter(~compression_classifier.held_out())
    model = compression_classifier.fit(docs, labels)
    out = compression_classifier.score(docs, model)
    return out.select("doc_id", compression_classifier.held_out().alias("held_out"), "score", "predicted")


def op3_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(load(spark, sf_dir, "embeddings"))


def op4_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(load(spark, sf_dir, "documents"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(load(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(load(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = line_dedup.LineIndex.build(docs).report(docs)
    return out.select("doc_id", "n_lines", "n_dropped", sha256_utf8(F.col("kept_text")).alias("kept_sha256"))


def op9_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path())


def op10_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(load(spark, sf_dir, "documents"))


def op11_suffix_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return merkle.verify(docs, merkle.chosen(F.col("doc_id")), {"n_chars": F.col("n_chars") + 1})


def op13_gated_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(load(spark, sf_dir, "documents"))


QUERIES = {
    "op1_weighted_fingerprints": op1_weighted_fingerprints,
    "op2_compression_quality": op2_compression_quality,
    "op3_cover_tree_dedup": op3_cover_tree_dedup,
    "op4_trigram_secrets": op4_trigram_secrets,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_url_cascade": op7_url_cascade,
    "op8_line_dedup": op8_line_dedup,
    "op9_binary_packing": op9_binary_packing,
    "op10_partenum_jaccard": op10_partenum_jaccard,
    "op11_suffix_resampling": op11_suffix_resampling,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_gated_lm_scores": op13_gated_lm_scores,
}

ORACLES: dict[str, str] = {
    "op3_cover_tree_dedup": oracles.OP3,
    "op4_trigram_secrets": oracles.op4(secret_scan.BASE + secret_scan.ADDED, len(secret_scan.BASE)),
    "op5_warc_round_trip": oracles.OP5,
    "op6_pareto_mixing": oracles.OP6,
    "op7_url_cascade": oracles.op7(url_filter.RULES, url_filter.LISTED_BELOW),
    "op8_line_dedup": oracles.OP8,
    "op10_partenum_jaccard": oracles.OP10,
    "op11_suffix_resampling": oracles.op11(importance.BUCKETS, 5, importance.LEAST_WORDS, 42),
    "op12_merkle_manifest": oracles.op12(),
}
