"""Queries over the text tables, one for each operator, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, fingerprints, language_id, license_scan, line_dedup, merkle, ngram_join, packing, sharding, token_counts, toxicity
from .common import read


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; the files are the environment's, not this repository's."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests=True)


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.language_ids(docs, language_id.train(docs))


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(read(spark, sf_dir, "documents"), words=3, num=90, den=100)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents"), extend=True)
    return out.select("doc_id", F.col("_deleted_lines").alias("deleted_lines"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text")


def phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(read(spark, sf_dir, "documents"))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read(spark, sf_dir, "documents"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_tree_concat": bpe_roundtrip,
        "op2_license_scan": licenses,
        "op3_language_id": language,
        "op4_ngram_jaccard_join": ngram_jaccard,
        "op5_line_dedup": lines,
        "op6_phrase_fingerprints": phrase_fingerprints,
        "op7_best_fit_packing": pack,
        "op8_exact_dedup": dedup,
        "op9_toxicity": toxic,
        "op10_token_counts": counts,
        "op11_filter_audit": audit,
        "op12_merkle_manifest": manifest,
        "op13_label_sharding": shards,
    }


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan.oracle_sql(),
        "op11_filter_audit": filter_audit.oracle_sql(),
        "op12_merkle_manifest": merkle.oracle_sql(),
        "op8_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256({LOW}) AS text_sha256 FROM documents) WINDOW w AS (PARTITION BY text_sha256)""",
    }
