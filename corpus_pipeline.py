"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Stages 1 to 4 return the columns of ``documents``; the last one returns the packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import language_id, line_dedup, ngram_join, packing, toxicity
from gridweave.llm.common import bounded_broadcast, read, settle, shared_dir

#: Documents whose language is less sure than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is scored as toxic go, each by its own text, whatever its id."""
    score = toxicity.score_column(toxicity.train(docs, read(spark, sf_dir, "labels")))
    return docs.where(score("text") < toxicity.THRESHOLD)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no letter or is of no clear language go, each by its own text."""
    found = language_id.language_column(language_id.train(docs))("text")
    return docs.where((found["lang"] != language_id.UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, and documents of which nothing but white space is left by that."""
    deleted = "_deleted_lines"
    while deleted in docs.columns:
        deleted += "_"
    out = line_dedup.line_dedup(docs, extend=True, deleted_col=deleted).where((F.col(deleted) == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col(deleted) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, row): rows whose id is their own, and the others, once each; ``row`` has all columns of ``docs``.

    The key is the id.  Rows without an id or with one that other rows have get a hash of id and text,
    far below zero; of rows that repeat both, one stays, which the text's sha256 decides.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    repeated = settle(base.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    repeated = bounded_broadcast(repeated, repeated.count())
    own = base.where("id is not null").join(repeated, "id", "left_anti").select(F.col("id").alias("key"), "row")
    others = base.where("id is null").unionByName(base.join(repeated, "id", "left_semi"))
    once = others.withColumn("sha", F.sha2(F.col("row").getField("text"), 256)).dropDuplicates(["id", "sha"])
    key = -F.lit(1 << 62) - F.pmod(F.xxhash64("id", "sha"), F.lit(1 << 62))
    return own, once.select(key.alias("key"), "row")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their runs of five words, the least id stays.

    Rows that have no id of their own are told apart by id and text; they come before others.
    """
    own, others = _keyed(docs)
    keyed = own.unionByName(others)
    texts = keyed.select("key", F.col("row").getField("text").alias("text"))
    gone = settle(ngram_join.components(texts, id_col="key").where("component_id != doc_id").select(F.col("doc_id").alias("key")))
    left = keyed.join(bounded_broadcast(gone, gone.count()), "key", "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: Trained models and shards by hash have no SQL form; tests hold the operators of the stages against brute force.
ORACLE_SQL = None
