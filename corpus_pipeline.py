"""Raw documents to packed token sequences, in stages that each write their result for the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsift.llm import jaccard, langid, packing, rules, secret_scan
from oddsift.llm.base import crc_of, small_batches, spare_name
from oddsift.session import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: null texts, texts without a letter, and undecided ones.

    Rows that repeat are judged alike; a null id is not learned from. An empty table stays empty.
    """
    small_batches(spark)
    usable = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(3)) != 1, F.lit(False))
    return langid.keep(docs, langid.train(docs, usable, PIECES))


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie far from every language reference; a null text has no words and
    fails. Rows that repeat are judged alike. An empty table stays empty."""
    small_batches(spark)
    return rules.keep(docs, rules.references(docs))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that five-word shingles at a similarity of 0.8 link: the least id, null last.

    Rows are told apart by a 64-bit hash of id and text, so rows that share an id, or have none, are judged each by its
    own text. Of equal rows one stays; rows without shingles all stay. An empty table stays empty.
    """
    small_batches(spark)
    key = spare_name(docs.columns, "row_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    groups = materialize(jaccard.group(keyed, width=5, num=80, den=100, doc_id=key), "groups").where("n_shingles > 0")
    ids = keyed.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("own")).distinct()
    first = F.min(F.struct(F.col("own").isNull(), "own", "doc_id")).alias("first")
    found = groups.select("doc_id", "component_id").distinct().join(ids, "doc_id")
    chosen = found.groupBy("component_id").agg(first).select(F.col("first.doc_id").alias("doc_id"))
    gone = found.join(chosen, "doc_id", "left_anti").select(F.col("doc_id").alias(key)).distinct()
    kept = keyed.join(gone, key, "left_anti")
    twice = groups.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if not twice.isEmpty():
        kept = kept.join(twice, key, "left_anti").unionByName(kept.join(twice, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret in the texts and counts ``n_chars`` anew; all documents stay, also repeated ones and those
    with a null text. An empty table stays empty."""
    spans, base = spare_name(docs.columns, "spans"), spare_name(docs.columns, "base_spans")
    masked = secret_scan.redact(docs, secret_scan.pair_ratios(secret_scan.labelled_strings(spark, docs)), "text", spans, base)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document, packed into sequences of at most 2048 tokens.

    A null text has only the end id; repeated rows are packed each. An empty table gives no pieces.
    """
    small_batches(spark)
    return packing.pack_texts(docs, WORD_BPE, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_rules", rules_stage),
    ("ngram_jaccard", jaccard_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: language scores and packing are beyond SQL; tests hold the Jaccard stage and the tokens packed against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
