"""The corpus pipeline: stages over `documents`, each written and read again as the next one's input.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright import session
from gridwright.llm import bpe, common, decontaminate, langid, nearcopies, secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts, those without a letter, and those of which no learned language knows a
    quarter of the n-grams (documents of sf0.1 have 0.53 at least). A document whose lang is null gets the one that is found.
    The filter is learned from the documents whose id is not in the held-out bucket; where none of those has a language, nothing
    is known against any text with a letter, and all of them stay as they are."""
    model = langid.fit(docs.where(common.bucket_of("doc_id") != 2))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, model, least_known=0.25).where("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id. Near copies share four fifths of
    their five-word shingles or more. Documents without an id stay; of rows with equal ids all stay or none."""
    copies = nearcopies.near_copies(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(session.save(copies, "pipeline-copies"), "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go: those with a benchmark window whose hit words are a twentieth of all at least."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    with common.small_batches(spark):
        bad = session.save(found.where("contaminated").select("doc_id").distinct(), "pipeline-contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked in the text; n_chars follows. Copied examples stay, and so does every document."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of the ids and of what they decode to."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=4_000_000)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("bpe_tokens", tokens),
]

#: SQL has neither the filters, nor the fingerprints, nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
