"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all rows and whole texts that
the stage before kept, and returns the columns of ``documents``; the last one
returns the encoded documents.

Defined results: a null or empty text has nothing to reject and stays; rows equal
in doc_id and text stay or go together; a null doc_id counts as the largest;
extra columns of any name come through unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.llm import bpe, decontam, line_dedup, ngram_join, toxicity
from verdanta.llm.cluster import checkpoint_dir, deleted, free_name, table


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with other names for columns that are called like an operator's own."""
    taken = {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in taken:
            docs = docs.withColumnRenamed(c, free_name(docs, f"_own_{c}"))
    return docs


def _columns(rows: DataFrame, kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns ``kept`` of ``rows``, called as in ``docs``."""
    return rows.select(*[F.col(f"`{k}`").alias(c) for k, c in zip(kept.columns, docs.columns)])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay; the model learns from those that ``labels`` marks."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity_score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that came earlier; n_chars follows the text."""
    kept = _aside(docs, "n_lines", "n_dropped")
    out = _columns(line_dedup.dedup_lines(kept), kept, docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay."""
    kept = _aside(docs, "item_ids", "max_containment", "contaminated")
    return _columns(decontam.search(kept, table(spark, sf_dir, "benchmark")).where("not contaminated"), kept, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained classifier is a stage, so SQL can't express the rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the table ``documents``; what a stage wrote is deleted once the next one has read it."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            deleted(spark, f"{folder}/{before}")
        before = name
    return docs
