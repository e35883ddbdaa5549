"""The registered queries opN_<name>, over their whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.llm import bpe, decontam, exact_dedup, html_extract, line_dedup, lm, ngram_join, pii, toxicity, url_filter
from verdanta.llm.cluster import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"))


@_query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op3_decontam(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.search(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.concat_ws(",", F.col("item_ids").cast("array<string>")).alias("item_ids"), "max_containment", "contaminated")


ORACLES["op3_decontam"] = decontam.ORACLE


@_query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract(table(spark, folder, "pages"))


@_query
def op6_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"))


@_query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


ORACLES["op7_line_dedup"] = line_dedup.ORACLE


@_query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


ORACLES["op8_url_filter"] = url_filter.ORACLE


@_query
def op9_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, folder, "documents")).drop("row_key")


ORACLES["op9_ngram_join"] = ngram_join.ORACLE


@_query
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


ORACLES["op10_exact_dedup"] = exact_dedup.ORACLE
