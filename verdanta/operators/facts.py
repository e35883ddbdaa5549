"""Facts of filings: bound to their contexts, file-level names and years, and the idempotent warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import contains_any, financial_year, strip

#: Columns of the stored facts, all text, in the stored order.
FACT_COLUMNS = "concept namespace value context_ref unit_ref decimals normalized_value value_type category company_name report_year source_file period_type start_date end_date instant_date dimensions_json".split()
KEYS = ["company_name", "report_year"]


def period_type(instant, start, end):
    """instant where the context has one, else duration."""
    return F.when(instant.isNotNull(), "instant").otherwise("duration")


def last_contexts(contexts: DataFrame) -> DataFrame:
    """One context for each (source_file, context_id): of repeated ids the last one."""
    others = [c for c in contexts.columns if c not in ("source_file", "context_id")]
    return contexts.groupBy("source_file", "context_id").agg(F.max_by(F.struct(*others), "pos").alias("c")).select("source_file", "context_id", *[f"c.{x}" for x in others if x != "pos"])


def bind_contexts(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """Facts with the period and dimensions of their context; without one, nulls and no dimensions."""
    c = contexts.select("source_file", F.col("context_id").alias("context_ref"), "period_type", "start_date", "end_date", "instant_date", F.to_json("dimensions").alias("_dims"))
    return facts.join(c, ["source_file", "context_ref"], "left").withColumn("dimensions_json", F.coalesce("_dims", F.lit("{}"))).drop("_dims")


def company_names(facts: DataFrame) -> DataFrame:
    """(source_file, company_name): the first fact in document order that names it, else the folder, else unknown."""
    v, concept = strip(F.coalesce("value", F.lit(""))), F.lower("concept")
    named = F.col("concept").isin(V.COMPANY_CONCEPTS) & ~v.isin(V.COMPANY_MISSING)
    like = concept.contains("name") & contains_any(concept, ["company", "entity", "listed"]) & (v != "") & (F.length(v) < 150) & contains_any(F.lower(v), V.COMPANY_WORDS)
    first = lambda test: F.min_by(F.when(test, v), F.when(test, F.col("pos")))
    found = facts.groupBy("source_file").agg(first(named).alias("a"), first(like).alias("b"))
    parts = F.split("source_file", "/")
    folder = F.when(F.size(parts) >= 3, F.element_at(parts, F.greatest(F.size(parts) - 2, F.lit(1))))
    folder = F.when(~folder.isin(V.COMPANY_FOLDERS_SKIPPED) & (folder != ""), strip(F.replace(folder, F.lit("_"), F.lit(" "))))
    return found.select("source_file", F.coalesce("a", "b", folder, F.lit("Unknown Company")).alias("company_name"))


def report_years(facts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(source_file, report_year): from a fact, else the main context, else the last ending duration, else the file's name."""
    v, concept = strip(F.coalesce("value", F.lit(""))), F.lower("concept")
    says = contains_any(concept, ["financialyear", "reportingperiod"]) & (F.length(v) < 20) & v.rlike(r"\d{4}")
    a = facts.groupBy("source_file").agg(F.min_by(F.when(says, v), F.when(says, F.col("pos"))).alias("a"))
    both = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    main = both & (F.col("context_id") == V.MAIN_CONTEXT)
    span = both & (F.col("period_type") == "duration") & F.col("start_date").rlike(r"^\d{4}(-|$)") & F.col("end_date").rlike(r"^\d{4}(-|$)")
    label = financial_year(F.col("start_date"), F.col("end_date"))
    b = contexts.groupBy("source_file").agg(F.max(F.when(main, label)).alias("b"), F.max_by(F.when(span, label), F.when(span, F.struct("end_date", "start_date"))).alias("c"))
    name = F.element_at(F.split("source_file", "/"), -1)
    file_year = F.nullif(F.regexp_extract(name, r"(FY\d{4}-\d{2}(?!\d)|\d{4}-\d{4}|\d{4}-\d{2})", 1), F.lit(""))
    return a.join(b, "source_file", "left").select("source_file", F.coalesce("a", "b", "c", file_year, F.lit("FYUnknown")).alias("report_year"))


def report_counts(facts: DataFrame, contexts: DataFrame, units: DataFrame) -> DataFrame:
    """(source_file, context_count, unit_count, fact_count)."""
    kinds = [(contexts, "context_count"), (units, "unit_count"), (facts, "fact_count")]
    rows = None
    for df, name in kinds:
        part = df.select("source_file", *[F.lit(int(n == name)).alias(n) for _, n in kinds])
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source_file").agg(*[F.sum(n).alias(n) for _, n in kinds])


def replace_keys(stored: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``stored`` with the rows of every key that ``new`` has replaced by those of ``new``."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files (path, hash, ...) that the ledger doesn't have with the same content."""
    return files.join(ledger.select("path", "hash"), ["path", "hash"], "left_anti")
