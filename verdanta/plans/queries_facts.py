"""Queries over facts: values, categories, validation, contexts, warehouse, names and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import category, normalize
from verdanta.operators import facts as ops
from verdanta.operators import validate as checks
from verdanta.plans import inputs as I
from verdanta.plans.registry import query


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def category_sql(column: str) -> str:
    low = f"lower({column})"
    return f"case when {_any(low, V.ENVIRONMENTAL)} then 'Environmental' when {_any(low, V.SOCIAL)} then 'Social' when {_any(low, V.GOVERNANCE)} then 'Governance' else 'Other' end"


NUM = r"^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?$"
#: Typed facts as SQL: v the stripped value, number without commas, kind, num.
TYPED = f"""
typed as (
  select f.*, trim(f.value) as v, replace(trim(f.value), ',', '') as number,
    case when trim(f.value) = '' or trim(f.value) in ({_list(V.MISSING)}) then 'missing'
         when lower(trim(f.value)) in ({_list(V.YES)}) then 'yes' when lower(trim(f.value)) in ({_list(V.NO)}) then 'no'
         when regexp_matches(trim(f.value), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') then 'iso' when regexp_matches(trim(f.value), '^\\d{{2}}-\\d{{2}}-\\d{{4}}$') then 'day'
         when regexp_matches(replace(trim(f.value), ',', ''), '{NUM}') then 'number' else 'text' end as shape
  from ({I.duck(I.FACTS)}) f
), facts as (
  select *,
    case shape when 'missing' then 'text' when 'yes' then 'boolean' when 'no' then 'boolean' when 'iso' then 'date' when 'day' then 'date'
      when 'number' then case when contains(lower(concept), 'percentage') or contains(lower(concept), 'rate') or coalesce(unit_ref, '') = 'pure' then 'percentage' else 'numeric' end else 'text' end as value_type,
    case when shape = 'number' then cast(number as double) end as num,
    {category_sql('concept')} as category
  from typed
)
"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    return I.run(spark, folder, I.FACTS)


def named_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Typed facts with a company and a year, as the warehouse has them."""
    f = normalize(facts(spark, folder))
    return f.withColumns({"company_name": F.col("company"), "report_year": F.concat(F.year("stamp").cast("string"), F.lit("-04-01")), "dimensions_json": F.lit("{}")})


NAMED = TYPED + ", named as (select *, company as company_name, cast(year(stamp) as varchar) || '-04-01' as report_year from facts)"


@query("facts_by_category", f"with {TYPED} select category, count(*) as n from facts group by category")
def facts_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).groupBy(category(F.col("concept")).alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")


@query("facts_by_entity", "select c_name as entity, count(*) as n from orders join customer on o_custkey = c_custkey group by c_name")
def facts_by_entity(spark: SparkSession, folder: str) -> DataFrame:
    return facts(spark, folder).groupBy(F.col("company").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query("documents_by_category", f"select {category_sql('text')} as category, count(*) as n from documents where text is not null group by 1")
def documents_by_category(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null")
    return docs.groupBy(category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("filtered_sample", f"with {TYPED} select pos, concept, v as value from facts where contains(concept, 'Emissions') and unit_ref = 'INR' and num is not null order by pos limit 5")
def filtered_sample(spark: SparkSession, folder: str) -> DataFrame:
    f = normalize(facts(spark, folder)).where(F.col("concept").contains("Emissions") & (F.col("unit_ref") == "INR") & F.col("num_value").isNotNull())
    return f.orderBy("pos").limit(5).select("pos", "concept", F.btrim("value").alias("value"))


@query("in_list_projection", f"with {TYPED} select concept, v as value, unit_ref, source_file, pos from facts where concept in ({_list(list(V.SOURCE_TAGS))})")
def in_list_projection(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder).where(F.col("concept").isin(list(V.SOURCE_TAGS)))
    return f.select("concept", F.btrim("value").alias("value"), "unit_ref", "source_file", "pos")


@query(
    "normalize_values",
    f"""with {TYPED} select pos, value_type, round(num, 6) as num, shape = 'yes' as is_yes,
      case shape when 'missing' then null when 'yes' then 'True' when 'no' then 'False' when 'iso' then v when 'day' then v[7:10] || '-' || v[4:5] || '-' || v[1:2]
        when 'number' then case when not regexp_matches(number, '[.eE]') then cast(cast(number as bigint) as varchar)
          when num >= 1e16 then regexp_replace(printf('%.0e', num / 1.5), '.*', '1.5') || 'e+' || cast(cast(floor(log10(num)) as int) as varchar)
          else cast(cast(num as decimal(38, 1)) as varchar) end else v end as normalized_value,
      category from facts""",
)
def normalize_values(spark: SparkSession, folder: str) -> DataFrame:
    f = normalize(facts(spark, folder))
    return f.select("pos", "value_type", F.round("num_value", 6).alias("num"), F.coalesce("bool_value", F.lit(False)).alias("is_yes"), "normalized_value", "category")


_CHECKS = """
checked as (
  select *, (value_type = 'percentage' and num < 0) as neg_pct, (value_type = 'percentage' and num > 100) as big_pct,
    (num < 0 and (contains(lower(concept), 'numberof') or contains(lower(concept), 'amountof') or contains(lower(concept), 'costof') or contains(lower(concept), 'quantityof')
      or contains(lower(concept), 'turnover') or contains(lower(concept), 'spent'))) as neg_count
  from facts
)"""


@query("validate_facts", f"with {TYPED}, {_CHECKS} select pos, true as is_valid, coalesce(neg_pct, false)::int + coalesce(big_pct, false)::int + coalesce(neg_count, false)::int as n_warnings from checked")
def validate_facts(spark: SparkSession, folder: str) -> DataFrame:
    return checks.validate(normalize(facts(spark, folder))).select("pos", "is_valid", "n_warnings")


@query("validation_summary", f"with {TYPED}, {_CHECKS} select count(*) as facts, 0::bigint as errors, sum(coalesce(neg_pct, false)::int + coalesce(big_pct, false)::int + coalesce(neg_count, false)::int)::bigint as warnings from checked")
def validation_summary(spark: SparkSession, folder: str) -> DataFrame:
    return checks.summary(checks.validate(normalize(facts(spark, folder))))


_CONTEXTS = I.duck(I.CONTEXTS, facts=I.duck(I.FACTS))


def contexts(spark: SparkSession, folder: str) -> DataFrame:
    return I.run(spark, folder, I.CONTEXTS, facts=I.FACTS).withColumn("dimensions", F.create_map(F.lit("k"), F.col("pos").cast("string")))


@query(
    "fact_context_left_join",
    f"""with {TYPED}, c as (select * from ({_CONTEXTS}) x qualify row_number() over (partition by source_file, context_id order by pos desc) = 1)
      select f.pos, f.context_ref, c.period_type, c.start_date, c.end_date, c.instant_date, coalesce('{{"k":"' || cast(c.pos as varchar) || '"}}', '{{}}') as dimensions_json
      from facts f left join c on f.source_file = c.source_file and f.context_ref = c.context_id""",
)
def fact_context_left_join(spark: SparkSession, folder: str) -> DataFrame:
    bound = ops.bind_contexts(facts(spark, folder), ops.last_contexts(contexts(spark, folder)))
    return bound.select("pos", "context_ref", "period_type", "start_date", "end_date", "instant_date", "dimensions_json")


@query(
    "upsert_replace_keys",
    """with o as (select o_orderstatus as k, year(o_orderdate) as y, o_orderkey as id from orders),
      old as (select *, 'old' as version from o where id % 2 = 0), new as (select *, 'new' as version from o where id % 5 = 1 and y % 2 = 0)
      select k, y, version, count(*) as n, sum(id)::bigint as ids from
        (select * from old where not exists (select 1 from new where new.k = old.k and new.y = old.y) union all select * from new) group by k, y, version""",
)
def upsert_replace_keys(spark: SparkSession, folder: str) -> DataFrame:
    o = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderstatus").alias("k"), F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderkey").alias("id"))
    old, new = o.where("id % 2 = 0").withColumn("version", F.lit("old")), o.where("id % 5 = 1 and y % 2 = 0").withColumn("version", F.lit("new"))
    return ops.replace_keys(old, new, ["k", "y"]).groupBy("k", "y", "version").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(
    "unprocessed_files_anti",
    """with f as (select cast(doc_id as varchar) as path, md5(coalesce(text, '')) as hash from documents),
      l as (select cast(d.doc_id as varchar) as path, md5(case when d.doc_id % 7 = 0 then 'changed' else coalesce(d.text, '') end) as hash from documents d join labels using (doc_id))
      select path, hash from f where not exists (select 1 from l where l.path = f.path and l.hash = f.hash)""",
)
def unprocessed_files_anti(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))
    done = docs.join(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id"), "doc_id")
    return ops.unprocessed(files, done.select(F.col("doc_id").cast("string").alias("path"), F.md5(F.when(F.col("doc_id") % 7 == 0, F.lit("changed")).otherwise(F.col("text"))).alias("hash")))


@query(
    "company_first_match",
    f"""with {TYPED}, a as (
        select source_file, arg_min(v, pos) filter (concept in ({_list(V.COMPANY_CONCEPTS)}) and v not in ({_list(V.COMPANY_MISSING)})) as a,
          arg_min(v, pos) filter (contains(lower(concept), 'name') and {_any('lower(concept)', ['company', 'entity', 'listed'])} and v <> '' and length(v) < 150 and {_any('lower(v)', V.COMPANY_WORDS)}) as b
        from facts group by source_file)
      select source_file, coalesce(a, b, replace(string_split(source_file, '/')[2], '_', ' ')) as company_name from a""",
)
def company_first_match(spark: SparkSession, folder: str) -> DataFrame:
    return ops.company_names(facts(spark, folder))


@query(
    "report_year_resolve",
    f"""with {TYPED}, f as (select source_file, arg_min(v, pos) filter ({_any('lower(concept)', ['financialyear', 'reportingperiod'])} and length(v) < 20 and regexp_matches(v, '\\d{{4}}') and pos % 3 = 0) as a from facts group by source_file),
      c as (select source_file, arg_max(start_date[1:4] || '-' || end_date[3:4], end_date || start_date) filter (period_type = 'duration') as c from (select * from ({_CONTEXTS}) x qualify row_number() over (partition by source_file, context_id order by pos desc) = 1) group by source_file)
      select f.source_file, coalesce(f.a, c.c, 'FYUnknown') as report_year from f left join c using (source_file)""",
)
def report_year_resolve(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder)
    f = f.withColumn("concept", F.when((F.col("concept") == "ReportingPeriodLabel") & (F.col("pos") % 3 != 0), "Other").otherwise(F.col("concept")))
    return ops.report_years(f, ops.last_contexts(contexts(spark, folder)).withColumn("pos", F.lit(0)))


@query(
    "report_counts",
    f"""with f as (select source_file, count(*) as n from ({I.duck(I.FACTS)}) group by 1), c as (select source_file, count(*) as n from ({_CONTEXTS}) group by 1)
      select source_file, coalesce(c.n, 0)::bigint as context_count, 0::bigint as unit_count, coalesce(f.n, 0)::bigint as fact_count from f full join c using (source_file)""",
)
def report_counts(spark: SparkSession, folder: str) -> DataFrame:
    f = facts(spark, folder)
    return ops.report_counts(f, contexts(spark, folder), f.limit(0))


@query("processing_totals", "select count(*) filter (o_orderstatus = 'F') as success, count(*) filter (o_orderstatus = 'O') as skipped, count(*) filter (o_orderstatus not in ('F', 'O')) as failed from orders")
def processing_totals(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("o_orderstatus")
    o = spark.read.parquet(f"{folder}/orders.parquet")
    return o.agg(F.count_if(s == "F").alias("success"), F.count_if(s == "O").alias("skipped"), F.count_if(~s.isin("F", "O")).alias("failed"))


@query("event_windows", "select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: tumbling windows over events."""
    from verdanta.streaming.ingest import event_counts

    return event_counts(spark.read.parquet(f"{folder}/events.parquet")).withColumn("total", F.round("total", 4))
