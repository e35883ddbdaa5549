"""Queries over document layout: headings, trees, tables, boxes, trees of disclosures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.operators import segment
from verdanta.plans import inputs as I
from verdanta.plans.registry import query

_P = dict(V.HEADINGS)
_G = dict(V.STANDARD_HEADINGS)


def _m(pattern: str, column: str = "t") -> str:
    return f"regexp_matches({column}, '{pattern}')"


_FONT = "case when is_bold and avg_font_size >= 16 then 1 when is_bold and avg_font_size >= 13 then 2 when is_bold and avg_font_size >= 11 then 3 when is_bold and line_count <= 2 and length(text) < 120 then 4 else 0 end"
CLASSIFIED = f"""
blocks as (select *, trim(text) as t from ({I.duck(I.BLOCKS)}) b),
levels as (select *, {_FONT} as font from blocks),
classified as (
  select *, case when t = '' then '' when {_m(_P['section'])} then 'section' when {_m(_P['principle'])} then 'principle' when {_m(_P['essential'])} then 'essential' when {_m(_P['leadership'])} then 'leadership'
      when {_m(_P['section_field'])} and length(t) < 100 then 'section_field' when {_m(_P['question'])} and length(t) > 20 then 'question' when font > 0 then 'font_based' else '' end as heading_type,
    row_number() over (partition by doc order by page_num, y0, x0, seq, t) as pos
  from levels
)"""


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered, classified blocks; the text breaks ties of equal places, the fonts those of equal texts."""
    return segment.in_order(segment.classify(I.run(spark, folder, I.BLOCKS)))


@query(
    "heading_classify",
    f"""with {CLASSIFIED} select doc, pos, heading_type,
      case heading_type when '' then 0 when 'section' then 1 when 'principle' then 2 when 'essential' then 3 when 'leadership' then 3 when 'section_field' then 3 when 'question' then 4 else font end as heading_level,
      case heading_type when '' then '' when 'section' then trim(left(t, 30)) when 'principle' then 'Principle' || regexp_extract(t, '{_P['principle']}', 1) when 'essential' then 'Essential Indicators' when 'leadership' then 'Leadership Indicators'
        when 'section_field' then trim(left(t, 60)) when 'question' then 'Q' || regexp_extract(t, '{_P['question']}', 1) else left(t, 80) end as heading_label from classified""",
)
def heading_classify(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("doc", "pos", "heading_type", "heading_level", "heading_label")


@query(
    "standard_headings",
    f"""with x as (select n_nationkey as k, cast(1 + n_nationkey % 5 as int) as page_num, case cast(n_nationkey % 6 as int) when 0 then 'GRI 30' || n_nationkey % 9 || ': Water ' || n_name when 1 then 'Disclosure 303-' || n_nationkey || ' ' || n_name
        when 2 then 'REQUIREMENTS for ' || n_name when 3 then '1. Topic management disclosures' when 4 then 'Topic 11.' || n_nationkey || ' of ' || n_name else n_name || ' text' end as t from nation)
      select k, case when {_m(_G['gri_standard'])} and page_num <= 3 then 'gri_standard' when {_m(_G['gri_disclosure'])} then 'gri_disclosure' when {_m(_G['gri_subsection'])} then 'gri_subsection' when {_m(_G['gri_topic'])} then 'gri_topic' else '' end as heading_type from x""",
)
def standard_headings(spark: SparkSession, folder: str) -> DataFrame:
    n, k = spark.read.parquet(f"{folder}/nation.parquet"), F.col("n_nationkey")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("GRI 30"), (k % 9).cast("string"), F.lit(": Water "), "n_name"))
        .when(k % 6 == 1, F.concat(F.lit("Disclosure 303-"), k.cast("string"), F.lit(" "), "n_name"))
        .when(k % 6 == 2, F.concat(F.lit("REQUIREMENTS for "), "n_name"))
        .when(k % 6 == 3, "1. Topic management disclosures")
        .when(k % 6 == 4, F.concat(F.lit("Topic 11."), k.cast("string"), F.lit(" of "), "n_name"))
        .otherwise(F.concat("n_name", F.lit(" text")))
    )
    b = n.select(k.alias("k"), (1 + k % 5).cast("int").alias("page_num"), text.alias("text"), F.lit(9.0).alias("avg_font_size"), F.lit(False).alias("is_bold"), F.lit(1).alias("line_count"))
    return segment.classify(b, standards=True).select("k", "heading_type")


def _run(test: str) -> str:
    return f"coalesce(max(case when {test} then pos end) over w, -1)"


OWNED = (
    CLASSIFIED
    + f"""
, marked as (
  select *, {_run("heading_type = 'section'")} as s, {_run(f"heading_type = 'principle' and regexp_extract(t, '{_P['principle']}', 1) = '6'")} as p, {_run(f"heading_type = 'principle' and regexp_extract(t, '{_P['principle']}', 1) <> '6'")} as x,
    {_run("heading_type in ('essential', 'leadership')")} as g, {_run("heading_type = 'question'")} as q
  from classified window w as (partition by doc order by pos rows between unbounded preceding and current row)
), owned as (
  select *, x >= 0 and x = greatest(s, p, x) as skipped,
    case when q > greatest(s, p, x) and q > g then q when g > greatest(s, p, x) then g when p >= 0 and p > s and p > x then p else s end as owner
  from marked
)"""
)


@query(
    "segment_tree",
    f"with {OWNED} select doc, pos, owner, skipped, case when owner = -1 then 'document' when owner = q then 'question' when owner = g then 'group' when owner = p then 'principle' else 'section' end as owner_kind from owned",
)
def segment_tree(spark: SparkSession, folder: str) -> DataFrame:
    return segment.report_owners(blocks(spark, folder)).select("doc", "pos", "owner", "skipped", "owner_kind")


@query(
    "owned_content",
    f"with {OWNED} select doc, owner, min(page_num) as page_start, max(page_num) as page_end, count(*) as n_blocks, md5(string_agg(text, '|' order by pos)) as content from owned where heading_type = '' and not skipped group by doc, owner",
)
def owned_content(spark: SparkSession, folder: str) -> DataFrame:
    out = segment.owned_text(segment.report_owners(blocks(spark, folder)))
    return out.select("doc", "owner", "page_start", "page_end", "n_blocks", F.md5(F.array_join("content", "|")).alias("content"))


@query(
    "page_end_rollup",
    f"""with {CLASSIFIED}, x as (select *, {_run("heading_type = 'section'")} as section from classified window w as (partition by doc order by pos rows between unbounded preceding and current row))
      select doc, section, min(page_num) as page_start, max(page_num) as page_end, count(*) filter (heading_type <> '') as n_headings from x group by doc, section""",
)
def page_end_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return segment.section_pages(blocks(spark, folder))


@query(
    "standard_tree",
    f"""with {CLASSIFIED}, k as (select doc, pos, case when heading_type = 'section' then 'gri_standard' when heading_type = 'principle' then 'gri_disclosure' when heading_type in ('essential', 'leadership') then 'gri_subsection' else '' end as h from classified),
      m as (select *, {_run("h = 'gri_standard'")} as s, {_run("h = 'gri_disclosure'")} as d, {_run("h = 'gri_subsection'")} as r from k window w as (partition by doc order by pos rows between unbounded preceding and current row))
      select doc, pos, case when r > d and r > s then r when d > s then d else s end as owner from m""",
)
def standard_tree(spark: SparkSession, folder: str) -> DataFrame:
    h = F.col("heading_type")
    b = blocks(spark, folder).withColumn("heading_type", F.when(h == "section", "gri_standard").when(h == "principle", "gri_disclosure").when(h.isin("essential", "leadership"), "gri_subsection").otherwise(""))
    return segment.standard_owners(b).select("doc", "pos", "owner")


@query("reading_order", f"with {CLASSIFIED} select doc, pos, text from classified")
def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    return blocks(spark, folder).select("doc", "pos", "text")


@query("heading_list", f"with {CLASSIFIED} select doc, pos, heading_type, text from classified where heading_type <> ''")
def heading_list(spark: SparkSession, folder: str) -> DataFrame:
    return segment.headings(blocks(spark, folder)).select("doc", "pos", "heading_type", "text")


@query(
    "span_blocks",
    """with s as (select 'd' || l_orderkey % 20 as doc, cast(l_linenumber as int) as page_num, l_suppkey as block, l_orderkey as seq, 'w' || l_partkey as text, l_quantity as size, l_returnflag = 'A' as bold from lineitem)
      select doc, page_num, block, md5(string_agg(text, ' ' order by seq, text)) as text, round(avg(size), 1) as avg_font_size, 2 * count(*) filter (bold) > count(*) as is_bold from s group by doc, page_num, block""",
)
def span_blocks(spark: SparkSession, folder: str) -> DataFrame:
    li = spark.read.parquet(f"{folder}/lineitem.parquet")
    s = li.select(F.concat(F.lit("d"), (F.col("l_orderkey") % 20).cast("string")).alias("doc"), F.col("l_linenumber").cast("int").alias("page_num"), F.col("l_suppkey").alias("block"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "A").alias("bold"))
    return segment.span_blocks(s).withColumn("text", F.md5("text"))


@query(
    "bbox_exclude",
    """with b as (select l_orderkey as id, 'd' || l_orderkey % 50 as doc, l_linenumber as page_num, l_quantity as x0, l_quantity as y0, l_quantity + 10 as x1, l_quantity + 4 + l_linenumber as y1, l_linenumber as line from lineitem),
      t as (select * from b where id % 10 = 0)
      select b.id, b.line from b where not exists (select 1 from t where t.doc = b.doc and t.page_num = b.page_num and
        greatest(0, least(b.x1, t.x1) - greatest(b.x0, t.x0)) * greatest(0, least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5)""",
)
def bbox_exclude(spark: SparkSession, folder: str) -> DataFrame:
    li, q, n = spark.read.parquet(f"{folder}/lineitem.parquet"), F.col("l_quantity"), F.col("l_linenumber")
    b = li.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("d"), (F.col("l_orderkey") % 50).cast("string")).alias("doc"), n.alias("page_num"), q.alias("x0"), q.alias("y0"), (q + 10).alias("x1"), (q + 4 + n).alias("y1"), n.alias("line"))
    return segment.outside_tables(b, b.where("id % 10 = 0")).select("id", "line")


_TABLES = """
tables as (
  select c_custkey as id, case when c_custkey % 3 = 0 then ['', ' '] when c_custkey % 3 = 1 then ['Unit ', 'Total  water'] else ['FY', ''] end as headers,
    [[' ' || c_name, cast(c_nationkey as varchar)], ['', ' '], [case when c_custkey % 4 = 0 then '' else 'female  employee' end, ''], ['x']] as rows from customer
), cleaned as (
  select id, [trim(regexp_replace(h, '\\s+', ' ', 'g')) for h in headers] as headers,
    [r for r in [[trim(regexp_replace(c, '\\s+', ' ', 'g')) for c in r] for r in rows] if len([c for c in r if c <> '']) > 0] as rows from tables
), normal as (
  select id, case when len([h for h in headers if h <> '']) = 0 then rows[1] else headers end as headers, case when len([h for h in headers if h <> '']) = 0 then rows[2:] else rows end as rows from cleaned where len(rows) > 0
)"""


def _tables(spark: SparkSession, folder: str) -> DataFrame:
    c, k = spark.read.parquet(f"{folder}/customer.parquet"), F.col("c_custkey")
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    headers = F.when(k % 3 == 0, a("", " ")).when(k % 3 == 1, a("Unit ", "Total  water")).otherwise(a("FY", ""))
    rows = F.array(a(F.concat(F.lit(" "), "c_name"), F.col("c_nationkey").cast("string")), a("", " "), a(F.when(k % 4 == 0, "").otherwise("female  employee"), ""), a("x"))
    return c.select(k.alias("id"), headers.alias("headers"), rows.alias("rows"))


@query("table_normalize", f"with {_TABLES} select id, array_to_string(headers, '|') as headers, array_to_string([array_to_string(r, ',') for r in rows], ';') as rows, len(rows)::int as row_count, len(headers)::int as col_count from normal")
def table_normalize(spark: SparkSession, folder: str) -> DataFrame:
    t = segment.normalize_tables(_tables(spark, folder))
    return t.select("id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"), "row_count", "col_count")


@query(
    "table_records",
    f"""with {_TABLES}, r as (select id, headers, unnest(rows) as cells, generate_subscripts(rows, 1) - 1 as row from normal), c as (select id, row, cells, unnest(headers) as header, generate_subscripts(headers, 1) - 1 as i from r)
      select id, row, case when header = '' then 'col_' || i else header end as key, coalesce(cells[i + 1], '') as value from c""",
)
def table_records(spark: SparkSession, folder: str) -> DataFrame:
    return segment.table_records(segment.normalize_tables(_tables(spark, folder)))


@query(
    "metric_tables",
    f"""with {_TABLES}, x as (select id, lower(array_to_string(headers, ' ') || ' ' || array_to_string(flatten(rows), ' ')) as text from tables)
      select id, len([w for w in {V.METRIC_WORDS} if contains(text, w)]) >= 3 as is_metric from x""",
)
def metric_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _tables(spark, folder).select("id", segment.metric_table(F.col("headers"), F.col("rows")).alias("is_metric"))
