"""Driver tables seen as the engine's inputs.

The domain has no table of its own in the test data, so these adapters give
facts, contexts, blocks, boxes, concepts and decisions made of the tables there.
Each is one SQL text that both engines run, so a query and its oracle start from
the same rows and differ in everything after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Facts from orders: concept, value and unit by key, so that every kind of value occurs.
FACTS = """
select 'filings/' || replace(cast(c_mktsegment as string), ' ', '_') || '/x/f' || cast(o_custkey % 20 as string) || '.xml' as source_file,
       o_orderkey as pos,
       case cast(o_orderkey % 13 as int)
         when 0 then 'TotalScope1Emissions' when 1 then 'TotalScope2Emissions' when 2 then 'TotalEnergyConsumedFromRenewableSources'
         when 3 then 'TotalVolumeOfWaterWithdrawal' when 4 then 'TotalWasteGenerated' when 5 then 'NumberOfFemaleEmployeesOrWorkers'
         when 6 then 'PercentageOfFemaleBoardOfDirectors' when 7 then 'AmountSpentForCSRProjectsUndertaken' when 8 then 'CorporateIdentityNumber'
         when 9 then 'NameOfTheCompany' when 10 then 'ReportingPeriodLabel' when 11 then 'PolicyOnEthics' else 'NumberOfStreetVendors' end as concept,
       '' as namespace,
       case cast(o_orderkey % 11 as int)
         when 0 then ' Nil ' when 1 then 'Yes' when 2 then 'n' when 3 then '31-03-20' || cast(10 + o_orderkey % 15 as string) when 4 then '20' || cast(10 + o_orderkey % 15 as string) || '-04-01'
         when 5 then cast(1 + o_orderkey % 9 as string) || ',' || cast(100 + o_orderkey % 900 as string)
         when 6 then cast(o_orderkey % 200 as string) || '.5' when 7 then '-' || cast(1 + o_orderkey % 50 as string) when 8 then '+00' || cast(o_orderkey % 7 as string)
         when 9 then '1.5e' || cast(o_orderkey % 20 as string) else c_name || ' Limited' end as value,
       'c' || cast(o_orderkey % 40 as string) as context_ref,
       case when o_orderkey % 5 = 0 then 'pure' when o_orderkey % 5 = 1 then null else 'INR' end as unit_ref,
       '0' as decimals, c_name as company, o_orderdate as stamp
from {orders} join {customer} on o_custkey = c_custkey
"""

#: Contexts c0 .. c29 of every file (facts refer to 40), some of them twice.
CONTEXTS = """
select s.source_file, 'c' || cast(k.k % 30 as string) as context_id, k.k as pos,
       case when k.k % 3 = 0 then 'instant' else 'duration' end as period_type,
       case when k.k % 3 = 0 then null else '20' || cast(10 + k.k % 15 as string) || '-04-01' end as start_date,
       case when k.k % 3 = 0 then null else '20' || cast(11 + k.k % 15 as string) || '-03-31' end as end_date,
       case when k.k % 3 = 0 then '20' || cast(10 + k.k % 15 as string) || '-03-31' end as instant_date
from (select distinct source_file from ({facts}) f) s, (select distinct cast(o_orderkey % 33 as bigint) as k from {orders}) k
"""

#: Text blocks: the lines of documents, with headings where a line's number says so.
BLOCKS = r"""
select d.doc, d.page_num, d.seq, d.x0, d.y0, d.font as avg_font_size, d.bold as is_bold, 1 as line_count,
  case when d.seq = 0 then 'SECTION A: General' when d.seq % 17 = 5 then 'SECTION B: Policies' when d.seq % 11 = 3 then 'PRINCIPLE ' || cast(1 + d.seq % 9 as string) || ' of conduct'
       when d.seq % 11 = 7 then 'Principle 6 environment' when d.seq % 7 = 4 then 'Essential Indicators' when d.seq % 7 = 6 then 'Leadership indicators'
       when d.seq % 5 = 2 then cast(1 + d.seq % 30 as string) || '. Provide details of the measures taken' when d.seq % 13 = 8 then 'CSR Details' else d.line end as text
from (select 'd' || cast(l_orderkey % 97 as string) as doc, 1 + cast(floor(l_linenumber / 3.0) as int) as page_num, cast(l_orderkey % 61 as int) as seq,
             cast(l_quantity as double) as y0, cast(l_linenumber as double) as x0, case when l_returnflag = 'R' then 12.0 else 9.0 end as font, l_linestatus = 'F' and l_returnflag = 'R' as bold,
             'measured ' || cast(l_partkey as string) as line, l_orderkey, l_linenumber
      from {lineitem}) d
"""

#: Concepts: nations as one framework's, regions' market segments as the other's.
SOURCE_CONCEPTS = """
select 'urn:x#S' || cast(n_nationkey as string) as uri,
       case cast(n_nationkey % 6 as int) when 0 then 'Total GHG emissions of ' when 1 then 'Water withdrawal and consumption in ' when 2 then 'Occupational health and safety of workers in ' when 3 then 'Anti-corruption policy of ' when 4 then 'Electricity and fuel of ' else 'Wages of employees in ' end || lower(n_name) as label,
       case when n_nationkey % 3 = 0 then 'Requirement' else 'Disclosure' end as concept_type, n_name || ' disclosure text' as definition,
       case cast(n_nationkey % 5 as int) when 0 then 'tCO2e' when 1 then 'kilolitre' when 2 then 'GJ per rupee' when 3 then '%' else null end as unit,
       case cast(n_nationkey % 4 as int) when 0 then 'float' when 1 then 'int' when 2 then 'text' else null end as datatype,
       case when n_nationkey % 7 = 6 then '' when n_nationkey % 2 = 0 then 'Principle 6 environment|Section C' else 'Principle ' || cast(1 + n_nationkey % 9 as string) || '|Section C report' end as path
from {nation}
"""
TARGET_CONCEPTS = """
select 'urn:x#T' || cast(s_suppkey as string) as uri,
       case cast(s_suppkey % 6 as int) when 0 then 'Direct greenhouse gas emissions' when 1 then 'Water consumption' when 2 then 'Occupational health and safety management' when 3 then 'Anti corruption training' when 4 then 'Energy within the organization' else 'Employee compensation' end || ' ' || cast(s_suppkey % 4 as string) as label,
       case when s_suppkey % 2 = 0 then 'Requirement' else 'Disclosure' end as concept_type, 'text of ' || s_name as definition,
       case cast(s_suppkey % 5 as int) when 0 then 'tonnes CO2' when 1 then 'kilolitre' when 2 then 'MJ' when 3 then 'INR' else null end as unit,
       case cast(s_suppkey % 3 as int) when 0 then 'decimal' when 1 then 'text' else 'string' end as datatype,
       case cast(s_suppkey % 4 as int) when 0 then 'GRI 305 emissions|environment' when 1 then 'GRI 403 safety|people' when 2 then 'Principle 6 topics' else 'GRI 205 anti-corruption' end as path
from {supplier}
"""

#: Decisions of five annotators over the labelled documents.
DECISIONS = """
select m.model, row_number() over (partition by m.model order by l.doc_id) - 1 as pos,
       case m.k when 0 then case when l.quality = 1 then 'Agree' else 'Disagree' end
                when 1 then case when l.toxic = 1 then 'Disagree' else 'Agree' end
                when 2 then case when l.doc_id % 3 = 0 then 'Agree' when l.doc_id % 3 = 1 then 'Disagree' else 'Uncertain' end
                when 3 then 'Uncertain' else case when l.quality = 1 and l.doc_id % 5 <> 0 then 'Agree' else 'Disagree' end end as decision
from {labels} l, (select 0 as k, 'Truth' as model union all select 1, 'Clean' union all select 2, 'Third' union all select 3, 'Never' union all select 4, 'Near') m
"""


def run(spark: SparkSession, folder: str, sql: str, **inner: str) -> DataFrame:
    """An adapter's SQL over the tables of a folder."""
    for name, text in inner.items():
        sql = sql.replace("{" + name + "}", text)
    used = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str, **inner: str) -> str:
    """The same as DuckDB SQL."""
    for name, text in inner.items():
        sql = sql.replace("{" + name + "}", text)
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
