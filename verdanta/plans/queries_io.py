"""Queries over sources and sinks: filings, warehouse, ledgers, graph files, triples, trees, mappings.

Inputs are made of the test tables, written to the session's shared checkpoint
folder where the operator reads files, and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions.normalize import clean_name, namespace_of
from verdanta.operators import align, graph, segment, trees
from verdanta.operators import facts as ops
from verdanta.operators.shared import checkpoint_dir
from verdanta.plans import inputs as I
from verdanta.plans import queries_align as A
from verdanta.plans import queries_graph as G
from verdanta.plans.registry import query
from verdanta.sources import files, filings, sinks
from verdanta.streaming.ingest import facts_of_files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- filings: one for each of up to 50 numbers k. Of ten, seven are well formed, one is cut off, one names an
# encoding that nobody knows, one has no tags.

_OPEN = '<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:c="urn:taxonomy">'
_CONTEXTS = """
<context id="DCYMain"><entity><identifier scheme="s">L{k}</identifier></entity><period><startDate>20{y}-04-01</startDate><endDate>20{z}-03-31</endDate></period></context>
<context id="I"><entity><segment><d:explicitMember dimension="x">ignored</d:explicitMember></segment></entity><period><instant>20{z}-03-31</instant></period><scenario><d:explicitMember dimension="c:Axis">c:A{k}</d:explicitMember><d:typedMember dimension="c:T"><c:v>7</c:v></d:typedMember></scenario></context>
<context id="I"><period><instant>20{y}-06-30</instant></period></context>
<unit id="u{k}"><measure>INR</measure><measure>second</measure></unit><unit id="none"/>
"""


def _xml() -> str:
    """The text of file k as SQL that both engines run, over (k, facts)."""
    parts, rest = [], _CONTEXTS
    while rest:
        text, mark, rest = rest.partition("{")
        parts.append("'" + text.replace("'", "''") + "'")
        if mark:
            name, _, rest = rest.partition("}")
            parts.append({"k": "cast(k as string)", "y": "cast(10 + k % 13 as string)", "z": "cast(11 + k % 13 as string)"}[name])
    body = " || ".join(parts)
    head = "case when k % 10 = 8 then '<?xml version=\"1.0\" encoding=\"x-odd\"?>' else '<?xml version=\"1.0\"?>' end"
    return f"case when k % 10 = 9 then 'no tags ' || cast(k as string) else {head} || '{_OPEN}' || {body} || facts || case when k % 10 = 7 then '<open>' else '</xbrl>' end end"


#: The facts of file k, in the order of n.
_FACT = """
select c_custkey % 50 as k, c_custkey as n,
       case cast(c_custkey % 6 as int) when 0 then 'NameOfTheCompany' when 1 then 'TotalScope1Emissions' when 2 then 'AmountSpentForCSRProjectsUndertaken' when 3 then 'PercentageOfFemaleBoardOfDirectors' when 4 then 'PolicyOnEthics' else 'TotalWasteGenerated' end as concept,
       case cast(c_custkey % 6 as int) when 0 then c_name || ' & Co Limited' when 4 then 'Yes' else cast(c_custkey % 997 as string) || case when c_custkey % 2 = 0 then '' else '.25' end end as value,
       case when c_custkey % 7 = 6 then 'nowhere' when c_custkey % 3 = 1 then 'I' else 'DCYMain' end as context_ref,
       case when c_custkey % 6 in (1, 2, 5) then 'u' || cast(c_custkey % 50 as string) end as unit_ref,
       case when c_custkey % 4 = 0 then '0' end as decimals
from {customer}
"""
_FACT_TEXT = """'<c:' || concept || ' contextRef="' || context_ref || '"' || coalesce(' unitRef="' || unit_ref || '"', '') || coalesce(' decimals="' || decimals || '"', '') || '>' || replace(value, '&', '&amp;') || '</c:' || concept || '>'"""
_PATH = "'in/Acme_' || cast(k as string) || '/x/f' || cast(k as string) || '.xml'"


def filing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(k, path, text) of every file."""
    facts = I.run(spark, folder, _FACT)
    each = facts.select("k", "n", F.expr(_FACT_TEXT).alias("x")).groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda f: f["x"]), "").alias("facts"))
    return each.select("k", F.expr(_PATH).alias("path"), F.expr(_xml()).alias("text"))


def filing_rows(spark: SparkSession, folder: str) -> DataFrame:
    return filings.parse(filing_texts(spark, folder).select("path", F.encode("text", "UTF-8").alias("content")))


_FILES = f"facts as ({I.duck(_FACT)}), ks as (select distinct k from facts), f as (select k, {_PATH} as source_file, k % 10 >= 7 as fallback from ks where k % 10 <> 9)"


@query(
    "filing_contexts",
    f"""with {_FILES} select source_file, 'DCYMain' as context_id, 'duration' as period_type, '20' || (10 + k % 13) || '-04-01' as start_date, '20' || (11 + k % 13) || '-03-31' as end_date, null as instant_date, 'L' || k as entity, 's' as scheme, '' as dimensions from f
      union all select source_file, 'I', 'instant', null, null, '20' || (11 + k % 13) || '-03-31', '', '', 'c:A' || k || ',7' from f
      union all select source_file, 'I', 'instant', null, null, '20' || (10 + k % 13) || '-06-30', '', '', '' from f""",
)
def filing_contexts(spark: SparkSession, folder: str) -> DataFrame:
    c, d = filings.contexts(filing_rows(spark, folder)), F.col("dimensions")
    members = F.concat_ws(",", F.try_element_at(d, F.lit("c:Axis")), F.try_element_at(d, F.lit("c:T")))
    return c.select("source_file", "context_id", "period_type", "start_date", "end_date", "instant_date", F.col("entity_identifier").alias("entity"), F.col("entity_scheme").alias("scheme"), members.alias("dimensions"))


@query("filing_units", f"with {_FILES} select source_file, 'u' || k as unit_id, 'INR' as measure from f union all select source_file, 'none', '' from f")
def filing_units(spark: SparkSession, folder: str) -> DataFrame:
    return filings.units(filing_rows(spark, folder))


@query(
    "filing_facts",
    f"""with {_FILES} select f.source_file, row_number() over (partition by facts.k order by n) as place, concept, case when fallback then '' else 'urn:taxonomy' end as namespace, value, context_ref, unit_ref, decimals,
      case when fallback then 'fallback' else 'strict' end as parser from facts join f using (k)""",
)
def filing_facts(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = filing_rows(spark, folder).where("kind = 'fact'")
    place = F.row_number().over(W.partitionBy("source_file").orderBy("pos"))
    return rows.select("source_file", place.cast("long").alias("place"), "concept", "namespace", "value", "context_ref", "unit_ref", "decimals", "parser")


@query("filing_bad_files", f"with {_FILES} select {_PATH} as source_file from ks where k % 10 = 9")
def filing_bad_files(spark: SparkSession, folder: str) -> DataFrame:
    return filings.bad_files(filing_rows(spark, folder))


_TEXTS = f"with {_FILES}, t as (select k, string_agg({_FACT_TEXT}, '' order by n) as facts from facts group by k), texts as (select k, {_xml().replace('as string)', 'as varchar)')} as text from t)"


@query("filing_scan", f"{_TEXTS} select k, md5(text || chr(10)) as hash from texts")
def filing_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Written as files, found again in subfolders; a folder named twice gives each file once, one that isn't there nothing."""
    at = _folder(spark, "filings")
    filing_texts(spark, folder).select("k", "text").repartition("k").write.partitionBy("k").option("lineSep", "\n").text(at)
    found = filings.find_files(spark, at, f"{at}/missing", at, pattern="part-*")
    return found.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k"), "hash")


_STORED = f"""
{_FILES}, named as (
  select k, coalesce((select arg_min(x.value, x.n) from facts x where x.k = f.k and x.concept = 'NameOfTheCompany'), 'Acme ' || k) as company_name, '20' || (10 + k % 13) || '-' || (11 + k % 13) as report_year from f
), stored as (
  select company_name, report_year, concept, value, context_ref, unit_ref, case when concept in ('TotalScope1Emissions', 'TotalWasteGenerated') then 'Environmental' when concept in ('AmountSpentForCSRProjectsUndertaken', 'PercentageOfFemaleBoardOfDirectors') then 'Social' when concept = 'PolicyOnEthics' then 'Governance' else 'Other' end as category,
    case when concept = 'NameOfTheCompany' then 'text' when concept = 'PolicyOnEthics' then 'boolean' when concept in ('PercentageOfFemaleBoardOfDirectors', 'TotalWasteGenerated') then 'percentage' else 'numeric' end as value_type,
    case when concept = 'PolicyOnEthics' then 'True' else value end as normalized_value, case context_ref when 'DCYMain' then 'duration' when 'I' then 'instant' end as period_type,
    case when context_ref = 'DCYMain' then '20' || (10 + k % 13) || '-04-01' end as start_date, case when context_ref = 'I' then '20' || (10 + k % 13) || '-06-30' end as instant_date
  from facts join named using (k)
)"""


@query("warehouse_round_trip", f"with {_STORED} select company_name, report_year, concept, value, normalized_value, value_type, category, context_ref, unit_ref, period_type, start_date, instant_date from stored")
def warehouse_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Filings to the partitioned warehouse, written twice: one copy is read back."""
    at = _folder(spark, "warehouse")
    facts = facts_of_files(filing_texts(spark, folder).select("path", F.encode("text", "UTF-8").alias("content")))
    for _ in range(2):
        sinks.write_facts(facts, at)
    return sinks.read_facts(spark, at).select("company_name", "report_year", "concept", "value", "normalized_value", "value_type", "category", "context_ref", "unit_ref", "period_type", "start_date", "instant_date")


@query("fact_columns", "select unnest(range(17))::int as place, unnest(['" + "', '".join(ops.FACT_COLUMNS) + "']) as column, 'string' as type")
def fact_columns(spark: SparkSession, folder: str) -> DataFrame:
    at = _folder(spark, "warehouse")
    sinks.write_facts(facts_of_files(filing_texts(spark, folder).select("path", F.encode("text", "UTF-8").alias("content"))), at)
    return files.describe(sinks.read_facts(spark, at))


@query("ledger_round_trip", "select 'new' as state, doc_id from documents where doc_id % 3 <> 0 union all select 'fresh', doc_id from documents")
def ledger_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """What a ledger hasn't read yet; after a fresh start, everything."""
    at = _folder(spark, "ledger")
    found = _table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    schema = "path string, hash string, processed_at string"
    for k in (0, 3):  # two runs append
        sinks.append_ledger(found.where(f"doc_id % 6 = {k}").select("path", "hash", F.lit("then").alias("processed_at")), at)
    new = ops.unprocessed(found, files.read_state(spark, at, schema)).select(F.lit("new").alias("state"), "doc_id")
    kept = _folder(spark, "result")
    new.write.parquet(kept)
    files.delete_state(spark, at)
    fresh = ops.unprocessed(found, files.read_state(spark, at, schema)).select(F.lit("fresh").alias("state"), "doc_id")
    return spark.read.parquet(kept).unionByName(fresh)


@query("namespace_pick", "select n_nationkey as id, case when n_nationkey % 3 = 0 then 'urn:default' when n_nationkey % 3 = 1 then 'urn:cap' else '' end as namespace from nation")
def namespace_pick(spark: SparkSession, folder: str) -> DataFrame:
    n, k = _table(spark, folder, "nation"), F.col("n_nationkey")
    pair = lambda a, b: F.create_map(F.lit(a), F.lit(b))
    spaces = F.when(k % 3 == 0, F.map_concat(pair("default", "urn:default"), pair("in-capmkt", "urn:cap"))).when(k % 3 == 1, pair("in-capmkt", "urn:cap")).otherwise(pair("other", "urn:o"))
    return n.select(k.alias("id"), namespace_of(spaces).alias("namespace"))


_DOC_PATHS = "case cast(doc_id % 6 as int) when 0 then '/d/' || source || '/BRSR/' || cast(doc_id as string) || '.pdf' when 1 then '/d/' || source || '/Annual/FY' || cast(doc_id as string) || '.v2.pdf' when 2 then '/raw/GRI 2' || cast(doc_id % 90 + 10 as string) || '_ Topic.pdf' when 3 then '/raw/GRI 2_ General.pdf' when 4 then '/raw/GRI 1' || cast(doc_id % 10 as string) || '_ Sector.pdf' else '/raw/BRSR GRI 4' || cast(doc_id as string) || '.pdf' end"


@query(
    "document_paths",
    f"""with p as (select doc_id, source, {_DOC_PATHS.replace('as string)', 'as varchar)')} as path from documents)
      select doc_id, case when doc_id % 6 in (0, 1) then source else 'Unknown' end as company, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') as fiscal_year,
        doc_id % 6 = 0 as is_report, contains(lower(string_split(path, '/')[-1]), 'gri') as named_gri,
        contains(string_split(path, '/')[-1], 'BRSR') or not (contains(string_split(path, '/')[-1], 'GRI ') and ((contains(path, 'GRI 2') and not contains(path, 'GRI 2_')) or contains(path, 'GRI 4') or regexp_matches(path, 'GRI 1[1-9]_'))) as environmental
      from p""",
)
def document_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Companies, years and rules of documents by path, in the order of the paths."""
    path = F.col("path")
    p = _table(spark, folder, "documents").select("doc_id", "source", F.expr(_DOC_PATHS).alias("path"))
    reports = files.report_documents(p).select("doc_id", F.lit(True).alias("is_report"))
    out = p.join(reports, "doc_id", "left").orderBy("path", "doc_id")
    return out.select("doc_id", files.company_of_path(path).alias("company"), files.year_of_path(path).alias("fiscal_year"), F.coalesce("is_report", F.lit(False)).alias("is_report"), files.wanted_document(path, "gRi").alias("named_gri"), files.wanted_document(path, environmental_only=True).alias("environmental"))


@query("clean_names", "select distinct x as name, case when x = '' then 'unknown' else trim(regexp_replace(x, '[^\\p{L}\\p{N}]+', '_', 'g'), '_') end as clean from (select c_name || ' (' || c_mktsegment || ')' as x from customer union all select p_name from part union all select source || '//' || lang from documents union all select '')")
def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    c, p, d = (_table(spark, folder, t) for t in ("customer", "part", "documents"))
    names = c.select(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("name")).unionByName(p.select(F.col("p_name").alias("name"))).unionByName(d.select(F.concat("source", F.lit("//"), "lang").alias("name"))).unionByName(spark.createDataFrame([("",)], "name string"))
    return names.distinct().select("name", clean_name(F.col("name")).alias("clean"))


# --- graph files


@query("graph_csv_round_trip", f"with {G.GRAPH} select 'node' as kind, id as a, label as b, '' as c from nodes union all select 'edge', start_id, end_id, type from edges")
def graph_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    at = _folder(spark, "graph")
    sinks.write_graph(*G.built(spark, folder, stored=True), at)
    nodes = files.read_graph_csv(spark, f"{at}/nodes", files.NODES).select(F.lit("node").alias("kind"), F.col("`id:ID`").alias("a"), F.col("`label:LABEL`").alias("b"), F.lit("").alias("c"))
    edges = files.read_graph_csv(spark, f"{at}/relationships", list(graph.EDGE_HEADER.values())).select(F.lit("edge").alias("kind"), F.col("`start_id:START_ID`").alias("a"), F.col("`end_id:END_ID`").alias("b"), F.col("`type:TYPE`").alias("c"))
    return nodes.unionByName(edges)


@query(
    "graph_summary",
    f"""with {G.GRAPH}, l as (select string_split(label, ';')[-1] as label, count(*) as n from nodes group by 1), t as (select type, count(*) as n from edges group by 1)
      select (select count(*) from nodes) as total_nodes, (select count(*) from edges) as total_relationships, (select '{{' || string_agg('"' || label || '":' || n, ',' order by label) || '}}' from l) as nodes_by_label, (select '{{' || string_agg('"' || type || '":' || n, ',' order by type) || '}}' from t) as relationships_by_type""",
)
def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = graph.summary(*G.built(spark, folder, stored=True))
    return s.withColumns({c: F.to_json(c) for c in ("nodes_by_label", "relationships_by_type")})


@query("graph_said_counts", f"with {G.GRAPH} select (select count(*) from nodes) as total_nodes, (select count(*) from edges) as total_relationships, 2 as warnings, 0::bigint as errors, 'PASSED' as status")
def graph_said_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts that a summary states and the files don't have are warnings."""
    nodes, edges = G.built(spark, folder, stored=True)
    return graph.report(spark, nodes, edges, {"total_nodes": -1, "total_relationships": -1}).select("total_nodes", "total_relationships", "warnings", "errors", "status")


@query("triples_round_trip", f"with {G._PLACES}, odd as (select p_partkey as k, p_name || case when p_partkey % 3 = 0 then ' \"said\"' when p_partkey % 3 = 1 then ' back\\slash\\n' else chr(10) || 'line' end as name from part) " + f"select uri as s, '{trees.RDF_TYPE}' as p, '{trees.NS}' || class as o, null as datatype from places union select source, '{trees.NS}' || relation, target, null from links union select '{trees.NS}P_' || k, '{trees.NS}name', name, '{trees.XSD}string' from odd")
def triples_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = G._places(spark, folder)
    k = F.col("p_partkey")
    odd = F.concat("p_name", F.when(k % 3 == 0, ' "said"').when(k % 3 == 1, " back\\slash\\n").otherwise("\nline"))
    more = _table(spark, folder, "part").select(F.concat(F.lit(f"{trees.NS}P_"), k.cast("string")).alias("s"), F.lit(f"{trees.NS}name").alias("p"), odd.alias("o"), F.lit(f"{trees.XSD}string").alias("datatype"))
    at = _folder(spark, "triples")
    sinks.write_triples(trees.triples(nodes.select("uri", "class"), edges).unionByName(more), at)
    return files.read_triples(spark, at)


@query("ontology_schema", f"select '{trees.NS}' || c as s, '{trees.RDF_TYPE}' as p, '{trees.OWL}Class' as o from (select unnest(['" + "', '".join(trees.V.CLASSES) + f"']) as c) union all select '{trees.NS}' || c, '{trees.RDF_TYPE}', '{trees.OWL}ObjectProperty' from (select unnest(['" + "', '".join(trees.V.OBJECT_PROPERTIES) + f"']) as c) union all select '{trees.NS}' || c, '{trees.RDF_TYPE}', '{trees.OWL}DatatypeProperty' from (select unnest(['" + "', '".join(trees.V.DATA_PROPERTIES) + f"']) as c) union all select '{trees.NS}' || c, '{trees.SUB_PROPERTY}', '{trees.NS}belongsTo' from (select unnest(['" + "', '".join(trees.V.SUB_PROPERTIES) + "']) as c)")
def ontology_schema(spark: SparkSession, folder: str) -> DataFrame:
    return trees.base_triples(spark).select("s", "p", "o")


# --- disclosure trees: a report for each region, a standard for each nation


def _report_trees(spark: SparkSession, folder: str) -> DataFrame:
    r, n, s = (_table(spark, folder, t) for t in ("region", "nation", "supplier"))
    k = F.col("s_suppkey")
    item = F.struct(F.concat(F.lit("Q"), k.cast("string")).alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("text "), "s_name").alias("text"), F.concat(F.lit("Metric "), (k % 3).cast("string")).alias("metric"), F.when(k % 2 == 0, "GJ").alias("unit"), F.when(k % 2 == 0, "float").alias("datatype"), F.lit("all").alias("applicability"), (k % 9).cast("int").alias("page_start"), (k % 9 + 1).cast("int").alias("page_end"), F.array(F.lit("c1"), F.lit("c2")).alias("content"))
    items = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    section = F.struct(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("section_id"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("int").alias("page_start"), (F.col("n_nationkey") + 1).cast("int").alias("page_end"), F.array(F.concat(F.lit("about "), "n_name")).alias("content"), F.col("items").alias("disclosures"))
    sections = n.join(items, "n_nationkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(section)).alias("sections"))
    doc = F.concat(F.lit("r"), F.col("r_regionkey").cast("string"))
    return r.join(sections, "r_regionkey").select(doc.alias("doc"), F.lit("BRSR").alias("framework"), F.col("r_name").alias("company"), F.lit("FY24").alias("fiscal_year"), F.concat(doc, F.lit("_brsr.pdf")).alias("source_file"), F.lit(9).alias("total_pages"), F.array(F.concat(F.lit("Intro "), "r_name")).alias("content"), "sections")


def _standard_trees(spark: SparkSession, folder: str) -> DataFrame:
    n, s = _table(spark, folder, "nation"), _table(spark, folder, "supplier")
    k, u = F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")
    need = lambda kind, content: F.struct(F.lit(kind).alias("type"), content.alias("content"))
    needs = F.array(need("REQUIREMENTS", F.array().cast("array<string>")), need("GUIDANCE", F.array(F.concat(F.lit("z"), k))))
    item = F.struct(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "Topic ").otherwise("303-"), k).alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("text "), "s_name").alias("text"), F.array(F.lit("c")).alias("content"), needs.alias("requirements"))
    items = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    standard = F.struct(F.concat(F.lit("GRI "), u).alias("standard_id"), F.concat(F.lit("GRI "), u, F.lit(": "), "n_name").alias("title"), F.array(F.col("n_name")).alias("content"), F.col("items").alias("disclosures"))
    return n.join(items, "n_nationkey").select(F.concat(F.lit("g"), u).alias("doc"), F.lit("GRI").alias("framework"), F.concat(F.lit("GRI "), u, F.lit(".pdf")).alias("source_file"), F.array(standard).alias("standards"))


def _read_back(spark: SparkSession, *found: DataFrame) -> DataFrame:
    """Trees written as JSON, one document a file, beside a manifest and a broken file, and read again."""
    at = _folder(spark, "trees")
    for i, df in enumerate(found):
        sinks.write_json(df.repartition("doc"), f"{at}/{i}", "doc")
    spark.range(1).select(F.lit('{"framework": "BRSR", "sections": [').alias("value")).write.text(f"{at}/broken/doc=x")
    return files.read_trees(spark, f"{at}/*/doc=*/").where("_bad is null")


_CLEAN = lambda x: f"trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"
_NS = trees.NS
_ITEMS = "s as (select s_suppkey as k, s_name, s_nationkey, 'text ' || s_name as t from supplier)"
_Q_URI = f"'{_NS}Disclosure_Q' || k || '_' || left(md5(t), 12)"


@query(
    "report_tree_nodes",
    f"""with {_ITEMS} select '{_NS}Framework_' || {_CLEAN("'r' || r_regionkey || '_brsr.pdf'")} as uri, 'Framework' as class, 'BRSR' as identifier, 'Business Responsibility and Sustainability Report' as name, -1 as page_start, 'Intro ' || r_name as text from region where r_regionkey in (select n_regionkey from nation where n_nationkey in (select s_nationkey from s))
      union all select '{_NS}Topic_S' || n_nationkey, 'Topic', 'S' || n_nationkey, n_name, n_nationkey::int, 'about ' || n_name from nation where n_nationkey in (select s_nationkey from s)
      union all select {_Q_URI}, 'Disclosure', 'Q' || k, s_name, (k % 9)::int, t || chr(10) || 'c1' || chr(10) || 'c2' from s
      union all select distinct '{_NS}Metric_Metric_' || k % 3, 'Metric', 'Metric ' || k % 3, 'Metric ' || k % 3, -1, null from s union all select distinct '{_NS}Unit_GJ', 'Unit', 'GJ', 'GJ', -1, null from s where k % 2 = 0""",
)
def report_tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return trees.report_graph(_read_back(spark, _report_trees(spark, folder)))[0].select("uri", "class", "identifier", "name", F.coalesce("page_start", F.lit(-1)).alias("page_start"), "text")


_BOTH = lambda a, b, down, up, rows: f"select {a} as source, {b} as target, '{down}' as relation {rows} union all select {b}, {a}, '{up}' {rows}"


@query(
    "report_tree_edges",
    f"""with {_ITEMS}, e as ({_BOTH(f"'{_NS}Framework_r' || n_regionkey || '_brsr_pdf'", f"'{_NS}Topic_S' || n_nationkey", 'contains', 'belongsToFramework', 'from nation where n_nationkey in (select s_nationkey from s)')}
      union all {_BOTH(f"'{_NS}Topic_S' || s_nationkey", _Q_URI, 'contains', 'belongsToTopic', 'from s')}
      union all select {_Q_URI}, '{_NS}Metric_Metric_' || k % 3, 'hasMetric' from s union all select {_Q_URI}, '{_NS}Unit_GJ', 'hasUnit' from s where k % 2 = 0) select distinct * from e""",
)
def report_tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    return trees.report_graph(_read_back(spark, _report_trees(spark, folder)))[1]


@query(
    "standard_tree_nodes",
    f"""with {_ITEMS}, i as (select *, '{_NS}' || case when k % 4 = 0 then 'Topic_Topic_' else 'Disclosure_303_' end || k as uri, case when k % 4 = 0 then 'Topic' else 'Disclosure' end as class, case when k % 4 = 0 then 'Topic ' else '303-' end || k as id from s)
      select distinct '{_NS}Framework_GRI_' || s_nationkey || '_pdf' as uri, 'Framework' as class, 'GRI' as identifier, 'GRI ' || s_nationkey as name, '' as text from s
      union all select distinct '{_NS}Topic_GRI_' || s_nationkey, 'Topic', 'GRI ' || s_nationkey, 'GRI ' || s_nationkey || ': ' || n_name, n_name from s join nation on n_nationkey = s_nationkey
      union all select uri, class, id, s_name, t || chr(10) || 'c' from i
      union all select '{_NS}Requirement_' || left(md5(uri || '#0'), 12), 'Requirement', 'REQUIREMENTS', 'REQUIREMENTS', '' from i union all select '{_NS}Requirement_' || left(md5('z' || k), 12), 'Requirement', 'GUIDANCE', 'GUIDANCE', 'z' || k from i""",
)
def standard_tree_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = trees.standard_graph(_read_back(spark, _standard_trees(spark, folder)))[0]
    return nodes.select("uri", "class", "identifier", "name", F.coalesce("text", F.lit("")).alias("text"))


@query(
    "standard_tree_edges",
    f"""with {_ITEMS}, i as (select *, '{_NS}' || case when k % 4 = 0 then 'Topic_Topic_' else 'Disclosure_303_' end || k as uri from s), e as (
      {_BOTH(f"'{_NS}Framework_GRI_' || s_nationkey || '_pdf'", f"'{_NS}Topic_GRI_' || s_nationkey", 'contains', 'belongsToFramework', 'from s')} union all {_BOTH(f"'{_NS}Topic_GRI_' || s_nationkey", 'uri', 'contains', 'belongsToTopic', 'from i')}
      union all {_BOTH('uri', f"'{_NS}Requirement_' || left(md5(uri || '#0'), 12)", 'requires', 'belongsToDisclosure', 'from i')} union all {_BOTH('uri', f"'{_NS}Requirement_' || left(md5('z' || k), 12)", 'requires', 'belongsToDisclosure', 'from i')}) select distinct * from e""",
)
def standard_tree_edges(spark: SparkSession, folder: str) -> DataFrame:
    return trees.standard_graph(_read_back(spark, _standard_trees(spark, folder)))[1]


@query(
    "tree_concepts",
    f"""with {_ITEMS} select {_Q_URI} as uri, 'BRSR' as framework, s_name as label, 'Disclosure' as concept_type, 'Metric ' || k % 3 as metric, case when k % 2 = 0 then 'GJ' end as unit, case when k % 2 = 0 then 'float' end as datatype,
      n_name as topic, 'Business Responsibility and Sustainability Report' as parent_topic from s join nation on n_nationkey = s_nationkey""",
)
def tree_concepts(spark: SparkSession, folder: str) -> DataFrame:
    c = trees.concepts(*trees.report_graph(_read_back(spark, _report_trees(spark, folder))))
    return c.select("uri", "framework", "label", "concept_type", "metric", "unit", "datatype", "topic", "parent_topic")


@query(
    "tree_manifest",
    """select 'BRSR' as framework, r_name as company, 'r' || r_regionkey || '_brsr.json' as output_file, 0 as standards, count(*)::int as sections from region join nation on n_regionkey = r_regionkey where n_nationkey in (select s_nationkey from supplier) group by r_name, r_regionkey
      union all select distinct 'GRI', null, 'GRI ' || s_nationkey || '.json', 1, 0 from supplier""",
)
def tree_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Reports and standards from one scan; the broken file is told by its text and left out."""
    found = _read_back(spark, _report_trees(spark, folder), _standard_trees(spark, folder))
    return sinks.manifest(found).select("framework", "company", "output_file", "standards", "sections")


@query("tables_from_rows", "select c_custkey as id, case when c_custkey % 3 = 2 then 'h1|h2' else 'a|b' end as headers, case when c_custkey % 3 = 2 then 'x,y;' || c_name || ',z' else '1,' || c_name end as rows from customer where c_custkey % 3 <> 0")
def tables_from_rows(spark: SparkSession, folder: str) -> DataFrame:
    c, k = _table(spark, folder, "customer"), F.col("c_custkey")
    row = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    cells = F.when(k % 3 == 0, F.array(row("only", "one"))).when(k % 3 == 1, F.array(row("a", "b"), row("1", F.col("c_name")))).otherwise(F.array(row("h1", "h2"), row("x", "y"), row(F.col("c_name"), "z")))
    t = segment.tables_of_rows(c.select(k.alias("id"), cells.alias("cells")))
    return t.select("id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("rows"))


# --- mappings


def _r6(c: str) -> Column:
    return A.r6(F.col(c))


@query(
    "mapping_records",
    f"""with {A.SCORED}, r as (select *, {A._REL} as relationship from scored)
      select md5(s_uri || chr(10) || t_uri) as pair_id, string_split(s_uri, '#')[-1] as s_id, string_split(t_uri, '#')[-1] as t_id, relationship, string_split({A._SKOS}, '#')[-1] as skos_relation, {A._r6('score * 100')} as confidence, {A._r6('lex')} as label_similarity, {A._r6('emb2')} as embedding_similarity,
        {A._r6('prop')} as unit_compatibility, {A._r6('structural')} as hierarchy_similarity, 1.5::double as unused from r""",
)
def mapping_records(spark: SparkSession, folder: str) -> DataFrame:
    """Final records through JSON and back, with their evidence."""
    at = _folder(spark, "mappings")
    sinks.write_json(align.mappings(A.scored(spark, folder)), at)
    m = spark.read.json(at)
    e = F.col("evidence_summary")
    unused = e["definition_similarity"] + e["topic_similarity"] + e["context_similarity"]
    return m.select("pair_id", "s_id", "t_id", "relationship", "skos_relation", _r6("confidence_score").alias("confidence"), A.r6(e["label_similarity"]).alias("label_similarity"), A.r6(e["embedding_similarity"]).alias("embedding_similarity"), A.r6(e["unit_compatibility"]).alias("unit_compatibility"), A.r6(e["hierarchy_similarity"]).alias("hierarchy_similarity"), unused.alias("unused"))


@query(
    "mapping_summary_csv",
    f"""with {A.SCORED}, r as (select *, {A._REL} as relationship from scored) select s_label, t_label, relationship, {A._r6('lex')} as label_similarity, count(*) as n from r group by all""",
)
def mapping_summary_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The flat file: nested columns are JSON text."""
    at = _folder(spark, "summary")
    sinks.write_flat_csv(align.mappings(A.scored(spark, folder)), at)
    m = spark.read.option("header", True).option("escape", '"').csv(at)
    label = F.get_json_object("evidence_summary", "$.label_similarity").cast("double")
    return m.groupBy("s_label", "t_label", "relationship", A.r6(label).alias("label_similarity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rule_reasons",
    f"""with {A.SCORED}, p as (select *, case when len(s_path) > 0 and len(t_path) > 0 then {A._jaccard('s_path[1]', 't_path[1]')} else 0.0::double end as parents from scored)
      select s_uri, t_uri, concat_ws(' / ', case when s_esg <> 'Unknown' and t_esg <> 'Unknown' and s_esg <> t_esg then 'Rule 1: dimensions ' || s_esg || ' and ' || t_esg || ' conflict, score x 0.1' when s_esg <> 'Unknown' and t_esg <> 'Unknown' then 'Rule 1: both of dimension ' || s_esg else 'Rule 1: skipped, a dimension is unknown' end,
        case when parents >= 0.5 then 'Rule 2: parents alike (' || printf('%.2f', parents) || '), score x 1.15' end,
        case when s_dt <> '' and t_dt <> '' and s_num <> t_num then 'Rule 3: one side numeric, the other not, score x 0.8' when s_num and t_num and s_unit <> '' and s_unit = t_unit then 'Rule 3: same unit ' || s_unit || ', score x 1.05'
          when s_num and t_num and s_unit <> '' and t_unit <> '' then 'Rule 3: numeric, units ' || s_unit || ' and ' || t_unit || ' differ' end) as reasons from p""",
)
def rule_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return A.scored(spark, folder).select("s_uri", "t_uri", F.array_join("reasoning", " / ").alias("reasons"))
