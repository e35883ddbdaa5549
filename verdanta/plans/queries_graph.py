"""Queries over the property graph and its checks, and over triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.operators import graph, trees
from verdanta.plans.queries_facts import NAMED, _list, named_facts
from verdanta.plans.registry import query


def _values(rows: list[tuple], *names: str) -> str:
    return "(values " + ", ".join("(" + _list([str(x) for x in r]) + ")" for r in rows) + f") v({', '.join(names)})"


_CANON = _values(list(V.SOURCE_TAGS.items()), "tag", "canonical")
_SCHEMA_NODES = _values(
    [(f"Category_{c}", "Category") for c in V.CATEGORIES] + [(f"Standard_{s}", "Standard") for s in (V.SOURCE_STANDARD, *V.STANDARD_TAGS)] + [(n, "ESGMetric;CanonicalConcept") for n, _, _ in V.CANONICAL] + [(f"Framework_{s}_{t}", "ESGMetric;FrameworkTag") for s, ts in V.STANDARD_TAGS.items() for t in ts],
    "id",
    "label",
)
_SCHEMA_EDGES = _values(
    [(n, f"Category_{c}", "BELONGS_TO") for n, c, _ in V.CANONICAL] + [e for s, ts in V.STANDARD_TAGS.items() for t, (n, _, _) in zip(ts, V.CANONICAL) for e in ((f"Framework_{s}_{t}", f"Standard_{s}", "BELONGS_TO"), (f"Framework_{s}_{t}", n, "MAPS_TO"))],
    "start_id",
    "end_id",
    "type",
)
GRAPH = (
    NAMED
    + f"""
, placed as (
  select n.*, m.canonical, string_split(report_year, '-')[1] as year,
    upper(trim(regexp_replace(company_name, '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')) as company_id
  from named n join {_CANON.replace(') v(', ') m(')} on n.concept = m.tag
), keyed as (
  select *, 'Fact_' || company_id || '_' || concept || '_' || year || '_' || left(md5(concat_ws('_', company_id, concept, year, '{{}}', source_file, cast(pos as varchar))), 12) as fact_id from placed
), nodes as (
  select id, label from {_SCHEMA_NODES} union all select distinct company_id, 'Company' from keyed union all select distinct 'Year_' || year, 'Year' from keyed union all select fact_id, 'ESGMetric;Fact' from keyed
), edges as (
  select start_id, end_id, type from {_SCHEMA_EDGES}
  union all select company_id, 'Year_' || year, 'REPORTS' from keyed union all select company_id, fact_id, 'HAS_METRIC' from keyed union all select fact_id, 'Year_' || year, 'DISCLOSED_IN' from keyed
  union all select fact_id, 'Category_' || category, 'BELONGS_TO' from keyed union all select fact_id, 'Standard_BRSR', 'MAPS_TO' from keyed union all select fact_id, canonical, 'MAPS_TO' from keyed
)"""
)
#: The same graph with defects: years doubled, a concept and a category gone, an edge type misspelt, labels emptied.
BROKEN = (
    GRAPH
    + """
, bad_nodes as (
  select case when id = 'Category_Other' then '' else id end as id, case when id = 'Standard_ISSB' then '' else label end as label from nodes where id not in ('CSRSpending', 'Category_Social')
  union all select id, label from nodes where label = 'Year'
), bad_edges as (
  select start_id, end_id, case when type = 'REPORTS' and end_id like '%5' then 'REPORTED' when type = 'DISCLOSED_IN' and start_id like '%a' then '' else type end as type from edges
), ok_ids as (select distinct id from bad_nodes where id <> '' and label <> '')"""
)


def built(spark: SparkSession, folder: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    return graph.build(spark, named_facts(spark, folder), stored=stored)


def broken(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    n, e = built(spark, folder, stored=True)
    i, t = F.col("id"), F.col("type")
    bad = n.where(~i.isin("CSRSpending", "Category_Social")).withColumn("label", F.when(i == "Standard_ISSB", "").otherwise(F.col("label"))).withColumn("id", F.when(i == "Category_Other", "").otherwise(i))
    kind = F.when((t == "REPORTS") & F.col("end_id").endswith("5"), "REPORTED").when((t == "DISCLOSED_IN") & F.col("start_id").endswith("a"), "").otherwise(t)
    return bad.unionByName(n.where("label = 'Year'")), e.withColumn("type", kind)


@query("graph_nodes", f"with {GRAPH} select id, label from nodes")
def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return built(spark, folder)[0].select("id", "label")


@query("graph_edges", f"with {GRAPH} select start_id, end_id, type from edges")
def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return built(spark, folder)[1]


@query("graph_label_counts", f"with {GRAPH} select string_split(label, ';')[-1] as label, count(*) as count from nodes group by 1")
def graph_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.label_counts(built(spark, folder)[0])


@query("graph_edge_counts", f"with {GRAPH} select type, count(*) as count from edges group by 1")
def graph_edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_counts(built(spark, folder)[1])


_DANGLING = """
ends as (select unnest(['start', 'end']) as side, unnest([start_id, end_id]) as id, type from bad_edges where start_id <> '' and end_id <> '' and type <> ''),
dangling as (select side, id, type, count(*) as edges from ends where id not in (select id from ok_ids) group by side, id, type)"""


@query("graph_dangling", f"with {BROKEN}, {_DANGLING} select side, id, type, edges from dangling")
def graph_dangling(spark: SparkSession, folder: str) -> DataFrame:
    nodes, edges = broken(spark, folder)
    return graph.dangling(edges, nodes)


@query("graph_duplicate_ids", f"with {BROKEN} select id, count(*) - 1 as repeats from bad_nodes where id <> '' and label <> '' group by id having count(*) > 1")
def graph_duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    return graph.duplicate_ids(broken(spark, folder)[0])


@query("graph_coverage_missing", f"with {BROKEN} select id from {_values([(n,) for n, _, _ in V.CANONICAL], 'id')} where id not in (select id from ok_ids)")
def graph_coverage_missing(spark: SparkSession, folder: str) -> DataFrame:
    return graph.missing_concepts(spark, broken(spark, folder)[0])


@query(
    "graph_report",
    f"""with {BROKEN}, {_DANGLING}, r as (
      select (select count(*) from bad_nodes) as total_nodes, (select count(*) from bad_nodes where id = '') as empty_ids, (select count(*) from bad_nodes where id <> '' and label = '') as empty_labels,
        (select count(*) from bad_edges) as total_relationships, (select count(*) from bad_edges where start_id = '' or end_id = '' or type = '') as empty_edges,
        (select count(*) from bad_edges where start_id <> '' and end_id <> '' and type <> '' and type not in ({_list(V.EDGE_TYPES)})) as unexpected_types, (select count(*) from ok_ids) as unique_node_ids,
        (select coalesce(sum(c - 1), 0)::bigint from (select count(*) as c from bad_nodes where id <> '' and label <> '' group by id)) as duplicates, (select coalesce(sum(edges), 0)::bigint from dangling) as dangling,
        (select count(*) from {_values([(n,) for n, _, _ in V.CANONICAL], 'id')} where id not in (select id from ok_ids)) as missing_concepts)
      select *, empty_ids + empty_labels + duplicates + empty_edges + dangling + missing_concepts as errors, unexpected_types as warnings, 'FAILED' as status from r""",
)
def graph_report(spark: SparkSession, folder: str) -> DataFrame:
    return graph.report(spark, *broken(spark, folder))


@query("first_nodes", "select region as id, arg_min(name, k) as name from (select r_name as region, n_name as name, n_nationkey as k from nation join region on n_regionkey = r_regionkey) group by 1")
def first_nodes(spark: SparkSession, folder: str) -> DataFrame:
    n, r = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("nation", "region"))
    df = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    return graph.first_of_each(df, "k").select("id", "name")


def _places(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, nations and regions as nodes (uri, class, name, page_start) and edges."""
    r, n, s = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("region", "nation", "supplier"))
    uri = lambda kind, key: F.concat(F.lit(f"{trees.NS}{kind}_"), F.col(key).cast("string"))
    nodes = r.select(uri("R", "r_regionkey").alias("uri"), F.lit("Framework").alias("class"), F.col("r_name").alias("name"), F.lit(None).cast("int").alias("page_start"))
    nodes = nodes.unionByName(n.select(uri("N", "n_nationkey").alias("uri"), F.lit("Topic").alias("class"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("page_start")))
    nodes = nodes.unionByName(s.select(uri("S", "s_suppkey").alias("uri"), F.lit("Disclosure").alias("class"), F.col("s_name").alias("name"), F.lit(None).cast("int").alias("page_start")))
    edges = n.select(uri("N", "n_nationkey").alias("source"), uri("R", "n_regionkey").alias("target"), F.lit("belongsToFramework").alias("relation"))
    edges = edges.unionByName(s.select(uri("S", "s_suppkey").alias("source"), uri("N", "s_nationkey").alias("target"), F.lit("belongsToTopic").alias("relation")))
    return nodes, edges


_NS, _XSD = trees.NS, trees.XSD
_PLACES = f"""
places as (
  select '{_NS}R_' || r_regionkey as uri, 'Framework' as class, r_name as name, null::int as page from region union all
  select '{_NS}N_' || n_nationkey, 'Topic', n_name, n_nationkey from nation union all select '{_NS}S_' || s_suppkey, 'Disclosure', s_name, null from supplier
), links as (
  select '{_NS}N_' || n_nationkey as source, '{_NS}R_' || n_regionkey as target, 'belongsToFramework' as relation from nation union all
  select '{_NS}S_' || s_suppkey, '{_NS}N_' || s_nationkey, 'belongsToTopic' from supplier
)"""


@query(
    "rdf_triples",
    f"""with {_PLACES} select uri as s, '{trees.RDF_TYPE}' as p, '{_NS}' || class as o, null as datatype from places union select uri, '{_NS}name', name, '{_XSD}string' from places
      union select uri, '{_NS}pageStart', cast(page as varchar), '{_XSD}integer' from places where page is not null union select source, '{_NS}' || relation, target, null from links""",
)
def rdf_triples(spark: SparkSession, folder: str) -> DataFrame:
    return trees.triples(*_places(spark, folder))


@query("concept_pivot", f"with {_PLACES} select uri as s, name, cast(page as varchar) as \"pageStart\" from places")
def concept_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return trees.pivot_attributes(trees.triples(*_places(spark, folder)), ["name", "pageStart"])


@query(
    "ancestor_path",
    f"""with recursive {_PLACES.strip()}, up as (
        select uri, uri as at, [name][1:0] as path, 0 as depth from places
        union all select up.uri, l.target, list_append(up.path, p.name), depth + 1 from up join links l on up.at = l.source join places p on p.uri = l.target where depth < 5)
      select uri, array_to_string(arg_max(path, depth), '|') as path from up group by uri""",
)
def ancestor_path(spark: SparkSession, folder: str) -> DataFrame:
    return trees.ancestor_paths(*_places(spark, folder)).select("uri", F.array_join("hierarchy_path", "|").alias("path"))
