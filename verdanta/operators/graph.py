"""Property graph of companies, years, facts and standards, and its integrity checks.

Nodes and edges are built as projections and unions; every check is a filter,
an anti join or an aggregate, so none collects the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import first_filled, year_of
from verdanta.operators.shared import checkpoint

NODE = "id label name concept value normalized_value value_type unit_ref source_file dimensions description".split()
EDGE = ["start_id", "end_id", "type"]
#: Column names of bulk-import files.
NODE_HEADER = {"id": "id:ID", "label": "label:LABEL"}
EDGE_HEADER = {"start_id": "start_id:START_ID", "end_id": "end_id:END_ID", "type": "type:TYPE"}


def schema_nodes(spark: SparkSession) -> DataFrame:
    """Categories, standards, canonical concepts and the standards' tags."""
    rows = [(f"Category_{c}", "Category", c, "") for c in V.CATEGORIES]
    rows += [(f"Standard_{s}", "Standard", s, "") for s in (V.SOURCE_STANDARD, *V.STANDARD_TAGS)]
    rows += [(name, "ESGMetric;CanonicalConcept", name, text) for name, _, text in V.CANONICAL]
    rows += [(f"Framework_{s}_{t}", "ESGMetric;FrameworkTag", t, "") for s, tags in V.STANDARD_TAGS.items() for t in tags]
    return _filled(spark.createDataFrame(rows, "id string, label string, name string, description string"))


def schema_edges(spark: SparkSession) -> DataFrame:
    rows = [(name, f"Category_{category}", "BELONGS_TO") for name, category, _ in V.CANONICAL]
    for s, tags in V.STANDARD_TAGS.items():
        for tag, (name, _, _) in zip(tags, V.CANONICAL):
            rows += [(f"Framework_{s}_{tag}", f"Standard_{s}", "BELONGS_TO"), (f"Framework_{s}_{tag}", name, "MAPS_TO")]
    return spark.createDataFrame(rows, "start_id string, end_id string, type string")


def _filled(nodes: DataFrame) -> DataFrame:
    """All node columns, empty where a kind of node has none."""
    return nodes.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in nodes.columns else F.lit("").alias(c) for c in NODE])


def company_id(name: Column) -> Column:
    """Two companies have short ids of old; any other gets one from its name."""
    low = F.lower(name)
    slug = F.upper(F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", ""))
    return F.when(low.contains("tata consultancy"), "TCS").when(low.contains("reliance"), "RELIANCE").otherwise(slug)


def canonical_of(concept: Column) -> Column:
    """The canonical concept of a source tag, else Other: a constant map, no join."""
    table = F.create_map(*[F.lit(x) for pair in V.SOURCE_TAGS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, concept), F.lit("Other"))


def placed_facts(facts: DataFrame, mapped_only: bool = True) -> DataFrame:
    """Facts with the ids of their company, year and own node; the fact's id is stable over reruns."""
    if mapped_only:
        facts = facts.where(F.col("concept").isin(list(V.SOURCE_TAGS)))
    facts = facts.withColumns({"company": company_id(F.col("company_name")), "year": year_of(F.col("report_year"))})
    key = F.concat_ws("_", "company", "concept", "year", "dimensions_json", F.col("source_file"), F.col("pos").cast("string"))
    return facts.withColumn("fact_id", F.concat_ws("_", F.lit("Fact"), "company", "concept", "year", F.substring(F.md5(key), 1, 12)))


def instance_nodes(placed: DataFrame) -> DataFrame:
    """Company, Year and Fact nodes, one for each id: the first in (source_file, pos) order."""
    company = placed.select(F.col("company").alias("id"), F.lit("Company").alias("label"), F.col("company_name").alias("name"), "source_file", "pos")
    company = company.groupBy("id", "label").agg(F.min_by("name", F.struct("source_file", "pos")).alias("name"))
    year = placed.select(F.concat(F.lit("Year_"), F.col("year")).alias("id"), F.lit("Year").alias("label"), F.col("year").alias("name")).distinct()
    name = F.concat(F.col("company"), F.lit(" "), F.col("concept"), F.lit(" ("), F.col("year"), F.lit(")"))
    fact = placed.select(F.col("fact_id").alias("id"), F.lit("ESGMetric;Fact").alias("label"), name.alias("name"), "concept", "value", "normalized_value", "value_type", "unit_ref", "source_file", F.col("dimensions_json").alias("dimensions"))
    return _filled(company).unionByName(_filled(year)).unionByName(_filled(fact))


def instance_edges(placed: DataFrame) -> DataFrame:
    """Six edges a fact (a multiset), by one projection and one explode."""
    year = F.concat(F.lit("Year_"), F.col("year"))
    canonical = canonical_of(F.col("concept"))
    by_canonical = F.create_map(*[F.lit(x) for name, category, _ in V.CANONICAL for x in (name, category)])
    category = F.coalesce(first_filled(F.col("category"), F.try_element_at(by_canonical, canonical)), F.lit("Other"))
    edge = lambda a, b, t: F.struct(a.alias("start_id"), b.alias("end_id"), F.lit(t).alias("type"))
    company, fact = F.col("company"), F.col("fact_id")
    edges = F.array(
        edge(company, year, "REPORTS"),
        edge(company, fact, "HAS_METRIC"),
        edge(fact, year, "DISCLOSED_IN"),
        edge(fact, F.concat(F.lit("Category_"), category), "BELONGS_TO"),
        edge(fact, F.lit(f"Standard_{V.SOURCE_STANDARD}"), "MAPS_TO"),
        edge(fact, canonical, "MAPS_TO"),
    )
    return placed.select(F.inline(edges))


def build(spark: SparkSession, facts: DataFrame, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole graph.

    Nodes and edges each go over the placed facts more than once; ``stored``
    writes these to a checkpoint first, for callers that read both.
    """
    placed = placed_facts(facts)
    if stored:
        placed = checkpoint(placed.select("company", "year", "fact_id", "company_name", "concept", "value", "normalized_value", "value_type", "unit_ref", "source_file", "dimensions_json", "category", "pos"))
    return schema_nodes(spark).unionByName(instance_nodes(placed)), schema_edges(spark).unionByName(instance_edges(placed))


def first_of_each(nodes: DataFrame, order: str) -> DataFrame:
    """One node for each id: the first by ``order``."""
    others = [c for c in nodes.columns if c != "id"]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*others), order).alias("n")).select("id", "n.*")


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.element_at(F.split("label", ";"), -1).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: total_nodes, total_relationships, and the counts by label and by type as maps."""
    counts = lambda df, key, name: df.agg(F.coalesce(F.sum("count"), F.lit(0)).alias(f"total_{name}"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "count")))).alias(f"{name}_by_{key}"))  # noqa: E731  one row for each kind
    return counts(label_counts(nodes), "label", "nodes").join(F.broadcast(counts(edge_counts(edges), "type", "relationships")))


def valid_ids(nodes: DataFrame) -> DataFrame:
    """Ids of nodes with an id and a label (edges to others dangle)."""
    return nodes.where("id <> '' and label <> ''").select("id").distinct()


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """(id, repeats): how often an id occurs again after its first node."""
    return nodes.where("id <> '' and label <> ''").groupBy("id").agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(side, id, type, edges): ends of edges that no node has."""
    ids = valid_ids(nodes)
    ends = edges.where("start_id <> '' and end_id <> '' and type <> ''")
    ends = ends.select(F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("start_id").alias("id")), F.struct(F.lit("end").alias("side"), F.col("end_id").alias("id")))).alias("e"), "type")
    ends = ends.groupBy("e.side", "e.id", "type").agg(F.count(F.lit(1)).alias("edges"))
    return ends.join(ids, "id", "left_anti").select("side", "id", "type", "edges")


def missing_concepts(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Canonical concepts that the graph lacks."""
    wanted = spark.createDataFrame([(name,) for name, _, _ in V.CANONICAL], "id string")
    return wanted.join(valid_ids(nodes), "id", "left_anti")


def report(spark: SparkSession, nodes: DataFrame, edges: DataFrame, said: dict[str, int] | None = None) -> DataFrame:
    """One row: status, totals and the counts of each kind of error and warning.

    Ids, labels and edges are checkpointed, so that the graph is built once and
    not for each count.
    """
    nodes, edges = checkpoint(nodes.select("id", "label")), checkpoint(edges.select(*EDGE))
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.coalesce(F.sum((F.col("id") == "").cast("long")), F.lit(0)).alias("empty_ids"), F.coalesce(F.sum(((F.col("id") != "") & (F.col("label") == "")).cast("long")), F.lit(0)).alias("empty_labels"))
    e = edges.agg(
        F.count(F.lit(1)).alias("total_relationships"),
        F.coalesce(F.sum(((F.col("start_id") == "") | (F.col("end_id") == "") | (F.col("type") == "")).cast("long")), F.lit(0)).alias("empty_edges"),
        F.coalesce(F.sum((~F.col("type").isin(V.EDGE_TYPES) & (F.col("type") != "") & (F.col("start_id") != "") & (F.col("end_id") != "")).cast("long")), F.lit(0)).alias("unexpected_types"),
    )
    each = nodes.where("id <> '' and label <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    u = each.agg(F.count(F.lit(1)).alias("unique_node_ids"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("duplicates"))
    g = dangling(edges, nodes).agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("dangling"))
    m = missing_concepts(spark, nodes).agg(F.count(F.lit(1)).alias("missing_concepts"))
    row = n
    for part in (e, u, g, m):  # one row each
        row = row.join(F.broadcast(part))
    wrong = sum((F.lit(v) != F.col(k)).cast("int") for k, v in (said or {}).items()) if said else F.lit(0)
    errors = F.col("empty_ids") + F.col("empty_labels") + F.col("duplicates") + F.col("empty_edges") + F.col("dangling") + F.col("missing_concepts")
    return row.withColumns({"errors": errors, "warnings": F.col("unexpected_types") + wrong, "status": F.when(errors == 0, "PASSED").otherwise("FAILED")})
