"""Disclosure trees as an RDF-like graph: triples, nodes and edges, and concepts read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import clean_name

NS = "http://example.org/verdanta/ontology#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUB_PROPERTY = "http://www.w3.org/2000/01/rdf-schema#subPropertyOf"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
NODE = "uri string, class string, identifier string, name string, source_document string, page_start int, page_end int, section_label string, text string, datatype string, applicability string"
#: A node's columns as properties: name, and the type of its literals.
PROPERTIES = {"identifier": "string", "name": "string", "source_document": "string", "page_start": "integer", "page_end": "integer", "section_label": "string", "text": "string", "datatype": "string", "applicability": "string"}
PROPERTY_NAMES = {"source_document": "sourceDocument", "page_start": "pageStart", "page_end": "pageEnd", "section_label": "sectionLabel", "datatype": "hasDatatype", "applicability": "hasApplicability"}


def base_triples(spark: SparkSession) -> DataFrame:
    """Classes and properties."""
    rows = [(NS + c, RDF_TYPE, OWL + "Class") for c in V.CLASSES]
    rows += [(NS + p, RDF_TYPE, OWL + "ObjectProperty") for p in V.OBJECT_PROPERTIES]
    rows += [(NS + p, RDF_TYPE, OWL + "DatatypeProperty") for p in V.DATA_PROPERTIES]
    rows += [(NS + p, SUB_PROPERTY, NS + "belongsTo") for p in V.SUB_PROPERTIES]
    return spark.createDataFrame([(*r, None) for r in rows], "s string, p string, o string, datatype string")


def _uri(kind: str | Column, *parts: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit(NS), kind, *[x for p in parts for x in (F.lit("_"), p)])


def _joined(*parts: Column) -> Column:
    """Texts and arrays of texts as lines."""
    return F.array_join(F.filter(F.concat(*parts), lambda x: x.isNotNull() & (x != "")), "\n")


def _text(item: Column) -> Column:
    none = F.array().cast("array<string>")
    return _joined(F.array(item["text"]), F.coalesce(item["content"], none))


def _node(uri: Column, kind: str | Column, identifier: Column, name: Column, source: Column, text: Column, item: Column | None = None, extra: bool = False) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(
        uri.alias("uri"), (F.lit(kind) if isinstance(kind, str) else kind).alias("class"), identifier.cast("string").alias("identifier"), name.alias("name"), source.alias("source_document"),
        (item["page_start"] if item is not None else F.lit(None).cast("int")).alias("page_start"), (item["page_end"] if item is not None else F.lit(None).cast("int")).alias("page_end"),
        (name if item is not None else null).alias("section_label"), text.alias("text"),
        (item["datatype"] if extra else null).alias("datatype"), (item["applicability"] if extra else null).alias("applicability"),
    )


def _edge(a: Column, b: Column, p: str) -> Column:
    return F.struct(a.alias("source"), b.alias("target"), F.lit(p).alias("relation"))


def _measures(rows: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Metric and unit nodes and edges of items (columns uri and ``item``)."""
    each = rows.select("uri", F.explode(F.array(F.struct(F.lit("Metric").alias("k"), F.col(item)["metric"].alias("v")), F.struct(F.lit("Unit").alias("k"), F.col(item)["unit"].alias("v")))).alias("m")).where("m.v <> ''")
    target = _uri(F.col("m.k"), clean_name(F.col("m.v")))
    null = F.lit(None).cast("string")
    nodes = each.select(F.struct(target.alias("uri"), F.col("m.k").alias("class"), F.col("m.v").alias("identifier"), F.col("m.v").alias("name"), null.alias("source_document"), null.cast("int").alias("page_start"), null.cast("int").alias("page_end"), null.alias("section_label"), null.alias("text"), null.alias("datatype"), null.alias("applicability")).alias("n")).select("n.*")
    edges = each.select(F.col("uri").alias("source"), target.alias("target"), F.concat(F.lit("has"), F.col("m.k")).alias("relation"))
    return nodes, edges


def _both(rows: DataFrame, uri: str, parent: str, down: str, up: str) -> DataFrame:
    return rows.select(F.inline(F.array(_edge(F.col(parent), F.col(uri), down), _edge(F.col(uri), F.col(parent), up))))


def _collect(nodes: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes, of repeated uris one (the smallest row, so the choice doesn't hang on the order), and distinct edges."""
    n, e = nodes[0], edges[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.unionByName(x)
    others = [c for c in n.columns if c != "uri"]
    n = n.groupBy("uri").agg(F.min(F.struct(*others)).alias("n")).select("uri", "n.*")
    return n, e.distinct()


def report_graph(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of reports: framework, section and principle topics, disclosures, metrics and units."""
    source = F.coalesce("source_file", F.lit(""))
    docs = trees.withColumns({"source": source, "doc_uri": _uri("Framework", clean_name(source))})
    nodes = [docs.select(_node(F.col("doc_uri"), "Framework", F.lit("BRSR"), F.lit("Business Responsibility and Sustainability Report"), F.col("source"), F.array_join("content", "\n")).alias("n")).select("n.*")]
    sections = docs.select("source", "doc_uri", F.explode("sections").alias("s"))
    section_id = F.coalesce(F.nullif(F.col("s.section_id"), F.lit("")), F.left(F.col("s.label"), F.lit(20)))
    sections = sections.withColumn("uri", _uri("Topic", clean_name(section_id)))
    nodes.append(sections.select(_node(F.col("uri"), "Topic", F.col("s.section_id"), F.col("s.label"), F.col("source"), F.array_join("s.content", "\n"), F.col("s")).alias("n")).select("n.*"))
    edges = [_both(sections, "uri", "doc_uri", "contains", "belongsToFramework")]
    principles = sections.select("source", F.col("uri").alias("parent"), F.explode("s.principles").alias("p")).withColumn("uri", _uri("Topic_Principle", clean_name(F.col("p.label"))))
    nodes.append(principles.select(_node(F.col("uri"), "Topic", F.col("p.principle_num"), F.col("p.label"), F.col("source"), _text(F.col("p")), F.col("p")).alias("n")).select("n.*"))
    edges.append(_both(principles, "uri", "parent", "contains", "childOf"))
    questions = sections.select("source", F.col("uri").alias("parent"), F.explode("s.disclosures").alias("q"))
    questions = questions.unionByName(principles.select("source", F.col("uri").alias("parent"), F.explode("p.disclosures").alias("q")))
    groups = principles.select("source", F.col("uri").alias("parent"), F.explode("p.indicator_groups").alias("g"))
    questions = questions.unionByName(groups.select("source", "parent", F.explode("g.disclosures").alias("q")))
    questions = questions.withColumn("uri", _uri("Disclosure", clean_name(F.col("q.id")), F.left(F.md5(F.coalesce("q.text", F.lit(""))), F.lit(12))))
    nodes.append(questions.select(_node(F.col("uri"), "Disclosure", F.col("q.id"), F.col("q.label"), F.col("source"), _text(F.col("q")), F.col("q"), extra=True).alias("n")).select("n.*"))
    edges.append(_both(questions, "uri", "parent", "contains", "belongsToTopic"))
    more = _measures(questions, "q")
    return _collect([*nodes, more[0]], [*edges, more[1]])


def standard_graph(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of standards: framework, standard topics, disclosures or topics, requirements."""
    source = F.coalesce("source_file", F.lit(""))
    docs = trees.withColumns({"source": source, "doc_uri": _uri("Framework", clean_name(source))})
    nodes = [docs.select(_node(F.col("doc_uri"), "Framework", F.lit("GRI"), F.replace("source", F.lit(".pdf"), F.lit("")), F.col("source"), F.array_join("content", "\n")).alias("n")).select("n.*")]
    standards = docs.select("source", "doc_uri", F.explode("standards").alias("s")).where("s.title <> ''").withColumn("uri", _uri("Topic", clean_name(F.col("s.standard_id"))))
    nodes.append(standards.select(_node(F.col("uri"), "Topic", F.col("s.standard_id"), F.col("s.title"), F.col("source"), F.array_join("s.content", "\n"), F.col("s")).alias("n")).select("n.*"))
    edges = [_both(standards, "uri", "doc_uri", "contains", "belongsToFramework")]
    items = standards.select("source", F.col("uri").alias("parent"), F.explode("s.disclosures").alias("d"))
    own = clean_name(F.col("d.id"))
    items = items.withColumn("kind", F.when(F.lower(own).contains("topic"), "Topic").otherwise("Disclosure"))
    items = items.withColumn("uri", _uri(F.col("kind"), own))
    nodes.append(items.select(_node(F.col("uri"), F.col("kind"), F.col("d.id"), F.col("d.label"), F.col("source"), _text(F.col("d")), F.col("d"), extra=True).alias("n")).select("n.*"))
    edges.append(_both(items, "uri", "parent", "contains", "belongsToTopic"))
    needs = items.select("source", F.col("uri").alias("parent"), F.posexplode("d.requirements").alias("i", "r"))
    text = F.array_join("r.content", "\n")
    needs = needs.withColumn("uri", _uri("Requirement", F.left(F.md5(F.when(text == "", F.concat("parent", F.lit("#"), F.col("i").cast("string"))).otherwise(text)), F.lit(12))))
    nodes.append(needs.select(_node(F.col("uri"), "Requirement", F.col("r.type"), F.col("r.type"), F.col("source"), text, F.col("r"), extra=True).alias("n")).select("n.*"))
    edges.append(_both(needs, "uri", "parent", "requires", "belongsToDisclosure"))
    a, b = _measures(items, "d"), _measures(needs, "r")
    return _collect([*nodes, a[0], b[0]], [*edges, a[1], b[1]])


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The set of triples (s, p, o, datatype): a node's type and filled properties, and the edges."""
    items = [F.struct(F.lit(RDF_TYPE).alias("p"), F.concat(F.lit(NS), F.col("class")).alias("o"), F.lit(None).cast("string").alias("datatype"))]
    for c, kind in PROPERTIES.items():
        if c in nodes.columns:
            items.append(F.struct(F.lit(NS + PROPERTY_NAMES.get(c, c)).alias("p"), F.col(c).cast("string").alias("o"), F.lit(XSD + kind).alias("datatype")))
    own = nodes.select(F.col("uri").alias("s"), F.explode(F.array(*items)).alias("t")).select("s", "t.*").where("o is not null and o <> ''")
    links = edges.select(F.col("source").alias("s"), F.concat(F.lit(NS), F.col("relation")).alias("p"), F.col("target").alias("o"), F.lit(None).cast("string").alias("datatype"))
    return own.unionByName(links).distinct()


def pivot_attributes(triples_: DataFrame, properties: list[str]) -> DataFrame:
    """(s, one column a property): the smallest object of each; the columns are stated, so no pass finds them."""
    name = F.substring_index("p", "#", -1)
    return triples_.withColumn("_p", name).where(F.col("_p").isin(properties)).groupBy("s").pivot("_p", properties).agg(F.min("o"))


#: Predicates that lead to a concept's parent, the first that it has counts.
PARENT_ORDER = ["belongsToTopic", "belongsToFramework", "belongsToDisclosure", "belongsTo"]


def ancestor_paths(nodes: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(uri, hierarchy_path): names of at most ``depth`` ancestors, the nearest first."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PARENT_ORDER]), F.col("relation"))
    parents = edges.where(F.col("relation").isin(PARENT_ORDER)).groupBy("source").agg(F.min(F.struct(rank.alias("r"), F.col("target").alias("t"))).alias("b"))
    parents = parents.select("source", F.col("b.t").alias("target")).join(nodes.select(F.col("uri").alias("target"), "name"), "target", "left").select("source", "target", "name")
    out = nodes.select("uri", F.col("uri").alias("at"), F.array().cast("array<string>").alias("hierarchy_path"))
    for _ in range(depth):
        out = out.join(parents, F.col("at") == F.col("source"), "left").select("uri", F.col("target").alias("at"), F.when(F.col("name").isNull(), F.col("hierarchy_path")).otherwise(F.concat("hierarchy_path", F.array("name"))).alias("hierarchy_path"))
    return out.select("uri", "hierarchy_path")


def concepts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Disclosures and requirements of either framework with their attributes, metric, unit and ancestors."""
    own = nodes.where(F.col("class").isin("Disclosure", "Requirement"))
    text = F.lower(F.concat_ws(" ", "source_document", "uri"))
    framework = F.when(text.contains("brsr"), "BRSR").when(text.contains("gri"), "GRI")
    names = nodes.select(F.col("uri").alias("target"), F.col("name").alias("measure"))
    has = edges.where(F.col("relation").isin("hasMetric", "hasUnit")).join(names, "target").groupBy("source").agg(F.max(F.when(F.col("relation") == "hasMetric", F.col("measure"))).alias("metric"), F.max(F.when(F.col("relation") == "hasUnit", F.col("measure"))).alias("unit"))
    out = own.withColumn("framework", framework).dropna(subset=["framework"])
    out = out.join(has.withColumnRenamed("source", "uri"), "uri", "left").join(ancestor_paths(nodes, edges), "uri", "left")
    return out.select("uri", "framework", F.col("name").alias("label"), F.col("class").alias("concept_type"), F.col("text").alias("definition"), "metric", "unit", "datatype", "applicability", F.get("hierarchy_path", F.lit(0)).alias("topic"), F.get("hierarchy_path", F.lit(1)).alias("parent_topic"), "hierarchy_path")
