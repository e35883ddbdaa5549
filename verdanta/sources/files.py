"""Other inputs: disclosure trees, layout blocks, exported graphs, state; always with a stated schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "struct<headers: array<string>, rows: array<array<string>>, row_count: int, col_count: int, page_num: int, bbox: array<double>>"
EXTRA = "metric: string, unit: string, datatype: string, applicability: string"
PAGES = f"page_start: int, page_end: int, content: array<string>, tables: array<{TABLE}>"
DISCLOSURE = f"struct<id: string, label: string, text: string, {EXTRA}, {PAGES}>"
REQUIREMENT = f"struct<type: string, text: string, {EXTRA}, {PAGES}>"
STANDARD_DISCLOSURE = f"struct<id: string, label: string, text: string, {EXTRA}, {PAGES}, requirements: array<{REQUIREMENT}>>"
GROUP = f"struct<group_type: string, {PAGES}, disclosures: array<{DISCLOSURE}>>"
PRINCIPLE = f"struct<principle_num: int, label: string, text: string, {PAGES}, indicator_groups: array<{GROUP}>, disclosures: array<{DISCLOSURE}>>"
SECTION = f"struct<section_id: string, label: string, {PAGES}, principles: array<{PRINCIPLE}>, disclosures: array<{DISCLOSURE}>>"
STANDARD = f"struct<standard_id: string, title: string, {PAGES}, disclosures: array<{STANDARD_DISCLOSURE}>>"
#: One document: a report has sections, a standard has standards.
TREE = (
    "framework string, framework_full_name string, issuer string, company string, fiscal_year string, source_file string, total_pages int,"
    f" content array<string>, tables array<{TABLE}>, sections array<{SECTION}>, standards array<{STANDARD}>, _bad string"
)
BLOCKS = (
    "doc string, page_num int, seq int, block_type string, text string, x0 double, y0 double, x1 double, y1 double,"
    " avg_font_size double, is_bold boolean, line_count int, headers array<string>, rows array<array<string>>"
)
LEDGER = "path string, hash string, processed_at string, metadata struct<company_name: string, report_year: string, fact_count: int>"
CATEGORY_CACHE = "concept string, category string"
NODES = ["id:ID", "label:LABEL", "name", "concept", "value", "normalized_value", "value_type", "unit_ref", "source_file", "dimensions", "description"]


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Disclosure trees, one JSON document a file; manifests left out, a broken file has its text in _bad and nothing else."""
    trees = spark.read.schema(TREE).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return trees.where(~F.col("_metadata.file_name").contains("manifest.json"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).json(path)


def read_graph_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A bulk-import file, every column as text, empty for empty."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger or cache in JSON lines; empty where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def delete_state(spark: SparkSession, *paths: str) -> None:
    """Forget ledgers and caches, for a fresh start; one that doesn't exist is passed over."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, datatype) of a file of triples, one a line, as ``write_triples`` has them; other lines are passed over."""
    line = r'^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"(.*)"\^\^<([^>]*)>) \.$'
    part = lambda k: F.regexp_extract("value", line, k)
    raw = spark.read.text(path).where(F.col("value").rlike(line)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("iri"), part(4).alias("text"), part(5).alias("kind"))
    # a backslash stands for itself only as a pair, so the pairs are set aside first
    text = F.replace(F.col("text"), F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    literal = F.col("kind") != ""
    return raw.select("s", "p", F.when(literal, text).otherwise(F.col("iri")).alias("o"), F.when(literal, F.col("kind")).alias("datatype"))


def describe(df: DataFrame) -> DataFrame:
    """(place, column, type) of every column."""
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "place int, column string, type string")


def company_of_path(path: Column) -> Column:
    """The folder before BRSR or Annual in a document's path."""
    parts = F.split(path, "/")
    at = F.greatest(F.array_position(parts, "BRSR"), F.array_position(parts, "Annual"))
    return F.when(at > 1, F.get(parts, (at - 2).cast("int"))).otherwise(F.lit("Unknown"))


def year_of_path(path: Column) -> Column:
    """A document's file name without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def wanted_document(path: Column, name_filter: str | None = None, environmental_only: bool = False) -> Column:
    """Whether a document is read: its name has the filter text (any case), and none of the series left out."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(True) if not name_filter else F.contains(F.lower(name), F.lit(name_filter.lower()))
    if environmental_only:
        left_out = (name.contains("GRI 2") & ~name.contains("GRI 2_")) | name.contains("GRI 4") | name.rlike(r"GRI 1[1-9]_")
        out = out & (name.contains("BRSR") | ~(name.contains("GRI ") & left_out))
    return out


def report_documents(paths: DataFrame, companies: list[str] | None = None) -> DataFrame:
    """Paths of reports (…/BRSR/*.pdf), of companies whose name occurs in the path."""
    out = paths.where(F.col("path").rlike(r"/BRSR/[^/]*\.pdf$"))
    return out.where(F.exists(F.array(*[F.lit(c) for c in companies]), lambda c: F.contains(F.col("path"), c))) if companies else out
