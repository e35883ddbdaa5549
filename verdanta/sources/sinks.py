"""Outputs: the partitioned warehouse, graph files, triples, trees, mappings, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.operators.facts import FACT_COLUMNS, KEYS
from verdanta.operators.graph import EDGE_HEADER, NODE_HEADER


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The fact and report tables, where they don't exist yet."""
    columns = ", ".join(f"{c} STRING" for c in FACT_COLUMNS)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.esg_facts ({columns}) USING parquet PARTITIONED BY (company_name, report_year)")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {database}.reports_metadata (company_name STRING, report_year STRING, namespace STRING, source_file STRING,"
        " context_count INT, unit_count INT, fact_count INT, ingested_at TIMESTAMP) USING parquet"
    )


def write_facts(facts: DataFrame, path: str) -> None:
    """Replace the partitions (company, year) that ``facts`` has, leave the others: writing twice leaves one copy."""
    rows = facts.select(*[F.col(c).cast("string") for c in FACT_COLUMNS])
    rows.repartition(*KEYS, F.pmod(F.hash("source_file", "concept"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in FACT_COLUMNS)
    return spark.read.schema(schema).parquet(path).select(*FACT_COLUMNS)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and relationships as bulk-import CSV."""
    for df, header, name in ((nodes, NODE_HEADER, "nodes"), (edges, EDGE_HEADER, "relationships")):
        df.withColumnsRenamed(header).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def write_json(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_flat_csv(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def triple_text(s: Column, p: Column, o: Column, datatype: Column) -> Column:
    """One triple as a line; an object with a datatype is a literal."""
    literal = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(o, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    value = F.when(datatype.isNull(), F.concat(F.lit("<"), o, F.lit(">"))).otherwise(F.concat(F.lit('"'), literal, F.lit('"^^<'), datatype, F.lit(">")))
    return F.concat(F.lit("<"), s, F.lit("> <"), p, F.lit("> "), value, F.lit(" ."))


def write_triples(triples: DataFrame, path: str) -> None:
    triples.select(triple_text(F.col("s"), F.col("p"), F.col("o"), F.col("datatype"))).write.mode("overwrite").text(path)


def manifest(trees: DataFrame) -> DataFrame:
    """One row a document."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    name = F.concat(F.regexp_replace("source_file", r"\.[^.]*$", ""), F.lit(".json"))
    return trees.select("framework", "company", "fiscal_year", "source_file", name.alias("output_file"), "total_pages", size("standards").alias("standards"), size("sections").alias("sections"))


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
