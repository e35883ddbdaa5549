"""Command line: ingest filings, build and check the graph, build and align ontologies, evaluate annotators.

python -m verdanta ingest FOLDER... --warehouse PATH [--force | --fresh]
python -m verdanta graph --warehouse PATH --out FOLDER
python -m verdanta ontology TREES --out FOLDER
python -m verdanta align TREES --out FOLDER [--blocked]
python -m verdanta evaluate DECISIONS --truth MODEL
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.operators import align, evaluate, graph, trees
from verdanta.operators import facts as ops
from verdanta.operators.shared import checkpoint
from verdanta.session import session
from verdanta.sources import files, filings, sinks
from verdanta.streaming.ingest import facts_of_files

LEDGER = "path string, hash string, processed_at string"


def ingest(spark: SparkSession, folders: list[str], warehouse: str, force: bool = False, fresh: bool = False) -> DataFrame:
    """New and changed filings into the warehouse; the ledger beside it tells which these are. Returns counts by category.

    A file's facts replace those that the same file had; facts of other files
    stay, also where company and year are the same. ``force`` reads every file
    again, ``fresh`` also forgets the ledger.
    """
    state = f"{warehouse}_ledger"
    if fresh:
        files.delete_state(spark, state)
    found = filings.find_files(spark, *folders)
    ledger = spark.createDataFrame([], LEDGER) if force else files.read_state(spark, state, LEDGER)
    todo = checkpoint(ops.unprocessed(found.select("path", "hash"), ledger))  # names and hashes, not the files
    new = checkpoint(facts_of_files(found.join(todo, ["path", "hash"], "left_semi")).select(*[F.col(c).cast("string") for c in ops.FACT_COLUMNS]))
    if files.exists(spark, warehouse):
        stored = sinks.read_facts(spark, warehouse).join(todo.select(F.col("path").alias("source_file")), "source_file", "left_anti")
        new = new.unionByName(checkpoint(stored.join(new.select(*ops.KEYS).distinct(), ops.KEYS, "left_semi").select(*ops.FACT_COLUMNS)))
    sinks.write_facts(new, warehouse)
    sinks.append_ledger(todo.select("path", "hash", F.current_timestamp().cast("string").alias("processed_at")), state)
    return sinks.read_facts(spark, warehouse).groupBy("category").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "category")


def build_graph(spark: SparkSession, warehouse: str, out: str) -> DataFrame:
    """Nodes, edges and counts of the warehouse's graph as files; returns the integrity report."""
    stored = sinks.read_facts(spark, warehouse)
    nodes, edges = graph.build(spark, stored.withColumn("pos", F.xxhash64(*stored.columns)))
    sinks.write_graph(nodes, edges, out)
    sinks.write_json(graph.summary(nodes, edges), f"{out}/summary")
    sinks.write_json(graph.label_counts(nodes).withColumn("kind", F.lit("node")).unionByName(graph.edge_counts(edges).withColumnRenamed("type", "label").withColumn("kind", F.lit("edge"))), f"{out}/counts")
    return graph.report(spark, nodes, edges)


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all trees of either kind, stored: what follows reads them more than once."""
    found = files.read_trees(spark, path).where("_bad is null")  # a broken file stops no other
    a, b = trees.report_graph(found.where("framework = 'BRSR'")), trees.standard_graph(found.where("framework = 'GRI'"))
    return checkpoint(a[0].unionByName(b[0]).dropDuplicates(["uri"])), checkpoint(a[1].unionByName(b[1]).distinct())


def align_trees(spark: SparkSession, path: str, out: str, blocked: bool = False) -> DataFrame:
    """The mappings between the two frameworks' concepts as files; returns how often each relation occurs."""
    nodes, edges = ontology(spark, path)
    concepts = trees.concepts(nodes, edges)
    found = align.align(concepts.where("framework = 'BRSR'"), concepts.where("framework = 'GRI'"), blocked=blocked)
    sinks.write_json(found, f"{out}/mappings")
    sinks.write_flat_csv(spark.read.json(f"{out}/mappings"), f"{out}/summary")
    return evaluate.value_counts(found, "relationship").orderBy(F.desc("count"), "relationship")


def agreement(spark: SparkSession, path: str, truth: str) -> DataFrame:
    """Rates and confusion of every annotator (JSON lines: model, decisions) against one as the truth."""
    d = evaluate.decisions_long(spark.read.schema("model string, decisions array<string>").json(path))
    return evaluate.agreement_rates(d).join(evaluate.confusion(evaluate.aligned(d), truth), "model").orderBy("model")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="verdanta", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["ingest", "graph", "ontology", "align", "evaluate"])
    p.add_argument("paths", nargs="*")
    for name in ("warehouse", "out", "truth"):
        p.add_argument(f"--{name}")
    p.add_argument("--force", action="store_true")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--blocked", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.getActiveSession() or session()
    if a.command == "ingest":
        ingest(spark, a.paths, a.warehouse, a.force, a.fresh).show(truncate=False)
    elif a.command == "graph":
        report = build_graph(spark, a.warehouse, a.out)
        report.show(truncate=False, vertical=True)
        return int(report.first().status != "PASSED")
    elif a.command == "ontology":
        nodes, edges = ontology(spark, a.paths[0])
        sinks.write_triples(trees.base_triples(spark).unionByName(trees.triples(nodes, edges)), f"{a.out}/triples")
        sinks.write_flat_csv(nodes, f"{a.out}/nodes")
        sinks.write_flat_csv(edges, f"{a.out}/edges")
    elif a.command == "align":
        align_trees(spark, a.paths[0], a.out, a.blocked).show(truncate=False)
    else:
        agreement(spark, a.paths[0], a.truth).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
