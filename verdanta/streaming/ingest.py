"""Incremental ingest: filings as a file stream into the warehouse, and (an extension) windowed event counts.

The file source's checkpoint is the ledger of what was read; each micro-batch
replaces the (company, year) partitions that it has, so a batch that runs twice
leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdanta.functions.normalize import normalize
from verdanta.operators import facts as ops
from verdanta.operators.validate import validate
from verdanta.sources import filings, sinks


def facts_of_files(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Files (path, content) to stored-form facts: parsed, bound, named, typed, validated."""
    from verdanta.operators.shared import checkpoint

    rows = checkpoint(filings.parse(files))  # three kinds are read from one pass over the files
    raw, contexts = filings.facts(rows), ops.last_contexts(filings.contexts(rows))
    bound = ops.bind_contexts(raw, contexts)
    named = bound.join(ops.company_names(raw), "source_file", "left").join(ops.report_years(raw, contexts), "source_file", "left")
    return validate(normalize(named, cache))


def ingest(spark: SparkSession, folder: str, warehouse: str) -> DataFrame:
    """One batch over a folder: write what is there, and return the facts."""
    facts = facts_of_files(filings.find_files(spark, folder))
    sinks.write_facts(facts, warehouse)
    return facts


def ingest_stream(spark: SparkSession, folder: str, warehouse: str, checkpoint: str) -> StreamingQuery:
    """Every new filing of a folder into the warehouse, until all that is there was read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", filings.PATTERNS).option("recursiveFileLookup", True).load(folder)
    write = lambda batch, _: sinks.write_facts(facts_of_files(batch.select("path", "content")), warehouse)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Extension: events (ts, event_type, value) counted and summed in tumbling windows, with a watermark; batch or stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
