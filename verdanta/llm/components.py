"""Connected components of links, in DataFrame functions: alternating small and large stars.

Every round replaces the links of a node by links to its smallest neighbour,
first for the smaller neighbours, then for the larger ones, until each component
is a star around its smallest node. Neighbours are summed (a minimum) before
they shuffle, and nodes with over a thousandth of the links are joined by
broadcast, so a node with very many links is no hot group. Each round ends in a
reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import checkpoint, join_hot

#: Links of a task.
ROWS = 100_000


def _stars(links: DataFrame) -> bool:
    """Whether every u has one link, and none of them is the v of another."""
    n, distinct = links.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == distinct and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (columns u, v of whole numbers): component is the smallest node."""
    links = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = checkpoint(links)
    while not _stars(links):
        parts = -(-links.count() // ROWS)  # few links need few tasks
        links = links.coalesce(parts)
        # small stars first: a node's other neighbours are few distinct hubs, so the large stars have fewer links
        low = checkpoint(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(parts))
        small = join_hot(links, low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        small = checkpoint(small.where("u <> v").coalesce(2 * parts).distinct().coalesce(parts))
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n").coalesce(parts))
        large = join_hot(both.where("v > u"), low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = checkpoint(large.coalesce(parts).distinct().coalesce(parts))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
