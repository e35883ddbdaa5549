"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 hashes every row to a position of a filter and packs the positions met by
two rows or more into bitmaps. Pass 2 tests every row against the bitmaps: a row
whose position was met once cannot have an equal and passes straight through;
only the possibly repeated rows shuffle, as digests, never as texts.

The filter has 16 positions a row, so about one in 16 unrepeated rows is shuffled
for nothing, at any size of input. Its size is bounded by ``filter_bits`` (2**30
bits are 128 MB), so that it can be broadcast. Where that is too few for all rows
(over 67 million), the digests are written once by ranges of their hash, and each
range goes through both passes with a filter of its own.

A group of any size is summed before it shuffles. The few groups that hold over
a thousandth of the repeated rows (so there are under 1,000) are joined by
broadcast, so a hot group never meets in one task.

Defined results: a null text counts as empty and all empty texts are equal; of
equal texts the one with the most code points stays, then the smallest doc_id
(a null doc_id comes last); rows equal in doc_id and text too are all kept or
all dropped together; a very long text is one digest like any other. An empty
table gives an empty result. Other columns are left out, so their names can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.llm import bitmaps
from verdanta.llm.cluster import checkpoint, join_hot, written

#: A filter has at most 2**FILTER_BITS positions.
FILTER_BITS = 30
#: The characters that the comparison ignores: [\x20\x09-\x0D].
IGNORED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), IGNORED, "")


def _found(rows: DataFrame, bits: int) -> DataFrame:
    """Both passes over digests (doc_id, key, points): each with its group's size and the row that stays."""
    maybe, single = bitmaps.possibly_repeated(rows, "key", bits=bits)
    maybe = checkpoint(maybe)
    best = F.min(F.struct((-F.col("points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    groups = maybe.groupBy("key").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))
    groups = checkpoint(groups.select("key", "group_size", F.col("best.c").alias("keep_id"), (-F.col("best.a")).alias("keep_points"), F.col("group_size").alias("n")))
    single = single.select("doc_id", "key", "points", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points"))
    return single.unionByName(join_hot(maybe, groups, ["key"], "n"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    whole = F.col(text).cast("string")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(whole).cast("binary"), 256)).alias("key"),
        F.coalesce(F.char_length(whole), F.lit(0)).cast("long").alias("points"),
    )
    rows = checkpoint(rows)  # digests only: the texts are read once
    n = rows.count()
    ranges = max(1, -(-bitmaps.PER_KEY * n >> filter_bits))
    if ranges == 1:
        found = _found(rows, bitmaps.bits_for(n, filter_bits))
    else:
        stored, delete = written(rows.withColumn("_range", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(ranges))), "_range")
        parts = [written(_found(stored.where(F.col("_range") == k).drop("_range"), filter_bits))[0] for k in range(ranges)]
        delete()
        found = reduce(DataFrame.unionByName, parts)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("key")).alias("text_sha256"))


ORACLE = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents
), w as (
  select *, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id asc nulls last) as keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from w
"""
