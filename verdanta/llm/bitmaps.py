"""A Bloom filter with one hash, in DataFrame functions: bitmaps over 2**bits positions.

The number of positions follows the number of keys, up to ``MOST_BITS``: a packed
filter has at most 2**MOST_BITS / 8 bytes (32 MB), so it is safe to broadcast.
With ``PER_KEY`` positions for each key about one in ``PER_KEY`` other rows passes
for nothing; a second hash would halve that for twice the work of packing. A
fuller filter lets more rows pass; it never loses one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import checkpoint

MOST_BITS, PER_KEY = 28, 16
#: A bitmap function of Spark packs 2**15 positions into one value.
BUCKET_BITS = 15


def bits_for(keys: int, most: int = MOST_BITS) -> int:
    return min(most, max(BUCKET_BITS, (PER_KEY * keys - 1).bit_length()))


def with_position(rows: DataFrame, *keys: str, bits: int) -> DataFrame:
    return rows.withColumn("_at", F.xxhash64(*keys).bitwiseAND(F.lit((1 << bits) - 1)))


def pack(positions: DataFrame) -> DataFrame:
    """The filter of the column ``_at``."""
    bucket = F.shiftright("_at", BUCKET_BITS).cast("int").alias("_bucket")
    return checkpoint(positions.groupBy(bucket).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))).alias("_map")))


def tested(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """``rows`` (with ``_at``) and a boolean ``_in``: whether the filter may have them."""
    inner = F.col("_at").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.shiftright(inner, 3) + 1, F.lit(1))), 16, 10).cast("int")
    found = F.getbit(byte, inner.bitwiseAND(F.lit(7))) == 1
    joined = rows.withColumn("_bucket", F.shiftright("_at", BUCKET_BITS).cast("int")).join(F.broadcast(maps), "_bucket", "left")
    return joined.withColumn("_in", F.coalesce(found, F.lit(False))).drop("_bucket", "_map", "_at")


def split(rows: DataFrame, others: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys may be among those of ``others``, rows whose keys certainly are not)."""
    bits = bits_for(others.count())
    maps = pack(with_position(others.select(*keys), *keys, bits=bits).select("_at").distinct())
    both = tested(with_position(rows, *keys, bits=bits), maps)
    return both.where("_in").drop("_in"), both.where("not _in").drop("_in")


def maybe_in(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys may be among those of ``others``: a filter before a shuffled join."""
    return split(rows, others, *keys)[0]


def possibly_repeated(rows: DataFrame, *keys: str, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys may occur again, rows whose keys certainly do not)."""
    at = with_position(rows, *keys, bits=bits)
    maps = pack(at.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    both = tested(at, maps)
    return both.where("_in").drop("_in"), both.where("not _in").drop("_in")
