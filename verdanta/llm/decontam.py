r"""Benchmark decontamination by size-partitioned MinHash containment search.

Texts are compared as lower-case words (runs of letters, marks and digits). An
item's shingles are its runs of five words; an item of fewer words has one
shingle, all of them. A document is contaminated by an item if it contains at
least 0.8 of the item's distinct shingles.

The sketch of an item holds, for each of 64 permutations, its shingle of least
hash. For any set that contains a share c of the item, each of the 64 is in the
set with probability c, whatever the set's size: so short items are found inside
long documents, where the Jaccard similarity says nothing. Items are partitioned
by size (a power of two of shingles). A partition is searched only for documents
large enough to contain 0.8 of its smallest item. An item is a candidate if the
document has over ``threshold - margin`` of its sketch (an item at the threshold
is missed with probability under 1e-8), and is then verified: exact containment,
on the words themselves, over the whole document.

The index of a block of items has a bounded size (``block_words``) and is
broadcast; a larger benchmark is searched block by block. No document is
shuffled or collected. Defined results: a null or empty text contains nothing; a
very long text is searched whole; items without words match nothing; repeated
items are searched once and all reported; a null item_id is not listed, but its
item still contaminates; with an empty benchmark no document is contaminated;
without documents there are no rows; repeated documents have the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.llm.cluster import free_name, short_batches
from verdanta.llm.textbatch import mix, shingles, text_chunks, word_hashes

WIDTH = 5
THRESHOLD = 0.8
PERMUTATIONS = 64
MARGIN = 0.35
BLOCK_WORDS = 400_000
#: Bits of the first, coarse look-up of a shingle.
COARSE = 20


def words_of(text: Column) -> Column:
    """Lower-case words with one blank between."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


@dataclass
class Partition:
    """Items of one shingle width and size class."""

    width: int
    least: int  # shingles that the smallest item needs
    keys: np.ndarray = None  # sorted hashes of sketch shingles, one for each posting
    items: np.ndarray = None
    shares: np.ndarray = None  # of the item's permutations that this shingle is the least of
    coarse: np.ndarray = None


@dataclass
class Index:
    ids: list = field(default_factory=list)
    needles: list = field(default_factory=list)  # the item's distinct shingles, as text between blanks
    parts: list = field(default_factory=list)


def build_index(items: Sequence[tuple[list[int], str]], width: int = WIDTH, threshold: float = THRESHOLD) -> Index:
    index, groups = Index(), {}
    seeds = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for item_ids, text in items:
        words = text.split(" ") if text else []
        if not words:
            continue
        w = min(width, len(words))
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes, _, _, bounds = word_hashes(raw, np.array([0, len(raw)]))
        own = np.unique(shingles(hashes, bounds, w)[0])
        least = own[np.argmin(mix(own[None, :] ^ seeds[:, None]), axis=1)]
        keys, counts = np.unique(least, return_counts=True)
        index.ids.append(item_ids)
        index.needles.append(list(dict.fromkeys(f" {' '.join(words[i : i + w])} " for i in range(len(words) - w + 1))))
        groups.setdefault((w, len(own).bit_length()), []).append((len(index.ids) - 1, len(own), keys, counts / PERMUTATIONS))
    for (w, _), found in sorted(groups.items()):
        part = Partition(w, min(int(np.ceil(threshold * n - 1e-9)) for _, n, _, _ in found))
        keys = np.concatenate([k for _, _, k, _ in found])
        order = np.argsort(keys, kind="stable")
        part.keys = keys[order]
        part.items = np.concatenate([np.full(len(k), i) for i, _, k, _ in found])[order]
        part.shares = np.concatenate([s for _, _, _, s in found])[order]
        part.coarse = np.zeros(1 << COARSE, bool)
        part.coarse[part.keys >> np.uint64(64 - COARSE)] = True
        index.parts.append(part)
    return index


def candidates(index: Index, hashes: np.ndarray, bounds: np.ndarray, share: float) -> set[tuple[int, int]]:
    """(row, item) for which at least ``share`` of the item's sketch is in the row."""
    found, made = set(), {}
    for part in index.parts:
        if part.width not in made:
            made[part.width] = shingles(hashes, bounds, part.width)
        values, at = made[part.width]
        near = np.flatnonzero(part.coarse[values >> np.uint64(64 - COARSE)])
        if not len(near):
            continue
        key = values[near]
        low, high = np.searchsorted(part.keys, key, "left"), np.searchsorted(part.keys, key, "right")
        near, key, low, high = (x[high > low] for x in (near, key, low, high))
        row = np.searchsorted(at, near, side="right") - 1
        big = np.diff(at)[row] >= part.least
        _, first = np.unique(np.stack([row[big].astype(np.uint64), key[big]]), axis=1, return_index=True)
        row, low, high = row[big][first], low[big][first], high[big][first]
        n = high - low
        posting = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair, which = np.unique(np.repeat(row, n) * len(index.ids) + part.items[posting], return_inverse=True)
        weight = np.bincount(which, part.shares[posting], len(pair))
        found |= {divmod(int(p), len(index.ids)) for p in pair[weight >= share - 1e-9]}
    return found


def search(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with item_ids (array of the items found, ascending) and max_containment (0 if none).

    Columns of ``docs`` with these names are replaced.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).cast("long").alias("id"), words_of(F.col(item_text)).alias("words")).where("words <> ''")
    wanted = wanted.groupBy("words").agg(F.collect_set("id").alias("ids"))
    total = wanted.agg(F.sum(F.size(F.split("words", " "))).cast("long")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    kept = [c for c in docs.columns if c.lower() not in ("item_ids", "max_containment", "contaminated")]
    short_batches(spark)
    found, plain = None, words_of(F.col(f"`{text}`"))
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()
        index = spark.sparkContext.broadcast(build_index(sorted((sorted(r[1]), r[0]) for r in rows), width, threshold))
        found = _searcher(index, threshold)(plain) if found is None else _searcher(index, threshold)(plain, found)
    own = free_name(docs, "_found")
    out = docs.withColumn(own, found)
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{own}.{c}").alias(c) for c in ("item_ids", "max_containment", "contaminated")])


def _searcher(shared, threshold: float):
    """A function of the text's words, and of what the blocks before have found."""

    def searched(index: Index, plain: pa.Array, ids: list, best: list, bad: list) -> pa.Array:
        for a, _, data, offsets in text_chunks(plain) if index.ids else ():
            hashes, _, _, bounds = word_hashes(data, offsets)
            for row, item in sorted(candidates(index, hashes, bounds, threshold - MARGIN)):
                text = f" {plain[a + row].as_py()} "
                needles = index.needles[item]
                share = sum(x in text for x in needles) / len(needles)
                if share >= threshold - 1e-12:
                    bad[a + row] = True
                    best[a + row] = max(best[a + row], share)
                    ids[a + row] = sorted({*ids[a + row], *index.ids[item]})
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64()), pa.array(bad, pa.bool_())], ["item_ids", "max_containment", "contaminated"])

    @F.arrow_udf("item_ids array<long>, max_containment double, contaminated boolean")
    def first(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index: Index = shared.value
        for plain in columns:
            n = len(plain)
            yield searched(index, plain, [[] for _ in range(n)], [0.0] * n, [False] * n)

    @F.arrow_udf("item_ids array<long>, max_containment double, contaminated boolean")
    def later(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index: Index = shared.value
        for plain, before in columns:
            yield searched(index, plain, *(before.field(i).to_pylist() for i in range(3)))

    return lambda plain, before=None: first(plain) if before is None else later(plain, before)


ORACLE = r"""
with d as (
  select doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') as w from documents
), b as (
  select item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' ') as w from benchmark
), bs as (
  select distinct item_id, least(5, len(w)) as k, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) as s from b where w <> ['']
), bn as (
  select item_id, count(*) as n from bs group by item_id
), ds as (
  select distinct doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, (len(w) - k + 2)::bigint)]) as s
  from d, (select distinct k from bs) where w <> [''] and len(w) >= k
), m as (
  select ds.doc_id, bs.item_id, count(*) / any_value(bn.n) as c
  from ds join bs on ds.s = bs.s and ds.k = bs.k join bn on bs.item_id = bn.item_id
  group by ds.doc_id, bs.item_id having count(*) / any_value(bn.n) >= 0.8 - 1e-12
)
select d.doc_id, coalesce(string_agg(m.item_id, ',' order by m.item_id), '') as item_ids,
       coalesce(max(m.c), 0.0)::double as max_containment, count(m.item_id) > 0 as contaminated
from d left join m on d.doc_id = m.doc_id group by d.doc_id
"""
