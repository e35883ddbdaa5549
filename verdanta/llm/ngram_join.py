r"""N-gram Jaccard join: documents linked when their shingle sets overlap enough, by a prefix-tree join.

Sets are kept in one global order: shingles that a batch of documents has often
come last, by how often; all others come by hash, at random. If two sets have a
Jaccard similarity of at least t, the first p = n - ceil(t n) + 1 shingles of
each share one. Of the at most p - 1 shingles that are not common, the random
part of the order rarely brings many to the front, so the prefixes share far
more than one: ``least_shared`` is the number that all but one in 1e10 linked
sets share (one, where the random part is short), as counted in the prefix of
the smallest possible partner. A set with fewer shingles in other sets' prefixes
is not compared. This leaves out the documents that share
no more than some lines or passages with others.

Comparisons run in groups of bounded size. A group's sets are stored in a trie
(a radix tree over the global order), and a query set is sent down from the
root: the overlap with a node's run is counted once for all sets below it, and a
subtree is left when the overlap so far plus all that remains can't reach what
the similarity needs.

Only components are asked for, so no group of near copies makes all its pairs:
1. Equal sets are one set (each row is counted, one set is compared).
2. In each of a few rounds, every set is compared with one hub: of the sets that
   a hash singles out for its prefix shingles, the one it shares most with and
   is not connected with. Near copies are linked here, in blocks of at most
   ``block`` sets around a hub, however large their group. After a round only
   shingles that join different components are left, and only sets that have
   enough of these.
3. The sets that are left are gathered into areas: two sets are in one area if
   they share a band of MinHash values, or through others that do; there are so
   many bands that linked sets miss each other with a chance under 1e-10. Within
   an area sets are compared block by block, every block with every other,
   passing over pairs that are in one component already.

Links and components stay distributed; the driver only gets the frequent
shingles of the order, at most ``ORDERED``. Shingles and nodes that hold over a
thousandth of the rows of a join are joined by broadcast. Words and sets are
known by 64-bit hashes.

Defined results: a null, empty or blank text has an empty set and is linked with
nothing; a text of fewer words than a shingle has one shingle, all its words; a
very long text is one set like any other. Repeated rows are linked. A null doc_id
counts as the largest. An empty table gives no rows. Extra columns are left out,
and come through ``keep_one`` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.llm import bitmaps
from verdanta.llm.cluster import checkpoint, join_hot, least_of_top, release, settled, short_batches, written
from verdanta.llm.components import connected
from verdanta.llm.textbatch import mix, shingles, text_chunks, word_hashes

WIDTH = 4
PERCENT = 85
#: Sets of a block that is compared in one task.
BLOCK = 256
#: Rounds of comparisons with hubs before the rest is compared block by block.
ROUNDS = 2
#: Hashes that a band of the areas' signatures joins, and the chance that two linked sets share no band.
BAND, RISK = 8, 1e-10
#: A shingle is frequent if a batch has it in so many documents, and in so large a share of them.
FREQUENT, FREQUENT_SHARE = 4, 0.001
#: Frequent shingles that the order knows of; the order of the rest is by hash, which changes no result.
ORDERED = 1 << 16


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """The overlap that sets of n and m shingles need: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def document_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each row's distinct shingles, ascending."""
    for a, b, data, offsets in text_chunks(column):
        hashes, _, _, bounds = word_hashes(data, offsets)
        values, at = shingles(hashes, bounds, width)
        for i in range(b - a):
            yield np.unique(values[at[i] : at[i + 1]])


def set_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


class SetTrie:
    """A radix tree of ordered sets."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
        self.root = self._node([i for i in order if len(sets[i])], 0)

    def _node(self, members: list[int], depth: int):
        """(run, depth after it, largest size below, sets that end here, children)."""
        root = (np.zeros(0, np.uint64), depth, max((len(self.sets[i]) for i in members), default=0), [], [])
        stack = [(root, members)]
        while stack:
            node, own = stack.pop()
            at, a = node[1], 0
            while a < len(own):
                first = self.sets[own[a]]
                if len(first) == at:
                    node[3].append(own[a])
                    a += 1
                    continue
                b = a + 1
                while b < len(own) and len(self.sets[own[b]]) > at and self.sets[own[b]][at] == first[at]:
                    b += 1
                last = self.sets[own[b - 1]]
                n = min(len(first), len(last))
                differ = np.flatnonzero(first[at:n] != last[at:n])
                end = at + int(differ[0]) if len(differ) else n
                child = (first[at:end], end, max(len(self.sets[i]) for i in own[a:b]), [], [])
                node[4].append(child)
                stack.append((child, own[a:b]))
                a = b
        return root

    def similar(self, query: np.ndarray, percent: int = PERCENT) -> list[int]:
        """The sets that are similar to ``query`` (ascending values)."""
        found, m = [], len(query)
        if not m:
            return found
        stack = [(self.root, 0)]
        while stack:
            (_, depth, _, ends, children), overlap = stack.pop()
            for i in ends:
                if overlap >= need(len(self.sets[i]), m, percent):
                    found.append(i)
            for child in children:
                run, below, largest = child[0], child[1], child[2]
                if 100 * largest < percent * m or overlap + largest - depth < need(largest, m, percent):
                    continue
                at = np.minimum(np.searchsorted(query, run), m - 1)
                met = overlap + int((query[at] == run).sum())
                if met + largest - below >= need(largest, m, percent):
                    stack.append((child, met))
        return found


class Order:
    """The global order of shingles."""

    def __init__(self, frequent: list[tuple[int, int]]) -> None:
        keys = np.array([k for k, _ in frequent], np.int64).astype(np.uint64)
        counts = np.array([c for _, c in frequent], np.int64)
        by = np.argsort(keys)
        self.keys, self.counts = keys[by], counts[by]

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, int]:
        """Ascending ``values`` in the global order, and how many of them are not frequent."""
        if not len(self.keys) or not len(values):
            return values, len(values)
        at = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
        often = np.where(self.keys[at] == values, self.counts[at], 0)
        rest = int(np.count_nonzero(often))
        return (values[np.lexsort((values, often))], len(values) - rest) if rest else (values, len(values))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


@lru_cache(100_000)
def least_shared(n: int, plain: int, percent: int = PERCENT, risk: float = 1e-10) -> int:
    """How many shingles the prefixes of a set of n and any linked set share, but for a chance of ``risk``.

    ``plain`` of the n shingles are in random order. Shingles of both sets that
    are among the first m of the union are in both prefixes, if m is the shorter
    prefix, which the smallest partner has. Of the union's random part at least
    ``common`` shingles are in both sets, and at most ``others`` in one, so the
    number among the first m is at least hypergeometric.
    """
    m = prefix_length(-(-percent * n // 100), percent)
    common, others = plain - (100 - percent) * n // 100, (100 - percent) * n // percent
    if common <= 0:
        return 1
    total = common + others
    m = min(m, total)
    low = max(0, m - others)
    k = np.arange(low, min(m, common))
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    first = log(common, low) + log(others, m - low) - log(total, m)
    steps = np.log((common - k) * (m - k) / ((k + 1) * (others - m + k + 1)))
    tail = np.cumsum(np.exp(first + np.concatenate([[0.0], np.cumsum(steps)])))
    return max(1, low + int(np.searchsorted(tail, risk, side="right")))


def _summaries(docs: DataFrame, text: str, doc_id: str, width: int) -> DataFrame:
    """Per row (doc_id, row_key, n, sid): the size of its set and the set's hash; besides, rows (tok, often) of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row_key", "n", "sid", "tok", "often"]
        for batch in batches:
            sizes, sids, parts = [], [], []
            for values in document_sets(batch.column(1), width):
                sizes.append(len(values))
                sids.append(set_id(values) if len(values) else None)
                parts.append(values)
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sids, pa.int64()), none, none], names=names)
            every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            del parts
            edge = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
            counts = np.diff(np.append(edge, len(every)))
            often = counts >= max(FREQUENT, FREQUENT_SHARE * len(sizes))
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(every[edge[often]].astype(np.int64)), pa.array(counts[often], pa.int64())], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(run, "doc_id long, row_key long, n long, sid long, tok long, often long")


def _prefixes(docs: DataFrame, text: str, width: int, percent: int, order) -> DataFrame:
    """(tok, sid, least) for the shingles of each row's prefix; least is how many of them a partner shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = Order(order.value)
        for batch in batches:
            toks, sids, least = [], [], []

            def out() -> pa.RecordBatch:
                lengths = np.array([len(t) for t in toks])
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).astype(np.int64)), pa.array(np.repeat(np.array(sids, np.int64), lengths)), pa.array(np.repeat(np.array(least, np.int32), lengths))], names=["tok", "sid", "least"])

            for values in document_sets(batch.column(0), width):
                if len(values):
                    p = prefix_length(len(values), percent)
                    in_order, plain = ordered(values)
                    toks.append(in_order[:p])
                    sids.append(set_id(values))
                    least.append(least_shared(len(values), plain, percent))
                if len(toks) == 500:
                    yield out()
                    toks, sids, least = [], [], []
            if toks:
                yield out()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "tok long, sid long, least int")


def _sets(docs: DataFrame, text: str, width: int, order) -> DataFrame:
    """(sid, set): each row's set in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = Order(order.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                found = [v for v in document_sets(batch.column(0).slice(a, 500), width) if len(v)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(v) for v in found], pa.int64()), pa.array([ordered(v)[0].tobytes() for v in found], pa.binary())], names=["sid", "set"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "sid long, set binary")


def _enough(members: DataFrame) -> DataFrame:
    """The rows of sets that have enough shingles left."""
    good = settled(members.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).where("n >= least").select("sid", "n"))
    return join_hot(members, good, ["sid"], "n", "left_semi")  # a very long document has very many shingles


def _open(members: DataFrame) -> DataFrame:
    """The rows (tok, sid, least, comp) of shingles that join different components, of sets that have enough of them."""
    for _ in range(2):
        met = settled(members.groupBy("tok").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("tok", "n"))
        members = settled(_enough(join_hot(members, met, ["tok"], "n", "left_semi")))
    return members


def _bands(sets: DataFrame, percent: int) -> DataFrame:
    """(band, sid): hashes of bands of MinHash values of whole sets."""
    bands = math.ceil(math.log(RISK) / math.log(1 - (percent / 100) ** BAND))
    seeds = (np.random.default_rng(17).integers(0, 1 << 63, (bands, BAND), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part, out = batch.slice(a, 200), []
                for x in part.column(1):
                    values = np.frombuffer(x.as_py(), np.uint64)
                    least = np.concatenate([(values[:, None] * seeds[k : k + 8].ravel()[None, :]).min(0) for k in range(0, bands, 8)])
                    joined = number
                    for column in least.reshape(bands, BAND).T:
                        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) ^ column)
                    out.append(joined)
                sids = np.repeat(part.column(0).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).astype(np.int64)), pa.array(sids)], names=["band", "sid"])

    return sets.select("sid", "set").mapInArrow(run, "band long, sid long")


def _compare(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between a group's stored sets and its query sets.

    ``groups`` has (g, h, sid, stored, query, comp): the stored sets of group
    (g, h) go into its trie, the query sets down it; of two sets in one
    component (comp) the link is not looked for.
    """

    def run(table: pa.Table) -> pa.Table:
        sid = table.column("sid").to_numpy()
        comp = table.column("comp").to_numpy()
        stored, query = table.column("stored").to_numpy(zero_copy_only=False), table.column("query").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        inside = np.flatnonzero(stored)
        trie = SetTrie([sets[i] for i in inside])
        us, vs = [], []
        for q in np.flatnonzero(query):
            for k in trie.similar(np.sort(sets[q]), percent):
                if comp[inside[k]] != comp[q]:
                    us.append(sid[q])
                    vs.append(sid[inside[k]])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return groups.join(sets, "sid").groupBy("g", "h").applyInArrow(run, "u long, v long")


def similar_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, row_key (a hash of doc_id and text)."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = checkpoint(_summaries(docs, text, doc_id, width))
    often = rows.where("tok is not null").groupBy("tok").agg(F.sum("often").alias("often"))
    often = checkpoint(often)
    least = least_of_top(often, "often", ORDERED)
    order = spark.sparkContext.broadcast([tuple(r) for r in often.where(F.col("often") >= least).collect()])  # at most ORDERED pairs
    rows = rows.where("tok is null").select("doc_id", "row_key", "n", "sid")

    prefixes, delete = written(_prefixes(docs, text, width, percent, order))
    shared = checkpoint(prefixes.groupBy("tok").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("tok", "n"))
    members = join_hot(bitmaps.maybe_in(prefixes, shared, "tok"), shared, ["tok"], "n", "left_semi").distinct()
    members = checkpoint(members.withColumn("comp", F.col("sid")))
    delete()
    members = _open(members)
    wanted = members.select("sid").distinct()
    sets = bitmaps.maybe_in(_sets(docs, text, width, order), wanted, "sid").join(wanted, "sid", "left_semi")
    release(spark)
    sets = settled(sets.groupBy("sid").agg(F.first("set").alias("set")), 5000)

    links = spark.createDataFrame([], "u long, v long")
    for k in range(ROUNDS):
        # for each shingle the set that this round's hash puts first; for each set the hub that it shares most with
        first = members.groupBy("tok").agg(F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("h"), "sid", "comp")).alias("f"), F.count(F.lit(1)).alias("n"))
        first = settled(first.select("tok", F.col("f.sid").alias("g"), F.col("f.comp").alias("g_comp"), "n"))
        hubs = join_hot(members, first, ["tok"], "n").where("comp <> g_comp").groupBy("sid", "comp", "g", "g_comp").agg(F.count(F.lit(1)).alias("c"))
        hubs = settled(hubs.groupBy("sid", "comp").agg(F.max(F.struct("c", "g", "g_comp")).alias("best")).select("sid", "comp", "best.g", "best.g_comp"))
        if hubs.isEmpty():
            break
        parts = hubs.groupBy("g", "g_comp").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
        stored = hubs.join(parts, ["g", "g_comp"]).select("g", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("long").alias("h"), "sid", F.lit(True).alias("stored"), F.lit(False).alias("query"), "comp")
        asked = parts.select("g", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("h"), F.col("g").alias("sid"), F.lit(False).alias("stored"), F.lit(True).alias("query"), F.col("g_comp").alias("comp"))
        new = settled(_compare(stored.unionByName(asked), sets, percent))
        if new.isEmpty():
            continue
        links = links.unionByName(new)
        comps = settled(connected(links)).withColumnRenamed("id", "sid")
        own = members.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).join(comps, "sid", "left")
        own = settled(own.select("sid", F.coalesce("component", "sid").alias("comp"), "n"))
        members = _open(join_hot(members.drop("comp"), own, ["sid"], "n"))
        release(spark)

    # sets whose prefixes still join different components
    rest = members.select("sid", "comp").distinct()
    bands = settled(_bands(sets.join(rest.select("sid"), "sid", "left_semi"), percent))
    start = bands.groupBy("band").agg(F.min("sid").alias("v"), F.max("sid").alias("high")).where("v <> high").select("band", "v")
    near = bands.join(start, "band").select(F.col("sid").alias("u"), "v").distinct()
    areas = settled(connected(near).select(F.col("id").alias("sid"), F.col("component").alias("g")).join(rest, "sid"))
    parts = areas.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    cut = areas.join(parts, "g").withColumn("mine", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("long"))
    # a block meets every block: as the stored one where its number is the smaller
    met = cut.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1L)")))
    pairs = met.select("g", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).alias("h"), "sid", (F.col("mine") <= F.col("other")).alias("stored"), (F.col("mine") >= F.col("other")).alias("query"), "comp")
    links = links.unionByName(settled(_compare(pairs, sets, percent)))
    comps = connected(links).withColumnRenamed("id", "sid")

    first = rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = first.join(comps, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).where("size > 1")
    named = settled(named.join(least, "component").select("sid", "component_id"))
    out = rows.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "row_key")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest; rows equal in doc_id and text stay together."""
    found = similar_components(docs, text, doc_id, **options)
    gone = checkpoint(found.where("doc_id is null and component_id is not null or doc_id <> component_id").select(F.col("row_key").alias("_key")).distinct())
    # a row goes through the filter as one value, so no column of it can clash
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).alias("_key"))
    maybe, rest = bitmaps.split(rows, gone, "_key")  # only rows that may go are shuffled
    return rest.unionByName(maybe.join(gone, "_key", "left_anti")).select("_row.*")


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 4 then [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as u, b.doc_id as v from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))
), r as (
  select doc_id as id, doc_id as reach from documents
  union
  select r.id, p.v from r join p on r.reach = p.u
), c as (
  select id, min(reach) as component_id from r group by id
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.id = d.doc_id
"""
