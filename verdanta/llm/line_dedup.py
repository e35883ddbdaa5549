r"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is compared trimmed and in lower case. Two lines are copies when they are
equal or, with 20 characters or more, one edit apart (a character inserted,
deleted or replaced). An occurrence goes when an earlier occurrence of a copy
exists; documents come by doc_id, lines by their place. Lines of under 10
characters are left alone.

How near copies are found:
1. Only digests of lines shuffle, and only those whose hash may occur again (a
   filter of bitmaps tells); equal lines are summed to their first occurrence.
2. Two lines one edit apart, the shorter of length s, agree in their first or
   their last s/2 characters (rounded down). Only lines that share such a half with another
   distinct line are live; most lines end here.
3. Live lines are cut into blocks; only a block whose whole rest is shared with
   another live line can hold the edit.
4. For such blocks, lines emit every variant within the bound as a hashed key:
   the line itself and, for each place i, the line without its i-th character.
   Equal variants are joined without making pairs within a group: lines with the
   same (variant, i) differ by a replacement at i, so the earliest of the group
   stands for all; a line that equals a variant is one deletion away from every
   line that emits it.
5. Each found pair (line, earliest partner) is verified by edit distance.

Groups of any size are summed before they shuffle; the few lines that hold over a
thousandth of all repeated occurrences are joined by broadcast. Whole texts
shuffle only where a filter says that the document may lose a line.

Defined results: a null text has no lines and stays null; an empty text stays; a
row stays even if all its lines go (its text is then empty); a very long text or
line is treated whole. A null doc_id comes last. Rows equal in doc_id count as
one document: of equal lines at the same place none is earlier. An empty table
gives no rows. All columns of ``docs`` come back, but for those that are called
n_lines or n_dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.llm import bitmaps
from verdanta.llm.cluster import checkpoint, join_hot

MIN_CHARS = 10
NEAR_CHARS = 20
#: White space that is trimmed off a line.
BLANKS = " \t\x0b\x0c\r"


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line that counts: its document, its place, its compared form and two hashes of that."""
    lines = rows.select("_id", "_key", F.posexplode(F.split("_text", "\n")).alias("_pos", "_raw"))
    lines = lines.select("_id", "_key", "_pos", F.lower(F.btrim("_raw", F.lit(BLANKS))).alias("_norm"))
    lines = lines.withColumn("_len", F.char_length("_norm")).where(F.col("_len") >= MIN_CHARS)
    return lines.withColumns({"_a": F.xxhash64("_norm"), "_b": F.xxhash64("_norm", F.lit(1))})


def _halves() -> Column:
    """Keys of the first and last halves, their length rounded down to a multiple of 4.

    A line also gives the keys of a line shorter by one, where these differ; so
    whichever of a pair is the shorter, both have the keys of its length.
    """
    keys = []
    for k in (1, 2):
        half = F.floor((F.col("_len") - k) / 8).cast("int") * 4
        pair = (F.xxhash64(F.lit(0), F.left("_norm", half)), F.xxhash64(F.lit(1), F.right("_norm", half)))
        keys += pair if k == 1 else [F.when(F.col("_len") % 8 == 1, x) for x in pair]
    return F.when(F.col("_len") >= NEAR_CHARS, F.array_compact(F.array(*keys)))


def _order() -> Column:
    """Documents by id (a null one last), then lines by place."""
    return F.struct(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("i"), F.col("_pos").alias("p"))


def _blocks(texts: DataFrame) -> DataFrame:
    """For each live line and each block of it that one edit may lie in: a key of all the rest.

    A line of length n stands for the shorter or equal one of a pair (s = n) and
    for the longer one (s = n - 1). Blocks are cut by s: 16 characters, or more
    where that would be over 64 blocks. The longer one's block has one character
    more, so what follows the block is aligned.
    """
    sides = texts.select("_a", "_b", "_norm", F.explode(F.array(F.lit(False), F.lit(True))).alias("_longer"))
    sides = sides.withColumn("_s", F.char_length("_norm") - F.col("_longer").cast("int"))
    sides = sides.withColumn("_width", F.greatest(F.lit(16), F.ceil(F.col("_s") / 64)).cast("int"))
    parts = sides.withColumn("_start", F.explode(F.expr("sequence(0, _s - 1, _width)")))
    parts = parts.withColumn("_size", F.least(F.col("_width"), F.col("_s") - F.col("_start")) + F.col("_longer").cast("int"))
    place = F.xxhash64("_s", "_start", F.expr("substring(_norm, 1, _start)"), F.expr("substring(_norm, _start + _size + 1)"))
    return parts.select("_a", "_b", "_longer", "_start", "_size", place.alias("_place"))


def _near(digests: DataFrame, lines: DataFrame) -> DataFrame:
    """(_a, _b, cut): for lines with an earlier near copy, the order of the earliest."""
    keys = digests.where("_halves is not null").select("_a", "_b", F.explode("_halves").alias("_half"))
    shared = keys.groupBy("_half").agg(F.min("_a").alias("_low"), F.max("_a").alias("_high")).where("_low <> _high").select("_half")
    shared = checkpoint(shared)
    live = checkpoint(bitmaps.maybe_in(keys, shared, "_half").join(shared, "_half", "left_semi").select("_a", "_b").distinct())
    texts = bitmaps.maybe_in(lines.where(F.col("_len") >= NEAR_CHARS), live, "_a", "_b")
    texts = texts.groupBy("_a", "_b").agg(F.min(_order()).alias("_first"), F.min("_norm").alias("_norm"))  # before the join: a line may be hot
    texts = checkpoint(texts.join(live, ["_a", "_b"], "left_semi"))
    blocks = _blocks(texts)
    met = blocks.groupBy("_place").agg(F.min("_a").alias("_low"), F.max("_a").alias("_high")).where("_low <> _high").select("_place")
    hot = checkpoint(blocks.join(met, "_place", "left_semi"))
    hot = hot.join(texts, ["_a", "_b"]).select(F.struct("_first", "_a", "_b").alias("_me"), "_place", "_longer", F.expr("substring(_norm, _start + 1, _size)").alias("_part"))
    own = hot.where("not _longer").select(F.col("_me").alias("_own"), F.xxhash64("_place", "_part").alias("_v"))
    less = hot.select("_me", "_place", "_longer", "_part", F.explode(F.sequence(F.lit(1), F.char_length("_part"))).alias("_i"))
    less = less.select("_me", "_longer", "_i", F.xxhash64("_place", F.concat(F.expr("substring(_part, 1, _i - 1)"), F.expr("substring(_part, _i + 1)"))).alias("_v"))
    even = less.where("not _longer")
    best = even.groupBy("_v", "_i").agg(F.min("_me").alias("_hub"), F.max("_me").alias("_last")).where("_hub <> _last").select("_v", "_i", "_hub")
    pairs = even.join(best, ["_v", "_i"]).where("_me > _hub").select("_me", "_hub")
    deleted = less.where("_longer").join(own, "_v").select("_me", "_own")
    pairs = pairs.unionByName(deleted.where("_me > _own").select("_me", F.col("_own").alias("_hub")))
    pairs = pairs.unionByName(deleted.where("_me < _own").select(F.col("_own").alias("_me"), F.col("_me").alias("_hub")))
    pairs = pairs.distinct()
    left = texts.select("_a", "_b", F.col("_norm").alias("_x"))
    right = texts.select(F.col("_a").alias("_ha"), F.col("_b").alias("_hb"), F.col("_norm").alias("_y"))
    pairs = pairs.select("_me._a", "_me._b", F.col("_hub._a").alias("_ha"), F.col("_hub._b").alias("_hb"), F.col("_hub._first").alias("_cut"))
    near = pairs.join(left, ["_a", "_b"]).join(right, ["_ha", "_hb"]).where(F.levenshtein("_x", "_y", 1) >= 0)
    return near.groupBy("_a", "_b").agg(F.min("_cut").alias("_cut"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and the counts n_lines and n_dropped.

    Columns of ``docs`` named n_lines or n_dropped are replaced.
    """
    whole = F.col(text).cast("string")
    named = F.col(doc_id).cast("long")
    key = F.xxhash64(named, whole)
    rows = docs.select(named.alias("_id"), key.alias("_key"), whole.alias("_text"))
    lines = _lines(rows)
    digests = checkpoint(lines.select("_id", "_key", "_pos", "_a", "_b", _halves().alias("_halves")))
    repeated, _ = bitmaps.possibly_repeated(digests.select("_a", "_b", "_id", "_pos"), "_a", "_b", bits=bitmaps.bits_for(digests.count()))
    copies = repeated.groupBy("_a", "_b").agg(F.min(_order()).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cuts = copies.select("_a", "_b", F.col("_first").alias("_cut"), "_n").unionByName(_near(digests, lines).withColumn("_n", F.lit(1).cast("long")))
    cuts = checkpoint(cuts.groupBy("_a", "_b").agg(F.min("_cut").alias("_cut"), F.max("_n").alias("_n")))
    gone = join_hot(bitmaps.maybe_in(digests.select("_a", "_b", "_id", "_key", "_pos"), cuts, "_a", "_b"), cuts, ["_a", "_b"], "_n").where(_order() > F.col("_cut"))
    gone = checkpoint(gone.groupBy("_id", "_key").agg(F.collect_set("_pos").alias("_gone")))
    # only documents that may lose a line are shuffled; a row goes as one value, so no column of it can clash
    rows = docs.select(F.struct("*").alias("_row"), key.alias("_key"), named.alias("_id"))
    losing, clean = bitmaps.split(rows, gone, "_key")
    losing = losing.join(gone.withColumnsRenamed({"_key": "_gone_key", "_id": "_gone_id"}), F.col("_key").eqNullSafe(F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone_id")), "left")
    out = losing.select("_row", "_gone").unionByName(clean.select("_row", F.lit(None).cast("array<int>").alias("_gone")))
    whole = F.col("_row")[text].cast("string")
    parts = F.split(whole, "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    dropped = F.coalesce(F.array_size("_gone"), F.lit(0))
    fresh = {text.lower(): F.when(F.col("_gone").isNull(), whole).otherwise(kept)}
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own = [fresh.get(c.lower(), F.col("_row")[c]).alias(c) for c in names]
    return out.select(*own, F.coalesce(F.array_size(parts), F.lit(0)).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


ORACLE = r"""
with recursive l as (
  select doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) as pos,
         unnest(string_split(text, chr(10))) as raw
  from documents where text is not null
), n as (
  select doc_id, pos, raw, lower(trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))) as norm from l
), o as (
  select *, length(norm) as len, row_number() over (order by doc_id nulls last, pos) as ord from n
), d as (
  select norm, len, min(ord) as first from o where len >= 10 group by norm, len
), h as (
  select norm, first, s, side,
         case side when 0 then left(norm, (s // 2)::bigint) else right(norm, (s // 2)::bigint) end as half
  from (select norm, first, unnest([len, len - 1]) as s from d where len >= 20), (values (0), (1)) v(side)
), p as (
  select distinct x.norm, y.first from h x join h y on x.s = y.s and x.side = y.side and x.half = y.half
  where x.first > y.first and abs(length(x.norm) - length(y.norm)) <= 1 and levenshtein(x.norm, y.norm) <= 1
), c as (
  select d.norm, least(d.first, coalesce(min(p.first), d.first)) as cut from d left join p on d.norm = p.norm group by d.norm, d.first
), k as (
  select o.doc_id, o.pos, o.raw, coalesce(o.ord > c.cut, false) as gone from o left join c on o.norm = c.norm and o.len >= 10
)
select d.doc_id, coalesce(string_agg(k.raw, chr(10) order by k.pos) filter (not k.gone), case when d.text is null then null else '' end) as text,
       count(k.pos) as n_lines, coalesce(sum(k.gone::bigint), 0)::bigint as n_dropped
from documents d left join k on d.doc_id = k.doc_id group by d.doc_id, d.text
"""
