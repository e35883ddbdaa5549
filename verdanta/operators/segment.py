"""Document layout: headings, the tree that blocks belong to, reading order, tables.

The sequential scan of a document becomes running maxima of marker positions:
a level is open if its last marker came after the last marker of every level
above. Windows are partitioned by parts of a document of about PART blocks; what
the parts before one hold (their rows, their last markers) is a small table that
is joined to it. So a task holds a bounded number of blocks, however long a
document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import strip, words_hit
from verdanta.operators.shared import checkpoint

ORDER = ["page_num", "y0", "x0", "seq"]
#: What blocks at the same place are ordered by: all that their class hangs on, so that places don't change from run to run.
TIES = ["text", "is_bold", "avg_font_size", "line_count"]
#: Blocks that a part of a document is to have, and that a task of a window is to read.
PART = 50_000
ROWS_A_TASK = 250_000
#: Pages of long documents that are broadcast at most.
MAX_PAGES = 500_000


def font_level(size: Column, bold: Column, lines: Column, text: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for least, level in V.FONT_LEVELS:
        out = out.when(bold & (size >= least), level)
    return out.when(bold & (lines <= 2) & (F.length(text) < 120), 4).otherwise(0)


def classify(blocks: DataFrame, standards: bool = False) -> DataFrame:
    """``blocks`` with heading_type ('' for body text), heading_level and heading_label.

    ``standards`` chooses the patterns of standards instead of those of reports.
    Patterns come before fonts.
    """
    blocks, t = blocks.withColumn("_stripped", strip(F.coalesce("text", F.lit("")))), F.col("_stripped")
    p = dict(V.STANDARD_HEADINGS if standards else V.HEADINGS)
    level = font_level(F.col("avg_font_size"), F.coalesce("is_bold", F.lit(False)), F.coalesce("line_count", F.lit(1)), F.col("text"))
    hit = lambda k: t.rlike(p[k])
    if standards:
        title = hit("gri_standard") & ((F.col("page_num") <= 3) | level.isin(1, 2))
        kinds = [
            ("gri_standard", title, 1, strip(F.left(t, F.lit(50)))),
            ("gri_disclosure", hit("gri_disclosure"), 2, strip(F.left(t, F.lit(50)))),
            ("gri_subsection", hit("gri_subsection"), 3, F.regexp_extract(t, p["gri_subsection"], 1)),
            ("gri_topic", hit("gri_topic"), 2, strip(F.left(t, F.lit(50)))),
        ]
    else:
        kinds = [
            ("section", hit("section"), 1, strip(F.left(t, F.lit(30)))),
            ("principle", hit("principle"), 2, F.concat(F.lit("Principle"), F.regexp_extract(t, p["principle"], 1))),
            ("essential", hit("essential"), 3, F.lit("Essential Indicators")),
            ("leadership", hit("leadership"), 3, F.lit("Leadership Indicators")),
            ("section_field", hit("section_field") & (F.length(t) < 100), 3, strip(F.left(t, F.lit(60)))),
            ("question", hit("question") & (F.length(t) > 20), 4, F.concat(F.lit("Q"), F.regexp_extract(t, p["question"], 1))),
        ]
    kinds.append(("font_based", level > 0, level, F.left(t, F.lit(80))))
    kind, depth, label = F.when(t == "", ""), F.when(t == "", 0), F.when(t == "", "")
    for name, test, n, text in kinds:
        kind, depth, label = kind.when(test, name), depth.when(test, n), label.when(test, text)
    return blocks.withColumns({"heading_type": kind.otherwise(""), "heading_level": depth.otherwise(0), "heading_label": label.otherwise("")}).drop("_stripped")


def headings(classified: DataFrame) -> DataFrame:
    return classified.where("heading_type <> ''")


def _dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` to tasks of ROWS_A_TASK rows, where the session's number of tasks is too small for that."""
    tasks = -(-rows // ROWS_A_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def in_order(blocks: DataFrame) -> DataFrame:
    """``blocks`` with pos: the place in reading order (page, top, left; the text and the fonts break ties).

    A document of more than PART blocks is cut into parts: pages in a row, and
    bands of equal height of a page that alone is longer. A block's place is that
    within its part and the number of blocks in the parts before.
    """
    order = [*ORDER, *[c for c in TIES if c in blocks.columns]]
    y, n = F.col("y0").cast("double"), F.col("n")
    pages = checkpoint(blocks.groupBy("doc", "page_num").agg(F.count(F.lit(1)).alias("n"), F.min(y).alias("low"), F.max(y).alias("high")))
    rows = pages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    by_doc = W.partitionBy("doc")
    before = lambda key: by_doc.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    long = pages.withColumns({"_all": F.sum("n").over(by_doc), "_before": F.coalesce(F.sum("n").over(before("page_num")), F.lit(0))}).where(F.col("_all") > PART)
    long = long.select(F.col("doc").alias("_d"), F.col("page_num").alias("_p"), F.floor(F.col("_before") / PART).alias("_first"), F.ceil(n / PART).alias("_bands"), F.col("low").alias("_low"), (F.col("high") - F.col("low")).alias("_height"))
    n_long = long.count()
    if not n_long:
        return _dealt(blocks, rows, "doc").withColumn("pos", F.row_number().over(by_doc.orderBy(*order)).cast("long"))
    # a page of n blocks has as many bands as it has parts, so its last band is no later than the next page's first
    whole = (F.col("_height") > 0) & (F.col("_height") < float("inf")) & y.isNotNull()
    band = F.when(whole, F.least(F.col("_bands") - 1, F.floor((y - F.col("_low")) / F.col("_height") * F.col("_bands")))).otherwise(0)
    df = blocks.join(F.broadcast(long) if n_long <= MAX_PAGES else long, F.col("doc").eqNullSafe(F.col("_d")) & F.col("page_num").eqNullSafe(F.col("_p")), "left")
    df = df.withColumn("_part", F.coalesce(F.col("_first") + band, F.lit(0)))
    parts = df.where("_first is not null").groupBy("doc", "_part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(F.col("doc").alias("_d"), F.col("_part").alias("_p"), F.sum("n").over(before("_part")).alias("_offset"))
    df = _dealt(df.drop("_d", "_p", "_first", "_bands", "_low", "_height"), rows, "doc", "_part")
    df = df.withColumn("pos", F.row_number().over(W.partitionBy("doc", "_part").orderBy(*order)).cast("long"))
    df = df.join(F.broadcast(parts), F.col("doc").eqNullSafe(F.col("_d")) & F.col("_part").eqNullSafe(F.col("_p")), "left")
    return df.withColumn("pos", F.col("pos") + F.coalesce("_offset", F.lit(0))).drop("_d", "_p", "_part", "_offset")


def _last(df: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each mark: the last pos up to a block where its test holds, -1 where there is none.

    Each part (pos by PART) is scanned alone; the last marks of the parts before come from a table of a row a part.
    """
    rows = df.count()
    df = df.withColumns({"_part": F.floor(F.col("pos") / PART)} | {name: F.when(test, F.col("pos")) for name, test in marks.items()})
    before = W.partitionBy("doc").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = df.groupBy("doc", "_part").agg(*[F.max(name).alias(name) for name in marks])
    parts = parts.select(F.col("doc").alias("_d"), F.col("_part").alias("_p"), *[F.max(name).over(before).alias(f"_{name}") for name in marks])
    parts = parts.where(F.coalesce(*[f"_{name}" for name in marks]).isNotNull())
    run = W.partitionBy("doc", "_part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    df = _dealt(df, rows, "doc", "_part").withColumns({name: F.max(name).over(run) for name in marks})
    df = df.join(F.broadcast(parts), F.col("doc").eqNullSafe(F.col("_d")) & F.col("_part").eqNullSafe(F.col("_p")), "left")
    return df.withColumns({name: F.coalesce(name, f"_{name}", F.lit(-1)) for name in marks}).drop("_d", "_p", "_part", *[f"_{name}" for name in marks])


def report_owners(classified: DataFrame, principle: str = "6") -> DataFrame:
    """Ordered blocks of reports with owner (pos of the heading that owns them, -1 for the document), owner_kind and skipped.

    Only one principle's content is kept: blocks after another one are skipped
    until the next section or that principle.
    """
    k = F.col("heading_type")
    number = F.regexp_extract(strip(F.coalesce("text", F.lit(""))), dict(V.HEADINGS)["principle"], 1)
    marks = {
        "last_section": k == "section",
        "last_wanted": (k == "principle") & (number == principle),
        "last_other": (k == "principle") & (number != principle),
        "last_group": k.isin("essential", "leadership"),
        "last_question": k == "question",
    }
    df = _last(classified, marks)
    s, p, x, g, q = (F.col(c) for c in marks)
    top = F.greatest(s, p, x)
    owner = F.when((q > top) & (q > g), q).when(g > top, g).when((p >= 0) & (p > s) & (p > x), p).otherwise(s)
    kind = F.when(owner == -1, "document").when(owner == q, "question").when(owner == g, "group").when(owner == p, "principle").otherwise("section")
    return df.withColumns({"owner": owner, "owner_kind": kind, "skipped": (x >= 0) & (x == top), "orphan_group": (g > top) & (top != p)}).drop(*marks)


def standard_owners(classified: DataFrame) -> DataFrame:
    """The same for standards: standard, then disclosure or topic, then requirement."""
    k = F.col("heading_type")
    marks = {"last_standard": k == "gri_standard", "last_disclosure": k.isin("gri_disclosure", "gri_topic"), "last_requirement": k == "gri_subsection"}
    df = _last(classified, marks)
    s, d, r = (F.col(c) for c in marks)
    owner = F.when((r > d) & (r > s), r).when(d > s, d).otherwise(s)
    kind = F.when(owner == -1, "document").when(owner == r, "requirement").when(owner == d, "disclosure").otherwise("standard")
    return df.withColumns({"owner": owner, "owner_kind": kind}).drop(*marks)


def owned_text(owned: DataFrame) -> DataFrame:
    """(doc, owner, owner_kind, page_start, page_end, n_blocks, content): body blocks by owner."""
    body = owned.where("heading_type = ''")
    if "skipped" in owned.columns:
        body = body.where("not skipped")
    return body.groupBy("doc", "owner", "owner_kind").agg(
        F.min("page_num").alias("page_start"),
        F.max("page_num").alias("page_end"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("content"),
    )


def section_pages(classified: DataFrame) -> DataFrame:
    """(doc, section, page_start, page_end, n_headings): pages rolled up to the section that is open."""
    df = _last(classified, {"section": F.col("heading_type") == "section"})
    return df.groupBy("doc", "section").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end"), F.sum((F.col("heading_type") != "").cast("long")).alias("n_headings"))


def span_blocks(spans: DataFrame) -> DataFrame:
    """Spans (doc, page_num, block, seq, text, size, bold) as blocks: text, mean size, bold by strict majority."""
    return spans.groupBy("doc", "page_num", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.round(F.avg("size"), 1).alias("avg_font_size"),
        (F.sum(F.col("bold").cast("int")) * 2 > F.count(F.lit(1))).alias("is_bold"),
    )


def overlap_share(a: str, b: str) -> Column:
    """The share of box a (columns a_x0 ...) that lies in box b; 0 for an empty box."""
    c = lambda side, edge: F.col(f"{side}_{edge}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = (c(a, "x1") - c(a, "x0")) * (c(a, "y1") - c(a, "y0"))
    return F.when(area > 0, w * h / area).otherwise(0.0)


def outside_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Text blocks that lie in no table of their page by more than ``share``: an equi join on the page, an area test, an anti join."""
    edges = ("x0", "y0", "x1", "y1")
    t = tables.select(F.col("doc").alias("t_doc"), F.col("page_num").alias("t_page"), *[F.col(e).alias(f"t_{e}") for e in edges])
    b = blocks.withColumns({f"b_{e}": F.col(e) for e in edges})
    return b.join(t, (F.col("doc") == F.col("t_doc")) & (F.col("page_num") == F.col("t_page")) & (overlap_share("b", "t") > share), "left_anti").drop(*[f"b_{e}" for e in edges])


def clean_cell(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_tables(tables: DataFrame) -> DataFrame:
    """Tables (headers, rows) with clean cells, no blank rows, the first row as header where the header is blank; empty tables go."""
    clean = lambda a: F.transform(a, clean_cell)
    filled = lambda a: F.exists(a, lambda c: c != "")
    df = tables.withColumns({"headers": clean(F.coalesce("headers", F.array().cast("array<string>"))), "rows": F.filter(F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), clean), filled)})
    df = df.where(F.size("rows") > 0).withColumn("_promote", ~filled(F.col("headers")))
    df = df.withColumn("headers", F.when(F.col("_promote"), F.element_at("rows", 1)).otherwise(F.col("headers")))
    df = df.withColumn("rows", F.when(F.col("_promote"), F.slice("rows", 2, F.size("rows"))).otherwise(F.col("rows")))
    return df.drop("_promote").withColumns({"row_count": F.size("rows"), "col_count": F.size("headers")})


def tables_of_rows(raw: DataFrame) -> DataFrame:
    """Tables found on a page (cells: arrays of texts by row) with the first row as header; those of under two rows go."""
    return raw.where(F.size("cells") >= 2).withColumns({"headers": F.element_at("cells", 1), "rows": F.slice("cells", 2, F.size("cells"))}).drop("cells")


def table_records(normalized: DataFrame) -> DataFrame:
    """One row per table row and header: (..., row, key, value); a blank header is col_i, a short row padded."""
    rest = [c for c in normalized.columns if c not in ("headers", "rows", "row_count", "col_count")]
    rows = normalized.select(*rest, "headers", F.posexplode("rows").alias("row", "cells"))
    cells = rows.select(*rest, "row", "cells", F.posexplode("headers").alias("i", "header"))
    key = F.when(F.col("header") == "", F.concat(F.lit("col_"), F.col("i").cast("string"))).otherwise(F.col("header"))
    return cells.select(*rest, "row", key.alias("key"), F.coalesce(F.get("cells", F.col("i")), F.lit("")).alias("value"))


def metric_table(headers: Column, rows: Column) -> Column:
    """Whether a table's text has three of the metric words."""
    text = F.lower(F.concat_ws(" ", headers, F.flatten(rows)))
    return words_hit(text, V.METRIC_WORDS) >= 3
