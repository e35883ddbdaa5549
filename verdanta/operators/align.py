"""Alignment of two sets of concepts: lexical, structural, property and embedding scores, rules, relations.

Everything that hangs on one concept (tokens, aliases, unit dimension) is
computed once for each concept, before pairs are made. A pair is a row, and each
score a column of it, so no score tables are joined. Pairs come from all against
all, dealt out to tasks of bounded size; ``blocked_pairs`` makes fewer from an
inverted index of tokens, by an equi join.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdanta.functions import vocab as V
from verdanta.functions.normalize import contains_any, words_hit

#: Concepts of the smaller side that are broadcast to make all-against-all pairs; of two larger sides, blocks of BLOCK meet.
MAX_SIDE = 20_000
BLOCK = 5_000
#: Pairs that one task makes where a side is broadcast.
PAIRS_A_TASK = 20_000


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def lexical_tokens(text: Column) -> Column:
    """Words of a label: phrases rewritten, stop words left out, synonyms replaced."""
    t = F.lower(F.coalesce(text, F.lit("")))
    for pattern, new in V.PHRASES:
        t = F.regexp_replace(t, pattern, new)
    words = F.regexp_extract_all(t, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    kept = F.filter(words, lambda w: ~w.isin(V.STOP_WORDS))
    table = F.create_map(*[F.lit(x) for pair in V.SYNONYMS.items() for x in pair])
    return F.transform(kept, lambda w: F.coalesce(F.try_element_at(table, w), w))


def aliases(label: Column) -> Column:
    """The label itself and, in lower case, every spelling that the alias table gives."""
    low = F.lower(label)
    more = [F.when(F.contains(low, F.lit(a)), F.replace(low, F.lit(a), F.lit(b))) for a, b in V.ALIASES]
    return F.array_distinct(F.array_compact(F.array(label, *more)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def unit_dimension(unit: Column) -> Column:
    low = F.lower(F.coalesce(unit, F.lit("")))
    out = F.when(low == "", "unknown")
    for name, words in V.UNIT_DIMENSIONS.items():
        out = out.when(contains_any(low, words), name)
    return out.otherwise("unknown")


def dimension(uri: Column, label: Column, path: Column) -> Column:
    """E, S, G or Unknown: by the standard's series, the principle, else a keyword vote with one winner."""
    text = F.lower(F.concat_ws(" ", uri, label, F.array_join(path, " ")))
    series = F.nullif(F.regexp_extract(text, r"gri\s*(\d)\d{2}", 1), F.lit(""))
    principle = F.nullif(F.regexp_extract(text, r"principle\s*(\d)", 1), F.lit(""))
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (str(k), v)])
    e, s, g = (words_hit(text, w) for w in (V.ENVIRONMENT_VOTES, V.SOCIAL_VOTES, V.GOVERNANCE_VOTES))
    vote = F.when((e > s) & (e > g), "E").when((s > e) & (s > g), "S").when((g > e) & (g > s), "G").otherwise("Unknown")
    return F.coalesce(F.try_element_at(table(V.SERIES_DIMENSIONS), series), F.try_element_at(table(V.PRINCIPLE_DIMENSIONS), principle), vote)


def prepare(concepts: DataFrame) -> DataFrame:
    """Concepts with what their pairs need: a struct of tokens, aliases, path tokens, unit and type classes, dimension."""
    unit, dt = F.lower(F.btrim(F.coalesce("unit", F.lit("")))), F.lower(F.coalesce("datatype", F.lit("")))
    path = F.coalesce("hierarchy_path", F.array().cast("array<string>"))
    own = {
        "aliases": F.transform(aliases(F.coalesce("label", F.lit(""))), lambda a: F.struct(a.alias("a"), F.array_distinct(lexical_tokens(a)).alias("w"))),
        "path": F.transform(path, word_set),
        "unit": unit,
        "unit_dimension": unit_dimension(F.col("unit")),
        "intensity": contains_any(unit, V.INTENSITY_WORDS),
        "datatype": dt,
        "numeric": contains_any(dt, V.NUMERIC_TYPES),
        "dimension": dimension(F.col("uri"), F.coalesce("label", F.lit("")), path),
    }
    return concepts.select("uri", "label", "concept_type", F.coalesce("definition", F.lit("")).alias("definition"), path.alias("hierarchy_path"), F.struct(*[c.alias(k) for k, c in own.items()]).alias("f"), *(["embedding"] if "embedding" in concepts.columns else []))


def _side(concepts: DataFrame, prefix: str) -> DataFrame:
    return concepts.select(*[F.col(c).alias(f"{prefix}_{c}") for c in concepts.columns])


def all_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source with every target, of any number: the smaller side is broadcast and the larger dealt out; of two large sides, blocks meet blocks.

    A task holds one side or block of bounded size (a block can spill) and streams the other.
    """
    n, m = source.count(), target.count()
    s, t = _side(source, "s"), _side(target, "t")
    if min(n, m) > MAX_SIDE:
        return s.repartition(-(-n // BLOCK)).hint("shuffle_replicate_nl").join(t.repartition(-(-m // BLOCK)))
    tasks = min(-(-n * m // PAIRS_A_TASK), max(n, m))
    dealt = lambda df: df.repartition(tasks) if tasks > 1 else df
    return F.broadcast(s).join(dealt(t)) if n <= m else dealt(s).join(F.broadcast(t))


def blocked_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs that share a lexical token or a word of their nearest ancestors: an inverted index, no cross join."""
    keys = lambda df, p: df.select(F.col("uri").alias(f"{p}_uri"), F.explode(F.array_distinct(F.concat(F.flatten(F.transform("f.aliases", lambda a: a["w"])), F.transform(F.flatten(F.slice("f.path", 1, 1)), lambda w: F.concat(F.lit("^"), w))))).alias("k"))
    ids = keys(source, "s").join(keys(target, "t"), "k").select("s_uri", "t_uri").distinct()
    return ids.join(_side(source, "s"), "s_uri").join(_side(target, "t"), "t_uri")


def similar_word_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, j) of rows (l, w) and (r, w), w distinct words, with a Jaccard similarity of ``least`` or more.

    Such a pair shares a word among the rarest of the right set, all but
    ``least`` of them less one. Only these are joined, so the words that most
    sets have make no rows; the pairs found are verified by their whole sets.
    """
    n = F.size("w")
    words = right.select("r", F.explode("w").alias("k"))
    rare = words.join(words.groupBy("k").agg(F.count(F.lit(1)).alias("f")), "k").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("f", "k"))).alias("o"))
    first = F.slice("o", F.lit(1), F.size("o") - F.ceil(F.size("o") * least - 1e-9).cast("int") + 1)
    rare = rare.select("r", F.explode(F.transform(first, lambda x: x["k"])).alias("k"))
    ids = left.select("l", F.explode("w").alias("k")).join(rare, "k").select("l", "r").distinct()
    pairs = ids.join(left.withColumn("n", n), "l").join(right.select("r", F.col("w").alias("v"), n.alias("m")), "r")
    pairs = pairs.where((F.col("n") >= least * F.col("m") - 1e-9) & (F.col("m") >= least * F.col("n") - 1e-9))
    return pairs.select("l", "r", jaccard(F.col("w"), F.col("v")).alias("j")).where(F.col("j") >= least)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, for which there is no built-in function; equal pairs of a batch are computed once."""
    known: dict[tuple[str, str], float] = {}

    def ratio(x: str, y: str) -> float:
        if (x, y) not in known:
            known[x, y] = SequenceMatcher(None, x or "", y or "").ratio()
        return known[x, y]

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_alias_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.95 of the mean of the best token Jaccard and the best sequence ratio over the aliases of both sides; 1 for equal aliases."""
    known: dict[tuple, tuple[float, float]] = {}

    def score(x, y) -> float:
        if {p["a"].strip().lower() for p in x} & {q["a"].strip().lower() for q in y}:
            return 1.0
        words = ratio = 0.0
        for p in x:
            for q in y:
                key = (p["a"], q["a"])
                if key not in known:
                    u, w = set(p["w"]), set(q["w"])
                    known[key] = len(u & w) / len(u | w) if u and w else 0.0, SequenceMatcher(None, *key).ratio()
                words, ratio = max(words, known[key][0]), max(ratio, known[key][1])
        return (0.5 * words + 0.5 * ratio) * 0.95

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")


def lexical(s: Column, t: Column) -> Column:
    return best_alias_score(s["aliases"], t["aliases"])


def structural(s: Column, t: Column) -> Column:
    """0.4 parents + 0.4 weighted path overlap + 0.2 depth agreement; 0 where both paths are empty. Paths are arrays of word sets."""
    n, m = F.size(s), F.size(t)
    zero = F.lit(0.0)
    near = F.when((n > 0) & (m > 0), jaccard(F.get(s, F.lit(0)), F.get(t, F.lit(0)))).otherwise(zero)
    weight = lambda i: F.lit(1.0) / (i + 1)

    # the first best place of each x, found once; both sums in one pass
    best = F.transform(s, lambda x, i: F.struct(i.alias("i"), F.array_max(F.transform(t, lambda y, j: F.struct(jaccard(x, y).alias("v"), (-j).alias("j")))).alias("b")))
    w = lambda e: F.when(m > 0, (weight(e["i"]) + weight(-e["b"]["j"])) / 2).otherwise(weight(e["i"]))
    add = lambda acc, e: F.struct((acc["num"] + F.coalesce(e["b"]["v"], zero) * w(e)).alias("num"), (acc["den"] + w(e)).alias("den"))
    missed = F.aggregate(F.transform(t, lambda y, k: F.when(F.coalesce(F.array_max(F.transform(s, lambda x: jaccard(x, y))), zero) < 0.5, weight(k)).otherwise(zero)), zero, lambda acc, e: acc + e)
    path = F.aggregate(best, F.struct(zero.alias("num"), zero.alias("den")), add, lambda acc: F.coalesce(F.try_divide(acc["num"], acc["den"] + missed), zero))
    depth = F.greatest(zero, 1 - 0.15 * F.abs(n - m))
    return F.when((n == 0) & (m == 0), 0.0).otherwise(0.4 * near + 0.4 * path + 0.2 * depth)


def property_score(s: Column, t: Column) -> Column:
    """The mean of datatype and unit compatibility."""
    both = (s["datatype"] != "") & (t["datatype"] != "")
    dt = F.when(~both, 0.5).when((s["datatype"] == t["datatype"]) | (s["numeric"] & t["numeric"]), 1.0).when(s["numeric"] | t["numeric"], 0.5).otherwise(0.8)
    known = (s["unit"] != "") & (t["unit"] != "")
    same = (s["unit_dimension"] != "unknown") & (s["unit_dimension"] == t["unit_dimension"])
    unit = F.when(~known, 0.5).when(s["unit"] == t["unit"], 1.0).when(same, F.when(s["intensity"] == t["intensity"], 0.95).otherwise(0.70)).when(s["intensity"] & t["intensity"], 0.60).otherwise(0.20)
    return (dt + unit) / 2


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def damped(embedding: Column, lex: Column) -> Column:
    """Embedding similarity counts little where the labels have nothing in common."""
    return F.when(lex < 0.05, embedding * 0.3).otherwise(embedding)


def aggregate_scores(lex: Column, struct: Column, prop: Column, emb: Column, weights: dict[str, float] = V.WEIGHTS) -> Column:
    """The weighted mean (a missing property score has no weight); 0 where label and embedding both say nothing."""
    w = weights
    zero = F.lit(0.0)
    # added in this order, which the last digits hang on
    with_it = F.coalesce(lex, zero) * w["lexical"] + F.coalesce(struct, zero) * w["structural"] + prop * w["property"] + F.coalesce(emb, zero) * w["embedding"]
    without = F.coalesce(lex, zero) * w["lexical"] + F.coalesce(struct, zero) * w["structural"] + F.coalesce(emb, zero) * w["embedding"]
    rest = w["lexical"] + w["structural"] + w["embedding"]
    score = F.when(prop.isNull(), without / rest).otherwise(with_it / (w["lexical"] + w["structural"] + w["property"] + w["embedding"]))
    return F.when((F.coalesce(lex, F.lit(0.0)) < 0.15) & (F.coalesce(emb, F.lit(0.0)) < 0.15), 0.0).otherwise(score)


def score_pairs(pairs: DataFrame, minimum: float = V.THRESHOLDS["broader_narrower"]) -> DataFrame:
    """Pairs with all scores; those with neither lexical 0.12 nor structural 0.35 go, then those under ``minimum``."""
    df = pairs.withColumns({"lexical_score": lexical(F.col("s_f"), F.col("t_f")), "structural_score": structural(F.col("s_f.path"), F.col("t_f.path"))})
    df = df.where("lexical_score >= 0.12 or structural_score >= 0.35")
    emb = damped(cosine(F.col("s_embedding"), F.col("t_embedding")), F.col("lexical_score")) if "s_embedding" in df.columns else F.lit(0.0)
    df = df.withColumns({"property_score": property_score(F.col("s_f"), F.col("t_f")), "embedding_score": emb})
    df = df.withColumn("similarity", aggregate_scores(*[F.col(f"{k}_score") for k in ("lexical", "structural", "property", "embedding")]))
    return df.where(F.col("similarity") >= minimum)


def apply_rules(scored: DataFrame) -> DataFrame:
    """Dimension conflict x 0.1; alike parents x 1.15; datatype conflict x 0.8, equal units x 1.05 (at most 1); with the reasons."""
    s, t = F.col("s_f"), F.col("t_f")
    known = (s["dimension"] != "Unknown") & (t["dimension"] != "Unknown")
    conflict = known & (s["dimension"] != t["dimension"])
    parents = F.when((F.size(s["path"]) > 0) & (F.size(t["path"]) > 0), jaccard(F.get(s["path"], F.lit(0)), F.get(t["path"], F.lit(0)))).otherwise(0.0)
    mixed = (s["datatype"] != "") & (t["datatype"] != "") & (s["numeric"] != t["numeric"])
    measured = s["numeric"] & t["numeric"] & (s["unit"] != "") & (t["unit"] != "")
    same = measured & (s["unit"] == t["unit"])
    one = F.when(conflict, F.col("similarity") * 0.1).otherwise(F.col("similarity"))
    two = F.when(parents >= 0.5, F.least(F.lit(1.0), one * 1.15)).otherwise(one)
    three = F.when(mixed, two * 0.8).when(same, F.least(F.lit(1.0), two * 1.05)).otherwise(two)
    why = F.array_compact(
        F.array(
            F.when(conflict, F.format_string("Rule 1: dimensions %s and %s conflict, score x 0.1", s["dimension"], t["dimension"])).when(known, F.format_string("Rule 1: both of dimension %s", s["dimension"])).otherwise("Rule 1: skipped, a dimension is unknown"),
            F.when(parents >= 0.5, F.format_string("Rule 2: parents alike (%.2f), score x 1.15", parents)),
            F.when(mixed, F.lit("Rule 3: one side numeric, the other not, score x 0.8")).when(same, F.format_string("Rule 3: same unit %s, score x 1.05", s["unit"])).when(measured, F.format_string("Rule 3: numeric, units %s and %s differ", s["unit"], t["unit"])),
        )
    )
    return scored.withColumns({"score": three, "reasoning": why})


def one_to_one(scored: DataFrame, least: float = 0.85, cap: float = 0.74) -> DataFrame:
    """Pairs of ``least`` or more taken greedily by score, each concept once; the others of that level get ``cap``.

    A round keeps every pair that is the best of both its concepts and sets aside
    all pairs that share a concept with a kept one; the rounds end when none is
    left, which gives what taking pairs one by one would give. Each round keeps
    the best pair of all at least, so they do end. Ties go by uri.
    """
    from verdanta.operators.shared import checkpoint

    key = F.struct((-F.col("score")).alias("a"), F.col("s_uri").alias("b"), F.col("t_uri").alias("c"))
    open_ = checkpoint(scored.where(F.col("score") >= least).select("s_uri", "t_uri", "score"))
    kept = None
    while not open_.isEmpty():
        best_s = open_.groupBy("s_uri").agg(F.min(key).alias("k")).select("k.b", "k.c")
        best_t = open_.groupBy("t_uri").agg(F.min(key).alias("k")).select("k.b", "k.c")
        now = checkpoint(best_s.join(best_t, ["b", "c"]).select(F.col("b").alias("s_uri"), F.col("c").alias("t_uri")))
        kept = now if kept is None else kept.unionByName(now)
        open_ = checkpoint(open_.join(now.select("s_uri"), "s_uri", "left_anti").join(now.select("t_uri"), "t_uri", "left_anti"))
    if kept is None:
        return scored.withColumn("retained", F.lit(None).cast("boolean"))
    df = scored.join(kept.withColumn("_kept", F.lit(True)), ["s_uri", "t_uri"], "left")
    high = F.col("score") >= least
    lost = high & F.col("_kept").isNull()
    return df.withColumns({"retained": F.when(high, F.col("_kept").isNotNull()), "score": F.when(lost, F.least("score", F.lit(cap))).otherwise(F.col("score"))}).drop("_kept")


def relation(score: Column, s_type: Column, t_type: Column, s_definition: Column, t_definition: Column, thresholds: dict[str, float] = V.THRESHOLDS) -> Column:
    by_length = F.when(F.length(s_definition) > F.length(t_definition), "Broader").otherwise("Narrower")
    direction = F.when((s_type == "Disclosure") & (t_type == "Requirement"), "Broader").when((s_type == "Requirement") & (t_type == "Disclosure"), "Narrower").otherwise(by_length)
    return F.when(score >= thresholds["equivalent"], "Equivalent").when(score >= thresholds["partial"], "Partial Equivalent").when(score >= thresholds["broader_narrower"], direction).otherwise("NotMapped")


def skos(rel: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in V.SKOS_MATCH.items() for x in (k, v)])
    return F.concat(F.lit(V.SKOS), F.coalesce(F.try_element_at(table, F.lower(F.btrim(rel))), F.lit("relatedMatch")))


def top_pairs(scored: DataFrame, k: int = 100) -> DataFrame:
    return scored.orderBy(F.desc("score"), "s_uri", "t_uri").limit(k)


def mappings(scored: DataFrame) -> DataFrame:
    """Final records: relation, SKOS property, evidence and reasons, with pair_id for later joins."""
    rel = relation(F.col("score"), F.col("s_concept_type"), F.col("t_concept_type"), F.col("s_definition"), F.col("t_definition"))
    half = F.lit(0.5)
    evidence = F.struct(
        F.col("lexical_score").alias("label_similarity"), half.alias("definition_similarity"), F.col("embedding_score").alias("embedding_similarity"), F.col("property_score").alias("unit_compatibility"),
        F.col("property_score").alias("datatype_compatibility"), F.col("structural_score").alias("hierarchy_similarity"), half.alias("relationship_similarity"), half.alias("topic_similarity"), half.alias("context_similarity"),
    )
    df = scored.withColumn("relationship", rel).withColumn("ontology_path", skos(F.col("relationship")))
    return df.select(
        F.md5(F.concat_ws("\n", "s_uri", "t_uri")).alias("pair_id"), "s_uri", "t_uri", "s_label", "t_label", "relationship", (F.col("score") * 100).alias("confidence_score"), F.col("score").alias("similarity_score"),
        evidence.alias("evidence_summary"), "ontology_path", F.substring_index("ontology_path", "#", -1).alias("skos_relation"), F.substring_index("s_uri", "#", -1).alias("s_id"), F.substring_index("t_uri", "#", -1).alias("t_id"),
        "lexical_score", "structural_score", "property_score", "reasoning",
    )


def align(source: DataFrame, target: DataFrame, k: int = 100, blocked: bool = False) -> DataFrame:
    """The whole alignment of two concept tables: the k best mappings."""
    s, t = prepare(source), prepare(target)
    pairs = blocked_pairs(s, t) if blocked else all_pairs(s, t)
    return mappings(top_pairs(one_to_one(apply_rules(score_pairs(pairs))), k))
