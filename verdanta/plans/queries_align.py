"""Queries over concept alignment: scores, rules, one-to-one repair, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.operators import align
from verdanta.plans import inputs as I
from verdanta.plans.queries_facts import _any, _list
from verdanta.plans.registry import query


def concepts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(source, target), prepared."""
    path = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "\\|"))
    return tuple(align.prepare(I.run(spark, folder, sql).withColumn("hierarchy_path", path)) for sql in (I.SOURCE_CONCEPTS, I.TARGET_CONCEPTS))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return align.all_pairs(*concepts(spark, folder))


def _r6(x: str) -> str:
    """Six decimals, by the same steps in both engines (their own roundings differ in ties)."""
    return f"floor(({x}) * 1e6::double + 0.5::double) / 1e6::double"


def r6(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def _words(text: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({text}), '([\\p{{L}}\\p{{N}}_]+)', 1))"


def _tokens(text: str) -> str:
    """Lexical tokens as SQL."""
    t = f"lower({text})"
    for pattern, new in V.PHRASES:
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    table = "map([" + _list(list(V.SYNONYMS)) + "], [" + _list(list(V.SYNONYMS.values())) + "])"
    return f"[coalesce({table}[w], w) for w in regexp_extract_all({t}, '([\\p{{L}}\\p{{N}}_]+)', 1) if w not in ({_list(V.STOP_WORDS)})]"


def _jaccard(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b}))::double / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0.0)"


def _dimension_sql(unit: str) -> str:
    return f"case when coalesce({unit}, '') = '' then 'unknown' " + " ".join(f"when {_any(f'lower({unit})', ws)} then '{n}'" for n, ws in V.UNIT_DIMENSIONS.items()) + " else 'unknown' end"


def _esg_sql(prefix: str) -> str:
    votes = [f"len([w for w in [{_list(ws)}] if contains(x.full_text, w)])" for ws in (V.ENVIRONMENT_VOTES, V.SOCIAL_VOTES, V.GOVERNANCE_VOTES)]
    e, s, g = votes
    series = "case regexp_extract(x.full_text, 'gri\\s*(\\d)\\d{2}', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in V.SERIES_DIMENSIONS.items()) + " end"
    principle = "case regexp_extract(x.full_text, 'principle\\s*(\\d)', 1) " + " ".join(f"when '{k}' then '{v}'" for k, v in V.PRINCIPLE_DIMENSIONS.items()) + " end"
    return f"coalesce({series}, {principle}, case when {e} > {s} and {e} > {g} then 'E' when {s} > {e} and {s} > {g} then 'S' when {g} > {e} and {g} > {s} then 'G' else 'Unknown' end)"


def _side_sql(sql: str, p: str) -> str:
    num = _any("coalesce(lower(datatype), '')", V.NUMERIC_TYPES)
    return f"""
  select x.uri as {p}_uri, x.label as {p}_label, x.concept_type as {p}_type, x.definition as {p}_definition, {_tokens('x.label')} as {p}_tokens, trim(lower(coalesce(unit, ''))) as {p}_unit, {_dimension_sql('unit')} as {p}_dim,
    {_any("lower(coalesce(unit, ''))", V.INTENSITY_WORDS)} as {p}_int, coalesce(lower(datatype), '') as {p}_dt, {num} as {p}_num, {_esg_sql(p)} as {p}_esg,
    case when path = '' then [] else [{_words('a')} for a in string_split(path, '|')] end as {p}_path
  from (select *, lower(uri || ' ' || label || ' ' || replace(path, '|', ' ')) as full_text from ({I.duck(sql)}) y) x"""


PAIRS = f"s as ({_side_sql(I.SOURCE_CONCEPTS, 's')}), t as ({_side_sql(I.TARGET_CONCEPTS, 't')}), pairs as (select * from s cross join t)"
PROPERTY = """((case when s_dt = '' or t_dt = '' then 0.5 when s_dt = t_dt or (s_num and t_num) then 1.0 when s_num or t_num then 0.5 else 0.8 end)::double
  + (case when s_unit = '' or t_unit = '' then 0.5 when s_unit = t_unit then 1.0 when s_dim <> 'unknown' and s_dim = t_dim then case when s_int = t_int then 0.95 else 0.70 end when s_int and t_int then 0.60 else 0.20 end)::double) / 2"""
STRUCTURAL = f"""
ancestors as (select s_uri, t_uri, s_path, t_path, unnest(s_path) as x, generate_subscripts(s_path, 1) as i from pairs),
best as (
  select s_uri, t_uri, i, case when len(t_path) = 0 then 0.0 else list_max([{_jaccard('x', 'y')} for y in t_path]) end as v,
    case when len(t_path) = 0 then 1 else list_position([{_jaccard('x', 'y')} for y in t_path], list_max([{_jaccard('x', 'y')} for y in t_path])) end as j from ancestors
), folded as (select s_uri, t_uri, sum(v * (1::double / i + 1::double / j) / 2) as num, sum((1::double / i + 1::double / j) / 2) as den from best group by s_uri, t_uri),
back as (select s_uri, t_uri, unnest(t_path) as y, generate_subscripts(t_path, 1) as k, s_path from pairs),
missed as (select s_uri, t_uri, sum(case when coalesce(list_max([{_jaccard('x', 'y')} for x in s_path]), 0.0) < 0.5 then 1::double / k else 0 end) as m from back group by s_uri, t_uri),
structured as (
  select p.*, case when len(s_path) = 0 and len(t_path) = 0 then 0.0 else
      0.4::double * case when len(s_path) > 0 and len(t_path) > 0 then {_jaccard('s_path[1]', 't_path[1]')} else 0 end
    + 0.4::double * coalesce(f.num / nullif(f.den + coalesce(m.m, 0), 0), 0) + 0.2::double * greatest(0.0::double, 1 - 0.15::double * abs(len(s_path) - len(t_path))) end as structural
  from pairs p left join folded f using (s_uri, t_uri) left join missed m using (s_uri, t_uri)
)"""


@query("token_jaccard_pairs", f"with {PAIRS} select s_uri, t_uri, round({_jaccard('s_tokens', 't_tokens')}, 6) as j from pairs where len(list_intersect(s_tokens, t_tokens)) > 0")
def token_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """By an inverted index of tokens: only pairs that share one meet."""
    tokens = [c.select(F.col("uri").alias(f"{p}_uri"), F.array_distinct(align.lexical_tokens(F.col("label"))).alias(f"{p}_w")) for c, p in zip(concepts(spark, folder), "st")]
    ids = tokens[0].select("s_uri", F.explode("s_w").alias("k")).join(tokens[1].select("t_uri", F.explode("t_w").alias("k")), "k").select("s_uri", "t_uri").distinct()
    return ids.join(tokens[0], "s_uri").join(tokens[1], "t_uri").select("s_uri", "t_uri", F.round(align.jaccard(F.col("s_w"), F.col("t_w")), 6).alias("j"))


@query("document_jaccard_pairs", f"""with d as (select doc_id, {_words('text')} as w from documents where text is not null), b as (select item_id, {_words('text')} as w from benchmark)
      select doc_id, item_id, round({_jaccard('d.w', 'b.w')}, 6) as j from d cross join b where {_jaccard('d.w', 'b.w')} >= 0.3""")
def document_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Only rare words join; no common word makes rows."""
    d = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").select(F.col("doc_id").alias("l"), align.word_set(F.col("text")).alias("w"))
    b = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.col("item_id").alias("r"), align.word_set(F.col("text")).alias("w"))
    return align.similar_word_sets(d, b, 0.3).select(F.col("l").alias("doc_id"), F.col("r").alias("item_id"), F.round("j", 6).alias("j"))


@query("structural_score", f"with {PAIRS}, {STRUCTURAL} select s_uri, t_uri, {_r6("structural")} as score from structured")
def structural_score(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("s_uri", "t_uri", r6(align.structural(F.col("s_f.path"), F.col("t_f.path"))).alias("score"))


@query("property_score", f"with {PAIRS} select s_uri, t_uri, {_r6(PROPERTY)} as score from pairs")
def property_score(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("s_uri", "t_uri", r6(align.property_score(F.col("s_f"), F.col("t_f"))).alias("score"))


@query("concept_dimensions", f"with {PAIRS} select s_uri as uri, s_esg as dimension, s_dim as unit_dimension from s union all select t_uri, t_esg, t_dim from t")
def concept_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    a, b = concepts(spark, folder)
    return a.unionByName(b).select("uri", F.col("f.dimension").alias("dimension"), F.col("f.unit_dimension").alias("unit_dimension"))


def _replace_sql(c: str) -> str:
    return "[" + ", ".join(f"case when contains(lower({c}), '{a}') then replace(lower({c}), '{a}', '{b}') end" for a, b in V.ALIASES) + "]"


@query("label_aliases", f"with {PAIRS} select s_uri as uri, unnest(list_distinct(list_concat([s_label], [x for x in {_replace_sql('s_label')} if x is not null]))) as alias from s")
def label_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return concepts(spark, folder)[0].select("uri", F.explode(F.transform("f.aliases", lambda a: a["a"])).alias("alias"))


def _ratio_sql(pairs: str) -> str:
    """CTEs that end in ``ratios`` (a, b, ratio): the longest common run, the first in a and then in b; the same left and right of it, and so on."""
    return f"""
strings as (select distinct a, b from {pairs}),
numbered as (select row_number() over (order by a, b) as p, a, b from strings),
cells as (
  select p, i, j from (select p, a, b, unnest(range(1, length(a) + 1)) as i from numbered) x, lateral (select unnest(range(1, length(x.b) + 1)) as j) y where x.a[i] = x.b[j]
), blocks as (
  select p, 1::bigint as i0, length(a) as i1, 1::bigint as j0, length(b) as j1, 0::bigint as n from numbered
  union all
  select p, unnest([i0, i + n]) as i0, unnest([i - 1, i1]) as i1, unnest([j0, j + n]) as j0, unnest([j - 1, j1]) as j1, unnest([n, 0::bigint]) as n from (
    select p, i0, i1, j0, j1, arg_min(i, (-n, i, j)) as i, arg_min(j, (-n, i, j)) as j, max(n) as n from (
      select p, i0, i1, j0, j1, i - j as d, run, min(i) as i, min(j) as j, count(*) as n from (
        select k.p, k.i0, k.i1, k.j0, k.j1, c.i, c.j, c.i - row_number() over (partition by k.p, k.i0, k.j0, c.i - c.j order by c.i) as run
        from blocks k join cells c on c.p = k.p and c.i between k.i0 and k.i1 and c.j between k.j0 and k.j1 where k.i1 >= k.i0 and k.j1 >= k.j0
      ) r group by p, i0, i1, j0, j1, i - j, run
    ) l group by p, i0, i1, j0, j1
  ) best
), ratios as (
  select a, b, case when length(a) + length(b) = 0 then 1.0::double else 2.0::double * coalesce(m, 0) / (length(a) + length(b)) end as ratio
  from numbered left join (select p, sum(n) as m from blocks group by p) using (p)
)"""


def _alias_list(p: str) -> str:
    return f"list_distinct(list_concat([{p}_label], [x for x in {_replace_sql(f'{p}_label')} if x is not null]))"


#: The lexical score: the best token overlap and the best sequence ratio over all aliases of both sides.
LEXICAL = f"""
sa as (select s_uri, unnest({_alias_list('s')}) as a from s), ta as (select t_uri, unnest({_alias_list('t')}) as b from t),
alias_pairs as (select s_uri, t_uri, a, b, {_tokens('a')} as x, {_tokens('b')} as y from sa cross join ta),
{_ratio_sql('alias_pairs')},
lexical as (
  select s_uri, t_uri, case when bool_or(trim(lower(a)) = trim(lower(b))) then 1.0::double else (0.5::double * max(case when len(x) > 0 and len(y) > 0 then {_jaccard('x', 'y')} else 0 end) + 0.5::double * max(ratio)) * 0.95::double end as lexical
  from alias_pairs join ratios using (a, b) group by s_uri, t_uri
)"""


@query("sequence_ratio_pairs", f"with recursive {PAIRS}, lowered as (select s_uri, t_uri, lower(s_label) as a, lower(t_label) as b from pairs), {_ratio_sql('lowered')} select s_uri, t_uri, {_r6('ratio')} as ratio from lowered join ratios using (a, b)")
def sequence_ratio_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Ratcliff-Obershelp similarity of labels."""
    return pairs(spark, folder).select("s_uri", "t_uri", r6(align.sequence_ratio(F.lower("s_label"), F.lower("t_label"))).alias("ratio"))


@query("lexical_score", f"with recursive {PAIRS}, {LEXICAL} select s_uri, t_uri, {_r6('lexical')} as score from lexical")
def lexical_score(spark: SparkSession, folder: str) -> DataFrame:
    return pairs(spark, folder).select("s_uri", "t_uri", r6(align.lexical(F.col("s_f"), F.col("t_f"))).alias("score"))


@query("cosine_pairs", f"with {PAIRS}, e as (select vec_id, embedding::double[] as x from embeddings) select s_uri, t_uri, round(list_cosine_similarity(a.x, b.x), 4) + 0::double as cosine from pairs join e a on 'urn:x#S' || a.vec_id = s_uri join e b on 'urn:x#T' || b.vec_id = t_uri")
def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every source concept with every target concept, by their embeddings."""
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    with_vectors = [c.join(e.select(F.concat(F.lit(f"urn:x#{p}"), F.col("vec_id").cast("string")).alias("uri"), "embedding"), "uri") for c, p in zip(concepts(spark, folder), "ST")]
    return align.all_pairs(*with_vectors).select("s_uri", "t_uri", (F.round(align.cosine(F.col("s_embedding"), F.col("t_embedding")), 4) + F.lit(0.0)).alias("cosine"))  # no negative zero


#: Scored pairs without the sequence ratio: token overlap stands for the label's score, so that SQL can follow.
SCORED = f"""
{PAIRS}, {STRUCTURAL}, lexed as (select *, {_jaccard('s_tokens', 't_tokens')} as lex, {PROPERTY} as prop, 0.2::double + 0.01::double * (length(s_label) % 30) as emb from structured),
damp as (select *, case when lex < 0.05 then emb * 0.3::double else emb end as emb2 from lexed where lex >= 0.12 or structural >= 0.35),
agg as (select *, case when lex < 0.15 and emb2 < 0.15 then 0.0 else lex * 0.40::double + structural * 0.35::double + prop * 0.15::double + emb2 * 0.10::double end as similarity from damp),
rule1 as (select *, case when s_esg <> 'Unknown' and t_esg <> 'Unknown' and s_esg <> t_esg then similarity * 0.1::double else similarity end as r1 from agg),
rule2 as (select *, case when len(s_path) > 0 and len(t_path) > 0 and {_jaccard('s_path[1]', 't_path[1]')} >= 0.5 then least(1.0::double, r1 * 1.15::double) else r1 end as r2 from rule1),
scored as (select *, {_r6("case when s_dt <> '' and t_dt <> '' and s_num <> t_num then r2 * 0.8::double when s_num and t_num and s_unit <> '' and s_unit = t_unit then least(1.0::double, r2 * 1.05::double) else r2 end")} as score from rule2)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    p = pairs(spark, folder)
    p = p.withColumns({"lexical_score": align.jaccard(align.lexical_tokens(F.col("s_label")), align.lexical_tokens(F.col("t_label"))), "structural_score": align.structural(F.col("s_f.path"), F.col("t_f.path"))})
    p = p.where("lexical_score >= 0.12 or structural_score >= 0.35").withColumn("property_score", align.property_score(F.col("s_f"), F.col("t_f")))
    p = p.withColumn("embedding_score", align.damped(0.2 + 0.01 * (F.length("s_label") % 30), F.col("lexical_score")))
    p = p.withColumn("similarity", align.aggregate_scores(*[F.col(f"{k}_score") for k in ("lexical", "structural", "property", "embedding")]))
    return align.apply_rules(p).withColumn("score", r6(F.col("score")))


@query("aggregate_confidence", f"with {SCORED} select s_uri, t_uri, {_r6("similarity")} as similarity from scored")
def aggregate_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("s_uri", "t_uri", r6(F.col("similarity")).alias("similarity"))


@query("reasoned_scores", f"with {SCORED} select s_uri, t_uri, score from scored")
def reasoned_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("s_uri", "t_uri", "score")


_REL = """case when score >= 0.70 then 'Equivalent' when score >= 0.50 then 'Partial Equivalent' when score >= 0.30 then
  case when s_type = 'Disclosure' and t_type = 'Requirement' then 'Broader' when s_type = 'Requirement' and t_type = 'Disclosure' then 'Narrower' when length(s_definition) > length(t_definition) then 'Broader' else 'Narrower' end else 'NotMapped' end"""
_SKOS = f"'{V.SKOS}' || case lower(relationship) when 'equivalent' then 'exactMatch' when 'partial equivalent' then 'closeMatch' when 'broader' then 'broadMatch' when 'narrower' then 'narrowMatch' else 'relatedMatch' end"


@query("skos_relations", f"with {SCORED}, r as (select *, {_REL} as relationship from scored) select s_uri, t_uri, relationship, {_SKOS} as ontology_path from r")
def skos_relations(spark: SparkSession, folder: str) -> DataFrame:
    return align.mappings(scored(spark, folder)).select("s_uri", "t_uri", "relationship", "ontology_path")


@query("top_k_mappings", f"with {SCORED} select s_uri, t_uri, score from scored order by score desc, s_uri, t_uri limit 100")
def top_k_mappings(spark: SparkSession, folder: str) -> DataFrame:
    return align.top_pairs(scored(spark, folder), 100).select("s_uri", "t_uri", "score")


@query("relation_distribution", f"with {SCORED} select {_REL} as relationship, count(*) as count from scored group by 1")
def relation_distribution(spark: SparkSession, folder: str) -> DataFrame:
    from verdanta.operators.evaluate import value_counts

    return value_counts(align.mappings(scored(spark, folder)), "relationship")


@query("mean_confidence", f"with {SCORED} select round(avg(score) * 100, 4) as mean_confidence, count(*) as n from scored")
def mean_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return align.mappings(scored(spark, folder)).agg(F.round(F.avg("confidence_score"), 4).alias("mean_confidence"), F.count(F.lit(1)).alias("n"))


@query(
    "greedy_one_to_one",
    f"""with recursive {SCORED.strip()}, ranked as (select s_uri, t_uri, score, row_number() over (order by score desc, s_uri, t_uri) as rn from scored where score >= 0.45),
      walk as (select 0::bigint as rn, []::varchar[] as used, null::varchar as s_uri, null::varchar as t_uri
        union all select r.rn, case when list_contains(w.used, r.s_uri) or list_contains(w.used, r.t_uri) then w.used else list_concat(w.used, [r.s_uri, r.t_uri]) end,
          case when list_contains(w.used, r.s_uri) or list_contains(w.used, r.t_uri) then null else r.s_uri end, r.t_uri from walk w join ranked r on r.rn = w.rn + 1)
      select s_uri, t_uri from walk where s_uri is not null""",
)
def greedy_one_to_one(spark: SparkSession, folder: str) -> DataFrame:
    return align.one_to_one(scored(spark, folder), least=0.45, cap=0.4).where("retained").select("s_uri", "t_uri")


_ALIGNED = f"""
with recursive {PAIRS}, {STRUCTURAL.strip()}, {LEXICAL.strip()},
lexed as (select p.*, l.lexical as lex, {PROPERTY} as prop from structured p join lexical l using (s_uri, t_uri)),
agg as (select *, case when lex < 0.15 then 0.0::double else lex * 0.40::double + structural * 0.35::double + prop * 0.15::double + 0 * 0.10::double end as similarity from lexed where lex >= 0.12 or structural >= 0.35),
rule1 as (select *, case when s_esg <> 'Unknown' and t_esg <> 'Unknown' and s_esg <> t_esg then similarity * 0.1::double else similarity end as r1 from agg where similarity >= 0.30),
rule2 as (select *, case when len(s_path) > 0 and len(t_path) > 0 and {_jaccard('s_path[1]', 't_path[1]')} >= 0.5 then least(1.0::double, r1 * 1.15::double) else r1 end as r2 from rule1),
reasoned as (select *, case when s_dt <> '' and t_dt <> '' and s_num <> t_num then r2 * 0.8::double when s_num and t_num and s_unit <> '' and s_unit = t_unit then least(1.0::double, r2 * 1.05::double) else r2 end as score0 from rule2),
ranked as (select s_uri, t_uri, row_number() over (order by score0 desc, s_uri, t_uri) as rn from reasoned where score0 >= 0.85),
walk as (
  select 0::bigint as rn, []::varchar[] as used, null::varchar as s_uri, null::varchar as t_uri
  union all
  select r.rn, case when list_contains(w.used, r.s_uri) or list_contains(w.used, r.t_uri) then w.used else list_concat(w.used, [r.s_uri, r.t_uri]) end,
    case when list_contains(w.used, r.s_uri) or list_contains(w.used, r.t_uri) then null else r.s_uri end, r.t_uri from walk w join ranked r on r.rn = w.rn + 1
), repaired as (
  select r.*, case when score0 >= 0.85 and w.s_uri is null then least(score0, 0.74::double) else score0 end as score
  from reasoned r left join walk w on w.s_uri = r.s_uri and w.t_uri = r.t_uri
), top as (select * from repaired order by score desc, s_uri, t_uri limit 100), related as (select *, {_REL} as relationship from top)
select s_uri, t_uri, relationship, {_r6('score')} as similarity_score, string_split({_SKOS}, '#')[-1] as skos_relation from related"""


@query("alignment", _ALIGNED)
def alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The whole alignment with its full lexical score."""
    path = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split("path", "\\|"))
    s, t = (I.run(spark, folder, sql).withColumn("hierarchy_path", path) for sql in (I.SOURCE_CONCEPTS, I.TARGET_CONCEPTS))
    return align.align(s, t).select("s_uri", "t_uri", "relationship", r6(F.col("similarity_score")).alias("similarity_score"), "skos_relation")
