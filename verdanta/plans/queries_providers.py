"""Queries over outside providers with offline stand-ins: caches, enrichment, verdicts, prompts, schedule, report.

Each stand-in is a plain function of the request, so SQL can follow it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.operators import evaluate, providers
from verdanta.plans import queries_align as A
from verdanta.plans import queries_evaluate as E
from verdanta.plans.registry import query


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _by_length(items: list[dict]) -> list[dict]:
    return [{"category": ("Social", "no category", "Governance")[len(x["concept"]) % 3]} for x in items]


@query(
    "concept_categories",
    "select p_partkey as id, p_name as concept, case when p_name in (select p_name from part where p_partkey % 5 = 0 and length(p_name) % 2 = 0) then 'Environmental' when length(p_name) % 3 = 0 then 'Social' when length(p_name) % 3 = 2 then 'Governance' else 'Other' end as category from part",
)
def concept_categories(spark: SparkSession, folder: str) -> DataFrame:
    """The cache answers first, the provider for distinct misses only; an answer that is no category is Other."""
    p = _table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("concept"))
    cache = p.where("id % 5 = 0 and length(concept) % 2 = 0").select("concept", F.lit("Environmental").alias("category")).distinct()
    return providers.classify_concepts(p, cache, _by_length)[0].select("id", "concept", "category")


@query("concept_cache_misses", "select distinct p_name as concept, case when length(p_name) % 3 = 0 then 'Social' when length(p_name) % 3 = 2 then 'Governance' else 'Other' end as category from part where p_name not in (select p_name from part where p_partkey % 5 = 0 and length(p_name) % 2 = 0)")
def concept_cache_misses(spark: SparkSession, folder: str) -> DataFrame:
    """What the cache learns: every distinct miss once."""
    p = _table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("concept"))
    cache = p.where("id % 5 = 0 and length(concept) % 2 = 0").select("concept", F.lit("Environmental").alias("category")).distinct()
    return providers.classify_concepts(p, cache, _by_length)[1]


def _measured(items: list[dict]) -> list[dict]:
    if any(x["text"].startswith("fail") for x in items):
        raise ConnectionError("no answer")
    return [{"metric": str(len(x["text"])), "unit": x["text"][:1], "datatype": None, "applicability": "all"} for x in items]


@query(
    "enriched_texts",
    "with t as (select conv_id, turn, text from conversations where text is not null) select conv_id, turn, case when length(text) >= 15 then cast(least(length(text), 1500) as varchar) end as metric, case when length(text) >= 15 then left(text, 1) end as unit, case when length(text) >= 15 then 'all' end as applicability from t where not starts_with(text, 'fail')",
)
def enriched_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Short texts aren't asked about, long ones as far as the provider takes them; equal texts once."""
    t = _table(spark, folder, "conversations").where("text is not null and not startswith(text, 'fail')")
    return providers.enrich(t.select("conv_id", "turn", "text"), _measured).select("conv_id", "turn", "metric", "unit", "applicability")


def _verdicts(items: list[dict]) -> list[dict]:
    return [{"verification": ("Agree", "Perhaps", None, "Disagree")[x["k"] % 4], "confidence": ("High", "Huge", "Low", None)[x["k"] % 4], "explanation": f"of {x['pair_id']}" if x["k"] % 2 else None} for x in items]


@query(
    "verified_mappings",
    """select 'p' || s_suppkey as pair_id, case when s_suppkey % 4 = 0 then 'Agree' else 'Disagree' end as verification, case s_suppkey % 4 when 0 then 'High' when 1 then 'Medium' when 2 then 'Low' else 'Medium' end as confidence,
      case when s_suppkey % 2 = 1 then 'of p' || s_suppkey else 'Verification skipped or failed' end as explanation from supplier""",
)
def verified_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """Malformed and missing verdicts count as Disagree; an unknown confidence as Medium, none at all as Low."""
    m = _table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pair_id"), F.col("s_suppkey").cast("int").alias("k"))
    return providers.verify(m, _verdicts).select("pair_id", "verification", "confidence", "explanation")


@query("unverified_mappings", "select 'p' || s_suppkey as pair_id, 'Disagree' as verification, 'Low' as confidence, 'Verification skipped' as explanation from supplier")
def unverified_mappings(spark: SparkSession, folder: str) -> DataFrame:
    """With verification off, every verdict is Disagree, Low."""
    m = _table(spark, folder, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("pair_id"))
    return providers.verify(m).select("pair_id", "verification", "confidence", "explanation")


_PROMPT = f"""with {A.PAIRS}, n as (select *, row_number() over (partition by s_uri order by t_uri) - 1 as pos from pairs), b as (select s_uri as model, (pos // 10)::int as batch, pos, s_label, t_label from n)
  select model, batch, md5('Judge:' || chr(10) || string_agg(pos || '. ' || s_label || ' <-> ' || t_label, chr(10) order by pos)) as digest, model || ':' || md5('Judge:' || chr(10) || string_agg(pos || '. ' || s_label || ' <-> ' || t_label, chr(10) order by pos)) as key from b group by model, batch"""


@query("batch_prompts", _PROMPT)
def batch_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One numbered prompt for each batch of ten pairs, and its cache key."""
    from pyspark.sql import Window as W

    p = A.pairs(spark, folder).select(F.col("s_uri").alias("model"), "s_label", "t_label", "t_uri")
    p = p.withColumn("pos", F.row_number().over(W.partitionBy("model").orderBy("t_uri")) - 1)
    b = evaluate.batches(p, "pos", 10, "model").drop("t_uri")
    return providers.prompts(b, "Judge:").select("model", "batch", F.md5("prompt").alias("digest"), "key")


_MODELS = "(select unnest([" + ", ".join(f"'{m}'" for m in V.ANNOTATORS) + "]) as model, unnest(range(1, 10)) as place union all select 'Another', 1000 union all select n_name, 1000 from nation)"


@query("provider_schedule", f"select model, row_number() over (order by place, model) as turn from {_MODELS}")
def provider_schedule(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window as W

    names = spark.createDataFrame([(m,) for m in [*reversed(V.ANNOTATORS), "Another"]], "model string").unionByName(_table(spark, folder, "nation").select(F.col("n_name").alias("model")))
    return providers.schedule(names).select("model", F.row_number().over(W.orderBy("place", "model")).cast("long").alias("turn"))


@query(
    "provider_status",
    """select o_orderkey as id, case when o_orderkey % 3 = 0 then 'Skipped' when o_orderkey % 11 = 0 then 'Completed' else case o_orderkey % 8 when 0 then 'Rate Limited' when 1 then 'No Credits' when 2 then 'Invalid API Key' when 3 then 'Permission Denied' when 4 then 'Offline' when 5 then 'Offline' else 'Available' end end as status from orders""",
)
def provider_status(spark: SparkSession, folder: str) -> DataFrame:
    o, k = _table(spark, folder, "orders"), F.col("o_orderkey")
    code = F.when(k % 8 == 0, 429).when(k % 8 == 1, 402).when(k % 8 == 2, 401).when(k % 8 == 3, 403).when(k % 8 == 4, 500).when(k % 8 == 5, 404).when(k % 8 == 6, 200)
    return o.select(k.alias("id"), providers.status(k % 3 != 0, code, k % 11 == 0).alias("status"))


@query("selected_providers", "select unnest(['OpenAI', 'Groq', 'Mistral']) as model, unnest([1, 4, 7]) as place")
def selected_providers(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.createDataFrame([(m,) for m in V.ANNOTATORS], "model string")
    return providers.schedule(names.where(F.col("model").isin("Mistral", "OpenAI", "Groq"))).select("model", F.col("place").cast("int").alias("place"))


@query("embedded_texts", "select doc_id, case when exists (select 1 from benchmark b where b.text = d.text) then 3.0::double else 0.0::double end as total, 3 as size, md5(text) as key from documents d where text is not null union all select 100000000 + item_id, 3.0, 3, md5(text) from benchmark where text is not null")
def embedded_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings by the text's hash: cached vectors, and zeros where there is no encoder; equal texts are encoded once."""
    d, b = _table(spark, folder, "documents").where("text is not null"), _table(spark, folder, "benchmark").where("text is not null")
    cache = b.select(F.md5("text").alias("key"), F.array_repeat(F.lit(1.0).cast("float"), 3).alias("embedding")).dropDuplicates(["key"])
    texts = d.select("doc_id", "text").unionByName(b.select((F.col("item_id") + 100000000).alias("doc_id"), "text"))
    out = providers.embed_missing(texts, cache, size=3)[0]
    return out.select("doc_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("embedding").alias("size"), "key")


@query("new_embeddings", "select distinct md5(text) as key from documents where text is not null and md5(text) not in (select md5(text) from benchmark where text is not null)")
def new_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    d, b = _table(spark, folder, "documents").where("text is not null"), _table(spark, folder, "benchmark").where("text is not null")
    cache = b.select(F.md5("text").alias("key"), F.array_repeat(F.lit(1.0).cast("float"), 3).alias("embedding"))
    return providers.embed_missing(d.select("doc_id", "text"), cache, size=3)[1].select("key")


@query(
    "provider_report",
    f"""with {E._D}, s as (select a.model, count(*)::double as n, sum(a.y)::double as sx, sum(b.y)::double as sy, sum(a.y * b.y)::double as sxy from d a join d b on a.pos = b.pos and b.model = 'Truth' group by 1),
      c as (select d.model, count(*) filter (t.y = 1 and d.y = 1) as tp, count(*) filter (t.y = d.y) as same, count(*) as n from d join d t on t.pos = d.pos and t.model = 'Truth' group by d.model),
      u as (select model, count(*) as calls, sum(length(decision))::bigint as total_tokens, count(*) filter (decision = 'Uncertain') as failures from d group by model)
      select model, round(avg(y) * 100, 6) as agreement, any_value(c.tp) as tp, round(any_value(c.same / c.n), 6) as accuracy, round(any_value(coalesce((s.n * sxy - sx * sy) / nullif(sqrt((s.n * sx - sx * sx) * (s.n * sy - sy * sy)), 0), 0)), 6) as r,
        any_value(total_tokens) as total_tokens, round(any_value(total_tokens / 1000.0 * 0.002), 8) as cost, round(any_value((calls - failures) * 100.0 / calls), 6) as success_rate
      from d join c using (model) join s using (model) join u using (model) group by model""",
)
def provider_report(spark: SparkSession, folder: str) -> DataFrame:
    """One row a provider: rates, confusion and correlation against the truth, tokens and cost."""
    d = E.decisions(spark, folder)
    n = F.count(F.lit(1))
    usage = d.groupBy("model").agg(n.alias("n"), F.sum(F.length("decision")).alias("total_tokens"), n.alias("calls"), F.count_if(F.col("decision") == "Uncertain").alias("failures")).withColumn("rate", F.lit(0.002))
    report = evaluate.provider_report(d, usage, "Truth")
    return report.select("model", F.round("agreement", 6).alias("agreement"), "tp", F.round("accuracy", 6).alias("accuracy"), F.round("r", 6).alias("r"), "total_tokens", F.round("cost", 8).alias("cost"), F.round("success_rate", 6).alias("success_rate"))


@query("heuristic_decisions", f"with {A.SCORED}, r as (select *, {A._REL} as relationship from scored) select s_uri, t_uri, case when relationship in ('Partial Equivalent', 'Equivalent') then 'Agree' else 'Disagree' end as decision from r")
def heuristic_decisions(spark: SparkSession, folder: str) -> DataFrame:
    from verdanta.operators import align

    m = align.mappings(A.scored(spark, folder))
    return m.select("s_uri", "t_uri", evaluate.heuristic_decision(F.col("relationship")).alias("decision"))
