"""Queries over annotator agreement, cost, caches and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.operators import evaluate, providers
from verdanta.plans import inputs as I
from verdanta.plans.registry import query

_D = f"d as (select model, pos, (decision = 'Agree')::int as y, decision from ({I.duck(I.DECISIONS)}) x)"


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return I.run(spark, folder, I.DECISIONS)


@query(
    "agreement_confusion",
    f"""with {_D}, c as (select d.model, count(*) filter (t.y = 1 and d.y = 1) as tp, count(*) filter (t.y = 0 and d.y = 1) as fp, count(*) filter (t.y = 1 and d.y = 0) as fn, count(*) filter (t.y = 0 and d.y = 0) as tn
        from d join d t on t.pos = d.pos and t.model = 'Truth' group by d.model),
      m as (select *, (tp + tn) / (tp + fp + fn + tn) as a, coalesce(tp / nullif(tp + fp, 0), 0) as p, coalesce(tp / nullif(tp + fn, 0), 0) as r from c)
      select model, tp, fp, fn, tn, round(a, 6) as accuracy, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from m""",
)
def agreement_confusion(spark: SparkSession, folder: str) -> DataFrame:
    c = evaluate.confusion(evaluate.aligned(decisions(spark, folder)), "Truth")
    return c.select("model", "tp", "fp", "fn", "tn", *[F.round(k, 6).alias(k) for k in ("accuracy", "precision", "recall", "f1")])


@query(
    "agreement_pearson",
    f"""with {_D}, s as (select a.model as a, b.model as b, count(*)::double as n, sum(a.y)::double as sx, sum(b.y)::double as sy, sum(a.y * b.y)::double as sxy from d a join d b on a.pos = b.pos group by 1, 2)
      select a, b, round(coalesce((n * sxy - sx * sy) / nullif(sqrt((n * sx - sx * sx) * (n * sy - sy * sy)), 0), 0), 6) as r from s""",
)
def agreement_pearson(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.correlations(decisions(spark, folder)).withColumn("r", F.round("r", 6))


@query("agreement_rate", f"with {_D} select model, round(avg(y) * 100, 6) as agreement from d group by model")
def agreement_rate(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.agreement_rates(decisions(spark, folder)).withColumn("agreement", F.round("agreement", 6))


@query(
    "cost_per_100",
    f"""with {_D}, u as (select model, count(*) as n, sum(length(decision))::bigint as total_tokens, count(*) as calls, count(*) filter (decision = 'Uncertain') as failures, 0.002 as rate from d group by model)
      select model, total_tokens, round(total_tokens / 1000.0 * rate, 8) as cost, round(total_tokens / n * 100 / 1000.0 * rate, 8) as cost_per_100, round((calls - failures) * 100.0 / calls, 6) as success_rate from u""",
)
def cost_per_100(spark: SparkSession, folder: str) -> DataFrame:
    d = decisions(spark, folder)
    u = d.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("decision")).alias("total_tokens"), F.count(F.lit(1)).alias("calls"), F.count_if(F.col("decision") == "Uncertain").alias("failures")).withColumn("rate", F.lit(0.002))
    return evaluate.costs(u).select("model", "total_tokens", F.round("cost", 8).alias("cost"), F.round("cost_per_100", 8).alias("cost_per_100"), F.round("success_rate", 6).alias("success_rate"))


@query("decision_batches", f"with {_D} select model, cast(floor(pos / 10) as int) as batch, count(*) as n, min(pos) as first from d group by 1, 2")
def decision_batches(spark: SparkSession, folder: str) -> DataFrame:
    b = evaluate.batches(decisions(spark, folder), "pos", 10, "model")
    return b.groupBy("model", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query(
    "reply_recovery",
    """with c as (select conv_id, turn, case cast(conv_id % 4 as int) when 0 then '```json' || chr(10) || '[{"decision":"Agree"},{"decision":"Maybe"}]' || chr(10) || '```' when 1 then 'Sure: [{"decision":"Disagree"},{"decision":"Agree"}] done' when 2 then '[{"decision":"Agree"}]' else 'no answer' end as reply from conversations)
      select conv_id, turn, case when conv_id % 4 = 0 then 'Agree,Uncertain' when conv_id % 4 = 1 then 'Disagree,Agree' else 'Uncertain,Uncertain' end as decisions from c""",
)
def reply_recovery(spark: SparkSession, folder: str) -> DataFrame:
    c, k = spark.read.parquet(f"{folder}/conversations.parquet"), F.col("conv_id")
    reply = F.when(k % 4 == 0, '```json\n[{"decision":"Agree"},{"decision":"Maybe"}]\n```').when(k % 4 == 1, 'Sure: [{"decision":"Disagree"},{"decision":"Agree"}] done').when(k % 4 == 2, '[{"decision":"Agree"}]').otherwise("no answer")
    items = evaluate.reply_items(reply, "decision", F.lit(2), V.DECISIONS, "Uncertain")
    return c.select("conv_id", "turn", F.array_join(items, ",").alias("decisions"))


@query(
    "cache_miss_only",
    "with c as (select distinct md5(text) as k from benchmark where item_id % 2 = 0) select distinct md5(text) as key from (select text from documents where text is not null union all select text from benchmark) where md5(text) not in (select k from c)",
)
def cache_miss_only(spark: SparkSession, folder: str) -> DataFrame:
    b = spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("text").where("text is not null").unionByName(b.select("text"))
    return providers.misses(texts.select(F.md5("text").alias("key")), b.where("item_id % 2 = 0").select(F.md5("text").alias("key")), ["key"])


@query("open_work_items", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def open_work_items(spark: SparkSession, folder: str) -> DataFrame:
    docs, done = (spark.read.parquet(f"{folder}/{t}.parquet").select("doc_id") for t in ("documents", "labels"))
    return providers.open_items(docs, done, ["doc_id"])
