"""Agreement between annotators: long decisions (model, pos, decision), confusion, correlation, rates, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.functions import vocab as V


def decisions_long(wide: DataFrame, model: str = "model", decisions: str = "decisions") -> DataFrame:
    """Arrays of decisions by position; an unknown decision counts as Uncertain."""
    df = wide.select(F.col(model).alias("model"), F.posexplode(decisions).alias("pos", "decision"))
    return df.withColumn("decision", F.when(F.col("decision").isin(V.DECISIONS), F.col("decision")).otherwise("Uncertain"))


def binary(decision: Column) -> Column:
    return (F.coalesce(decision, F.lit("")) == "Agree").cast("int")


def heuristic_decision(relationship: Column) -> Column:
    return F.when(relationship.isin("Partial Equivalent", "Equivalent"), "Agree").otherwise("Disagree")


def aligned(decisions: DataFrame) -> DataFrame:
    """Decisions at the positions that every model has."""
    size = decisions.groupBy("model").agg(F.max("pos").alias("m")).agg(F.min("m").alias("m"))  # one row
    return decisions.join(F.broadcast(size), F.col("pos") <= F.col("m")).drop("m")


def confusion(decisions: DataFrame, truth: str) -> DataFrame:
    """Per model against ``truth``: tp, fp, fn, tn, accuracy, precision, recall, f1 (0 where undefined)."""
    d = decisions.select("model", "pos", binary(F.col("decision")).alias("y"))
    t = d.where(F.col("model") == truth).select("pos", F.col("y").alias("t"))
    c = d.join(t, "pos").groupBy("model").agg(
        F.count_if((F.col("t") == 1) & (F.col("y") == 1)).alias("tp"),
        F.count_if((F.col("t") == 0) & (F.col("y") == 1)).alias("fp"),
        F.count_if((F.col("t") == 1) & (F.col("y") == 0)).alias("fn"),
        F.count_if((F.col("t") == 0) & (F.col("y") == 0)).alias("tn"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn)})
    return c.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def correlations(decisions: DataFrame) -> DataFrame:
    """(a, b, r): Pearson correlation of every two models' 0/1 decisions, 0 for a constant one.

    Computed from sums: the built-in ``corr`` fails on a constant column.
    """
    d = decisions.select("model", "pos", binary(F.col("decision")).cast("double").alias("y"))
    p = d.select(F.col("model").alias("a"), "pos", F.col("y").alias("x")).join(d.select(F.col("model").alias("b"), "pos", "y"), "pos")
    s = p.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    low = F.sqrt((F.col("n") * F.col("sx") - F.col("sx") ** 2) * (F.col("n") * F.col("sy") - F.col("sy") ** 2))
    return s.select("a", "b", F.coalesce(F.try_divide(top, low), F.lit(0.0)).alias("r"))


def agreement_rates(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("model").agg((F.avg(binary(F.col("decision")).cast("double")) * 100).alias("agreement"))


def costs(usage: DataFrame) -> DataFrame:
    """usage (model, total_tokens, n, calls, failures, rate per 1000 tokens) with cost, cost_per_100 and success_rate."""
    tokens = F.col("total_tokens") / 1000.0
    return usage.withColumns(
        {
            "cost": tokens * F.col("rate"),
            "cost_per_100": F.coalesce(F.try_divide(F.col("total_tokens").cast("double"), F.col("n")), F.lit(0.0)) * 100 / 1000.0 * F.col("rate"),
            "success_rate": F.when(F.col("calls") > 0, (F.col("calls") - F.col("failures")) * 100.0 / F.col("calls")).otherwise(100.0),
        }
    )


def provider_report(decisions: DataFrame, usage: DataFrame, truth: str) -> DataFrame:
    """One row a provider: its rates, confusion against ``truth``, correlation with it, tokens and cost."""
    d = aligned(decisions)
    r = correlations(d).where(F.col("b") == truth).select(F.col("a").alias("model"), "r")
    return agreement_rates(decisions).join(confusion(d, truth), "model", "left").join(r, "model", "left").join(costs(usage), "model", "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def reply_items(reply: Column, field: str, size: Column, allowed: list[str], default: str) -> Column:
    """The values of ``field`` in a model's reply: fences and talk around the outermost [...] taken off; ``default`` for each item of a malformed reply or one of another length."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\[.*\])", 1)
    items = F.from_json(F.nullif(body, F.lit("")), f"array<struct<{field}: string>>", {"mode": "PERMISSIVE"})
    values = F.transform(items, lambda x: F.when(x[field].isin(allowed), x[field]).otherwise(F.lit(default)))
    return F.when(items.isNotNull() & (F.size(items) == size), values).otherwise(F.array_repeat(F.lit(default), size))


def batches(items: DataFrame, order: str, size: int, *by: str) -> DataFrame:
    """``items`` with batch: fixed-size chunks in order, within ``by`` (a bounded group, such as one model's items)."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return items.withColumn("batch", F.floor((n - 1) / size).cast("int"))
