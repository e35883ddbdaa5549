"""Validation of typed facts: errors make a fact invalid, warnings don't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import contains_any


def validate(facts: DataFrame) -> DataFrame:
    """``facts`` (normalized) with is_valid, n_errors, n_warnings and issues (texts)."""
    present = F.col("normalized_value").isNotNull()
    kind, number = F.col("value_type"), F.col("num_value")
    numeric = number.isNotNull()
    checks = [
        ("E", present & (kind == "numeric") & ~numeric, "Expected a number for '%s', got %s"),
        ("E", present & (kind == "percentage") & ~numeric, "Expected a percentage for '%s', got %s"),
        ("E", present & (kind == "boolean") & F.col("bool_value").isNull(), "Expected a boolean for '%s', got %s"),
        ("W", (kind == "percentage") & (number < 0), "Percentage '%s' is negative: %s"),
        ("W", (kind == "percentage") & (number > 100), "Percentage '%s' is over 100: %s"),
        ("W", numeric & contains_any(F.lower("concept"), V.NON_NEGATIVE_WORDS) & (number < 0), "'%s' is usually not negative: %s"),
    ]
    # each test is a column of its own, computed once
    df = facts.withColumns({f"_t{i}": F.coalesce(test, F.lit(False)) for i, (_, test, _) in enumerate(checks)})
    said = [F.when(F.col(f"_t{i}"), F.format_string(text, "concept", "normalized_value")) for i, (_, _, text) in enumerate(checks)]
    count = lambda k: sum((F.col(f"_t{i}").cast("int") for i, (x, _, _) in enumerate(checks) if x == k), F.lit(0))
    df = df.withColumns({"issues": F.array_compact(F.array(*said)), "n_errors": count("E"), "n_warnings": count("W")})
    return df.withColumn("is_valid", F.col("n_errors") == 0).drop(*[f"_t{i}" for i in range(len(checks))])


def summary(validated: DataFrame) -> DataFrame:
    """One row: facts, errors (facts that are invalid), warnings."""
    return validated.agg(
        F.count(F.lit(1)).alias("facts"),
        F.coalesce(F.sum((~F.col("is_valid")).cast("long")), F.lit(0)).alias("errors"),
        F.coalesce(F.sum("n_warnings"), F.lit(0)).cast("long").alias("warnings"),
    )
