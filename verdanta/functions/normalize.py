"""Typed values of facts: missing, boolean, date, number, text; categories of concepts; exact text forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdanta.functions import vocab as V

NUMBER = r"^[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?$"
ISO_DATE, DAY_FIRST = r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}-\d{2}-\d{4}$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes off blanks only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _has(c: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether one of the words is a substring: plain searches that end with the first word found.

    A long list is one constant array, so the generated code stays small; the
    text is bound once, so what makes it isn't run again for each word.
    """
    if len(words) > 8:
        return F.get(F.transform(F.array(c), lambda x: _has(x, words)), F.lit(0))
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def words_hit(c: Column, words: list[str]) -> Column:
    """How many of the words are substrings."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)))


def category(concept: Column, cached: Column | None = None) -> Column:
    """Environmental, Social or Governance by the first list with a keyword; else what the cache says; else Other."""
    rest = F.lit("Other") if cached is None else F.coalesce(cached, F.lit("Other"))
    of = lambda low: F.when(_has(low, V.ENVIRONMENTAL), "Environmental").when(_has(low, V.SOCIAL), "Social").when(_has(low, V.GOVERNANCE), "Governance")
    return F.coalesce(F.get(F.transform(F.array(F.lower(concept)), of), F.lit(0)), rest)


def with_float_text(df: DataFrame, number: str, name: str) -> DataFrame:
    """``df`` with ``name``: the double ``number`` as its shortest decimal text, plain from 1e-4 to under 1e16, else with a two-digit exponent.

    The JVM's text of a double may have a digit more than it needs; so the text
    with one digit less is taken where it is the same double. (Of texts equally
    short the JVM's may differ in the last digit; it is still the same double.)
    Each step is a column that the next ones read more than once, so the
    optimiser keeps the steps apart and nothing is computed twice.
    """
    c = lambda k: F.col(f"_f_{k}")
    same = lambda k: F.concat(c(k).cast("string"), F.lit("E"), (c("power") - c("size") + 2).cast("string")).try_cast("double") == F.abs(F.col(number))
    steps = [
        {"text": F.abs(F.col(number)).cast("string")},
        {"mantissa": F.substring_index(c("text"), "E", 1), "raised": F.when(F.contains(c("text"), F.lit("E")), F.substring_index(c("text"), "E", -1).try_cast("int")).otherwise(0)},
        {"whole": F.substring_index(c("mantissa"), ".", 1), "every": F.replace(c("mantissa"), F.lit("."), F.lit(""))},
        {"plain": F.ltrim(c("every"), F.lit("0"))},
        {"digits": F.rtrim(c("plain"), F.lit("0")), "power": F.length(c("whole")) - 1 - (F.length(c("every")) - F.length(c("plain"))) + c("raised")},
        {"size": F.length(c("digits"))},
        {"shorter": F.left(c("digits"), c("size") - 1).try_cast("long")},
        {"near": c("shorter") + (F.right(c("digits"), F.lit(1)) >= "5").cast("int")},
        {"far": 2 * c("shorter") + 1 - c("near")},
        {"found": F.when(c("size") < 2, None).when(same("near"), c("near")).when(same("far"), c("far")).cast("string")},
        {"power2": F.coalesce(c("power") + F.length(c("found")) - (c("size") - 1), c("power")), "digits2": F.coalesce(F.rtrim(c("found"), F.lit("0")), c("digits"))},
        {"size2": F.length(c("digits2")), "exponent": F.abs(c("power2")).cast("string")},
    ]
    power, digits, size = c("power2"), c("digits2"), c("size2")
    plain = F.concat(F.rpad(F.left(digits, power + 1), power + 1, F.lit("0")), F.lit("."), F.when(size > power + 1, F.substring(digits, power + 2, size)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    first = F.when(size > 1, F.concat(F.left(digits, F.lit(1)), F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(digits)
    science = F.concat(first, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(c("exponent"), F.greatest(F.lit(2), F.length(c("exponent"))), F.lit("0")))
    out = F.when(digits == "", "0.0").when((power >= 0) & (power < 16), plain).when((power < 0) & (power >= -4), small).otherwise(science)
    steps.append({"out": out})
    for step in steps:
        df = df.withColumns({f"_f_{k}": x for k, x in step.items()})
    return df.withColumn(name, F.concat(F.when(F.col(number).cast("string").startswith("-"), "-").otherwise(""), c("out"))).drop(*[f"_f_{k}" for step in steps for k in step])


def normalize(facts: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """``facts`` with normalized_value, value_type, num_value, bool_value, date_value and category.

    ``normalized_value`` is the text form of a value whose type differs by row:
    True or False, an ISO date, a whole number or a decimal, or the text itself;
    null for a missing value. The typed columns hold the value to compute with.
    ``cache`` (concept, category) has categories of concepts without a keyword.
    """
    v, low, number, shape = (F.col(f"_n_{k}") for k in ("value", "low", "number", "shape"))
    out = facts.withColumn("_n_value", strip(F.coalesce("value", F.lit(""))))
    if cache is not None:
        out = out.join(cache.select(F.col("concept"), F.col("category").alias("_n_cached")), "concept", "left")
    # in steps, each a column that the next ones read more than once: nothing is computed twice
    out = out.withColumns({"_n_low": F.lower(v), "_n_number": F.replace(v, F.lit(","), F.lit("")), "_n_concept": F.lower("concept")})
    date = F.when(v.rlike(ISO_DATE), "iso").when(v.rlike(DAY_FIRST), "day")
    kind = F.when((v == "") | v.isin(V.MISSING), "missing").when(low.isin(V.YES), "yes").when(low.isin(V.NO), "no")
    kind = kind.when(date.isNotNull(), date).when(number.rlike(NUMBER), F.when(number.rlike("[.eE]"), "float").otherwise("whole")).otherwise("text")
    out = out.withColumn("_n_shape", kind)
    numeric = shape.isin("float", "whole")
    whole = F.regexp_replace(F.regexp_replace(number, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    out = out.withColumns(
        {
            "num_value": F.when(numeric, number.try_cast("double")),
            "_n_whole": F.when(shape == "whole", whole),
            "_n_date": F.when(shape == "iso", v).when(shape == "day", F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))),
            "_n_percent": numeric & (contains_any(F.col("_n_concept"), V.PERCENT_WORDS) | F.coalesce(F.col("unit_ref") == V.PERCENT_UNIT, F.lit(False))),
        }
    )
    out = out.withColumn("_n_float", F.when(shape == "float", F.col("num_value")))
    out = with_float_text(out, "_n_float", "_n_text")
    plain = F.when(shape == "yes", "True").when(shape == "no", "False").when(shape.isin("iso", "day"), F.col("_n_date")).when(shape == "float", F.col("_n_text"))
    out = out.withColumns(
        {
            "value_type": F.when(shape.isin("yes", "no"), "boolean").when(shape.isin("iso", "day"), "date").when(numeric, F.when(F.col("_n_percent"), "percentage").otherwise("numeric")).otherwise("text"),
            "normalized_value": plain.when(shape == "whole", F.when(F.col("_n_whole") == "-0", "0").otherwise(F.col("_n_whole"))).when(shape == "text", v),
            "bool_value": F.when(shape == "yes", True).when(shape == "no", False),
            "date_value": F.col("_n_date").try_cast("date"),
            "category": category(F.col("concept"), F.col("_n_cached") if cache is not None else None),
        }
    )
    return out.drop(*[f"_n_{k}" for k in ("value", "low", "number", "concept", "shape", "whole", "date", "percent", "float", "text", "cached")])


def year_of(report_year: Column) -> Column:
    return F.substring_index(report_year, "-", 1)


def financial_year(start: Column, end: Column) -> Column:
    """2023-04-01 and 2024-03-31 as 2023-24."""
    a, b = F.substring_index(start, "-", 1), F.substring_index(end, "-", 1)
    return F.concat(a, F.lit("-"), F.when(F.length(b) == 4, F.right(b, F.lit(2))).otherwise(b))


def clean_name(c: Column) -> Column:
    """A label as part of an identifier: other signs than letters and digits as single underscores, none at the ends."""
    name = F.regexp_replace(F.regexp_replace(strip(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(name)


def namespace_of(namespaces: Column) -> Column:
    """A filing's namespace: the default one, else the capital-market one, else empty."""
    return F.coalesce(F.try_element_at(namespaces, F.lit("default")), F.try_element_at(namespaces, F.lit("in-capmkt")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
