"""Values, categories and labels against independent Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from verdanta.functions import vocab as V
from verdanta.functions.normalize import category, clean_name, financial_year, normalize, with_float_text
from verdanta.operators import align
from verdanta.operators.validate import summary, validate

GOLDEN = [
    ("Any", None, " Nil ", "text", None), ("Any", None, "-", "text", None), ("Any", None, "Not applicable", "text", None), ("Any", None, " ", "text", None), ("Any", None, None, "text", None),
    ("Any", None, "nil", "text", "nil"), ("Any", None, "Yes", "boolean", "True"), ("Any", None, "N", "boolean", "False"), ("Any", None, "31-03-2024", "date", "2024-03-31"), ("Any", None, "2024-13-99", "date", "2024-13-99"),
    ("AmountSpent", "INR", "1,234", "numeric", "1234"), ("AmountSpent", "INR", "1.5e3", "numeric", "1500.0"), ("AmountSpent", "INR", ".5", "numeric", "0.5"), ("AmountSpent", "INR", "5.", "text", "5."),
    ("X", "pure", "12", "percentage", "12"), ("TotalWasteGenerated", None, "500", "percentage", "500"), ("X", None, "-0", "numeric", "0"), ("X", None, "+007", "numeric", "7"), ("X", None, "123456789012345678901234", "numeric", "123456789012345678901234"), ("X", None, "5d", "text", "5d"),
]


def test_values(spark):
    df = spark.createDataFrame([(i, c, u, v) for i, (c, u, v, _, _) in enumerate(GOLDEN)], "pos long, concept string, unit_ref string, value string")
    got = {r.pos: r for r in normalize(df).collect()}
    for i, (_, _, value, kind, text) in enumerate(GOLDEN):
        assert (got[i].value_type, got[i].normalized_value) == (kind, text), value
    assert got[9].date_value is None and str(got[8].date_value) == "2024-03-31"


def test_floats_as_text(spark):
    rng = random.Random(1)
    values = [0.0, 1.0, -1.5, 1e16, 1e15, 1.25e-5, 1e-4, 123456789.125, 1.2345678e7, 5e-324, 1.7976931348623157e308, 1e22, 9999999999999998.0] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 22) for _ in range(500)]
    got = with_float_text(spark.createDataFrame([(v,) for v in values], "x double"), "x", "t").collect()
    assert all(float(r.t) == r.x and len(r.t) <= len(repr(r.x)) + 1 for r in got)
    assert sum(r.t != repr(r.x) for r in got) <= 10  # a last digit that makes no other double


@pytest.mark.parametrize(
    ("concept", "want"),
    [("TotalScope1Emissions", "Environmental"), ("NumberOfFemaleEmployeesOrWorkers", "Social"), ("PercentageOfFemaleBoardOfDirectors", "Social"), ("SignatureDate", "Environmental"), ("NumberOfStreetVendors", "Environmental"), ("WindingUp", "Environmental"), ("BoardMeetings", "Governance"), ("CorporateIdentityNumber", "Other")],
)
def test_categories(spark, concept, want):
    assert spark.range(1).select(category(F.lit(concept))).first()[0] == want


def test_plan_of_values_stays_small(spark):
    df = validate(normalize(spark.createDataFrame([("X", None, "1.5", 1)], "concept string, unit_ref string, value string, pos long")))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 25_000 and plan.count("regexp_replace") <= 8


def test_category_cache(spark):
    df = spark.createDataFrame([("Qqq", None, "1"), ("Xxx", None, "1"), ("WaterUse", None, "1")], "concept string, unit_ref string, value string")
    cache = spark.createDataFrame([("Qqq", "Social"), ("WaterUse", "Governance")], "concept string, category string")
    assert {r.concept: r.category for r in normalize(df, cache).collect()} == {"Qqq": "Social", "Xxx": "Other", "WaterUse": "Environmental"}


def test_keyword_lists():
    assert [len(x) for x in (V.ENVIRONMENTAL, V.SOCIAL, V.GOVERNANCE)] == [52, 69, 43]


def test_validation(spark):
    rows = [("Percentage1", None, "-3"), ("Percentage2", None, "101"), ("AmountOfX", None, "-1"), ("X", None, "-1"), ("X", None, "Nil"), ("NumberOfGenerated", None, "-4")]
    v = validate(normalize(spark.createDataFrame(rows, "concept string, unit_ref string, value string")))
    assert [r.n_warnings for r in v.collect()] == [1, 1, 1, 0, 0, 2]
    assert summary(v).first().asDict() == {"facts": 6, "errors": 0, "warnings": 5}
    broken = normalize(spark.createDataFrame([("X", None, "4")], "concept string, unit_ref string, value string")).withColumn("num_value", F.lit(None).cast("double"))
    assert summary(validate(broken)).first().errors == 1


def test_names(spark):
    row = spark.range(1).select(clean_name(F.lit(" Écart (net) — 5% ")), clean_name(F.lit("")), financial_year(F.lit("2023-04-01"), F.lit("2024-03-31"))).first()
    assert list(row) == ["Écart_net_5", "unknown", "2023-24"]


def py_tokens(text: str) -> list[str]:
    text = text.lower()
    for pattern, new in V.PHRASES:
        text = re.sub(pattern, new, text)
    return [V.SYNONYMS.get(w, w) for w in re.findall(r"\w+", text) if w not in V.STOP_WORDS]


def test_lexical_tokens(spark):
    texts = ["Total Greenhouse Gases and CO2", "Water withdrawal and consumption", "Anti - corruption; anti corruption", "Wages of Workers in the staff", "", "Émissions d'énergie"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(align.lexical_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [py_tokens(t) for t in texts]


def py_jaccard(a: str, b: str) -> float:
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    return len(x & y) / len(x | y) if x and y else 0.0


def py_structural(s: list[str], t: list[str]) -> float:
    if not s and not t:
        return 0.0
    near = py_jaccard(s[0], t[0]) if s and t else 0.0
    num = den = 0.0
    for i, a in enumerate(s):
        sims = [py_jaccard(a, b) for b in t]
        j = max(range(len(t)), key=lambda k: sims[k]) if t and max(sims) > 0 else 0
        w = (1 / (i + 1) + 1 / (j + 1)) / 2
        num, den = num + (sims[j] if t else 0) * w, den + w
    den += sum(1 / (k + 1) for k, b in enumerate(t) if max([py_jaccard(a, b) for a in s], default=0) < 0.5)
    return 0.4 * near + 0.4 * (num / den if den else 0) + 0.2 * max(0.0, 1 - 0.15 * abs(len(s) - len(t)))


def test_structural(spark):
    rng = random.Random(5)
    name = lambda: " ".join(rng.choice(["water", "énergie", "GRI 303", "waste", "topic", "a"]) for _ in range(rng.randint(0, 3)))
    rows = [([name() for _ in range(rng.randint(0, 4))], [name() for _ in range(rng.randint(0, 4))]) for _ in range(200)]
    words = lambda c: F.transform(c, align.word_set)
    got = spark.createDataFrame(rows, "s array<string>, t array<string>").select(align.structural(words(F.col("s")), words(F.col("t"))).alias("x")).collect()
    for (s, t), r in zip(rows, got):
        assert r.x == pytest.approx(py_structural(s, t), abs=1e-9), (s, t)


def test_sequence_ratio(spark):
    from difflib import SequenceMatcher

    rows = [("water withdrawal", "withdrawal of water"), ("", ""), ("a" * 300, "a" * 250 + "b"), ("Gas", "gas")]
    got = spark.createDataFrame(rows, "a string, b string").select(align.sequence_ratio("a", "b")).collect()
    assert [r[0] for r in got] == [SequenceMatcher(None, a, b).ratio() for a, b in rows]
