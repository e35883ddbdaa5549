"""Facts, graph, layout, trees, alignment and evaluation: goldens and invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from verdanta.functions.normalize import normalize
from verdanta.operators import align, evaluate, graph, providers, segment, trees
from verdanta.operators import facts as ops
from verdanta.sources import files, filings, sinks
from verdanta.streaming import ingest

FILING = """<?xml version="1.0"?>
<xbrl xmlns="http://www.xbrl.org/2003/instance" xmlns:d="http://xbrl.org/2006/xbrldi" xmlns:c="urn:taxonomy">
 <context id="DCYMain"><entity><identifier scheme="s">L1</identifier></entity><period><startDate>2023-04-01</startDate><endDate>2024-03-31</endDate></period></context>
 <context id="I"><entity><segment><d:explicitMember dimension="x">ignored</d:explicitMember></segment></entity><period><instant>2024-03-31</instant></period>
  <scenario><d:explicitMember dimension="c:Axis">c:A</d:explicitMember><d:typedMember dimension="c:T"><c:v>7</c:v></d:typedMember></scenario></context>
 <context id="I"><period><instant>2025-03-31</instant></period></context>
 <unit id="u"><measure>INR</measure><measure>second</measure></unit>
 <c:NameOfTheCompany contextRef="DCYMain">{name}</c:NameOfTheCompany>
 <c:TotalScope1Emissions contextRef="DCYMain" unitRef="u" decimals="0">1,234</c:TotalScope1Emissions>
 <c:TotalWasteGenerated contextRef="nowhere">500</c:TotalWasteGenerated>
</xbrl>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in/Acme_Co/x").mkdir(parents=True)
    (tmp_path / "in/Acme_Co/x/FY2023-24.xml").write_text(FILING.format(name="Acme Limited"))
    (tmp_path / "in/Acme_Co/x/broken.XBRL").write_text(FILING.format(name="-").replace("</xbrl>", "<open>").replace("2023-04-01", "2022-04-01"))
    (tmp_path / "in/Acme_Co/x/bad.xml").write_text("no tags")
    return str(tmp_path / "in")


def test_filings(spark, folder):
    found = filings.find_files(spark, folder, folder + "/missing")
    assert found.count() == 3
    rows = filings.parse(found).cache()
    assert {r.parser: r["count"] for r in rows.where("kind = 'fact'").groupBy("parser").count().collect()} == {"strict": 3, "fallback": 3}
    assert filings.bad_files(rows).count() == 1
    ctx = ops.last_contexts(filings.contexts(rows)).where("source_file like '%FY2023%'")
    by = {r.context_id: r for r in ctx.collect()}
    assert by["I"].instant_date == "2025-03-31" and by["I"].dimensions == {} and by["DCYMain"].start_date == "2023-04-01"
    first = filings.contexts(rows).where("context_id = 'I' and dimensions['c:Axis'] = 'c:A'").first()
    assert first.dimensions == {"c:Axis": "c:A", "c:T": "7"} and first.period_type == "instant"
    assert {r.measure for r in filings.units(rows).collect()} == {"INR"}
    assert filings.find_files(spark, folder + "/missing").count() == 0


def test_a_broken_file_stops_no_other(spark):
    good = FILING.format(name="Acme")
    cases = {"good": good.encode(), "odd": good.replace('version="1.0"', 'version="1.0" encoding="x-nobody"').encode(), "utf16": good.replace('version="1.0"', 'version="1.0" encoding="utf-16"').encode(), "none": b"", "bytes": bytes(range(256)) * 4}
    rows = filings.parse(spark.createDataFrame(list(cases.items()), "path string, content binary")).collect()
    facts = {k: [r for r in rows if r.source_file == k and r.kind == "fact"] for k in cases}
    assert {k: (len(v), v[0].parser if v else None) for k, v in facts.items()} == {"good": (3, "strict"), "odd": (3, "fallback"), "utf16": (3, "fallback"), "none": (0, None), "bytes": (0, None)}
    assert {r.source_file for r in rows if r.kind == "bad"} == {"none", "bytes"}


def test_ingest_twice_leaves_one_copy(spark, folder, tmp_path):
    warehouse = str(tmp_path / "warehouse")
    facts = ingest.ingest(spark, folder, warehouse)
    one = {(r.company_name, r.report_year) for r in facts.collect()}
    assert one == {("Acme Limited", "2023-24"), ("Acme Co", "2022-24")}
    n = sinks.read_facts(spark, warehouse).count()
    ingest.ingest(spark, folder, warehouse)
    stored = sinks.read_facts(spark, warehouse)
    assert stored.count() == n == 6
    row = stored.where("concept = 'TotalScope1Emissions' and company_name = 'Acme Limited'").first()
    assert (row.normalized_value, row.value_type, row.category, row.period_type, row.dimensions_json) == ("1234", "numeric", "Environmental", "duration", "{}")
    assert stored.where("context_ref = 'nowhere' and period_type is null and dimensions_json = '{}'").count() == 2


def test_ingest_stream(spark, folder, tmp_path):
    for _ in range(2):
        q = ingest.ingest_stream(spark, folder, str(tmp_path / "w"), str(tmp_path / "c"))
        q.awaitTermination(120)
    assert sinks.read_facts(spark, str(tmp_path / "w")).count() == 6


def test_replace_and_ledger(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "1", 2)], "company_name string, report_year string, v int")
    new = spark.createDataFrame([("a", "1", 9), ("a", "1", 8), ("c", "1", 7)], "company_name string, report_year string, v int")
    assert sorted(r.v for r in ops.replace_keys(old, new).collect()) == [2, 7, 8, 9]
    files_ = spark.createDataFrame([("p", "h"), ("q", "h")], "path string, hash string")
    assert [r.path for r in ops.unprocessed(files_, spark.createDataFrame([("p", "h"), ("q", "old")], "path string, hash string")).collect()] == ["q"]


def test_graph_arithmetic(spark):
    """With F facts, C companies and Y years: 49 + C + Y + F nodes, 72 + 6 F edges; 615, 3 and 5 give 672 and 3762."""
    tags = list(graph.V.SOURCE_TAGS)
    rows = [(f"f{i}", i, tags[i % 8], "1", "c", "INR", ["Reliance Industries", "Tata Consultancy Services", "Other Co"][i % 3], f"{2019 + i % 5}-04-01", "{}") for i in range(615)]
    facts = normalize(spark.createDataFrame(rows, "source_file string, pos long, concept string, value string, context_ref string, unit_ref string, company_name string, report_year string, dimensions_json string"))
    nodes, edges = graph.build(spark, facts)
    assert (nodes.count(), edges.count()) == (672, 3762)
    assert {r.type: r["count"] for r in graph.edge_counts(edges).collect()} == {"BELONGS_TO": 655, "MAPS_TO": 1262, "REPORTS": 615, "HAS_METRIC": 615, "DISCLOSED_IN": 615}
    assert {r.label: r["count"] for r in graph.label_counts(nodes).collect()} == {"Category": 4, "Standard": 5, "CanonicalConcept": 8, "FrameworkTag": 32, "Company": 3, "Year": 5, "Fact": 615}
    row = graph.report(spark, nodes, edges, {"total_nodes": 672, "total_relationships": 1}).first()
    assert (row.status, row.errors, row.warnings) == ("PASSED", 0, 1)


def py_owners(kinds: list[tuple[str, str]]) -> list[int]:
    """A sequential scan: which heading owns each block."""
    s = p = g = q = -1
    out = []
    for i, (kind, number) in enumerate(kinds, 1):
        if kind == "section":
            s, p, g, q = i, -1, -1, -1
        elif kind == "principle":
            p, g, q = (i if number == "6" else -2 if s == -1 or True else -1), -1, -1
        elif kind in ("essential", "leadership"):
            g, q = i, -1
        elif kind == "question":
            q = i
        out.append(q if q > 0 else g if g > 0 else p if p > 0 else s)
    return out


def test_owners_follow_a_scan(spark):
    rng = random.Random(3)
    words = {"section": "SECTION A x", "principle": "PRINCIPLE {} x", "essential": "Essential Indicators", "question": "1. A question that is long enough", "body": "plain words"}
    rows, want = [], {}
    for d in range(30):
        kinds = [(rng.choice(list(words)), str(rng.choice([6, 6, 3]))) for _ in range(40)]
        for i, (k, n) in enumerate(kinds, 1):
            rows.append((f"d{d}", 1, i, float(i), 0.0, words[k].format(n), 9.0, False, 1))
        want[f"d{d}"] = py_owners(kinds)
    b = segment.in_order(segment.classify(spark.createDataFrame(rows, "doc string, page_num int, seq int, y0 double, x0 double, text string, avg_font_size double, is_bold boolean, line_count int")))
    got = segment.report_owners(b).where("heading_type = '' and not skipped").collect()
    assert len(got) > 100
    assert [(r.doc, r.pos, r.owner, want[r.doc][r.pos - 1]) for r in got if r.owner != want[r.doc][r.pos - 1]] == []


def test_report_tree_to_graph(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"framework":"BRSR","source_file":"acme_brsr.pdf","total_pages":3,"content":["intro"],"sections":[{"section_id":"C","label":"SECTION C","page_start":1,"page_end":3,"principles":[{"principle_num":6,"label":"Principle6","text":"Environment","page_start":2,"page_end":3,'
        '"indicator_groups":[{"group_type":"Essential","disclosures":[{"id":"Q1","label":"Q1","text":"Energy used","page_start":3,"page_end":3,"content":["a","b"],"metric":"Energy","unit":"GJ"}]}]}]}]}'
    )
    (tmp_path / "manifest.json").write_text("{}")
    t = files.read_trees(spark, str(tmp_path / "*.json"))
    nodes, edges = trees.report_graph(t)
    core = nodes.where("class not in ('Metric', 'Unit')")
    assert core.count() == 4 and edges.where("relation not in ('hasMetric', 'hasUnit')").count() == 6 and edges.count() == 8
    q = nodes.where("class = 'Disclosure'").first()
    assert (q.page_start, q.page_end, q.text) == (3, 3, "Energy used\na\nb")
    c = trees.concepts(nodes, edges).first()
    assert (c.framework, c.metric, c.unit, c.hierarchy_path) == ("BRSR", "Energy", "GJ", ["Principle6"])
    assert trees.triples(nodes, edges).where("p like '%pageStart' and o = '3' and datatype like '%integer'").count() == 1
    assert trees.base_triples(spark).count() > 10
    sinks.write_triples(trees.triples(nodes, edges), str(tmp_path / "nt"))
    assert spark.read.text(str(tmp_path / "nt")).where(r"value like '%Energy used\\\\na%'").count() == 1
    sinks.write_graph(core.select(F.col("uri").alias("id"), F.col("class").alias("label"), "name", *[F.lit("").alias(x) for x in graph.NODE[3:]]), edges.toDF(*graph.EDGE), str(tmp_path / "csv"))
    assert files.read_graph_csv(spark, str(tmp_path / "csv/nodes"), files.NODES).count() == 4
    assert sinks.manifest(t).first().sections == 1


def test_standard_tree_to_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"framework":"GRI","source_file":"GRI 303.pdf","standards":[{"standard_id":"GRI 303","title":"GRI 303: Water","disclosures":[{"id":"Topic_1","label":"t","text":"x","requirements":[]},{"id":"303-1","label":"d","text":"y","requirements":[{"type":"REQUIREMENTS","content":[]},{"type":"GUIDANCE","content":[]},{"type":"GUIDANCE","content":["z"]}]}]}]}'
    )
    nodes, edges = trees.standard_graph(files.read_trees(spark, str(tmp_path / "g.json")))
    assert {r["class"]: r["count"] for r in nodes.groupBy("class").count().collect()} == {"Framework": 1, "Topic": 2, "Disclosure": 1, "Requirement": 3}
    assert edges.count() == 2 * (1 + 2 + 3)


def test_long_documents_in_parts(spark, monkeypatch):
    for name, value in {"PART": 20, "ROWS_A_TASK": 25}.items():
        monkeypatch.setattr(segment, name, value, raising=False)
    rng = random.Random(3)
    texts = ["SECTION A: General", "PRINCIPLE 2 of conduct", "Principle 6 environment", "Essential Indicators", "3. Provide details of the measures taken", "text", "more text"]
    rows = []
    for doc, n, pages, heights in (("one page", 90, 1, 40), ("pages", 150, 25, 9), ("flat", 50, 2, 1), ("short", 9, 3, 5), (None, 45, 2, 30)):
        # the heights lie unevenly; some pages and heights are not known; rows are alike but for their text and fonts
        rows += [(doc, rng.choice([None, *range(pages)]), 0, rng.choice([None, rng.randrange(heights) ** 2 / 3]), 0.0, rng.choice(texts[-2 - 5 * (rng.random() < 0.4) :]), 12.0, rng.random() < 0.5, 1) for _ in range(n)]
    blocks = segment.classify(spark.createDataFrame(rows, "doc string, page_num int, seq int, y0 double, x0 double, text string, avg_font_size double, is_bold boolean, line_count int"))
    placed = segment.in_order(blocks)
    by_doc = lambda got: {d: [r for r in got if r.doc == d] for d in {r.doc for r in got}}
    first = lambda v: (v is not None, v)
    for part in by_doc(placed.collect()).values():
        part.sort(key=lambda r: r.pos)
        assert [r.pos for r in part] == list(range(1, len(part) + 1))
        keys = [(first(r.page_num), first(r.y0), r.text, r.is_bold) for r in part]
        assert keys == sorted(keys)
    owned = segment.report_owners(placed).withColumn("task", F.spark_partition_id()).collect()
    assert len(owned) == len(rows)
    for part in by_doc(owned).values():
        s = p = x = g = q = -1
        for r in sorted(part, key=lambda r: r.pos):
            at, kind = r.pos, r.heading_type
            s, g, q = (at if kind == "section" else s), (at if kind in ("essential", "leadership") else g), (at if kind == "question" else q)
            p, x = (at if r.text.startswith("Principle 6") else p), (at if r.text.startswith("PRINCIPLE 2") else x)
            top = max(s, p, x)
            assert r.owner == (q if q > top and q > g else g if g > top else p if p > max(s, x) else s)
            assert r.skipped == (x >= 0 and x == top)
    # one document's blocks are not in one task
    assert len({r.task for r in owned if r.doc == "pages"}) > 1
    rolled = {(r.doc, r.section): r.n_headings for r in segment.section_pages(placed).collect()}
    assert sum(rolled.values()) == sum(r.heading_type != "" for r in owned)


def pair(spark, s: dict, t: dict):
    base = {"label": "", "concept_type": "Disclosure", "definition": "", "unit": None, "datatype": None, "hierarchy_path": []}
    schema = "uri string, label string, concept_type string, definition string, unit string, datatype string, hierarchy_path array<string>"
    side = lambda d: align.prepare(spark.createDataFrame([tuple((base | d)[c.split()[0]] for c in schema.split(", "))], schema))
    return align.all_pairs(side(s), side(t))


def test_rules(spark):
    p = pair(spark, {"uri": "s", "label": "Water", "unit": "kl", "datatype": "float", "hierarchy_path": ["Principle 6"]}, {"uri": "t", "label": "Water", "unit": "KL ", "datatype": "float", "hierarchy_path": ["GRI 303"]})
    row = align.apply_rules(p.withColumn("similarity", F.lit(0.8))).first()
    assert row.score == pytest.approx(0.84) and "Rule 1" in row.reasoning[0]
    assert align.score_pairs(p).first().lexical_score == 1.0


def test_all_pairs_of_any_number(spark, monkeypatch):
    for name, value in {"MAX_SIDE": 3, "BLOCK": 2, "PAIRS_A_TASK": 4}.items():
        monkeypatch.setattr(align, name, value, raising=False)
    side = lambda n: spark.createDataFrame([(f"c{i}", i) for i in range(n)], "uri string, x int")
    for n, m in ((2, 9), (9, 2), (5, 7), (0, 4), (4, 0), (1, 1)):
        got = align.all_pairs(side(n), side(m))
        assert got.columns == ["s_uri", "s_x", "t_uri", "t_x"]
        assert sorted((r.s_x, r.t_x) for r in got.collect()) == [(i, j) for i in range(n) for j in range(m)]
        parts = got.rdd.getNumPartitions()
        assert parts >= {18: 5, 35: 12}.get(n * m, 0)  # a task makes a bounded number of pairs


def test_greedy_repair_is_greedy(spark):
    rng = random.Random(7)
    for _ in range(5):
        rows = [(f"s{i}", f"t{j}", round(rng.uniform(0.8, 1), 2)) for i in range(8) for j in range(8) if rng.random() < 0.6]
        got = align.one_to_one(spark.createDataFrame(rows, "s_uri string, t_uri string, score double"))
        used: set[str] = set()
        want = set()
        for s, t, x in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if x >= 0.85 and not {s, t} & used:
                used |= {s, t}
                want.add((s, t))
        out = got.collect()
        assert {(r.s_uri, r.t_uri) for r in out if r.retained} == want
        assert all(r.score == 0.74 for r in out if r.retained is False) and len(out) == len(rows)


#: Decisions of 79 mappings: agree / tp against the truth model; the rest follows from 35 agreements of the truth.
AGREEMENT = {"A": (36, 28, 0.8101, 0.7778, 0.8000, 0.7887, 0.6166), "B": (37, 17, 0.5190, 0.4595, 0.4857, 0.4722, 0.0310), "C": (0, 0, 0.5570, 0.0, 0.0, 0.0, 0.0), "D": (41, 30, 0.7975, 0.7317, 0.8571, 0.7895, 0.6036), "E": (38, 35, 0.9620, 0.9211, 1.0, 0.9589, 0.9264)}


def test_agreement_goldens(spark):
    rows = [("Truth", ["Agree"] * 35 + ["Disagree"] * 32 + ["Uncertain"] * 12)]
    for m, (agree, tp, *_) in AGREEMENT.items():
        rows.append((m, ["Agree"] * tp + ["Disagree"] * (35 - tp) + ["Agree"] * (agree - tp) + ["odd"] * (44 - agree + tp)))
    d = evaluate.aligned(evaluate.decisions_long(spark.createDataFrame(rows, "model string, decisions array<string>")))
    c = {r.model: r for r in evaluate.confusion(d, "Truth").collect()}
    r = {x.a: x.r for x in evaluate.correlations(d).where("b = 'Truth'").collect()}
    for m, (_, tp, acc, p, rec, f1, pearson) in AGREEMENT.items():
        assert c[m].tp == tp
        assert [round(v, 4) for v in (c[m].accuracy, c[m].precision, c[m].recall, c[m].f1, r[m])] == [acc, p, rec, f1, pearson]


def test_replies(spark):
    replies = ['```json\n[{"decision": "Agree"}, {"decision": "?"}]\n```', "[1, 2]", "nothing", None, '[{"decision": "Agree"}]']
    got = spark.createDataFrame([(x,) for x in replies], "x string").select(evaluate.reply_items(F.col("x"), "decision", F.lit(2), graph.V.DECISIONS if hasattr(graph.V, "DECISIONS") else [], "Uncertain")).collect()
    assert got[0][0] == ["Agree", "Uncertain"] and all(r[0] == ["Uncertain", "Uncertain"] for r in got[1:])


def test_providers(spark):
    cache = spark.createDataFrame([("known", "Social")], "concept string, category string")
    asked = spark.createDataFrame([("known",), ("new",), ("new",)], "concept string")
    out, new = providers.classify_concepts(asked, cache)
    assert sorted((r.concept, r.category) for r in out.collect()) == [("known", "Social"), ("new", "Other"), ("new", "Other")] and new.count() == 1
    maps = spark.createDataFrame([("p1",), ("p2",)], "pair_id string")
    assert {(r.verification, r.confidence) for r in providers.verify(maps).collect()} == {("Disagree", "Low")}
    assert {r.confidence for r in providers.verify(maps, lambda items: [{"verification": "Agree"}] * len(items)).collect()} == {"Medium"}
    assert {r.verification for r in providers.verify(maps, lambda items: []).collect()} == {"Disagree"}
    texts = spark.createDataFrame([("short",), ("long enough for a call",)], "text string")
    assert providers.enrich(texts, lambda items: [{"metric": "m"} for _ in items]).where("metric = 'm'").count() == 1
    vectors, fresh = providers.embed_missing(texts, spark.createDataFrame([], "key string, embedding array<float>"), size=3)
    assert {tuple(r.embedding) for r in vectors.collect()} == {(0.0, 0.0, 0.0)} and fresh.count() == 2


def test_retries():
    waits: list[float] = []
    replies = iter([(429, {"Retry-After": "90"}, None), (503, {}, None), (200, {}, "fine")])
    assert providers.with_retries(lambda: next(replies), sleep=waits.append, noise=lambda: 0.0) == "fine" and waits == [30.0, 6.0]
    with pytest.raises(PermissionError):
        providers.with_retries(lambda: (401, {}, None), sleep=waits.append)


def test_paths(spark):
    df = spark.createDataFrame([("/d/Acme/BRSR/FY24.pdf",), ("/d/x/GRI 205_ Anti.pdf",), ("/d/x/GRI 2_ General.pdf",), ("/d/x/GRI 303_ Water.pdf",), ("/d/x/GRI 13_ Farm.pdf",)], "path string")
    row = df.select(files.company_of_path(F.col("path")), files.year_of_path(F.col("path"))).first()
    assert list(row) == ["Acme", "FY24"]
    kept = [r.path.rsplit("/", 1)[1] for r in df.where(files.wanted_document(F.col("path"), environmental_only=True)).collect()]
    assert kept == ["FY24.pdf", "GRI 2_ General.pdf", "GRI 303_ Water.pdf"]
    assert files.report_documents(df, ["Acme"]).count() == 1


def test_tables_exist_once(spark):
    sinks.create_tables(spark)
    sinks.create_tables(spark)
    assert [c for c, _ in spark.table("esg_facts").dtypes][-2:] == ["company_name", "report_year"]


def test_config(tmp_path):
    from verdanta import config

    (tmp_path / "c.json").write_text('{"thresholds": {"partial": 0.6}, "top_k": 5}')
    c = config.load(str(tmp_path / "c.json"), {"VERDANTA_TOP_K": "7", "VERDANTA_WEIGHTS": '{"lexical": 0.5}'})
    assert (c.top_k, c.thresholds["partial"], c.thresholds["equivalent"], c.weights["lexical"], c.verify_chunk) == (7, 0.6, 0.7, 0.5, 15)
    (tmp_path / "c.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"), {})


def test_timed():
    from verdanta.session import timed

    with timed("nothing") as took:
        pass
    assert 0 <= took["seconds"] < 1
