"""The command line from filings to a checked graph, and from trees to mappings."""

from __future__ import annotations

import json

from tests.test_operators import FILING
from verdanta import __main__ as cli


def test_ingest_and_graph(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/FY2023-24.xml").write_text(FILING.format(name="Acme Limited"))
    w = str(tmp_path / "w")
    counts = {r.category: r["count"] for r in cli.ingest(spark, [str(tmp_path / "in")], w).collect()}
    assert counts == {"Environmental": 2, "Other": 1}
    assert {r.category: r["count"] for r in cli.ingest(spark, [str(tmp_path / "in")], w).collect()} == counts
    assert cli.main(["graph", "--warehouse", w, "--out", str(tmp_path / "g")]) == 0
    assert spark.read.json(str(tmp_path / "g/counts")).where("label = 'Fact'").first()["count"] == 2


def test_ingest_keeps_other_files_of_a_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    w, text = str(tmp_path / "w"), FILING.format(name="Acme Limited")
    total = lambda: sum(r["count"] for r in cli.ingest(spark, [str(tmp_path / "in")], w).collect())
    (tmp_path / "in/a.xml").write_text(text)
    assert total() == 3
    (tmp_path / "in/b.xml").write_text(text)
    assert total() == 6
    (tmp_path / "in/a.xml").write_text(text.replace('<c:TotalWasteGenerated contextRef="nowhere">500</c:TotalWasteGenerated>', ""))
    assert total() == 5
    assert sum(r["count"] for r in cli.ingest(spark, [str(tmp_path / "in")], w, fresh=True).collect()) == 5


def test_align(spark, tmp_path):
    report = {"framework": "BRSR", "source_file": "a_brsr.pdf", "sections": [{"section_id": "C", "label": "SECTION C", "disclosures": [{"id": "Q1", "label": "Water withdrawal by source", "text": "Water withdrawal"}]}]}
    standard = {"framework": "GRI", "source_file": "GRI 303.pdf", "standards": [{"standard_id": "GRI 303", "title": "GRI 303: Water", "disclosures": [{"id": "303-3", "label": "Water withdrawal by source", "text": "w", "requirements": []}]}]}
    for name, tree in (("r", report), ("s", standard)):
        (tmp_path / f"{name}.json").write_text(json.dumps(tree))
    assert cli.main(["ontology", str(tmp_path / "*.json"), "--out", str(tmp_path / "o")]) == 0
    assert cli.align_trees(spark, str(tmp_path / "*.json"), str(tmp_path / "m"), blocked=True).count() == 1
    assert spark.read.json(str(tmp_path / "m/mappings")).first().s_label == "Water withdrawal by source"
    (tmp_path / "d.json").write_text('{"model": "T", "decisions": ["Agree", "Disagree"]}\n{"model": "M", "decisions": ["Agree", "Agree"]}\n')
    assert {r.model: r.fp for r in cli.agreement(spark, str(tmp_path / "d.json"), "T").collect()} == {"T": 0, "M": 1}
