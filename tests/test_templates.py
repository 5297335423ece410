"""The shipped templates, files anywhere that Spark reads, defects, and the printed report."""

import re

import pytest

from larkspan.functions.schema import DOMAINS, LABELS
from larkspan.operators import metrics, templates
from larkspan.sources import reports
from larkspan.sources.templates import SHIPPED, label_support, load_templates, missing_labels, shipped_templates, template_defects

SLOTS = {*templates.VALUES, *templates.NUMBERS}


def test_shipped_files(spark):
    table = load_templates(spark, SHIPPED.as_uri())
    assert sorted(map(repr, table.collect())) == sorted(map(repr, shipped_templates(spark).collect()))
    rows = table.collect()
    assert {r["domain"] for r in rows} == set(DOMAINS) == {f.stem for f in SHIPPED.glob("*.yaml")}
    assert all(r["n_patterns"] >= 10 for r in rows) and len({r["text_template"] for r in rows}) == len(rows)
    assert {r["label"] for r in label_support(table).collect()} == set(LABELS)
    assert missing_labels(table, LABELS).first()["missing"] == []
    for r in rows:
        slots = re.findall(templates.SLOT, r["text_template"])
        assert slots and set(slots) <= SLOTS
        assert r["rationale_template"] or r["risk"] == "LOW"
    assert template_defects(spark, SHIPPED.as_uri(), sorted(SLOTS)).isEmpty()
    made = templates.generate(spark, table, 400, 3).collect()
    assert len(made) == 400 and not any("{" in r["text"] + r["rationale"] for r in made)


def test_defects(spark, tmp_path):
    good = 'domain: personal\npatterns:\n  - {text: "at {CITY}", labels: [LOCATION], risk: HIGH}\n'
    files = {"a.yaml": good, "b.yaml": good.replace("personal", "legal"), "c.yaml": "domain: [", "d.yaml": good.replace("LOCATION", "PHONE"), "e.yaml": good.replace("CITY", "PLANET"), "f.txt": "no template"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    found = {r["file"]: r["defect"] for r in template_defects(spark, str(tmp_path), sorted(SLOTS)).collect()}
    assert set(found) == {"b.yaml", "c.yaml", "d.yaml", "e.yaml"}
    assert "unknown domain" in found["b.yaml"] and "not YAML" in found["c.yaml"] and "PHONE" in found["d.yaml"] and "PLANET" in found["e.yaml"]
    with pytest.raises(ValueError):
        load_templates(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        load_templates(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no template files"):
        load_templates(spark, str(tmp_path / "empty"))


def test_printed_report(spark):
    one = spark.createDataFrame([("m", 3, 0.5, {"LOCATION": 1.0}, 0.9, 0.0, None, 1.0, 0.25)], reports.REPORT)
    text = metrics.render_report(one)
    assert text.startswith("m, test examples: 3\n") and re.search(r"F1 LOCATION +1\.0000", text) and re.search(r"F1 ROUTINE +-", text)
    assert re.search(r"risk_accuracy +0\.9000", text) and text.count("\n") == 2 + len(metrics.METRICS) + len(LABELS)
