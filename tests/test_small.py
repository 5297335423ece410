"""Corrections by row, flags on texts beyond ASCII, reports, configurations, missing labels."""

import pytest
from pyspark.sql import functions as F

from larkspan.functions.features import flags
from larkspan.operators import datasets, metrics, templates
from larkspan.sources import reports
from larkspan.sources.templates import missing_labels

EXAMPLE = "id string, text string, labels array<string>, risk string, rationale string, is_hard_negative boolean, split string, domain string, source string"


def test_corrections_leave_other_rows_alone(spark):
    row = lambda i, t: (i, t, ["LOCATION"], "MEDIUM", "Detected: LOCATION", False, "train", "medical", "template")
    d = spark.createDataFrame([row("a", "x"), row("a", "y"), row("b", "z"), row("b", "z"), row(None, "n"), row(None, "n")], EXAMPLE)
    c = spark.createDataFrame([("a", 1, None, "HIGH", None, None, None), ("a", 2, None, None, "other", None, None), ("zz", 1, None, "LOW", None, None, None)], "id string, ord int, labels array<string>, risk string, rationale string, is_hard_negative boolean, source string")
    out = sorted(((r["id"] or ""), r["text"], r["risk"], r["rationale"]) for r in datasets.apply_corrections(d, c).collect())
    assert out == [("", "n", "MEDIUM", "Detected: LOCATION")] * 2 + [("a", t, "HIGH", "other") for t in "xy"] + [("b", "z", "MEDIUM", "Detected: LOCATION")] * 2
    assert datasets.apply_corrections(d, c.limit(0)).count() == 6 and datasets.apply_corrections(d.limit(0), c).count() == 0


def test_flags_are_unicode(spark):
    d = spark.createDataFrame([("passwordé",), ("é password é",), ("١٢٣-٤٥٦-٧٨٩٠",), ("12 Elm St",)], "text string")
    got = [tuple(r) for r in d.select(*[c.alias(n) for n, c in flags(F.col("text")).items()]).collect()]
    assert got == [(0, 0, 0, 0), (0, 0, 0, 1), (0, 1, 0, 0), (0, 0, 1, 0)]


def test_reports_and_configurations(spark, tmp_path):
    one = spark.createDataFrame([("m", 3, 0.5, {"LOCATION": 1.0}, 0.9, 0.0, None, 1.0, 0.25)], reports.REPORT)
    reports.write_report(one, str(tmp_path / "r"))
    assert reports.read_report(spark, str(tmp_path / "r")).collect() == one.collect()
    counted = metrics.count_passed(metrics.check_targets(one)).first()
    assert counted["targets"] == len(metrics.TARGETS) and 0 < counted["passed"] < counted["targets"]
    (tmp_path / "c.yaml").write_text("epochs: 3\nlora: {r: 16}\n")
    assert reports.load_config(spark, str(tmp_path / "c.yaml")) == {"epochs": 3, "lora": {"r": 16}}
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        reports.load_config(spark, str(tmp_path / "l.yaml"))
    with pytest.raises(FileNotFoundError):
        reports.load_config(spark, str(tmp_path / "none.yaml"))


def test_missing_labels_and_placeholders(spark):
    d = spark.createDataFrame([("x", ["A"]), ("x", ["B", "A"]), ("y", []), ("z", None)], "g string, labels array<string>")
    assert {r["g"]: r["missing"] for r in missing_labels(d, ["C", "B", "A"], "g").collect()} == {"x": ["C"], "y": ["A", "B", "C"], "z": ["A", "B", "C"]}
    p = spark.createDataFrame([("{A} b {C_1} {A}",), ("none",)], "p string")
    assert [r[0] for r in p.select(templates.placeholders(F.col("p"))).collect()] == [["A", "C_1", "A"], []]
