"""Multilabel evaluation in one aggregate, and comparison of two predictors.

Input rows pair a prediction with its truth by key: pred, gold (arrays of labels), pred_risk, gold_risk,
is_hard_negative. All counts come from one pass with partial aggregation; a single row leaves each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.scalars import ratio
from larkspan.functions.schema import LABELS, RISKS

METRICS = ("multilabel_f1", "risk_accuracy", "false_negative_rate", "quasi_id_f1", "hard_negative_precision")
# The targets of an evaluation and whether less is better.
TARGETS = (("multilabel_f1", 0.80, False), ("risk_accuracy", 0.85, False), ("false_negative_rate", 0.08, True), ("quasi_id_f1", 0.70, False), ("hard_negative_precision", 0.92, False))


def pair(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions (labels, risk) joined to truth (labels, risk, is_hard_negative) by key, one to one."""
    p = predictions.select(key, F.col("labels").alias("pred"), F.col("risk").alias("pred_risk"))
    t = truth.select(key, F.col("labels").alias("gold"), F.col("risk").alias("gold_risk"), "is_hard_negative")
    return t.join(p, key)


def _counts() -> list[Column]:
    out = [
        F.count("*").alias("n"),
        F.count_if(F.col("pred_risk") == F.col("gold_risk")).alias("risk_hits"),
        F.count_if(F.size("gold") > 0).alias("labelled"),
        F.count_if((F.size("gold") > 0) & (F.size("pred") == 0)).alias("missed"),
        F.count_if("is_hard_negative").alias("hn"),
        F.count_if(F.col("is_hard_negative") & (F.size("pred") == 0)).alias("hn_clean"),
        F.count_if((F.size("pred") > 0) == (F.size("gold") > 0)).alias("gate_hits"),
    ]
    for k, label in enumerate(LABELS):
        p, g = F.array_contains("pred", label), F.array_contains("gold", label)
        out += [F.count_if(p & g).alias(f"tp{k}"), F.count_if(p & ~g).alias(f"fp{k}"), F.count_if(~p & g).alias(f"fn{k}")]
    return out


def counted(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*_counts())


def label_confusion(pairs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """label, tp, fp, fn: a row for each of the eight labels."""
    counts = counted(pairs) if counts is None else counts
    rows = ", ".join(f"'{label}', tp{k}, fp{k}, fn{k}" for k, label in enumerate(LABELS))
    return counts.selectExpr(f"stack({len(LABELS)}, {rows}) AS (label, tp, fp, fn)")


def _f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return precision, recall, ratio(2 * precision * recall, precision + recall)


def label_f1(pairs: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1."""
    p, r, f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return label_confusion(pairs).select("*", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def evaluation_report(pairs: DataFrame, model_name: str) -> DataFrame:
    """One row: the model's name, the size of the test set, f1_by_label and the five metrics."""
    f1 = [_f1(F.col(f"tp{k}"), F.col(f"fp{k}"), F.col(f"fn{k}"))[2] for k in range(len(LABELS))]
    by_label = F.create_map(*[x for label, v in zip(LABELS, f1, strict=True) for x in (F.lit(label), v)])
    return counted(pairs).select(
        F.lit(model_name).alias("model_name"),
        F.col("n").alias("test_set_size"),
        (sum(f1[1:], f1[0]) / len(LABELS)).alias("multilabel_f1"),
        by_label.alias("f1_by_label"),
        ratio(F.col("risk_hits"), F.col("n")).alias("risk_accuracy"),
        ratio(F.col("missed"), F.col("labelled")).alias("false_negative_rate"),
        f1[LABELS.index("QUASI-ID")].alias("quasi_id_f1"),
        ratio(F.col("hn_clean"), F.col("hn"), 1.0).alias("hard_negative_precision"),
        ratio(F.col("gate_hits"), F.col("n")).alias("gate_accuracy"),
    )


def long_report(report: DataFrame) -> DataFrame:
    """metric, value: the five metrics and, as f1:<label>, the per-label values."""
    flat = F.concat(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]), F.transform(F.map_entries("f1_by_label"), lambda e: F.struct(F.concat(F.lit("f1:"), e["key"]).alias("metric"), e["value"].alias("value"))))
    return report.select(F.explode(flat).alias("m")).select("m.*")


def compare(finetuned: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, finetuned, baseline, delta of two reports."""
    a, b = long_report(finetuned).withColumnRenamed("value", "finetuned"), long_report(baseline).withColumnRenamed("value", "baseline")
    return a.join(b, "metric").withColumn("delta", F.col("finetuned") - F.col("baseline"))


def check_targets(report: DataFrame) -> DataFrame:
    """metric, value, op, target, passed."""
    targets = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("target"), F.lit(less).alias("less")) for m, t, less in TARGETS])
    values = F.create_map(*[x for m, _, _ in TARGETS for x in (F.lit(m), F.col(m))])
    rows = report.select(values.alias("v"), F.explode(targets).alias("t")).select("t.*", F.element_at("v", F.col("t.metric")).alias("value"))
    return rows.select("metric", "value", F.when(F.col("less"), "<=").otherwise(">=").alias("op"), "target", F.when(F.col("less"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target")).alias("passed"))


def risk_matrix(pairs: DataFrame) -> DataFrame:
    """gold_risk, pred_risk, n: nine rows, also those without a pair."""
    cells = [(g, p) for g in RISKS for p in RISKS]
    counts = pairs.agg(*[F.count_if((F.col("gold_risk") == g) & (F.col("pred_risk") == p)).alias(f"c{i}") for i, (g, p) in enumerate(cells)])
    return counts.selectExpr("stack(9, " + ", ".join(f"'{g}', '{p}', c{i}" for i, (g, p) in enumerate(cells)) + ") AS (gold_risk, pred_risk, n)")


def gate_accuracy(pairs: DataFrame) -> DataFrame:
    return counted(pairs).select("n", ratio(F.col("gate_hits"), F.col("n")).alias("gate_accuracy"))


def risk_disagreements(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The rows in whose risk two predictors differ."""
    return a.select(key, F.col("risk").alias("risk_a")).join(b.select(key, F.col("risk").alias("risk_b")), key).where("risk_a <> risk_b")


def render_comparison(comparison: DataFrame, test_size: int) -> str:
    """A text report with four decimals and signed deltas; the table has thirteen rows."""
    rows = {r["metric"]: r for r in comparison.collect()}
    line = lambda name, r: f"{name:<26}{r['finetuned']:>10.4f}{r['baseline']:>10.4f}{r['delta']:>+10.4f}"
    head = f"Test examples: {test_size}\n\n{'Metric':<26}{'finetuned':>10}{'baseline':>10}{'delta':>10}"
    return "\n".join([head, *[line(m, rows[m]) for m in METRICS], "", *[line(f"F1 {x}", rows[f"f1:{x}"]) for x in sorted(LABELS)]]) + "\n"


def render_report(report: DataFrame) -> str:
    """One model's metrics and F1 by label as text, with four decimals; the table has one row."""
    r = report.first()
    value = lambda v: "-" if v is None else f"{v:.4f}"
    lines = [f"{r['model_name']}, test examples: {r['test_set_size']}", *[f"{m:<26}{value(r[m]):>10}" for m in METRICS]]
    return "\n".join([*lines, "", *[f"{f'F1 {x}':<26}{value((r['f1_by_label'] or {}).get(x)):>10}" for x in sorted(LABELS)]]) + "\n"


def count_passed(checked: DataFrame) -> DataFrame:
    """passed and targets: how many of the rows of check_targets hold, a metric without a value doesn't."""
    return checked.agg(F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"), F.count("*").alias("targets"))
