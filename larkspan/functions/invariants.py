"""Record invariants as column expressions: the rules that a row breaks, and two policies for such rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.schema import DOMAINS, ID_PATTERN, LABELS, RISKS, SOURCES, SPLITS


def rules(with_id: bool = True, ids: str = ID_PATTERN, text: bool = True) -> dict[str, Column]:
    """Name to the condition under which a row breaks the rule; nulls break the rule of their column. Datasets of any size are held to NUMBERED_ID. text: whether there has to be one; steps that leave texts as they came let rows without pass."""
    c = F.col
    no = lambda ok: ~F.coalesce(ok, F.lit(False))
    clean = (F.size("labels") == 0) & (c("risk") == "LOW") & (c("rationale") == "") & (c("source") == "hard-negative")
    out = {
        "labels": no(F.forall("labels", lambda x: x.isin(*LABELS))),
        "risk": no(c("risk").isin(*RISKS)),
        "unlabelled_risk": F.coalesce((F.size("labels") == 0) & (c("risk") != "LOW"), F.lit(False)),
        "low_rationale": F.coalesce((c("risk") == "LOW") & (c("rationale") != ""), F.lit(False)),
        "risk_rationale": F.coalesce(c("risk").isin("MEDIUM", "HIGH") & (F.coalesce("rationale", F.lit("")) == ""), F.lit(False)),
        "text": no(c("text") != ""),
        "domain": no(c("domain").isin(*DOMAINS)),
        "source": no(c("source").isin(*SOURCES)),
        "hard_negative": F.coalesce(c("is_hard_negative"), F.lit(False)) & no(clean),
    }
    if not text:
        del out["text"]
    if with_id:
        out |= {"id": no(c("id").rlike(ids)), "split": no(c("split").isin(*SPLITS))}
    return out


def violations(with_id: bool = True, ids: str = ID_PATTERN, text: bool = True) -> Column:
    """The names of the rules that a row breaks, sorted: array<string>."""
    return F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules(with_id, ids, text).items()])))


def drop_invalid(df: DataFrame, with_id: bool = True, ids: str = ID_PATTERN, text: bool = True) -> DataFrame:
    return df.where(F.size(violations(with_id, ids, text)) == 0)


def require_valid(df: DataFrame, with_id: bool = True, ids: str = ID_PATTERN, text: bool = True) -> DataFrame:
    """Fails, when it runs, on the first row that breaks a rule."""
    broken = violations(with_id, ids, text)
    fail = F.raise_error(F.concat(F.lit("invalid example: "), F.array_join(broken, ",")))
    return df.where(F.when(F.size(broken) > 0, fail.cast("boolean")).otherwise(F.lit(True)))


def report_violations() -> Column:
    """For a one-row report: the macro average is the mean of eight per-label values and all values are shares."""
    values = F.map_values("f1_by_label")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1))
    shares = F.array("multilabel_f1", "risk_accuracy", "false_negative_rate", "quasi_id_f1", "hard_negative_precision")
    return F.array_compact(
        F.array(
            F.when(F.size(values) != len(LABELS), F.lit("labels")),
            F.when(F.exists(F.concat(shares, values), lambda x: (x < 0) | (x > 1)), F.lit("range")),
            F.when(F.abs(mean - F.col("multilabel_f1")) > 1e-6, F.lit("macro")),
            F.when(F.col("test_set_size") <= 0, F.lit("size")),
            F.when(F.col("model_name") == "", F.lit("name")),
        )
    )
