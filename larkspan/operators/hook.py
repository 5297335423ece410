"""Scanning of events: the text of a payload, a predictor's verdict on it, an exit code and a message."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.features import flags
from larkspan.functions.jsonx import kind

HOOKS = ("user_prompt", "pre_tool_use", "post_tool_use")


def hook_text(hook: Column, payload: Column) -> Column:
    """The text to scan; null if the payload isn't JSON, "" if it has none. An object given to a tool counts as its JSON text."""
    v = F.try_parse_json(payload)

    def text(name: str, whole: bool = False) -> Column:
        x = F.try_variant_get(v, f"$.{name}", "variant")
        out = F.when(kind(x) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        return out.when(x.isNotNull() & (kind(x) != "VOID"), F.to_json(x)) if whole else out

    found = F.when(hook == HOOKS[0], text("query")).when(hook == HOOKS[1], text("tool_input", True)).when(hook == HOOKS[2], text("tool_output"))
    return F.when(v.isNotNull(), F.coalesce(found, F.lit("")))


def pattern_predictor(text: Column) -> Column:
    """A predictor without a model: credentials by pattern. Models come as functions from a column to such a struct."""
    hit = flags(text)["has_credential_pattern"] == 1
    none = F.array().cast("array<string>")
    return F.struct(F.when(hit, F.array(F.lit("CREDENTIAL"))).otherwise(none).alias("labels"), F.when(hit, "HIGH").otherwise("LOW").alias("risk"), F.when(hit, "PII type detected: CREDENTIAL").otherwise("").alias("rationale"))


def verdicts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """columns, text, exit_code and message of rows with text and _p, a struct of labels, risk and rationale or null."""
    code = F.when(F.col("text").isNull(), 1).when(F.coalesce(F.size("_p.labels"), F.lit(0)) > 0, 2).otherwise(0)
    message = F.when(code == 1, "invalid JSON").when(code == 2, F.to_json(F.struct(F.array_sort("_p.labels").alias("labels"), F.col("_p.risk").alias("risk"), F.col("_p.rationale").alias("rationale")))).otherwise("")
    return rows.select(*columns, "text", code.cast("int").alias("exit_code"), message.alias("message"))


def scan(events: DataFrame, predict: Callable[[Column], Column] = pattern_predictor) -> DataFrame:
    """Adds text, exit_code (0 clean, 1 error, 2 found) and message to rows of hook_type and payload."""
    rows = events.withColumn("text", hook_text(F.col("hook_type"), F.col("payload")))
    return verdicts(rows.withColumn("_p", F.when(F.coalesce("text", F.lit("")) != "", predict(F.col("text")))), events.columns)


def scan_with(events: DataFrame, detector) -> DataFrame:
    """As scan, with a detector (`operators/detector.py`): its predictions need more than an expression of one column."""
    rows = events.withColumn("text", hook_text(F.col("hook_type"), F.col("payload")))
    has = F.coalesce("text", F.lit("")) != ""
    found = detector.detect(rows.where(has)).withColumn("_p", F.struct("labels", "risk", "rationale"))
    none = rows.where(~has).withColumn("_p", F.lit(None).cast(found.schema["_p"].dataType))
    return verdicts(found.select(*rows.columns, "_p").unionByName(none), events.columns)
