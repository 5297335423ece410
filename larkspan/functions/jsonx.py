"""JSON out of model output: extraction, repair and strict or lenient reading, all native.

Variants need spark.sql.variant.allowDuplicateKeys=true for the last of equal keys to win; `configure` sets it.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larkspan.functions.schema import LABELS, RISKS

# What counts as a fence and as a braced object (one level of nesting), and the reason that is filled in.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"
BRACES = r"(?s)\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
WHOLE_FENCE = r"(?s)\A```(?:json)?\s*\n?(.*?)\n?\s*```\z"
FILLED_RATIONALE = "Multiple quasi-identifiers detected."


def configure(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def as_object(s: Column) -> Column:
    """The variant of a text that is a JSON object and nothing else; else null."""
    v = F.try_parse_json(s)
    return F.when(s.rlike(r"(?s)\A\s*\{.*\}\s*\z") & kind(v).startswith("OBJECT"), v)


def repair(s: Column) -> Column:
    """Quotes made double, commas before closers dropped, missing closers added: braces, then brackets."""
    single, double = F.contains(s, F.lit("'")), F.contains(s, F.lit('"'))
    q = F.when(single & ~double, F.replace(s, F.lit("'"), F.lit('"'))).when(single, F.regexp_replace(s, "'([^']*)'", '"$1"')).otherwise(s)
    q = F.regexp_replace(q, r",\s*([}\]])", "$1")
    count = lambda ch: F.length(q) - F.length(F.replace(q, F.lit(ch), F.lit("")))
    more = lambda a, b: F.repeat(F.lit(b), F.greatest(F.lit(0), count(a) - count(b)))
    return F.concat(q, more("{", "}"), more("[", "]"))


def extract_object(raw: Column) -> Column:
    """The first candidate that is an object: the text, what its first fence holds, its first braces, its repair."""
    text = strip(raw)
    return F.coalesce(as_object(text), as_object(strip(F.regexp_extract(raw, FENCE, 1))), as_object(F.regexp_extract(raw, BRACES, 0)), as_object(repair(text)))


def string_field(v: Column, name: str) -> Column:
    """The field where it is a string; else null."""
    x = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(kind(x) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def label_field(v: Column, name: str = "labels") -> Column:
    """Known labels among the strings of a list, distinct and sorted; [] for whatever else."""
    items = F.try_variant_get(v, f"$.{name}", "array<variant>")
    known = F.transform(F.filter(items, lambda x: kind(x) == "STRING"), lambda x: x.cast("string"))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(known, lambda x: x.isin(*LABELS)))), F.array().cast("array<string>"))


def parse_output(raw: Column) -> Column:
    """struct<labels, risk, rationale, is_valid>: never fails; no object gives no labels, LOW and ""."""
    return F.transform(F.array(extract_object(raw)), lambda v: _consistent(label_field(v), string_field(v, "risk"), string_field(v, "rationale")))[0]


def _consistent(labels: Column, risk: Column, reason: Column) -> Column:
    risk = F.when(F.size(labels) == 0, F.lit("LOW")).when(risk.isin(*RISKS), risk).otherwise(F.lit("LOW"))
    reason = F.when(risk == "LOW", F.lit("")).when((F.size(labels) >= 2) & (F.coalesce(reason, F.lit("")) == ""), F.lit(FILLED_RATIONALE)).otherwise(F.coalesce(reason, F.lit("")))
    return F.struct(labels.alias("labels"), risk.alias("risk"), reason.alias("rationale"), ((risk == "LOW") | (reason != "")).alias("is_valid"))


def strip_code_fences(s: Column) -> Column:
    """What a text that is one fence holds; any other text unchanged."""
    t = strip(s)
    return F.when(t.rlike(WHOLE_FENCE), strip(F.regexp_extract(t, WHOLE_FENCE, 1))).otherwise(s)


def first_array(s: Column) -> Column:
    """A JSON list as it is, or the first list among an object's fields in their own order, as text; else null."""
    v = F.try_parse_json(s)
    keys = F.coalesce(F.json_object_keys(s), F.array().cast("array<string>"))
    field = lambda k: F.call_function("get_json_object", s, F.concat(F.lit("$['"), k, F.lit("']")))
    lists = F.filter(F.transform(keys, field), lambda x: kind(F.try_parse_json(x)).startswith("ARRAY"))
    return F.when(kind(v).startswith("ARRAY"), s).when(kind(v).startswith("OBJECT"), F.get(lists, F.lit(0)))
