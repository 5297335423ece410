"""Types and closed value sets of labelled examples."""

from __future__ import annotations

from pyspark.sql import types as T

# Labels in taxonomy order, risk levels in rising order, and the other closed sets.
LABELS = ("LOCATION", "WORKPLACE", "ROUTINE", "MEDICAL-CONTEXT", "DEMOGRAPHIC", "DEVICE-ID", "CREDENTIAL", "QUASI-ID")
RISKS = ("LOW", "MEDIUM", "HIGH")
SPLITS = ("train", "validation", "test")
DOMAINS = ("medical", "scheduling", "workplace", "personal")
SOURCES = ("template", "llm-augmented", "hard-negative")
ID_PATTERN = r"\A(train|validation|test)-[0-9]{5}\z"
#: Ids as numbering makes them: five digits, and from the 100,000th row of a split on as many as its number has.
NUMBERED_ID = r"\A(train|validation|test)-([0-9]{5}|[1-9][0-9]{5,})\z"

_s, _b = T.StringType(), T.BooleanType()
RAW_EXAMPLE = T.StructType(
    [T.StructField("text", _s), T.StructField("labels", T.ArrayType(_s)), T.StructField("risk", _s), T.StructField("rationale", _s), T.StructField("is_hard_negative", _b), T.StructField("domain", _s), T.StructField("source", _s)]
)
EXAMPLE = T.StructType([T.StructField("id", _s), *RAW_EXAMPLE.fields[:5], T.StructField("split", _s), *RAW_EXAMPLE.fields[5:]])
CORRECTION = T.StructType(
    [T.StructField("id", _s), T.StructField("labels", T.ArrayType(_s)), T.StructField("risk", _s), T.StructField("rationale", _s), T.StructField("is_hard_negative", _b), T.StructField("source", _s)]
)
