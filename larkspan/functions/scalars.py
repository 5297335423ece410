"""Counts, ids, plans and small texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspan.functions.schema import LABELS

# Output tokens by model, and tokens that an example takes by format.
TOKEN_BUDGETS = {"qwen2.5:3b": 2400, "qwen2.5:7b": 3200, "qwen2.5:14b": 3200, "llama3.1:8b": 3200, "mistral:7b": 3200}
DEFAULT_BUDGET = 3200
TOKENS_PER_EXAMPLE = {"structured": 75, "simple": 30, "validation": 80}
LEAST_BATCH = 10
OVER_REQUEST = 1.3


def half_even(x: Column) -> Column:
    """Rounding of counts: halves go to the even neighbour."""
    return F.bround(x, 0).cast("bigint")


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def example_id(split: Column, number: Column) -> Column:
    return F.format_string("%s-%05d", split, number)


def id_number(ident: Column) -> Column:
    return F.substring_index(ident, "-", -1).cast("bigint")


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; 11th to 13th."""
    suffix = F.when((n % 100).between(11, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def rationale(labels: Column) -> Column:
    """What a baseline prediction gives as its reason."""
    listed = F.array_join(F.array_sort(labels), ", ")
    return F.when(F.size(labels) == 0, F.lit("")).when(F.size(labels) == 1, F.concat(F.lit("PII type detected: "), listed)).otherwise(F.concat(F.lit("Multiple PII types detected: "), listed))


def batch_limit(model: Column, kind: str) -> Column:
    budget = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TOKEN_BUDGETS.items() for x in kv]), model), F.lit(DEFAULT_BUDGET))
    return F.greatest(F.lit(LEAST_BATCH), F.floor(budget / TOKENS_PER_EXAMPLE[kind])).cast("bigint")


def batch_size(model: str, kind: str) -> int:
    """batch_limit of one model."""
    return max(LEAST_BATCH, TOKEN_BUDGETS.get(model, DEFAULT_BUDGET) // TOKENS_PER_EXAMPLE[kind])


def over_requested(n: Column) -> Column:
    return F.ceil(n * F.lit(OVER_REQUEST)).cast("bigint")


def generation_plan(total: Column, have: Column, template_fraction: Column, hard_negative_ratio: Column) -> dict[str, Column]:
    """How many examples each stage makes: all but hard negatives first, less those there are, by fraction from templates."""
    goal = half_even(total * (1 - hard_negative_ratio))
    remaining = F.greatest(F.lit(0).cast("bigint"), goal - have)
    template = half_even(remaining * template_fraction)
    return {"target_non_hn": goal, "remaining": remaining, "template_count": template, "llm_count": remaining - template}


def hard_negative_count(existing: Column, share: Column) -> Column:
    return F.when((share <= 0) | (existing == 0), F.lit(0).cast("bigint")).otherwise(half_even(existing * share / (1 - share)))


def is_hub_id(path: Column) -> Column:
    """Whether a model's name is a hub id (one slash, not first) rather than a local path."""
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) == 1) & ~path.startswith("/")


def hub_id(path: str) -> bool:
    """is_hub_id of one name."""
    return path.count("/") == 1 and not path.startswith("/")


def taxonomy_bullets() -> str:
    return "\n".join(f"- {label}" for label in LABELS)
