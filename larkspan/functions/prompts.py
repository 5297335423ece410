"""Prompts and training texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.scalars import taxonomy_bullets
from larkspan.functions.schema import RISKS

# The prompt around a text, the end of a completion, and the limit of tokens.
BEFORE = (
    "<|user|>\n"
    "Classify which quasi-identifier PII categories are present in the\n"
    "following text. Return the list of category labels from the taxonomy,\n"
    "an overall risk score (LOW/MEDIUM/HIGH), and a brief rationale.\n"
    "\n"
    "Text: "
)
AFTER = "\n<|end|>\n<|assistant|>\n"
COMPLETION_END = "\n<|end|>"
MAX_TOKENS = 1024


def prompt(text: Column) -> Column:
    return F.concat(F.lit(BEFORE), text, F.lit(AFTER))


def framed(text: str) -> str:
    return BEFORE + text + AFTER


def words(text: Column) -> Column:
    """The default tokenizer: words between blanks. A real one comes as a function of a column."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def completion(labels: Column, risk: Column, rationale: Column) -> Column:
    return F.to_json(F.struct(F.array_sort(labels).alias("labels"), risk.alias("risk"), rationale.alias("rationale")))


def formatted(df: DataFrame, tokenize: Callable[[Column], Column] = words) -> DataFrame:
    """Adds training_text and n_tokens."""
    made = df.withColumn("training_text", F.concat(prompt(F.col("text")), completion(F.col("labels"), F.col("risk"), F.col("rationale")), F.lit(COMPLETION_END)))
    return made.withColumn("n_tokens", F.size(tokenize(F.col("training_text"))).cast("bigint"))


def training_text(df: DataFrame, tokenize: Callable[[Column], Column] = words, limit: int = MAX_TOKENS) -> DataFrame:
    """Adds training_text and n_tokens, and leaves out what is longer than the limit."""
    return formatted(df, tokenize).where(F.col("n_tokens") <= limit)


def assembled(text: Column, tokenize: Callable[[Column], Column] = words, join: Callable[[Column], Column] = lambda t: F.array_join(t, " "), limit: int = MAX_TOKENS) -> Column:
    """Prompt tokens within the limit: the text gives way, then the whole is cut."""
    frame = tokenize(prompt(F.lit("")))
    room = F.greatest(F.lit(limit) - F.size(frame), F.lit(0))
    fitted = F.slice(tokenize(prompt(join(F.slice(tokenize(text), F.lit(1), room)))), 1, limit)
    return F.when(room <= 0, F.slice(frame, 1, limit)).otherwise(fitted)


def generation_prompt(count: Column, domain: Column) -> Column:
    """Asks a model for examples of a domain, as {"examples": [...]}."""
    return F.format_string(
        "Write %d invented texts of one to three sentences for the domain \"%s\" that contain personal information by context.\n"
        f"Categories:\n{taxonomy_bullets()}\n"
        "Answer with a JSON object {\"examples\": [{\"text\", \"labels\", \"risk\", \"rationale\", \"domain\"}]}. "
        f"risk is one of {', '.join(RISKS)}; it is LOW, with an empty rationale, if there are no labels, and needs a rationale otherwise.",
        count,
        domain,
    )


def validation_prompt(batch: Column) -> Column:
    """Asks for a check of a batch: array<struct<id, text, labels, risk, rationale>>."""
    return F.concat(
        F.lit(f"Check labels, risk and rationale of each example.\nCategories:\n{taxonomy_bullets()}\nExamples:\n"),
        F.to_json(batch),
        F.lit("\nAnswer with a JSON object {\"results\": [{\"id\", \"labels\", \"risk\", \"rationale\", \"valid\"}]}, one entry for each id."),
    )


def hard_negative_prompt(count: Column) -> Column:
    return F.format_string(
        "Write %d short texts that name places, times, organisations or people and yet identify no private person: "
        "history, fiction, public figures, general statements, hypothetical cases.\n"
        "Answer with a JSON object {\"texts\": [\"...\"]}.",
        count,
    )
