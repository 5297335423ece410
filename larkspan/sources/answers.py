"""Answers of a model to prompts, asked for until all are there, and never twice for an answer that has been kept.

Answers are tables of a journal, one for each pass. A pass asks what is left after an anti-join with all passes before; a call that fails, or
whose answer holds no list, stays unanswered and is asked again in the next. Passes that bring nothing are failures, and so many of them in
a row abort; what came before stays in the journal. A lost executor costs the calls of its unfinished tasks, which are small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.sources.journal import Journal
from larkspan.sources.model_client import ask

#: Passes in a row without an answer that abort, and calls of a task at most.
FAILURES, TASK_CALLS = 5, 16


def one_pass(prompts: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """call, response of prompts (call, prompt) that are answered, each asked once."""
    tasks = max(1, -(-prompts.count() // TASK_CALLS))
    return ask(prompts.select("call", "prompt").repartition(tasks, "call"), client, attempts=1).where("response IS NOT NULL").select("call", "response")


def answered(prompts: DataFrame, client: Callable[[str], str], journal: Journal, name: str, failures: int = FAILURES) -> DataFrame:
    """call, response for every row of prompts (call, unique, and prompt). RuntimeError after so many passes in a row without an answer."""
    asked = journal.table(f"{name}-prompts", lambda: prompts.select("call", "prompt"))
    left, in_row, turn, parts = asked, 0, 0, []
    while not left.isEmpty():
        if in_row == failures:
            raise RuntimeError(f"{name}: {failures} passes in a row brought no answer")
        # a pass that brings nothing isn't kept, so a restart begins to count anew
        now = left
        part = journal.table(f"{name}-{turn}", lambda: one_pass(now, client))  # noqa: B023
        if part.isEmpty():
            journal.drop(f"{name}-{turn}")
            in_row += 1
            continue
        in_row, turn = 0, turn + 1
        parts.append(part)
        left = left.join(part, "call", "left_anti")
    if not parts:
        return asked.select("call", F.lit(None).cast("string").alias("response")).limit(0)
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out
