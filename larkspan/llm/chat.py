"""Chat formatting: turns of a conversation as one training string with a loss mask, reversibly.

Relational and native: the turns of a conversation are collected as structs and sorted, adjacent
turns of one role are merged into a block by array functions, and strings are concatenated. No
Python runs on executors.

Template
    block  = "### " role ": " turn+      (a newline stands between blocks)
    turn   = text "</turn>"
In roles and texts a backslash becomes `\\s`, `###` becomes `\\h` and `</turn>` becomes `\\t` (in
roles also `:` becomes `\\c`). As every backslash of the input is followed by `s`, the other codes are
free, so a formatted string holds control strings only where the template puts them, and
`parse` gets every turn back, turns of merged blocks included.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first), then role,
then text, so ties and repeated rows have one order; rows whose conv_id is null form one conversation;
an empty table gives an empty result; other columns are ignored.

A conversation is one output row and so has to fit a task; its work grows in proportion to its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import let, running

HEAD, COLON, END, BETWEEN = "### ", ": ", "</turn>", "\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(text, F.lit("###"), F.lit("\\h")), F.lit(END), F.lit("\\t"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\t"), F.lit(END)), F.lit("\\h"), F.lit("###"))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")))


def _blocks(turns: Column) -> Column:
    """Sorted turns to array<struct<role, texts>>: a block for each run of one role."""
    first = F.filter(
        F.transform(turns, lambda t, i: F.when((i == 0) | (F.get(turns, i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull()
    )
    return let(
        first,
        lambda at: F.transform(
            at,
            lambda i, k: F.struct(
                F.get(turns, i)["role"].alias("role"),
                F.transform(F.slice(turns, i + 1, F.coalesce(F.get(at, k + 1), F.size(turns)) - i), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )


def _pieces(blocks: Column) -> Column:
    """array<struct<role, head, text>>: each turn with what stands before its text."""
    return F.flatten(
        F.transform(
            blocks,
            lambda b, k: F.transform(
                b["texts"],
                lambda x, i: F.struct(
                    b["role"].alias("role"),
                    F.when(i > 0, F.lit("")).otherwise(F.concat(F.when(k > 0, F.lit(BETWEEN)).otherwise(F.lit("")), F.lit(HEAD), escape_role(b["role"]), F.lit(COLON))).alias("head"),
                    escape(x).alias("text"),
                ),
            ),
        )
    )


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss array<struct<start, chars>>: spans of `formatted`, in code points, that are learned."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    pieces = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")).select("conv_id", let(F.col("turns"), lambda t: let(_blocks(t), _pieces)).alias("pieces"))

    def masked(p: Column) -> Column:
        lengths = F.transform(p, lambda x: (F.length(x["head"]) + F.length(x["text"]) + len(END)).cast("long"))
        starts = let(lengths, running)
        spans = let(
            starts,
            lambda s: F.transform(
                p,
                lambda x, i: F.when(
                    x["role"].isin(*loss_roles),
                    F.struct((F.get(s, i) + F.length(x["head"])).alias("start"), F.length(x["text"]).cast("long").alias("chars")),
                ),
            ),
        )
        return F.filter(spans, lambda x: x.isNotNull())

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "").alias("formatted"),
        let(F.col("pieces"), masked).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    head = rf"^\n?{HEAD}([^:]*){COLON}"
    segments = F.transform(
        F.slice(F.split(formatted, END, -1), 1, F.greatest(F.size(F.split(formatted, END, -1)) - 1, F.lit(0))),
        lambda s: F.when(
            s.rlike(head),
            F.struct(F.regexp_extract(s, head, 1).alias("role"), F.regexp_replace(s, head, "").alias("text")),
        ).otherwise(F.struct(F.lit(None).cast("string").alias("role"), s.alias("text"))),
    )

    def spread(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.when(x["role"].isNotNull(), i)), lambda i: i.isNotNull())
        return let(
            heads,
            lambda at: F.flatten(
                F.transform(
                    at,
                    lambda i, k: F.transform(
                        F.slice(s, i + 1, F.coalesce(F.get(at, k + 1), F.size(s)) - i),
                        lambda x: F.struct(unescape_role(F.get(s, i)["role"]).alias("role"), unescape(x["text"]).alias("text")),
                    ),
                )
            ),
        )

    return let(segments, spread)


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped: array<string>."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int"))))
