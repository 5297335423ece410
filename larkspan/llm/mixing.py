"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a schedule: at training time t in [0, 1] it is drawn in proportion to
`target * (1 + slope * (2 t - 1))`, whose integral over the run is its target and whose integral up to t,
`target * (t + slope * (t^2 - t))`, is its cumulative demand of words. A source's documents, in the order
of a seeded hash of their ids, make a stream of words which is read up to the target, from the start again
if the target exceeds the source. Inverting the cumulative demand at the middle of what a document
gives to the stream yields its position in training; documents are range-sorted by position.

Native. Offsets in the streams are distributed prefix sums, so a hot source spreads over tasks; the table
of sources, a row each, is windowed as one and broadcast only below `BROADCAST_SOURCES` rows.

Defined cases: a null text has size 0; null sources are one source, the last; sources without words have
target 0 and give nothing; null ids and repeated rows are rows like others (those that agree in id and text are interchangeable); other
columns, whatever their names, come along in `mix` and are ignored in `plan`; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.common import durable, fresh, n_words, prefix_sums, scratch, with_rows

WEIGHTS = (5, 2, 1)
#: Of each weight: heavy sources fade, light ones grow.
SLOPES = (-0.5, 0.0, 0.5)
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, slope from rows of source and size.

    The mix has `share` times all words. A source is full, at `most` times its own size, if an equal level
    of words per weight over it and all sources that fill no sooner would exceed that; in the order of most
    words per weight this is one running comparison, which ends where resharing the excess ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), (F.col("_at") % len(values)).cast("int"))
    per = per.withColumn("_at", at).select("source", "source_size", pick(weights).alias("_weight"), pick(slopes).alias("slope"))
    cap = F.col("source_size") * F.lit(float(most))
    fill = Window.orderBy(cap / F.col("_weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = per.select(
        "*",
        cap.alias("_cap"),
        F.coalesce(F.sum(cap).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_full"),
        F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
        (F.sum("source_size").over(everything) * share).alias("_all"),
    )
    level = (F.col("_all") - F.col("_full")) / F.col("_open")
    per = per.withColumn("_is_full", level * F.col("_weight") >= F.col("_cap"))
    left = F.col("_all") - F.sum(F.when(F.col("_is_full"), F.col("_cap")).otherwise(0.0)).over(everything)
    over = F.sum(F.when(~F.col("_is_full"), F.col("_weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("_is_full"), F.col("_cap")).otherwise(F.col("_weight") * left / F.when(over > 0, over))
    return per.select("source", "source_size", target.alias("target"), "slope")


def position(q: Column, slope: Column) -> Column:
    """The time at which the share q of a source's target is reached: t with t + slope (t^2 - t) = q."""
    down = 1 - slope
    return F.least(F.lit(1.0), 2 * q / F.when(q > 0, down + F.sqrt(down * down + 4 * slope * q)).otherwise(F.lit(1.0)))


def plan(docs: DataFrame, seed: int = 17, extra: Sequence[str] = (), **options) -> DataFrame:
    """A row per document: doc_id, text_hash, source, size, source_size, target, taken and passes.

    passes: array<struct<epoch, words, position>>, one for each time that the document is drawn. Written down.
    """
    with scratch() as keep:
        return keep(durable(_plan(docs, seed, extra, **options)))


def _plan(docs: DataFrame, seed: int, extra: Sequence[str], **options) -> DataFrame:
    rows = durable(
        docs.select(
            "doc_id",
            "source",
            n_words(F.col("text")).alias("size"),
            F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_hash"),
            # pseudo-random, and the same in any engine
            F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("_key"),
            *extra,
        )
    )
    targets = durable(source_targets(rows, **options))
    few = targets.count() <= BROADCAST_SOURCES
    targets = targets.withColumnRenamed("source", "_source")
    placed = prefix_sums(rows, ["source"], ["_key", "doc_id", "text_hash"], "size")
    placed = placed.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("_source")))
    goal = F.floor(F.col("target") + 0.5)
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(goal / F.greatest("source_size", F.lit(1))).cast("int") - 1))
    words = lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - e * F.col("source_size") - F.col("before")))
    passes = F.transform(
        epochs,
        lambda e: F.struct(
            e.alias("epoch"),
            words(e).alias("words"),
            position((e * F.col("source_size") + F.col("before") + words(e) / 2) / F.when(goal > 0, goal).otherwise(1), F.col("slope")).alias("position"),
        ),
    )
    out = placed.withColumn("passes", F.filter(passes, lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"), "passes", *extra)


def mix(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """The columns of `docs`, in the order of training positions, once for each pass that draws a document.

    Rows are told apart by file and place in it, so texts aren't written in between. Whole documents: one that the end of its source's target cuts is drawn if at least half of it is within.
    """
    row, place = fresh(docs, "_row"), fresh(docs, "_position")
    rows = with_rows(docs, row)
    with scratch() as keep:
        passes = (
            plan(rows.select("doc_id", "source", "text", F.col(row).alias("_row")), seed, extra=("_row",), **options)
            .select("_row", "size", F.explode("passes").alias("_p"))
            .where(F.col("_p.words") * 2 >= F.col("size"))
        )
        passes = keep(durable(passes.select(F.col("_row").alias(row), F.col("_p.position").alias(place))))
    return rows.join(passes, row).orderBy(place, row).select(*[F.col(f"`{c}`") for c in docs.columns])
