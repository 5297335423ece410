"""Positions in a seeded hash order, without a window over a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.sources.cluster import new_folder


def seeded(seed: object, *key: str) -> Column:
    """md5 of "seed:key": a pseudo-random order that any engine reproduces."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def in_order(df: DataFrame, *order: str) -> DataFrame:
    """Adds `place` (from 0) of a row by some columns, nulls first. No window over rows: ranges of the order are written as files in the shared folder, and a row's
    place is its place in its file after the rows of all files before. Ties stand in any order, fixed by the writing."""
    spark = df.sparkSession
    path = new_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.parquet(path)
    return file_places(spark.read.schema(df.schema).parquet(path))


def file_places(rows: DataFrame) -> DataFrame:
    """Adds `place` (from 0) in the order in which the rows of a written table stand: part files by their numbers, rows by their places in them."""
    columns = rows.columns
    at = rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("bigint").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    # a row for each file
    w = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    ahead = at.groupBy(F.col("_file").alias("_f")).agg(F.count("*").alias("_n")).select("_f", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ahead"))
    return at.join(ahead, F.col("_file") == F.col("_f")).select(*columns, (F.col("_ahead") + F.col("_at")).cast("bigint").alias("place"))


def ranked(df: DataFrame, groups: Sequence[str], order: str, ties: Sequence[str], digits: int = 2) -> DataFrame:
    """Adds `position` (from 1) of a row in its group by the hex string `order`, and `group_size`.

    Groups are cut by the first digits of `order`; rows are ranked within these pieces, and counts of the pieces, at most
    16^digits for each group, give what stands ahead. A group with a third of all rows so uses many tasks.
    """
    piece = F.substring(order, 1, digits)
    counts = df.groupBy(*groups, piece.alias("_piece")).count()
    w = Window.partitionBy(*groups)
    ahead = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_piece").alias("_p"),
        F.coalesce(F.sum("count").over(w.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.sum("count").over(w).alias("group_size"),
    )
    local = df.withColumn("_piece", piece)
    local = local.withColumn("_n", F.row_number().over(Window.partitionBy(*groups, "_piece").orderBy(order, *ties)))
    on = F.col("_piece") == F.col("_p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(ahead, on).select(*df.columns, (F.col("_n") + F.col("_ahead")).alias("position"), "group_size")
