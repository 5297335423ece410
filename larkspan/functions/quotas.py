"""Whole numbers shared out in proportion to weights, none above its cap, and the first rows of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.ranking import ranked


def apportion(groups: DataFrame, total: int) -> DataFrame:
    """Adds `quota` to groups (group, weight, cap: whole numbers, weights above 0).

    A group's share is its weight's part of the total; what is above a cap is shared again by weight among the others, until none is above. Shares
    are rounded down, and what is then left goes, one each, to the largest remainders, ties in order of the group. So quotas add up to the total, or to all caps if
    that is less. Whole-number arithmetic throughout. A row for each group: windows run over the groups, never over their rows.
    """
    one = F.lit(0)
    by_cap = Window.partitionBy(one).orderBy(F.expr("cap / weight"), "group")
    every = Window.partitionBy(one)
    goal = F.least(F.lit(total).cast("decimal(38,0)"), F.sum(F.col("cap").cast("decimal(38,0)")).over(every))
    # in order of cap by weight, a group is full if a fair share of what the groups before it leave reaches its cap
    placed = groups.withColumn("_goal", goal)
    placed = placed.withColumns(
        {
            "_before": F.coalesce(F.sum(F.col("cap").cast("decimal(38,0)")).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum(F.col("weight").cast("decimal(38,0)")).over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    placed = placed.withColumn("_full", (F.col("_goal") - F.col("_before")) * F.col("weight") >= F.col("cap") * F.col("_weights"))
    rest = F.col("_goal") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(every), F.lit(0))
    placed = placed.withColumns({"_rest": rest.cast("decimal(38,0)"), "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every), F.lit(0)).cast("decimal(38,0)")})
    share = "cast(cast(_rest * weight as decimal(38,0)) div greatest(_open, 1) as bigint)"
    placed = placed.withColumns({"_floor": F.when(F.col("_full"), F.col("cap")).otherwise(F.expr(share)).cast("bigint"), "_part": F.when(F.col("_full"), F.lit(-1)).otherwise(F.expr("cast(_rest * weight as decimal(38,0)) % greatest(_open, 1)"))})
    left = F.col("_goal") - F.sum("_floor").over(every)
    place = F.row_number().over(Window.partitionBy(one).orderBy(F.desc("_part"), "group"))
    placed = placed.withColumns({"_left": left, "_place": place})
    return placed.select(*groups.columns, (F.col("_floor") + F.when((F.col("_place") <= F.col("_left")) & ~F.col("_full"), 1).otherwise(0)).cast("bigint").alias("quota"))


def first_of(rows: DataFrame, group: str, order: str, ties: list[str], quotas: DataFrame) -> DataFrame:
    """Of each group the first rows by `order` (hexadecimal digits of a hash), as many as quotas (group, quota) has for it. No window over a whole group."""
    placed = ranked(rows, [group], order, ties)
    held = quotas.select(F.col("group").alias("_q"), "quota")
    return placed.join(held, F.col(group).eqNullSafe(F.col("_q"))).where("position <= quota").select(*rows.columns, "position")
