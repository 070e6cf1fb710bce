"""Joins and ranks over keys of which one value may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key with more than this share of the rows is hot; there are at most 1/HOT_SHARE of them.
HOT_SHARE = 1 / 1000
#: Groups of more rows than this are not ranked in one task.
GROUP_ROWS = 100_000


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row per key, its number of rows in ``size``).

    Hot keys go through a broadcast of at most 1/HOT_SHARE rows, all others
    through an ordinary join, so no task gathers the rows of a hot key.
    """
    heavy = groups.where(F.col(size) > max(1.0, total * HOT_SHARE))
    marks = F.broadcast(heavy.select(key, F.lit(True).alias("__hot")))
    marked = rows.join(marks, key, "left")
    hot = marked.where(F.col("__hot")).join(F.broadcast(heavy), key)
    rest = marked.where(F.col("__hot").isNull()).join(groups, key)
    return hot.unionByName(rest).drop("__hot")


def rank_in_groups(rows: DataFrame, group: str, *order: Column, most: int = GROUP_ROWS) -> DataFrame:
    """``rows`` with their 1-based ``rank`` in ``order`` within their group, and the group's ``members``.

    Groups of at most ``most`` rows are ranked by a window. Larger ones are laid
    out by range, so that many tasks share one, and ranked by their places.
    """
    from assetlode.operators.views import positions

    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    heavy = sizes.where(F.col("members") > most)
    own = Window.partitionBy(group)
    if heavy.isEmpty():
        return rows.withColumns({"rank": F.row_number().over(own.orderBy(*order)), "members": F.count(F.lit(1)).over(own)})
    light = rank_in_groups(rows.join(heavy, group, "left_anti"), group, *order, most=1 << 62)
    laid = positions(lookup(rows, heavy, group, "members", rows.count()), F.col(group), *order)
    firsts = laid.groupBy(group).agg(F.min("place").alias("__start"), F.count(F.lit(1)).alias("__rows"))
    ranked = lookup(laid, firsts, group, "__rows", laid.count()).withColumn("rank", (F.col("place") - F.col("__start") + 1).cast("int"))
    return light.unionByName(ranked.select(*light.columns))
