"""Looking rows up by a key of which one value may hold a third of all rows (``lookup``), and keeping one row of many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlode.operators.skew import lookup
from assetlode.plans.staging import materialize

__all__ = ["MARK", "lookup", "only_one_of_each", "row_mark"]

MARK = "struct<a: bigint, b: bigint>"


def row_mark() -> Column:
    """128 bits of doc_id and text, so equal for rows that share both and, but for chance, for no others."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(7)).alias("b"))


def only_one_of_each(docs: DataFrame, marks: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of ``docs`` for each mark in ``winners``; ``marks`` has the marks of all rows.

    What is kept grows with the documents, so rows are shuffled by mark at every
    size, and no broadcast is planned while there are few. Rows that share doc_id
    and text, if there are any, are reduced to one before they are shuffled.
    """
    key = "mark"
    while key in [c.lower() for c in docs.columns]:
        key = f"_{key}"
    winners = materialize(winners.select(F.col("mark").alias(key)), "kept-rows")
    found = marks.select(F.col("mark").alias(key)).join(winners.hint("shuffle_hash"), key, "left_semi")
    repeated = materialize(found.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(key), "repeated-rows")
    marked = docs.withColumn(key, row_mark())
    if repeated.isEmpty():
        return marked.join(winners.hint("shuffle_hash"), key, "left_semi").drop(key)
    single = marked.join(winners.join(repeated, key, "left_anti").hint("shuffle_hash"), key, "left_semi")
    return single.unionByName(marked.join(repeated, key, "left_semi").dropDuplicates([key]).select(*single.columns)).drop(key)
