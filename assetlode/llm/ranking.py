"""Running totals over a total order of all rows, without one task that sees them all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlode.plans.staging import materialize


def running_total(df: DataFrame, order: list[str], carry: list[str], weight: str, name: str) -> DataFrame:
    """``carry`` columns and, as ``name``, the sum of ``weight`` over all rows that come before in ``order``.

    Rows are range-partitioned and summed within each partition; the partitions'
    sums, a row for each, shift them. ``order`` should be unique a row.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(df.dtypes)

    def lay(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = at + np.cumsum(n)
            at = int(ends[-1]) if len(ends) else at
            columns = [batch.column(c) for c in carry] + [pa.array(np.full(len(n), part), pa.int32()), pa.array(ends - n, pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "__part", "__at", "__n"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "__part int, __at long, __n long"])
    laid = materialize(
        df.select(*dict.fromkeys([*order, *carry, weight])).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lay, schema), "laid")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("__part").agg(F.max(F.col("__at") + F.col("__n")).alias("__here")).select(
        "__part", F.coalesce(F.sum("__here").over(before), F.lit(0)).alias("__first"))
    # A row for each partition, so as many as the shuffle has.
    return laid.join(F.broadcast(starts), "__part").select(*carry, (F.col("__first") + F.col("__at")).alias(name))
