"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents with equal texts form a group that may not be divided. Groups above a
20,000th of all bytes stand alone; the rest are hashed into as many lots, so the
differencing sees at most 40,000 items whatever the corpus holds. It keeps a heap
of partial partitions, combines the two with the largest spread, oppositely
ordered, and ends with one partition of every item into the shards.

Defined results: a null text is in a group with the empty text and has no bytes
of its own; a group heavier than a shard gets the shard for itself; repeated
rows are sharded each; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlode.plans.staging import materialize

ROW_BYTES = 16
LOTS = 20_000


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: multi-way Karmarkar-Karp."""
    if not sizes:
        return []
    if shards == 1:
        return [0] * len(sizes)
    n = len(sizes)
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)

    def vector(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        v = np.zeros(shards, dtype=np.int64)
        v[0] = sizes[node]
        return v

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        joint = vector(a) + vector(b)[::-1]
        order = np.argsort(-joint, kind="stable")
        joint = joint[order]
        node = n + len(made)
        made.append((a, b, order))
        sums[node] = joint
        heapq.heappush(heap, (int(joint[-1] - joint[0]), node))

    out = [0] * n
    places = {heap[0][1]: np.arange(shards)}
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        mine = places.pop(n + k)
        of_a = np.empty(shards, dtype=np.int64)
        of_a[order] = mine
        for child, where in ((a, of_a), (b, of_a[::-1])):
            if child < n:
                out[child] = int(where[0])
            else:
                places[child] = where
    if not made:
        out[0] = 0
    return out


def shard(docs: DataFrame, shards: int = 40, lots: int = LOTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (always null: the law is ``bytes``) per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    lot = F.pmod(F.xxhash64("group"), F.lit(lots)).cast("int")
    items = materialize(
        groups.select(
            F.when(F.col("bytes") * lots > total, F.col("group")).alias("alone"),
            F.when(F.col("bytes") * lots <= total, lot).alias("lot"),
            "bytes",
        ).groupBy("alone", "lot").agg(F.sum("bytes").alias("bytes")),
        "shard-items",
    )

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(key=[f"{int(n):08d}" if a is None else a.hex() for a, n in zip(pdf["alone"], pdf["lot"].fillna(0))])
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        pdf["shard"] = differencing([int(x) for x in pdf["bytes"]], shards)
        return pdf[["alone", "lot", "shard"]]

    placed = materialize(
        items.groupBy().applyInPandas(assign, "alone binary, lot int, shard int"), "shard-places"
    )
    # At most ``lots`` rows on either side, whatever the corpus holds.
    alone = placed.where("alone is not null").select(F.col("alone").alias("group"), F.col("shard").alias("own_shard"))
    shared = placed.where("alone is null").select("lot", F.col("shard").alias("lot_shard"))
    cell = max(256, math.isqrt(max(1, n_rows // shards)))
    cells = max(1, math.ceil(n_rows / shards / cell))
    there = (
        rows.withColumn("lot", lot)
        .join(F.broadcast(alone), "group", "left")
        .join(F.broadcast(shared), "lot", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "lot_shard").alias("shard"),
                F.pmod(F.xxhash64("doc_id", "group"), F.lit(cells)).alias("cell"))
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = there.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32")
    return (
        there.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                (F.col("first") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
