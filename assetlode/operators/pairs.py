"""Similarity self-joins: Hamming distance on fingerprints, cosine on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.functions.scalars import hamming
from assetlode.operators.skew import lookup
from assetlode.plans.staging import materialize

#: Up to this distance bands beat blocks: beyond it they let too many pairs through.
BANDED_UP_TO = 8
BLOCK = 2_048


def bands(hashes: DataFrame, distance: int, bits: int = 64) -> DataFrame:
    """``distance`` + 1 slices of each hash; two hashes that close agree in one of them at least."""
    count = distance + 1
    cuts = [bits * k // count for k in range(count + 1)]
    slices = [
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.shiftleft("h", 64 - z), 64 - (z - a)).alias("slice"))
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:]))
    ]
    return hashes.select("id", "h", F.explode(F.array(*slices)).alias("s")).select("id", "h", "s.band", "s.slice")


def _banded(hashes: DataFrame, distance: int) -> DataFrame:
    own = bands(hashes, distance)
    a = own.select(F.col("id").alias("a"), F.col("h").alias("ha"), "band", "slice")
    b = own.select(F.col("id").alias("b"), F.col("h").alias("hb"), "band", "slice")
    near = a.join(b, ["band", "slice"]).where("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb")))
    return near.where(F.col("distance") <= distance).select("a", "b", "distance").distinct()


def _dealt(rows: DataFrame, total: int, block: int) -> tuple[DataFrame, int]:
    """Rows dealt into blocks, and each to every pair of blocks it takes part in."""
    n = max(1, -(-total // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other"), n


def _in_blocks(rows: DataFrame, kernel, schema: str) -> DataFrame:
    """``kernel`` over each pair of blocks of bounded size; every pair of rows meets in one of them."""
    dealt, _ = _dealt(rows, rows.count(), BLOCK)

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        cross = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        return kernel(table, (block[:, None] < block[None, :]) if cross else np.triu(np.ones((len(block), len(block)), dtype=bool), 1))

    return dealt.groupBy("bi", "bj").applyInArrow(run, schema)


def _pair_table(table: pa.Table, i: np.ndarray, j: np.ndarray, name: str, values: pa.Array) -> pa.Table:
    ids = table.column("id").to_numpy()
    return pa.table({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), name: values})


def hamming_pairs(hashes: DataFrame, distance: int) -> DataFrame:
    """a, b, distance of all pairs (a < b) of ``hashes`` (id, h) at most ``distance`` apart; exact either way.

    Small distances go through bands, an equi-join on slices of the hash; larger
    ones through blocks, in which distances are counted in machine words.
    """
    if distance <= BANDED_UP_TO:
        return _banded(hashes, distance)

    def kernel(table: pa.Table, wanted: np.ndarray) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        apart = np.bitwise_count(h[:, None] ^ h[None, :])
        i, j = np.nonzero((apart <= distance) & wanted)
        return _pair_table(table, i, j, "distance", pa.array(apart[i, j].astype(np.int32)))

    return _in_blocks(hashes.select("id", "h"), kernel, "a long, b long, distance int")


def hamming_edges(hashes: DataFrame, distance: int, *same: str) -> DataFrame:
    """a, b that tie the rows of ``hashes`` (id, h) as all pairs at most ``distance`` apart would, ``same`` columns being equal.

    Rows of one hash are tied to the first of them, and only those firsts meet the
    others, so a hash that a third of all rows share costs one edge a row.
    """
    key = ["h", *same]
    firsts = materialize(hashes.groupBy(*key).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "hashes")
    near = hamming_pairs(firsts.select("id", "h"), distance).select("a", "b")
    for c in same:
        own = firsts.select("id", c)
        near = near.join(own.toDF("a", "__a"), "a").join(own.toDF("b", "__b"), "b").where(F.col("__a").eqNullSafe(F.col("__b"))).select("a", "b")
    shared = firsts.where("rows > 1").withColumnRenamed("id", "a")
    total = hashes.count()
    if len(key) == 1:
        tied = lookup(hashes.select("id", "h"), shared, "h", "rows", total)
    else:
        mark = F.xxhash64(*key)
        tied = lookup(hashes.withColumn("__k", mark), shared.select(mark.alias("__k"), "a", "rows"), "__k", "rows", total)
    return near.union(tied.select("a", F.col("id").alias("b")).where("a <> b"))


def cosine_pairs(vectors: DataFrame, threshold: float, max_neighbors: int | None = None) -> DataFrame:
    """a, b, similarity of all pairs (a < b) of ``vectors`` (id, v) whose dot product reaches ``threshold``.

    Blocks are multiplied as matrices in double precision. With ``max_neighbors``
    only each row's nearest pairs stay, as an approximate index would give them.
    """

    def kernel(table: pa.Table, wanted: np.ndarray) -> pa.Table:
        column = table.column("v").combine_chunks()
        v = column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
        dots = v @ v.T
        i, j = np.nonzero((dots >= threshold) & wanted)
        return _pair_table(table, i, j, "similarity", pa.array(dots[i, j]))

    pairs = _in_blocks(vectors.select("id", "v"), kernel, "a long, b long, similarity double")
    if max_neighbors is None:
        return pairs
    from pyspark.sql import Window

    pairs = materialize(pairs, "cosine-pairs")
    both = pairs.select("a", "b", "similarity").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
    near = both.withColumn("rank", rank).where(F.col("rank") <= max_neighbors)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").distinct()


# Approximate candidates, exact verification

#: Rows of the sample that cells are learnt from, and the most cells there are: the bound of what is broadcast.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4_096


def cell_centres(vectors: DataFrame, cells: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, by spherical k-means on a sample of at most SAMPLE_ROWS rows."""
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, vectors.count()))
    picked = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").limit(SAMPLE_ROWS)
    v = np.array([r[0] for r in picked.collect()], dtype=np.float64)
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if len(v) else v.reshape(0, 1)
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)] if len(v) else v
    for _ in range(rounds if len(v) else 0):
        home = (v @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, home, v)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-12), centres)
    return centres


def cell_pairs(vectors: DataFrame, threshold: float, probes: int, cells: int | None = None) -> DataFrame:
    """a, b, similarity of pairs (a < b) of ``vectors`` (id, v) that reach ``threshold`` and meet in a cell.

    Each row has its home in the nearest cell and is probed in its ``probes`` nearest
    ones; a pair meets where one is at home and the other at home or probed. Every
    row takes part, and similarities are exact; what is missed are pairs whose homes
    are no probes of each other. Cells are compared in blocks of bounded size.
    """
    total = vectors.count()
    centres = cell_centres(vectors, min(MOST_CELLS, cells or max(1, round(total**0.5))))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            column = batch.column("v")
            if batch.num_rows:
                v = column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
                near = np.argsort(-(v @ shared.value.T), axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(len(v)), near.shape[1]))
                home = np.zeros(near.shape, dtype=bool)
                home[:, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(home.ravel()), batch.column("id").take(at), column.take(at)], names=["cell", "home", "id", "v"])

    dealt = materialize(vectors.select("id", "v").mapInArrow(assign, "cell int, home boolean, id long, v array<float>"), "cells")
    # A row for each cell, of which there are MOST_CELLS at most.
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    parted = dealt.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    parted = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parted = parted.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks")

    def run(table: pa.Table) -> pa.Table:
        block, home = table.column("block").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        column = table.column("v").combine_chunks()
        v = column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
        wanted = np.triu(home[:, None] | home[None, :], 1)
        if table.column("bi")[0].as_py() != table.column("bj")[0].as_py():
            wanted &= block[:, None] != block[None, :]
        dots = v @ v.T
        i, j = np.nonzero((dots >= threshold) & wanted)
        return _pair_table(table, i, j, "similarity", pa.array(dots[i, j]))

    return parted.groupBy("cell", "bi", "bj").applyInArrow(run, "a long, b long, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
