"""Connected components of a graph of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.operators.skew import lookup
from assetlode.plans.staging import discard, materialize


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components: each node keeps its least neighbour, to which the lesser others are tied.

    Where nodes are tied to several roots, this leaves about one edge a node. A
    node of many edges is summed up before the shuffle and joined, not gathered.
    """
    ordered = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct()
    low = ordered.join(ordered.groupBy("src").agg(F.min("dst").alias("low")), "src")
    return low.select("src", F.col("low").alias("dst")).union(low.where("dst <> low").select("dst", "low")).distinct()


def least_of_components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a list of edges, and for each the least node of its component."""
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = place[: len(src)], place[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return nodes, nodes[label]
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not (label[label] == label).all():
            label = label[label]


def stars(edges: DataFrame) -> DataFrame:
    """Edges with the same components, in which each partition's nodes are tied to the least they are connected with there."""

    def run(batches):
        parts = [(x.column("src").to_numpy(), x.column("dst").to_numpy()) for x in batches if x.num_rows]
        if parts:
            node, low = least_of_components(*(np.concatenate(c) for c in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(node[node != low], pa.int64()), pa.array(low[node != low], pa.int64())], names=["src", "dst"])

    return edges.mapInArrow(run, "src long, dst long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node of ``edges`` (long); nodes without edges don't appear.

    The edges are contracted first, over all and then within each shuffle partition,
    so that few rounds are left. Each takes the least label among a node's neighbours
    and then jumps to the label of that label, so that paths shorten by half or
    more; the label that most nodes have is looked up by broadcast, as no task could
    gather them. A round's labels are written in the shared folder, which cuts the
    lineage; the loop ends when no label changes.
    """
    both = stars(contracted(edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))))
    both = materialize(both.union(both.select("dst", "src")).distinct(), "edges")
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")), "labels")
    total = labels.count()
    for _ in range(max_rounds):
        seen = labels.select(F.col("node").alias("dst"), F.col("component").alias("theirs"))
        lowest = both.join(seen, "dst").groupBy("src").agg(F.min("theirs").alias("low"))
        near = labels.join(lowest.withColumnRenamed("src", "node"), "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("now"))
        near = materialize(near, "near")
        if near.where("now <> was").isEmpty():
            discard(near)
            break
        roots = near.groupBy("now").agg(F.count(F.lit(1)).alias("tied")).join(near.select(F.col("node").alias("now"), F.col("now").alias("far")), "now")
        moved = materialize(lookup(near, roots, "now", "tied", total).select("node", F.least("now", "far").alias("component")), "labels")
        discard(labels, near)
        labels = moved
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    discard(both)
    return labels
