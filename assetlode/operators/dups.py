"""Duplicate groups: exact by content, perceptual by fingerprint, semantic by vector; and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assetlode.functions.scalars import dot, hamming, hash_similarity
from assetlode.operators.components import connected_components
from assetlode.operators.pairs import cell_pairs, cosine_pairs, hamming_edges
from assetlode.operators.skew import lookup, rank_in_groups
from assetlode.plans.staging import materialize


def exact_groups(files: DataFrame) -> DataFrame:
    """Files that share a content hash, ranked in their group: hash, rank, is_best, path, file_size, similarity.

    Empty and unreadable files take no part. The sizes are grouped first, which
    needs no content, so that only files of equal size are compared by hash.
    """
    real = files.where("file_size > 0")
    twins = real.groupBy("file_size").count().where("count > 1").select("file_size")
    rows = real.join(twins, "file_size", "left_semi").where("content_hash is not null")
    ranked = rank_in_groups(rows, "content_hash", F.desc("file_size"), F.col("path")).where("members > 1")
    return ranked.select("content_hash", "rank", (F.col("rank") == 1).alias("is_best"), "path", "file_size", F.lit(100.0).alias("similarity"))


def ranked_members(members: DataFrame, group: str, *order: Column) -> DataFrame:
    """One row per path of each group, ranked; groups with fewer than two paths go."""
    per_path = F.row_number().over(Window.partitionBy(group, "path").orderBy(*order)) == 1
    once = members.withColumn("once", per_path).where("once").drop("once")
    return rank_in_groups(once, group, *order).where("members > 1").drop("members").withColumn("is_best", F.col("rank") == 1)


def beside_best(ranked: DataFrame, group: str, column: str) -> DataFrame:
    """``ranked`` with the best row's ``column`` of its group, as ``best``."""
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("__rows"), F.first(F.when(F.col("is_best"), F.col(column)), ignorenulls=True).alias("best"))
    return lookup(ranked, sizes, group, "__rows", ranked.count()).drop("__rows")


def perceptual_groups(hashed: DataFrame, distance: int, same_channel_only: bool = False) -> DataFrame:
    """Groups of (id, path, h, width, height, file_size) whose fingerprints are close, directly or by way of others."""
    hashed = materialize(hashed, "fingerprints")
    edges = hamming_edges(hashed, distance, *(["channel"] if same_channel_only else []))
    components = connected_components(edges, "a", "b")
    members = hashed.join(components.withColumnRenamed("node", "id"), "id")
    ranked = ranked_members(members, "component", F.desc(F.col("width") * F.col("height")), F.desc("file_size"), F.col("path"))
    score = hash_similarity(hamming(F.col("h"), F.col("best")))
    return beside_best(materialize(ranked, "ranked"), "component", "h").withColumn("similarity", F.when(F.col("is_best"), F.lit(100.0)).otherwise(score)).drop("best")


def semantic_groups(vectors: DataFrame, threshold: float, max_neighbors: int | None = None, probes: int | None = None) -> DataFrame:
    """Groups of (id, path, v, width, height, file_size) whose vectors are close, directly or by way of others.

    With ``probes``, pairs are looked for in cells; otherwise all pairs are compared.
    """
    own = vectors.select("id", "v")
    pairs = cell_pairs(own, threshold, probes) if probes else cosine_pairs(own, threshold, max_neighbors)
    components = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    members = vectors.join(components.withColumnRenamed("node", "id"), "id")
    ranked = ranked_members(members, "component", F.desc(F.col("width") * F.col("height")), F.desc("file_size"), F.col("path"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), dot(F.col("v"), F.col("best")) * 100))
    return beside_best(materialize(ranked, "ranked"), "component", "v").withColumn("similarity", F.when(F.col("is_best"), F.lit(100.0)).otherwise(score)).drop("best")


def search(vectors: DataFrame, query: list[float], limit: int = 250) -> DataFrame:
    """The nearest ``limit`` rows of (id, path, v) to ``query`` by cosine distance: one row per path, ranked."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    norm = F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(asked, asked))
    distance = F.lit(1.0) - dot(F.col("v"), asked) / norm
    nearest = vectors.withColumn("distance", distance).groupBy("path").agg(F.min(F.struct("distance", "id")).alias("m")).select("path", "m.distance", "m.id")
    top = nearest.orderBy("distance", "id").limit(limit)
    similarity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("distance"))) * 100
    # ``limit`` rows go into the ranking.
    return top.select(F.row_number().over(Window.orderBy("distance", "id")).alias("rank"), "id", "path", "distance", similarity.alias("similarity"))
