"""A quality filter by importance resampling.

Two generative models of hashed word uni- and bigrams: one of target text (good
labelled documents), one of the raw corpus, counted over every document. A
document's log weight is the sum of the log ratios of the two over its n-grams; as
n-grams of one text are far from independent, one with more than ``TEMPER`` of them
counts as that many, so that the sum grows with the evidence but not with mere
length. With a Gumbel number added, the top k of all documents are a sample
without replacement in proportion to the weights.

Defined results: a null text is an empty one, with weight 0; equal keys go by
doc_id (null first); a row's Gumbel number hangs on doc_id, text and seed, and rows
that share the first two are numbered and draw one each; without target rows all
weights are 0; an empty table gives no rows; columns other than ``doc_id`` and
``text`` are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlode.llm.arrow import map_rows
from assetlode.llm.hot import lookup
from assetlode.llm.quality_rules import labelled_sample
from assetlode.llm.ranking import running_total
from assetlode.plans.staging import materialize

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: So many n-grams of a text count in full; more are scaled down to them.
TEMPER = 64.0
KEEP_SHARE = 0.85
SAMPLE_ROWS = 20_000
SEED = 10


def ngram_buckets(text: str | None) -> np.ndarray:
    """The bucket of every word and of every pair of neighbouring words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) * np.uint64(0x9E3779B97F4A7C15)
    pairs = (h[:-1] ^ (h[:-1] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]
    mixed = np.concatenate([h, pairs])
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts; a row for each bucket reaches the driver."""

    def count(part: pa.RecordBatch) -> dict:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for text in part.column("text").to_pylist():
            total += np.bincount(ngram_buckets(text), minlength=BUCKETS)
        return {"counts": pa.array([total.tolist()], pa.list_(pa.int64()))}

    rows = map_rows(texts.select("text"), count, "counts array<long>", rows=10_000)
    found = rows.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.float64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = target + SMOOTHING, raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def log_weight(buckets: np.ndarray, ratio: np.ndarray) -> float:
    n = len(buckets)
    return float(ratio[buckets].sum()) * min(1.0, TEMPER / n) if n else 0.0


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """row, doc_id, mark (a hash of doc_id and text) and log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    id_type = dict(docs.dtypes)["doc_id"]

    def run(part: pa.RecordBatch) -> dict:
        weights = [log_weight(ngram_buckets(t), shared.value) for t in part.column("text").to_pylist()]
        return {c: part.column(c) for c in ("row", "doc_id", "mark")} | {"log_weight": pa.array(weights, pa.float64())}

    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", mark.alias("mark"), "text")
    return map_rows(source, run, f"row long, doc_id {id_type}, mark long, log_weight double", rows=1000)


def numbered(weighed: DataFrame) -> DataFrame:
    """``weighed`` with a ``repeat``: 0 where the mark is the row's own, else a number that no other row of the mark has."""
    shared = materialize(weighed.groupBy("mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated-marks")
    total = weighed.count()
    single = weighed.join(shared, "mark", "left_anti").withColumn("repeat", F.lit(0).cast("long"))
    if shared.isEmpty():
        return single
    repeated = lookup(weighed, shared, "mark", "rows", total).withColumn("one", F.lit(1))
    return single.unionByName(running_total(repeated, ["mark", "row"], weighed.columns, "one", "repeat"))


def gumbel(seed: int) -> F.Column:
    """A Gumbel number that only mark, repeat and seed decide."""
    bits = F.pmod(F.xxhash64("mark", "repeat", F.lit(seed)), F.lit(1 << 52))
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))))


def resample(docs: DataFrame, labels: DataFrame, keep_share: float = KEEP_SHARE, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, place and kept of every row; the first ceil(keep_share * rows) places are kept."""
    target = bucket_counts(labelled_sample(docs, labels, "quality", rows).where("label = 1"))
    ratio = log_ratio(target, bucket_counts(docs))
    weighed = materialize(weigh(docs, ratio), "weights")
    wanted = math.ceil(weighed.count() * keep_share)
    ordered = numbered(weighed).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed)).withColumns({"down": -F.col("gumbel_key"), "one": F.lit(1)})
    placed = running_total(ordered, ["down", "doc_id", "row"], ["doc_id", "log_weight", "gumbel_key"], "one", "place")
    return placed.select("doc_id", "log_weight", "gumbel_key", "place", (F.col("place") < wanted).alias("kept"))
