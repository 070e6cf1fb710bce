"""The incremental vector store: what to reuse, what to encode again, what to evict."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlode.plans.staging import delete, materialize

VECTOR_SCHEMA = "id string, vector array<float>, path string, channel string, file_size bigint, mtime bigint"
KEY = ["path", "channel"]


def classify(items: DataFrame, cached: DataFrame) -> DataFrame:
    """``items`` (path, channel, file_size, mtime) with status hit, changed or new."""
    known = cached.select(*KEY, F.col("file_size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    same = (F.col("old_size") == F.col("file_size")) & (F.col("old_mtime") == F.col("mtime"))
    status = F.when(F.col("known").isNull(), F.lit("new")).when(same, F.lit("hit")).otherwise(F.lit("changed"))
    return items.join(known, KEY, "left").withColumn("status", status).drop("old_size", "old_mtime", "known")


def prune(cached: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache without the paths of ``gone``."""
    return cached.join(gone.select("path").distinct(), "path", "left_anti")


def merge(items: DataFrame, cached: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What holds for ``items`` now: cached rows that still fit, and the others encoded afresh.

    Rows of files that are not among ``items`` any more do not come back.
    """
    states = classify(items, cached)
    hits = cached.join(states.where("status = 'hit'").select(*KEY), KEY, "left_semi")
    return hits.unionByName(encode(states.where("status <> 'hit'").drop("status")))


def collect_garbage(entries: DataFrame, now: int, idle_days: int = 14, most_bytes: int = 1 << 30) -> DataFrame:
    """``entries`` (path, file_size, last_used) with their fate: idle, evicted or kept.

    Idle entries go first; of the rest the longest unused go until what remains
    fits. The running sum is over days first and within a day then, so no task
    sorts the whole cache.
    """
    idle = F.col("last_used") < now - idle_days * 86_400
    live = entries.where(~idle).withColumn("day", F.floor(F.col("last_used") / 86_400))
    after = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = live.groupBy("day").agg(F.sum("file_size").alias("bytes")).select("day", F.coalesce(F.sum("bytes").over(after), F.lit(0)).alias("newer"))
    inside = F.sum("file_size").over(Window.partitionBy("day").orderBy(F.desc("last_used"), F.desc("path")))
    newest = live.withColumn("inside", inside).join(days, "day").withColumn("kept_bytes", F.col("newer") + F.col("inside"))
    fate = F.when(F.col("kept_bytes") <= most_bytes, F.lit("kept")).otherwise(F.lit("evicted"))
    return entries.where(idle).select("path", "file_size", "last_used", F.lit("idle").alias("fate")).unionByName(newest.select("path", "file_size", "last_used", fate.alias("fate")))


class VectorStore:
    """Vectors as Parquet in numbered versions by model; what has another schema doesn't count.

    A part is a folder that counts once its write has ended. Appended parts join the
    current version; a new state is written as the next version, which takes the
    place of the old one at once, and only then are older parts deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, model_key: str) -> str:
        return f"{self.root}/model_key={model_key}"

    def parts(self, model_key: str) -> dict[int, list[str]]:
        """The folders of each version whose write has ended."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(model_key))
        fs = place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        out: dict[int, list[str]] = {}
        for status in fs.listStatus(place) if fs.exists(place) else []:
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                out.setdefault(int(name[1:].partition("-")[0]), []).append(f"{self.path(model_key)}/{name}")
        return out

    def read(self, model_key: str) -> DataFrame:
        empty = self.spark.createDataFrame([], VECTOR_SCHEMA)
        parts = self.parts(model_key)
        if not parts:
            return empty
        found = self.spark.read.parquet(*sorted(parts[max(parts)]))
        return found.select(*empty.columns) if set(empty.columns) <= set(found.columns) else empty

    def _write(self, rows: DataFrame, model_key: str, version: int) -> None:
        rows.select(*self.spark.createDataFrame([], VECTOR_SCHEMA).columns).write.parquet(f"{self.path(model_key)}/v{version}-{uuid.uuid4().hex}")

    def append(self, rows: DataFrame, model_key: str) -> None:
        self._write(rows, model_key, max(self.parts(model_key), default=0))

    def replace(self, rows: DataFrame, model_key: str) -> None:
        """``rows``, which don't read this store, become its whole state."""
        old = self.parts(model_key)
        self._write(rows, model_key, max(old, default=0) + 1)
        for path in (p for paths in old.values() for p in paths):
            delete(self.spark, path)

    def put(self, rows: DataFrame, model_key: str) -> None:
        """Add ``rows``; those that are there under the same path and channel go."""
        rows = materialize(rows, "vectors")
        old = self.read(model_key)
        if old.join(rows.select(*KEY), KEY, "left_semi").isEmpty():
            self.append(rows, model_key)
        else:
            self.replace(materialize(old.join(rows.select(*KEY), KEY, "left_anti").unionByName(rows.select(*old.columns)), "vectors"), model_key)

    def refresh(self, items: DataFrame, model_key: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Bring the store up to date for ``items`` and return their rows."""
        now = materialize(merge(items, self.read(model_key), encode), "vectors")
        self.replace(now, model_key)
        return now
