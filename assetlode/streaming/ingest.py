"""New files of a folder into the vector store, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetlode.functions.predicates import has_extension
from assetlode.operators.cache import VectorStore
from assetlode.sources.scan import plain_path

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, root: str, store: VectorStore, model_key: str, encode: Callable[[DataFrame], DataFrame], checkpoint: str, extensions: list[str], once: bool = True) -> StreamingQuery:
    """Watch ``root`` and put the vectors of new and changed files into the store.

    Paths are those of ``sources.scan``. A batch that is run again after a failure
    adds only the files that the store doesn't have in the same state. A stream takes
    each path once; under a new checkpoint it lists all again, and a changed file's
    row takes the place of its old one.
    """
    raw = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True).load(root)
    files = raw.select(plain_path(F.col("path")).alias("path"), F.lit("Composite").alias("channel"), F.col("length").alias("file_size"), F.unix_seconds("modificationTime").alias("mtime"), "content")

    def add(batch: DataFrame, _: int) -> None:
        known = store.read(model_key).select("path", "channel", "file_size", "mtime")
        fresh = batch.where(has_extension(F.col("path"), extensions)).join(known, ["path", "channel", "file_size", "mtime"], "left_anti")
        store.put(encode(fresh), model_key)

    writer = files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
