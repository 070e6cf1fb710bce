"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest, at a path that the caller
gives and that any later session opens again. A batch is reduced to one row per
digest; a sort-merge anti-join with the index says which digests are new, and the
batch's rows are appended: for each digest its number of rows, and the keeper where
it is new. Verdicts are read back from the index. No step carries texts through a
shuffle.

Defined results: a null text counts as empty; texts of white space only equal
the empty text; a null doc_id ranks after every other id; repeated rows count
each in ``group_size``; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are ignored. A batch that is run again under its name, be it
after a crash in the middle of an append, adds nothing twice and gives the verdicts
of its first run. Batches of one index are run one after another.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.llm.hot import lookup, only_one_of_each, row_mark
from assetlode.plans.staging import materialize, staging_path

WHITE_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


class DigestIndex:
    """An append-only table (digest binary, batch string, number long, keep_id, n_rows long) bucketed and sorted by digest.

    Batches are numbered in the order of their first append. The row of a digest's
    first batch has the keeper; each batch has a row with its count. ``path`` None
    is a private index in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or staging_path(spark, "digest-index")).rstrip("/")
        self.buckets, self.private = buckets, path is None
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"

    def open(self, id_type: str = "bigint") -> DigestIndex:
        """Register the table of ``path`` in this session; an index that is there keeps its number of buckets."""
        if not self.spark.catalog.tableExists(self.table):
            spec = self.spark.createDataFrame([], "buckets long, id_type string")
            made = self.spark.read.schema(spec.schema).parquet(f"{self.path}/spec").first() if self._exists(f"{self.path}/spec") else None
            if made is None:
                buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                self.spark.range(1).select(F.lit(buckets).cast("long").alias("buckets"), F.lit(id_type).alias("id_type")).write.mode("overwrite").parquet(f"{self.path}/spec")
            else:
                buckets, id_type = made["buckets"], made["id_type"]
            self.spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, batch STRING, number BIGINT, keep_id {id_type}, is_first BOOLEAN, n_rows BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/rows'")
            self.buckets = buckets
        return self

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(place)

    def read(self) -> DataFrame:
        return self.open().spark.table(self.table)

    def number(self, batch: str) -> tuple[int, bool]:
        """The number of a batch, and whether the index has rows of it."""
        own, last = self.read().agg(F.max(F.when(F.col("batch") == batch, F.col("number"))), F.max("number")).first()
        return (own, True) if own is not None else ((last or 0) + 1, False)

    def append(self, rows: DataFrame) -> None:
        """Add rows; one writer per bucket, so that a batch adds one file to each."""
        rows.select(*self.read().columns).repartition(self.buckets or 1, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def close(self) -> None:
        """Forget the table's name in this session; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "batch") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; appends the batch to ``index``.

    Of equal texts the row with the most code points stays, then the smallest
    doc_id. Where an earlier batch has the text, its keeper stays and
    ``group_size`` counts the rows of the batches up to this one.
    """
    return _verdicts(docs, index, batch).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (~F.col("old") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _verdicts(docs: DataFrame, index: DigestIndex, batch: str, marked: bool = False) -> DataFrame:
    """Rows with the verdict on their digest; if ``marked``, also the row's mark and, as ``keep_mark``, that of the row of its digest that stays."""
    rows = materialize(
        docs.select(
            *([row_mark().alias("mark")] if marked else []),
            "doc_id",
            F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
            F.coalesce(F.char_length("text"), F.lit(0)).alias("n_chars"),
        ),
        "digests",
    )
    rank = [(-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")]
    best = F.min(F.struct(*rank, *([F.col("mark").alias("d")] if marked else [])))
    keep_mark = [best.getField("d").alias("keep_mark")] if marked else []
    groups = materialize(rows.groupBy("digest").agg(best.getField("c").alias("keep_id"), *keep_mark, F.count(F.lit(1)).alias("n_rows")), "digest-groups")

    index.open(dict(docs.dtypes)["doc_id"])
    number, begun = index.number(batch)
    earlier = index.read().where(F.col("number") < number).select("digest")
    fresh = groups.hint("merge").join(earlier, "digest", "left_anti").withColumn("is_first", F.lit(True))
    seen = groups.hint("merge").join(earlier, "digest", "left_semi").withColumn("is_first", F.lit(False))
    added = fresh.unionByName(seen).withColumns({"batch": F.lit(batch), "number": F.lit(number).cast("long")})
    if begun:
        added = added.hint("merge").join(index.read().where(F.col("number") == number).select("digest"), "digest", "left_anti")
    index.append(added)

    # Back from the index: its rows lie by digest already.
    keeper = F.col("is_first")
    stored = index.read().where(F.col("number") <= number).groupBy("digest").agg(
        F.max(F.struct(keeper.alias("k"), "keep_id")).getField("keep_id").alias("keep_id"),
        F.max(F.when(keeper, F.col("number"))).alias("first"),
        F.sum("n_rows").alias("group_size"),
        F.max(F.when(F.col("number") == number, F.col("n_rows"))).alias("n_rows"),
    )
    verdicts = stored.where("n_rows is not null").withColumn("old", F.col("first") < number).drop("first")
    if marked:
        verdicts = verdicts.hint("merge").join(groups.select("digest", "keep_mark"), "digest")
    verdicts = materialize(verdicts, "digest-verdicts")
    if index.private:
        index.close()
    return lookup(rows, verdicts, "digest", "n_rows", rows.count())


def keep_first_copies(docs: DataFrame, index: DigestIndex | None = None, batch: str = "batch") -> DataFrame:
    """``docs`` with one row for each text that earlier batches of ``index`` don't have, whatever the doc_ids; all columns stay."""
    found = _verdicts(docs, index or DigestIndex(docs.sparkSession), batch, marked=True)
    winners = found.where(~F.col("old") & (F.col("mark") == F.col("keep_mark"))).select("mark").distinct()
    return only_one_of_each(docs, found.select("mark"), winners)
