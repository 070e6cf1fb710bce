"""From raw documents to packed sequences: quality rules, toxicity, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's documents. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assetlode.llm import exact_dedup, near_join, packing, quality_rules, toxicity
from assetlode.llm.queries import documents, labels, tokenizer
from assetlode.plans.shipping import ship
from assetlode.plans.staging import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, toxicity.fit(toxicity.training_rows(docs, labels(spark, sf_dir))))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first_copies(docs, exact_dedup.DigestIndex(spark))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = materialize(stage(spark, out, sf_dir), f"stage-{name}")
    return out


#: Trained models and the curve are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
