"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All stages but the last return the columns of documents; the last returns packed pieces.

Cases. Null and empty texts fail the quality rules and go there; a null lang counts as '', a null doc_id as one id of all rows that
bear it, in the filters: such rows stay or go together. Repeated rows are judged alike, and one of them stays. Very long texts are
read whole. An empty table gives an empty result at each stage. Further columns of documents pass through all stages but the last,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import near_dedup, packing, quality_rules, substring_dedup, toxicity
from offerlens.llm.common import durable, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.dedup_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("best_fit_packing", pack),
]

#: A trained network and a language model have no SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
