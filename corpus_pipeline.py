"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

1. quality classifier: documents that it rejects go; 2. line dedup: boilerplate lines go, and documents of which nothing but
such lines was there; 3. near-duplicates: one document of each group stays; 4. benchmark decontamination: contaminated documents
go; 5. mixing to target weights: how many words of each document the mix takes, and when.

Edge cases: a null text is scored like an empty one, has no lines and no shingles, duplicates nothing, and takes nothing from the
mix; rows that are repeated in full stay together (both are the document that stays, or neither); rows that share an id are judged
each by its own text; a null id is an id like others; an empty table, labels or benchmark passes through (without labels every
score is 0.5, and all documents stay); other columns are kept up to the mix; texts may be of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontam, line_dedup, mixing, near_dup, quality_model
from pagewright.llm.common import split_remainder, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_model.train(docs, table(spark, sf_dir, "labels"), split_remainder("doc_id", 5) != 0)
    return quality_model.score_quality(docs, model).filter("predicted = 1").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs).filter("n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns).filter("NOT contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs).select("doc_id", "source", *mixing.OUTPUTS, "positions")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix)]

#: The classifier and near-duplicate detection are beyond SQL; tests/llm holds the pipeline against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
