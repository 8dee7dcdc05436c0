"""The corpus pipeline: toxic documents go, then those in no learned language, then near-duplicates; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import base, language, neardup, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, base.table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep(docs, size=5, percent=80)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Learned stages can't be put in SQL; the pipeline is tested stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
