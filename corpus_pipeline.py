"""From raw documents to a mixed training corpus, stage by stage.

Every stage is written to the shared folder and read again by the next one, so a
lost executor costs at most the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import decontamination, mixing, personal_data, quality, simhash
from mapweave.sources.tables import stage

#: The whole is fitted on samples and searched by sketches, which SQL cannot express.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model does not reject."""
    return quality.select_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return simhash.keep_one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; mostly contaminated ones are dropped."""
    return decontamination.remove_contamination(docs, _table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return personal_data.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as its rate towards the target shares says."""
    return mixing.mixed_corpus(docs, _table(spark, sf_dir, "labels"), mixing.TARGETS, F.col("lang"))


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmarks),
    ("personal data", redact_personal_data),
    ("mixing to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
