"""A corpus pipeline: quality, lines, near duplicates, mixture, tokens.

Every stage works on all rows that the one before kept, and is written as
Parquet and read again; all but the last return the columns of ``documents``.

For every stage: a null text counts as an empty one, and neither is dropped for
being empty unless the classifier rejects it; repeated rows are treated alike
(near_dedup keeps one row of an id); rows without an id are documents like
others, told apart by their texts (near_dedup keeps them all, as they have no id
that could stand for them); an empty table gives an empty one; more columns are
passed on as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitkeep.llm import bpe, linededup, minhash, mixing, rulefit
from orbitkeep.llm.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    return rulefit.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the first of near-equal lines only; those that consist of other documents' lines are gone."""
    rows = linededup.without_repeats(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else rows


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8."""
    return minhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one that is taken twice is there twice."""
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids and the text that these decode to."""
    return bpe.tokenized(docs, bpe.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_tokens", bpe_tokens),
]

#: Fitted rules, signatures and merges are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
