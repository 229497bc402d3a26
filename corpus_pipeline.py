"""A training corpus from the documents table: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinstone.llm import jaccard, leaks, mixing, quality, secrets
from veinstone.llm.queries import table
from veinstone.llm.scratch import Scratch, made, release


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.select_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return leaks.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows."""
    return secrets.mask_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights of sources, languages and topics."""
    return mixing.sample_mixture(docs)


STAGES = [("quality classifier", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", decontaminate), ("secret scans", mask_secrets), ("mixing sources", mix_sources)]

#: SQL can express neither the classifier nor the searches; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's own intermediate tables go as soon as its rows are stored."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        mark = made()
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        release(spark, mark)
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
