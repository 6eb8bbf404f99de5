"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens. Counted as part of lodestar.llm.

Defined cases, in every stage: an empty table stays empty; extra columns pass through, also those named like what a stage adds
(all but the last return the columns that they got). Quality rules reject null and empty texts; languages and sources may be
null. Near duplicates: rows of equal doc_id and text are one document, of which one row stays; a null doc_id stays only where no
other document of its group has an id. The secret scan leaves null and empty texts as they are. The mix repeats rows and takes
a null source as a source of its own. The last stage gives a row for each row taken, no ids for a null text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, mixing, quality, secrets, simhash
from lodestar.llm.common import MADE, materialize, remove, remove_since, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the smallest doc_id: five-word shingles."""
    small_batches(spark)
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as their source's rate says."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids: one row a document taken, with its ids and the digests of them and of their decoding."""
    small_batches(spark)
    return bpe.round_trip(docs, bpe.tokenizer_path(), with_ids=True)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", secret_scan), ("mixing", mix), ("tokens", tokens)]

#: Robust estimates, fingerprint components and the forest have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet in the shared folder and read again; what a stage needed goes once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        mark = len(MADE)
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        remove_since(spark, mark, docs.scratch_path)
        if before:
            remove(spark, before)
        before = docs.scratch_path
    return STAGES[-1][1](spark, docs, sf_dir)
